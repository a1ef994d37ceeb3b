"""Queries of the time rule, on given tracks: actors are tracks and pose_hit is the posture cue."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxtrail.functions.text import display_status, output_path
from boxtrail.operators import incidents as inc
from boxtrail.operators import plates as pl
from boxtrail.operators import results as rt
from boxtrail.operators import runs
from boxtrail.operators import sampling as sm
from boxtrail.plans.registry import query
from boxtrail.plans.relational import FRAMED, RIDER, all_frames, framed_plates
from boxtrail.settings import DEFAULT as S
from boxtrail.settings import MOTORCYCLES
from boxtrail.sources import clips as src

# The same rule in DuckDB SQL, step by step.
RULE = """, smp AS (SELECT video_id, actor_id AS track_id, frame_idx, fps, x1, y1, x2, y2, confidence, pose_hit AS hit FROM detections JOIN rates USING (video_id) WHERE label = 'person' AND confidence >= 0.4),
lg AS (SELECT *, lag(x1) OVER w AS a1, lag(y1) OVER w AS b1, lag(x2) OVER w AS a2, lag(y2) OVER w AS b2 FROM smp WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame_idx)),
ov AS (SELECT *, greatest(0.0, least(x2, a2) - greatest(x1, a1)) * greatest(0.0, least(y2, b2) - greatest(y1, b1)) AS o FROM lg),
mv AS (SELECT video_id, track_id, frame_idx, fps, hit, x1, y1, x2, y2, a1 IS NULL AS first, a1 IS NOT NULL AND NOT (
   o / ((a2 - a1) * (b2 - b1) + (x2 - x1) * (y2 - y1) - o) >= 0.65 AND sqrt(power((x1 + x2) * 0.5 - (a1 + a2) * 0.5, 2) + power((y1 + y2) * 0.5 - (b1 + b2) * 0.5, 2)) / (b2 - b1) <= 0.08
   AND abs((x2 - x1) * (y2 - y1) - (a2 - a1) * (b2 - b1)) / ((a2 - a1) * (b2 - b1)) <= 0.2) AS moved FROM ov),
rn AS (SELECT *, sum(CASE WHEN first OR moved THEN 1 ELSE 0 END) OVER w AS run FROM mv WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING)),
rd AS (SELECT *, frame_idx - min(frame_idx) OVER (PARTITION BY video_id, track_id, run) AS still_frames FROM rn),
ht AS (SELECT *, CAST(floor(frame_idx / fps + 1e-9) AS BIGINT) AS sec, still_frames >= fps AS ready, hit AND still_frames >= fps AS counted, lead(frame_idx) OVER w AS next_frame, lead(moved) OVER w AS next_moved
   FROM rd WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame_idx)),
lr AS (SELECT *, max(run) OVER (PARTITION BY video_id, track_id, sec) AS last_run, max(frame_idx) OVER (PARTITION BY video_id, track_id, sec) AS last_frame FROM ht),
ps AS (SELECT video_id, track_id, sec, count(*) AS samples, count(*) FILTER (counted AND run = last_run) AS hits, bool_or(moved) AS has_motion,
   max(next_frame) FILTER (frame_idx = last_frame) AS next_frame, coalesce(bool_or(next_moved) FILTER (frame_idx = last_frame), false) AS next_moved FROM lr GROUP BY ALL),
gd AS (SELECT * FROM ps WHERE hits >= 3 AND next_frame IS NOT NULL AND NOT next_moved),
br AS (SELECT *, CASE WHEN lag(sec) OVER w IS NULL OR lag(sec) OVER w <> sec - 1 OR has_motion THEN 1 ELSE 0 END AS b FROM gd WINDOW w AS (PARTITION BY video_id, track_id ORDER BY sec)),
il AS (SELECT *, sum(b) OVER (PARTITION BY video_id, track_id ORDER BY sec ROWS UNBOUNDED PRECEDING) AS island FROM br),
st AS (SELECT video_id, track_id, sec, next_frame, CAST(row_number() OVER (PARTITION BY video_id, track_id, island ORDER BY sec) AS INT) AS streak FROM il),
cf AS (SELECT video_id, track_id, min(next_frame) AS confirm_frame FROM st WHERE streak >= 10 GROUP BY ALL),
ex AS (SELECT video_id, track_id, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame, max(frame_idx) + CAST(floor(3 * any_value(fps)) AS BIGINT) + 1 AS expiry_frame FROM smp GROUP BY ALL),
rg AS (SELECT video_id, track_id, confirm_frame, last_frame, expiry_frame FROM cf JOIN ex USING (video_id, track_id)),
mx AS (SELECT *, max(expiry_frame) OVER (PARTITION BY video_id ORDER BY confirm_frame, expiry_frame, track_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM rg),
ev AS (SELECT *, sum(CASE WHEN reach IS NULL OR confirm_frame > reach THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY confirm_frame, expiry_frame, track_id ROWS UNBOUNDED PRECEDING) AS event FROM mx),
iv AS (SELECT video_id, CAST(event - 1 AS BIGINT) AS event_index, min(confirm_frame) AS start_frame, max(expiry_frame) AS stop FROM ev GROUP BY video_id, event),
incidents AS (SELECT video_id, event_index, start_frame, CASE WHEN stop >= total_frames THEN total_frames - 1 ELSE stop END AS end_frame, start_frame / fps AS start_sec,
   (CASE WHEN stop >= total_frames THEN total_frames - 1 ELSE stop END) / fps AS end_sec, stop >= total_frames AS open_interval FROM iv JOIN clips USING (video_id)),
frames AS (SELECT video_id, unnest(range(0, total_frames)) AS frame_idx FROM clips),
act AS (SELECT f.video_id, f.frame_idx, bool_or(r.track_id IS NOT NULL) AS active FROM frames f LEFT JOIN rg r ON r.video_id = f.video_id AND f.frame_idx >= r.confirm_frame AND f.frame_idx < r.expiry_frame GROUP BY ALL),
ss AS (SELECT h.video_id, h.track_id, h.frame_idx, h.ready, coalesce(h.frame_idx >= r.confirm_frame, false) AS confirmed,
   CASE WHEN bool_or(h.moved) OVER (PARTITION BY h.video_id, h.track_id, h.sec ORDER BY h.frame_idx ROWS UNBOUNDED PRECEDING) THEN 0 ELSE coalesce(s.streak, 0) END AS good_seconds
   FROM ht h LEFT JOIN st s ON s.video_id = h.video_id AND s.track_id = h.track_id AND s.sec = h.sec - 1 LEFT JOIN rg r ON r.video_id = h.video_id AND r.track_id = h.track_id)
"""


def samples(d):
    rows = sm.confidence_filter(d["detections"], ("person",), S.scene_confidence)
    rows = sm.with_rate(rows, d["clips"])
    return rows.select("video_id", F.col("actor_id").alias("track_id"), "frame_idx", "fps", "x1", "y1", "x2", "y2", F.col("pose_hit").alias("hit"))


def per_second(d):
    hits, _, _ = inc.time_rule(samples(d))
    return inc.hits_per_second(hits)


def ranges(d):
    return inc.time_rule(samples(d))[2]


def intervals(d):
    return inc.incident_intervals(ranges(d), d["clips"])


SAMPLE = ["video_id", "track_id", "frame_idx"]


@query("box_motion", RULE + "SELECT video_id, track_id, frame_idx, first, moved FROM mv")
def _(d):
    return inc.box_motion(samples(d)).select(*SAMPLE, "first", "moved")


@query("still_time", RULE + "SELECT video_id, track_id, frame_idx, still_frames, ready FROM ht")
def _(d):
    return inc.still_time(inc.box_motion(samples(d))).select(*SAMPLE, "still_frames", "ready")


@query("gated_hits", RULE + "SELECT video_id, track_id, sec, hits FROM ps WHERE NOT next_moved")
def _(d):
    return per_second(d).filter("not next_moved").select("video_id", "track_id", "sec", "hits")


@query("hits_per_second", RULE + "SELECT video_id, track_id, sec, samples, hits, has_motion FROM ps")
def _(d):
    return per_second(d).select("video_id", "track_id", "sec", "samples", "hits", "has_motion")


@query("good_seconds", RULE + "SELECT video_id, track_id, sec FROM gd")
def _(d):
    return inc.good_seconds(per_second(d)).select("video_id", "track_id", "sec")


@query("good_streak", RULE + "SELECT video_id, track_id, sec, streak FROM st")
def _(d):
    return inc.good_streak(per_second(d)).select("video_id", "track_id", "sec", "streak")


@query("confirm_latch", RULE + "SELECT * FROM cf")
def _(d):
    return inc.confirm_latch(inc.good_streak(per_second(d)))


@query("track_expiry", RULE + "SELECT * FROM ex")
def _(d):
    return inc.track_expiry(samples(d))


@query("incident_intervals", RULE + "SELECT * FROM incidents")
def _(d):
    return intervals(d)


@query("event_index", RULE + "SELECT video_id, start_frame, event_index FROM incidents")
def _(d):
    return intervals(d).select("video_id", "start_frame", "event_index")


@query("frame_active", RULE + "SELECT * FROM act")
def _(d):
    return inc.frame_active(all_frames(d), ranges(d))


@query("edges", RULE + ", e AS (SELECT *, lag(active, 1, false) OVER (PARTITION BY video_id ORDER BY frame_idx) AS b FROM act) SELECT video_id, frame_idx, active AND NOT b AS enter, NOT active AND b AS exit FROM e WHERE active <> b")
def _(d):
    return inc.edges(inc.frame_active(all_frames(d), ranges(d))).filter("enter or exit").select("video_id", "frame_idx", "enter", "exit")


MARKED = """, ls AS (SELECT *, lead(frame_idx) OVER (PARTITION BY video_id, track_id ORDER BY frame_idx) AS until FROM smp),
hd AS (SELECT l.video_id, l.track_id, greatest(l.frame_idx, confirm_frame) AS fr, least(coalesce(until, expiry_frame), expiry_frame) AS upto, x1, y1, x2, y2 FROM ls l JOIN rg USING (video_id, track_id)),
mk AS (SELECT f.video_id, f.frame_idx, h.track_id, h.x1, h.y1, h.x2, h.y2 FROM frames f JOIN hd h ON h.video_id = f.video_id AND f.frame_idx >= h.fr AND f.frame_idx < h.upto)"""


@query("interval_frames", RULE + MARKED + "SELECT * FROM mk")
def _(d):
    return inc.marked_frames(samples(d), d["clips"])


def states(d):
    return inc.sample_state(samples(d))


@query("suspected", RULE + "SELECT video_id, track_id, frame_idx, good_seconds FROM ss WHERE NOT confirmed AND ready AND good_seconds > 0")
def _(d):
    return states(d).filter("suspected").select(*SAMPLE, "good_seconds")


@query("progress_score", RULE + "SELECT video_id, frame_idx, max(CASE WHEN confirmed THEN 1.0 ELSE least(1.0, good_seconds / 10) END) AS score FROM ss GROUP BY ALL")
def _(d):
    return inc.progress_score(states(d))


@query("count_reasons", RULE + f""", gp AS ({RIDER}),
gd2 AS (SELECT d.* FROM detections d SEMI JOIN gp USING (video_id, frame_idx, ord)),
a AS (SELECT video_id, count(*) AS seen FROM detections WHERE label = 'person' GROUP BY video_id), b AS (SELECT video_id, count(*) AS n, count(*) FILTER (
   least(1500, ceil(x2 + (x2 - x1) * 0.12)) <= greatest(0, floor(x1 - (x2 - x1) * 0.12)) OR least(700, ceil(y2 + (y2 - y1) * 0.12)) <= greatest(0, floor(y1 - (y2 - y1) * 0.12))) AS small_crop FROM gd2 GROUP BY video_id),
o AS (SELECT video_id, CAST(sum(greatest(n - 3, 0)) AS BIGINT) AS over_cap FROM (SELECT video_id, frame_idx, count(*) AS n FROM gd2 GROUP BY ALL) q GROUP BY video_id),
m AS (SELECT video_id, count(*) FILTER (moved) AS motion_resets, count(*) FILTER (NOT ready) AS not_still, count(*) FILTER (hit AND NOT ready) AS hits_ignored, count(*) FILTER (hit AND ready AND next_moved) AS hits_before_motion FROM ht GROUP BY video_id)
SELECT video_id, seen - coalesce(n, 0) AS rider, coalesce(over_cap, 0) AS over_cap, coalesce(small_crop, 0) AS small_crop, coalesce(motion_resets, 0) AS motion_resets, coalesce(not_still, 0) AS not_still, coalesce(hits_ignored, 0) AS hits_ignored, coalesce(hits_before_motion, 0) AS hits_before_motion
FROM a LEFT JOIN b USING (video_id) LEFT JOIN o USING (video_id) LEFT JOIN m USING (video_id)""")
def _(d):
    hits, _, _ = inc.time_rule(samples(d))
    seen = d["detections"].filter("label = 'person'")
    gated = sm.rider_exclusion(seen, d["detections"].filter(F.col("label").isin(*MOTORCYCLES)))
    return inc.count_reasons(seen, gated, hits, 1500, 700, cap=3)


@query("incidents_per_clip", RULE + "SELECT video_id, count(event_index) AS events, count(event_index) > 0 AS detected FROM clips LEFT JOIN incidents USING (video_id) GROUP BY video_id")
def _(d):
    return runs.incidents_per_clip(d["clips"], intervals(d))


CLOCK = "CASE WHEN {0} < 60 THEN format('{{:.2f}}s', {0}) ELSE format('{{}}m {{:.2f}}s', CAST(floor({0} / 60) AS INT), {0} % 60) END"
TIME = "format('{{}}:{{:06.3f}}', CAST(floor({0} / 60) AS INT), {0} % 60)"
SIX = "format('{{:.6f}}', {0})"

# Runs: every seventh clip has no frame rate and fails; step seconds and counters are shares of a clip's frames and boxes.
RUNS = """, cn AS (SELECT video_id, count(DISTINCT frame_idx) AS f, count(*) FILTER (label = 'person') AS p FROM detections GROUP BY video_id),
tm AS (SELECT video_id, f / 8.0 AS other_sec, f / 32.0 AS yolo_sec, p / 64.0 AS peeing_sec, f / 64.0 AS annotate_draw_sec, f / 16.0 AS video_write_sec, f AS yolo_input_frames, CAST(ceil(f / 8.0) AS BIGINT) AS yolo_batch_launches,
   0 AS yolo_padded_slots, CAST(ceil(f / 8.0) AS BIGINT) * 8 - f AS yolo_max_batch_slack, p AS peeing_pose_input_crops, CAST(ceil(p / 16.0) AS BIGINT) AS peeing_pose_batch_launches, 0 AS peeing_pose_padded_slots,
   CAST(ceil(p / 16.0) AS BIGINT) * 16 - p AS peeing_pose_max_batch_slack, CAST(ceil(f / 8.0) AS BIGINT) AS peeing_pose_prefetch_windows, f AS peeing_pose_prefetch_frames, p AS peeing_pose_prefetch_crops, p % 7 AS peeing_pose_prefetch_unused_hits FROM cn),
rs AS (SELECT c.video_id, path AS input_path, regexp_replace(regexp_replace(path, '^/clips/', '/out/'), '(\\.[^./]*)$', '_marked\\1') AS output_path, video_id % 7 <> 3 AS success, CASE WHEN video_id % 7 = 3 THEN 'invalid frame rate' ELSE '' END AS error,
   width, height, CASE WHEN video_id % 7 = 3 THEN 0.0 ELSE fps END AS fps, total_frames, CASE WHEN video_id % 7 = 3 THEN 0.0 ELSE total_frames / fps END AS duration, (f + 8) / 4.0 AS wall_sec, 16.5 AS models_init_sec FROM clips c JOIN cn USING (video_id))"""


def run_clips(d):
    """A row for each clip: paths, size, whether it can be read."""
    meta = runs.clip_metadata(d["clips"].withColumn("fps", F.when(F.col("video_id") % 7 == 3, 0.0).otherwise(F.col("fps"))))
    told = runs.error_rows(meta).drop("path").join(meta.select("video_id", "path", "fps", "width", "height", "total_frames"), "video_id")
    return told.withColumn("output_path", output_path(F.col("path"), "/clips", "/out", "_marked")).withColumnRenamed("path", "input_path")


def run_tables(d):
    """(runs, times) of all clips."""
    n = d["detections"].groupBy("video_id").agg(F.count_distinct("frame_idx").alias("f"), F.count_if(F.col("label") == "person").alias("p"))
    f, p = F.col("f"), F.col("p")
    times = n.select(
        "video_id", (f / 8).alias("other_sec"), (f / 32).alias("yolo_sec"), (p / 64).alias("peeing_sec"), (f / 64).alias("annotate_draw_sec"), (f / 16).alias("video_write_sec"),
        f.alias("yolo_input_frames"), F.ceil(f / 8).alias("yolo_batch_launches"), F.lit(0).alias("yolo_padded_slots"), (F.ceil(f / 8) * 8 - f).alias("yolo_max_batch_slack"),
        p.alias("peeing_pose_input_crops"), F.ceil(p / 16).alias("peeing_pose_batch_launches"), F.lit(0).alias("peeing_pose_padded_slots"), (F.ceil(p / 16) * 16 - p).alias("peeing_pose_max_batch_slack"),
        F.ceil(f / 8).alias("peeing_pose_prefetch_windows"), f.alias("peeing_pose_prefetch_frames"), p.alias("peeing_pose_prefetch_crops"), (p % 7).alias("peeing_pose_prefetch_unused_hits"),
    )
    told = run_clips(d).join(n.select("video_id", ((f + 8) / 4).alias("wall_sec")), "video_id").withColumn("models_init_sec", F.lit(16.5))
    return told, times


OK = "CASE WHEN success THEN {0} END"
SUMMARY = RUNS + f""" SELECT input_path, output_path, success, error, width, height, {OK.format(SIX.format("fps"))} AS fps, {OK.format("total_frames")} AS total_frames, {OK.format(SIX.format("duration"))} AS duration_sec,
  {OK.format(CLOCK.format("duration"))} AS video_duration_str, {SIX.format("wall_sec")} AS wall_sec, {CLOCK.format("wall_sec")} AS wall_duration_str, {CLOCK.format("wall_sec")} AS completed_in_min_sec, {SIX.format("models_init_sec")} AS models_init_sec,
  {", ".join(f"{SIX.format(c)} AS {c}" for c in rt.SECONDS)}, {OK.format(SIX.format("(yolo_sec + peeing_sec + annotate_draw_sec)"))} AS inference_sec, {OK.format(SIX.format("(video_write_sec + other_sec)"))} AS encode_io_sec,
  {", ".join(rt.COUNTERS)}, count(event_index) > 0 AS peeing_detected, count(event_index) AS peeing_event_count FROM rs JOIN tm USING (video_id) LEFT JOIN incidents i ON i.video_id = rs.video_id AND success GROUP BY ALL"""


def summary(d):
    told, times = run_tables(d)
    good = told.filter("success").select("video_id")
    return rt.summary_table(told, times, runs.incidents_per_clip(good, intervals(d)).drop("detected"))


def through_csv(d, rows):
    """The rows of a run, written by a first try that had half of them, repeated, and read back; empty fields of text columns that are never null come back as text."""
    path = src.scratch(d.spark, "results")
    src.append_csv(rows.filter(F.xxhash64("input_path") % 2 == 0), path, "night")
    src.append_csv(rows, path, "night")
    back = src.read_runs(d.spark, path, rows.schema).drop("run")
    return back.withColumn("error", F.coalesce("error", F.lit(""))) if "error" in back.columns else back


FOLDER = "regexp_extract(path, '([^/]*)/[^/]*$', 1)"


@query("batch_totals", RUNS + f""", rt AS (SELECT rs.video_id, {FOLDER} AS folder, success, wall_sec, CASE WHEN success THEN duration END AS duration, CASE WHEN success THEN yolo_sec + peeing_sec + annotate_draw_sec END AS infer, CASE WHEN success THEN video_write_sec + other_sec END AS io FROM rs JOIN tm USING (video_id) JOIN (SELECT video_id, path FROM clips) c USING (video_id))
  SELECT folder, video_id, count(*) FILTER (success) AS ok, count(*) FILTER (NOT success) AS failed, round(sum(duration), 6) AS duration_sec, round(sum(wall_sec), 6) AS wall_sec, round(sum(infer), 6) AS inference_sec, round(sum(io), 6) AS encode_io_sec FROM rt GROUP BY ROLLUP (folder, video_id)""")
def _(d):
    told, times = run_tables(d)
    folders = told.withColumn("folder", F.regexp_extract("input_path", "([^/]*)/[^/]*$", 1))
    rounded = {c: F.round(c, 6) for c in ("duration_sec", "wall_sec", "inference_sec", "encode_io_sec")}
    return runs.batch_totals(folders, rt.step_sums(times), "folder", "video_id").withColumns(rounded)


@query("batch_job", RULE + SUMMARY)
def _(d):
    return summary(d)


@query("write_summary", RULE + SUMMARY)
def _(d):
    return through_csv(d, summary(d))


@query("write_manifest", RUNS + f"""SELECT input_path, output_path, success, error, {SIX.format("duration")} AS duration_sec, {SIX.format("fps")} AS fps, width, height, total_frames, {SIX.format("wall_sec")} AS wall_sec,
  {SIX.format("(yolo_sec + peeing_sec + annotate_draw_sec)")} AS inference_sec, {SIX.format("(video_write_sec + other_sec)")} AS encode_io_sec, {SIX.format("models_init_sec")} AS models_init_sec FROM rs JOIN tm USING (video_id)""")
def _(d):
    return through_csv(d, rt.manifest_table(*run_tables(d)))


def incident_table(d, rows, rg):
    """The interval table in full of tracked samples and their confirmed ranges, which are few and worked out once."""
    rg = src.kept(rg, "ranges")
    iv = inc.incident_intervals(rg, d["clips"])
    last = F.when(F.col("open_interval"), F.col("end_frame")).otherwise(F.col("end_frame") - 1)
    return rt.interval_table(iv, inc.marked_boxes(iv.select("video_id", last.alias("frame_idx")), rows, rg), run_clips(d))


INCIDENT_TABLE = MARKED + RUNS + f""", bx AS (SELECT video_id, frame_idx, count(*) AS n, CAST(to_json(list([x1, y1, x2, y2] ORDER BY track_id)) AS VARCHAR) AS j FROM mk GROUP BY ALL)
  SELECT input_path, output_path, event_index, start_frame, end_frame, {SIX.format("start_sec")} AS start_sec, {SIX.format("end_sec")} AS end_sec, {SIX.format("(end_sec - start_sec)")} AS duration_sec, {TIME.format("start_sec")} AS start_time_str,
  {TIME.format("end_sec")} AS end_time_str, {CLOCK.format("(end_sec - start_sec)")} AS duration_str, coalesce(n, 0) AS n_confirmed_bboxes, coalesce(j, '[]') AS bboxes_json, open_interval
  FROM incidents i JOIN rs ON rs.video_id = i.video_id AND success LEFT JOIN bx ON bx.video_id = i.video_id AND bx.frame_idx = CASE WHEN open_interval THEN end_frame ELSE end_frame - 1 END"""


@query("incident_job", RULE + INCIDENT_TABLE)
def _(d):
    return incident_table(d, samples(d), ranges(d))


@query("write_incidents", RULE + INCIDENT_TABLE)
def _(d):
    return through_csv(d, incident_table(d, samples(d), ranges(d)))


@query("display_job", RULE + "SELECT video_id, track_id, frame_idx, CASE WHEN confirmed THEN 'CONFIRMED' WHEN good_seconds > 0 AND ready THEN format('suspect {}s', good_seconds) ELSE 'person' END AS status FROM ss")
def _(d):
    return states(d).select(*SAMPLE, display_status(F.col("confirmed"), F.col("good_seconds"), F.col("ready")).alias("status"))


# Plate texts over given vehicle tracks.
PLATE = """, pr AS (SELECT video_id, actor_id AS track_id, frame_idx, score, plate_confidence, regexp_replace(regexp_replace(raw_text, '[^0-9A-Za-z]+', '-', 'g'), '^-|-$', '', 'g') AS t FROM plates),
pb AS (SELECT *, max(CASE WHEN t <> '' AND score >= 0.5 THEN struct_pack(s := score, f := frame_idx, t := t) END) OVER w AS b FROM pr WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING)),
rb AS (SELECT video_id, track_id, frame_idx, score, plate_confidence, coalesce(b.t, '') AS best_text, coalesce(b.s, 0.0) AS best_score FROM pb),
lk AS (SELECT *, bool_or(best_score >= 0.9 AND length(best_text) >= 3 AND contains(substr(best_text, 2, length(best_text) - 2), '-')) OVER (PARTITION BY video_id, track_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) AS locked FROM rb)
"""


def readings(d):
    return d["plates"].withColumnRenamed("actor_id", "track_id")


@query("running_best_text", PLATE + "SELECT video_id, track_id, frame_idx, best_text, best_score FROM rb")
def _(d):
    return pl.running_best_text(readings(d)).select(*SAMPLE, "best_text", "best_score")


@query("text_lock", PLATE + "SELECT video_id, track_id, frame_idx, locked FROM lk")
def _(d):
    return pl.text_lock(readings(d)).select(*SAMPLE, "locked")


# samples whose frame number six divides are read, and their label stays for the samples after them
CARRIED = PLATE + """, p6 AS (SELECT *, max(CASE WHEN t <> '' AND score >= 0.5 THEN struct_pack(s := score, f := frame_idx, t := t) END) OVER (PARTITION BY video_id, track_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) AS b FROM pr WHERE frame_idx % 6 = 0),
r6 AS (SELECT *, coalesce(b.t, '') AS best_text, coalesce(b.s, 0.0) AS best_score FROM p6),
l6 AS (SELECT video_id, track_id, frame_idx, CASE WHEN best_text <> '' THEN format('{} {:.2f}', best_text, best_score) WHEN score >= 0.5 THEN format('{:.2f}', score) ELSE format('LP {:.2f}', plate_confidence) END AS label FROM r6),
lc AS (SELECT v.video_id, v.track_id, v.frame_idx, last_value(label IGNORE NULLS) OVER (PARTITION BY v.video_id, v.track_id ORDER BY v.frame_idx ROWS UNBOUNDED PRECEDING) AS label FROM pr v LEFT JOIN l6 USING (video_id, track_id, frame_idx))
"""


@query("label_carry", CARRIED + "SELECT * FROM lc")
def _(d):
    rows = readings(d)
    return pl.label_carry(rows.filter("frame_idx % 6 = 0"), rows.select(*SAMPLE)).select(*SAMPLE, "label")


def cadence(d):
    return pl.read_cadence(framed_plates(d).withColumnRenamed("actor_id", "track_id"))


def overlap_sql(a, b):
    """Overlap over union of boxes with area, in DuckDB."""
    o = f"greatest(0.0, least({a}x2, {b}x2) - greatest({a}x1, {b}x1)) * greatest(0.0, least({a}y2, {b}y2) - greatest({a}y1, {b}y1))"
    return f"({o}) / (({a}x2 - {a}x1) * ({a}y2 - {a}y1) + ({b}x2 - {b}x1) * ({b}y2 - {b}y1) - {o})"


def cadence_sql(readings, key):
    """The reading of each track in DuckDB: one sample after the other. ``readings`` has the key, frame_idx, t, score and the plate box."""
    of = ", ".join(key)
    apart = lambda c: f"abs((p_{c}1 + p_{c}2) - (q.{c}1 + q.{c}2)) / 2 <= 0.75 * greatest(8.0, p_x2 - p_x1, p_y2 - p_y1, q.x2 - q.x1, q.y2 - q.y1)"
    near = f"({overlap_sql('p_', 'q.')} >= 0.15 OR ({apart('x')} AND {apart('y')}))"
    better = "action = 'read' AND t <> '' AND score >= 0.5 AND score >= conf"
    box = ", ".join(f"CASE WHEN action = 'skip' THEN p_{c} ELSE {c} END AS p_{c}" for c in ("x1", "y1", "x2", "y2"))
    return f""", rd AS MATERIALIZED (SELECT {of}, frame_idx, t, length(t) >= 3 AND contains(substr(t, 2, length(t) - 2), '-') AS dashed, score, CAST(g_x1 AS DOUBLE) AS x1, CAST(g_y1 AS DOUBLE) AS y1, CAST(g_x2 AS DOUBLE) AS x2, CAST(g_y2 AS DOUBLE) AS y2,
   row_number() OVER (PARTITION BY {of} ORDER BY frame_idx) AS k FROM ({readings}) q),
rec AS (SELECT {of}, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS frame_idx, '' AS action, '' AS text, CAST(0 AS DOUBLE) AS conf, false AS locked, CAST(NULL AS BIGINT) AS last, CAST(NULL AS DOUBLE) AS p_x1, CAST(NULL AS DOUBLE) AS p_y1, CAST(NULL AS DOUBLE) AS p_x2, CAST(NULL AS DOUBLE) AS p_y2 FROM rd WHERE rd.k = 1
 UNION ALL SELECT r.* FROM (SELECT {of}, k, frame_idx, action, CASE WHEN {better} THEN t ELSE text END AS text, CASE WHEN {better} THEN score ELSE conf END AS conf, locked OR ({better} AND score >= 0.9 AND dashed) AS locked, CASE WHEN action = 'skip' THEN last ELSE frame_idx END AS last, {box}
   FROM (SELECT q.*, r.text, r.conf, r.locked, r.last, r.p_x1, r.p_y1, r.p_x2, r.p_y2, CASE WHEN q.frame_idx - r.last < CASE WHEN r.locked THEN 20 ELSE 5 END THEN 'skip' WHEN r.locked AND r.text <> '' AND r.conf >= 0.9 AND coalesce({near}, false) THEN 'keep' ELSE 'read' END AS action
     FROM rec r JOIN rd q ON {" AND ".join(f"q.{c} = r.{c}" for c in key)} AND q.k = r.k + 1) z) r),
cd AS (SELECT {of}, frame_idx, action, text, conf AS text_confidence, locked FROM rec WHERE k > 0)
"""


TEXT = "regexp_replace(regexp_replace(raw_text, '[^0-9A-Za-z]+', '-', 'g'), '^-|-$', '', 'g') AS t"
READINGS = f"SELECT f.video_id, actor_id AS track_id, frame_idx, {TEXT}, score, plate_confidence, g_x1, g_y1, g_x2, g_y2 FROM framed f JOIN plates USING (video_id, frame_idx, ord)"
CADENCE = FRAMED + cadence_sql(READINGS, ("video_id", "track_id"))


@query("plate_cadence", CADENCE + "SELECT video_id, track_id, frame_idx, action FROM cd")
def _(d):
    return cadence(d).select(*SAMPLE, "action")


@query("reuse_locked_text", CADENCE + "SELECT video_id, track_id, frame_idx, text, text_confidence FROM cd WHERE action = 'keep'")
def _(d):
    return cadence(d).filter("action = 'keep'").select(*SAMPLE, "text", "text_confidence")
