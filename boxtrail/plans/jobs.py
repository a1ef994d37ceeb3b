"""Whole jobs: association, litter, plates, sweep, annotation."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxtrail.functions import geometry as g
from boxtrail.functions.pose import HIP, KNEE, WRIST, posture_cue, standing_sides, wrist_groin
from boxtrail.functions.text import head_label, litter_class
from boxtrail.operators import evaluation as ev
from boxtrail.operators import incidents as inc
from boxtrail.operators import plates as pl
from boxtrail.operators import results as rt
from boxtrail.operators import sampling as sm
from boxtrail.operators import tracking as tr
from boxtrail.plans.registry import query
from boxtrail.plans.relational import FRAMED, KEY, POSE_CARRY, RIDER, framed_plates, held_poses
from boxtrail.plans.timerule import CARRIED, INCIDENT_TABLE, MARKED, PLATE, RULE, TEXT, cadence_sql, incident_table, overlap_sql, ranges, readings, samples
from boxtrail.settings import DEFAULT as S
from boxtrail.settings import MOTORCYCLES, PERSON, VEHICLES
from boxtrail.sources import clips as src


def persons(d):
    det = d["detections"]
    seen = sm.with_rate(sm.confidence_filter(det, ("person",), S.scene_confidence), d["clips"])
    return sm.rider_exclusion(seen, sm.confidence_filter(det, MOTORCYCLES, S.scene_confidence))


def vehicles(d):
    return sm.with_rate(sm.confidence_filter(d["detections"], VEHICLES, S.scene_confidence), d["clips"])


def associated_sql(rows, order, least):
    """Greedy association in DuckDB, one sample after the other: tk has video_id, segment, frame_idx, ord, track_id. Rows have most, the frames after which a track is gone."""
    box = "'x1': b.x1, 'y1': b.y1, 'x2': b.x2, 'y2': b.y2, 'f': f.frame_idx"
    same = "'x1': t.x1, 'y1': t.y1, 'x2': t.x2, 'y2': t.y2, 'f': t.f"
    said = "CAST([] AS STRUCT(ord INT, id BIGINT)[])"
    return f""", fr AS MATERIALIZED (SELECT video_id, segment, frame_idx, row_number() OVER (PARTITION BY video_id, segment ORDER BY frame_idx) AS k, list({{'ord': ord, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY {order}) AS boxes, any_value(most) AS most FROM ({rows}) q GROUP BY video_id, segment, frame_idx),
rec1 AS (SELECT video_id, segment, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS frame_idx, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(id BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, f BIGINT, u BOOLEAN)[]) AS tracks, {said} AS said FROM fr WHERE fr.k = 1
 UNION ALL SELECT r.video_id, r.segment, r.k, r.frame_idx, r.s.n, r.s.tracks, r.s.said FROM (SELECT p.video_id, p.segment, f.k, f.frame_idx, list_reduce(f.boxes, lambda acc, b:
   list_transform([list_max(list_filter(list_transform(acc.tracks, lambda t: {{'o': CASE WHEN t.u THEN -1.0 ELSE {overlap_sql('t.', 'b.')} END, 'neg': -t.id}}), lambda c: c.o >= {least}))], lambda m:
     CASE WHEN m IS NULL THEN {{'n': acc.n + 1, 'tracks': list_append(acc.tracks, {{'id': acc.n, {box}, 'u': false}}), 'said': list_append(acc.said, {{'ord': b.ord, 'id': acc.n}})}}
     ELSE {{'n': acc.n, 'tracks': list_transform(acc.tracks, lambda t: CASE WHEN t.id = -m.neg THEN {{'id': t.id, {box}, 'u': true}} ELSE t END), 'said': list_append(acc.said, {{'ord': b.ord, 'id': -m.neg}})}} END)[1],
   {{'n': p.n, 'tracks': list_transform(list_filter(p.tracks, lambda t: f.frame_idx - t.f <= f.most), lambda t: {{'id': t.id, {same}, 'u': false}}), 'said': {said}}}) AS s FROM rec1 p JOIN fr f ON f.video_id = p.video_id AND f.segment = p.segment AND f.k = p.k + 1) r),
tk AS MATERIALIZED (SELECT video_id, segment, frame_idx, u.ord AS ord, u.id AS track_id FROM (SELECT video_id, segment, frame_idx, unnest(said) AS u FROM rec1) z)
"""


def segments_sql(rows):
    """The rows with a segment that grows where consecutive frames are more than their ``most`` apart."""
    return f"""SELECT q.*, segment FROM ({rows}) q JOIN (SELECT video_id, frame_idx, CAST(sum(g) OVER (PARTITION BY video_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM
  (SELECT video_id, frame_idx, CASE WHEN frame_idx - lag(frame_idx) OVER (PARTITION BY video_id ORDER BY frame_idx) > most THEN 1 ELSE 0 END AS g FROM (SELECT DISTINCT video_id, frame_idx, most FROM ({rows}) d1) d2) d3) d4 USING (video_id, frame_idx)"""


BOXED = "SELECT video_id, frame_idx, ord, confidence, x1, y1, x2, y2, {} AS most FROM detections JOIN rates USING (video_id)"
GATED_PERSONS = f", gp AS MATERIALIZED ({RIDER})"
PERSON_ROWS = f"{BOXED.format('3 * fps')} SEMI JOIN gp USING (video_id, frame_idx, ord) WHERE confidence >= 0.4"
PERSON_TRACKS = GATED_PERSONS + associated_sql(segments_sql(PERSON_ROWS), "confidence DESC, ord", S.person_iou)
VEHICLE_TRACKS = associated_sql(segments_sql(f"{BOXED.format('stride')} WHERE label <> 'person' AND confidence >= 0.4"), "ord", S.vehicle_iou)


@query("associate_persons", PERSON_TRACKS + "SELECT * FROM tk")
def _(d):
    return tr.associate_persons(persons(d)).select(*KEY, "segment", "track_id")


@query("associate_vehicles", VEHICLE_TRACKS + "SELECT * FROM tk")
def _(d):
    return tr.associate_vehicles(vehicles(d)).select(*KEY, "segment", "track_id")


def keypoints(hit):
    """Keypoints of a standing person with a hand near the hips, or far from them."""
    at = lambda y: F.struct(F.lit(0.5).alias("x"), y.alias("y"), F.lit(0.9).alias("c"))
    y = {WRIST["L"]: F.when(hit, 0.53).otherwise(0.2), HIP["L"]: F.lit(0.5), HIP["R"]: F.lit(0.52), KNEE["L"]: F.lit(0.8)}
    unseen = F.struct(F.lit(0.5).alias("x"), F.lit(0.5).alias("y"), F.lit(0.0).alias("c"))
    return F.array(*[at(y[k]) if k in y else unseen for k in range(1, 18)])


def tracked_samples(d):
    """Associated persons as samples: track_id is segment and number in one; the posture cue comes from keypoints by key."""
    rows = tr.associate_persons(persons(d))
    cue = d["detections"].filter("label = 'person'").select(*KEY, posture_cue(keypoints(F.col("pose_hit")), S.visibility, S.wrist_limit).alias("hit"))
    unique = F.col("segment") * 1000000000 + F.col("track_id")
    return rows.join(cue, KEY).select("video_id", unique.alias("track_id"), "frame_idx", "fps", *g.Box._fields, "hit")


TRACKED = PERSON_TRACKS + RULE.replace("smp AS (SELECT video_id, actor_id AS track_id, frame_idx, fps, x1, y1, x2, y2, confidence, pose_hit AS hit FROM detections JOIN rates USING (video_id) WHERE label = 'person' AND confidence >= 0.4)", "smp AS MATERIALIZED (SELECT video_id, segment * 1000000000 + track_id AS track_id, frame_idx, fps, x1, y1, x2, y2, confidence, pose_hit AS hit FROM tk JOIN detections USING (video_id, frame_idx, ord) JOIN rates USING (video_id))")


@query("incident_job_tracked", TRACKED + INCIDENT_TABLE)
def _(d):
    """From raw boxes: gate, riders, association, posture from keypoints, the time rule, the interval table."""
    rows = tracked_samples(d)
    return incident_table(d, rows, inc.time_rule(rows)[2])


# Litter: frame numbers and videos of the score lists; only frames with activity count, the cigarette head runs on every second batch.
LITTER = """, fv AS (SELECT vec_id, video_id, (vec_id // 10 + 20) * stride AS frame_idx, logits FROM (SELECT *, vec_id % 10 AS video_id FROM logits) q JOIN rates USING (video_id)),
ga AS (SELECT fv.*, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS rn FROM fv SEMI JOIN (SELECT DISTINCT video_id, frame_idx FROM detections WHERE confidence >= 0.4) q USING (video_id, frame_idx)),
lt AS (SELECT video_id, frame_idx, vec_id, rn, pos, logit, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, pos) AS INT) AS rank FROM (SELECT video_id, frame_idx, vec_id, rn, unnest(logits) AS logit, unnest(range(64)) AS pos FROM ga) q),
lb AS (SELECT video_id, frame_idx, rank, pos // 4 AS query, CASE WHEN pos % 4 = 1 THEN 'cigarette' ELSE 'litter' END AS label, CASE WHEN pos % 4 = 1 THEN 1 ELSE 0 END AS class_id, 1 / (1 + exp(-logit)) AS score,
  (CAST(vec_id % 10 AS DOUBLE) / 20 + (pos // 4) / 40.0 - 0.05) * 1920 AS x1, CAST((0.5 - 0.05) * 1920 - 420 AS DOUBLE) AS y1, (CAST(vec_id % 10 AS DOUBLE) / 20 + (pos // 4) / 40.0 + 0.05) * 1920 AS x2, CAST((0.5 + 0.05) * 1920 - 420 AS DOUBLE) AS y2
  FROM lt WHERE rank <= 50 AND 1 / (1 + exp(-logit)) >= 0.5 AND (pos % 4 <> 1 OR CAST(ceil(rn / 8.0) AS BIGINT) % 2 = 0))"""


def litter_boxes(d):
    """Heads of one flat list, decoded from a letterboxed input: class 1 is the cigarette head."""
    lists = sm.with_rate(d["logits"].withColumn("video_id", F.col("vec_id") % 10), d["clips"]).withColumn("frame_idx", F.expr("(vec_id div 10 + 20) * stride"))
    gated = sm.gate(lists.drop("fps", "stride"), d["detections"], PERSON + VEHICLES, S.scene_confidence)
    runs_on = sm.every_nth_batch(gated.select("video_id", "frame_idx")).select("video_id", "frame_idx")
    top = sm.decode_topk(gated, 4, 300, 0.5, 50).join(gated.select("vec_id", "video_id", "frame_idx"), "vec_id")
    is_cigarette = F.col("class_id") == 1
    both = sm.union_heads(top.filter(~is_cigarette), top.filter(is_cigarette).join(runs_on, ["video_id", "frame_idx"], "left_semi"))
    cx = (F.col("vec_id") % 10).cast("double") / 20 + F.col("query") / 40.0
    box = g.letterbox(F.lit(1920), F.lit(1080), 640, 640)
    b = g.unletterbox(g.from_centre(cx, F.lit(0.5), F.lit(0.1), F.lit(0.1)), *[box[k] for k in ("ox", "oy", "gain_x", "gain_y")])
    label = head_label(F.when(is_cigarette, "cigarette"), F.lit(None).cast("string"), "litter")
    return both.withColumn("label", label).select(
        "video_id", "frame_idx", "rank", "query", "label", litter_class(F.col("label")).alias("class_id"), "score", b.x1.alias("x1"), b.y1.alias("y1"), b.x2.alias("x2"), b.y2.alias("y2")
    )


@query("litter_job", LITTER + "SELECT video_id, frame_idx, rank, query, label, class_id, round(score, 9) AS score, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM lb")
def _(d):
    rounded = {"score": F.round("score", 9)} | {c: F.round(c, 6) for c in g.Box._fields}
    return litter_boxes(d).withColumns(rounded)


PLATE_ROWS = f"SELECT f.video_id, segment, track_id, frame_idx, {TEXT}, score, g_x1, g_y1, g_x2, g_y2 FROM framed f JOIN plates p USING (video_id, frame_idx, ord) JOIN tk USING (video_id, frame_idx, ord) WHERE plate_confidence >= 0.25"


@query("plate_job", FRAMED + VEHICLE_TRACKS + cadence_sql(PLATE_ROWS, ("video_id", "segment", "track_id")) + "SELECT * FROM cd")
def _(d):
    """Vehicle tracks by association, plates in frame pixels, cadence, lock and reuse: the text after every sample."""
    tracks = tr.associate_vehicles(vehicles(d)).select(*KEY, "segment", "track_id")
    rows = framed_plates(d).filter(F.col("plate_confidence") >= S.plate_confidence).join(tracks, KEY)
    return pl.read_cadence(rows, key=("video_id", "segment", "track_id"))


# The sweep: the hit threshold acts on the way from wrist to groin in a sample's pose, the duration on the streak.
SECONDS = [3, 5, 8, 10]
GRID = [0.05, 0.08, 0.11, 0.14, 0.17, 0.20]


def pose_rows(d):
    """A pose for each person's box (video_id, frame_idx, ord, kp): hips, knees, and one or two hands at some way from the groin."""
    at = lambda y, c=0.9: F.struct(F.lit(0.5).alias("x"), y.cast("double").alias("y"), F.lit(c).cast("double").alias("c") if isinstance(c, float) else c.alias("c"))
    seen = lambda c: F.when(c, 0.9).otherwise(0.1)
    left, right = (F.lit(0.513) + (F.col("actor_id") * a + F.col("i") * b) % n / 100.0 for a, b, n in ((31, 7, 25), (17, 3, 40)))
    joints = {WRIST["L"]: at(left), WRIST["R"]: at(right, seen(F.col("i") % 2 == 0)), HIP["L"]: at(F.lit(0.5)), HIP["R"]: at(F.lit(0.52)), KNEE["L"]: at(F.lit(0.8), seen(F.col("i") % 11 != 0)), KNEE["R"]: at(F.lit(0.4))}
    rest = at(F.lit(0.5), 0.0)
    return d["detections"].filter("label = 'person'").select(*KEY, F.array(*[joints.get(k, rest) for k in range(1, 18)]).alias("kp"))


def posed(rows, poses):
    """Samples (with ord) with distance: the way of the best hand to the groin in the pose of their box; null for one who does not stand or has no pose."""
    stands = standing_sides(F.col("kp"), S.visibility) != ""
    return rows.join(poses.select(*KEY, F.when(stands, wrist_groin(F.col("kp"), S.visibility)).alias("distance")), KEY, "left").drop("ord")


def given_samples(d):
    rows = sm.with_rate(sm.confidence_filter(d["detections"], ("person",), S.scene_confidence), d["clips"])
    return rows.select(*KEY, F.col("actor_id").alias("track_id"), "fps", *g.Box._fields)


def sweep_streaks(samples):
    """Streaks per threshold of samples with distance. Samples are passed once: a second's hits are an array with a count for each
    threshold, only seconds are multiplied by the grid, and a track's expiry stands on its seconds.
    """
    base = inc.still_time(inc.box_motion(samples.withColumn("hit", F.col("distance").isNotNull())))
    hits = inc.with_expiry(inc.gated_hits(base))
    counts = F.array(*[F.count_if(F.col("ready") & (F.col("distance") < t)) for t in GRID])
    grid = F.array(*[F.lit(t) for t in GRID])
    per = inc.hits_per_second(hits, counts, ("expiry_frame",))
    per = per.select("*", F.posexplode("hits").alias("at", "n")).withColumns({"hits": F.col("n"), "track_id": F.struct("track_id", F.element_at(grid, F.col("at") + 1).alias("threshold"))}).drop("at", "n")
    streaks = inc.good_streak(per)
    return streaks.select("video_id", F.col("track_id.track_id").alias("track_id"), F.col("track_id.threshold").alias("threshold"), "expiry_frame", "sec", "streak", "next_frame")


def sweep_events(d, rows=None):
    rows = posed(given_samples(d), pose_rows(d)) if rows is None else rows
    seconds = d.spark.createDataFrame([(x,) for x in SECONDS], "seconds int")
    found = ev.event_counts(ev.streaks_for_grid(sweep_streaks(rows), seconds, ("expiry_frame",)))
    points = d["clips"].crossJoin(F.broadcast(ev.grid(d.spark, GRID, SECONDS)))
    return points.join(found, ["video_id", "threshold", "seconds"], "left").withColumn("events", F.coalesce("events", F.lit(0)))


def sweep_rows(d, rows=None):
    named = sweep_events(d, rows).withColumn("video", F.regexp_extract("path", r"([^/]*)$", 1))
    manifest = d["clips"].filter("video_id % 2 = 0").select(F.regexp_extract("path", r"([^/]*)$", 1).alias("video"), (F.col("video_id") % 3 == 0).alias("truth"))
    listed = named.withColumn("video", F.when(F.col("video").rlike("^cam"), F.concat(F.lit("FP"), F.col("video"))).otherwise(F.col("video")))
    return ev.eval_rows(ev.truth_join(listed, manifest))


WAY = "CASE WHEN i % 11 <> 0 THEN CASE WHEN i % 2 = 0 THEN least(abs(CAST(0.513 AS DOUBLE) + (actor_id * 31 + i * 7) % 25 / 100.0 - 0.51), abs(CAST(0.513 AS DOUBLE) + (actor_id * 17 + i * 3) % 40 / 100.0 - 0.51)) ELSE abs(CAST(0.513 AS DOUBLE) + (actor_id * 31 + i * 7) % 25 / 100.0 - 0.51) END END"
SWEEP = (
    RULE.replace("confidence, pose_hit AS hit FROM", f"confidence, 0 AS hit, {WAY} AS distance FROM").replace("mv AS (SELECT video_id, track_id, frame_idx, fps, hit,", "mv AS (SELECT video_id, track_id, frame_idx, fps, hit, distance,").replace("hit AND still_frames >= fps AS counted", "false AS counted").split("lr AS (")[0].rstrip().rstrip(",")
    + """, gr AS (SELECT unnest(CAST([0.05, 0.08, 0.11, 0.14, 0.17, 0.20] AS DOUBLE[])) AS threshold), dr AS (SELECT unnest([3, 5, 8, 10]) AS seconds),
tl AS (SELECT *, max(run) OVER (PARTITION BY video_id, track_id, sec) AS last_run, max(frame_idx) OVER (PARTITION BY video_id, track_id, sec) AS last_frame FROM ht),
tp AS (SELECT threshold, video_id, track_id, sec, count(*) FILTER (ready AND distance < threshold AND run = last_run) AS hits, bool_or(moved) AS has_motion, max(next_frame) FILTER (frame_idx = last_frame) AS next_frame,
   coalesce(bool_or(next_moved) FILTER (frame_idx = last_frame), false) AS next_moved FROM tl, gr GROUP BY ALL),
tb AS (SELECT *, CASE WHEN lag(sec) OVER w IS NULL OR lag(sec) OVER w <> sec - 1 OR has_motion THEN 1 ELSE 0 END AS b FROM tp WHERE hits >= 3 AND next_frame IS NOT NULL AND NOT next_moved WINDOW w AS (PARTITION BY threshold, video_id, track_id ORDER BY sec)),
ti AS (SELECT *, sum(b) OVER (PARTITION BY threshold, video_id, track_id ORDER BY sec ROWS UNBOUNDED PRECEDING) AS island FROM tb),
ts AS (SELECT *, row_number() OVER (PARTITION BY threshold, video_id, track_id, island ORDER BY sec) AS streak FROM ti),
tc AS (SELECT threshold, seconds, video_id, track_id, min(next_frame) AS confirm_frame FROM ts JOIN dr ON streak >= seconds GROUP BY ALL),
tx AS (SELECT video_id, track_id, max(frame_idx) + CAST(floor(3 * any_value(fps)) AS BIGINT) + 1 AS expiry_frame FROM smp GROUP BY ALL),
tm AS (SELECT *, max(expiry_frame) OVER (PARTITION BY threshold, seconds, video_id ORDER BY confirm_frame, expiry_frame, track_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM tc JOIN tx USING (video_id, track_id)),
te AS (SELECT threshold, seconds, video_id, count(*) FILTER (reach IS NULL OR confirm_frame > reach) AS events FROM tm GROUP BY ALL),
tg AS (SELECT c.video_id, c.path, g.threshold, d.seconds, coalesce(te.events, 0) AS events, CASE WHEN regexp_extract(path, '([^/]*)$', 1) LIKE 'cam%' THEN 'FP' ELSE '' END || regexp_extract(path, '([^/]*)$', 1) AS video,
   CASE WHEN video_id % 4 = 0 OR video_id % 4 = 2 THEN video_id % 3 = 0 ELSE false END AS truth FROM clips c CROSS JOIN gr g CROSS JOIN dr d LEFT JOIN te USING (video_id, threshold, seconds)),
tr AS (SELECT *, CASE WHEN truth AND events > 0 THEN 'TP' WHEN truth THEN 'FN' WHEN events > 0 THEN 'FP' ELSE 'TN' END AS result, regexp_extract(upper(video), '^(FN|FP|TP)', 1) AS clip_tag FROM tg)
"""
)


#: Durations of the whole grid: those of the sweep and every one that the reference names, from 5 to 10.
DURATIONS = [3, 5, 6, 7, 8, 9, 10]


@query("sweep_grid", f"SELECT video_id, threshold, seconds FROM clips, (SELECT unnest(CAST({ev.THRESHOLDS} AS DOUBLE[])) AS threshold) g, (SELECT unnest({DURATIONS}) AS seconds) d")
def _(d):
    """The whole grid of the reference: every threshold from 0.05 to 0.20 in steps of 0.01, at every duration."""
    return d["clips"].select("video_id").crossJoin(F.broadcast(ev.grid(d.spark, ev.THRESHOLDS, DURATIONS)))


@query("truth_join", SWEEP + "SELECT DISTINCT video, truth FROM tr")
def _(d):
    return sweep_rows(d).select("video", (F.col("truth") == "yes").alias("truth")).distinct()


SWEEP_ROWS = SWEEP + "SELECT video, path, threshold, seconds, CASE WHEN truth THEN 'yes' ELSE 'no' END AS truth, CASE WHEN events > 0 THEN 'yes' ELSE 'no' END AS predicted, result, clip_tag, events FROM tr"


@query("sweep_job", SWEEP_ROWS)
def _(d):
    return sweep_rows(d).select("video", "path", "threshold", "seconds", "truth", "predicted", "result", "clip_tag", "events")


SWEEP_TRACKED = PERSON_TRACKS + SWEEP.replace(f"actor_id AS track_id, frame_idx, fps, x1, y1, x2, y2, confidence, 0 AS hit, {WAY} AS distance FROM detections JOIN rates USING (video_id) WHERE label = 'person' AND confidence >= 0.4", f"segment * 1000000000 + track_id AS track_id, frame_idx, fps, x1, y1, x2, y2, confidence, 0 AS hit, {WAY} AS distance FROM tk JOIN detections USING (video_id, frame_idx, ord) JOIN rates USING (video_id)")


@query("sweep_job_tracked", SWEEP_TRACKED + "SELECT video, path, threshold, seconds, result, clip_tag, events FROM tr")
def _(d):
    """The sweep from raw boxes and poses: gate, riders, association once for all grid points."""
    rows = tr.associate_persons(persons(d)).withColumn("track_id", F.col("segment") * 1000000000 + F.col("track_id"))
    return sweep_rows(d, posed(rows.select(*KEY, "track_id", "fps", *g.Box._fields), pose_rows(d))).select("video", "path", "threshold", "seconds", "result", "clip_tag", "events")


NOTED = "CASE WHEN truth THEN 'should detect peeing' ELSE 'should NOT detect peeing' END"
EVALUATION = SWEEP + f"""SELECT video, clip_tag, path AS video_path, threshold AS hand_groin_y_threshold, seconds AS seconds_required, CASE WHEN truth THEN 'yes' ELSE 'no' END AS should_detect_peeing, CASE WHEN truth THEN 'yes' ELSE 'no' END AS ground_truth_peeing,
  CASE WHEN events > 0 THEN 'yes' ELSE 'no' END AS predicted_peeing, result, CASE WHEN result IN ('TP', 'TN') THEN 'yes' ELSE 'no' END AS is_correct, CASE WHEN result = 'TP' THEN 'yes' ELSE 'no' END AS is_tp, events AS peeing_event_count, video_id / 4.0 AS wall_sec,
  CASE result WHEN 'TP' THEN CASE clip_tag WHEN 'FN' THEN 'Prod miss (' || {NOTED} || '); model detected — fixed' WHEN 'TP' THEN 'Prod hit (' || {NOTED} || '); model detected — OK' ELSE {NOTED} || '; model detected — OK' END
   WHEN 'FN' THEN CASE WHEN clip_tag IN ('FN', 'TP') THEN 'Prod miss/hit (' || {NOTED} || '); model missed — still wrong' ELSE {NOTED} || '; model missed' END WHEN 'FP' THEN {NOTED} || '; model fired — false alarm' ELSE {NOTED} || '; model silent — OK' END AS notes FROM tr"""


@query("write_eval", EVALUATION)
def _(d):
    path = src.scratch(d.spark, "eval")
    wall = d["clips"].select("path", (F.col("video_id") / 4).alias("wall_sec"))
    rows = rt.evaluation_table(sweep_rows(d).join(wall, "path"))
    src.overwrite_csv(rows, path)
    return d.spark.read.schema(rows.schema).csv(path, header=True).withColumn("clip_tag", F.coalesce("clip_tag", F.lit("")))


COUNTS = ", tq AS (SELECT threshold, seconds, count(*) FILTER (result = 'TP') AS tp, count(*) FILTER (result = 'FN') AS fn, count(*) FILTER (result = 'FP') AS fp, count(*) FILTER (result = 'TN') AS tn, count(*) FILTER (result IN ('TP', 'TN')) AS correct, count(*) AS clips FROM tr GROUP BY ALL)"


@query("confusion", SWEEP + COUNTS + "SELECT * FROM tq")
def _(d):
    return ev.confusion(sweep_rows(d))


@query("sweep_matrix", SWEEP + COUNTS + "SELECT threshold, " + ", ".join(f"max(format('{{}}/{{}} ({{}}+{{}})', correct, clips, tp, tn)) FILTER (seconds = {s}) AS s{s}" for s in SECONDS) + " FROM tq GROUP BY threshold")
def _(d):
    return ev.sweep_matrix(sweep_rows(d), SECONDS)


@query("clip_matrix", SWEEP + "SELECT path, video, seconds, " + ", ".join(f"max(result) FILTER (threshold = {t}) AS t{t:.2f}".replace("t0.", "t0_") for t in GRID) + ", count(*) FILTER (result IN ('TP', 'TN')) AS correct FROM tr GROUP BY ALL")
def _(d):
    return ev.clip_matrix(sweep_rows(d), GRID)


@query("by_tag", SWEEP + "SELECT threshold, seconds, clip_tag, video, path, video || ': ' || result AS line FROM tr")
def _(d):
    return ev.by_tag(sweep_rows(d))


CLAMPED = ", ".join(f"CAST(greatest(0, least({side} - 1, CAST(trunc({c}) AS BIGINT))) AS INT) AS {c}" for c, side in (("x1", 1920), ("y1", 1080), ("x2", 1920), ("y2", 1080)))
LAYERS = f""", an AS (SELECT * FROM (SELECT video_id, frame_idx, 0 AS layer, label || format(' {{:.2f}}', score) AS said, class_id, {CLAMPED} FROM lb) q WHERE x2 > x1 AND y2 > y1
UNION ALL SELECT * FROM (SELECT video_id, frame_idx, 1, label || format(' {{:.2f}}', confidence), 0, {CLAMPED} FROM detections) q WHERE x2 > x1 AND y2 > y1
UNION ALL SELECT video_id, frame_idx, 2, label, 0, g_x1, g_y1, g_x2, g_y2 FROM framed JOIN (SELECT video_id, frame_idx, actor_id AS track_id, ord FROM plates) p USING (video_id, frame_idx, ord) JOIN lc USING (video_id, track_id, frame_idx) WHERE label IS NOT NULL)"""
MARKS = "SELECT video_id, frame_idx, 3 AS layer, 'CONFIRMED' AS said, 0 AS class_id, CAST(round_even(x1, 0) AS INT) AS x1, CAST(round_even(y1, 0) AS INT) AS y1, CAST(round_even(x2, 0) AS INT) AS x2, CAST(round_even(y2, 0) AS INT) AS y2 FROM mk"
ANNOTATION = RULE + MARKED + LITTER + FRAMED + CARRIED + LAYERS
POSES = f", ps1 AS ({POSE_CARRY})"


def annotation_layers(d):
    """The rows of sampled frames: litter, scene boxes, plate labels. Boxes are cut to the frame."""
    whole = ["video_id", "frame_idx", "layer", "said", "class_id", *g.Box._fields]
    cut = lambda rows, layer, said, kind: sm.with_box(rows.select("video_id", "frame_idx", F.lit(layer).alias("layer"), said.alias("said"), kind.cast("int").alias("class_id"), *g.Box._fields), g.clamp_box(g.box(), F.lit(1920), F.lit(1080)))
    litter = cut(litter_boxes(d), 0, F.format_string("%s %.2f", "label", F.bround("score", 2)), F.col("class_id"))
    scene = cut(sm.scene_filter(d["detections"]), 1, F.format_string("%s %.2f", "label", F.bround("confidence", 2)), F.lit(0))
    plates = framed_plates(d, pl.labels_read(readings(d), F.col("frame_idx") % 6 == 0).filter("label is not null"))
    plates = plates.select("video_id", "frame_idx", F.lit(2).alias("layer"), F.col("label").alias("said"), F.lit(0).alias("class_id"), *[F.col(f"g_{c}").alias(c) for c in g.Box._fields])
    return litter.select(*whole).unionByName(scene.select(*whole)).unionByName(plates)


def marks(d):
    whole = [F.bround(c).cast("int").alias(c) for c in g.Box._fields]
    rows = inc.marked_frames(samples(d), d["clips"])
    return rows.select("video_id", "frame_idx", F.lit(3).alias("layer"), F.lit("CONFIRMED").alias("said"), F.lit(0).alias("class_id"), *whole)


@query("annotation_rows", ANNOTATION + "SELECT * FROM an UNION ALL " + MARKS)
def _(d):
    return annotation_layers(d).unionByName(marks(d))


@query("annotation_job", ANNOTATION + POSES + """, ah AS (SELECT f.video_id, f.frame_idx, layer, said, class_id, x1, y1, x2, y2 FROM frames f JOIN rates r ON r.video_id = f.video_id JOIN an ON an.video_id = f.video_id AND an.frame_idx = f.frame_idx - f.frame_idx % stride
  UNION ALL SELECT f.video_id, f.frame_idx, 4, CAST(pose AS VARCHAR), 0, NULL, NULL, NULL, NULL FROM frames f JOIN rates r ON r.video_id = f.video_id JOIN ps1 p ON p.video_id = f.video_id AND p.frame_idx = f.frame_idx - f.frame_idx % stride WHERE pose IS NOT NULL
  UNION ALL """ + MARKS + ") SELECT * FROM ah")
def _(d):
    """Every decoded frame: the layers and the held pose of its last sampled frame, and the boxes of confirmed tracks."""
    none = {c: F.lit(None).cast("int") for c in g.Box._fields}
    poses = held_poses(d).filter("pose is not null").select("video_id", "frame_idx", F.lit(4).alias("layer"), F.col("pose").cast("string").alias("said"), F.lit(0).alias("class_id")).withColumns(none)
    held = sm.until_next(annotation_layers(d).unionByName(poses), d["clips"])
    return held.unionByName(marks(d))


@query("event_log", RULE + LITTER + PLATE + f"""SELECT video_id, start_sec AS ts, 'urination' AS event_type, NULL AS x1, NULL AS y1, NULL AS x2, NULL AS y2, 1.0 AS confidence, NULL AS extra FROM incidents
UNION ALL SELECT v.video_id, ts, 'vehicle', x1, y1, x2, y2, v.confidence, text FROM (SELECT video_id, actor_id AS track_id, min(frame_idx) / any_value(fps) AS ts, arg_min(x1, frame_idx) AS x1, arg_min(y1, frame_idx) AS y1, arg_min(x2, frame_idx) AS x2, arg_min(y2, frame_idx) AS y2, max(confidence) AS confidence
   FROM detections JOIN rates USING (video_id) WHERE label <> 'person' AND confidence >= 0.4 GROUP BY ALL) v LEFT JOIN (SELECT video_id, track_id, arg_max(best_text, frame_idx) AS text FROM rb GROUP BY ALL HAVING arg_max(best_text, frame_idx) <> '') t USING (video_id, track_id)
UNION ALL SELECT video_id, frame_idx / fps, 'litter', round(x1, 6), round(y1, 6), round(x2, 6), round(y2, 6), round(score, 9), label FROM lb JOIN rates USING (video_id)""")
def _(d):
    seen = vehicles(d).withColumns({"track_id": F.col("actor_id"), "ts": F.col("frame_idx") / F.col("fps")})
    last = pl.running_best_text(readings(d)).groupBy("video_id", "track_id").agg(F.max_by("best_text", "frame_idx").alias("text")).filter("text <> ''")
    rounded = {c: F.round(c, 6) for c in g.Box._fields} | {"ts": F.col("frame_idx") / F.col("fps"), "confidence": F.round("score", 9)}
    return rt.event_log(inc.incident_intervals(ranges(d), d["clips"]), seen, last, sm.with_rate(litter_boxes(d), d["clips"]).withColumns(rounded))
