"""Queries of single expressions over the fixture tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from boxtrail.functions import geometry as g
from boxtrail.functions import pose as p
from boxtrail.functions import text as t
from boxtrail.plans.registry import query
from boxtrail.settings import DEFAULT as S

# Pairs of boxes: each sample of an actor with the one before.
PAIRS = """, pairs AS (SELECT actor_id, frame_idx, x1, y1, x2, y2, lag(x1) OVER w AS a1, lag(y1) OVER w AS b1, lag(x2) OVER w AS a2, lag(y2) OVER w AS b2
  FROM detections WINDOW w AS (PARTITION BY actor_id ORDER BY frame_idx)), prs AS (SELECT * FROM pairs WHERE a1 IS NOT NULL)
"""
INTER = "(greatest(0.0, least(x2, a2) - greatest(x1, a1)) * greatest(0.0, least(y2, b2) - greatest(y1, b1)))"
IOU = f"(CASE WHEN {INTER} > 0 THEN {INTER} / ((a2 - a1) * (b2 - b1) + (x2 - x1) * (y2 - y1) - {INTER}) ELSE 0.0 END)"
KEY = ["actor_id", "frame_idx"]


def pairs(d):
    by = Window.partitionBy("actor_id").orderBy("frame_idx")
    rows = d["detections"].select(*KEY, *g.Box._fields, *[F.lag(c).over(by).alias(f"b_{c}") for c in g.Box._fields])
    return rows.filter("b_x1 is not null")


def boxes(b: g.Box, digits: int = 6) -> list:
    return [F.round(e, digits).alias(c) for c, e in zip(g.Box._fields, b, strict=True)]


@query("iou", PAIRS + f"SELECT actor_id, frame_idx, round({IOU}, 9) AS iou FROM prs")
def _(d):
    return pairs(d).select(*KEY, F.round(g.iou(g.box("b_"), g.box()), 9).alias("iou"))


@query("intersection_area", PAIRS + f"SELECT actor_id, frame_idx, {INTER} AS area FROM prs")
def _(d):
    return pairs(d).select(*KEY, g.intersection_area(g.box("b_"), g.box()).alias("area"))


@query("expand_box", "SELECT actor_id, frame_idx, round((x1 + x2) / 2 - (x2 - x1) * 0.575, 6) AS x1, round((y1 + y2) / 2 - (y2 - y1) * 0.55, 6) AS y1, round((x1 + x2) / 2 + (x2 - x1) * 0.575, 6) AS x2, round((y1 + y2) / 2 + (y2 - y1) * 0.55, 6) AS y2 FROM detections WHERE label = 'motorcycle'")
def _(d):
    return d["detections"].filter("label = 'motorcycle'").select(*KEY, *boxes(g.expand_box(g.box(), S.bike_x, S.bike_y)))


@query("lower_body", "SELECT actor_id, frame_idx, x1, round(y2 - (y2 - y1) * 0.6, 6) AS y1, x2, y2 FROM detections WHERE label = 'person'")
def _(d):
    return d["detections"].filter("label = 'person'").select(*KEY, *boxes(g.lower_body(g.box(), S.bike_lower)))


@query("bottom_centre_in", PAIRS + "SELECT actor_id, frame_idx, (x1 + x2) / 2 BETWEEN a1 AND a2 AND y2 BETWEEN b1 AND b2 AS inside FROM prs")
def _(d):
    return pairs(d).select(*KEY, g.bottom_centre_in(g.box(), g.box("b_")).alias("inside"))


MOTION = "sqrt(power((x1 + x2) / 2 - (a1 + a2) / 2, 2) + power((y1 + y2) / 2 - (b1 + b2) / 2, 2)) / (b2 - b1)"
CHANGE = "abs((x2 - x1) * (y2 - y1) - (a2 - a1) * (b2 - b1)) / ((a2 - a1) * (b2 - b1))"


@query("centre_motion", PAIRS + f"SELECT actor_id, frame_idx, round({MOTION}, 9) AS motion FROM prs")
def _(d):
    return pairs(d).select(*KEY, F.round(g.centre_motion(g.box("b_"), g.box()), 9).alias("motion"))


@query("size_change", PAIRS + f"SELECT actor_id, frame_idx, round({CHANGE}, 9) AS change FROM prs")
def _(d):
    return pairs(d).select(*KEY, F.round(g.size_change(g.box("b_"), g.box()), 9).alias("change"))


@query("same_place", PAIRS + f"SELECT actor_id, frame_idx, {IOU} >= 0.15 OR (abs((x1 + x2) / 2 - (a1 + a2) / 2) <= 0.75 * greatest(8.0, x2 - x1, y2 - y1, a2 - a1, b2 - b1) AND abs((y1 + y2) / 2 - (b1 + b2) / 2) <= 0.75 * greatest(8.0, x2 - x1, y2 - y1, a2 - a1, b2 - b1)) AS same FROM prs")
def _(d):
    return pairs(d).select(*KEY, g.same_place(g.box("b_"), g.box()).alias("same"))


@query("cxcywh_to_xyxy", "SELECT actor_id, frame_idx, x1 - greatest(x2 - 100, 0.0) / 2 AS x1, y1 - greatest(y2 - 300, 0.0) / 2 AS y1, x1 + greatest(x2 - 100, 0.0) / 2 AS x2, y1 + greatest(y2 - 300, 0.0) / 2 AS y2 FROM detections")
def _(d):
    b = g.from_centre(F.col("x1"), F.col("y1"), F.col("x2") - 100, F.col("y2") - 300)
    return d["detections"].select(*KEY, *[e.alias(c) for c, e in zip(g.Box._fields, b, strict=True)])


# Frames of many shapes: one per video.
SHAPES = ", shapes AS (SELECT video_id, CAST(320 + video_id % 97 * 20 AS INT) AS width, CAST(240 + video_id % 89 * 12 AS INT) AS height FROM clips)"
LB = SHAPES + """, s AS (SELECT *, least(640.0 / width, 640.0 / height) AS k FROM shapes),
l AS (SELECT video_id, width, height, CAST(greatest(1, round_even(width * k, 0)) AS INT) AS nw, CAST(greatest(1, round_even(height * k, 0)) AS INT) AS nh FROM s),
b AS (SELECT *, (640 - nw) // 2 AS pad_x, (640 - nh) // 2 AS pad_y FROM l),
lb AS (SELECT video_id, nw, nh, pad_x, pad_y, -pad_x * (width / nw) AS ox, -pad_y * (height / nh) AS oy, 640 * (width / nw) AS gain_x, 640 * (height / nh) AS gain_y FROM b)"""


def laid_out(d):
    shapes = d["clips"].select("video_id", (F.lit(320) + F.col("video_id") % 97 * 20).cast("int").alias("width"), (F.lit(240) + F.col("video_id") % 89 * 12).cast("int").alias("height"))
    return shapes.select("video_id", *[e.alias(n) for n, e in g.letterbox(F.col("width"), F.col("height"), 640, 640).items()])


@query("letterbox", LB + "SELECT video_id, nw, nh, pad_x, pad_y, round(ox, 6) + 0.0 AS ox, round(oy, 6) + 0.0 AS oy, round(gain_x, 6) AS gain_x, round(gain_y, 6) AS gain_y FROM lb")
def _(d):
    return laid_out(d).select("video_id", "nw", "nh", "pad_x", "pad_y", *[(F.round(c, 6) + (0.0 if c[0] == "o" else 0)).alias(c) for c in ("ox", "oy", "gain_x", "gain_y")])


@query("unletterbox", LB + "SELECT actor_id, frame_idx, x1 / 1920 * gain_x + ox AS x1, y1 / 1080 * gain_y + oy AS y1, x2 / 1920 * gain_x + ox AS x2, y2 / 1080 * gain_y + oy AS y2 FROM detections JOIN lb USING (video_id)")
def _(d):
    rows = d["detections"].join(laid_out(d), "video_id")
    b = g.Box(F.col("x1") / 1920, F.col("y1") / 1080, F.col("x2") / 1920, F.col("y2") / 1080)
    out = g.unletterbox(b, *[F.col(c) for c in ("ox", "oy", "gain_x", "gain_y")])
    return rows.select(*KEY, *[e.alias(c) for c, e in zip(g.Box._fields, out, strict=True)])


@query("keypoints_to_frame", "SELECT vec_id, list_transform(kp, lambda q: round(100 + vec_id % 50 + q.x * 120, 6)) AS xs, list_transform(kp, lambda q: round(50 + q.y * 1, 6)) AS ys FROM poses")
def _(d):
    x1 = (F.lit(100) + F.col("vec_id") % 50).cast("double")
    moved = d["poses"].select("vec_id", p.keypoints_to_frame(F.col("kp"), x1, F.lit(50.0), x1 + 120, F.lit(50.5)).alias("kp"))
    return moved.select("vec_id", F.transform("kp", lambda q: F.round(q["x"], 6)).alias("xs"), F.transform("kp", lambda q: F.round(q["y"], 6)).alias("ys"))


OK = "(kp[{0}]).c >= 0.45"


def _standing(hip, knee):
    return f"({OK.format(hip)} AND {OK.format(knee)} AND (kp[{hip}]).y < (kp[{knee}]).y)"


STAND_L, STAND_R = _standing(12, 14), _standing(13, 15)
DIST = f"""(CASE WHEN {OK.format(12)} AND {OK.format(13)} THEN least(CASE WHEN {OK.format(10)} THEN abs((kp[10]).y - ((kp[12]).y + (kp[13]).y) * 0.5) ELSE 1e9 END, CASE WHEN {OK.format(11)} THEN abs((kp[11]).y - ((kp[12]).y + (kp[13]).y) * 0.5) ELSE 1e9 END)
  WHEN {OK.format(12)} AND {OK.format(10)} THEN abs((kp[10]).y - (kp[12]).y) WHEN {OK.format(13)} AND {OK.format(11)} THEN abs((kp[11]).y - (kp[13]).y) ELSE 1e9 END)"""


@query("hip_hand_px", f"SELECT vec_id, CASE WHEN {OK.format(12)} AND {OK.format(10)} THEN round(sqrt(power((kp[10]).x - (kp[12]).x, 2) + power((kp[10]).y - (kp[12]).y, 2)), 9) END AS l, CASE WHEN {OK.format(13)} AND {OK.format(11)} THEN round(sqrt(power((kp[11]).x - (kp[13]).x, 2) + power((kp[11]).y - (kp[13]).y, 2)), 9) END AS r FROM poses")
def _(d):
    return d["poses"].select("vec_id", *[F.round(p.hip_hand_px(F.col("kp"), s, S.visibility), 9).alias(s.lower()) for s in "LR"])


@query("standing_sides", f"SELECT vec_id, concat_ws(',', CASE WHEN {STAND_L} THEN 'L' END, CASE WHEN {STAND_R} THEN 'R' END) AS sides FROM poses")
def _(d):
    return d["poses"].select("vec_id", p.standing_sides(F.col("kp"), S.visibility).alias("sides"))


@query("wrist_groin", f"SELECT vec_id, round({DIST}, 9) AS distance FROM poses")
def _(d):
    return d["poses"].select("vec_id", F.round(p.wrist_groin(F.col("kp"), S.visibility), 9).alias("distance"))


@query("posture_cue", f"SELECT vec_id, ({STAND_L} OR {STAND_R}) AND {DIST} < 0.09 AS cue FROM poses")
def _(d):
    return d["poses"].select("vec_id", p.posture_cue(F.col("kp"), S.visibility, S.wrist_limit).alias("cue"))


NORM = "regexp_replace(regexp_replace(coalesce(raw_text, ''), '[^0-9A-Za-z]+', '-', 'g'), '^-|-$', '', 'g')"
PK = ["video_id", "frame_idx", "actor_id"]


@query("plate_text", f"SELECT video_id, frame_idx, actor_id, {NORM} AS text FROM plates")
def _(d):
    return d["plates"].select(*PK, t.plate_text(F.col("raw_text")).alias("text"))


@query("inner_dash", f"SELECT video_id, frame_idx, actor_id, length({NORM}) >= 3 AND contains(substr({NORM}, 2, length({NORM}) - 2), '-') AS dashed FROM plates")
def _(d):
    return d["plates"].select(*PK, t.inner_dash(t.plate_text(F.col("raw_text"))).alias("dashed"))


@query("plate_label", f"SELECT video_id, frame_idx, actor_id, CASE WHEN score >= 0.9 AND {NORM} <> '' THEN format('{{}} {{:.2f}}', {NORM}, score) WHEN score >= 0.5 THEN format('{{:.2f}}', score) ELSE format('LP {{:.2f}}', plate_confidence) END AS label FROM plates")
def _(d):
    sure = F.when(F.col("score") >= 0.9, t.plate_text(F.col("raw_text"))).otherwise("")
    return d["plates"].select(*PK, t.plate_label(sure, F.col("score"), F.col("score"), F.col("plate_confidence"), S.text_confidence).alias("label"))


@query("clock_text", "SELECT actor_id, frame_idx, CASE WHEN s < 60 THEN format('{:.2f}s', s) ELSE format('{}m {:.2f}s', CAST(floor(s / 60) AS INT), s % 60) END AS clock FROM (SELECT *, greatest(frame_idx * 17 / 8.0 - 20, 0.0) AS s FROM detections) q")
def _(d):
    return d["detections"].select(*KEY, t.clock_text(F.col("frame_idx") * 17 / 8.0 - 20).alias("clock"))


@query("video_time", "SELECT actor_id, frame_idx, CASE WHEN s >= 3600 THEN format('{}:{:02d}:{:06.3f}', CAST(floor(s / 3600) AS INT), CAST(floor(s % 3600 / 60) AS INT), s % 60) ELSE format('{}:{:06.3f}', CAST(floor(s / 60) AS INT), s % 60) END AS at FROM (SELECT *, greatest(frame_idx * 137 / 8.0 - 20, 0.0) AS s FROM detections) q")
def _(d):
    return d["detections"].select(*KEY, t.video_time(F.col("frame_idx") * 137 / 8.0 - 20).alias("at"))


@query("parse_bool", "SELECT video_id, CASE WHEN video_id % 5 IN (0, 1, 2) THEN true ELSE false END AS truth FROM clips")
def _(d):
    word = F.element_at(F.array(*[F.lit(x) for x in (" YES", "pos", "1", "No ", "none")]), (F.col("video_id") % 5 + 1).cast("int"))
    return d["clips"].select("video_id", t.parse_bool(word).alias("truth"))


STEM = "regexp_extract(path, '([^/]*)\\.[^./]*$', 1)"


@query("clip_tag", f"SELECT video_id, regexp_extract(upper({STEM}), '^(FN|FP|TP)', 1) AS tag FROM clips")
def _(d):
    return d["clips"].select("video_id", t.clip_tag(F.col("path")).alias("tag"))


OUTCOME = "CASE WHEN video_id % 3 = 0 AND video_id % 2 = 0 THEN 'TP' WHEN video_id % 3 = 0 THEN 'FN' WHEN video_id % 2 = 0 THEN 'FP' ELSE 'TN' END"


@query("outcome", f"SELECT video_id, {OUTCOME} AS result, {OUTCOME} IN ('TP', 'TN') AS correct FROM clips")
def _(d):
    r = t.outcome(F.col("video_id") % 3 == 0, F.col("video_id") % 2 == 0)
    return d["clips"].select("video_id", r.alias("result"), r.isin("TP", "TN").alias("correct"))


@query("outcome_note", f"""SELECT video_id, CASE WHEN r = 'TP' AND g = 'FN' THEN 'Prod miss (' || s || '); model detected — fixed' WHEN r = 'TP' AND g = 'TP' THEN 'Prod hit (' || s || '); model detected — OK' WHEN r = 'TP' THEN s || '; model detected — OK'
  WHEN r = 'FN' AND g IN ('FN', 'TP') THEN 'Prod miss/hit (' || s || '); model missed — still wrong' WHEN r = 'FN' THEN s || '; model missed' WHEN r = 'FP' THEN s || '; model fired — false alarm' ELSE s || '; model silent — OK' END AS note
  FROM (SELECT video_id, {OUTCOME} AS r, regexp_extract(upper({STEM}), '^(FN|FP|TP)', 1) AS g, CASE WHEN video_id % 3 = 0 THEN 'should detect peeing' ELSE 'should NOT detect peeing' END AS s FROM clips) q""")
def _(d):
    truth = F.col("video_id") % 3 == 0
    return d["clips"].select("video_id", t.outcome_note(t.outcome(truth, F.col("video_id") % 2 == 0), t.clip_tag(F.col("path")), truth).alias("note"))


@query("near", "SELECT actor_id, frame_idx, abs(confidence - (confidence + (i % 3) * 8e-10)) <= 1e-9 AS near FROM detections")
def _(d):
    return d["detections"].select(*KEY, t.near(F.col("confidence"), F.col("confidence") + F.col("i") % 3 * 8e-10).alias("near"))


@query("boxes_json", "SELECT video_id, frame_idx, '[' || string_agg('[' || format('{:.1f},{:.1f},{:.1f},{:.1f}', x1, y1, x2, y2) || ']', ',' ORDER BY ord) || ']' AS boxes FROM detections GROUP BY video_id, frame_idx")
def _(d):
    grouped = d["detections"].groupBy("video_id", "frame_idx").agg(F.array_sort(F.collect_list(F.struct("ord", *g.Box._fields))).alias("b"))
    return grouped.select("video_id", "frame_idx", t.boxes_json(F.col("b")).alias("boxes"))


@query("display_status", "SELECT actor_id, frame_idx, CASE WHEN actor_id % 5 = 0 AND i > 9 THEN 'CONFIRMED' WHEN i % 4 > 0 AND pose_hit THEN format('suspect {}s', i % 4) ELSE 'person' END AS status FROM detections")
def _(d):
    return d["detections"].select(*KEY, t.display_status((F.col("actor_id") % 5 == 0) & (F.col("i") > 9), F.col("i") % 4, F.col("pose_hit")).alias("status"))


@query("head_label", "SELECT actor_id, frame_idx, CASE WHEN label = 'car' THEN 'mapped car' WHEN label = 'person' THEN 'litter' WHEN label = 'truck' THEN 'litter' ELSE label END AS label FROM detections")
def _(d):
    classes = d.spark.createDataFrame([("car", "mapped car")], "label string, class_label string")  # a fixed class table
    name = F.when(F.col("label") == "person", " BackGround ").when(F.col("label") == "truck", None).otherwise(F.col("label"))
    rows = d["detections"].join(F.broadcast(classes), "label", "left")
    return rows.select(*KEY, t.head_label(F.col("class_label"), name, "litter").alias("label"))


@query("litter_class", "SELECT actor_id, frame_idx, CASE WHEN label = 'truck' THEN 1 ELSE 0 END AS class_id FROM detections")
def _(d):
    said = F.when(F.col("label") == "truck", "A Cigarette butt").otherwise(F.col("label"))
    return d["detections"].select(*KEY, t.litter_class(said).alias("class_id"))


@query("output_path", "SELECT video_id, regexp_replace(regexp_replace(path, '^/clips/', '/out/'), '(\\.[^./]*)$', '_done\\1') AS out_path FROM clips")
def _(d):
    return d["clips"].select("video_id", t.output_path(F.col("path"), "/clips", "/out", "_done").alias("out_path"))
