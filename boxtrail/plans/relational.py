"""Queries of sources, filters, gates, joins, top-k, set operations and run statistics."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import functions as F

from boxtrail.functions import geometry as g
from boxtrail.operators import plates as pl
from boxtrail.operators import runs
from boxtrail.operators import sampling as sm
from boxtrail.operators import tracking as tr
from boxtrail.operators.scoring import callback_boxes, detect_batches, score_batches, sharp_crops
from boxtrail.plans.registry import query
from boxtrail.settings import DEFAULT as S
from boxtrail.settings import MOTORCYCLES, PERSON, VEHICLES
from boxtrail.sources import clips as src

DET = ["video_id", "frame_idx", "ord", "label", "confidence", "x1", "y1", "x2", "y2"]
DETS = ", ".join(DET)
KEY = ["video_id", "frame_idx", "ord"]


# a file of as many bytes as its clip has frames, and one of another kind beside every third clip
FILES = ", files AS (SELECT path, total_frames AS length FROM clips UNION ALL SELECT path || '.txt', 1 FROM clips WHERE video_id % 3 = 0)"


def _make_files(root):
    def make(batches):
        fs, top = pa.fs.FileSystem.from_uri(root)
        for batch in batches:
            for path, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs.create_dir((top + path).rsplit("/", 1)[0])
                with fs.open_output_stream(top + path) as out:
                    out.write(b"0" * size)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["files"])

    return make


@query("scan_clips", FILES + "SELECT path, length FROM files WHERE regexp_matches(lower(path), '\\.(mp4|mov|avi|mkv|webm|m4v)$')")
def _(d):
    c = d["clips"]
    files = c.select("path", F.col("total_frames").alias("size")).unionByName(c.filter("video_id % 3 = 0").select(F.concat("path", F.lit(".txt")).alias("path"), F.lit(1).cast("long").alias("size")))
    root = src.scratch(d.spark, "clips")
    files.mapInArrow(_make_files(root), "files long").agg(F.sum("files")).collect()
    return src.scan_clips(d.spark, root).select(F.regexp_extract("path", r"(/clips/[^/]*/[^/]*)$", 1).alias("path"), "length")


@query("scan_eval_clips", "SELECT DISTINCT path FROM clips WHERE regexp_matches(path, '/(FN|FP|TP)[^/]*\\.(mp4|avi|mov)$')")
def _(d):
    return src.eval_clips(d["clips"].select("path"))


@query("ordered_clips", "SELECT path, row_number() OVER (ORDER BY path) AS place FROM clips")
def _(d):
    return src.numbered_clips(d["clips"])


@query("read_manifest", "SELECT regexp_extract(path, '([^/]*)$', 1) AS video, (video_id + 1) % 3 = 0 AS truth FROM clips")
def _(d):
    word = lambda k: F.when((F.col("video_id") + k) % 3 == 0, " Yes").otherwise("neg")
    c = d["clips"]
    lines = c.select(F.col("path").alias("Video_Path"), word(0).alias("Label"), F.col("video_id").alias("line_no"))
    again = c.select(F.concat(F.lit("x/"), F.regexp_extract("path", r"([^/]*)$", 1)).alias("Video_Path"), word(1).alias("Label"), (F.col("video_id") + 10**6).alias("line_no"))
    blank = c.select(F.lit(None).cast("string").alias("Video_Path"), F.lit("never read").alias("Label"), F.col("video_id").alias("line_no"))
    path = src.scratch(d.spark, "manifest")
    rows = lines.unionByName(again).unionByName(blank)
    rows.repartitionByRange("line_no").sortWithinPartitions("line_no").drop("line_no").write.csv(path, header=True)
    return src.read_manifest(d.spark, path)


@query("read_detections", f"SELECT {DETS} FROM detections")
def _(d):
    path = src.scratch(d.spark, "detections")
    d["detections"].select(*DET).write.parquet(path)
    return src.read_detections(d.spark, path)


@query("explode_arrays", "SELECT video_id, frame_idx, ord, 'person' AS label, CASE WHEN frame_idx % 10 = 0 THEN 1.0 ELSE confidence END AS confidence, x1, y1, x2, y2 FROM detections")
def _(d):
    f = d["detections"].groupBy("video_id", "frame_idx").agg(F.array_sort(F.collect_list(F.struct("ord", F.array("x1", "y1", "x2", "y2").alias("b"), "confidence"))).alias("r"))
    scores = F.when(F.col("frame_idx") % 10 != 0, F.transform("r", lambda x: x["confidence"]))
    return sm.explode_arrays(f.select("video_id", "frame_idx", F.transform("r", lambda x: x["b"]).alias("boxes"), scores.alias("scores")))


RAW = ", raw AS (SELECT video_id, path, total_frames, CASE CAST(video_id % 7 AS INT) WHEN 0 THEN 0.0 WHEN 1 THEN 120.0 WHEN 2 THEN 2.5 WHEN 3 THEN NULL ELSE 8.0 END AS fps FROM clips)"


def raw(d):
    fps = F.when(F.col("video_id") % 7 == 0, 0.0).when(F.col("video_id") % 7 == 1, 120.0).when(F.col("video_id") % 7 == 2, 2.5).when(F.col("video_id") % 7 == 3, None).otherwise(8.0)
    return d["clips"].select("video_id", "path", "total_frames", fps.alias("fps"))


@query("clip_metadata", RAW + "SELECT video_id, path, total_frames, fps, coalesce(fps > 0, false) AS valid, CASE WHEN fps > 0 THEN total_frames / fps END AS duration, coalesce(fps > 0 AND NOT fps BETWEEN 5 AND 60, false) AS unusual_fps FROM raw")
def _(d):
    return runs.clip_metadata(raw(d))


@query("error_rows", RAW + "SELECT video_id, path, coalesce(fps > 0, false) AS success, CASE WHEN fps > 0 THEN '' ELSE 'invalid frame rate' END AS error, CASE WHEN fps > 0 THEN total_frames / fps ELSE 0.0 END AS duration FROM raw")
def _(d):
    return runs.error_rows(runs.clip_metadata(raw(d)))


@query("stride", "SELECT video_id, CAST(greatest(1, round_even(least(greatest(f, 5), 60) / 4, 0)) AS INT) AS stride FROM (SELECT video_id, CAST(video_id % 80 AS DOUBLE) AS f FROM clips) q")
def _(d):
    return d["clips"].select("video_id", sm.stride((F.col("video_id") % 80).cast("double")).alias("stride"))


@query("sample_frames", "SELECT video_id, frame_idx, ord FROM detections JOIN rates USING (video_id) WHERE frame_idx // stride % stride = 0")
def _(d):
    numbered = sm.with_rate(d["detections"], d["clips"]).select("video_id", F.expr("frame_idx div stride").alias("frame_idx"), "ord")
    return sm.sample_frames(numbered, d["clips"]).select("video_id", (F.col("frame_idx") * F.col("stride")).alias("frame_idx"), "ord")


@query("frame_time", "SELECT video_id, frame_idx, ord, frame_idx / fps AS ts, CAST(floor(frame_idx / fps + 1e-9) AS BIGINT) AS sec FROM detections JOIN rates USING (video_id)")
def _(d):
    fps = F.col("fps")
    return sm.with_rate(d["detections"], d["clips"]).select(*KEY, sm.frame_time(F.col("frame_idx"), fps).alias("ts"), sm.calendar_second(F.col("frame_idx"), fps).alias("sec"))


@query("scene_filter", f"SELECT {DETS} FROM detections WHERE label IN ('person', 'car', 'motorcycle')")
def _(d):
    renamed = d["detections"].withColumn("label", F.when(F.col("label") == "truck", "dog").otherwise(F.col("label")))
    return sm.scene_filter(renamed).select(*DET)


@query("confidence_filter", f"SELECT {DETS} FROM detections WHERE label <> 'person' AND confidence >= 0.4")
def _(d):
    return sm.confidence_filter(d["detections"], VEHICLES, S.scene_confidence).select(*DET)


@query("normalise_scene", f"SELECT {DETS} FROM detections WHERE label IN ('person', 'motorcycle') AND confidence >= 0.6")
def _(d):
    return sm.normalise_scene(d["detections"], 0.6).select(*DET)


CUT = "CAST(greatest(0, least({1} - 1, CAST(trunc({0}) AS BIGINT))) AS INT) AS {0}"


@query("clamp_box", f"SELECT * FROM (SELECT video_id, frame_idx, ord, {CUT.format('x1', 1500)}, {CUT.format('y1', 700)}, {CUT.format('x2', 1500)}, {CUT.format('y2', 700)} FROM detections) q WHERE x2 > x1 AND y2 > y1")
def _(d):
    return sm.with_box(d["detections"].select(*KEY, *g.Box._fields), g.clamp_box(g.box(), F.lit(1500), F.lit(700)))


@query("padded_crop", "SELECT * FROM (SELECT video_id, frame_idx, ord, CAST(greatest(0, floor(x1 - (x2 - x1) * 0.12)) AS INT) AS x1, CAST(greatest(0, floor(y1 - (y2 - y1) * 0.12)) AS INT) AS y1, CAST(least(1500, ceil(x2 + (x2 - x1) * 0.12)) AS INT) AS x2, CAST(least(700, ceil(y2 + (y2 - y1) * 0.12)) AS INT) AS y2 FROM detections) q WHERE x2 > x1 AND y2 > y1")
def _(d):
    return sm.with_box(d["detections"].select(*KEY, *g.Box._fields), g.padded_crop(g.box(), F.lit(1500), F.lit(700), S.crop_margin))


LAPLACE = """, px AS (SELECT vec_id, p // 8 AS r, p % 8 AS c, logits[p + 1] * 400 AS g FROM (SELECT vec_id, logits, unnest(range(64)) AS p FROM logits) q),
lp AS (SELECT o.vec_id, n.g AS up, s.g AS down, w.g AS lt, e.g AS rt, o.g FROM px o JOIN px n ON n.vec_id = o.vec_id AND n.c = o.c AND n.r = abs(o.r - 1) JOIN px s ON s.vec_id = o.vec_id AND s.c = o.c AND s.r = 7 - abs(7 - o.r - 1)
   JOIN px w ON w.vec_id = o.vec_id AND w.r = o.r AND w.c = abs(o.c - 1) JOIN px e ON e.vec_id = o.vec_id AND e.r = o.r AND e.c = 7 - abs(7 - o.c - 1))"""


@query("crop_quality", LAPLACE + "SELECT vec_id FROM lp GROUP BY vec_id HAVING var_pop(up + down + lt + rt - 4 * g) >= 30000")
def _(d):
    crops = d["logits"].select("vec_id", F.lit(8).alias("width"), F.lit(8).alias("height"), F.transform("logits", lambda x: x * 400).alias("gray"))
    return sharp_crops(crops, least_side=8, least=30000.0).select("vec_id")


GATED = "(SELECT DISTINCT video_id, frame_idx FROM detections WHERE {})"


@query("activity_gate", f"SELECT video_id, frame_idx, ord FROM detections SEMI JOIN {GATED.format('confidence >= 0.9')} q USING (video_id, frame_idx)")
def _(d):
    return sm.gate(d["detections"].select(*KEY), d["detections"], PERSON + VEHICLES, 0.9)


@query("vehicle_gate", f"SELECT video_id, frame_idx, ord FROM detections SEMI JOIN {GATED.format("label <> 'person' AND confidence >= 0.4")} q USING (video_id, frame_idx)")
def _(d):
    return sm.gate(d["detections"].select(*KEY), d["detections"], VEHICLES, S.scene_confidence)


@query("every_nth_batch", "SELECT video_id, frame_idx FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS rn FROM (SELECT DISTINCT video_id, frame_idx FROM detections) f) q WHERE CAST(ceil(rn / 8.0) AS BIGINT) % 2 = 0")
def _(d):
    return sm.every_nth_batch(d["detections"].select("video_id", "frame_idx").distinct()).drop("batch_no")


@query("frame_join", "SELECT d.video_id, frame_idx, ord, fps, width, height FROM detections d JOIN clips USING (video_id)")
def _(d):
    return sm.with_frame(d["detections"], d["clips"]).select(*KEY, "fps", "width", "height")


def all_frames(d):
    return d["clips"].select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total_frames") - 1)).alias("frame_idx"))


FRAMES = ", frames AS (SELECT video_id, unnest(range(0, total_frames)) AS frame_idx FROM clips)"


@query("carry_forward", FRAMES + "SELECT f.video_id, f.frame_idx, d.ord, d.actor_id FROM frames f JOIN detections d ON d.video_id = f.video_id JOIN rates r ON r.video_id = f.video_id WHERE d.frame_idx = f.frame_idx - f.frame_idx % r.stride")
def _(d):
    return sm.carry_forward(all_frames(d), d["detections"].select(*KEY, "actor_id"), d["clips"]).select(*KEY, "actor_id")


RIDER = """SELECT video_id, frame_idx, ord FROM detections p WHERE label = 'person' AND NOT EXISTS (SELECT 1 FROM detections m WHERE m.label = 'motorcycle' AND m.video_id = p.video_id AND m.frame_idx = p.frame_idx
  AND greatest(0.0, least(p.x2, (m.x1 + m.x2) * 0.5 + (m.x2 - m.x1) * 1.15 * 0.5) - greatest(p.x1, (m.x1 + m.x2) * 0.5 - (m.x2 - m.x1) * 1.15 * 0.5)) * greatest(0.0, least(p.y2, (m.y1 + m.y2) * 0.5 + (m.y2 - m.y1) * 1.1 * 0.5) - greatest(p.y2 - (p.y2 - p.y1) * 0.6, (m.y1 + m.y2) * 0.5 - (m.y2 - m.y1) * 1.1 * 0.5)) / ((p.x2 - p.x1) * (p.y2 - p.y1) * 0.6) >= 0.1
  AND (p.x1 + p.x2) * 0.5 BETWEEN (m.x1 + m.x2) * 0.5 - (m.x2 - m.x1) * 1.15 * 0.5 AND (m.x1 + m.x2) * 0.5 + (m.x2 - m.x1) * 1.15 * 0.5 AND p.y2 BETWEEN (m.y1 + m.y2) * 0.5 - (m.y2 - m.y1) * 1.1 * 0.5 AND (m.y1 + m.y2) * 0.5 + (m.y2 - m.y1) * 1.1 * 0.5)"""


@query("rider_exclusion", RIDER)
def _(d):
    det = d["detections"]
    return sm.rider_exclusion(det.filter("label = 'person'"), det.filter(F.col("label").isin(*MOTORCYCLES))).select(*KEY)


OVER = "greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"


@query("overlap_pairs", f", boxes AS MATERIALIZED (SELECT video_id, frame_idx, frame_idx // stride AS k, ord, x1, y1, x2, y2 FROM detections JOIN rates USING (video_id)) SELECT * FROM (SELECT b.video_id, b.frame_idx, a.ord AS prev_ord, b.ord, round({OVER} / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {OVER}), 9) AS iou FROM boxes a JOIN boxes b ON a.video_id = b.video_id AND b.k = a.k + 1 AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2) q WHERE iou >= 0.35")
def _(d):
    return tr.overlap_pairs(sm.with_rate(d["detections"], d["clips"]), S.person_iou).withColumn("iou", F.round("iou", 9))


def framed_plates(d, plates=None):
    """Plates of 40 x 14 pixels inside their vehicles, in frame pixels."""
    b = g.Box(F.col("px"), F.col("py"), F.col("px") + 40, F.col("py") + 14)
    rows = (d["plates"] if plates is None else plates).withColumns({f"p_{c}": e for c, e in zip(g.Box._fields, b, strict=True)})
    return sm.plate_to_frame(rows, d["clips"])


FRAMED = """, framed AS (SELECT video_id, frame_idx, ord, least(1919, vx1 + least(vx2 - vx1 - 1, CAST(px AS INT))) AS g_x1, least(1079, vy1 + least(vy2 - vy1 - 1, CAST(py AS INT))) AS g_y1, least(1919, vx1 + least(vx2 - vx1 - 1, CAST(px AS INT) + 40)) AS g_x2, least(1079, vy1 + least(vy2 - vy1 - 1, CAST(py AS INT) + 14)) AS g_y2
  FROM (SELECT *, CAST(greatest(0, least(1919, trunc(x1))) AS INT) AS vx1, CAST(greatest(0, least(1079, trunc(y1))) AS INT) AS vy1, CAST(greatest(0, least(1919, trunc(x2))) AS INT) AS vx2, CAST(greatest(0, least(1079, trunc(y2))) AS INT) AS vy2 FROM plates) q
  WHERE vx2 > vx1 AND vy2 > vy1 AND least(vx2 - vx1 - 1, CAST(px AS INT) + 40) > least(vx2 - vx1 - 1, CAST(px AS INT)) AND least(vy2 - vy1 - 1, CAST(py AS INT) + 14) > least(vy2 - vy1 - 1, CAST(py AS INT)))
"""


@query("plate_to_frame", FRAMED + "SELECT * FROM framed")
def _(d):
    return framed_plates(d).select(*KEY, *[f"g_{c}" for c in g.Box._fields])


# hits come as a list for each frame; every third frame's list is one short, so its hits come by key, where odd crops have none
@query("pose_join", """, pp AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY confidence DESC, ord) AS rank FROM detections WHERE label = 'person')
SELECT video_id, frame_idx, ord, CASE WHEN frame_idx % 3 <> 0 AND rank % 4 <> 0 THEN pose_hit WHEN ord % 2 = 0 THEN NOT pose_hit END AS pose FROM pp""")
def _(d):
    persons = sm.person_rank(d["detections"].filter("label = 'person'"))
    hit = F.when(F.col("rank") % 4 != 0, F.col("pose_hit"))
    lists = persons.groupBy("video_id", "frame_idx").agg(F.array_sort(F.collect_list(F.struct("rank", hit.alias("hit")))).alias("l"))
    hits = F.transform("l", lambda x: x["hit"])
    lists = lists.select("video_id", "frame_idx", F.when(F.col("frame_idx") % 3 == 0, F.slice(hits, 1, F.size("l") - 1)).otherwise(hits).alias("hits"))
    direct = persons.filter("ord % 2 = 0").select(*KEY, (~F.col("pose_hit")).alias("hit"))
    return sm.pose_join(persons, lists, direct).select(*KEY, "pose")


@query("person_rank", "SELECT video_id, frame_idx, ord, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY video_id, frame_idx ORDER BY confidence DESC, ord) AS INT) AS rank FROM detections WHERE label = 'person') q WHERE rank <= 3")
def _(d):
    return sm.person_rank(d["detections"].filter("label = 'person'"), 3).select(*KEY, "rank")


TOP = ", top AS (SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, pos) AS INT) AS rank, pos, logit FROM (SELECT vec_id, unnest(logits) AS logit, unnest(range(64)) AS pos FROM logits) q)"


@query("decode_topk", TOP + "SELECT vec_id, rank, pos // 4 AS query, CAST(pos % 4 AS INT) AS class_id, round(1 / (1 + exp(-logit)), 9) AS score FROM top WHERE rank <= 50 AND 1 / (1 + exp(-logit)) >= 0.5")
def _(d):
    return sm.decode_topk(d["logits"], 4, 300, 0.5, 50).withColumn("score", F.round("score", 9))


@query("best_plate", "SELECT video_id, frame_idx, arg_max(ord, plate_confidence * 1e6 - ord) AS ord, max(plate_confidence) AS plate_confidence FROM plates GROUP BY video_id, frame_idx")
def _(d):
    return pl.best_plate(d["plates"], ["video_id", "frame_idx"])


BADSCORE = "CASE WHEN actor_id % 13 = 0 THEN NULL ELSE score END"


@query("best_text", f"SELECT video_id, frame_idx, arg_max(trim(txt), round(s * 1e6) * 1000 + ord) AS text, max(s) AS score FROM (SELECT *, {BADSCORE} AS s, CASE WHEN i % 6 = 0 THEN '  ' ELSE raw_text END AS txt FROM plates) q WHERE s IS NOT NULL AND trim(txt) <> '' GROUP BY video_id, frame_idx")
def _(d):
    bad = F.when(F.col("actor_id") % 13 == 0, "not a number").otherwise(F.col("score").cast("string"))
    texts = d["plates"].select(*KEY, bad.alias("score"), F.when(F.col("i") % 6 == 0, "  ").otherwise(F.col("raw_text")).alias("text"))
    return pl.best_text(texts, ["video_id", "frame_idx"])


@query("best_pose", "SELECT vec_id // 4 AS crop, arg_max(list_transform(kp, lambda q: q.x), round(box_conf * 1e12) * 4 - vec_id % 4) AS xs, max(box_conf) AS box_conf FROM poses GROUP BY vec_id // 4")
def _(d):
    poses = d["poses"].withColumns({"crop": F.expr("vec_id div 4"), "inst": F.col("vec_id") % 4})
    return pl.best_pose(poses, ["crop"]).select("crop", F.transform("kp", lambda q: q["x"]).alias("xs"), "box_conf")


STAGES = ", stages AS (SELECT video_id, stage, inputs, CAST(ceil(inputs / 8.0) AS BIGINT) AS launches, CASE WHEN video_id % 9 = 0 THEN 0.0 ELSE inputs / 64.0 END AS seconds FROM (SELECT video_id, label AS stage, count(*) AS inputs FROM detections GROUP BY video_id, label) q)"


def stages(d):
    n = d["detections"].groupBy("video_id", F.col("label").alias("stage")).agg(F.count("*").alias("inputs"))
    return n.withColumns({"launches": F.ceil(F.col("inputs") / 8), "seconds": F.when(F.col("video_id") % 9 == 0, 0.0).otherwise(F.col("inputs") / 64.0)})


@query("stage_rates", STAGES + "SELECT video_id, stage, CASE WHEN seconds = 0 THEN 0.0 ELSE inputs / seconds END AS per_second, CASE WHEN launches = 0 THEN 0.0 ELSE inputs / launches END AS average_batch, CASE WHEN launches = 0 THEN 0.0 ELSE seconds * 1000 / launches END AS ms_per_launch FROM stages")
def _(d):
    return runs.stage_rates(stages(d))


@query("run_totals", STAGES + "SELECT video_id, sum(CASE WHEN stage IN ('draw', 'write') THEN 0.0 ELSE seconds END) AS inference_sec, sum(CASE WHEN stage IN ('draw', 'write') THEN seconds ELSE 0.0 END) AS io_sec FROM (SELECT * REPLACE (CASE stage WHEN 'car' THEN 'draw' WHEN 'truck' THEN 'write' ELSE stage END AS stage) FROM stages) q GROUP BY video_id")
def _(d):
    named = stages(d).withColumn("stage", F.when(F.col("stage") == "car", "draw").when(F.col("stage") == "truck", "write").otherwise(F.col("stage")))
    return runs.run_totals(named)


@query("batch_fill", "SELECT video_id, frame_idx, n, CAST(ceil(n / 8.0) AS BIGINT) AS launches, CASE WHEN video_id % 2 = 0 THEN 0 ELSE CAST(ceil(n / 8.0) AS BIGINT) * 8 - n END AS padded, CASE WHEN video_id % 2 = 0 THEN CAST(ceil(n / 8.0) AS BIGINT) * 8 - n ELSE 0 END AS slack FROM (SELECT video_id, frame_idx, count(*) AS n FROM detections GROUP BY video_id, frame_idx) q")
def _(d):
    calls = d["detections"].groupBy("video_id", "frame_idx").agg(F.count("*").alias("n")).withColumn("dynamic", F.col("video_id") % 2 == 0)
    return runs.batch_fill(calls, 8).drop("dynamic")


@query("union_heads", "SELECT vec_id, 'litter' AS head, 0 AS layer, rank FROM top WHERE rank <= 5 UNION ALL SELECT vec_id, 'cigarette', 1, rank FROM top WHERE rank <= 3 AND pos % 4 = 1".join([TOP, ""]))
def _(d):
    top = sm.decode_topk(d["logits"], 4, 300, 0.0, 5).select("vec_id", "rank", "class_id")
    return sm.union_heads(top, top.filter("rank <= 3 and class_id = 1")).drop("class_id")


@query("union_person_bike", """, n AS (SELECT video_id, frame_idx, label, row_number() OVER (PARTITION BY video_id, frame_idx, label ORDER BY ord) - 1 AS k, count(*) FILTER (label = 'person') OVER (PARTITION BY video_id, frame_idx) AS persons, confidence, x1, y1, x2, y2 FROM detections WHERE label IN ('person', 'motorcycle'))
SELECT video_id, frame_idx, CAST(CASE WHEN label = 'person' THEN k ELSE k + persons END AS INT) AS ord, label, confidence, x1, y1, x2, y2 FROM n""")
def _(d):
    listed = lambda kind: F.array_sort(F.collect_list(F.when(F.col("label") == kind, F.struct("ord", F.array("x1", "y1", "x2", "y2").alias("b"), "confidence"))))
    f = d["detections"].groupBy("video_id", "frame_idx").agg(listed("person").alias("p"), listed("motorcycle").alias("m"))
    column = lambda a, k, name: F.transform(a, lambda x: x[k]).alias(name)
    frames = f.select("video_id", "frame_idx", column("p", "b", "person_boxes"), column("p", "confidence", "person_scores"), column("m", "b", "bike_boxes"), column("m", "confidence", "bike_scores"))
    return sm.union_person_bike(frames)


@query("discard_sink", "SELECT count(*) AS rows FROM detections")
def _(d):
    src.discard(d["detections"])
    return d["detections"].agg(F.count("*").alias("rows"))


@query("score_batches", "SELECT video_id, frame_idx, ord, round(confidence * 0.5 + 0.25, 9) AS model_score FROM detections")
def _(d):
    def model():
        return lambda rows: rows["confidence"] * 0.5 + 0.25

    out = score_batches(d["detections"].select(*KEY, "confidence"), model, "model_score double")
    return out.select(*KEY, F.round("model_score", 9).alias("model_score"))


@query("scene_callback", f"SELECT {DETS} FROM detections WHERE label IN ('person', 'motorcycle') AND confidence >= 0.6")
def _(d):
    def callback():
        return lambda rows: rows["label"].where(rows["confidence"] >= 0.6, "dog")

    called = score_batches(d["detections"].select(*DET), callback, "said string")
    return sm.normalise_scene(called.withColumn("label", F.col("said")), 0.6).select(*DET)


@query("model_lists", "SELECT video_id, frame_idx, box, CAST(k AS INT) AS ord, format('{}-{}', label, k) AS text, round(confidence / (k + 1), 9) AS score FROM (SELECT video_id, frame_idx, ord AS box, label, confidence, unnest(range(0, ord % 3)) AS k FROM detections) q")
def _(d):
    """A model that reads none, one or two texts from each box."""

    def model():
        return lambda rows: [[(f"{label}-{k}", c / (k + 1)) for k in range(n % 3)] for label, c, n in zip(rows["label"], rows["confidence"], rows["box"], strict=True)]

    out = detect_batches(d["detections"].select("video_id", "frame_idx", F.col("ord").alias("box"), "label", "confidence"), model, "text string, score double")
    return out.select("video_id", "frame_idx", "box", "ord", "text", F.round("score", 9).alias("score"))


def images(d):
    """Frames whose image is the list of what can be seen in it."""
    seen = F.sort_array(F.collect_list(F.struct("ord", "label", "confidence", *g.Box._fields)))
    frames = d["detections"].groupBy("video_id", "frame_idx").agg(seen.alias("image"))
    return sm.with_rate(frames, d["clips"]).filter("frame_idx % stride = 0")


def normalised(boxes):
    """What is kept of a callback's boxes, in its order."""
    kept = sm.normalise_scene(boxes, 0.6)
    return kept.select(*DET)


@query("frame_callback", f"SELECT video_id, frame_idx, ord, label, round(confidence * CASE WHEN frame_idx / fps < 20 THEN 1 ELSE 0.9 END, 9) AS confidence, x1, y1, x2, y2 FROM detections JOIN rates USING (video_id) WHERE label IN ('person', 'motorcycle') AND confidence * CASE WHEN frame_idx / fps < 20 THEN 1 ELSE 0.9 END >= 0.6")
def _(d):
    """A callback for one frame, less sure from its 20th second on."""

    def callback(frame_idx, image, ts):
        return [(x["label"], x["confidence"] * (1 if ts < 20 else 0.9), (x["x1"], x["y1"], x["x2"], x["y2"])) for x in image]

    return normalised(callback_boxes(images(d), callback)).withColumn("confidence", F.round("confidence", 9))


@query("window_callback", """, wf AS (SELECT DISTINCT video_id, frame_idx, frame_idx // (stride * 8) AS w FROM detections JOIN rates USING (video_id)), wn AS (SELECT video_id, frame_idx, count(*) OVER (PARTITION BY video_id, w) AS n FROM wf)
  SELECT video_id, frame_idx, ord, label, round(confidence * n / 8, 9) AS confidence, x1, y1, x2, y2 FROM detections JOIN wn USING (video_id, frame_idx) WHERE label IN ('person', 'motorcycle') AND confidence * n / 8 >= 0.6""")
def _(d):
    """A callback for a read window, as sure as its window is full."""

    def callback(items):
        return [[(x["label"], x["confidence"] * len(items) / 8, (x["x1"], x["y1"], x["x2"], x["y2"])) for x in image] for _, image, _ in items]

    return normalised(callback_boxes(images(d), callback, batched=True)).withColumn("confidence", F.round("confidence", 9))


POSE_CARRY = """WITH q AS (SELECT video_id, frame_idx, count(*) FILTER (label = 'person') AS persons, count(*) FILTER (label = 'person' AND pose_hit) AS posed, max(ord) FILTER (label = 'person' AND pose_hit) AS last FROM detections GROUP BY video_id, frame_idx),
  c AS (SELECT *, CASE WHEN posed > 0 THEN last WHEN persons > 0 THEN -1 END AS v FROM q)
  SELECT video_id, frame_idx, nullif(last_value(v IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING), -1) AS pose FROM c"""


def held_poses(d):
    person = F.col("label") == "person"
    f = d["detections"].groupBy("video_id", "frame_idx").agg(F.count_if(person).alias("persons"), F.max(F.when(person & F.col("pose_hit"), F.col("ord"))).alias("pose"))
    return sm.pose_carry(f)


@query("pose_carry", f", ps1 AS ({POSE_CARRY}) SELECT * FROM ps1")
def _(d):
    return held_poses(d)
