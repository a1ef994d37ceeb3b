"""Sampling, filters and gates on detection tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxtrail.functions import geometry as g
from boxtrail.operators.spread import carried, running_sum
from boxtrail.settings import DEFAULT, MOTORCYCLES, PERSON, VEHICLES, Settings

FRAME = ["video_id", "frame_idx"]


def stride(fps: Column, s: Settings = DEFAULT, override: int | None = None) -> Column:
    """Frames between samples: the clamped rate over the target, half to even, 1 at least."""
    if override:
        return F.lit(max(1, override))
    target = s.target_rate if s.target_rate > 0 else 5.0
    return F.greatest(F.lit(1), F.bround(F.least(F.greatest(fps, F.lit(s.fps_min)), F.lit(s.fps_max)) / target).cast("int"))


def sample_frames(frames: DataFrame, clips: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Rows of sampled frames, with the clip's stride. Clips are one row per video: small, left to the planner to broadcast."""
    strides = clips.select("video_id", stride(F.col("fps"), s).alias("stride"))
    return frames.join(strides, "video_id").filter("frame_idx % stride = 0")


def with_rate(rows: DataFrame, clips: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Rows with fps and stride of their clip: the rate goes along with the key, so clips of any rates share a run."""
    return rows.join(clips.select("video_id", "fps", stride(F.col("fps"), s).alias("stride")), "video_id")


def frame_time(frame: Column, fps: Column) -> Column:
    return frame / fps


def calendar_second(frame: Column, fps: Column) -> Column:
    return F.floor(frame / fps + 1e-9)


def scene_filter(detections: DataFrame) -> DataFrame:
    return detections.filter(F.col("label").isin(*PERSON, *VEHICLES))


def confidence_filter(detections: DataFrame, labels: tuple[str, ...], least: float) -> DataFrame:
    return detections.filter(F.col("label").isin(*labels) & (F.col("confidence") >= least))


def normalise_scene(detections: DataFrame, least: float = 0.0, keep_motorcycles: bool = True) -> DataFrame:
    return confidence_filter(detections, PERSON + (MOTORCYCLES if keep_motorcycles else ()), least)


def with_frame(detections: DataFrame, clips: DataFrame) -> DataFrame:
    """Frame size and rate for each box."""
    return detections.join(clips.select("video_id", "fps", "width", "height", "total_frames"), "video_id")


def with_box(rows: DataFrame, b: g.Box) -> DataFrame:
    """Rows with their box replaced, those whose box became empty dropped."""
    return rows.withColumns(dict(zip(g.Box._fields, b, strict=True))).filter(g.not_empty(g.box()))


def gate(rows: DataFrame, scene: DataFrame, labels: tuple[str, ...], least: float) -> DataFrame:
    """Rows of frames that hold a box of ``labels`` at ``least``."""
    return rows.join(confidence_filter(scene, labels, least).select(*FRAME), FRAME, "left_semi")


def every_nth_batch(frames: DataFrame, batch: int = DEFAULT.batch, n: int = DEFAULT.every_nth) -> DataFrame:
    """Of the gated frames of each video, in batches of ``batch``, those of every n-th batch; the count restarts per video."""
    rows = running_sum(frames, F.lit(1), "rn")
    return rows.withColumn("batch_no", F.ceil(F.col("rn") / batch)).filter(F.col("batch_no") % n == 0).drop("rn")


def carry_forward(frames: DataFrame, samples: DataFrame, clips: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """For every frame the rows of the last sampled frame at or before it; an empty sample carries as empty."""
    strides = clips.select("video_id", stride(F.col("fps"), s).alias("stride"))
    at = frames.join(strides, "video_id").withColumn("sample_frame", F.expr("frame_idx - frame_idx % stride")).drop("stride")
    return at.join(samples.withColumnRenamed("frame_idx", "sample_frame"), ["video_id", "sample_frame"])


def until_next(samples: DataFrame, clips: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Rows of sampled frames on every decoded frame up to the next sampled one; no frame table is needed."""
    rows = with_rate(samples, clips, s).join(clips.select("video_id", "total_frames"), "video_id").filter("frame_idx % stride = 0 and frame_idx < total_frames")
    shown = F.explode(F.sequence("frame_idx", F.least(F.col("frame_idx") + F.col("stride"), "total_frames") - 1))
    return rows.withColumn("frame_idx", shown).drop("fps", "stride", "total_frames")


def rider_exclusion(persons: DataFrame, bikes: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Persons who do not sit on a motorcycle of their frame."""
    b = bikes.select(*FRAME, *[F.col(c).alias(f"m_{c}") for c in g.Box._fields])
    p = persons.alias("p")
    test = g.on_motorcycle(g.box("p."), g.box("b.m_"), s.bike_x, s.bike_y, s.bike_lower, s.bike_overlap)
    same = (F.col("p.video_id") == F.col("b.video_id")) & (F.col("p.frame_idx") == F.col("b.frame_idx"))
    return p.join(b.alias("b"), same & test, "left_anti")


def plate_to_frame(plates: DataFrame, clips: DataFrame) -> DataFrame:
    """Plate boxes (p_x1..p_y2 inside a vehicle's cut) in frame pixels, clamped to the cut and to the frame."""
    rows = plates.join(clips.select("video_id", "width", "height"), "video_id")
    v = g.clamp_box(g.box(), F.col("width"), F.col("height"))
    rows = rows.withColumns({f"v_{c}": e for c, e in zip(g.Box._fields, v, strict=True)}).filter(g.not_empty(g.box("v_")))
    inner = g.clamp_box(g.box("p_"), F.col("v_x2") - F.col("v_x1"), F.col("v_y2") - F.col("v_y1"))
    rows = rows.withColumns({f"q_{c}": e for c, e in zip(g.Box._fields, inner, strict=True)}).filter(g.not_empty(g.box("q_")))
    q, vb = g.box("q_"), g.box("v_")
    moved = g.Box(vb.x1 + q.x1, vb.y1 + q.y1, vb.x1 + q.x2, vb.y1 + q.y2)
    out = g.clamp_box(moved, F.col("width"), F.col("height"))
    rows = rows.withColumns({f"g_{c}": e for c, e in zip(g.Box._fields, out, strict=True)}).filter(g.not_empty(g.box("g_")))
    return rows.drop(*[f"{p}_{c}" for p in "vqp" for c in g.Box._fields], "width", "height")


def person_rank(persons: DataFrame, cap: int | None = None) -> DataFrame:
    """Persons of a frame by falling confidence, input order in ties; at most ``cap`` if given."""
    rank = F.row_number().over(Window.partitionBy(*FRAME).orderBy(F.desc("confidence"), "ord"))
    ranked = persons.withColumn("rank", rank)
    return ranked.filter(F.col("rank") <= cap) if cap else ranked


def decode_topk(logits: DataFrame, classes: int, k: int, threshold: float, most: int, key: str = "vec_id") -> DataFrame:
    """Sigmoid scores of a flat queries x classes list: the k best by score then place, over the threshold, ``most`` at most.

    A list is sorted in its row, so nothing is shuffled.
    """
    worst_first = F.transform("logits", lambda x, i: F.struct((-x).alias("neg"), i.alias("pos")))
    best = F.slice(F.array_sort(worst_first), 1, min(k, most))
    top = logits.select(key, F.posexplode(best).alias("place", "t")).withColumn("score", 1 / (1 + F.exp("t.neg")))
    top = top.filter(F.col("score") >= threshold)
    return top.select(key, (F.col("place") + 1).alias("rank"), F.expr(f"t.pos div {classes}").alias("query"), (F.col("t.pos") % classes).alias("class_id"), "score")


def explode_arrays(frames: DataFrame, default_score: float = 1.0, label: str = "person") -> DataFrame:
    """Detections from columns boxes (arrays of 4 numbers) and scores (may be null); a box of another size fails."""
    pairs = F.transform("boxes", lambda b, i: F.struct(b.alias("b"), F.get("scores", i).alias("s")))
    rows = frames.select(*FRAME, F.posexplode(pairs).alias("ord", "d"))
    b = F.when(F.size("d.b") == 4, F.col("d.b")).otherwise(F.raise_error(F.lit("a box must have 4 numbers")).cast("array<double>"))
    rows = rows.withColumn("b", b)
    return rows.select(*FRAME, "ord", F.lit(label).alias("label"), F.coalesce("d.s", F.lit(default_score)).alias("confidence"), *[F.element_at("b", k + 1).alias(c) for k, c in enumerate(g.Box._fields)])


def pose_join(persons: DataFrame, prefetched: DataFrame, direct: DataFrame) -> DataFrame:
    """persons with pose: the hit of each one's crop.

    ``prefetched`` (video_id, frame_idx, hits) lists hits by place in the frame, persons in order of ``rank``. Where the list
    is missing, its length is not the number of persons, or an entry is null, the hit comes from ``direct`` (video_id,
    frame_idx, ord, hit) by key; a crop without any hit is null.
    """
    counts = persons.groupBy(*FRAME).agg(F.count("*").alias("_n"))
    fits = prefetched.join(counts, FRAME).filter(F.size("hits") == F.col("_n")).select(*FRAME, "hits")
    rows = persons.join(fits, FRAME, "left").join(direct.select(*FRAME, "ord", F.col("hit").alias("_direct")), [*FRAME, "ord"], "left")
    return rows.withColumn("pose", F.coalesce(F.get("hits", F.col("rank") - 1), "_direct")).drop("hits", "_direct")


def pose_carry(frames: DataFrame) -> DataFrame:
    """(video_id, frame_idx, pose) from frames with persons (a count) and pose (null: none): the last pose stays.

    A frame with persons and no pose clears it, a frame without persons keeps it.
    """
    value = F.when(F.col("pose").isNotNull(), F.struct("pose")).when(F.col("persons") > 0, F.struct(F.lit(None).cast(frames.schema["pose"].dataType).alias("pose")))
    return carried(frames, value, "held").select(*FRAME, F.col("held.pose").alias("pose"))


def union_heads(litter: DataFrame, cigarette: DataFrame) -> DataFrame:
    """Boxes of both heads in one table with head and layer; litter comes first in a frame."""
    named = lambda rows, head, layer: rows.withColumns({"head": F.lit(head), "layer": F.lit(layer)})
    return named(litter, "litter", 0).unionByName(named(cigarette, "cigarette", 1))


def union_person_bike(frames: DataFrame, label: str = "motorcycle") -> DataFrame:
    """Detections from columns person_boxes, person_scores, bike_boxes, bike_scores: persons first, ``ord`` runs on over both."""
    part = lambda kind, said: explode_arrays(frames.select(*FRAME, F.col(f"{kind}_boxes").alias("boxes"), F.col(f"{kind}_scores").alias("scores")), label=said)
    before = frames.select(*FRAME, F.coalesce(F.size("person_boxes"), F.lit(0)).alias("_n"))
    bikes = part("bike", label).join(before, FRAME).withColumn("ord", F.col("ord") + F.greatest("_n", F.lit(0))).drop("_n")
    return part("person", "person").unionByName(bikes)
