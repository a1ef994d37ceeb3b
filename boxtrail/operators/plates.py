"""Plate texts: best of a crop, best so far of a track, lock, and the reading cadence."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxtrail.functions.text import inner_dash, plate_label, plate_text
from boxtrail.operators.machines import PlateState
from boxtrail.operators.spread import placed
from boxtrail.settings import DEFAULT, Settings

TRACK = ["video_id", "track_id"]


def best_plate(plates: DataFrame, crop: list[str]) -> DataFrame:
    """The most confident plate of each crop; the first in a tie."""
    return plates.groupBy(*crop).agg(
        F.max_by("ord", F.struct("plate_confidence", -F.col("ord"))).alias("ord"), F.max("plate_confidence").alias("plate_confidence")
    )


def best_text(texts: DataFrame, crop: list[str]) -> DataFrame:
    """The best scored text of each crop, the last in a tie; blank texts and scores that are no numbers are skipped."""
    rows = texts.withColumn("score", F.expr("try_cast(score AS double)")).withColumn("text", F.trim("text"))
    rows = rows.filter("score is not null and text <> ''")
    return rows.groupBy(*crop).agg(F.max_by("text", F.struct("score", "ord")).alias("text"), F.max("score").alias("score"))


def best_pose(poses: DataFrame, crop: list[str]) -> DataFrame:
    """The keypoints of the instance with the highest box confidence; the first in a tie."""
    return poses.groupBy(*crop).agg(F.max_by("kp", F.struct("box_conf", -F.col("inst"))).alias("kp"), F.max("box_conf").alias("box_conf"))


def running_best_text(readings: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Adds best_text and best_score over the track's readings so far; the later wins a tie."""
    by = Window.partitionBy(*TRACK).orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    text = plate_text(F.col("raw_text"))
    valid = (text != "") & (F.col("score") >= s.text_confidence)
    best = F.max(F.when(valid, F.struct("score", "frame_idx", text.alias("text")))).over(by)
    return readings.withColumn("best", best).withColumns({"best_text": F.coalesce("best.text", F.lit("")), "best_score": F.coalesce("best.score", F.lit(0.0))}).drop("best")


def lock_flag(s: Settings = DEFAULT) -> Column:
    return (F.col("best_score") >= s.lock_confidence) & inner_dash(F.col("best_text"))


def text_lock(readings: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Adds locked: for good once the best text so far is sure and has an inner dash."""
    by = Window.partitionBy(*TRACK).orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    return running_best_text(readings, s).withColumn("locked", F.max(lock_flag(s)).over(by))


def label_carry(readings: DataFrame, frames: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Per live track and frame the last plate label at or before it."""
    best = running_best_text(readings, s)
    label = plate_label(F.col("best_text"), F.col("best_score"), F.col("score"), F.col("plate_confidence"), s.text_confidence)
    rows = frames.join(best.select(*TRACK, "frame_idx", label.alias("label")), [*TRACK, "frame_idx"], "left")
    by = Window.partitionBy(*TRACK).orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("label", F.last("label", ignorenulls=True).over(by))


def labels_read(readings: DataFrame, read: Column, s: Settings = DEFAULT) -> DataFrame:
    """Adds label to rows of tracks: the last plate label at or before each, of the rows that are ``read``; one pass over a track."""
    by = Window.partitionBy(*TRACK).orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    best = running_best_text(readings.withColumn("score", F.when(read, F.col("score"))), s)
    label = plate_label(F.col("best_text"), F.col("best_score"), F.col("score"), F.col("plate_confidence"), s.text_confidence)
    return best.withColumn("label", F.last(F.when(read, label), ignorenulls=True).over(by)).drop("best_text", "best_score")


def _cadence(key: list[str], s: Settings):
    def cadence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last = PlateState(), None
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in key), strict=True))
            rows = zip(*(batch.column(c).to_pylist() for c in ("frame_idx", "norm", "dashed", "score")), zip(*(batch.column(c).to_pylist() for c in PLATE_BOX), strict=True), strict=True)
            out = []
            for now, row in zip(keys, rows, strict=True):
                if now != last:
                    state, last = PlateState(), now
                out.append((state.see(*row, s), state.text, state.confidence, state.locked))
            done = zip(*out, strict=True) if out else [[]] * 4
            types = (pa.string(), pa.string(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in (*key, "frame_idx")), *(pa.array(c, t) for c, t in zip(done, types, strict=True))],
                [*key, "frame_idx", "action", "text", "text_confidence", "locked"],
            )

    return cadence


PLATE_BOX = ["g_x1", "g_y1", "g_x2", "g_y2"]


def read_cadence(readings: DataFrame, s: Settings = DEFAULT, key: tuple[str, ...] = ("video_id", "track_id")) -> DataFrame:
    """What is read of each track, one sample after the other.

    Rows need track keys, frame_idx, raw_text, score, plate_confidence and the plate box g_x1..g_y2. Adds action (skip:
    too early; keep: locked and in the same place, so the text stays and the box moves; read) and text, confidence,
    locked after the sample. Each choice depends on the one before, so a track's rows meet in one partition in frame
    order; what is held of it is its state.
    """
    rows = readings.withColumn("norm", plate_text(F.col("raw_text"))).withColumn("dashed", inner_dash(F.col("norm")))
    rows = rows.select(*key, "frame_idx", "score", "norm", "dashed", *[F.col(c).cast("double").alias(c) for c in PLATE_BOX])
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in (*key, "frame_idx")) + ", action string, text string, text_confidence double, locked boolean"
    return placed(rows, list(key), ["frame_idx"]).mapInArrow(_cadence(list(key), s), schema)
