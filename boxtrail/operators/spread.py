"""Order along a video without one task for a video: sums, numbers and carried values in buckets of frames.

A window runs inside each (video, bucket); what earlier buckets bring is a second window over one row for each bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Frames of a bucket: about an hour of sampled video.
BUCKET = 1 << 14
KEY = ["video_id", "bucket"]


def placed(rows: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """Adds _place, a row's number in its group: groups lie whole and in order in a partition, and rows that lie so stay where they are."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def _bucketed(frames: DataFrame) -> DataFrame:
    return frames.withColumn("bucket", F.expr(f"frame_idx div {BUCKET}"))


def _inside():
    return Window.partitionBy(*KEY).orderBy("frame_idx")


def _earlier():
    return Window.partitionBy("video_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)


def running_sum(frames: DataFrame, value: Column, into: str) -> DataFrame:
    """Adds the sum of ``value`` over a video's frames up to this one; frames (video_id, frame_idx) are distinct."""
    rows = _bucketed(frames).withColumn(into, value.cast("long"))
    before = rows.groupBy(*KEY).agg(F.sum(into).alias("_n")).withColumn("_n", F.coalesce(F.sum("_n").over(_earlier()), F.lit(0)))
    rows = rows.withColumn(into, F.sum(into).over(_inside().rowsBetween(Window.unboundedPreceding, 0)))
    return rows.join(before, KEY).withColumn(into, F.col(into) + F.col("_n")).drop("_n", "bucket")


def carried(frames: DataFrame, value: Column, into: str) -> DataFrame:
    """Adds the last value that is not null at or before each frame of a video."""
    rows = _bucketed(frames).withColumn(into, value)
    ends = rows.groupBy(*KEY).agg(F.max_by(into, F.when(F.col(into).isNotNull(), F.col("frame_idx"))).alias("_v"))
    ends = ends.withColumn("_v", F.last("_v", ignorenulls=True).over(_earlier()))
    rows = rows.withColumn(into, F.last(into, ignorenulls=True).over(_inside().rowsBetween(Window.unboundedPreceding, 0)))
    return rows.join(ends, KEY).withColumn(into, F.coalesce(into, "_v")).drop("_v", "bucket")


def previous_frame(frames: DataFrame, into: str) -> DataFrame:
    """Adds the frame before each one of a video's distinct frames, null at the first."""
    rows = _bucketed(frames)
    ends = rows.groupBy(*KEY).agg(F.max("frame_idx").alias("_f")).withColumn("_f", F.max("_f").over(_earlier()))
    return rows.withColumn(into, F.lag("frame_idx").over(_inside())).join(ends, KEY).withColumn(into, F.coalesce(into, "_f")).drop("_f", "bucket")
