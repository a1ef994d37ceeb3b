"""Clip metadata, error rows and run statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxtrail.settings import DEFAULT, Settings


def clip_metadata(clips: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Adds duration, valid (fps > 0) and unusual_fps; a bad clip has no duration."""
    ok = F.coalesce(F.col("fps") > 0, F.lit(False))
    return clips.withColumns({
        "valid": ok,
        "duration": F.when(ok, F.col("total_frames") / F.col("fps")),
        "unusual_fps": ok & ~F.col("fps").between(s.fps_min, s.fps_max),
    })


def error_rows(metadata: DataFrame) -> DataFrame:
    """One run row per clip: bad clips as success=false with a message, and the batch goes on."""
    good = metadata.filter("valid").select("video_id", "path", F.lit(True).alias("success"), F.lit("").alias("error"), "duration")
    bad = metadata.filter("not valid").select("video_id", "path", F.lit(False).alias("success"), F.lit("invalid frame rate").alias("error"), F.lit(0.0).alias("duration"))
    return good.unionByName(bad)


def batch_fill(calls: DataFrame, size: int) -> DataFrame:
    """Launches of (n inputs) in batches of ``size`` and the unused slots: padded in fixed batches, slack in dynamic ones."""
    n = F.greatest(F.col("n"), F.lit(0))
    launches = F.ceil(n / size)
    rows = calls.withColumn("launches", launches).withColumn("unused", launches * size - n)
    return rows.withColumn("padded", F.when(F.col("dynamic"), 0).otherwise(F.col("unused"))).withColumn("slack", F.when(F.col("dynamic"), F.col("unused")).otherwise(0)).drop("unused")


def stage_rates(stages: DataFrame) -> DataFrame:
    """Inputs per second, average batch and milliseconds per launch; 0 when the divisor is 0."""
    over = lambda a, b: F.coalesce(F.try_divide(a, F.nullif(b, F.lit(0.0))), F.lit(0.0))
    n, launches, seconds = F.col("inputs").cast("double"), F.col("launches").cast("double"), F.col("seconds").cast("double")
    return stages.select("video_id", "stage", over(n, seconds).alias("per_second"), over(n, launches).alias("average_batch"), over(seconds * 1000, launches).alias("ms_per_launch"))


def run_totals(stages: DataFrame) -> DataFrame:
    """Inference and I/O seconds per clip."""
    io = F.col("stage").isin("write", "draw")
    return stages.groupBy("video_id").agg(
        F.sum(F.when(io, 0.0).otherwise(F.col("seconds"))).alias("inference_sec"), F.sum(F.when(io, F.col("seconds")).otherwise(0.0)).alias("io_sec")
    )


def batch_totals(runs: DataFrame, times: DataFrame, *levels: str) -> DataFrame:
    """Clips that went well and that failed, and their seconds, for every level of ``levels`` and over all, in one pass.

    ``runs`` has video_id, success, duration, wall_sec and the levels, ``times`` inference_sec and encode_io_sec by video. A failed
    clip counts with its wall time only. Levels summed over are null.
    """
    rows = runs.join(times.select("video_id", "inference_sec", "encode_io_sec"), "video_id", "left")
    good = lambda c: F.sum(F.when(F.col("success"), F.col(c)))
    return rows.rollup(*levels).agg(
        F.count_if("success").alias("ok"), F.count_if(~F.col("success")).alias("failed"), good("duration").alias("duration_sec"), F.sum("wall_sec").alias("wall_sec"),
        good("inference_sec").alias("inference_sec"), good("encode_io_sec").alias("encode_io_sec"),
    )


def incidents_per_clip(clips: DataFrame, incidents: DataFrame) -> DataFrame:
    """Event count and detected flag, clips without events included."""
    n = incidents.groupBy("video_id").agg(F.count("*").alias("n"))
    return clips.select("video_id").join(n, "video_id", "left").select("video_id", F.coalesce("n", F.lit(0)).alias("events"), (F.coalesce("n", F.lit(0)) > 0).alias("detected"))
