"""Scoring against labelled clips over a grid of thresholds and durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxtrail.functions.text import base_name, clip_tag, outcome, outcome_note, parse_bool

THRESHOLDS = [round(0.05 + 0.01 * k, 2) for k in range(16)]


def parse_manifest(lines: DataFrame) -> DataFrame:
    """(video, truth) from a labelled list with line_no: header aliases in any case, blank names skipped, the last line of a name wins."""
    have = {c.strip().lower(): c for c in lines.columns}
    pick = lambda *names: next((have[n] for n in names if n in have), None)
    video, truth = pick("video", "video_path", "file"), pick("ground_truth_peeing", "ground_truth", "label", "expected_peeing")
    if not video or not truth:
        raise ValueError("a manifest needs a video and a truth column")
    name = F.trim(F.coalesce(F.col(f"`{video}`"), F.lit("")))
    rows = lines.filter(name != "").select(base_name(name).alias("video"), parse_bool(F.col(f"`{truth}`")).alias("truth"), "line_no")
    return rows.groupBy("video").agg(F.max_by("truth", "line_no").alias("truth"))


def truth_join(clips: DataFrame, manifest: DataFrame) -> DataFrame:
    """clips (video) with truth: by name from the manifest, else by prefix, else it fails."""
    tag = clip_tag(F.col("video"))
    by_prefix = F.when(tag.isin("FN", "TP"), True).when(tag == "FP", False)
    known = clips.join(manifest.withColumnRenamed("truth", "listed"), "video", "left")
    fails = F.raise_error(F.concat(F.lit("no truth for "), F.col("video"))).cast("boolean")
    return known.withColumn("truth", F.when(F.coalesce("listed", by_prefix).isNotNull(), F.coalesce("listed", by_prefix)).otherwise(fails)).drop("listed")


def grid(spark, thresholds: list[float], seconds: list[int]) -> DataFrame:
    """threshold x seconds; parameters, so of a fixed size."""
    t = spark.createDataFrame([(float(x),) for x in thresholds], "threshold double")
    return t.crossJoin(spark.createDataFrame([(int(x),) for x in seconds], "seconds int"))


def eval_rows(predicted: DataFrame) -> DataFrame:
    """The evaluation table from (video, path, threshold, seconds, truth, events)."""
    hit = F.col("events") > 0
    rows = predicted.withColumn("result", outcome(F.col("truth"), hit)).withColumn("clip_tag", clip_tag(F.col("video")))
    yes = lambda c: F.when(c, "yes").otherwise("no")
    return rows.select(
        "video", "clip_tag", "path", "threshold", "seconds", yes(F.col("truth")).alias("truth"), yes(hit).alias("predicted"), "result",
        yes(F.col("result").isin("TP", "TN")).alias("is_correct"), yes(F.col("result") == "TP").alias("is_tp"), "events",
        outcome_note(F.col("result"), F.col("clip_tag"), F.col("truth")).alias("notes"),
    )


def confusion(rows: DataFrame) -> DataFrame:
    n = lambda *r: F.count_if(F.col("result").isin(*r))
    return rows.groupBy("threshold", "seconds").agg(
        n("TP").alias("tp"), n("FN").alias("fn"), n("FP").alias("fp"), n("TN").alias("tn"), n("TP", "TN").alias("correct"), F.count("*").alias("clips")
    )


def sweep_cell() -> Column:
    return F.format_string("%d/%d (%d+%d)", "correct", "clips", "tp", "tn")


def sweep_matrix(rows: DataFrame, seconds: list[int]) -> DataFrame:
    """threshold x duration, cells 'correct/clips (tp+tn)'; one column per given duration."""
    table = confusion(rows).withColumn("cell", sweep_cell()).groupBy("threshold").pivot("seconds", seconds).agg(F.first("cell"))
    return table.select("threshold", *[F.col(str(x)).alias(f"s{x}") for x in seconds])


def clip_matrix(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """A row for each clip and duration, with its result at every given threshold (t0_05 for 0.05) and how many are correct.

    The grid is in the columns, so rows grow with the clips and no cell holds more than one result.
    """
    cells = [F.max(F.when(F.col("threshold") == t, F.col("result"))).alias(f"t{t:.2f}".replace(".", "_")) for t in thresholds]
    return rows.groupBy("path", "video", "seconds").agg(*cells, F.count_if(F.col("result").isin("TP", "TN")).alias("correct"))


def by_tag(rows: DataFrame) -> DataFrame:
    """A line 'clip: result' for each clip of each tag, by grid point, tag and clip: sorted in ranges, so a tag's lines may fill many tasks."""
    lines = rows.select("threshold", "seconds", "clip_tag", "video", "path", F.concat_ws(": ", "video", "result").alias("line"))
    return lines.orderBy("threshold", "seconds", "clip_tag", "video", "path")


def streaks_for_grid(streaks: DataFrame, seconds: DataFrame, of_track: tuple[str, ...] = ()) -> DataFrame:
    """Confirming frame per track and grid point from streaks (threshold, sec, streak, next_frame), without a rerun; ``of_track`` are a track's columns to keep."""
    joined = streaks.join(F.broadcast(seconds), F.col("streak") >= F.col("seconds"))
    return joined.groupBy("video_id", "track_id", *of_track, "threshold", "seconds").agg(F.min("next_frame").alias("confirm_frame"))


def event_counts(ranges: DataFrame) -> DataFrame:
    """Merged intervals per video and grid point."""
    by = Window.partitionBy("video_id", "threshold", "seconds").orderBy("confirm_frame", "expiry_frame", "track_id")
    reach = F.max("expiry_frame").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = reach.isNull() | (F.col("confirm_frame") > reach)
    return ranges.withColumn("new", new).groupBy("video_id", "threshold", "seconds").agg(F.count_if("new").alias("events"))
