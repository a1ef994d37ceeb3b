"""The result tables in full: clip summary, intervals, run manifest, evaluation. Column names are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxtrail.functions.text import boxes_json, clock_text, video_time

#: Columns of the result tables, in order.
SUMMARY = (
    "input_path", "output_path", "success", "error", "width", "height", "fps", "total_frames", "duration_sec", "video_duration_str",
    "wall_sec", "wall_duration_str", "completed_in_min_sec", "models_init_sec", "other_sec", "yolo_sec", "peeing_sec",
    "annotate_draw_sec", "video_write_sec", "inference_sec", "encode_io_sec", "yolo_input_frames", "yolo_batch_launches",
    "yolo_padded_slots", "yolo_max_batch_slack", "peeing_pose_input_crops", "peeing_pose_batch_launches", "peeing_pose_padded_slots",
    "peeing_pose_max_batch_slack", "peeing_pose_prefetch_windows", "peeing_pose_prefetch_frames", "peeing_pose_prefetch_crops",
    "peeing_pose_prefetch_unused_hits", "peeing_detected", "peeing_event_count",
)
INTERVALS = (
    "input_path", "output_path", "event_index", "start_frame", "end_frame", "start_sec", "end_sec", "duration_sec", "start_time_str",
    "end_time_str", "duration_str", "n_confirmed_bboxes", "bboxes_json", "open_interval",
)
MANIFEST = (
    "input_path", "output_path", "success", "error", "duration_sec", "fps", "width", "height", "total_frames", "wall_sec",
    "inference_sec", "encode_io_sec", "models_init_sec",
)
EVALUATION = (
    "video", "clip_tag", "video_path", "hand_groin_y_threshold", "seconds_required", "should_detect_peeing", "ground_truth_peeing",
    "predicted_peeing", "result", "is_correct", "is_tp", "peeing_event_count", "wall_sec", "notes",
)
SECONDS = ("other_sec", "yolo_sec", "peeing_sec", "annotate_draw_sec", "video_write_sec")
COUNTERS = tuple(c for c in SUMMARY if c.startswith(("yolo_", "peeing_pose_")) and not c.endswith("_sec"))


def six(x: Column) -> Column:
    return F.format_string("%.6f", x)


def step_sums(times: DataFrame) -> DataFrame:
    """times (video_id, seconds of each step, other columns) with inference_sec and encode_io_sec."""
    infer = F.col("yolo_sec") + F.col("peeing_sec") + F.col("annotate_draw_sec")
    return times.withColumns({"inference_sec": infer, "encode_io_sec": F.col("video_write_sec") + F.col("other_sec")})


def summary_table(runs: DataFrame, times: DataFrame, events: DataFrame) -> DataFrame:
    """One row per clip of ``runs`` (video_id, input_path, output_path, success, error, size, fps, total_frames, duration, wall_sec, models_init_sec).

    ``times`` has step seconds and counters by video, ``events`` video_id and events. A failed clip has no rate, length or
    step sums; a clip without times has no step columns.
    """
    rows = runs.join(step_sums(times), "video_id", "left").join(events, "video_id", "left")
    ok = lambda c: F.when(F.col("success"), c)
    n = F.coalesce("events", F.lit(0))
    made = {
        "fps": ok(six(F.col("fps"))), "total_frames": ok(F.col("total_frames")), "duration_sec": ok(six(F.col("duration"))), "video_duration_str": ok(clock_text(F.col("duration"))),
        "wall_sec": six(F.col("wall_sec")), "wall_duration_str": clock_text(F.col("wall_sec")), "completed_in_min_sec": clock_text(F.col("wall_sec")),
        "models_init_sec": six(F.col("models_init_sec")), "inference_sec": ok(six(F.col("inference_sec"))), "encode_io_sec": ok(six(F.col("encode_io_sec"))),
        "peeing_detected": n > 0, "peeing_event_count": n,
    } | {c: F.when(F.col(c).isNotNull(), six(F.col(c))) for c in SECONDS}
    return rows.select(*[made.get(c, F.col(c)).alias(c) for c in SUMMARY])


def interval_table(intervals: DataFrame, boxes: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per interval of a successful clip, with the boxes (video_id, frame_idx, track_id, box) of its last active frame."""
    last = F.when(F.col("open_interval"), F.col("end_frame")).otherwise(F.col("end_frame") - 1)
    listed = F.array_sort(F.collect_list(F.struct("track_id", "x1", "y1", "x2", "y2")))
    held = boxes.groupBy("video_id", "frame_idx").agg(F.count("*").alias("n"), boxes_json(listed).alias("json"))
    rows = intervals.withColumn("frame_idx", last).join(held, ["video_id", "frame_idx"], "left")
    rows = rows.join(runs.filter("success").select("video_id", "input_path", "output_path"), "video_id")
    took = F.col("end_sec") - F.col("start_sec")
    made = {
        "start_sec": six(F.col("start_sec")), "end_sec": six(F.col("end_sec")), "duration_sec": six(took), "start_time_str": video_time(F.col("start_sec")),
        "end_time_str": video_time(F.col("end_sec")), "duration_str": clock_text(took), "n_confirmed_bboxes": F.coalesce("n", F.lit(0)), "bboxes_json": F.coalesce("json", F.lit("[]")),
    }
    return rows.select(*[made.get(c, F.col(c)).alias(c) for c in INTERVALS])


def manifest_table(runs: DataFrame, times: DataFrame) -> DataFrame:
    """The run manifest: as the summary's first columns, numbers of a failed clip as 0."""
    rows = runs.join(step_sums(times), "video_id", "left")
    zero = lambda c: six(F.coalesce(F.col(c), F.lit(0.0)))
    made = {c: zero(c) for c in ("fps", "wall_sec", "inference_sec", "encode_io_sec", "models_init_sec")} | {"duration_sec": zero("duration")}
    return rows.select(*[made.get(c, F.col(c)).alias(c) for c in MANIFEST])


def evaluation_table(rows: DataFrame) -> DataFrame:
    """Evaluation rows (with wall_sec) under their file's column names; seconds of a run with two decimals."""
    named = {
        "video_path": F.col("path"), "hand_groin_y_threshold": F.col("threshold"), "seconds_required": F.col("seconds"), "should_detect_peeing": F.col("truth"),
        "ground_truth_peeing": F.col("truth"), "predicted_peeing": F.col("predicted"), "peeing_event_count": F.col("events"), "wall_sec": F.bround("wall_sec", 2),
    }
    return rows.select(*[named.get(c, F.col(c)).alias(c) for c in EVALUATION])


def event_log(incidents: DataFrame, vehicles: DataFrame, plates: DataFrame, litter: DataFrame) -> DataFrame:
    """video_id, ts, event_type, box, confidence, extra.

    An incident is an event at its start, without a box; a vehicle is one at its track's first sample, with the track's
    best plate text, if any, as extra; a litter box is one with its label. ``vehicles`` are tracked samples with ts and
    confidence, ``plates`` (video_id, track_id, text), ``litter`` boxes with ts, confidence and label.
    """
    box = ["x1", "y1", "x2", "y2"]
    none = [F.lit(None).cast("double").alias(c) for c in box]
    first = vehicles.groupBy("video_id", "track_id").agg(F.min_by(F.struct("ts", *box), "ts").alias("f"), F.max("confidence").alias("confidence"))
    seen = first.join(plates.select("video_id", "track_id", "text"), ["video_id", "track_id"], "left")
    return (
        incidents.select("video_id", F.col("start_sec").alias("ts"), F.lit("urination").alias("event_type"), *none, F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("extra"))
        .unionByName(seen.select("video_id", "f.ts", F.lit("vehicle").alias("event_type"), *[f"f.{c}" for c in box], "confidence", F.col("text").alias("extra")))
        .unionByName(litter.select("video_id", "ts", F.lit("litter").alias("event_type"), *box, "confidence", F.col("label").alias("extra")))
    )
