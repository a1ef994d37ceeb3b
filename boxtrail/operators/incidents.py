"""The time rule on tracked person samples: stillness, counted hits, good seconds, streaks, incidents.

Input rows are samples (video_id, track_id, frame_idx, fps, box, hit), each with the rate of its clip. Everything is a window
over one track, so a clip's tracks spread over tasks; nothing is ordered across tracks until incidents are
merged per video.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from boxtrail.functions import geometry as g
from boxtrail.settings import DEFAULT, Settings

TRACK = ["video_id", "track_id"]


def _by_frame():
    return Window.partitionBy(*TRACK).orderBy("frame_idx")


def _second() -> Column:
    return F.floor(F.col("frame_idx") / F.col("fps") + 1e-9)


def box_motion(samples: DataFrame, s: Settings = DEFAULT, by: WindowSpec | None = None) -> DataFrame:
    """Adds first and moved: a sample moved when it is not the first and fails the stillness test against the one before.

    Here and below ``by`` is a track's order, where the rows already lie in one that comes to the same as that of frames.
    """
    before = {f"b_{c}": F.lag(c).over(by or _by_frame()) for c in g.Box._fields}
    rows = samples.withColumns(before).withColumn("first", F.col("b_x1").isNull())
    still = g.is_still(g.box("b_"), g.box(), s.still_iou, s.still_motion, s.still_size)
    return rows.withColumn("moved", ~F.col("first") & ~F.coalesce(still, F.lit(False))).drop(*before)


def still_time(moved: DataFrame, s: Settings = DEFAULT, by: WindowSpec | None = None) -> DataFrame:
    """Adds run, still_frames and ready: a run starts at a first or moved sample and is ready after still_seconds."""
    breaks = (F.col("first") | F.col("moved")).cast("int")
    rows = moved.withColumn("run", F.sum(breaks).over(by or _by_frame()))
    start = F.max(F.when(F.col("first") | F.col("moved"), F.col("frame_idx"))).over(by or _by_frame())
    rows = rows.withColumn("still_frames", F.col("frame_idx") - start)
    return rows.withColumn("ready", (breaks == 0) & (F.col("still_frames") >= s.still_seconds * F.col("fps")))


def gated_hits(ready: DataFrame, by: WindowSpec | None = None) -> DataFrame:
    """Adds sec (where ``by`` is given the rows have it), counted (a hit of a ready sample), next_frame and next_moved of the track."""
    rows = ready if by else ready.withColumn("sec", _second())
    by = by or _by_frame()
    return rows.withColumn("counted", F.col("hit") & F.col("ready")).withColumns({"next_frame": F.lead("frame_idx").over(by), "next_moved": F.lead("moved").over(by)})


def hits_per_second(hits: DataFrame, count: Column | None = None, of_track: tuple[str, ...] = ()) -> DataFrame:
    """Per track and second: samples, hits of the last run in it, any motion, and what the next sample does.

    ``count`` is what hits aggregates, by default the counted samples; ``of_track`` are columns to keep that a track has one value of.
    """
    by_run = hits.groupBy(*TRACK, *of_track, "sec", "run").agg(
        F.count("*").alias("n"),
        (F.count_if("counted") if count is None else count).alias("hits"),
        F.max(F.col("moved").cast("int")).alias("m"),
        F.max(F.struct("frame_idx", "next_frame", "next_moved")).alias("last"),
    )
    return by_run.groupBy(*TRACK, *of_track, "sec").agg(
        F.sum("n").alias("samples"),
        F.max_by("hits", "run").alias("hits"),
        (F.max("m") == 1).alias("has_motion"),
        F.max_by("last", "run")["next_frame"].alias("next_frame"),
        F.coalesce(F.max_by("last", "run")["next_moved"], F.lit(False)).alias("next_moved"),
    )


def is_good(s: Settings = DEFAULT) -> Column:
    """A second counts when it has the hits and is closed by a later sample that did not move."""
    return (F.col("hits") >= s.hits_per_second) & F.col("next_frame").isNotNull() & ~F.col("next_moved")


def good_seconds(per_second: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    return per_second.filter(is_good(s))


def good_streak(per_second: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Good seconds with the length of their streak so far; a gap, a bad second or motion in a second starts over."""
    by_sec = Window.partitionBy(*TRACK).orderBy("sec")
    good = good_seconds(per_second, s)
    breaks = F.lag("sec").over(by_sec).isNull() | (F.lag("sec").over(by_sec) != F.col("sec") - 1) | F.col("has_motion")
    rows = good.withColumn("island", F.sum(breaks.cast("int")).over(by_sec))
    return rows.withColumn("streak", F.row_number().over(Window.partitionBy(*TRACK, "island").orderBy("sec")))


def confirm_latch(streaks: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Per confirmed track the frame that confirms it: the first sample after the second that fills the streak."""
    return streaks.filter(F.col("streak") >= s.seconds_required).groupBy(*TRACK).agg(F.min("next_frame").alias("confirm_frame"))


def with_expiry(samples: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Adds expiry_frame to a track's samples: the first frame more than max_missed seconds after its last sample."""
    last = F.max(F.col("frame_idx") + s.max_missed * F.col("fps")).over(Window.partitionBy(*TRACK))
    return samples.withColumn("expiry_frame", F.floor(last).cast("long") + 1)


def track_expiry(samples: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Per track the first frame more than max_missed seconds after its last sample."""
    ends = F.floor(F.max(F.col("frame_idx") + s.max_missed * F.col("fps"))).cast("long") + 1
    return samples.groupBy(*TRACK).agg(F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"), ends.alias("expiry_frame"))


def active_ranges(confirmed: DataFrame, expiry: DataFrame) -> DataFrame:
    return confirmed.join(expiry, TRACK).select(*TRACK, "confirm_frame", "last_frame", "expiry_frame")


def merged_ranges(ranges: DataFrame) -> DataFrame:
    """Per video the merged [confirm, expiry) ranges, touching ones joined: video_id, event (from 1), start_frame, stop."""
    by = Window.partitionBy("video_id").orderBy("confirm_frame", "expiry_frame", "track_id")
    reach = F.max("expiry_frame").over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = ranges.withColumn("new", (reach.isNull() | (F.col("confirm_frame") > reach)).cast("int"))
    return rows.withColumn("event", F.sum("new").over(by)).groupBy("video_id", "event").agg(
        F.min("confirm_frame").alias("start_frame"), F.max("expiry_frame").alias("stop")
    )


def incident_intervals(ranges: DataFrame, clips: DataFrame) -> DataFrame:
    """Merged ranges as intervals; open at the end of the clip.

    end_frame is the first inactive frame, or the clip's last frame when it ends first.
    """
    out = merged_ranges(ranges).join(clips.select("video_id", "fps", "total_frames"), "video_id")
    is_open = F.col("stop") >= F.col("total_frames")
    end = F.when(is_open, F.col("total_frames") - 1).otherwise(F.col("stop"))
    return out.select(
        "video_id",
        (F.col("event") - 1).alias("event_index"),
        "start_frame",
        end.alias("end_frame"),
        (F.col("start_frame") / F.col("fps")).alias("start_sec"),
        (end / F.col("fps")).alias("end_sec"),
        is_open.alias("open_interval"),
    )


#: Frames that a range join compares at once: both sides carry the frame's span as a join key.
SPAN = 1024


def in_ranges(frames: DataFrame, ranges: DataFrame, begin: str, end: str, how: str = "inner") -> DataFrame:
    """frames joined with the ranges [begin, end) of their video that hold them, by video and span of frames first."""
    rows = ranges.filter(F.col(begin) < F.col(end)).withColumnRenamed("video_id", "_video")
    rows = rows.withColumn("_span", F.explode(F.sequence(F.expr(f"`{begin}` div {SPAN}"), F.expr(f"(`{end}` - 1) div {SPAN}"))))
    at = frames.withColumn("_at", F.expr(f"frame_idx div {SPAN}"))
    on = (F.col("video_id") == F.col("_video")) & (F.col("_at") == F.col("_span")) & (F.col("frame_idx") >= F.col(begin)) & (F.col("frame_idx") < F.col(end))
    return at.join(rows, on, how).drop("_span", "_at")


def frame_active(frames: DataFrame, ranges: DataFrame) -> DataFrame:
    """frames with active: whether any confirmed track is alive. Ranges are merged first, so a frame meets one at most."""
    joined = in_ranges(frames.select("video_id", "frame_idx"), merged_ranges(ranges), "start_frame", "stop", "left")
    return joined.select("video_id", "frame_idx", F.col("_video").isNotNull().alias("active"))


def edges(active: DataFrame) -> DataFrame:
    """Enter and exit flags of a video's frames; each frame meets the one before by number, so a video needs no single task."""
    before = active.select("video_id", (F.col("frame_idx") + 1).alias("frame_idx"), F.col("active").alias("_before"))
    rows = active.join(before, ["video_id", "frame_idx"], "left").withColumn("_before", F.coalesce("_before", F.lit(False)))
    return rows.withColumn("enter", F.col("active") & ~F.col("_before")).withColumn("exit", ~F.col("active") & F.col("_before")).drop("_before")


def held_boxes(samples: DataFrame, ranges: DataFrame) -> DataFrame:
    """Boxes of confirmed tracks with the frames [from, to) on which they are the last ones of their track while it is active."""
    last = samples.select(*TRACK, "frame_idx", *g.Box._fields).join(ranges, TRACK).withColumn("until", F.lead("frame_idx").over(_by_frame()))
    rows = last.select(
        *TRACK, F.greatest("frame_idx", "confirm_frame").alias("from"), F.least(F.coalesce("until", "expiry_frame"), "expiry_frame").alias("to"), *g.Box._fields
    )
    return rows.filter(F.col("from") < F.col("to"))


def marked_frames(samples: DataFrame, clips: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """The box of every confirmed track on every frame of its clip while it is active, from the boxes alone. The samples are passed once."""
    rows = with_expiry(sample_state(samples, s), s).filter("confirm_frame is not null")
    upto = F.least(F.coalesce("next_frame", "expiry_frame"), "expiry_frame")
    held = rows.select(*TRACK, F.greatest("frame_idx", "confirm_frame").alias("from"), upto.alias("to"), *g.Box._fields).filter(F.col("from") < F.col("to"))
    held = held.join(clips.select("video_id", "total_frames"), "video_id").filter(F.col("from") < F.col("total_frames"))
    at = F.explode(F.sequence("from", F.least("to", "total_frames") - 1))
    return held.select("video_id", at.alias("frame_idx"), "track_id", *g.Box._fields)


def marked_boxes(frames: DataFrame, samples: DataFrame, ranges: DataFrame) -> DataFrame:
    """The box of every confirmed track on those of ``frames`` in which it is active: that of its last sample by then."""
    held = held_boxes(samples, ranges)
    return in_ranges(frames.select("video_id", "frame_idx"), held, "from", "to").select("video_id", "frame_idx", "track_id", *g.Box._fields)


def sample_state(samples: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Per sample: good_seconds so far (of the streak that reaches the second before), confirm_frame of its track, confirmed, suspected.

    A streak shows from the sample after its second on, and is gone when the second before is not in it. The samples are
    passed once: all windows go by track in the order of seconds and frames, so one sort serves them, and what is known by
    second or by track stands on each sample.
    """
    track = Window.partitionBy(*TRACK)
    by_frame = track.orderBy("sec", "frame_idx")
    second = Window.partitionBy(*TRACK, "sec").orderBy("frame_idx")
    whole = second.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    so_far = by_frame.rowsBetween(Window.unboundedPreceding, 0)
    rows = samples.withColumn("sec", _second())
    hits = gated_hits(still_time(box_motion(rows, s, by_frame), s, by_frame), by_frame)
    of_second = {
        "last_run": F.last("run").over(whole), "has_motion": F.max("moved").over(whole), "then": F.last("next_frame").over(whole),
        "then_moved": F.coalesce(F.last("next_moved").over(whole), F.lit(False)), "moved_yet": F.max("moved").over(second.rowsBetween(Window.unboundedPreceding, 0)),
    }
    rows = hits.withColumns(of_second).withColumn("hits", F.count_if(F.col("counted") & (F.col("run") == F.col("last_run"))).over(whole))
    rows = rows.withColumn("good", (F.col("hits") >= s.hits_per_second) & F.col("then").isNotNull() & ~F.col("then_moved"))
    rows = rows.withColumns({"p_sec": F.lag("sec").over(by_frame), "p_good": F.lag("good").over(by_frame)})
    apart = F.col("p_sec").isNull() | (F.col("p_sec") < F.col("sec") - 1) | ~F.col("p_good") | F.col("has_motion")
    begins = F.col("good") & (F.col("p_sec").isNull() | (F.col("p_sec") < F.col("sec"))) & apart
    rows = rows.withColumn("began", F.max(F.when(begins, F.col("sec"))).over(so_far))
    rows = rows.withColumn("streak", F.when(F.col("good"), F.col("sec") - F.col("began") + 1))
    before = F.coalesce(F.max("streak").over(track.orderBy("sec").rangeBetween(-1, -1)), F.lit(0)).cast("int")
    rows = rows.withColumn("before", before).withColumn("confirm_frame", F.min(F.when(F.col("streak") >= s.seconds_required, F.col("then"))).over(track))
    rows = rows.withColumn("good_seconds", F.when(F.col("moved_yet"), 0).otherwise(F.col("before")))
    rows = rows.withColumn("confirmed", F.coalesce(F.col("frame_idx") >= F.col("confirm_frame"), F.lit(False)))
    rows = rows.withColumn("suspected", ~F.col("confirmed") & F.col("ready") & (F.col("good_seconds") > 0))
    return rows.drop("last_run", "has_motion", "then", "then_moved", "moved_yet", "hits", "good", "p_sec", "p_good", "began", "streak", "before")


def progress_score(state: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Per sampled frame the largest share of a full streak over its tracks, 1 when one is confirmed."""
    share = F.when(F.col("confirmed"), 1.0).otherwise(F.least(F.lit(1.0), F.col("good_seconds") / s.seconds_required))
    return state.groupBy("video_id", "frame_idx").agg(F.max(share).alias("score"))


def time_rule(samples: DataFrame, s: Settings = DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hits, streaks, ranges) of samples."""
    hits = gated_hits(still_time(box_motion(samples, s), s))
    streaks = good_streak(hits_per_second(hits), s)
    return hits, streaks, active_ranges(confirm_latch(streaks, s), track_expiry(samples, s))


def count_reasons(seen: DataFrame, gated: DataFrame, hits: DataFrame, width: int, height: int, s: Settings = DEFAULT, cap: int | None = None) -> DataFrame:
    """Per video why persons and hits did not count.

    ``seen`` are person rows, ``gated`` those who sit on no motorcycle, ``hits`` their samples after gated_hits.
    rider: seen and not gated; over_cap: gated beyond the ``cap`` most confident of a frame; small_crop: crops that are
    empty after clamping; motion_resets, not_still, hits_ignored (no stillness yet), hits_before_motion.
    """
    n = lambda rows, name: rows.groupBy("video_id").agg(F.count("*").alias(name))
    over = F.greatest(F.count("*") - F.lit(cap if cap else 1 << 62), F.lit(0))
    capped = gated.groupBy("video_id", "frame_idx").agg(over.alias("over")).groupBy("video_id").agg(F.sum("over").alias("over_cap"))
    crop = g.padded_crop(g.box(), F.lit(width), F.lit(height), s.crop_margin)
    small = gated.groupBy("video_id").agg(F.count_if(~g.not_empty(crop)).alias("small_crop"))
    reset = hits.groupBy("video_id").agg(
        F.count_if("moved").alias("motion_resets"),
        F.count_if(~F.col("ready")).alias("not_still"),
        F.count_if(F.col("hit") & ~F.col("ready")).alias("hits_ignored"),
        F.count_if(F.col("counted") & F.col("next_moved")).alias("hits_before_motion"),
    )
    out = n(seen, "_seen").join(n(gated, "_gated"), "video_id", "left").join(capped, "video_id", "left").join(small, "video_id", "left").join(reset, "video_id", "left")
    names = ("over_cap", "small_crop", "motion_resets", "not_still", "hits_ignored", "hits_before_motion")
    return out.select("video_id", (F.col("_seen") - F.coalesce("_gated", F.lit(0))).alias("rider"), *[F.coalesce(c, F.lit(0)).alias(c) for c in names])
