"""Greedy box association, the one step that is order-dependent within a video.

Wherever a tracker must be empty a video splits into segments that are associated apart: where persons
are unseen for longer than max_missed, or at a sampled frame without vehicles. A segment's rows meet in one
partition in frame order and are walked there frame by frame; the state is the boxes of the live tracks, and
it starts anew with the next segment. Track ids are unique within a segment.

A camera that is never quiet is one segment, so long segments are split once more: a box only competes for tracks with
boxes it overlaps enough within the time that a track lives, so the connected components of that graph are walked
apart. Boxes are linked within buckets of frames, each with the frames after it that its tracks can reach; boxes seen
by two buckets tie their pieces together, and only those ties are a graph that Spark has to solve. Tracks then
are those of one walk up to their numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxtrail.operators.components import components
from boxtrail.operators.spread import placed, previous_frame, running_sum
from boxtrail.settings import DEFAULT, Settings
from boxtrail.sources.clips import kept

BOX = ["x1", "y1", "x2", "y2"]
#: Frames from which on a segment is long, and frames of the buckets in which its boxes are linked.
LONG, BUCKET = 1 << 14, 1 << 12


def overlap(a: tuple, b: tuple) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    size = lambda r: max(0.0, r[2] - r[0]) * max(0.0, r[3] - r[1])
    union = size(a) + size(b) - w * h
    return w * h / union if union > 0 else 0.0


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Overlap over union of every box of a with every box of b."""
    x = np.maximum(0.0, np.minimum(a[:, None, 2], b[:, 2]) - np.maximum(a[:, None, 0], b[:, 0]))
    x *= np.maximum(0.0, np.minimum(a[:, None, 3], b[:, 3]) - np.maximum(a[:, None, 1], b[:, 1]))
    size = lambda r: np.maximum(0.0, r[:, 2] - r[:, 0]) * np.maximum(0.0, r[:, 3] - r[:, 1])
    union = size(a)[:, None] + size(b) - x
    return np.divide(x, union, out=np.zeros_like(x), where=union > 0)


def follow(live: np.ndarray, boxes: np.ndarray, least: float) -> list[int]:
    """For each box in order the index of the live track it continues, or len(live) + i for a track that box i begins.

    A box takes the free track that overlaps most, the older one in a tie, if it overlaps by ``least``. A track that
    began in this sample stays free, so a later box of the sample may continue it.
    """
    old, taken = len(live), []
    share = overlaps(boxes, np.concatenate([live, boxes]))
    share[share < max(least, 1e-300)] = 0.0
    free = np.zeros(share.shape[1])
    free[:old] = 1.0
    for i, row in enumerate(share):
        k = int((row * free).argmax())
        if row[k] * free[k] > 0:
            free[k] = 0.0
        else:
            k = old + i
            free[k] = 1.0
        taken.append(k)
    return taken


class Tracks:
    """The live tracks of one segment, oldest first."""

    def __init__(self, number: int = 0, ids=(), boxes=(), frames=()) -> None:
        self.number = number
        self.ids, self.frames = np.array(ids, np.int64), np.array(frames, np.int64)
        self.boxes = np.array(boxes, float).reshape(-1, 4)

    def drop_before(self, frame: float) -> None:
        keep = self.frames >= frame
        if not keep.all():
            self.ids, self.boxes, self.frames = self.ids[keep], self.boxes[keep], self.frames[keep]

    def sample(self, boxes: np.ndarray, frame: int, least: float) -> np.ndarray:
        """Track ids of a sample's boxes, in their order."""
        taken = np.array(follow(self.boxes, boxes, least), np.int64)
        old = len(self.ids)
        begun = np.unique(taken[taken >= old])
        place = np.where(taken >= old, old + np.searchsorted(begun, taken), taken)
        self.ids = np.r_[self.ids, self.number + np.arange(len(begun))]
        self.number += len(begun)
        self.boxes = np.concatenate([self.boxes, np.empty((len(begun), 4))])
        self.frames = np.r_[self.frames, np.full(len(begun), frame)]
        self.boxes[place] = boxes  # the last box of a track counts
        self.frames[place] = frame
        return self.ids[place]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Sorted batches cut so that no group of equal ``keys`` is split, with the rows where groups begin."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        if not t.num_rows:
            continue
        b = t.to_batches()[0]
        new = np.zeros(b.num_rows, bool)
        new[0] = True
        for c in (b.column(k).to_numpy(zero_copy_only=False) for k in keys):
            new[1:] |= c[1:] != c[:-1]
        begins = np.flatnonzero(new)
        held = b.slice(begins[-1])
        if begins[-1]:
            yield b.slice(0, begins[-1]), begins[:-1]
    if held is not None:
        yield held, np.zeros(1, np.int64)


#: Pairs of boxes that are compared at once.
PAIRS = 1 << 21


def _paired(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []  # of the bucket the samples that a later one may follow: frame, ords, boxes
        for batch, begins in whole_groups(batches, ["video_id", "bucket", "frame_idx"]):
            video, bucket, own, frame, stride, ord_ = (batch.column(k).to_numpy() for k in ("video_id", "bucket", "own", "frame_idx", "stride", "ord"))
            boxes = np.stack([batch.column(c).to_numpy() for c in BOX], 1)
            out, size = [], 0
            for a, b in zip(begins.tolist(), [*begins[1:].tolist(), batch.num_rows], strict=True):
                if (now := (video[a], bucket[a])) != key:
                    key, held = now, []
                before = frame[a] - stride[a]
                held = [h for h in held if h[0] >= before]
                if own[a] == bucket[a] and held and held[0][0] == before:
                    _, ords, then = held[0]
                    for at in range(a, b, step := max(1, PAIRS // len(then))):
                        share = overlaps(boxes[at : min(b, at + step)], then)
                        i, j = np.nonzero(share >= max(least, 1e-300))
                        out.append((np.full(len(i), video[a]), np.full(len(i), frame[a]), ords[j], ord_[at + i], share[i, j]))
                        size += len(i)
                        if size >= PAIRS >> 4:
                            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], PAIR)
                            out, size = [], 0
                held.append((frame[a], ord_[a:b], boxes[a:b]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], PAIR)

    return run


PAIR = ["video_id", "frame_idx", "prev_ord", "ord", "iou"]


def overlap_pairs(samples: DataFrame, least: float) -> DataFrame:
    """Boxes of consecutive samples of a video (rows have its stride) that overlap by ``least``: candidates of the same track.

    Rows meet in buckets of frames, in order, with the last samples of the bucket before; two samples are one NumPy matrix, a
    crowded one in pieces.
    """
    own = F.expr(f"frame_idx div {BUCKET}")
    follows = F.expr(f"(frame_idx + stride) div {BUCKET}")
    rows = samples.select("video_id", "frame_idx", F.col("stride").cast("long").alias("stride"), F.col("ord").cast("int").alias("ord"), *BOX)
    rows = rows.withColumns({"own": own, "bucket": F.explode(F.when(follows > own, F.array(own, follows)).otherwise(F.array(own)))})
    met = placed(rows, ["video_id", "bucket"], ["frame_idx", "ord"])
    return met.mapInArrow(_paired(least), "video_id long, frame_idx long, prev_ord int, ord int, iou double")


def _walked(least: float):
    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tracks, last = Tracks(), None
        for batch, begins in whole_groups(batches, ["video_id", "segment", *PART, "frame_idx"]):
            video, segment, pf, po, frame, most = (batch.column(k).to_numpy() for k in ("video_id", "segment", *PART, "frame_idx", "most"))
            boxes = np.stack([batch.column(c).to_numpy() for c in BOX], 1)
            out = np.empty(batch.num_rows, np.int64)
            for a, b in zip(begins.tolist(), [*begins[1:].tolist(), batch.num_rows], strict=True):
                if (now := (video[a], segment[a], pf[a], po[a])) != last:
                    tracks, last = Tracks(), now
                tracks.drop_before(frame[a] - most[a])
                out[a:b] = tracks.sample(boxes[a:b], frame[a], least)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "track_id"])

    return walked


#: The first box, by frame and ord, of the component that a row is walked with.
PART = ["part_frame", "part_ord"]


def _walk(rows: DataFrame, order: list[Column | str], least: float) -> DataFrame:
    key = ["video_id", "segment", *PART]
    met = placed(rows, key, ["frame_idx", *order])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in met.schema.fields)
    return met.mapInArrow(_walked(least), schema + ", track_id long").drop("_place")


def linked(boxes: np.ndarray, frames: np.ndarray, most: np.ndarray, least: float) -> np.ndarray:
    """For each box, in frame order, the first box that it is connected with; boxes are linked if they overlap by ``least`` within ``most`` frames."""
    first = np.arange(len(boxes))

    def root(i: int) -> int:
        while first[i] != i:
            first[i] = i = first[first[i]]
        return i

    starts = np.flatnonzero(np.r_[True, frames[1:] != frames[:-1]])
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(boxes)], strict=True):
        w = int(np.searchsorted(frames, frames[a] - most[a]))
        now, then = np.nonzero(overlaps(boxes[a:b], boxes[w:b]) >= max(least, 1e-300))
        pairs = np.unique(np.stack([now + a, first[then + w]], 1), axis=0)  # many boxes of one track are one link
        for i, j in pairs.tolist():
            i, j = root(i), root(j)
            first[max(i, j)] = min(i, j)
    return np.array([root(i) for i in range(len(boxes))], np.int64)


def _linked(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, begins in whole_groups(batches, ["video_id", "segment", "bucket"]):
            frame, ord_, most = (batch.column(k).to_numpy() for k in ("frame_idx", "ord", "most"))
            boxes = np.stack([batch.column(c).to_numpy() for c in BOX], 1)
            ends = [*begins[1:].tolist(), batch.num_rows]
            root = np.concatenate([a + linked(boxes[a:b], frame[a:b], most[a:b], least) for a, b in zip(begins.tolist(), ends, strict=True)])
            kept = [batch.column(k) for k in ("video_id", "segment", "bucket", "frame_idx", "ord")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(frame[root]), pa.array(ord_[root].astype(np.int64))], ["video_id", "segment", "bucket", "frame_idx", "ord", *PART])

    return run


def _parts(rows: DataFrame, least: float) -> DataFrame:
    """Adds PART to the rows of long segments: boxes of different parts never compete for a track."""
    box = ["video_id", "frame_idx", "ord"]
    own = F.expr(f"frame_idx div {BUCKET}")
    reached = F.when((F.col("frame_idx") % BUCKET <= F.col("most")) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    near = rows.select(*box, "segment", "most", *BOX, F.explode(reached).alias("bucket"))
    group = ["video_id", "segment", "bucket"]
    met = near.repartition(*group).sortWithinPartitions(*group, "frame_idx", "ord")
    told = kept(met.mapInArrow(_linked(least), "video_id long, segment long, bucket long, frame_idx long, ord int, part_frame long, part_ord long"), "linked")
    node = lambda *c: F.struct("video_id", *c)
    part = node(*PART)
    ties = told.groupBy(*box).agg(F.min(part).alias("a"), F.max(part).alias("b")).filter("a <> b").select("a", "b")
    solved = components(ties).select(F.col("node").alias("part"), "root")
    mine = told.filter(F.col("bucket") == own).withColumn("part", part).join(solved, "part", "left")
    mine = mine.select(*box, *[F.coalesce(f"root.{c}", c).alias(c) for c in PART])
    return rows.join(mine, box)


def _numbered(walked: DataFrame) -> DataFrame:
    """Track ids of parts made unique within their video: each part's come after those of the parts that began before."""
    part = ["video_id", *PART]
    counts = walked.groupBy(*part).agg((F.max("track_id") + 1).alias("_n"))
    frames = counts.groupBy("video_id", F.col("part_frame").alias("frame_idx")).agg(F.sum("_n").alias("_all"))
    before = running_sum(frames, F.col("_all"), "_upto").select("video_id", F.col("frame_idx").alias("part_frame"), (F.col("_upto") - F.col("_all")).alias("_before"))
    inside = Window.partitionBy("video_id", "part_frame").orderBy("part_ord").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(before, ["video_id", "part_frame"])
    return walked.join(shift.select(*part, (F.col("_inside") + F.col("_before")).alias("_shift")), part).withColumn("track_id", F.col("track_id") + F.col("_shift")).drop("_shift")


def _associate(boxes: DataFrame, rows: DataFrame, order: list[Column | str], least: float) -> DataFrame:
    """``rows`` are the ``boxes`` with their segment."""
    none = {c: F.lit(-1).cast("long") for c in PART}
    if boxes.filter(F.col("frame_idx") >= LONG).isEmpty():  # so no segment is long, which is told before segments are worked out
        return _walk(rows.withColumns(none), order, least).drop("most", *PART)
    rows = kept(rows, "boxes")
    length = F.max("frame_idx") - F.min("frame_idx")
    long = rows.groupBy("video_id", "segment").agg((length >= LONG).alias("_long")).filter("_long").select("video_id", "segment")
    short = _walk(rows.join(long, ["video_id", "segment"], "left_anti").withColumns(none), order, least)
    parts = _parts(rows.join(long, ["video_id", "segment"], "left_semi"), least)
    return short.unionByName(_numbered(kept(_walk(parts, order, least), "walked"))).drop("most", *PART)


def _segments(rows: DataFrame) -> DataFrame:
    """Adds segment: it grows where consecutive frames of a video are more than ``most`` apart, a column of its rate."""
    # frames are far fewer than their rows and read several times
    frames = previous_frame(kept(rows.select("video_id", "frame_idx", "most").distinct(), "frames"), "_before")
    gap = F.coalesce(F.col("frame_idx") - F.col("_before") > F.col("most"), F.lit(False))
    told = running_sum(frames, gap.cast("int"), "segment").drop("_before", "most")
    return rows.join(told.hint("merge"), ["video_id", "frame_idx"])  # few bytes as a file, many in a hash table


def person_segments(persons: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Adds most (frames of max_missed at the clip's rate) and segment: it grows where consecutive samples are further apart."""
    return _segments(persons.withColumn("most", s.max_missed * F.col("fps")))


def associate_persons(persons: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Person rows (video_id, frame_idx, fps, ord, confidence, box) with segment and track_id."""
    rows = person_segments(persons, s).select("video_id", "segment", "frame_idx", "fps", "most", "ord", "confidence", *BOX)
    return _associate(persons, rows, [F.desc("confidence"), "ord"], s.person_iou)


def vehicle_segments(vehicles: DataFrame) -> DataFrame:
    """Adds most (the clip's stride) and segment: it grows after a sampled frame without vehicles."""
    return _segments(vehicles.withColumn("most", F.col("stride").cast("double")))


def associate_vehicles(vehicles: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Vehicle rows (video_id, frame_idx, stride, ord, box) with segment and track_id; a track not seen in a sample is gone."""
    rows = vehicle_segments(vehicles).select("video_id", "segment", "frame_idx", "most", "ord", *BOX)
    return _associate(vehicles, rows, ["ord"], s.vehicle_iou)
