"""Pluggable models over rows, and the sharpness of crops, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxtrail.operators.spread import placed
from boxtrail.operators.tracking import whole_groups
from boxtrail.settings import DEFAULT


def score_batches(rows: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.Series]], column: str) -> DataFrame:
    """Adds ``column`` ("name type") from a model that ``load`` makes once per task; it gets batches and gives a value per row."""
    name = column.split(" ")[0]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), column])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            yield pdf.assign(**{name: model(pdf)})

    return rows.mapInPandas(run, schema)


def _exploded(pdf: pd.DataFrame, lists: list, names: list[str]) -> pd.DataFrame:
    """The inputs with each entry of their lists, in order, and its place ``ord``."""
    if len(lists) != len(pdf):
        raise ValueError(f"a model gave {len(lists)} lists for {len(pdf)} inputs")
    sizes = [len(x) for x in lists]
    out = pdf.iloc[np.repeat(np.arange(len(pdf)), sizes)].reset_index(drop=True)
    out["ord"] = np.concatenate([np.arange(n) for n in sizes] or [[]]).astype("int32")
    values = list(zip(*(row for x in lists for row in x), strict=True)) or [()] * len(names)
    for name, column in zip(names, values, strict=True):
        out[name] = list(column) if column else pd.Series(dtype=object)  # an empty list would be floats, which Arrow turns into text in chunks
    return out


def _with(rows: DataFrame, more: str, drop: tuple[str, ...] = ()) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name not in drop), "ord int", more])


def detect_batches(rows: DataFrame, load: Callable[[], Callable[[pd.DataFrame], list]], fields: str) -> DataFrame:
    """A row for each result of a model that gives a list for every input: boxes of a frame, plates or texts of a crop.

    ``load`` makes the model once per task. It gets batches of rows and gives, in their order, a list of tuples
    (``fields``, "name type, ...") for each; another number of lists fails. Results carry their input's columns and their
    place ``ord``; an input with an empty list has no row.
    """
    names = [f.strip().split(" ")[0] for f in fields.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            yield _exploded(pdf, model(pdf), names)

    return rows.mapInPandas(run, _with(rows, fields))


BOXES = "label string, confidence double, x1 double, y1 double, x2 double, y2 double"


def callback_boxes(frames: DataFrame, callback: Callable, batched: bool = False, window: int = DEFAULT.batch) -> DataFrame:
    """Boxes that a user's callback sees in sampled frames (video_id, frame_idx, fps, stride, image): detections with ord.

    ``callback(frame_idx, image, ts)`` gives a list of (label, confidence, box) for one frame. A batched one gets
    a list of such triples, all sampled frames of a video's read window of ``window`` samples in order, and gives as many
    lists. A window's frames meet in one partition and are never split over calls. Frames without boxes have no row.
    """
    def items(batch: pa.RecordBatch) -> list[tuple]:
        frame, fps = (batch.column(c).to_numpy() for c in ("frame_idx", "fps"))
        return list(zip(frame.tolist(), batch.column("image").to_pandas(), (frame / fps).tolist(), strict=True))

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _boxed(batch, [callback(*item) for item in items(batch)], ["image"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, begins in whole_groups(batches, ["video_id", "_window"]):
            rows, seen = items(batch), []
            for a, b in zip(begins.tolist(), [*begins[1:].tolist(), batch.num_rows], strict=True):
                lists = callback(rows[a:b])
                if len(lists) != b - a:
                    raise ValueError(f"a model gave {len(lists)} lists for {b - a} inputs")
                seen.extend(lists)
            yield _boxed(batch, seen, ["image", "_window", "_place"])

    if not batched:
        return frames.mapInArrow(single, _with(frames, BOXES, ("image",)))
    rows = frames.withColumn("_window", F.expr(f"frame_idx div (stride * {window})"))
    met = placed(rows, ["video_id", "_window"], ["frame_idx"])
    return met.mapInArrow(windows, _with(rows, BOXES, ("image", "_window")))


def _boxed(batch: pa.RecordBatch, lists: list, drop: list[str]) -> pa.RecordBatch:
    """A row for each (label, confidence, box) of the lists, one for each row of the batch, with its place ``ord``; Arrow columns throughout."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    seen = [x for row in lists for x in row]
    boxes = np.array([x[2] for x in seen], float) if seen else np.empty((0, 4))
    if boxes.ndim != 2 or boxes.shape[1] != 4:
        raise ValueError("a box must have 4 numbers")
    of = batch.drop_columns(drop).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
    ord_ = (np.arange(len(seen)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
    more = [pa.array(ord_), pa.array([x[0] for x in seen], pa.string()), pa.array([x[1] for x in seen], pa.float64()), *(pa.array(c) for c in boxes.T.copy())]
    names = ["ord", *(f.split(" ")[0] for f in BOXES.split(", "))]
    return pa.RecordBatch.from_arrays([*of.columns, *more], [*of.schema.names, *names])


def laplacian_variance(gray: np.ndarray) -> float:
    """Variance of the 4-neighbour Laplacian; borders mirror without repeating the edge."""
    p = np.pad(gray, 1, mode="reflect") if min(gray.shape) > 1 else np.pad(gray, 1, mode="edge")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * gray).var())


def sharp_crops(crops: DataFrame, least_side: int = DEFAULT.min_side, least: float = DEFAULT.min_sharpness) -> DataFrame:
    """Crops (width, height, gray: row-major pixels) that are large and sharp enough; ``least`` <= 0 turns the second test off."""
    large = crops.filter(F.least("width", "height") >= least_side)
    if least <= 0:
        return large

    @F.pandas_udf("double")
    def variance(gray: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
        return pd.Series([laplacian_variance(np.asarray(g, float).reshape(h, w)) for g, w, h in zip(gray, width, height, strict=True)])

    return large.filter(variance("gray", "width", "height") >= least)
