"""Reading clips, manifests and detections, and writing results."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxtrail.functions.text import base_name
from boxtrail.operators.evaluation import parse_manifest
from boxtrail.settings import CLIP_EXTENSIONS

DETECTIONS = T.StructType(
    [T.StructField("video_id", T.LongType()), T.StructField("frame_idx", T.LongType()), T.StructField("ord", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("confidence", T.DoubleType())]
    + [T.StructField(c, T.DoubleType()) for c in ("x1", "y1", "x2", "y2")]
)


def scratch(spark: SparkSession, what: str) -> str:
    """A new path below the folder all executors share; where none is named, one of the machine if that is all there is (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = folder or "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return f"{folder.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def kept(rows: DataFrame, what: str) -> DataFrame:
    """The same rows, written once below the shared folder: what several steps read is worked out once, and a lost executor costs nothing."""
    path = scratch(rows.sparkSession, what)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def scan_clips(spark: SparkSession, root: str, extensions: tuple[str, ...] = CLIP_EXTENSIONS) -> DataFrame:
    """Files below ``root`` with a clip's extension in any case: path, length, modificationTime; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    return files.filter(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*extensions))


def eval_clips(paths: DataFrame) -> DataFrame:
    """Distinct paths of labelled clips: upper-case FN, FP or TP names with one of three extensions."""
    return paths.filter(base_name(F.col("path")).rlike(r"^(FN|FP|TP).*\.(mp4|avi|mov)$")).select("path").distinct()


def ordered_clips(paths: DataFrame) -> DataFrame:
    return paths.orderBy("path")


def numbered_clips(paths: DataFrame) -> DataFrame:
    """(path, place) from 1 on in name order: sorted ranges are written once, numbered within, and moved by the ranges before."""
    spark = paths.sparkSession
    at = scratch(spark, "ordered")
    paths.select("path").repartitionByRange("path").withColumn("part", F.spark_partition_id()).write.parquet(at)
    rows = spark.read.schema("path string, part int").parquet(at)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    sizes = rows.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("path"))
    return rows.withColumn("inside", inside).join(sizes, "part").select("path", (F.col("inside") + F.col("before")).alias("place"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(video, truth) of a CSV with a header, or of several in the order of their names; the last line of a name wins."""
    at = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    return parse_manifest(spark.read.csv(path, header=True).withColumn("line_no", at))


def read_detections(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    reader = spark.read.schema(DETECTIONS)
    return reader.csv(path, header=True) if kind == "csv" else reader.format(kind).load(path)


def append_csv(rows: DataFrame, path: str, run: str | None = None) -> None:
    """Result rows with a header; doubles as text with 6 decimals.

    Rows of a named ``run`` go to a folder of its own and take the place of what an earlier try of that run has left, so a
    job that failed and is repeated leaves its rows once. Other runs' rows stay.
    """
    fixed = [F.format_string("%.6f", c).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes]
    out = rows.select(*fixed)
    if run is None:
        out.write.mode("append").csv(path, header=True)
    else:
        out.withColumn("run", F.lit(run)).write.partitionBy("run").mode("overwrite").option("partitionOverwriteMode", "dynamic").csv(path, header=True)


def read_runs(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows that ``append_csv`` wrote for named runs, with their run."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("run", T.StringType())])).csv(path, header=True)


def overwrite_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)


def discard(rows: DataFrame) -> None:
    """Runs a plan without keeping its rows."""
    rows.write.format("noop").mode("overwrite").save()
