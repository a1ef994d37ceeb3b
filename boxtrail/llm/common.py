"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space bytes that the contracts name.
SPACE = r"[\x20\x09-\x0D]+"
#: Stands in for a null id inside an operator, so that joins and minima work; it sorts after every other id.
NULL_ID = 2**63 - 1


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach. Where none is named, one of the machine if that is all there is (tests), else it fails."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, what: str) -> str:
    """A new path for a written table below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(frame: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, kept in the shared folder so that a lost executor costs nothing."""
    spark = frame.sparkSession
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return frame.checkpoint(eager=True)


#: Bytes of an Arrow batch: each task holds some batches in the JVM and as many in Python, in bytes and not in rows.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From here on rows go to Python in batches of at most BATCH_BYTES, or one row if that is longer; a smaller limit of the session stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(-?\d+)\s*([kmgtp]?)b?", spark.conf.get(name).strip().lower())
    had = int(now[1]) << 10 * " kmgtp".index(now[2] or " ") if now else 0
    if not 0 < had <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_of(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def shown_id(name: str) -> Column:
    """Back from NULL_ID to null."""
    return F.when(F.col(name) != NULL_ID, F.col(name))


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def told_apart(rows: DataFrame) -> tuple[DataFrame, DataFrame | None, bool]:
    """Rows (id, text, others) with ids that stand for one text each, (id, shown) where ids had to be replaced, and
    whether any id occurs more than once. New ids, with gaps, keep the order of the old ones, and of one id's texts by their hashes.
    """
    marks = rows.select("id", F.xxhash64("text").alias("mark"))
    often = marks.groupBy("id").agg(F.count("*").alias("n"), F.min("mark").alias("x"), F.max("mark").alias("y")).filter("n > 1")
    n, apart = often.agg(F.count("*"), F.max(F.col("x") != F.col("y"))).first()
    if not apart:
        return rows, None, n > 0
    pairs = cut(marks.distinct().orderBy("id", "mark").withColumn("new", F.monotonically_increasing_id()))  # ranges in order, so numbers rise
    told = rows.withColumn("mark", F.xxhash64("text")).join(pairs, ["id", "mark"]).select(F.col("new").alias("id"), *(c for c in rows.columns if c != "id"))
    return told, pairs.select(F.col("new").alias("id"), F.col("id").alias("shown")), True


def remainder(modulus: int, name: str = "doc_id") -> Column:
    """crc32 of an id's text modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % modulus
