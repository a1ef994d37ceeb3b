"""A training corpus from raw documents: STAGES in order, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last
return the columns of documents.

What holds for every stage: other columns than those of documents, also such whose names operators use inside, are left
out; an empty table gives no rows; texts of any length are taken whole; a null doc_id stays null, and rows without a
doc_id, or with one that repeats, are decided each by itself. Stage by stage:

language: a null, empty or letterless text goes; repeated rows have one fate. exact: a null text counts as empty; of
equal texts, null ones too, one row stays. near: a null or blank text is like no other and stays; of rows equal in
doc_id and text one stays. decontamination: a null or empty text holds no passage and stays; repeated rows have one
fate. packing: a null text is the end token alone; repeated rows are packed one by one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxtrail.llm import block_naming, decontamination, language_id, near_dedup, packing
from boxtrail.llm.common import id_of, remainder, scratch, small_batches, table, told_apart
from boxtrail.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document closer than this to no language profile goes; words in a learned language score about 0.5 and more.
LEAST_SCORE = 0.25
NEAR_WORDS, NEAR_PERCENT = 5, 80


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that resemble a language profile; und and far texts go."""
    small_batches(spark)
    profiles = language_id.learn(docs.filter(remainder(5) != 0))
    told = language_id.predict(docs.select(*COLUMNS), profiles)
    return told.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def _kept(docs: DataFrame, decide: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of ``docs`` that ``decide`` keeps (doc_id, kept). It sees an id for each (doc_id, text), so rows without a
    doc_id or with a repeated one are decided each by itself; of rows that repeat both, one stays.
    """
    small_batches(docs.sparkSession)
    rows, _, again = told_apart(docs.select(*COLUMNS).withColumn("id", id_of()))
    ids = decide(rows.select(F.col("id").alias("doc_id"), "text")).filter("kept").select(id_of().alias("id")).distinct()
    kept = rows.join(ids, "id", "left_semi")
    return (kept.dropDuplicates(["id"]) if again else kept).select(*COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest doc_id of equal texts."""
    return _kept(docs, block_naming.exact_dedup)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return _kept(docs, lambda rows: near_dedup.near_duplicates(rows, NEAR_WORDS, NEAR_PERCENT))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without a passage of the benchmark."""
    small_batches(spark)
    found = decontamination.matches(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("hits") == 0).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as pieces of training sequences."""
    small_batches(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each but the last written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {}
