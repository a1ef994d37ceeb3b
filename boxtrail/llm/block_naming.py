"""Exact deduplication by deterministic block naming.

A text is cut into blocks of a fixed number of bytes. Distinct blocks are sorted and
numbered, so a block's number is a collision-free name; then names of adjacent pairs are
sorted and numbered again, and again, until one name is left for each document. Equal
(level, name) means equal text, since every name stands for exactly one string.

The text itself is shuffled once (a block goes out once per task that holds it); all later
rounds move integers. Pairs are first made distinct with map-side combining and the names
joined back, so one block or pair that a third of all rows share costs a row for each task,
and the joins can be split by adaptive execution.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxtrail.llm.common import SPACE, cut, id_of, shown_id, text_of

BLOCK_BYTES = 4096
#: Names are numbered within so many sorted buckets, so that no task sorts everything.
BUCKETS = 1 << 14
#: A task remembers so many blocks to send each once; forgetting one only sends it again.
REMEMBERED = 4096


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks that this task has not sent yet."""
    sent: dict[bytes, None] = {}
    for batch in batches:
        keep = []
        for row, block in enumerate(batch.column(1).to_pylist()):
            if block not in sent:
                sent[block] = None
                keep.append(row)
                if len(sent) > REMEMBERED:
                    sent.pop(next(iter(sent)))
        yield batch.take(pa.array(keep, pa.int64()))


def _numbered(frame: DataFrame, spread: F.Column, order: list[str]) -> DataFrame:
    """Distinct integer names by sorted order within hashed buckets."""
    w = Window.partitionBy("bucket").orderBy(*order)
    return frame.withColumn("bucket", F.pmod(spread, F.lit(BUCKETS))).withColumn(
        "name", F.dense_rank().over(w).cast("long") * BUCKETS + F.col("bucket")
    )


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(texts, names): texts has id, fp, sha, one row per input row; names has id, fp, level, name.

    fp tells rows apart that repeat an id with another text.
    """
    normal = docs.select(id_of().alias("id"), F.regexp_replace(text_of(), SPACE, " ").alias("norm"))
    cutter = lambda i: F.substring(F.col("bytes"), i * block_bytes + 1, F.lit(block_bytes))
    split = (
        normal.withColumn("bytes", F.encode("norm", "UTF-8"))
        .withColumn("last", F.greatest(F.lit(0), F.ceil(F.octet_length("norm") / block_bytes) - 1).cast("int"))
        .withColumn("blocks", F.transform(F.sequence(F.lit(0), F.col("last")), cutter))
    )
    texts = cut(
        split.select(
            "id",
            F.xxhash64("norm").alias("fp"),
            F.sha2("norm", 256).alias("sha"),
            F.transform("blocks", lambda b: F.xxhash64(b)).alias("marks"),
        )
    )
    spots = texts.select("id", "fp", F.posexplode("marks").alias("pos", "mark"))

    # One sort names all blocks. A mark (64-bit hash) only finds a block's name again; two blocks with
    # one mark are told apart by content below.
    blocks = (
        split.select("bytes", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("i"))  # bytes are made once a text
        .select(F.substring(F.col("bytes"), F.col("i") * block_bytes + 1, F.lit(block_bytes)).alias("block"))
        .select(F.xxhash64("block").alias("mark"), "block")
        .mapInArrow(_once, "mark long, block binary")
    )
    w = Window.partitionBy("bucket").orderBy("mark", "block")
    named = (
        _numbered(blocks, F.col("mark"), ["mark", "block"])
        .withColumn("again", F.lag("name").over(w).eqNullSafe(F.col("name")))
        .filter(~F.col("again"))
        .withColumn("clash", (F.lag("mark").over(w) == F.col("mark")) | (F.lead("mark").over(w) == F.col("mark")))
        .select("mark", "name", F.when(F.col("clash"), F.col("block")).alias("block"))
    )
    named = cut(named)
    names = spots.join(named.filter("block is null").select("mark", "name"), "mark").select("id", "fp", "pos", "name")
    clashing = named.filter("block is not null")
    if not clashing.isEmpty():  # exact also when two blocks share a 64-bit hash
        again = split.select("id", F.xxhash64("norm").alias("fp"), F.posexplode("blocks").alias("pos", "block"))
        names = names.unionByName(
            again.withColumn("mark", F.xxhash64("block")).join(clashing, ["mark", "block"]).select("id", "fp", "pos", "name")
        )

    last = texts.agg(F.max(F.size("marks"))).first()[0] or 1
    names = cut(names) if last > 1 else names
    single = texts.filter(F.size("marks") == 1).select("id", "fp").distinct()
    done = names.join(single, ["id", "fp"], "left_semi") if last > 1 else names
    done = done.select("id", "fp", F.lit(0).alias("level"), "name").distinct()
    level, width = 0, 1
    rest = names.join(single, ["id", "fp"], "left_anti")
    while width < last:
        level, width = level + 1, width * 2
        pairs = rest.groupBy("id", "fp", F.expr("pos div 2").cast("int").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
        )
        pairs = cut(pairs)
        ranks = _numbered(pairs.select("a", "b").distinct(), F.xxhash64("a", "b"), ["a", "b"]).select("a", "b", "name")
        rest = cut(pairs.join(ranks, ["a", "b"]).select("id", "fp", "pos", "name"))
        tops = rest.groupBy("id", "fp").agg(F.max("pos").alias("top"), F.max("name").alias("name"))
        done = done.unionByName(tops.filter("top = 0").select("id", "fp", F.lit(level).alias("level"), "name"))
        rest = rest.join(tops.filter("top > 0").select("id", "fp"), ["id", "fp"], "left_semi")
    return texts.select("id", "fp", "sha"), done


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs`` (doc_id, text; other columns are ignored).

    Texts are equal when identical after each run of ASCII white space became one space; a null
    text counts as empty, and empty texts equal each other. The smallest doc_id of a group stays;
    a null doc_id sorts last and is returned as null. Rows that repeat a doc_id count one each in
    group_size, and all rows of the smallest doc_id are kept. An empty table gives no rows.
    """
    texts, names = identities(docs, block_bytes)
    named = cut(texts.join(names, ["id", "fp"]).select("id", "sha", "level", "name"))
    groups = named.groupBy("level", "name").agg(F.min("id").alias("keep"), F.count("*").alias("group_size"))
    return named.join(groups, ["level", "name"]).select(
        shown_id("id").alias("doc_id"),
        shown_id("keep").alias("keep_id"),
        "group_size",
        (F.col("id") == F.col("keep")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


ORACLE = """
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""
