"""Deduplication of lines: those that many documents share stay in one of them only.

Every line's key is hashed to 128 bits in the scan. Distinct keys of a document are counted over documents with map-side
combining; the keys over the threshold, with the document that keeps them, are a table of their own. Hashes with their
positions join that table, which adaptive execution can split where a third of all documents hold one line, and the
positions that fall out meet their document again, where the other lines are put together by position.
A text travels once, in that last join; before it only hashes do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxtrail.llm.common import cut, id_of, scratch, shown_id, text_of

#: The six ASCII white-space characters, and letters that are lower-cased.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_DOCS = 20, 3


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def key_of(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def keyed(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """id, mark and keys (pos, a, b) of every row: 128-bit hashes of its lines' keys that are long enough."""
    rows = docs.select(id_of().alias("id"), text_of().alias("text"))
    lines = F.transform(lines_of(F.col("text")), lambda line, i: F.struct(i.alias("pos"), key_of(line).alias("key")))
    long = F.filter(lines, lambda x: F.length(x["key"]) >= least_length)
    keys = F.transform(long, lambda x: F.struct(x["pos"].alias("pos"), F.xxhash64(x["key"]).alias("a"), F.xxhash64(F.lit(1), x["key"]).alias("b")))
    return rows.select("id", F.xxhash64("text").alias("mark"), keys.alias("keys"))


def common_keys(rows: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """a, b and keep of the keys of ``keyed`` rows that at least ``least_docs`` documents hold; keep is the largest id of them."""
    held = rows.select("id", F.explode(F.array_distinct(F.transform("keys", lambda k: F.struct(k["a"].alias("a"), k["b"].alias("b"))))).alias("k")).select("id", "k.a", "k.b")
    if not rows.groupBy("id").count().filter("count > 1").isEmpty():
        held = held.distinct()  # rows of one document count once together
    return held.groupBy("a", "b").agg(F.count("*").alias("docs"), F.max("id").alias("keep")).filter(F.col("docs") >= least_docs).select("a", "b", "keep")


def drop_lines(docs: DataFrame, least_length: int = LEAST_LENGTH, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept (the text left) for every row of ``docs`` (doc_id, text; other columns are ignored).

    Lines whose key has at least ``least_length`` code points and is found in at least ``least_docs`` documents stay only in the
    document with the largest doc_id that holds it, there all of them. A null or empty text is one empty line. A null doc_id
    sorts last, so it is the largest, and is returned as null; rows that share a doc_id are one document for counts and for
    keeping, and are returned each with its own text. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = cut(keyed(docs, least_length))
    path = scratch(spark, "lines")
    common_keys(rows, least_docs).write.parquet(path)  # written, so that the join deals both sides anew and can split a hot key
    common = spark.read.schema("a long, b long, keep long").parquet(path)
    spots = rows.select("id", "mark", F.inline("keys"))
    falls = spots.join(common, ["a", "b"]).filter(F.col("id") != F.col("keep"))
    falls = falls.groupBy("id", "mark").agg(F.collect_set("pos").alias("falls"))  # a document's lines at most
    whole = docs.select(id_of().alias("id"), text_of().alias("text")).withColumn("mark", F.xxhash64("text"))
    lines, n = F.col("lines"), F.size("lines")
    left = F.array_except(F.sequence(F.lit(0), n - 1), F.coalesce("falls", F.array().cast("array<int>")))  # in order
    told = whole.join(falls, ["id", "mark"], "left").withColumn("lines", lines_of(F.col("text")))
    return told.select(
        shown_id("id").alias("doc_id"),
        n.cast("long").alias("n_lines"),
        (n - F.size(left)).cast("long").alias("n_dropped"),
        F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n").alias("kept"),
    )


def line_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of ``drop_lines``."""
    return drop_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = f"""
WITH l AS (SELECT doc_id, unnest(s) AS line, unnest(range(len(s))) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= {LEAST_LENGTH} GROUP BY key HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}),
m AS (SELECT doc_id, line, pos, keep IS NOT NULL AND keep <> doc_id AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
