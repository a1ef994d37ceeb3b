"""Merkle manifest of a dataset: a tree of hashes for each source, and one over their roots.

Rows are dealt out by ranges of (source, doc_id) and numbered from the ranges' counts, so that a source with a third of all
rows stays spread. Blocks of WIDTH**HEIGHT consecutive leaves are aligned subtrees, each built in one task and stored as
one row; their roots are the leaves of the next round, until one node is left for each source. The subroots then grow
one tree by the same code, whatever their number.

A stored subtree is laid out after van Emde Boas: it is split at half its height into a top tree and the trees that
hang below it, each stored whole and split again in the same way, so that a path from leaf to root touches few lines of
any cache. Where a node stands follows from its depth and number alone; construction and the search for siblings
use that arithmetic, and no pointer is stored.

A document's path holds the siblings of its leaf and of all nodes above it. Paths go down from the roots round by round, a row for
each block, and meet the leaves of their block in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxtrail.llm.common import cut, id_of, shown_id

#: Nodes of a run, and levels of runs in a stored subtree.
WIDTH, HEIGHT = 3, 8
SIZE = 32
TREE = ["known", "source"]


def field(value: Column) -> Column:
    """A value with its length in bytes before it, or a dash for null, so that no two rows read the same."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    """The digest of a document with ``text`` for its text, as bytes."""
    fields = [field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)]
    return F.unhex(F.sha2(F.concat(*fields), 256))


def run_digest(run: bytes) -> bytes:
    """The digest of consecutive nodes: they enter as hexadecimal text."""
    return sha256(run.hex().encode()).digest()


def places(depth: np.ndarray | int, number: np.ndarray, levels: int) -> np.ndarray:
    """Where the nodes at ``depth`` with these numbers from the left stand in a stored tree of so many levels."""
    at = np.zeros_like(number)
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        below = WIDTH ** (depth - top)
        at = at + full_size(top) + number // below * full_size(levels - top)
        number, depth, levels = number % below, depth - top, levels - top
    return at


def full_size(levels: int) -> int:
    """Nodes of a full tree of so many levels."""
    return (WIDTH**levels - 1) // (WIDTH - 1)


def height_of(total: int, height: int) -> int:
    """Levels of runs in the subtrees of a tree with ``total`` nodes in this round."""
    h = 0
    while h < height and WIDTH**h < total:
        h += 1
    return h


def stored(leaves: list[bytes], height: int) -> np.ndarray:
    """A subtree with these leaves as a table of digests; places of nodes that it lacks are zero."""
    out = np.zeros((full_size(height + 1), SIZE), np.uint8)
    level = leaves
    for depth in range(height, -1, -1):
        out[places(depth, np.arange(len(level)), height + 1)] = np.frombuffer(b"".join(level), np.uint8).reshape(-1, SIZE)
        if depth:
            level = [run_digest(b"".join(level[i : i + WIDTH])) for i in range(0, len(level), WIDTH)]
    return out


def paths_in(nodes: np.ndarray, count: int, height: int, numbers: np.ndarray) -> list[bytes]:
    """For each leaf of these numbers, of ``count``, its path to the subtree's root.

    A level of a path is a byte with the node's position in its run, a byte with the number of siblings, and their digests.
    """
    parts: list[list[bytes]] = [[] for _ in numbers]
    for depth in range(height, 0, -1):
        first = numbers - numbers % WIDTH
        there = np.minimum(count - first, WIDTH)
        others = [nodes[places(depth, np.minimum(first + k, count - 1), height + 1)] for k in range(WIDTH)]
        for i, (part, own, n) in enumerate(zip(parts, (numbers - first).tolist(), there.tolist(), strict=True)):
            part.append(bytes((own, n - 1)) + b"".join(others[k][i].tobytes() for k in range(n) if k != own))
        numbers, count = numbers // WIDTH, -(-count // WIDTH)
    return [b"".join(p) for p in parts]


def steps(path: bytes) -> Iterator[tuple[int, bytes]]:
    """Position in the run, and the siblings of it from left to right, level by level."""
    at = 0
    while at < len(path):
        n = path[at + 1] * SIZE
        yield path[at], path[at + 2 : at + 2 + n]
        at += 2 + n


def fold(digest: bytes, path: bytes) -> bytes:
    """The root that a leaf leads to with the siblings of a path."""
    for own, others in steps(path):
        digest = run_digest(others[: own * SIZE] + digest + others[own * SIZE :])
    return digest


def _ranked(rows: DataFrame, tree: list[str], order: list[str]) -> DataFrame:
    """Adds rank (from 0, by ``order`` in the row's tree) and total (rows of the tree)."""
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())  # rows is cut, so that a repeated task numbers alike
    spread = cut(tied.repartitionByRange(*tree, *order, "_tie").sortWithinPartitions(*tree, *order, "_tie"))
    spread = spread.drop("_tie").withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    parts = spread.groupBy(*tree, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))  # a row for each part at most
    whole = Window.partitionBy(*tree)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*tree, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("total"))
    return spread.join(parts, [*tree, "_part"]).withColumn("rank", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def _in_rank(table: pa.Table) -> tuple[pa.Table, int]:
    table = table.sort_by("rank").combine_chunks()
    return table, table.column("total")[0].as_py()


def _built(tree: list[str], height: int):
    def built(rows: pa.Table) -> pa.Table:
        rows, total = _in_rank(rows)
        h = height_of(total, height)
        nodes = stored(rows.column("digest").to_pylist(), h)
        one = rows.slice(0, 1).select([*tree, "block", "total"])
        return one.append_column("count", pa.array([rows.num_rows])).append_column("nodes", pa.array([nodes.tobytes()], pa.binary())).append_column("top", pa.array([nodes[0].tobytes()], pa.binary()))

    return built


def _schema(frame: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {frame.schema[n].dataType.simpleString()}" for n in names)


def grown(rows: DataFrame, tree: list[str], order: list[str], height: int = HEIGHT) -> tuple[list[DataFrame], list[DataFrame]]:
    """(levels, stores) of the trees over rows (``tree``, ``order``, digest, any others): by round, the nodes that enter it with rank, total and
    block, and the subtrees made of them, a row (tree, block, total, count, nodes, top) for each.
    """
    wide = WIDTH**height
    blocked = lambda frame: frame.withColumn("block", F.expr(f"rank div {wide}"))
    levels, stores = [blocked(_ranked(rows, tree, order))], []
    while True:
        now = levels[-1].select(*tree, "block", "total", "rank", "digest")
        schema = _schema(now, [*tree, "block", "total"]) + ", count long, nodes binary, top binary"
        stores.append(cut(now.groupBy(*tree, "block").applyInArrow(_built(tree, height), schema)))
        more = stores[-1].filter(F.col("total") > wide)
        if more.isEmpty():
            return levels, stores
        levels.append(blocked(more.select(*tree, F.col("top").alias("digest"), F.col("block").alias("rank"), F.expr(f"(total + {wide - 1}) div {wide}").alias("total"))))


def _walked(names: list[str], height: int):
    def walked(rows: pa.Table, store: pa.Table) -> pa.Table:
        rows, total = _in_rank(rows)
        one = {k: v[0] for k, v in store.to_pydict().items()}
        nodes = np.frombuffer(one["nodes"], np.uint8).reshape(-1, SIZE)
        numbers = rows.column("rank").to_numpy() % WIDTH**height
        paths = [p + one["above"] for p in paths_in(nodes, one["count"], height_of(total, height), numbers)]
        return rows.select(names).append_column("path", pa.array(paths, pa.binary())).append_column("tree_root", pa.array([one["tree_root"]] * len(paths), pa.binary()))

    return walked


def with_paths(levels: list[DataFrame], stores: list[DataFrame], tree: list[str], above: DataFrame | None = None, height: int = HEIGHT) -> DataFrame:
    """The rows of ``levels[0]`` with path and tree_root. ``above`` (tree, above) has paths that go on from the trees' roots."""
    down = None
    for level, store in zip(reversed(levels), reversed(stores), strict=True):
        ends = store.filter(F.col("total") <= WIDTH**height).select(*tree, "block", F.col("top").alias("tree_root"))
        ends = ends.withColumn("above", F.lit(b"")) if above is None else ends.join(above, tree)
        down = ends if down is None else ends.unionByName(down.select(*tree, F.col("rank").alias("block"), "tree_root", F.col("path").alias("above")))
        met = store.select(*tree, "block", "count", "nodes").join(down, [*tree, "block"])
        names = [c for c in level.columns if c != "total"]
        schema = _schema(level, names) + ", path binary, tree_root binary"
        down = level.groupBy(*tree, "block").cogroup(met.groupBy(*tree, "block")).applyInArrow(_walked(names, height), schema)
    return down


def proofs(docs: DataFrame, shown: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, shown, subroot, root and path (all bytes but doc_id) for every row of ``docs`` (doc_id, text, lang, source, n_chars; others are ignored).

    ``shown`` is the text with which a document is presented later, its own by default; the column of that name is the digest of the
    document with it. Leaves of a source ascend by doc_id, a null one last; rows that repeat it ascend by their digest, and
    equal rows take places next to each other. Rows without a source are a source of their own, the first. A null value is told
    from an empty one. An empty table gives no rows.
    """
    shown = F.col("text") if shown is None else shown
    rows = cut(docs.select(F.col("source").isNotNull().alias("known"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), id_of().alias("id"), leaf(F.col("text")).alias("digest"), leaf(shown).alias("shown")))
    levels, stores = grown(rows, TREE, ["id", "digest"], height)
    sub = None
    for s in stores:
        ends = s.filter(F.col("total") <= WIDTH**height).select(*TREE, F.col("top").alias("digest"))
        sub = ends if sub is None else sub.unionByName(ends)
    tops, crown = grown(cut(sub.withColumn("forest", F.lit(0))), ["forest"], TREE, height)
    above = with_paths(tops, crown, ["forest"], None, height)
    root = above.select("tree_root").first()  # one digest
    above = cut(above.select(*TREE, F.col("path").alias("above")))
    out = with_paths(levels, stores, TREE, above, height)
    return out.select(shown_id("id").alias("doc_id"), F.col("digest").alias("leaf"), "shown", F.col("tree_root").alias("subroot"), F.lit(bytes(root[0]) if root else None).cast("binary").alias("root"), "path")


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = batch.column(2).to_pylist()
        sums = [sha256(b"".join(s for _, s in steps(p)).hex().encode()).hexdigest() for p in paths]
        roots = [fold(d, p).hex() for d, p in zip(batch.column(1).to_pylist(), paths, strict=True)]
        keep = batch.select([0, 3, 4, 5])
        yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(sums, pa.string()), pa.array(roots, pa.string())], [*keep.schema.names, "proof_sha256", "folded_root"])


def verified(proven: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 (of the siblings of its path), folded_root (from the digest shown) and verified, for rows of ``proofs``; digests in hexadecimal."""
    text = lambda c: F.lower(F.hex(c)).alias(c)
    rows = proven.select("doc_id", "shown", "path", text("leaf"), text("subroot"), text("root"))
    out = rows.mapInArrow(_folded, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered(modulus: int = 2) -> Column:
    """The text without line ends where the checksum of the doc_id is divided by ``modulus``."""
    told = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == 0
    return F.when(told, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


ORACLE = """
WITH RECURSIVE half AS (SELECT list(list_reduce(list_prepend(i, range(4)), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY i) AS t FROM (SELECT unnest(range(16)) AS i)),
x AS (SELECT *, hex(encode(CAST(doc_id AS VARCHAR))) AS d FROM documents),
y AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(range(length(d) // 2), lambda i: [CAST('0x' || d[2 * i + 2] AS BIGINT), CAST('0x' || d[2 * i + 1] AS BIGINT)]))),
   lambda a, b: xor(a >> 4, half.t[(xor(a, b) & 15) + 1]))) AS h FROM x, half),
z AS (SELECT doc_id, source, text, CASE WHEN h % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS shown,
   strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head FROM y),
f AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(shown) || ':' || shown, '-')) AS shown,
   row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM z),
t AS (SELECT source, 0 AS lvl, i, leaf AS h, n FROM f
   UNION ALL SELECT source, lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 2) // 3) FROM t WHERE n > 1 GROUP BY source, lvl, i // 3),
s AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n, lvl AS top FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, i, subroot AS h, n FROM s
   UNION ALL SELECT lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 2) // 3) FROM u WHERE n > 1 GROUP BY lvl, i // 3),
rt AS (SELECT source, lvl, i // 3 AS g, list(h ORDER BY i) AS hs FROM t WHERE n > 1 GROUP BY source, lvl, i // 3),
ru AS (SELECT lvl, i // 3 AS g, list(h ORDER BY i) AS hs FROM u WHERE n > 1 GROUP BY lvl, i // 3),
a AS (SELECT doc_id, source, 0 AS lvl, i, shown AS h, '' AS proof FROM f
   UNION ALL SELECT a.doc_id, a.source, a.lvl + 1, a.i // 3, sha256(array_to_string(hs[:a.i % 3], '') || a.h || array_to_string(hs[a.i % 3 + 2:], '')),
   a.proof || array_to_string(hs[:a.i % 3], '') || array_to_string(hs[a.i % 3 + 2:], '') FROM a JOIN rt ON a.source IS NOT DISTINCT FROM rt.source AND a.lvl = rt.lvl AND a.i // 3 = rt.g),
m AS (SELECT a.doc_id, subroot, s.i, a.h, proof FROM a JOIN s ON a.source IS NOT DISTINCT FROM s.source AND a.lvl = s.top),
b AS (SELECT doc_id, subroot, 0 AS lvl, i, h, proof FROM m
   UNION ALL SELECT b.doc_id, b.subroot, b.lvl + 1, b.i // 3, sha256(array_to_string(hs[:b.i % 3], '') || b.h || array_to_string(hs[b.i % 3 + 2:], '')),
   b.proof || array_to_string(hs[:b.i % 3], '') || array_to_string(hs[b.i % 3 + 2:], '') FROM b JOIN ru ON b.lvl = ru.lvl AND b.i // 3 = ru.g),
e AS (SELECT h AS root, lvl AS top FROM u WHERE n = 1)
SELECT f.doc_id, leaf, b.subroot, root, sha256(proof) AS proof_sha256, b.h AS folded_root, b.h = root AS verified FROM f JOIN b USING (doc_id) JOIN e ON b.lvl = e.top
"""
