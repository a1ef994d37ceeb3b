"""Near-duplicate detection with SetSketch registers.

1. One pass over the texts gives each document its number of distinct word shingles, a 128-bit hash of
   its word sequence, and a sketch: REGISTERS truncated maxima of exponentially spaced levels (sketches
   merge by the maximum of each register).
2. Documents with the same word sequence become one class, with map-side combining; one representative
   of each class goes on, and the others join its component at the end.
3. Bands of registers are keys. The smallest member of a bucket is its centre, and all members of buckets
   with one centre form a cluster; a pair that shares any bucket shares a cluster.
4. Stars: each member is compared with its centre. Sketches travel first: a pair goes on if its jointly
   estimated similarity (by likelihood over the registers that are larger, smaller and equal) could reach the
   threshold. Texts are fetched only for those, to parts of a cluster of a bounded size in members and bytes,
   and verified on full shingle sets. This connects most copies with their centre in linear work.
5. The rest: clusters whose members are still in several components are compared in blocks, sketches first
   again. Only members with a possible partner in another component bring their texts, and only to the pairs of
   blocks where that partner is. What leaves a task is a forest of true links, never all pairs of a group.
6. Connected components by alternating star contraction, on Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxtrail.llm.common import cut, id_of, shown_id, small_batches, text_of, told_apart
from boxtrail.llm.kernels import U, mix, shingle_sets, shingles, stretches, words
from boxtrail.operators.tracking import whole_groups

#: Sketch parameters of the published scheme: base, rate, largest level.
B, RATE, LEVELS = 1.001, 20.0, 65534
REGISTERS, ROWS = 128, 4
#: Members of a cluster compared in one group, and bytes of their texts.
BLOCK, BYTES = 512, 16 << 20
#: Pairs whose estimate lies further below the threshold than this are not verified: over five standard errors.
SLACK = 0.2
_RNG = np.random.default_rng(20)
_A = _RNG.integers(0, 1 << 32, REGISTERS, np.uint32) | np.uint32(1)
_C = _RNG.integers(0, 1 << 32, REGISTERS, np.uint32)


def sketches(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Registers (texts x REGISTERS, uint16) of the sets of 64-bit hashes; an empty set has all zeros.

    A register is the largest level floor(1 - log_B(x)) over the elements, x exponential with the rate;
    that is the level of the smallest x, so minima of uniform hashes are kept and turned into levels once.
    """
    full = np.flatnonzero(np.diff(offsets))
    least = np.full((len(offsets) - 1, REGISTERS), 0xFFFFFFFF, np.uint32)
    x = (hashes ^ (hashes >> U(32))).astype(np.uint32)
    begins, ends = offsets[:-1][full], offsets[1:][full]
    step = 1 << 15  # elements at a time, to stay in cache; a text may span several steps
    for at in range(0, len(x), step):
        lo, hi = np.searchsorted(ends, at, "right"), np.searchsorted(begins, min(at + step, len(x)))
        cuts, part = np.maximum(begins[lo:hi], at) - at, x[at : at + step]
        into = full[lo:hi]
        for i in range(REGISTERS):
            y = part * _A[i]
            y += _C[i]
            y ^= y >> np.uint32(15)
            y *= np.uint32(0x2C1B3C6D)
            y ^= y >> np.uint32(12)
            least[into, i] = np.minimum(least[into, i], np.minimum.reduceat(y, cuts))
    u = (least[full].astype(np.float64) + 0.5) / 2.0**32
    level = np.floor(1 - np.log(-np.log1p(-u) / RATE) / np.log(B))
    out = np.zeros(least.shape, np.uint16)
    out[full] = np.clip(level, 0, LEVELS + 1)
    return out


def estimate(above: np.ndarray, below: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarity that maximises the joint likelihood, from counts of larger and smaller registers of a against b.

    With u = n_a / (n_a + n_b), v = 1 - u: P(larger) = p(u - v J), P(smaller) = p(v - u J), and equal
    otherwise, with p(x) = -log_B(1 - x (B - 1) / B). The likelihood is concave in J, so bisection finds it.
    """
    lo, hi = np.zeros(len(n_a)), _largest(n_a, n_b)
    for _ in range(30):
        j = (lo + hi) / 2
        up = _gain(above, below, n_a, n_b, j) > 0
        lo, hi = np.where(up, j, lo), np.where(up, hi, j)
    return (lo + hi) / 2


def _largest(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The largest similarity that sets of these sizes can have."""
    return np.minimum(n_a, n_b) / np.maximum(np.maximum(n_a, n_b), 1)


def _gain(above: np.ndarray, below: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, j: np.ndarray | float) -> np.ndarray:
    """Slope of the log likelihood at similarity j."""
    u = n_a / np.maximum(n_a + n_b, 1)
    v = 1 - u
    same = REGISTERS - above - below
    p = lambda x: -np.log1p(-x * (B - 1) / B) / np.log(B)
    slope = lambda x: (B - 1) / B / (1 - x * (B - 1) / B) / np.log(B)
    x, y = np.maximum(u - v * j, 1e-12), np.maximum(v - u * j, 1e-12)
    return -above * v * slope(x) / p(x) - below * u * slope(y) / p(y) + same * (v * slope(x) + u * slope(y)) / np.maximum(1 - p(x) - p(y), 1e-12)


def could_reach(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether the estimate for sketches a and b (rows of registers) lies above the threshold less SLACK.

    The likelihood is concave, so its slope there tells, without finding the estimate.
    """
    keep = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    k, least = np.flatnonzero(keep), percent / 100 - SLACK
    for at in range(0, len(k), 1 << 14):
        some = k[at : at + (1 << 14)]
        keep[some] = _gain((a[some] > b[some]).sum(1), (a[some] < b[some]).sum(1), n_a[some], n_b[some], least) >= 0
    return keep


def _described(size: int):
    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = 0
            for some in stretches(whole.column(1)):
                batch = whole.slice(at, len(some))
                at += len(some)
                w, offsets = words(batch.column(1))
                h, begins = shingles(w, offsets, size)
                text = np.repeat(np.arange(batch.num_rows), np.diff(begins))
                order = np.lexsort((h, text))
                hs, ts = h[order], text[order]
                new = np.r_[True, (hs[1:] != hs[:-1]) | (ts[1:] != ts[:-1])][: len(hs)]
                n = np.bincount(ts[new], minlength=batch.num_rows)
                # 128 bits of the word sequence: sums of position-dependent mixes
                place = (np.arange(len(w)) - np.repeat(offsets[:-1], np.diff(offsets))).astype(U)
                twin = []
                for salt in (U(0xA24BAED4963EE407), U(0x9FB21C651E98DF25)):
                    total = np.r_[U(0), np.cumsum(mix(w * salt + mix(place + salt)), dtype=U)]
                    twin.append(mix(total[offsets[1:]] - total[offsets[:-1]] + np.diff(offsets).astype(U)))
                reg = sketches(h, begins)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n.astype(np.int64)), pc.binary_length(batch.column(1)).cast(pa.int64()), *(pa.array(t.view(np.int64)) for t in twin), pa.array([r.tobytes() for r in reg], pa.binary())],
                    ["id", "n", "bytes", "twin_a", "twin_b", "sketch"],
                )

    return described


class Forest:
    """Union-find over the members of one group."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def find(self, k: int) -> int:
        while self.root[k] != k:
            self.root[k] = k = self.root[self.root[k]]
        return k

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.root[max(a, b)] = min(a, b)

    def labels(self) -> np.ndarray:
        while (self.root[self.root] != self.root).any():
            self.root = self.root[self.root]
        return self.root


def links(left: list[tuple], right: list[tuple] | None, size: int, percent: int) -> list[tuple[int, int]]:
    """True links among left, or between left and right, that connect members not connected yet.

    Members are (id, n, sketch, text, component); those of one component are connected already.
    """
    both = left + (right or [])
    cross = len(left) if right is not None else 0
    ids = [m[0] for m in both]
    n = np.array([m[1] for m in both], np.float64)
    reg = np.frombuffer(b"".join(m[2] for m in both), np.uint16).reshape(-1, REGISTERS)
    sets = shingle_sets(pa.array([m[3] for m in both], pa.string()), size)
    # members by postings of each shingle, to count all intersections of one member at once
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(both)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    forest, out = Forest(len(both)), []
    seen: dict[int, int] = {}
    for k, m in enumerate(both):
        forest.join(k, seen.setdefault(m[4], k))
    # the member with most registers in common with all comes first: it connects most of a group of copies
    mode = np.array([np.bincount(np.unique(c, return_inverse=True)[1]).argmax() for c in reg.T])
    common = (reg == np.array([np.unique(c)[m] for c, m in zip(reg.T, mode, strict=True)])).sum(1)
    for k in np.argsort(-common[:cross] if cross else -common, kind="stable").tolist():
        roots = forest.labels()
        other = np.arange(cross, len(both)) if cross else np.arange(len(both))
        other = other[(roots[other] != roots[k]) & (other != k)]
        other = other[100 * np.minimum(n[other], n[k]) >= percent * np.maximum(n[other], n[k])]
        if not len(other):
            continue
        other = other[could_reach(np.broadcast_to(reg[k], (len(other), REGISTERS)), reg[other], np.full(len(other), n[k]), n[other], percent)]
        if not len(other):
            continue
        if len(other) > 8:
            a, b = np.searchsorted(flat, sets[k]), np.searchsorted(flat, sets[k], "right")
            hit = np.repeat(a - np.r_[0, np.cumsum(b - a)[:-1]], b - a) + np.arange((b - a).sum())
            shared = np.bincount(owner[hit], minlength=len(both))[other]
        else:
            shared = np.array([len(np.intersect1d(sets[k], sets[o], assume_unique=True)) for o in other])
        true = other[100 * shared >= percent * (len(sets[k]) + np.array([len(sets[o]) for o in other]) - shared)]
        for o in true.tolist():
            if forest.find(k) != forest.find(o):
                forest.join(k, o)
                out.append((ids[k], ids[o]))
    return out


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b): component is the smallest id reachable.

    Large-star and small-star steps in turn, each a map-side combined minimum and a join on the id; edges
    are rewritten until nothing changes, in a number of rounds that grows with the logarithm of the size.
    """
    edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(low.select("a", F.col("m").alias("b")))
        edges = cut(small.distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1000003), F.sum("a"), F.sum("b")).first()
        if now == before:
            break
        before = now
    return edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))


def _possible(percent: int):
    """Of pairs (.., n, sketch, other_n, other_sketch) those whose estimate could reach the threshold."""

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy().astype(np.float64) for c in ("n", "other_n"))
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("sketch", "other_sketch"))
            keep = could_reach(a, b, n, m, percent)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("centre", "part", "id")], ["centre", "part", "id"])

    return possible


def _starred(size: int, percent: int):
    """True links of a part of a cluster between its centre (side 0) and its members."""

    def starred(members: pa.Table) -> pa.Table:
        t = members.sort_by([("side", "ascending"), ("id", "ascending")])
        sets = shingle_sets(t.column("text").combine_chunks(), size)
        ids = t.column("id").to_numpy()
        shared = np.array([len(np.intersect1d(sets[0], x, assume_unique=True)) for x in sets[1:]], np.int64)
        both = len(sets[0]) + np.array([len(x) for x in sets[1:]], np.int64) - shared
        true = ids[1:][100 * shared >= percent * both] if len(ids) else ids
        return pa.table({"a": pa.array(true, pa.int64()), "b": pa.array(np.full(len(true), ids[0] if len(ids) else 0), pa.int64())})

    return starred


#: Groups of up to so many members are compared all at once, pair by pair.
SMALL = 48


def _apart(batch: pa.RecordBatch, begins: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Pairs of rows of the small groups that could be linked and are in two components, and the large groups' (from, to).

    Rows are members with centre, i, j (the blocks that meet), part, n, sketch, component.
    """
    sizes = np.diff(np.r_[begins, batch.num_rows])
    small = sizes <= SMALL
    m = np.repeat(np.where(small, sizes, 0), sizes)  # partners of each row
    a = np.repeat(np.arange(batch.num_rows), m)
    b = np.repeat(np.repeat(begins, sizes), m) + np.arange(len(a)) - np.repeat(np.cumsum(m) - m, m)
    part, i, j, of = (batch.column(c).to_numpy() for c in ("part", "i", "j", "component"))
    keep = np.where(i[a] == j[a], a < b, (part[a] == i[a]) & (part[b] == j[a])) & (of[a] != of[b])
    a, b = a[keep], b[keep]
    n = batch.column("n").to_numpy().astype(np.float64)
    reg = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(-1, REGISTERS)
    close = np.zeros(len(a), bool)
    for at in range(0, len(a), 1 << 14):
        x, y = a[at : at + (1 << 14)], b[at : at + (1 << 14)]
        close[at : at + len(x)] = could_reach(reg[x], reg[y], n[x], n[y], percent)
    large = [(int(x), int(x + k)) for x, k in zip(begins[~small], sizes[~small], strict=True)]
    return a[close], b[close], large


_GROUP = ["centre", "i", "j"]


def _likely(percent: int):
    """Of pairs of blocks the members that could be linked with a member of another component."""

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, begins in whole_groups(batches, _GROUP):
            a, b, large = _apart(batch, begins, percent)
            chosen = np.zeros(batch.num_rows, bool)
            chosen[a] = chosen[b] = True
            for lo, hi in large:
                some = batch.slice(lo, hi - lo)
                reg = np.frombuffer(b"".join(some.column("sketch").to_pylist()), np.uint16).reshape(-1, REGISTERS)
                n, part, of = (some.column(c).to_numpy() for c in ("n", "part", "component"))
                n = n.astype(np.float64)
                left, right = (np.flatnonzero(part == some.column(c)[0].as_py()) for c in ("i", "j"))
                for k in left.tolist():
                    other = right[of[right] != of[k]]
                    other = other[could_reach(np.broadcast_to(reg[k], (len(other), REGISTERS)), reg[other], np.full(len(other), n[k]), n[other], percent)]
                    chosen[lo + other] = True
                    chosen[lo + k] |= len(other) > 0
            yield batch.filter(pa.array(chosen))

    return likely


def _compared(size: int, percent: int):
    """True links of the members of pairs of blocks (with texts) that connect different components."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, begins in whole_groups(batches, _GROUP):
            a, b, large = _apart(batch, begins, percent)
            ids, of = batch.column("id").to_numpy(), batch.column("component").to_numpy()
            out: list[tuple[int, int]] = []
            need = np.unique(np.r_[a, b])
            sets = dict(zip(need.tolist(), shingle_sets(batch.column("text").take(pa.array(need)), size), strict=True))
            names, name = np.unique(of, return_inverse=True)
            forest = Forest(len(names))  # of components; a link found in one group holds for all
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                if forest.find(name[x]) != forest.find(name[y]):
                    p, q = sets[x], sets[y]
                    shared = len(np.intersect1d(p, q, assume_unique=True))
                    if 100 * shared >= percent * (len(p) + len(q) - shared):
                        forest.join(name[x], name[y])
                        out.append((ids[x], ids[y]))
            for lo, hi in large:
                some = batch.slice(lo, hi - lo)
                members = list(zip(*(some.column(c).to_pylist() for c in ("id", "n", "sketch", "text", "component")), strict=True))
                i, j, part = some.column("i")[0].as_py(), some.column("j")[0].as_py(), some.column("part").to_pylist()
                if i == j:
                    out += links(members, None, size, percent)
                elif i in part and j in part:
                    out += links([r for r, p in zip(members, part, strict=True) if p == i], [r for r, p in zip(members, part, strict=True) if p == j], size, percent)
            x, y = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    return compared


def near_duplicates(docs: DataFrame, size: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text; other columns are ignored).

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; a document's set is its distinct
    ``size``-word shingles, or its whole sequence if shorter. Two documents are linked when 100 * intersection
    >= percent * union. A null, empty or blank text has no shingles and is linked with nothing. component_id is
    the smallest doc_id reachable. A null doc_id sorts last and is returned as null. Rows that repeat a doc_id, null
    too, with another text are documents of their own, in an order fixed by their texts' hashes, of which a component
    keeps one; rows that repeat both are one document, returned as often as it occurs.
    """
    small_batches(docs.sparkSession)
    rows, shown, again = told_apart(docs.select(id_of().alias("id"), text_of().alias("text")))
    base = cut(rows.mapInArrow(_described(size), "id long, n long, bytes long, twin_a long, twin_b long, sketch binary"))
    full = base.filter("n > 0")
    firsts = full.groupBy("twin_a", "twin_b").agg(F.min("id").alias("rep"))
    member = full.join(firsts, ["twin_a", "twin_b"])
    reps = cut(member.filter("id = rep").select("id", "n", "bytes", "sketch").dropDuplicates(["id"]))

    width = 2 * ROWS
    bands = F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // ROWS - 1)), lambda i: F.xxhash64(i, F.substring("sketch", i * width + 1, F.lit(width))))
    keyed = reps.select("id", "bytes", F.explode(bands).alias("bucket"))
    centres = keyed.groupBy("bucket").agg(F.min("id").alias("centre"), F.count("*").alias("members")).filter("members > 1").select("bucket", "centre")
    cluster = cut(keyed.join(centres, "bucket").groupBy("centre", "id").agg(F.first("bytes").alias("bytes")))
    sizes = cluster.groupBy("centre").agg(F.count("*").alias("members"), F.sum("bytes").alias("bytes"))
    sizes = cut(sizes.select("centre", F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("bytes") / BYTES)).cast("int").alias("parts")))
    texts = (rows.dropDuplicates(["id"]) if again else rows).select("id", "text")
    sketches_of = reps.select("id", "n", "sketch")

    # stars: a centre's sketch and text go to each part of its cluster, so a hot centre is spread over them
    heads = sizes.select("centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "parts")
    spread = cluster.filter("id <> centre").select("centre", "id").join(sizes, "centre").select("centre", "id", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    centre_rows = heads.join(sketches_of.withColumnsRenamed({"id": "centre", "n": "other_n", "sketch": "other_sketch"}), "centre").select("centre", "part", "other_n", "other_sketch")
    pairs = spread.join(sketches_of, "id").join(centre_rows, ["centre", "part"])
    pairs = cut(pairs.select("centre", "part", "id", "n", "sketch", "other_n", "other_sketch").mapInArrow(_possible(percent), "centre long, part int, id long"))
    wanted = pairs.select("centre", "part", "id", F.lit(1).alias("side")).unionByName(pairs.select("centre", "part", F.col("centre").alias("id"), F.lit(0).alias("side")).distinct())
    stars = wanted.join(texts, "id").select("centre", "part", "side", "id", "text").groupBy("centre", "part").applyInArrow(_starred(size, percent), "a long, b long")
    stars = cut(stars)

    # the rest: what several components share a cluster
    first = components(stars)
    of = cut(cluster.select("centre", "id").join(first, "id", "left").withColumn("component", F.coalesce("component", "id")))
    mixed = of.groupBy("centre").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("centre")
    placed = of.join(mixed, "centre").join(sizes, "centre").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    # a member meets the members of every part: itself in (part, part), the others in ordered pairs of parts
    placed = placed.select(
        "centre", "id", "component", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    ).select("centre", "id", "component", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))

    met = lambda rows: rows.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "id")
    kind = "centre long, i int, j int, id long, component long, part int, n long, sketch binary"
    columns = [c.split()[0] for c in kind.split(", ")]
    groups = cut(met(placed.join(sketches_of, "id").select(*columns)).mapInArrow(_likely(percent), kind))
    near = met(groups.join(texts, "id").select(*columns, "text")).mapInArrow(_compared(size, percent), "a long, b long")
    found = components(near.unionByName(first.select(F.col("id").alias("a"), F.col("component").alias("b"))))
    every = base.select("id", "n", "twin_a", "twin_b").join(firsts, ["twin_a", "twin_b"], "left").select("id", "n", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("id")).alias("rep"))
    every = every.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("id", "n", F.coalesce("component", "rep").alias("component"))
    every = every.withColumn("kept", F.col("id") == F.col("component"))
    if shown is not None:
        every = every.join(shown, "id").drop("id").withColumnRenamed("shown", "id")
        every = every.join(shown.withColumnRenamed("id", "component"), "component").drop("component").withColumnRenamed("shown", "component")
    return every.select(shown_id("id").alias("doc_id"), F.col("n").alias("n_shingles"), shown_id("component").alias("component_id"), "kept")


ORACLE = r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k + 3], ' '))) END AS g FROM t),
s AS (SELECT doc_id, unnest(g) AS g FROM g),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN g x ON x.doc_id = a JOIN g y ON y.doc_id = b WHERE 100 * n >= 80 * (len(x.g) + len(y.g) - n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS o FROM g UNION SELECT e.b, r.o FROM r JOIN e ON e.a = r.doc_id)
SELECT g.doc_id, CAST(len(g.g) AS BIGINT) AS n_shingles, min(o) AS component_id, g.doc_id = min(o) AS kept FROM g JOIN r USING (doc_id) GROUP BY g.doc_id, g.g
"""
