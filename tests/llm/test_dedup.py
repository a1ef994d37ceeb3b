import hashlib
import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from boxtrail.llm import block_naming, kernels, near_dedup, suffix_dedup

SPACE = re.compile(r"[\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def order(i):
    return math.inf if i is None else i


def check_exact(df, got):
    norm = [(i, SPACE.sub(" ", t or "")) for i, t in rows_of(df)]
    groups = defaultdict(list)
    for i, t in norm:
        groups[t].append(i)
    want = Counter()
    for i, t in norm:
        keep = min(groups[t], key=order)
        want[(i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect()) == want


@pytest.mark.parametrize("block", [4096, 64])
def test_exact(odd, documents, block):
    for df in (odd, documents):
        check_exact(df, block_naming.exact_dedup(df, block))


def test_exact_empty(none):
    assert block_naming.exact_dedup(none).count() == 0


def sets_of(rows, size):
    out = {}
    for i, t in rows:
        w = [x for x in SPACE.split((t or "").translate(LOWER)) if x]
        out.setdefault(order(i), []).append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    return out


def check_near(df, got, size=4, percent=80):
    sets = sets_of(rows_of(df), size)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    for r in got.collect():
        assert r.n_shingles in {len(s) for s in sets[order(r.doc_id)]}
        assert order(r.component_id) == find(order(r.doc_id)), r
        assert r.kept == (r.doc_id == r.component_id)


def test_near(odd, documents):
    for df in (odd, documents):
        got = near_dedup.near_duplicates(df)
        assert got.count() == df.count()
        check_near(df, got)


def test_near_groups(spark, monkeypatch):
    """A group of near copies larger than a block, with members that only others connect."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(60)]
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_near(df, near_dedup.near_duplicates(df))


def test_near_repeated_ids(spark):
    """Rows without an id, or with one id and different texts, are documents of their own, in the operator and the stages."""
    text = lambda seed: " ".join(random.Random(seed).choices([f"w{k}" for k in range(900)], k=60))
    rows = [(1, text(1)), (2, text(2)), (None, text(1) + " end"), (None, text(2) + " end"), (None, text(3)), (None, text(3) + " end"), (None, text(4)), (None, text(4)), (7, text(5)), (7, text(6)), (8, text(5) + " end"), (None, "  " + text(1))]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    got = near_dedup.near_duplicates(df)
    assert got.count() == len(rows)
    told = Counter((r.doc_id, r.component_id, r.kept) for r in got.collect())
    assert told == Counter({(1, 1, True): 1, (2, 2, True): 1, (None, 1, False): 2, (None, 2, False): 1, (None, None, True): 3, (None, None, False): 1, (7, 7, True): 2, (8, 7, False): 1})
    exact = corpus_pipeline.exact_stage(spark, df, "")
    assert exact.count() == len(rows) - 1  # one of text 4; "  " + text 1 differs by its leading space
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_stage(spark, exact, "").collect()]
    assert len(kept) == 6 and {(1, text(1)), (2, text(2)), (None, text(4)), (7, text(5)), (7, text(6))} < set(kept)
    blank = spark.createDataFrame([(None, "a b", "en", "s", 3), (None, "a  b", "en", "s", 4)], df.schema)
    assert corpus_pipeline.exact_stage(spark, blank, "").count() == 1


def test_near_empty(none):
    assert near_dedup.near_duplicates(none).count() == 0


def test_sketches_estimate():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        n = 2000
        common = rng.integers(0, 2**64, int(n * share), np.uint64)
        own = [rng.integers(0, 2**64, n - len(common), np.uint64) for _ in range(2)]
        a, b = (np.concatenate([common, x]) for x in own)
        ra, rb = near_dedup.sketches(np.concatenate([a, b]), np.array([0, n, 2 * n]))
        union = np.maximum(*(near_dedup.sketches(x, np.array([0, n]))[0] for x in (a, b)))
        assert (union == near_dedup.sketches(np.concatenate([a, b]), np.array([0, 2 * n]))[0]).all()  # sketches merge
        got = near_dedup.estimate(*(np.array([x]) for x in ((ra > rb).sum(), (ra < rb).sum(), n, n)))[0]
        true = len(common) / (2 * n - len(common))
        assert abs(got - true) < 5 * math.sqrt(true * (1 - true) / near_dedup.REGISTERS) + 0.02


def test_words():
    texts = ["Ab c  d e", "", " ", "x", "  a\tb c d e f", "ab C d e", "hello   "]
    w, o = kernels.words(pa.array(texts))
    assert np.diff(o).tolist() == [len(t.split()) for t in texts]
    s, so = kernels.shingles(w, o, 4)
    assert np.diff(so).tolist() == [1, 0, 0, 1, 3, 1, 1] and s[so[0]] == s[so[5]]
    w, o = kernels.words(pa.array([], pa.string()))
    assert len(w) == 0 and o.tolist() == [0]


def check_spans(df, got, length=100):
    marks = sorted({(order(i), t or "") for i, t in rows_of(df)}, key=lambda r: (r[0], r[1]))
    by_id = defaultdict(list)
    for i, t in marks:
        by_id[i].append(t)
    seen, want = set(), {}
    for i, t in marks:
        if len(by_id[i]) > 1:
            continue  # texts that share an id are ordered by a hash; see the test below
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        n = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        want[i] = (len(b), sum(gone), n, hashlib.sha256(kept).hexdigest())
    rows = got.collect()
    assert len(rows) == df.count()
    for r in rows:
        if order(r.doc_id) in want:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[order(r.doc_id)], r.doc_id


def test_spans(odd, documents):
    for df in (odd, documents):
        check_spans(df, suffix_dedup.removed_spans(df))


@pytest.mark.parametrize("hot, group", [(64, 2048), (2, 3)])
def test_spans_small_alphabet(spark, monkeypatch, hot, group):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    rng = random.Random(2)
    rows = [(k, "".join(rng.choice("ab") for _ in range(rng.randrange(400)))) for k in range(50)] + [(100 + k, "x" * rng.randrange(90, 300)) for k in range(20)]
    line = "".join(rng.choice("abcdefgh") for _ in range(60))
    rows += [(1000 + k, "".join(rng.choice("abcd") for _ in range(110)) + line + "".join(rng.choice("ab") for _ in range(k % 4)) + "y" * 50) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check_spans(df, suffix_dedup.removed_spans(df))


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_ranked_batches(size):
    """An owner's mark holds for all its rows, wherever a batch ends."""
    run, mark = suffix_dedup.RUN, suffix_dedup.MARK
    rows = [(4, 1, 1, run), (5, 1, 2, mark), (5, 2, 3, mark), (5, 1, 2, run), (5, 2, 3, run), (5, 2, 4, run), (6, 1, 5, run), (6, 2, 6, run), (7, 1, 7, mark), (7, 1, 7, run)]
    owner, runs, ids, kind = (np.array(c, np.int64) for c in zip(*rows))
    place = suffix_dedup._packed(np.full(len(rows), 10), np.full(len(rows), 3), kind)
    batches = [suffix_dedup._rows(suffix_dedup._RUN, *(c[k : k + size] for c in (owner, runs, ids, place))) for k in range(0, len(rows), size)]
    got = sorted((r["kind"], r["id"]) for b in suffix_dedup._ranked(100)(iter(batches)) for r in b.to_pylist())
    assert got == [(0, 4), (1, 5), (1, 6), (2, 2), (2, 3), (2, 7)]


def test_spans_repeated_id(spark):
    """Two texts of one id are two documents: the shared passage stays in one of them."""
    passage = "".join(random.Random(4).choices("abcdefg", k=150))
    df = spark.createDataFrame([(1, "A" * 40 + passage), (1, "B" * 40 + passage)], "doc_id long, text string")
    assert sorted(r.n_removed for r in suffix_dedup.removed_spans(df).collect()) == [0, 150]


def test_spans_repeated_row(spark):
    """A row that comes twice is one document, which doesn't repeat itself."""
    text = "".join(random.Random(4).choices("abcdefg", k=500))
    for parts in (1, 3):
        df = spark.createDataFrame([(1, text), (1, text), (2, text[:200]), (None, text), (None, text)], "doc_id long, text string").repartition(parts)
        got = sorted((r.doc_id or 9, r.n_removed) for r in suffix_dedup.removed_spans(df).collect())
        assert got == [(1, 0), (1, 0), (2, 200), (9, 500), (9, 500)]


def test_spans_periodic(spark):
    """A long text of one letter, or of a short period, sends a few rows, not one for each byte."""
    lead = "".join(random.Random(5).choices("bcdefg", k=500))
    rows = [(1, lead + "a" * 3_000_000), (2, "a" * 1_000_000 + lead), (3, "xyz" * 400_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sent = df.selectExpr("doc_id AS id", "text").mapInArrow(suffix_dedup._sampled(100), "owner long, run long, id long, place long")
    assert sent.count() < 1000
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.removed_spans(df).collect()}
    assert got == {1: (2_999_999, 1), 2: (1_000_500, 1), 3: (1_199_997, 1)}


def test_spans_empty(none):
    assert suffix_dedup.removed_spans(none).count() == 0
    for length in (10, 25, 16408):
        with pytest.raises(ValueError):
            suffix_dedup.removed_spans(none, length)


@pytest.mark.parametrize("length", [26, 60, 1000])
def test_spans_lengths(spark, length):
    """Thresholds that are no power of two times the gram, and runs of many windows."""
    rng = random.Random(length)
    line = "".join(rng.choices("abcdefgh", k=2 * length))
    rows = [(k, "".join(rng.choices("abcd", k=rng.randrange(300))) + line[rng.randrange(length) :] + "".join(rng.choices("ab", k=50))) for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check_spans(df, suffix_dedup.removed_spans(df, length), length)


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_reranked_batches(size, monkeypatch):
    """Pairs that occur once leave, wherever a batch ends."""
    monkeypatch.setattr(suffix_dedup, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 0})())}))
    rows = [(1, 1, 7, 10, 0), (1, 2, 7, 11, 0), (1, 2, 8, 12, 0), (1, 2, 9, 13, 0), (2, 2, 7, 14, 0), (3, 1, 7, 15, 0), (3, 1, 7, 16, 0), (4, 1, 1, 17, 0)]
    columns = [pa.array(c, pa.int64()) for c in zip(*rows)] + [pa.nulls(len(rows), pa.int64())]
    whole = pa.RecordBatch.from_arrays(columns, suffix_dedup._POSITION)
    got = [r for b in suffix_dedup._reranked(iter([whole.slice(k, size) for k in range(0, len(rows), size)])) for r in b.to_pylist()]
    assert sorted(r["id"] for r in got) == [11, 12, 13, 15, 16]
    ranks = {r["id"]: r["rank"] for r in got}
    assert ranks[11] == ranks[12] == ranks[13] != ranks[15] == ranks[16]


def test_near_dedup_takes_texts_by_bytes(spark):
    """What a task holds follows the bytes of a few texts, not the rows of a batch: in Python, and in batches sent there."""
    texts = pa.array([" ".join(f"w{k}x{i}" for i in range(1800)) for k in range(512)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(512), pa.int64()), texts], ["id", "text"])
    tracemalloc.start()
    n = sum(b.num_rows for b in near_dedup._described(4)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 512 and texts.nbytes > 6 << 20 and peak < 64 << 20

    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(limit)
    rows = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("word "), 800), F.col("id")).alias("text"))
    near_dedup.near_duplicates(rows.limit(10))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], ["n"])

    assert rows.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] < 4.1 * 2**20
    spark.conf.set(limit, "1MB")
    near_dedup.near_duplicates(rows.limit(10))
    assert spark.conf.get(limit) == "1MB"
    spark.conf.unset(limit)


def test_shingle_sets_in_stretches():
    texts = ["", "a b c d e", "x y", "long " * 300_000, " \n", *["the cat sat on the mat"] * 1100, "q r s t u v " * 90_000]
    column = pa.array(["left out", *texts]).slice(1)
    parts = list(kernels.stretches(column))
    assert [t for p in parts for t in p.to_pylist()] == texts and max(map(len, parts)) <= 512
    h, begins = kernels.shingles(*kernels.words(column), 4)
    for got, a, b in zip(kernels.shingle_sets(column, 4), begins[:-1], begins[1:], strict=True):
        assert got.tolist() == sorted(set(h[a:b].tolist()))
    assert kernels.shingle_sets(pa.array([], pa.string()), 4) == []
