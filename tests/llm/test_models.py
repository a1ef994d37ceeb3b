import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from boxtrail.llm import decontamination, language_id, ngram_trie, toxicity


def is_held(i, modulus, rest):
    return zlib.crc32(("" if i is None else str(i)).encode()) % modulus == rest


@given(st.lists(st.integers(0, 2**64 - 1), max_size=300), st.lists(st.integers(0, 2**64 - 1), max_size=20))
@settings(max_examples=60, deadline=None)
def test_elias_fano(values, others):
    v = np.array(sorted(set(values)), np.uint64)
    e = ngram_trie.EliasFano.of(v)
    if len(v):
        assert (e[np.arange(len(v))] == v).all()
    x = np.concatenate([v, np.array(others, np.uint64)])
    at = {int(a): k for k, a in enumerate(v)}
    assert e.find(x).tolist() == [at.get(int(a), -1) for a in x]


@given(st.lists(st.integers(0, 2**64 - 1), max_size=200), st.integers(0, 63))
@settings(max_examples=60, deadline=None)
def test_ranked(values, shift):
    x = np.array([v >> shift for v in values] * 2, np.uint64)
    for got, want in zip(ngram_trie.ranked(x), np.unique(x, return_inverse=True), strict=True):
        assert got.tolist() == want.tolist()


def test_codes():
    """Few values are kept, many stay near: cells are at most 0.08 wide in log10 at 10^-6, and 0.01 at 1."""
    few = np.repeat(np.arange(255) * 100, 3).astype(np.uint16)
    code, book = ngram_trie.coded(few, 9)
    assert book[0] == 9 and (code > 0).all() and (book[code] == few).all()
    share = 10.0 ** -np.random.default_rng(0).uniform(0, 6, 200_000)
    share[:150_000] = 0.2  # a frequent value takes no codes from the others
    q = ngram_trie.quantised(share)
    code, book = ngram_trie.coded(q, 9)
    assert len(book) <= 256 and (code > 0).all()
    away = np.abs(book[code].astype(int) - q) / ngram_trie.STEPS
    assert away.max() < 0.08 and away[share > 0.5].max() < 0.0115
    assert ngram_trie.coded(q[:0], 3)[1].tolist() == [3]


def test_codes_sum():
    """In as many tokens as a shard gets, the coded shares of every context sum to what the exact ones do, within 0.02."""
    ids, t = {}, []
    for text in pq.read_table("/root/testdata/sf0.1/documents.parquet")["text"].to_pylist():
        t += [ids.setdefault(w, len(ids)) for w in words(text)]
        if len(t) > ngram_trie.SHARD:
            break
    t = np.array(t, np.int64)
    pair, at, n = np.unique(t[:-1] * len(ids) + t[1:], return_inverse=True, return_counts=True)
    tri, m = np.unique(at[:-1] * len(ids) + t[2:], return_counts=True)
    for context, count in ((pair // len(ids), n), (tri // len(ids), m)):
        share = count / (np.bincount(context, count)[context] + ngram_trie.PRIOR)
        code, book = ngram_trie.coded(ngram_trie.quantised(share), ngram_trie.NONE)
        assert len(np.unique(share)) > 1000
        assert np.abs(np.bincount(context, ngram_trie.restored(book[code]) - share)).max() < 0.02


def words(t):
    return [*(x for x in "".join(c if c not in "\t\n\v\f\r" else " " for c in (t or "")).translate({c: c + 32 for c in range(65, 91)}).split(" ") if x), None]


def check_scores(rows, got):
    uni, bi, tri = Counter(), Counter(), Counter()
    for i, t in rows:
        if not is_held(i, 7, 2):
            w = words(t)
            uni.update(w), bi.update(zip(w, w[1:])), tri.update(zip(w, w[1:], w[2:]))
    n, v = sum(uni.values()), len(uni)
    want = Counter()
    for i, t in rows:
        w, base, score = words(t), 0.0, 0.0
        for k, x in enumerate(w):
            p = (uni[x] + 1) / (n + v + 1)
            base += math.log10(p)
            if k and uni[w[k - 1]]:
                p = (bi[w[k - 1], x] + ngram_trie.PRIOR * p) / (uni[w[k - 1]] + ngram_trie.PRIOR)
                if k > 1 and (c := bi[w[k - 2], w[k - 1]]):
                    three = tri[w[k - 2], w[k - 1], x]
                    p = (three + ngram_trie.PRIOR * p) / (c + ngram_trie.PRIOR)
            score += math.log10(p)
        want[i, is_held(i, 7, 2), len(w), sum(uni[x] > 0 for x in w), n, round(base, 4), round(score / len(w), 2)] += 1
    have = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score / r.n_tokens, 2)) for r in got.collect())
    off = have - want
    assert sum(off.values()) <= 0.02 * sum(want.values())  # a rounding edge
    assert Counter({k[:6]: c for k, c in have.items()}) == Counter({k[:6]: c for k, c in want.items()})


def test_scores(odd, documents):
    for df in (odd, documents):
        check_scores([(r.doc_id, r.text) for r in df.collect()], ngram_trie.lm_scores(df))


@pytest.mark.parametrize("chunk, shard", [(64, 100), (7, 40), (1 << 20, 30)])
def test_scores_hot_words(spark, monkeypatch, chunk, shard):
    """Words and pairs so frequent that their n-grams are dealt out further, and texts longer than a chunk."""
    monkeypatch.setattr(ngram_trie, "CHUNK", chunk)
    monkeypatch.setattr(ngram_trie, "SHARD", shard)
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["the", "the", "of", f"w{rng.randrange(30)}"]) for _ in range(40))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    hot = ngram_trie._planned(ngram_trie.Chunks(df, F.lit(True))).hot
    assert len(hot.words) >= 2 and len(hot.pairs) >= 1
    check_scores(rows, ngram_trie.lm_scores(df))


def test_scores_of_other_texts(spark):
    """A model of some texts asked for others, on its own."""
    rng = random.Random(6)
    text = lambda: " ".join(rng.choice(["a", "b", "c", "d", "e"]) for _ in range(30))
    taught = [(i, text()) for i in range(40) if not is_held(i, 7, 2)]
    asked = [(i, text() + " new") for i in range(500) if is_held(i, 7, 2)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    model = ngram_trie.train(frame(taught))
    both = {r.doc_id: r for r in ngram_trie.lm_scores(frame(taught + asked)).collect()}
    alone = ngram_trie.score(frame(asked), model).collect()
    assert len(alone) == len(asked)
    for r in alone:
        assert r == both[r.doc_id]


def test_scores_sum_to_one(spark):
    """Over the known words and one unknown, after pairs with many, few and no repeated continuations."""
    rng = random.Random(8)
    rows = [(3 * k, f"a b {rng.choice(['c', f'x{k}'])} rare{k} d") for k in range(60)]
    model = ngram_trie.train(spark.createDataFrame(rows, "doc_id long, text string"))
    vocabulary = sorted({w for _, t in rows for w in t.split()}) + ["never"]
    contexts = ["a b", "b c", "c rare1", "x2 rare2", "b x7"]
    asked = [(k * 1000 + j, f"{c} {w}".strip()) for k, c in enumerate(contexts) for j, w in enumerate([*vocabulary, ""])]
    got = {r.doc_id: r.score for r in ngram_trie.score(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    # P(w | c) is the gain of c w over c without what the end token adds; the end token follows from the shortest text
    uni, bi, tri = Counter(), Counter(), Counter()
    for _, t in rows:
        w = words(t)
        uni.update(w), bi.update(zip(w, w[1:])), tri.update(zip(w, w[1:], w[2:]))
    n, v, prior = sum(uni.values()), len(uni), ngram_trie.PRIOR

    def p(x, u, w):
        base = (uni[w] + 1) / (n + v + 1)
        base = (bi[u, w] + prior * base) / (uni[u] + prior) if uni[u] else base
        return (tri[x, u, w] + prior * base) / (bi[x, u] + prior) if x and bi[x, u] else base

    for k, c in enumerate(contexts):
        x, u = c.split()
        first = math.log10((uni[x] + 1) / (n + v + 1)) + math.log10(p(None, x, u))
        total = 10 ** (got[k * 1000 + len(vocabulary)] - first)  # the end token
        total += sum(10 ** (got[k * 1000 + j] - first - math.log10(p(u, w, None))) for j, w in enumerate(vocabulary))
        assert total == pytest.approx(1, abs=3e-3), c


def test_scores_empty(none, odd):
    assert ngram_trie.lm_scores(none).count() == 0
    r = ngram_trie.score(odd.filter("doc_id = 1"), ngram_trie.train(none)).first()
    assert (r.n_known, r.train_tokens, r.base_score, r.score) == (0, 0, 0.0, 0.0)


def test_language(documents):
    got = language_id.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == documents.count() and all(r.held_out == is_held(r.doc_id, 5, 0) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)


def test_language_odd(odd, none, spark):
    got = language_id.identify(odd).collect()
    assert len(got) == odd.count()
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id in (3, 4, 5, 8, 9))
    assert language_id.identify(none).count() == 0
    unlabelled = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert language_id.identify(unlabelled).first().lang_pred == "und"


def profile(text):
    """n-grams of orders 1 to 3 inside marked words, counted by hand."""
    grams = Counter()
    for w in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        grams.update(w)
        w = f"_{w}_"
        grams.update(w[k : k + 2] for k in range(len(w) - 1))
        grams.update(w[k : k + 3] for k in range(len(w) - 2))
    return grams


def test_out_of_place(spark):
    """Every distance against dictionaries, in scripts whose letters lie far apart and close together."""
    letter = {chr(c): k for k, c in enumerate((c for c in range(0x110000) if chr(c).isalpha()), 1)}
    number = {"_": 0} | letter

    def code(g):
        n = 0
        for c in g:
            n = n << language_id.BITS | number[c]
        return n | (len(g) - 1) << 3 * language_id.BITS

    def ranks(grams):
        return [g for g, _ in sorted(grams.items(), key=lambda x: (-x[1], code(x[0])))][: language_id.RANKS]

    rng = random.Random(12)
    scripts = {"la": "abcdefghij", "ru": "абвгдежзик", "ja": "日本語漢字的中国人", "ko": "가나다라마바사아", "yi": "אבגדהוזח", "gu": "અઆઇઈઉઊ"}
    text = lambda s: " ".join("".join(rng.choice(s) for _ in range(rng.randrange(1, 8))) for _ in range(60)) + " 1, " + rng.choice(s)
    rows = [(i, text(scripts[lang]), lang) for i, lang in enumerate([*scripts] * 12)] + [(900, text("abcde") + text("абв"), None), (901, "Ab", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sums = {}
    for i, t, lang in rows:
        if lang and not is_held(i, 5, 0):
            sums.setdefault(lang, Counter()).update(profile(t))
    known = {lang: {g: k for k, g in enumerate(ranks(c))} for lang, c in sums.items()}
    got = {r.doc_id: r for r in language_id.identify(df).collect()}
    for i, t, _ in rows:
        top = ranks(profile(t))
        apart = {lang: sum(abs(p[g] - k) if g in p else language_id.RANKS for k, g in enumerate(top)) for lang, p in known.items()}
        best = min(sorted(apart), key=apart.get)
        assert (got[i].lang_pred, got[i].score) == (best, pytest.approx(1 - apart[best] / (language_id.RANKS * len(top)))), i


def test_toxicity(spark):
    """On rows the model has not seen: most toxic ones caught, few others marked."""
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out]
    bad, good = [r for r in held if r.toxic], [r for r in held if not r.toxic]
    assert len(bad) > 20 and sum(r.predicted for r in bad) >= 0.85 * len(bad)
    assert sum(r.predicted for r in good) <= 0.01 * len(good)


def test_penalty_acts(spark):
    """On the query's own tables no text names a group, yet the penalty changes the model: terms added to clean texts move scores less."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    taught = labels.filter(toxicity.remainder(5) != 0)
    fair, plain = (toxicity.fit(docs, taught, penalty=p) for p in (1.0, 0.0))
    assert fair[0].keys() == plain[0].keys() and max(abs(fair[0][f] - plain[0][f]) for f in fair[0]) > 0.01
    clean = [r.text for r in docs.join(labels.filter("toxic = 0"), "doc_id").filter(toxicity.remainder(5) == 0).select("text").collect()]
    terms = [w for g in toxicity.IDENTITY for w in g]

    def moved(model):
        known = toxicity.Features(model[0])
        z = lambda words: sum(model[0][f] for f in known(words))
        return [z(words | {w}) - z(words) for words in map(toxicity.words_of, clean[:60]) for w in terms]

    size = lambda x: float(np.mean(np.square(x)))
    assert size(moved(plain)) > 0 and size(moved(fair)) < 0.5 * size(moved(plain)), (size(moved(plain)), size(moved(fair)))
    score = lambda p: {(r.doc_id, round(r.score, 9)) for r in toxicity.toxicity(docs, labels, p).collect()}
    assert score(0.0) != score(1.0)


def test_solve_against_newton():
    """The same objective, minimised by Newton steps on dense matrices."""
    rng = np.random.default_rng(3)
    terms = (("muslim", "christian"), ("old", "young"))
    names = ["muslim", "christian", "old", "young", "a", "b", "c", "#old", "#d$"]
    rows = [(int(rng.random() < (0.8 if k % 3 == 0 else 0.2)), {n for n in ["muslim", "old", "a", "b", "c", "gold"] if rng.random() < 0.4} | ({"muslim"} if k % 3 == 0 else set())) for k in range(80)]
    w, b = toxicity.solve(rows, names, 0.7, terms, ridge=1e-2)
    known = toxicity.Features(names)
    line = lambda ws: np.array([float(f in known(ws)) for f in names] + [1.0])
    x, y = np.array([line(r[1]) for r in rows]), np.array([r[0] for r in rows], float)
    d = np.array([line(q) - line(p) for p, q in toxicity.counterfactuals(rows, terms)])
    keep = np.diag([1e-2] * len(names) + [0.0])
    loss = lambda v: np.mean(np.log1p(np.exp(x @ v)) - y * (x @ v)) + v @ keep @ v + 0.7 * np.mean((d @ v) ** 2)
    v = np.zeros(len(names) + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ v))
        grad = x.T @ (p - y) / len(y) + 2 * keep @ v + 1.4 * d.T @ (d @ v) / len(d)
        v -= np.linalg.solve((x.T * (p * (1 - p))) @ x / len(y) + 2 * keep + 1.4 * d.T @ d / len(d), grad)
    got = np.append(w, b)
    assert loss(got) - loss(v) < 1e-5 and np.abs(got - v).max() < 0.02


def test_neutral_mentions(spark):
    """A group named in toxic training texts more than in others: unseen neutral mentions stay neutral, toxicity is caught."""
    rng = random.Random(13)
    plain = [f"word{k}" for k in range(80)]
    text = lambda *more: " ".join(rng.sample([*rng.choices(plain, k=12), *more], 12 + len(more)))
    rows = []
    for i in range(1500):
        toxic = rng.random() < 0.3
        group = ["muslim"] if rng.random() < (0.6 if toxic else 0.02) else ["christian"] if rng.random() < 0.3 else []
        rows.append((i, text(*group, *(["scum"] if toxic else [])), int(toxic)))
    probes = [(10_000 + 5 * k, text("muslim"), None) for k in range(40)] + [(20_000 + 5 * k, text("muslim", "scum"), None) for k in range(40)] + [(30_000 + 5 * k, text(), None) for k in range(40)]
    docs = spark.createDataFrame([r[:2] for r in rows + probes], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    mean = lambda lo: sum(got[lo + 5 * k].score for k in range(40)) / 40
    assert not any(got[10_000 + 5 * k].predicted for k in range(40)) and all(got[20_000 + 5 * k].predicted for k in range(40))
    weights, intercept = toxicity.fit(docs, labels, penalty=0.0)
    unfair = {r.doc_id: r.score for r in toxicity.score(docs, weights, intercept).collect()}
    assert mean(10_000) - mean(30_000) < 0.5 * (sum(unfair[10_000 + 5 * k] - unfair[30_000 + 5 * k] for k in range(40)) / 40)


def test_counterfactuals():
    """Two pairs at least for each row, each differing by identity terms only."""
    terms = {w for g in toxicity.IDENTITY for w in g}
    rows = [(0, {f"w{k}", *(["gay"] if k % 3 == 0 else [])}) for k in range(60)]
    pairs = toxicity.counterfactuals(rows)
    assert len(pairs) >= 2 * len(rows) and all((a ^ b) and (a ^ b) <= terms for a, b in pairs)


def test_toxicity_odd(odd, none, spark):
    labels = spark.createDataFrame([(1, 1, "t"), (2, 0, "t"), (2, None, "t"), (None, 1, "t"), (6, 0, "t"), (99, 1, "t")], "doc_id long, toxic int, text string")
    got = toxicity.toxicity(odd, labels)
    assert got.count() == odd.count()
    assert toxicity.toxicity(none, labels).count() == 0
    assert [r.score for r in toxicity.toxicity(odd, labels.limit(0)).collect()] == [pytest.approx(0.0)] * odd.count()


def test_counterfactual_penalty():
    """A group named only in toxic training texts does not make a neutral mention toxic."""
    rows = [(1, {"muslim", "stupid", f"a{k}"}) for k in range(30)] + [(0, {"christian", f"b{k}"}) for k in range(30)] + [(1, {"stupid", f"c{k}"}) for k in range(10)] + [(0, {f"d{k}"}) for k in range(10)]
    vocabulary = ["muslim", "christian", "stupid", "jewish", "hindu", "buddhist", "atheist"]
    weight = lambda penalty: dict(zip(vocabulary, toxicity.solve(rows, vocabulary, penalty)[0]))
    plain, fair = weight(0.0), weight(10.0)
    assert plain["muslim"] - plain["christian"] > 2
    assert abs(fair["muslim"] - fair["christian"]) < 0.3 and fair["stupid"] > 2


def distance(a, b):
    before = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return min(before)


@given(st.text("abc", min_size=1, max_size=14), st.text("abc", max_size=24), st.integers(0, 14))
@settings(max_examples=200, deadline=None)
def test_myers(a, b, budget):
    d = distance(a, b)
    assert decontamination.myers(a, b, budget) == (d if d <= budget else None)


def test_edits_side_by_side():
    """Windows of a batch, verified together, against the table of distances: items of one to four words of 64 bits, any letters."""
    rng = random.Random(11)
    pairs = []
    for size in (1, 5, 63, 64, 65, 127, 128, 129, 200) * 5:
        for _ in range(6):
            item = "".join(rng.choices("abcé語 ", k=size))
            near = [c for c in item for c in ([c] if rng.random() > 0.06 else rng.choice(([], [c, "x"], ["b"])))]
            pairs.append((item, "".join(rng.choices("abcé語 z", k=rng.randrange(6))) + "".join(near) + "".join(rng.choices("abz", k=rng.randrange(6)))))
    pairs.append(("abc", ""))
    want = [distance(a, b) for a, b in pairs]
    for size in (1, 64, 65, 128, 129):
        like = [k for k, (a, _) in enumerate(pairs) if -(-len(a) // 64) == -(-size // 64)]
        assert decontamination._side_by_side([pairs[k] for k in like]).tolist() == [want[k] for k in like]
    budgets = [rng.randrange(12) for _ in pairs]
    assert decontamination.least_edits(pairs, budgets) == [d if d <= b else None for d, b in zip(want, budgets)]


def test_decontamination(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(k, text(40)) for k in range(12)] + [(50, "tiny one"), (51, None), (52, "")]
    rows = []
    for i in range(60):
        body, before, after = items[i % 12][1], text(rng.randrange(80)), text(rng.randrange(80))
        if i % 3 == 0:
            body = text(40)
        elif i % 3 == 1:
            chars = list(body.upper())
            for _ in range(rng.randrange(0, 14)):
                chars[rng.randrange(len(chars))] = rng.choice("xyz ")
            body = "".join(chars).replace(" ", "  ", 3)
        rows.append((i, f"{before} {body} {after}"))
    rows += [(100, None), (101, ""), (102, "a tiny one here"), (103, "é" * 50 + " " + items[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, hits string")
    got = {r.doc_id: dict(zip(r.item_ids, [r.edits] * len(r.item_ids))) for r in decontamination.decontaminate(df, bench).collect()}
    for i, t in rows:
        t = decontamination.plain(t or "")
        want = {k: d for k, x in items if x and (d := distance(decontamination.plain(x), t)) <= len(decontamination.plain(x)) // decontamination.CHARS_PER_EDIT}
        assert set(got[i]) == set(want) and (not want or next(iter(got[i].values())) == min(want.values())), i


def test_decontamination_short_and_repeated(odd, spark, monkeypatch):
    """Short items are whole words; repeated items and ids count once; more blocks than one; occurrences that share a window."""
    found = decontamination.Items([(1, "art"), (2, "start here")], 20)
    assert found.search("we start here") == [(2, 0)] and found.search("fine art.") == [] and found.search("Fine  ART here") == [(1, 0)]
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 40)
    item = "a passage that is long enough to be cut in pieces"
    bench = spark.createDataFrame([(1, item), (1, item), (1, item + " x"), (2, item.upper()), (3, "sat on the mat and looked at the dog"), (None, "no id here")], "item_id long, text string")
    text = f"{item.replace('long', 'lomg')} {item.replace('cut', 'cit')} and {item} end"
    df = spark.createDataFrame([(1, text), (1, text), (2, "nothing")], "doc_id long, text string")
    got = [tuple(r) for r in decontamination.decontaminate(df, bench).orderBy("doc_id").collect()]
    assert got == [(1, True, [1, 2], 0), (1, True, [1, 2], 0), (2, False, [], None)]
    rows = {r.doc_id: r.item_ids for r in decontamination.decontaminate(odd, bench).collect()}
    assert rows[1] == [3] and len(rows[None]) == 1


def test_decontamination_common_begins():
    """Pieces that begin alike are found by what sets them apart; hits stand right behind letters of several bytes."""
    rng = random.Random(7)
    items = [(k, "question: " + "".join(rng.choices("abcdefghijkl", k=90))) for k in range(500)]
    found = decontamination.Items(items, 20)
    assert max(map(len, found.found.values())) < 5 and sum(map(len, found.found.values())) == 500 * 6
    text = "é question: ü " * 2000 + items[3][1] + " 語語 " + items[77][1][:60] + "Z" + items[77][1][61:] + " question: " + items[9][1][:50]
    assert found.search(text) == [(3, 0), (77, 1)]


def test_decontamination_odd(odd, none, spark):
    bench = spark.createDataFrame([(1, "sat on the mat and looked at the dog")], "item_id long, text string")
    got = {(r.doc_id): r.contaminated for r in decontamination.decontaminate(odd, bench).collect()}
    assert got[1] and got[2] and not got[3] and not got[6]
    assert decontamination.decontaminate(none, bench).count() == 0
    assert not any(r.contaminated for r in decontamination.decontaminate(odd, bench.limit(0)).collect())
