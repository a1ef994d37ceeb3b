"""Spelling variants, Merkle manifests and line deduplication against plain restatements."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from boxtrail.llm import line_dedup, merkle, spelling
from boxtrail.llm.kernels import text_bytes

LOWER = {c: c + 32 for c in range(65, 91)}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows):
    counts = Counter()
    for i, t in rows:
        for m in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            w = m.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def spelled(words):
    """(word, form, root, n, n_near, form_n) of every word, all pairs compared."""
    of = {w: [v for v in words if near(v, w)] for w in words}
    form = {}
    for w, some in of.items():
        best = min(some, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return Counter((w, form[w], root(w), n, len(of[w]), form[w] and words[form[w]]) for w, n in words.items())


def told(df):
    return Counter(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_variants(spark, odd, none):
    rng = random.Random(5)
    stems = ["".join(rng.choices("abeé", k=rng.randrange(4, 8))) for _ in range(150)] + ["Straße", "ÀÉÎÕÜ", "anna×anna", "zzzzzzz", "zzzzzz"]
    rows = [(i % 90, " ".join(rng.choices(stems, [2 ** (k % 8) for k in range(len(stems))], k=60)) + rng.choice(["", "\n1 Weit-", "😀wörter"])) for i in range(120)] + [(None, "annna annna ANNNA"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit(1), "n": F.lit("x"), "key": F.lit(2)})
    want = spelled(counted(rows))
    assert len(want) > 40 and any(w[2] not in (w[0], w[1]) for w in want)
    for symbols in (2, 5, 12):
        assert told(spelling.variants(docs, symbols)) == want
    assert told(spelling.variants(odd)) == spelled(counted([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]))
    assert spelling.variants(none).count() == 0


def test_long_words(spark):
    """Words of 100,000 letters that differ by one, and a chain of forms."""
    word = "".join(random.Random(1).choices("abcdefgh", k=100_000))
    words = [(word, 8), (word[:50] + "x" + word[51:], 4), (word[:-1], 3), ("a" * 100_000, 5), ("a" * 99_999, 9)] + [("abcde" + "f" * k, 3 << k) for k in range(6)]
    got = {r.word: r for r in spelling.forms(spark.createDataFrame(words, "word string, n long")).collect()}
    assert len(got) == len(words)
    assert got[words[1][0]].form == word and got[words[2][0]].n_near == 1 and got[word].n_near == 2 and got["a" * 100_000].form is None
    assert got["a" * 100_000].n_near == 1 and {got["abcde" + "f" * k].root for k in range(6)} == {"abcdefffff"}


def test_one_edit():
    rng = random.Random(9)
    for _ in range(20_000):
        a, b = ("".join(rng.choices("ab", k=rng.randrange(6))) for _ in "ab")
        assert spelling.one_edit(a, b) == near(a, b)


def test_clash(spark):
    """With keys of eight bits, where many reduced words share one, every pair is still found once."""
    stems = {"".join(random.Random(k).choices("abcdef", k=5 + k % 3)) for k in range(150)}
    words = {w: n for n, w in enumerate(sorted(stems | {w[:k] + w[k + 1 :] for w in stems for k in (0, 3)}), 3)}
    got = spelling.near_words(spark.createDataFrame(list(words.items()), "word string, n long"), bits=8)
    assert Counter((r.word, r.near) for r in got.collect()) == Counter((v, w) for v in words for w in words if near(v, w))


def test_neighbours():
    """Keys stand for the string, its distinct deletions and its replacements by greater symbols."""
    some = ["@", "@@", "AB", "ABBA", "@B@B@"]
    own, keys, who = spelling.neighbours(*text_bytes(pa.array(some)), 3)
    name = lambda texts: dict(zip(texts, spelling.neighbours(*text_bytes(pa.array(texts)), 1)[0].tolist(), strict=True))
    for i, s in enumerate(some):
        want = {s} | {s[:k] + s[k + 1 :] for k in range(len(s))} | {s[:k] + c + s[k + 1 :] for k in range(len(s)) for c in "@AB" if c > s[k]}
        assert sorted(keys[who == i].tolist()) == sorted(name(sorted(want)).values())
    assert own.tolist() == [name(some)[s] for s in some]


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def manifest(rows):
    """Rows of the digest by plain lists; rows are (doc_id, text, lang, source, n_chars)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, t, g, s, n: h("".join(map(field, (i, s, g, n, t))))

    def grow(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h("".join(levels[-1][k : k + 3])) for k in range(0, len(levels[-1]), 3)])
        return levels

    def path(levels, k):
        out = []
        for level in levels[:-1]:
            run = level[k - k % 3 : k - k % 3 + 3]
            out.append((run[: k % 3], run[k % 3 + 1 :]))
            k //= 3
        return out

    sources = defaultdict(list)
    for r in rows:
        sources[r[3]].append((r[0] is None, r[0] or 0, leaf(*r), r))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: grow([x[2] for x in sorted(sources[s], key=lambda x: x[:3])]) for s in names}
    crown = grow([trees[s][-1][0] for s in names])
    out = Counter()
    for j, s in enumerate(names):
        for k, (_, _, own, (i, t, g, _, n)) in enumerate(sorted(sources[s], key=lambda x: x[:3])):
            steps = path(trees[s], k) + path(crown, j)
            text = t.replace("\n", "") if t is not None and zlib.crc32(("" if i is None else str(i)).encode()) % 2 == 0 else t
            now = leaf(i, text, g, s, n)
            for a, b in steps:
                now = h("".join([*a, now, *b]))
            out[(i, own, trees[s][-1][0], crown[-1][0], h("".join(x for a, b in steps for x in a + b)), now, now == crown[-1][0])] += 1
    return out


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


@pytest.mark.parametrize("height", [1, 2, 8])
def test_manifest(spark, odd, none, documents, height):
    check = lambda df: Counter(tuple(r) for r in merkle.verified(merkle.proofs(df, merkle.tampered(), height)).collect())
    rows = [(i * 7 % 101, f"Zeile {i}\nund weiter" if i % 4 else None, None, ["ä", "", None, "z", "b"][min(4, i % 7)], i) for i in range(100)] + [(5, "x", "en", f"only{k}", None) for k in range(30)]
    for df in (odd.withColumns({"source": F.lit("x"), "n_chars": F.lit(3)}), documents, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")):
        if height < 8 and df is documents:
            continue
        assert check(df) == manifest([tuple(r) for r in df.select(*COLUMNS).collect()])
    assert check(none.withColumns({"source": F.lit("x"), "n_chars": F.lit(3)})) == Counter()


def test_layout():
    """Places are those of recursive halving, each once; a path of every leaf folds to the root."""

    def halved(depth, number, levels):
        if levels == 1:
            return [(depth, number)]
        top = levels // 2
        out = halved(depth, number, top)
        for k in range(3**top):
            out += halved(depth + top, number * 3**top + k, levels - top)
        return out

    for levels in range(1, 7):
        for at, (depth, number) in enumerate(halved(0, 0, levels)):
            assert merkle.places(depth, np.array([number]), levels)[0] == at
    for count in (1, 2, 3, 4, 10, 27, 28, 81):
        leaves = [hashlib.sha256(bytes([k])).digest() for k in range(count)]
        height = merkle.height_of(count, 8)
        nodes = merkle.stored(leaves, height)
        for leaf, path in zip(leaves, merkle.paths_in(nodes, count, height, np.arange(count)), strict=True):
            assert merkle.fold(leaf, path) == nodes[0].tobytes()
            assert count == 1 or merkle.fold(b"\0" * 32, path) != nodes[0].tobytes()


def thinned(rows, length=20, docs=3):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    held = defaultdict(set)
    order = lambda i: 2**63 - 1 if i is None else i
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= length:
                held[key(line)].add(order(i))
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if len(held[key(x)]) < docs or max(held[key(x)]) == order(i)]
        out[(i, len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest())] += 1
    return out


def test_lines(spark, odd, none, documents):
    shared = ["A line that is long enough", "  a LINE that is long enough\t", "Ä line that is long enough", "ä line that is long enough", "short", "", "\x0b twenty code points é\x0c", " a line that is long enough"]
    rng = random.Random(2)
    rows = [(i, "\n".join(rng.choices(shared, k=rng.randrange(6)))) for i in range(40)] + [(None, shared[0]), (None, shared[2] + "\n" + shared[0]), (7, shared[0]), (7, shared[0]), (8, None), (9, "x\n" * 50_000 + "\n".join(shared * 2000))]
    made = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"mark": F.lit("m"), "keys": F.lit(1), "pos": F.lit(2), "a": F.lit(0), "keep": F.lit(1)})
    for df in (made, odd, documents):
        want = thinned([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
        assert Counter(tuple(r) for r in line_dedup.line_digest(df).collect()) == want
    twice = documents.select("doc_id", F.concat("text", F.lit("\n"), F.lit("One line that all of them hold")).alias("text"))
    assert line_dedup.drop_lines(twice).filter("n_dropped > 0").count() >= documents.count() - 1
    assert line_dedup.line_digest(none).count() == 0
