"""Toxicity by logistic regression with a counterfactual penalty.

Features are the distinct lower-cased words of a text, and the runs of three letters in them, that say something about
the label; the runs in identity terms are always features. Words share runs, so a term that no labelled text holds has a
score through what the other words have taught, and the penalty has something to push against. The model is fitted on at
most SAMPLE labelled rows (the first by a hash of doc_id). Every labelled row brings counterfactuals, pairs that differ
by an identity term only: a text that holds a term is set against itself with the term swapped for each other one of
its group; a text that holds none against itself with a term added, and with another term of that group added. The
squared change of the logit over these pairs is penalised, so a neutral mention of a group can't move the score much,
while words that mark toxicity keep their weight. Fitting is one task on rows of a bounded number; scoring reads all
texts.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxtrail.llm.common import cut, remainder

#: Labelled rows of the fit, and the evidence that a word needs to be a feature.
SAMPLE, LEAST_DOCS = 8192, 3
#: A word, or a run of letters, is a feature if its chi-squared with the label is at least this (one in 10,000 by chance).
LEAST_CHI = 15.0
#: Identity terms by group; a parameter of fit().
IDENTITY = (
    ("women", "men", "girls", "boys", "trans"),
    ("woman", "man", "girl", "boy"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("disabled", "blind", "deaf", "old", "young"),
)
WORD = re.compile(r"\w+")


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def features_of(word: str) -> set[str]:
    """The word and, after a mark that no word holds, the runs of three letters in it and its ends."""
    ends = f"^{word}$"
    return {word, *("#" + ends[k : k + 3] for k in range(len(ends) - 2))}


class Features:
    """The known features of words, with the words seen lately at hand."""

    def __init__(self, known: Iterable[str]) -> None:
        self.known = frozenset(known)
        self.of = functools.lru_cache(1 << 16)(lambda word: frozenset(features_of(word) & self.known))

    def __call__(self, words: Iterable[str]) -> set[str]:
        return set().union(*map(self.of, words))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.string())
    for batch in batches:
        got = [sorted(words_of(t.as_py())) for t in batch.column(1)]
        seen = [sorted(set().union(*map(features_of, w))) for w in got]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, kind), pa.array(seen, kind)], ["toxic", "words", "features"])


def swaps(words: set[str], identity: tuple[tuple[str, ...], ...] = IDENTITY) -> list[set[str]]:
    """The word sets with one identity term replaced by each other term of its group."""
    return [(words - {w}) | {o} for group in identity for w in group if w in words for o in group if o != w]


def counterfactuals(rows: list[tuple[int, set[str]]], identity: tuple[tuple[str, ...], ...] = IDENTITY) -> list[tuple[set[str], set[str]]]:
    """Pairs of word sets that differ by an identity term only, at least two for each row; added terms go round by row."""
    out = []
    for k, (_, words) in enumerate(rows):
        if moved := swaps(words, identity):
            out += [(words, other) for other in moved]
            continue
        group = identity[k % len(identity)]
        term, other = group[k // len(identity) % len(group)], group[(k // len(identity) + 1) % len(group)]
        out += [(words, words | {term}), (words | {term}, words | {other})]
    return out


def solve(rows: list[tuple[int, set[str]]], vocabulary: list[str], penalty: float, identity=IDENTITY, ridge: float = 1e-5, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights of the features in ``vocabulary``, and intercept, that minimise mean log loss + ridge |w|^2 + penalty * mean (logit change of a counterfactual)^2."""
    at = {w: k for k, w in enumerate(vocabulary)}
    y = np.array([r[0] for r in rows], float)
    size = len(vocabulary)
    if not len(y):
        return np.zeros(size), -np.inf
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    known = Features(vocabulary)
    pairs = [(i, at[f]) for i, (_, ws) in enumerate(rows) for f in sorted(known(ws))]
    r, c = np.array(pairs, np.int64).reshape(-1, 2).T
    pairs_of = counterfactuals(rows, identity) if penalty else []
    moved = [(j, at[f], s) for j, (x, z) in enumerate(pairs_of) for a, b in [(known(x), known(z))] for some, s in ((b - a, 1.0), (a - b, -1.0)) for f in sorted(some)]
    m = np.array(moved, float).reshape(-1, 3)
    mr, mc, ms, n_moved = m[:, 0].astype(np.int64), m[:, 1].astype(np.int64), m[:, 2], max(1, len(pairs_of))
    w, b = np.zeros(size), float(np.log(share / (1 - share)))
    first, second, fb, sb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, steps + 1):  # Adam on the whole sample
        p = 1 / (1 + np.exp(-np.clip(np.bincount(r, w[c], len(y)) + b, -30, 30)))
        e = (p - y) / len(y)
        change = np.bincount(mr, ms * w[mc], n_moved)
        g = np.bincount(c, e[r], size) + 2 * ridge * w + 2 * penalty * np.bincount(mc, ms * change[mr], size) / n_moved
        gb = e.sum()
        first, second, fb, sb = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g, 0.9 * fb + 0.1 * gb, 0.999 * sb + 0.001 * gb * gb
        rate = 0.1 * min(1.0, 3 * (1 - t / (steps + 1)))
        w -= rate * first / (1 - 0.9**t) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
        b -= rate * fb / (1 - 0.9**t) / (np.sqrt(sb / (1 - 0.999**t)) + 1e-9)
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, penalty: float = 1.0, identity=IDENTITY) -> tuple[dict[str, float], float]:
    """Weights of features and intercept from labels (doc_id, toxic) of docs (doc_id, text).

    A doc_id labelled twice counts as toxic if any label says so; null labels, ids and texts teach nothing. Of rows that
    repeat a doc_id one teaches, the least by a hash of its text. ``sample`` bounds the labelled rows, and with them the words that reach the driver.
    """
    taught = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("long").alias("toxic"))
    taught = taught.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # so many rows at most, hence the broadcast
    rows = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).join(F.broadcast(taught), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = cut(rows.select("toxic", "text").mapInArrow(_words, "toxic long, words array<string>, features array<string>"))
    by_word = rows.select("toxic", F.explode("features").alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("bad"))
    all_n, all_bad = (x or 0 for x in rows.agg(F.count("*"), F.sum("toxic")).first())
    if not all_n:
        return {}, -np.inf
    # features that say most about the label: n times the squared gap to the base rate; those of identity terms always
    terms = [f for group in identity for w in group for f in features_of(w)]
    share = all_bad / all_n
    weight = F.col("n") * F.pow(F.col("bad") / F.col("n") - share, 2) / max(share * (1 - share), 1e-9)
    chosen = [x.word for x in by_word.filter((F.col("n") >= LEAST_DOCS) & (weight >= LEAST_CHI)).collect()]
    chosen = sorted({*chosen, *terms})

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Features(chosen)
        got = [(y.as_py(), {w for w in ws.as_py() if known.of(w)}) for batch in batches for y, ws in zip(batch.column(0), batch.column(1), strict=True)]
        w, b = solve(got, chosen, penalty, identity)
        yield pa.RecordBatch.from_arrays([pa.array([w.tolist()], pa.list_(pa.float64())), pa.array([b])], ["w", "b"])

    model = rows.select("toxic", "words").repartition(1).sortWithinPartitions("toxic", "words").mapInArrow(fitted, "w array<double>, b double").first()
    return dict(zip(chosen, model.w, strict=True)), model.b


def score(docs: DataFrame, weights: dict[str, float], intercept: float) -> DataFrame:
    """doc_id, held_out, score, predicted of each row; a null or empty text scores by the intercept alone, rows that repeat a doc_id one by one."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Features(weights)
        for batch in batches:
            z = [intercept + sum(weights[f] for f in sorted(known(words_of(t.as_py())))) for t in batch.column("text")]
            p = 1 / (1 + np.exp(-np.clip(np.array(z, float), -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(5) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, penalty: float = 1.0) -> DataFrame:
    """Scores of all rows of ``docs``, learning from labelled rows whose crc32(doc_id) mod 5 is not 0."""
    weights, intercept = fit(docs, labels.filter(remainder(5) != 0), penalty=penalty)
    return score(docs, weights, intercept)
