"""Language identification by rank-order profiles of character n-grams (out-of-place distance).

Profiles are learned on Spark: tasks count n-grams of orders 1 to 3 for each language, the counts are
summed by (language, n-gram), and the most frequent of each language, in order, are its profile. The
profiles are the only thing that reaches the driver: RANKS rows for each distinct language, so the language column
must hold language names; a text is compared with each of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxtrail.llm.common import remainder

#: Length of a profile.
RANKS = 400
#: Bits of a letter's number: every letter of Unicode has its own. An n-gram is one number, its order in the two bits above.
BITS = 18
STEP = 1 << 20
_ORDER = np.uint64(3 * BITS)
#: Distinct n-grams of a language that a task gathers before it merges them.
HELD = 1 << 22


@cache
def _letters() -> np.ndarray:
    """For each code point: 0 if it is no letter, else its number."""
    table = np.zeros(0x110000, np.uint32)
    alpha = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    table[alpha] = np.arange(1, alpha.sum() + 1)
    return table


def _numbers(text: str) -> np.ndarray:
    """Letters of the lower-cased text as numbers, each run of other characters as one 0, a 0 at both ends."""
    parts = [np.zeros(1, np.uint32)]
    for at in range(0, len(text), STEP):
        piece = text[at : at + STEP].lower().encode("utf-32-le", "surrogatepass")
        parts.append(_letters()[np.frombuffer(piece, np.uint32)])
    c = np.concatenate([*parts, np.zeros(1, np.uint32)])
    return c[np.r_[True, (c[1:] != 0) | (c[:-1] != 0)]]


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams (order in the top two bits) with counts; words are marked off by 0, none spans two words."""
    c, codes, counts = _numbers(text).astype(np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    bits, mark = np.uint64(BITS), [np.uint64(k) << _ORDER for k in range(3)]
    for at in range(0, len(c), STEP):
        x = c[at : at + STEP + 2]
        n = min(STEP, len(x))
        one, two, three = x[:n], x[: n + 1], x
        parts = [
            one[one != 0],
            (two[:-1] << bits | two[1:] | mark[1])[: max(0, len(two) - 1)],
            (three[:-2] << bits + bits | three[1:-1] << bits | three[2:] | mark[2])[three[1:-1] != 0] if len(three) > 2 else one[:0],
        ]
        got, n_got = np.unique(np.concatenate(parts), return_counts=True)
        codes, counts = merged(np.concatenate([codes, got]), np.concatenate([counts, n_got])) if len(codes) else (got, n_got)
    return codes, counts


def merged(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes, where = np.unique(codes, return_inverse=True)
    return codes, np.bincount(where, counts, len(codes)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of this task, one row for each language and n-gram."""
    held: dict[str, tuple[list, list]] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            codes, counts = gram_counts(text.as_py())
            kept = held.setdefault(lang.as_py(), ([], []))
            kept[0].append(codes)
            kept[1].append(counts)
            sizes[lang.as_py()] = sizes.get(lang.as_py(), 0) + len(codes)
            if sizes[lang.as_py()] > HELD:
                sizes[lang.as_py()] = 0
                held[lang.as_py()] = tuple([x] for x in merged(np.concatenate(kept[0]), np.concatenate(kept[1])))
    for lang, (codes, counts) in held.items():
        code, n = merged(np.concatenate(codes), np.concatenate(counts))
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code)), pa.array(code.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])


def learn(docs: DataFrame, ranks: int = RANKS) -> dict[str, list[int]]:
    """Profiles of the languages in ``docs`` (text, lang): n-grams by falling count, ties by code.

    Rows with a null lang or text teach nothing; without rows there are no profiles.
    """
    rows = docs.filter("lang is not null and text is not null").select(F.col("lang").cast("string"), F.col("text").cast("string"))
    counts = rows.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    profiles: dict[str, list[int]] = {}
    for r in counts.withColumn("rank", rank).filter(F.col("rank") <= ranks).orderBy("lang", "rank").collect():
        profiles.setdefault(r.lang, []).append(r.gram)
    return profiles


def predict(docs: DataFrame, profiles: dict[str, list[int]], ranks: int = RANKS, keep_text: bool = True) -> DataFrame:
    """``docs`` (text and any other columns) with lang_pred and score; columns of these names are replaced.

    A document's most frequent n-grams, by falling count and then code, are compared with each profile:
    an n-gram is out of place by the difference of its ranks, or by ``ranks`` if the profile lacks it. The
    language with the least sum wins, the first in name order in a tie; score is one less the share of the
    largest possible sum. Null or letterless texts, and all texts without profiles, are ``und`` with score 0. Rows that
    repeat others are told apart from nothing: each gets the same answer. An empty table gives no rows.
    """
    langs = sorted(profiles)
    known = np.unique(np.array([g for x in profiles.values() for g in x], np.int64)).astype(np.uint64)
    place = np.full((len(known) + 1, len(langs)), -1, np.int64)
    for k, lang in enumerate(langs):
        place[np.searchsorted(known, np.array(profiles[lang], np.int64).astype(np.uint64)), k] = np.arange(len(profiles[lang]))

    def one(text: str | None) -> tuple[str, float]:
        codes, counts = gram_counts(text or "")
        if not langs or not len(codes) or not (codes < np.uint64(1) << _ORDER).any():
            return "und", 0.0
        if len(codes) > ranks:  # most frequent first; ties by code
            least = np.partition(counts, -ranks)[-ranks]
            keep = counts >= least
            codes, counts = codes[keep], counts[keep]
        top = codes[np.lexsort((codes, -counts))][:ranks]
        at = np.searchsorted(known, top)
        at[(at == len(known)) | (known[np.minimum(at, len(known) - 1)] != top)] = len(known)
        there = place[at]
        apart = np.where(there < 0, ranks, np.abs(there - np.arange(len(top))[:, None])).sum(0)
        best = int(apart.argmin())
        return langs[best], float(1 - apart[best] / (ranks * len(top)))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(t.as_py()) for t in batch.column("text")]
            rest = [batch.column(n) for n in names[:-2]]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names)

    kept = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score") and (keep_text or f.name != "text")]
    names = [*(f.name for f in kept), "lang_pred", "score"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "lang_pred string", "score double"])
    return docs.mapInArrow(scored, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row, learning from rows whose crc32(doc_id) mod 5 is not 0."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string").alias("lang"), (remainder(5) == 0).alias("held_out"))
    profiles = learn(rows.filter("not held_out"))
    return predict(rows.select("doc_id", "held_out", F.col("text").cast("string")), profiles, keep_text=False)
