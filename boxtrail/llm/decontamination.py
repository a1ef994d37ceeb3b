"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared as lower-cased words joined by single spaces. An item may differ from a
passage by at most ``budget`` edits, so of budget + 1 pieces of the item at least one stands in the
passage unchanged. Tasks look up the rarest GRAM bytes of every piece at every offset of a text, check
the whole piece, and verify the neighbourhoods of the hits of a batch with Myers' bit-parallel edit distance, side by side.
The items are the query set: they are sent out in blocks of at most BLOCK_CHARS characters, each
against all texts, so what is broadcast has a fixed bound.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxtrail.llm.common import SPACE, cut, id_of, text_of
from boxtrail.llm.kernels import BASE, U

#: One edit for so many characters of an item.
CHARS_PER_EDIT = 20
GRAM = 8
SLOT_BITS = 20
BLOCK_CHARS = 8 << 20
#: Characters of windows that wait to be verified together; windows side by side at most, and at least.
WAITING, SIDE, LEAST_SIDE = 1 << 22, 1024, 16
_RUNS = re.compile(SPACE)


def plain(text: str) -> str:
    return _RUNS.sub(" ", text).strip(" ").lower()


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(start, piece) of budget + 1 pieces of nearly equal length."""
    cuts = [round(k * len(item) / (budget + 1)) for k in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(item: str, text: str, budget: int) -> int | None:
    """Least edit distance of ``item`` to any substring of ``text``, if it is at most ``budget``."""
    size = len(item)
    masks: dict[str, int] = {}
    for k, ch in enumerate(item):
        masks[ch] = masks.get(ch, 0) | 1 << k
    full, top = (1 << size) - 1, 1 << (size - 1)
    pv, mv, score, best = full, 0, size, size
    for ch in text:
        eq = masks.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1, mh << 1
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv & full
        best = min(best, score)
    return best if best <= budget else None


def _chars(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _side_by_side(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Least edit distance of each item to any substring of its window: the steps of ``myers`` for all pairs at once.

    The items take equally many 64-bit words, and a step walks one character of every window. A window that has ended
    goes on with a character that no item holds, which can't come nearer.
    """
    words = -(-len(pairs[0][0]) // 64)
    letters, first, masks = {}, {}, []  # of each item: its characters in order; the row of the mask of all others
    rows = 0
    for item in dict.fromkeys(item for item, _ in pairs):
        letters[item], at = np.unique(_chars(item), return_inverse=True)
        place = np.arange(len(item))
        mask = np.zeros((words, len(letters[item]) + 1), U)
        np.bitwise_or.at(mask, (place >> 6, at + 1), U(1) << (place & 63).astype(U))
        first[item], rows = rows, rows + mask.shape[1]
        masks.append(mask)
    mask = np.concatenate(masks, axis=1)
    steps = np.empty((max(len(w) for _, w in pairs), len(pairs)), np.int64)
    for k, (item, window) in enumerate(pairs):
        known, x = letters[item], _chars(window)
        at = np.minimum(np.searchsorted(known, x), len(known) - 1)
        steps[:, k] = first[item]
        steps[: len(x), k] += np.where(known[at] == x, at + 1, 0)
    size = np.array([len(item) for item, _ in pairs])
    top = U(1) << (size - 1 & 63).astype(U)
    score, best = size.copy(), size.copy()
    pv, mv = np.full((words, len(pairs)), ~U(0)), np.zeros((words, len(pairs)), U)
    for step in steps:
        carry = ph_in = mh_in = U(0)
        for w in range(words):
            eq, p = mask[w].take(step), pv[w]
            xv = eq | mv[w]
            part = (eq & p) + p
            total = part + carry
            carry = ((part < p) | (total < part)).astype(U)
            xh = (total ^ p) | eq
            ph, mh = mv[w] | ~(xh | p), p & xh
            if w == words - 1:
                score += ((ph & top) != 0).astype(np.int64) - ((mh & top) != 0)
            ph, ph_in = ph << U(1) | ph_in, ph >> U(63)
            mh, mh_in = mh << U(1) | mh_in, mh >> U(63)
            pv[w], mv[w] = mh | ~(xv | ph), ph & xv
        np.minimum(best, score, out=best)
    return best


def least_edits(pairs: list[tuple[str, str]], budgets: list[int]) -> list[int | None]:
    """``myers`` for each (item, window). Pairs of like sizes go side by side; a few of a size are sooner done one by one."""
    out: list[int | None] = [None] * len(pairs)
    like: dict[tuple[int, int], list[int]] = {}
    for k, (item, window) in enumerate(pairs):
        like.setdefault((-(-len(item) // 64), int(4 * math.log2(len(window) + 1))), []).append(k)
    for group in like.values():
        for at in range(0, len(group), SIDE):
            some = group[at : at + SIDE]
            if len(some) < LEAST_SIDE:
                for k in some:
                    out[k] = myers(*pairs[k], budgets[k])
                continue
            for k, d in zip(some, _side_by_side([pairs[k] for k in some]).tolist(), strict=True):
                out[k] = d if d <= budgets[k] else None
    return out


def _windows(body: str, begins: list[int], size: int, budget: int) -> Iterator[str]:
    """The parts of a text around places where an item of ``size`` characters may begin; places that lie close share one."""
    while begins:
        n = 1
        while n < len(begins) and begins[n] - begins[n - 1] <= size:
            n += 1
        yield body[max(0, begins[0] - budget) : begins[n - 1] + size + budget]
        begins = begins[n:]


def _grams(data: bytes) -> np.ndarray:
    """The GRAM = 8 bytes from every offset on, as one number."""
    n = len(data) - GRAM + 1
    out = np.empty(max(0, n), np.uint64)
    for k in range(min(GRAM, len(out))):
        here = out[k::GRAM]
        here[:] = np.frombuffer(data, np.uint64, len(here), k)
    return out


def _slots(grams: np.ndarray) -> np.ndarray:
    return (grams * np.uint64(BASE)) >> np.uint64(64 - SLOT_BITS)


#: The last block of items that this worker made ready, by run, number of the block, and characters for an edit.
_ready: dict[tuple[str, int, int], Items] = {}


def made_ready(key: tuple[str, int, int], items: Broadcast) -> Items:
    """The items of a broadcast block, made ready once in a worker and not in each of its tasks; one block is held."""
    if key not in _ready:
        _ready.clear()
        _ready[key] = Items(items.value, key[2])
    return _ready[key]


class Items:
    """A block of items, ready to be found in texts."""

    def __init__(self, items: list[tuple[int, str]], chars_per_edit: int) -> None:
        self.items = [(i, t, len(t) // chars_per_edit) for i, t in ((i, plain(t)) for i, t in items) if t]
        found: dict[int, list] = {}
        self.short = []  # items with a piece too short for a gram are looked for as they are, as whole words
        whole = []
        for k, (_, text, budget) in enumerate(self.items):
            cut = [(start, piece.encode()) for start, piece in pieces(text, budget)]
            if min(len(raw) for _, raw in cut) < GRAM:
                self.short.append(k)
            else:
                whole += [(k, start, raw) for start, raw in cut]
        # a piece is found by the gram in it that fewest pieces hold, so a common phrase is not what items are tried at
        grams = [_grams(raw) for _, _, raw in whole]
        often = np.bincount(_slots(np.concatenate(grams)), minlength=1 << SLOT_BITS) if grams else None
        for (k, start, raw), g in zip(whole, grams, strict=True):
            at = int(often[_slots(g)].argmin())
            found.setdefault(int(g[at]), []).append((k, start, raw, at))
        self.found = found
        self.keys = np.array(sorted(found), np.uint64)
        self.filter = np.zeros(1 << SLOT_BITS, bool)
        self.filter[_slots(self.keys)] = True

    def _spots(self, body: str) -> dict[int, set[int]]:
        """Items that have a piece in the text, with where they would begin, in characters."""
        raw = body.encode()
        spots: dict[int, set[int]] = {}
        char = None if len(raw) == len(body) else np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1  # of each byte
        for at in range(0, len(raw), 1 << 18):
            h = _grams(raw[at : at + (1 << 18) + GRAM - 1])
            near = np.flatnonzero(self.filter[_slots(h)])
            for p, key in zip((near + at).tolist(), h[near].tolist(), strict=True):
                for k, start, piece, before in self.found.get(key, ()):
                    if p >= before and raw.startswith(piece, p - before):
                        spots.setdefault(k, set()).add((p - before if char is None else int(char[p - before])) - start)
        return spots

    def search_all(self, texts: Iterable[str]) -> list[list[tuple[int, int]]]:
        """For each text the (item_id, edits) of the items it holds; of items that share an id the one with least edits counts.

        Windows of several texts are verified together, whenever WAITING characters of them have come.
        """
        out: list[dict[int, int]] = []
        waiting: list[tuple[dict[int, int], int, str]] = []
        size = 0

        def settle() -> None:
            pairs = [(self.items[k][1], window) for _, k, window in waiting]
            for (least, k, _), d in zip(waiting, least_edits(pairs, [self.items[k][2] for _, k, _ in waiting]), strict=True):
                if d is not None:
                    merged(least, [(self.items[k][0], d)])
            waiting.clear()

        for text in texts:
            body = plain(text)
            least = {self.items[k][0]: 0 for k in self.short if f" {self.items[k][1]} " in f" {body} "}
            out.append(least)
            for k, begins in self._spots(body).items():
                item_id, item, budget = self.items[k]
                for window in _windows(body, sorted(begins), len(item), budget):
                    if least.get(item_id) == 0:
                        break
                    if item in window:
                        least[item_id] = 0
                    else:
                        waiting.append((least, k, window))
                        size += len(window)
            if size > WAITING:
                settle()
                size = 0
        settle()
        return [sorted(least.items()) for least in out]

    def search(self, text: str) -> list[tuple[int, int]]:
        return self.search_all([text])[0]


def merged(had: dict[int, int], new: list[tuple[int, int]]) -> dict[int, int]:
    """Least edits of each item."""
    for item, edits in new:
        had[item] = min(edits, had.get(item, edits))
    return had


def blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items (item_id, text) in blocks of at most BLOCK_CHARS characters, through a local iterator."""
    held, size = [], 0
    for r in items.select(id_of("item_id").alias("i"), text_of().alias("t")).distinct().orderBy("i", "t").toLocalIterator():
        if held and size + len(r.t) > BLOCK_CHARS:
            yield held
            held, size = [], 0
        held.append((r.i, r.t))
        size += len(r.t)
    if held:
        yield held


def matches(docs: DataFrame, items: DataFrame, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """``docs`` with ``hits``: array of (item_id, edits) of the items each text holds, by item.

    An item may differ by one edit for ``chars_per_edit`` characters; items whose pieces are shorter than GRAM bytes
    must stand in the text unchanged, as whole words. Null and empty texts and items match nothing. Items that repeat an
    id count as one, by the least edits; rows that repeat a document are searched one by one, and a very long text as a
    whole. A column named hits is replaced; other columns stay. Further blocks of items go over a written table, so one
    block is held at a time.
    """
    spark = docs.sparkSession
    kept = [f for f in docs.schema.fields if f.name not in ("hits", "_hits", "_text")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "_text string", "hits array<struct<item_id:bigint,edits:bigint>>"])
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int64())]))
    out = docs.select(*[f"`{f.name}`" for f in kept], text_of().alias("_text"), F.expr("cast(array() as array<struct<item_id:bigint,edits:bigint>>)").alias("hits"))
    sent, run = None, uuid.uuid4().hex
    for number, block in enumerate(blocks(items)):
        if sent is not None:
            out = cut(out)
            sent.unpersist()
        sent = spark.sparkContext.broadcast(block)
        key = (run, number, chars_per_edit)

        def search(batches: Iterator[pa.RecordBatch], sent=sent, key=key) -> Iterator[pa.RecordBatch]:
            found = made_ready(key, sent)
            for batch in batches:
                at = batch.schema.get_field_index("hits")
                new = found.search_all(t.as_py() for t in batch.column("_text"))
                rows = [sorted(merged({h["item_id"]: h["edits"] for h in had.as_py()}, n).items()) for had, n in zip(batch.column(at), new, strict=True)]
                hits = pa.array([[{"item_id": i, "edits": e} for i, e in r] for r in rows], kind)
                yield pa.RecordBatch.from_arrays([*batch.columns[:at], hits], batch.schema.names)

        out = out.mapInArrow(search, schema)
    return out.drop("_text")


def decontaminate(docs: DataFrame, items: DataFrame, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """doc_id, contaminated, item_ids, edits (least over the items, null if none) of each row of ``docs``; see matches()."""
    found = matches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), items, chars_per_edit)
    return found.select(
        "doc_id",
        (F.size("hits") > 0).alias("contaminated"),
        F.transform("hits", lambda h: h["item_id"]).alias("item_ids"),
        F.array_min(F.transform("hits", lambda h: h["edits"])).alias("edits"),
    )
