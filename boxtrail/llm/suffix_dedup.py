"""Exact substring deduplication by distributed prefix doubling over sampled positions.

A byte goes when a ``length``-byte string over it also starts earlier. Ranks of all positions would be a
shuffle of many times the text, so positions are ranked in three rounds of growing prefixes, and a
position leaves as soon as its rank is unique or its fate is known:

1. GRAM bytes. Of the grams inside every ``length``-byte window the one with the least hash owns the
   window; equal windows have equal owners at equal places, so only owners are ranked (about one position
   in forty). Consecutive windows with one owner are a run. A task settles equal runs among its own texts,
   then Spark sorts (rank of the owner, rank of the run, document, position): of equal runs all but the
   first are repeats as a whole, and a run whose owner's rank is unique repeats nothing.
2. The runs left are opened. They travel with their bytes to their owner's place, where Spark sorts them by
   (owner, document, position); there positions are ranked by (owner, GRAM bytes), then by pairs
   (rank(p, h), name(p + h, h)) at growing offsets h up to the threshold, and after each step positions with a
   unique rank leave. All steps of an owner run in its one partition, so none needs another exchange.
3. Owners with more than GROUP open runs, or that one batch finds hot, don't meet in one place: their
   positions are dealt out, and the last two steps are rounds of Spark: sort by (owner, name of the first half),
   rerank what is not unique, sort by (rank, name of the second half), settle.

Names are 64-bit content hashes, ranks dense numbers of sorted pairs. Nothing is compared by one hash alone: a run by
(owner, run), a position by (owner, its names), 128 bits at least. A string that occurs often in a batch is sent
once, the rest being settled there, and runs of a hot owner are dealt out by the run. Texts are shuffled
once; both joins with them use the same exchange.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxtrail.llm.common import id_of, shown_id, text_of, told_apart
from boxtrail.llm.kernels import BASE, INVERSE, U, mix, powers, text_bytes

GRAM = 25
#: Bytes hashed at once; longer texts go in overlapping pieces.
PIECE = 1 << 18
#: An owner shared by more runs of one batch than this is dealt out by run.
HOT = 64
#: Open runs of one owner that are settled in one place.
GROUP = 2048
#: Windows of one run or stretch at most: 14 bits.
WINDOWS = 0x3FFF
_POW, _INV = powers(BASE, PIECE + 1), powers(INVERSE, PIECE + 1)


def _prefix(data: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * _POW[: len(data)], out=total[1:])
    return total


def _span(total: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix((total[b] - total[a]) * _INV[a] + (b - a).astype(U) * U(0xD6E8FEB86659FD93))


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    return np.minimum(key[: len(key) - (width - have)], key[width - have :]) if width > have else key


def _batches_of(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(from, to, text, shift, starts) of pieces of at most PIECE bytes: several texts, or part of a long one."""
    k, last = 0, len(offsets) - 1
    while k < last:
        if offsets[k + 1] - offsets[k] > PIECE:
            for at in range(offsets[k], offsets[k + 1] - length + 1, PIECE - length + 1):
                end = min(at + PIECE, offsets[k + 1])
                yield at, end, np.array([k]), np.array([at - offsets[k]]), np.array([0, end - at])
            k += 1
            continue
        n = max(k + 1, int(np.searchsorted(offsets, offsets[k] + PIECE, "right")) - 1)
        while offsets[n] - offsets[k] > PIECE:
            n -= 1
        yield offsets[k], offsets[n], np.arange(k, n), np.zeros(n - k, np.int64), offsets[k : n + 1] - offsets[k]
        k = n


def _pieces_of_runs(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, first window, number of windows, owner's rank, run's rank) of the runs of each piece."""
    for begin, end, text, shift, starts in _batches_of(offsets, length):
        size = end - begin
        if size < length:
            continue
        total = _prefix(raw[begin:end])
        ranks = mix((total[gram:] - total[:-gram]) * _INV[: size - gram + 1])
        key = (ranks >> U(20) << U(20)) | np.arange(len(ranks), dtype=U)
        owner = (_least(key, length - gram + 1) & U((1 << 20) - 1)).astype(np.int64)
        valid = np.zeros(len(owner) + 1, bool)  # windows inside one text
        long = np.flatnonzero(np.diff(starts) >= length)
        edge = np.zeros(len(owner) + 1, np.int32)
        np.add.at(edge, starts[:-1][long], 1)
        np.add.at(edge, starts[1:][long] - length + 1, -1)
        valid = np.cumsum(edge)[:-1] > 0
        new = valid & np.r_[True, (owner[1:] != owner[:-1]) | ~valid[:-1]]
        stop = valid & np.r_[(owner[1:] != owner[:-1]) | ~valid[1:], True]
        a, b = np.flatnonzero(new), np.flatnonzero(stop)
        where = np.searchsorted(starts, a, "right") - 1
        yield text[where], a - starts[where] + shift[where], b - a + 1, ranks[owner[a]], _span(total, a, b + length)


def _settle(ids: np.ndarray, at: np.ndarray, n: np.ndarray, owner: np.ndarray, run: np.ndarray, length: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Runs sorted by (owner, run, id, at), the first of equal ones, and the others as (id, at, n, owner), joined where their bytes meet.

    A joined stretch is cut so that its number of windows fits in 14 bits.
    """
    order = np.lexsort((at, ids, run, owner))
    ids, at, n, owner, run = (x[order] for x in (ids, at, n, owner, run))
    first = np.r_[True, (owner[1:] != owner[:-1]) | (run[1:] != run[:-1])][: len(owner)]
    lead = [x[first] for x in (ids, at, n, owner, run)]
    ids, at, n, owner = (x[~first] for x in (ids, at, n, owner))
    order = np.lexsort((at, ids))
    ids, at, n, owner = (x[order] for x in (ids, at, n, owner))
    end = at + n  # windows of one document follow each other, so ends do not fall
    begins = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (at[1:] > end[:-1] + length - 1)][: len(ids)])
    size = end[np.r_[begins[1:], len(ids)][: len(begins)] - 1] - at[begins]
    parts = -(-size // WINDOWS)
    k = np.repeat(np.arange(len(begins)), parts)
    off = (np.arange(len(k)) - np.repeat(np.cumsum(parts) - parts, parts)) * WINDOWS
    return lead, [ids[begins][k], at[begins][k] + off, np.minimum(WINDOWS, size[k] - off), owner[begins][k]]


def first_runs(raw: np.ndarray, offsets: np.ndarray, ids: np.ndarray, length: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """What _settle() gives for the runs of all texts. Each piece is settled by itself first, so what is held of a text that
    repeats itself is its first runs and a few stretches, not a run for each byte."""
    leads, spans = [], []
    for text, at, n, owner, run in _pieces_of_runs(raw, offsets, length):
        lead, span = _settle(ids[text], at, n, owner, run, length)
        leads.append(lead)
        spans.append(span)
    none = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, U)] * 2
    lead, span = _settle(*(np.concatenate(x) for x in zip(none, *leads, strict=True)), length)
    return lead, [np.concatenate(x) for x in zip(span, *spans, strict=True)]


def _rows(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def _packed(at: np.ndarray, n: np.ndarray, kind: np.ndarray) -> np.ndarray:
    return at << 16 | n << 2 | kind


#: Kinds of sampled rows: a first run, a run under a hot owner, repeats that their batch has settled, a mark of a hot owner.
RUN, HOT_RUN, SETTLED, MARK = range(4)
_RUN = ["owner", "run", "id", "place"]


def _sampled(length: int):
    """Runs (owner, run, id, place) that are first in their batch, stretches of repeats that the batch settles, marks of hot owners."""

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (ids, at, n, owner, run), spans = first_runs(*text_bytes(batch.column(1)), batch.column(0).to_numpy(), length)
            begins = np.r_[True, owner[1:] != owner[:-1]][: len(owner)]
            group = np.cumsum(begins) - 1
            many = np.bincount(group)[group] > HOT if len(owner) else begins
            mark = np.flatnonzero(begins & many)
            take = np.r_[np.arange(len(owner)), mark]
            place = np.r_[_packed(at, n, np.where(many, HOT_RUN, RUN)), _packed(at[mark], n[mark], np.full(len(mark), MARK))]
            yield _rows(_RUN, owner[take].view(np.int64), run[take].view(np.int64), ids[take], place)
            ids, at, n, owner = spans
            yield _rows(_RUN, owner.view(np.int64), np.zeros(len(ids), np.int64), ids, _packed(at, n, np.full(len(ids), SETTLED)))

    return sampled


_SPAN = ["id", "a", "b", "owner", "kind"]
_SPAN_TYPE = "id long, a long, b long, owner long, kind tinyint"


def _spans(kind: int, ids, a, b, owner=None) -> pa.RecordBatch:
    """kind 0: bytes a..b repeat; 1: b windows from a on are open; 2: they are open under a hot owner."""
    return _rows(_SPAN, ids, a, b, np.zeros(len(ids), np.int64) if owner is None else owner, np.full(len(ids), kind, np.int8))


def _ranked(length: int):
    """From runs sorted by (owner, marks first, run, id, place): repeats as a whole, and runs that stay open."""

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prev = None  # owner, run of the row before
        seen = None  # owner of the row before, which may be a mark
        is_hot = False  # whether the owner of the row before is marked
        held = None  # the only run of the current owner so far, if it is not marked
        for batch in batches:
            owner, run, ids, place = (c.to_numpy() for c in batch.columns)
            at, n, kind = place >> 16, place >> 2 & 0x3FFF, place & 3
            settled = kind == SETTLED
            yield _spans(0, ids[settled], at[settled], (at + n + length - 1)[settled])
            owner, run, ids, at, n, kind = (x[~settled] for x in (owner, run, ids, at, n, kind))
            if not len(owner):
                continue
            new_owner = np.r_[seen is None or owner[0] != seen, owner[1:] != owner[:-1]]
            seen = owner[-1]
            group = np.cumsum(new_owner)
            begins = np.flatnonzero(new_owner)
            hot = np.r_[is_hot, kind[begins] == MARK][group] | (kind == HOT_RUN)
            is_hot = bool(np.r_[is_hot, kind[begins] == MARK][group[-1]])
            real = kind != MARK
            owner, run, ids, at, n, hot = (x[real] for x in (owner, run, ids, at, n, hot))
            if not len(owner):
                continue
            new_owner = np.r_[prev is None or owner[0] != prev[0], owner[1:] != owner[:-1]]
            new_run = new_owner | np.r_[prev is None or run[0] != prev[1], run[1:] != run[:-1]]
            prev = owner[-1], run[-1]
            yield _spans(0, ids[~new_run], at[~new_run], (at + n + length - 1)[~new_run])
            lead = np.flatnonzero(new_run)
            if not len(lead):
                continue
            fresh = new_owner[lead]
            shared = ~fresh | np.r_[~fresh[1:], False]
            if held is not None and not fresh[0]:
                yield _spans(1, *(np.array([x]) for x in held))
            last = lead[-1]
            held = (ids[last], at[last], n[last], owner[last]) if fresh[-1] and not hot[last] else None
            go, far = lead[shared & ~hot[lead]], lead[hot[lead]]
            yield _spans(1, ids[go], at[go], n[go], owner[go])
            yield _spans(2, ids[far], at[far], n[far], owner[far])

    return ranked


def _levels(raw: np.ndarray, length: int, gram: int = GRAM) -> Iterator[tuple[int, int, np.ndarray]]:
    """(h, step, names of all h-byte strings of at most PIECE bytes): pairs at ``step`` give the next h, up to ``length``."""
    total = _prefix(raw)
    name, have = mix((total[gram:] - total[:-gram]) * _INV[: len(raw) - gram + 1]), gram
    while have < length:
        step = min(have, length - have)
        yield have, step, name
        name = mix(name[: len(name) - step] * U(3) + mix(name[step:]) + U(have))
        have += step


def _pieces(starts: np.ndarray, n: np.ndarray, length: int) -> Iterator[tuple[int, int, int]]:
    """(first run, run after the last, end) of stretches of at most PIECE bytes of runs laid out one after the other."""
    k = 0
    while k < len(starts):
        m = max(k + 1, int(np.searchsorted(starts, starts[k] + PIECE - WINDOWS - length, "right")))
        yield k, m, starts[m - 1] + n[m - 1] + length - 1
        k = m


def _pairs(raw: np.ndarray, starts: np.ndarray, n: np.ndarray, length: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """For the windows of all runs: at each level (name at p, name at p + step); the run, and the place in it."""
    levels: list[list] = []
    which, places = [], []
    for k, m, end in _pieces(starts, n, length):
        run = np.repeat(np.arange(k, m), n[k:m])
        place = np.arange(len(run)) - np.repeat(np.cumsum(n[k:m]) - n[k:m], n[k:m])
        at = starts[run] - starts[k] + place
        for level, (_, step, name) in enumerate(_levels(raw[starts[k] : end], length)):
            if len(levels) == level:
                levels.append([])
            levels[level].append((name[at], name[at + step]))
        which.append(run)
        places.append(place)
    return [tuple(np.concatenate(x) for x in zip(*parts, strict=True)) for parts in levels], np.concatenate(which), np.concatenate(places)


def _rerank(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(dense rank of each pair, whether another has the same)."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]
    rank = np.empty(len(a), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank, np.bincount(rank)[rank] > 1


def _opened(length: int):
    """Open runs with their bytes: (owner, id, at, n, bytes, hot)."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column("text"))
            lists = batch.column("open")
            flat, count = lists.flatten(), lists.value_lengths().to_numpy()
            a, n, owner, kind = (flat.field(k).to_numpy() for k in range(4))
            row = np.repeat(np.arange(batch.num_rows), count)
            begin, size = offsets[row] + a, n + length - 1
            ends = np.cumsum(size)
            for lo in range(0, len(row), 20000):
                some = slice(lo, lo + 20000)
                first = (ends[some][0] - size[some][0]) if len(row) else 0
                at = np.repeat(begin[some] - (ends[some] - size[some] - first), size[some]) + np.arange(ends[some][-1] - first)
                cuts = np.r_[0, ends[some] - first].astype(np.int64)
                texts = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(raw[at]))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x) for x in (owner[some], batch.column("id").to_numpy()[row[some]], a[some], n[some])), texts, pa.array(kind[some] == 2)],
                    ["owner", "id", "at", "n", "bytes", "hot"],
                )

    return opened


_POSITION = ["owner", "first", "second", "id", "a", "b"]


def _joined(ids: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (id, from, to) of repeated windows, joined where they meet."""
    order = np.lexsort((at, ids))
    ids, at = ids[order], at[order]
    first = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (at[1:] > at[:-1] + length)][: len(ids)])
    last = np.r_[first[1:], len(ids)][: len(first)] - 1
    return ids[first], at[first], at[last] + length


def _settled(length: int):
    """From open runs sorted by (owner, id, at): repeats (owner null), and positions (b null) of groups too large or hot."""

    def windows(t: pa.Table) -> tuple:
        raw, offsets = text_bytes(t.column("bytes").combine_chunks())
        levels, run, place = _pairs(raw, offsets[:-1], t.column("n").to_numpy(), length)
        return t.column("owner").to_numpy()[run], levels, t.column("id").to_numpy()[run], t.column("at").to_numpy()[run] + place

    def spans(ids: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, a, b = _joined(ids, at, length)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(ids), pa.int64()) for _ in range(3)), *(pa.array(x) for x in (ids, a, b))], _POSITION)

    def apart(t: pa.Table) -> Iterator[pa.RecordBatch]:
        owner, levels, ids, at = windows(t)
        first, second = levels[-1]
        order = np.lexsort((at, ids, second, first, owner))
        owner, first, second, ids, at = (x[order] for x in (owner, first, second, ids, at))
        again = np.zeros(len(ids), bool)
        again[1:] = (owner[1:] == owner[:-1]) & (first[1:] == first[:-1]) & (second[1:] == second[:-1])
        yield from spans(ids[again], at[again])
        rows = [x[~again] for x in (owner, first.view(np.int64), second.view(np.int64), ids, at)]
        yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in rows), pa.nulls(len(rows[0]), pa.int64())], _POSITION)

    def together(t: pa.Table) -> Iterator[pa.RecordBatch]:
        owner, levels, ids, at = windows(t)
        rank, left = _rerank(owner, levels[0][0].view(np.int64))  # at GRAM bytes
        alive = np.flatnonzero(left)
        rank = rank[alive]
        for _, second in levels:  # pairs at growing offsets, until unique or past the threshold
            rank, left = _rerank(rank, second.view(np.int64)[alive])
            alive, rank = alive[left], rank[left]
        ids, at = ids[alive], at[alive]
        order = np.lexsort((at, ids, rank))
        again = np.r_[False, rank[order][1:] == rank[order][:-1]][: len(order)]
        yield from spans(ids[order][again], at[order][again])

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # runs of the last owner
        large = None  # an owner with too many runs
        for batch in batches:
            t = pa.Table.from_batches([batch])
            hot = t.column("hot").to_numpy()
            if hot.any():
                yield from apart(t.filter(pa.array(hot)))
                t = t.filter(pa.array(~hot))
            if not len(t):
                continue
            t = pa.concat_tables([held, t]) if held is not None else t
            owner = t.column("owner").to_numpy()
            begins = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[begins, len(owner)])
            wide = np.repeat((sizes > GROUP) | (owner[begins] == large if large is not None else False), sizes)
            ended = np.arange(len(owner)) < begins[-1]
            if wide.any():
                yield from apart(t.filter(pa.array(wide)))
                large = owner[-1] if wide[-1] else large
            if (whole := ended & ~wide).any():
                yield from together(t.filter(pa.array(whole)))
            rest = ~ended & ~wide
            held = t.filter(pa.array(rest)) if rest.any() else None
        if held is not None:
            yield from together(held)

    return settled


def _reranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Positions sorted by (owner, first): those whose pair is not unique, with a dense rank; repeats pass through."""
    number, last, held = TaskContext.get().partitionId() << 40, None, None  # held: the first row of a pair, until another comes
    names = ["rank", "second", "id", "a", "b"]
    for batch in batches:
        done = batch.column(0).is_null().to_numpy(zero_copy_only=False)
        if done.any():
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(done)), *(batch.column(k).filter(pa.array(done)) for k in range(2, 6))], names)
        rows = batch.filter(pa.array(~done))
        if not rows.num_rows:
            continue
        owner, first, second, ids, at = (rows.column(k).to_numpy(zero_copy_only=False) for k in range(5))
        new = np.r_[last is None or (owner[0], first[0]) != last, (owner[1:] != owner[:-1]) | (first[1:] != first[:-1])]
        last = owner[-1], first[-1]
        rank = number + np.cumsum(new)
        number = int(rank[-1])
        if held is not None and not new[0]:
            yield _rows(names[:4], *(np.array([x]) for x in held)).append_column("b", pa.nulls(1, pa.int64()))
        again = ~new | np.r_[~new[1:], False]
        held = (int(rank[-1]), int(second[-1]), int(ids[-1]), int(at[-1])) if new[-1] else None
        out = _rows(names[:4], rank[again], second[again], ids[again], at[again])
        yield out.append_column("b", pa.nulls(out.num_rows, pa.int64()))


def _repeats(length: int):
    """Spans of repeats from positions sorted by (rank, second, id, at)."""

    def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prev = None
        for batch in batches:
            done = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            ids, at, b = (c.to_numpy(zero_copy_only=False) for c in batch.columns[2:])
            yield _rows(["id", "a", "b"], ids[done], at[done], b[done].astype(np.int64))
            rank, second = (batch.column(k).filter(pa.array(~done)).to_numpy(zero_copy_only=False) for k in (0, 1))
            ids, at = ids[~done], at[~done]
            if not len(rank):
                continue
            again = np.r_[prev is not None and (rank[0], second[0]) == prev, (rank[1:] == rank[:-1]) & (second[1:] == second[:-1])]
            prev = rank[-1], second[-1]
            yield _rows(["id", "a", "b"], *_joined(ids[again], at[again], length))

    return repeats


def _trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        lists = batch.column("spans")
        for k in range(batch.num_rows):
            raw = batch.column("text")[k].as_py().encode()
            spans: list[list[int]] = []
            for a, b in sorted((s["a"], s["b"]) for s in lists[k].as_py() or ()):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            left, at = hashlib.sha256(), 0
            for a, b in spans:
                left.update(raw[at:a])
                at = b
            left.update(raw[at:])
            out.append((len(raw), sum(b - a for a, b in spans), len(spans), left.hexdigest(), [{"a": a, "b": b} for a, b in spans]))
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], kind)],
            ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"],
        )


def removed_spans(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (array of byte spans) for every row of ``docs``.

    A byte is removed when a ``length``-byte string of UTF-8 bytes over it also starts earlier: in a document with a
    smaller doc_id, or earlier in its own. Null texts are empty; texts shorter than ``length`` lose nothing. A null
    doc_id sorts last and is returned as null. Rows that repeat a doc_id with another text are documents of their own,
    in an order fixed by their texts' hashes; rows that repeat both are one document, returned as often as it occurs.
    """
    if not GRAM < length <= WINDOWS + GRAM - 1:  # a run has length - GRAM + 1 windows at most
        raise ValueError(f"length must be from {GRAM + 1} to {WINDOWS + GRAM - 1}")
    rows, shown, repeated = told_apart(docs.select(id_of().alias("id"), text_of().alias("text")))
    copies = None
    if repeated:  # an id stands for one text now; a row that comes twice must not repeat itself
        copies = rows.groupBy("id").agg(F.count("*").alias("copies"))
        rows = rows.dropDuplicates(["id"]).sortWithinPartitions("id")  # behind a shuffle: in a repeatable order, for what a batch settles
    sampled = rows.mapInArrow(_sampled(length), "owner long, run long, id long, place long")
    kind = F.col("place").bitwiseAND(3)
    dealt = F.when(kind == HOT_RUN, F.col("run")).when(kind == SETTLED, F.col("id")).otherwise(0)
    ranked = (
        sampled.repartition("owner", dealt)
        .sortWithinPartitions("owner", kind != MARK, "run", "id", "place")
        .mapInArrow(_ranked(length), _SPAN_TYPE)
    )
    spans = ranked.groupBy("id").agg(
        F.collect_list(F.when(F.col("kind") == 0, F.struct("a", "b"))).alias("done"),
        F.collect_list(F.when(F.col("kind") > 0, F.struct("a", "b", "owner", "kind"))).alias("open"),
    )
    opened = rows.join(spans.filter(F.size("open") > 0).select("id", "open"), "id").select("id", "text", "open")
    opened = opened.mapInArrow(_opened(length), "owner long, id long, at long, n long, bytes binary, hot boolean")
    met = opened.repartition("owner", F.when(F.col("hot"), F.xxhash64("id", "at")).otherwise(0)).sortWithinPartitions("owner", "id", "at")
    met = met.mapInArrow(_settled(length), "owner long, first long, second long, id long, a long, b long")
    # positions and repeats are told apart after an exchange: a repeat goes by its id
    far = met.repartition(F.coalesce("owner", "id"), F.coalesce("first", F.lit(0)), F.col("owner").isNull()).sortWithinPartitions("owner", "first", "id", "a")
    far = far.mapInArrow(_reranked, "rank long, second long, id long, a long, b long")
    far = far.repartition(F.coalesce("rank", "id"), F.coalesce("second", F.lit(0)), F.col("rank").isNull()).sortWithinPartitions("rank", "second", "id", "a")
    late = far.mapInArrow(_repeats(length), "id long, a long, b long").groupBy("id").agg(F.collect_list(F.struct("a", "b")).alias("late"))
    none = F.expr("cast(array() as array<struct<a:bigint,b:bigint>>)")
    all_spans = spans.select("id", "done").join(late, "id", "left").select("id", F.concat(F.coalesce("done", none), F.coalesce("late", none)).alias("spans"))
    out = rows.join(all_spans, "id", "left").select("id", "text", "spans").mapInArrow(
        _trimmed, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<a:bigint,b:bigint>>"
    )
    if copies is not None:
        out = out.join(copies, "id").withColumn("copies", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies")
    if shown is not None:
        out = out.join(shown, "id").drop("id").withColumnRenamed("shown", "id")
    return out.select(shown_id("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed")


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, unnest(range(0, n - 99)) AS pos, unnest(list_transform(range(0, n - 99), lambda x: substr(h, CAST(2 * x + 1 AS BIGINT), 200))) AS word FROM d),
f AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY word ORDER BY doc_id, pos) AS r FROM w),
k AS (SELECT doc_id, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 100 THEN 0 ELSE 1 END AS new FROM f WHERE r > 1),
i AS (SELECT doc_id, pos, sum(new) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS i FROM k),
s AS (SELECT doc_id, min(pos) AS a, max(pos) + 100 AS b FROM i GROUP BY doc_id, i),
e AS (SELECT doc_id, a, b FROM s UNION ALL SELECT doc_id, n, n FROM d),
q AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a, b) AS before FROM e),
o AS (SELECT doc_id, string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a, b) AS kept FROM q JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(sum(b - a), 0) AS BIGINT) AS n_removed, count(a) AS n_spans, sha256(unhex(any_value(kept))) AS kept_sha256
FROM d JOIN o USING (doc_id) LEFT JOIN s USING (doc_id) GROUP BY d.doc_id, n
"""
