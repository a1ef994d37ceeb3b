"""Packing by vector bin packing with the dot-product heuristic.

Every piece has a demand in three dimensions: tokens, segments (1) and loss-bearing tokens. A sequence
is filled by taking, again and again, the fitting piece whose demand has the largest dot product with
what the sequence has left, each dimension measured in shares of its limit. When none fits and cutting
is allowed, a piece is cut to fill the rest. Each task packs the documents of its own partition, window
by window, so nothing is shuffled and a sequence never depends on another task; at most one sequence
per task is short.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxtrail.llm.common import text_of


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 512
    loss: int = 2048


#: Documents packed together; bounds a task's memory and the search for the best piece.
WINDOW = 2048
#: Sequence ids of a task start at its number times this.
TASK_IDS = 1 << 32


def fill(tokens: np.ndarray, loss: list[np.ndarray | None], limits: Limits, cut: bool, last: bool) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int]]]:
    """Sequences as lists of (piece, start, length), and what is left over as (piece, start).

    ``loss`` has for each piece the number of loss-bearing tokens before each of its tokens and at its end, None if all bear
    loss. A piece is cut where these numbers reach the limit. A piece over a limit by itself is cut at the limits.
    Unless ``last``, pieces that leave a sequence short are left over for the next call.
    """
    cap = np.array([limits.tokens, limits.segments, limits.loss], float)
    start, done = np.zeros(len(tokens), np.int64), []

    def bears(k: int, at: int, n: int) -> int:
        return n if loss[k] is None else int(loss[k][at + n] - loss[k][at])

    def most(k: int, at: int, room: int, bearing: int) -> int:
        """Tokens of piece k from ``at`` on, of which at most ``bearing`` bear loss."""
        if loss[k] is None:
            return min(room, bearing)
        return min(room, int(np.searchsorted(loss[k], loss[k][at] + bearing, "right")) - 1 - at)

    if limits.loss < 1:
        raise ValueError("a sequence must have room for a loss-bearing token")
    total = np.array([bears(k, 0, int(n)) for k, n in enumerate(tokens)], np.int64).reshape(len(tokens))
    for k in np.flatnonzero((tokens > limits.tokens) | (total > limits.loss)).tolist():
        while (n := most(k, int(start[k]), min(limits.tokens, int(tokens[k] - start[k])), limits.loss)) < tokens[k] - start[k]:
            done.append([(k, int(start[k]), n)])
            start[k] += n
            total[k] -= bears(k, int(start[k]) - n, n)
    left = tokens - start
    alive = left > 0
    need = np.stack([left, np.ones(len(left)), total], 1).astype(float)
    need[~alive] = np.inf
    share = np.where(alive[:, None], need / cap, 0.0)

    def take(k: int, n: int) -> None:
        start[k], left[k] = start[k] + n, left[k] - n
        alive[k] = left[k] > 0
        need[k] = (left[k], 1, bears(k, int(start[k]), int(left[k]))) if alive[k] else np.inf
        share[k] = need[k] / cap if alive[k] else 0.0

    while alive.any():
        room, row = cap.copy(), []
        while True:
            fits = (need[:, 0] <= room[0]) & (need[:, 1] <= room[1]) & (need[:, 2] <= room[2])
            worth = share @ (room / cap)
            worth[~fits] = -1.0
            k = int(worth.argmax())
            if worth[k] >= 0:
                n = int(left[k])
            elif cut and alive.any() and room[1] >= 1 and room[0] >= 1:
                k = int(np.argmax(np.where(alive, left, -1)))
                n = most(k, int(start[k]), int(min(room[0], left[k])), int(room[2]))
                if n < 1:
                    break
            else:
                break
            row.append((k, int(start[k]), n))
            room -= (n, 1, bears(k, int(start[k]), n))
            take(k, n)
        if not alive.any() and room[0] > 0 and not last:  # short: let the next window fill it up
            for k, at, n in row:
                start[k], left[k], alive[k] = min(at, start[k]), left[k] + n, True
            return done, [(int(k), int(start[k])) for k in np.flatnonzero(alive)]
        done.append(row)
    return done, []


def _letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones stand for themselves, the rest follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


#: Fixed value: how a byte-level vocabulary of this kind splits a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: White space longer than this overflows the stack of the split's backtracking; blanks as the split knows them.
LONG_SPACE = 1 << 16
_LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_SPACE)


def _pieces(text: str) -> Iterator[tuple[str, bool]]:
    """Parts of a text that are split apart anyway, and whether a part is one piece by itself: long white space, which
    leaves its last blank to a following word.
    """
    at = 0
    for m in _LONG_SPACE.finditer(text) if len(text) >= LONG_SPACE else ():
        end = m.end() - (m.end() < len(text))
        yield text[at : m.start()], False
        yield text[m.start() : end], True
        at = end
    yield text[at:], False


def byte_bpe(path: str, end: int, special: bool = False) -> Callable[[list[str]], list[np.ndarray]]:
    """Encodes texts with the byte-level BPE of a tokenizers file, ``end`` after each.

    The ids are those of the tokenizers library, with the file's added tokens as ordinary text unless ``special``, and
    by their own ids, as the library has it by default, if so; the merging runs in tiktoken
    on the file's vocabulary, where ids are merge ranks, at a quarter of the time. A file of another kind is read
    by the tokenizers library itself.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters, vocabulary = _letters(), spec["model"].get("vocab", {})
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
    alone = not any(t.get(k) for t in spec.get("added_tokens", ()) for k in ("single_word", "lstrip", "rstrip"))
    plain = {t: i for t, i in vocabulary.items() if t not in added} if isinstance(vocabulary, dict) else {}
    ranked = sorted(plain.values()) == list(range(len(plain))) and all(
        plain.get("".join(m if isinstance(m, list) else m.split(" "))) == 256 + k for k, m in enumerate(spec["model"].get("merges", ()))
    )
    usual = spec.get("pre_tokenizer") or {}
    if ranked and (alone or not special) and usual.get("type") == "ByteLevel" and not usual.get("add_prefix_space") and not spec.get("normalizer"):
        import tiktoken

        ranks = {bytes(letters[c] for c in t): i for t, i in plain.items()}
        model = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

        strings = re.compile(f"({'|'.join(map(re.escape, sorted(added, key=len, reverse=True)))})")

        def ordinary(text: str) -> np.ndarray:
            if len(text) < LONG_SPACE:
                return np.asarray(model.encode_ordinary(text), np.uint32)
            parts = (model._encode_single_piece(t) if whole else model.encode_ordinary(t) for t, whole in _pieces(text))
            return np.concatenate([np.asarray(p, np.uint32) for p in parts])

        def encoded(text: str) -> np.ndarray:
            if not special or not any(t in text for t in added):
                return np.append(ordinary(text), np.uint32(end))
            parts = enumerate(strings.split(text))  # every second one is an added token
            return np.concatenate([*(np.array([added[t]], np.uint32) if k % 2 else ordinary(t) for k, t in parts), np.array([end], np.uint32)])

        return lambda texts: [encoded(t) for t in texts]
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = not special
    return lambda texts: [np.array([*e.ids, end], np.uint32) for e in slow.encode_batch_fast(texts, add_special_tokens=False)]


def token_bytes(path: str) -> np.ndarray:
    """Bytes of text that each id of a byte-level tokenizers file stands for."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = {t["id"]: len(t["content"].encode()) for t in spec.get("added_tokens", ())}
    sizes = {i: len(t) for t, i in spec["model"]["vocab"].items()} | added  # a letter for each byte
    out = np.zeros(max(sizes) + 1, np.int64)
    out[list(sizes)] = list(sizes.values())
    return out


def bearing(text: str, ids: np.ndarray, spans: list[dict], sizes: np.ndarray) -> np.ndarray:
    """Loss-bearing tokens before each token of a text and at its end; ``spans`` are in code points."""
    ends = np.cumsum(sizes[ids[:-1]])
    starts = np.r_[0, ends[:-1]] if len(ends) else ends
    wide = len(text) != ends[-1] if len(ends) else False
    at = np.r_[0, np.cumsum([len(c.encode()) for c in text])] if wide else np.arange(len(text) + 1)
    mask = np.zeros(len(ids), np.int64)
    for s in spans:
        if s and s["length"] > 0:
            a, b = at[min(s["start"], len(text))], at[min(s["start"] + s["length"], len(text))]
            mask[np.searchsorted(ends, a, "right") : np.searchsorted(starts, b, "left")] = 1
    return np.r_[0, np.cumsum(mask)]


def spread(tokens: int, n: int) -> np.ndarray:
    """``n`` loss-bearing tokens lying evenly over a number of tokens, counted before each and at the end."""
    return np.arange(tokens + 1) * min(max(n, 0), tokens) // max(tokens, 1)


def pack(docs: DataFrame, tokenizer: str, end: int = 1, limits: Limits = Limits(), cut: bool = True, window: int = WINDOW, loss: str | None = None) -> DataFrame:
    """One row per piece of each row of ``docs`` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end token alone; rows that repeat a doc_id are packed one by one; a null
    doc_id stays null. An empty table gives no rows. ``loss`` names a column with the spans of the text that bear loss (an array
    of start and length in code points): a token bears loss if one of its bytes is in a span, the end token does not. Or it
    names one with the number of loss-bearing tokens, which then lie evenly over the row's tokens; a number beyond them counts
    as all. Without one, or where it is null, all tokens bear loss.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(tokenizer, end, special=True)
        sizes_of = token_bytes(tokenizer) if spans else None
        ids: list = []
        tokens: list[np.ndarray] = []
        begun: list[int] = []  # tokens of each document that are packed already
        before: list[np.ndarray | None] = []  # loss-bearing tokens before each token
        number = TaskContext.get().partitionId() * TASK_IDS

        def rows(last: bool) -> pa.RecordBatch:
            nonlocal ids, tokens, begun, before, number
            sizes = np.array([len(t) - b for t, b in zip(tokens, begun, strict=True)], np.int64)
            done, rest = fill(sizes, [None if x is None else x[b:] for x, b in zip(before, begun, strict=True)], limits, cut, last)
            out = []
            for row in done:
                offset = 0
                for k, start, n in row:
                    at = begun[k] + start
                    out.append((ids[k], at, n, zlib.crc32(tokens[k][at : at + n].astype("<u4").tobytes()), len(tokens[k]), number, offset))
                    offset += n
                number += 1
            ids, tokens, begun, before = [ids[k] for k, _ in rest], [tokens[k] for k, _ in rest], [begun[k] + s for k, s in rest], [before[k] for k, _ in rest]
            columns = zip(*out, strict=True) if out else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], NAMES)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids += part.column(0).to_pylist()
                texts = part.column(1).to_pylist()
                new = encode(texts)
                tokens += new
                begun += [0] * len(new)
                bears = part.column(2).to_pylist()
                before += [None if x is None else bearing(text, t, x, sizes_of) if spans else spread(len(t), x) for text, t, x in zip(texts, new, bears, strict=True)]
                if len(ids) >= window:
                    yield rows(False)
        if ids:
            yield rows(True)

    spans = bool(loss) and dict(docs.dtypes)[loss].startswith("array")
    bears = F.lit(None).cast("long") if not loss else F.transform(loss, lambda s: F.struct(s["start"].cast("long").alias("start"), s["length"].cast("long").alias("length"))) if spans else F.col(loss).cast("long")
    return docs.select(docs["doc_id"].cast("long"), text_of().alias("text"), bears.alias("loss")).mapInArrow(packed, ", ".join(f"{n} long" for n in NAMES))


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
