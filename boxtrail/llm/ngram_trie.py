"""A language model in memory-mapped Elias-Fano tries, a file for each shard of n-grams.

1. Texts become chunks of about CHUNK tokens, a file each: the chunk's distinct words (64-bit hashes) with their counts,
   and each token's place among them. The table of chunks tells whose texts they hold.
2. Words go to ranges of hashes, where they are counted and named: a word's id is its place among all words in order of
   hashes. Chunks get back the ids and counts of their words. The driver learns the number of tokens and types, and the
   words and word pairs that are so frequent that their n-grams are dealt out further, by the next word. Both lists hold
   two entries for each shard at most.
3. A chunk sends each shard the distinct n-grams it has for it, by ids, with their training counts. A shard holds the
   n-grams of some first words, about SHARD tokens, whatever the size of the corpus. Its task sums the counts, writes the
   trie file and answers, from the mapped file, what the chunks asked for.
4. Answers return to their chunks, where tokens take their probabilities from them. No task opens another shard's file.

A range's file is one Elias-Fano sequence of 64-bit hashes, a shard's words one of ids, its first words one of places
among them, all found by successor search. A node's children are ranks
in that sequence, relative to their context: level k holds parent * words + rank, a monotone sequence in Elias-Fano form,
and monotone pointers bound each context's range, in which a child is found by successor search. Probabilities are
smoothed with a Dirichlet prior,

    P(w | context) = (c(context w) + PRIOR * P(w | shorter context)) / (c(context) + PRIOR),

down to (c(w) + 1) / (N + V + 1); both shares are kept as 16-bit logarithms. All n-grams are kept, so the probabilities
of a context sum to 1 over the known words and one unknown. A file keeps a share in 8 bits: one of 255 values chosen for
that file, closer for large shares.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxtrail.llm.common import remainder, scratch, text_of
from boxtrail.llm.kernels import U, mix, words

PRIOR = 4.0
#: Tokens of a chunk, and about how many a shard gets; both fit in a task's memory many times.
CHUNK, SHARD = 1 << 20, 1 << 21
#: The token after the last word of a text; no word hashes to it but by chance.
END = U(0xE5D0F7EE7D0C5EED)
#: 16-bit logarithms cover 10^-12 to 1; the last one stands for 0.
STEPS = 65534 / 12.0
NONE = 65535
#: How much finer large shares are coded than small ones; 0 would be evenly in logarithms, 1 evenly in shares.
BEND = 0.15


def quantised(p: np.ndarray) -> np.ndarray:
    return np.clip(np.round(-np.log10(np.maximum(p, 1e-12)) * STEPS), 0, NONE - 1).astype(np.uint16)


def restored(q: np.ndarray) -> np.ndarray:
    return np.where(q == NONE, 0.0, 10.0 ** (-q.astype(np.float64) / STEPS))


def coded(q: np.ndarray, absent: int) -> tuple[np.ndarray, np.ndarray]:
    """(a code of 8 bits for each 16-bit value, the values of the codes); code 0 is ``absent``.

    Values share a code where their shares, to the power of BEND, fall into one cell of a grid as fine as 255 codes allow,
    and are kept as their mean. Cells are narrower for large shares than for small ones, whatever the number of values:
    with shares from 10^-6 to 1, in log10 at most 0.08 wide at 10^-6 and 0.01 near 1.
    """
    seen = np.bincount(q, minlength=1 << 16)
    values = np.flatnonzero(seen)
    to = np.zeros(1 << 16, np.uint8)
    if not len(values):
        return to[q], np.array([absent], np.uint16)
    bent = restored(values) ** BEND
    cells = lambda grid: np.unique(np.floor(bent[0] * grid - bent * grid), return_inverse=True)[1]
    low, high = 1, 1 << 24
    while high - low > 1:  # the finest grid whose cells in use have a code each
        mid = (low + high) // 2
        low, high = (mid, high) if cells(mid).max() < 255 else (low, mid)
    group = cells(low)
    book = np.round(np.bincount(group, values * seen[values]) / np.bincount(group, seen[values])).astype(np.int64)
    to[values] = 1 + group
    return to[q], np.r_[absent, book].astype(np.uint16)


def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and each one's place among them: np.unique by one sort of keys and places in 64 bits."""
    n = len(keys)
    width = max(1, n - 1).bit_length()
    if not n:
        return keys.astype(U), np.zeros(0, np.int64)
    cut = max(0, int(keys.max()).bit_length() + width - 64)  # low bits of the keys that find no room
    x = np.sort(keys >> U(cut) << U(width) | np.arange(n, dtype=U))
    place = (x & U((1 << width) - 1)).astype(np.int64)
    x = keys[place]
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    if cut and (x[1:] < x[:-1]).any():  # keys that differ in their low bits only
        return np.unique(keys, return_inverse=True)
    at = np.empty(n, np.int64)
    at[place] = np.cumsum(new) - 1
    return x[new], at


def _in_word(word: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the r-th set bit of each word."""
    place = np.zeros(len(word), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        n = np.bitwise_count(word & U((1 << width) - 1)).astype(np.int64)
        up = r >= n
        r = r - n * up
        word = np.where(up, word >> U(width), word)
        place += width * up
    return place


class EliasFano:
    """A sorted sequence of 64-bit numbers: low bits packed, high bits in unary.

    Counts of ones and zeros before each word, an eighth of a value's bits, are not kept but made when it is opened.
    """

    PARTS = ("low", "high")

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray) -> None:
        self.n, self.bits, self.low, self.high = n, bits, low, high
        self.ones = np.r_[0, np.cumsum(np.bitwise_count(high), dtype=np.int64)]
        self.zeros = np.arange(len(high) + 1, dtype=np.int64) * 64 - self.ones

    @staticmethod
    def of(values: np.ndarray) -> EliasFano:
        n = len(values)
        values = values.astype(U)
        top = int(values[-1]) if n else 0
        bits = max(0, min(56, (top // max(n, 1)).bit_length() - 1)) if n else 0
        packed = []
        for at in range(0, n, 1 << 15):  # a multiple of 8 values is whole bytes
            v = values[at : at + (1 << 15)]
            packed.append(np.packbits((v[:, None] >> np.arange(bits, dtype=U) & U(1)).astype(np.uint8), bitorder="little"))
        low = np.concatenate([*packed, np.zeros(8, np.uint8)])
        places = (values >> U(bits)).astype(np.int64) + np.arange(n)
        size = -(-(int(places[-1]) + 2 if n else 1) // 64) * 64
        flags = np.zeros(size, bool)
        flags[places] = True
        return EliasFano(n, bits, low, np.packbits(flags, bitorder="little").view(U))

    def _low(self, i: np.ndarray) -> np.ndarray:
        bit = i * self.bits
        eight = np.lib.stride_tricks.as_strided(self.low, (len(self.low) - 7, 8), (1, 1))[bit >> 3]
        return np.ascontiguousarray(eight).view(U)[:, 0] >> (bit & 7).astype(U) & U((1 << self.bits) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, "right") - 1
        high = word * 64 + _in_word(self.high[word], i - self.ones[word]) - i
        return high.astype(U) << U(self.bits) | self._low(i)

    def pair(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values i and i + 1: the next value's bit is mostly in the same word."""
        word = np.searchsorted(self.ones, i, "right") - 1
        bits = self.high[word]
        place = _in_word(bits, i - self.ones[word])
        high = word * 64 + place - i
        rest = np.where(place == 63, U(0), bits >> (np.minimum(place + 1, 63)).astype(U))
        step = np.bitwise_count((rest & (~rest + U(1))) - U(1)).astype(np.int64)  # zeros before the next bit
        second = (high + step).astype(U) << U(self.bits) | self._low(i + 1)
        far = np.flatnonzero(rest == 0)
        if len(far):
            second[far] = self[i[far] + 1]
        return high.astype(U) << U(self.bits) | self._low(i), second

    def _ones_before_zero(self, k: np.ndarray) -> np.ndarray:
        """How many values have a high part of at most k."""
        word = np.minimum(np.searchsorted(self.zeros, k, "right") - 1, len(self.high) - 1)
        inside = k - self.zeros[word]
        past = k >= self.zeros[-1]
        got = word * 64 + _in_word(~self.high[word], np.where(past, 0, inside)) - k
        return np.where(past, self.n, got)

    def find(self, x: np.ndarray, least: np.ndarray | int = 0, most: np.ndarray | None = None) -> np.ndarray:
        """Index of each x among the values [least, most), or -1: the successor of x among those with its high part."""
        if not self.n:
            return np.full(len(x), -1)
        x = x.astype(U)
        high = np.minimum(x >> U(self.bits), U(1 << 62)).astype(np.int64)
        lo = np.where(high > 0, self._ones_before_zero(np.maximum(high - 1, 0)), 0)
        hi = self._ones_before_zero(high)
        lo, hi = np.maximum(lo, least), hi if most is None else np.minimum(hi, most)
        return _successor(lambda i, _: self._low(i), lo, hi, x & U((1 << self.bits) - 1))


def _successor(at, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Index in [lo, hi) where the sorted values at(i, k) equal x[k], or -1."""
    lo, end = lo.copy(), hi
    hi = hi.copy()
    open_ = np.flatnonzero(lo < hi)
    while len(open_):
        mid = (lo[open_] + hi[open_]) >> 1
        less = at(mid, open_) < x[open_]
        lo[open_[less]] = mid[less] + 1
        hi[open_[~less]] = mid[~less]
        open_ = open_[lo[open_] < hi[open_]]
    found = np.full(len(lo), -1)
    k = np.flatnonzero(lo < end)
    same = at(lo[k], k) == x[k]
    found[k[same]] = lo[k[same]]
    return found


def write_arrays(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of named arrays; written under another name and moved, so that a repeated task does no harm."""
    fs, path = pa.fs.FileSystem.from_uri(uri)
    head, at = {}, 0
    for name, a in arrays.items():
        head[name] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // 64) * 64
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(own := f"{path}.{uuid.uuid4().hex}") as out:
        out.write(len(text).to_bytes(8, "little") + text)
        for a in arrays.values():
            out.write(np.ascontiguousarray(a).tobytes())
            out.write(b"\0" * (-a.nbytes % 64))
    fs.move(own, path)


def map_arrays(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file: mapped from a local or mounted file system, read from any other."""
    fs, path = pa.fs.FileSystem.from_uri(uri)
    raw = np.memmap(path, np.uint8, "r") if isinstance(fs, pa.fs.LocalFileSystem) else np.frombuffer(fs.open_input_file(path).read(), np.uint8)
    raw = raw.view(np.ndarray)
    size = int.from_bytes(raw[:8].tobytes(), "little")
    head = json.loads(raw[8 : 8 + size].tobytes())
    return {k: raw[8 + size + at : 8 + size + at + n * np.dtype(d).itemsize].view(d) for k, (d, n, at) in head.items()}


def _sequence(name: str, values: np.ndarray) -> dict[str, np.ndarray]:
    e = EliasFano.of(values)
    return {f"{name}.{p}": getattr(e, p) for p in EliasFano.PARTS} | {f"{name}.size": np.array([e.n, e.bits])}


def _mapped(arrays: dict[str, np.ndarray], name: str) -> EliasFano:
    n, bits = arrays[f"{name}.size"].tolist()
    return EliasFano(n, bits, *(arrays[f"{name}.{p}"] for p in EliasFano.PARTS))


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of every text's words and END, offsets of the texts)."""
    w, offsets = words(column)
    n = len(offsets) - 1
    out = np.full(len(w) + n, END, U)
    at = np.arange(len(w)) + np.repeat(np.arange(n), np.diff(offsets))
    out[at] = w
    return out, offsets + np.arange(n + 1)


def _narrow(a: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the least width that holds them."""
    top = int(a.max()) if len(a) else 0
    return a.astype(f"<u{next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)}")


def _packed(arrays: list[np.ndarray]) -> bytes:
    """Arrays of unsigned numbers in one compressed blob: rising ones as differences, the bytes of a number apart."""
    head, body = [len(arrays)], []
    for a in arrays:
        hashes, a = a.dtype == U, a.astype(U)
        rising = len(a) > 1 and bool((a[1:] >= a[:-1]).all())
        if rising:
            a = np.diff(a, prepend=U(0))
        width = -(-int(a.max()).bit_length() // 8) if len(a) else 0
        head += [width, rising, hashes, len(a)]
        body.append(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    blob = np.array(head, np.int64).tobytes() + b"".join(body)
    return len(blob).to_bytes(8, "little") + pa.compress(blob, "zstd", asbytes=True)


def _parsed(blob: bytes) -> list[np.ndarray]:
    """The arrays of a blob: 64-bit ones as such, others in the least width."""
    blob = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)
    k = int(np.frombuffer(blob, np.int64, 1)[0])
    head, at, out = np.frombuffer(blob, np.int64, 4 * k, 8), 8 + 32 * k, []
    for width, rising, hashes, n in head.reshape(k, 4).tolist():
        a = np.zeros((n, 8), np.uint8)
        a[:, :width] = np.frombuffer(blob, np.uint8, width * n, at).reshape(width, n).T
        a = a.view(U)[:, 0]
        if rising:
            a = np.cumsum(a, dtype=U)
        out.append(a if hashes else _narrow(a))
        at += width * n
    return out


CHUNKS = "chunk long, n long, row array<long>, doc_id array<long>, held array<boolean>, train array<boolean>, size array<long>, early array<long>"
_LONGS = pa.list_(pa.int64())
_CHUNK_SCHEMA = pa.schema(
    [("chunk", pa.int64()), ("n", pa.int64()), ("row", _LONGS), ("doc_id", _LONGS), ("held", pa.list_(pa.bool_())), ("train", pa.list_(pa.bool_())), ("size", _LONGS), ("early", _LONGS)]
)


def _by_load(load: np.ndarray) -> np.ndarray:
    """A chunk's words, the frequent ones first: tokens are kept as places in this order, most of which are small."""
    return np.argsort(-load.astype(np.int64), kind="stable")


def _file(folder: str, chunk: int, *names: str) -> list[np.ndarray]:
    """Arrays of a chunk's file."""
    file = map_arrays(f"{folder}/{chunk}")
    return [_parsed(file[n].tobytes())[0] for n in names]


def _chunked(folder: str, limit: int):
    """From (doc_id, held_out, train, text): chunks of whole texts, or of parts of a text with the two tokens before them."""

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, row = TaskContext.get().partitionId() << 32, 0, 0
        held: list[tuple] = []

        def chunk() -> pa.RecordBatch:
            nonlocal held, number
            size = np.array([len(h[4]) for h in held])
            word, ids = ranked(np.concatenate([h[4] for h in held]))
            early = np.array([h[5] for h in held])
            scored = np.arange(len(ids)) - np.repeat(np.cumsum(size) - size, size) >= np.repeat(early, size)
            taught = scored & np.repeat([h[3] for h in held], size)
            seen, load = (np.bincount(ids[x], minlength=len(word)) for x in (taught, scored))
            place = np.empty(len(word), np.int64)
            place[_by_load(load)] = np.arange(len(word))
            arrays = {"words": word, "seen": seen, "load": load, "tokens": place[ids]}
            write_arrays(f"{folder}/{part | number}", {k: np.frombuffer(_packed([x]), np.uint8) for k, x in arrays.items()})
            out = {
                "chunk": [part | number], "n": [int(scored.sum())], "row": [[h[0] for h in held]], "doc_id": [[h[1] for h in held]],
                "held": [[h[2] for h in held]], "train": [[h[3] for h in held]], "size": [size.tolist()], "early": [early.tolist()],
            }
            held, number = [], number + 1
            return pa.RecordBatch.from_pydict(out, schema=_CHUNK_SCHEMA)

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                t, offsets = tokens(some.column(3))
                for k, (i, is_held, train) in enumerate(zip(*(some.column(c).to_pylist() for c in range(3)), strict=True)):
                    for a in range(offsets[k], offsets[k + 1], limit):
                        begin = max(offsets[k], a - 2)
                        held.append((part | row, i, is_held, train, t[begin : min(a + limit, offsets[k + 1])], int(a - begin)))
                        if len(held[-1][4]) >= limit:
                            yield chunk()
                    row += 1
                if sum(len(h[4]) for h in held) >= limit:
                    yield chunk()
        if held:
            yield chunk()

    return chunked


class Chunks:
    """The texts of a frame as chunk files in ``folder``, and ``table``, whose rows tell what is in each.

    ``names``, once words are counted: what each range of hashes tells a chunk of its words, and the driver of itself.
    """

    names: DataFrame

    def __init__(self, docs: DataFrame, train: F.Column) -> None:
        """``train`` says which rows teach the model."""
        spark = docs.sparkSession
        rows = docs.select(F.col("doc_id").cast("long"), (remainder(7) == 2).alias("held_out"), train.alias("train"), text_of().alias("text"))
        path = scratch(spark, "chunks")
        self.folder = f"{path}/files"
        rows.mapInArrow(_chunked(self.folder, CHUNK), CHUNKS).write.parquet(f"{path}/table")
        self.table = spark.read.schema(CHUNKS).parquet(f"{path}/table")


class Hot:
    """Frequent words and word pairs, by hashes and by ids, with their training counts: their n-grams are dealt out by the next word."""

    def __init__(self, words: list[tuple[int, int, int]] = (), pairs: list[tuple[int, int, int]] = ()) -> None:
        """words: (hash, id, count); pairs: (hash, hash, count), both of such words."""
        ids = {h: i for h, i, _ in words}
        column = lambda rows, k: np.array([r[k] for r in rows], U)
        self.words = np.sort(column(words, 0))
        self.pairs = np.sort(_pair(column(pairs, 0), column(pairs, 1)))
        by_id = sorted((i, c) for _, i, c in words)
        self.ids, self.seen = column(by_id, 0), column(by_id, 1).astype(np.int64)
        named = _pair(np.array([ids[f] for f, _, _ in pairs], U), np.array([ids[t] for _, t, _ in pairs], U))
        order = np.argsort(named)
        self.id_pairs, self.pair_seen = named[order], column(pairs, 2).astype(np.int64)[order]


def _in(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Index of each x in the sorted ``known``, or -1."""
    if not len(known):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return np.where(known[at] == x, at, -1)


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first ^ mix(second + U(1)))


def _shard(x: np.ndarray, shards: int) -> np.ndarray:
    return (mix(x) >> U(33)).astype(np.int64) % shards


def _ranges(words: np.ndarray, shards: int) -> np.ndarray:
    """Where each range of hashes begins among sorted words, and the end; a range is a shard's share of all hashes."""
    return np.searchsorted((words >> U(32)) * U(shards) >> U(32), np.arange(shards + 1, dtype=U))


class Layout:
    """A chunk's distinct n-grams, the shard of each, and where each token's are.

    Entries are (shard, pair): every pair at its own shard, and a hot one also where its trigrams are.
    """

    def __init__(self, folder: str, row: dict, hot: Hot, shards: int) -> None:
        self.words, load, places = _file(folder, row["chunk"], "words", "load", "tokens")
        self.t = _by_load(load)[places]
        size, early = np.array(row["size"]), np.array(row["early"])
        place = np.arange(len(self.t)) - np.repeat(np.cumsum(size) - size, size)
        self.doc = np.repeat(np.arange(len(size)), size)
        self.scored = place >= early[self.doc]
        self.taught = self.scored & np.array(row["train"], bool)[self.doc]
        self.two = np.flatnonzero(place >= 1)
        self.three = np.flatnonzero((place >= 2) & self.scored)
        if not shards:
            return
        bits, t = U(max(1, len(self.words)).bit_length()), self.t.astype(U)
        pairs, at2 = ranked(t[self.two - 1] << bits | t[self.two])
        self.pair = np.full(len(t), -1)
        self.pair[self.two] = at2
        self.tris, self.at3 = ranked(self.pair[self.three - 1].astype(U) << bits | t[self.three])
        mask = (U(1) << bits) - U(1)
        self.first, self.second = (pairs >> bits).astype(np.int64), (pairs & mask).astype(np.int64)
        self.owner, self.third = (self.tris >> bits).astype(np.int64), (self.tris & mask).astype(np.int64)
        named = _pair(self.words[self.first], self.words[self.second])
        is_hot = _in(self.words, hot.words)[self.first] >= 0
        self.home = np.where(is_hot, _shard(named, shards), _shard(self.words, shards)[self.first])
        far = _in(named, hot.pairs) >= 0
        to = np.where(far[self.owner], _shard(named[self.owner] ^ self.words[self.third], shards), self.home[self.owner])
        key = lambda shard, pair: shard.astype(U) << U(32) | pair.astype(U)
        entries = key(self.home, np.arange(len(pairs)))
        entries = np.sort(np.r_[entries, np.unique(key(to, self.owner)[to != self.home[self.owner]])])
        self.entry_shard, self.entry_pair = (entries >> U(32)).astype(np.int64), (entries & U(0xFFFFFFFF)).astype(np.int64)
        under = np.searchsorted(entries, key(to, self.owner))
        self.order3 = np.argsort(under, kind="stable")  # trigrams by entry, then third word
        self.degree = np.bincount(under, minlength=len(entries))
        self.cuts2 = np.searchsorted(self.entry_shard, np.arange(shards + 1))
        self.cuts3 = np.r_[0, np.cumsum(self.degree)][self.cuts2]

    def parts(self, shard: int) -> tuple[slice, slice]:
        return tuple(slice(c[shard], c[shard + 1]) for c in (self.cuts2, self.cuts3))

    def requests(self, ids: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(shard, blob): ids of words, then by their places entries with counts and degrees, third words with counts."""
        n2 = np.bincount(self.pair[self.two], self.taught[self.two], len(self.home)).astype(np.int64)
        n3 = np.bincount(self.at3, self.taught[self.three], len(self.tris)).astype(np.int64)
        at = np.zeros(len(self.words), np.int64)
        for shard in np.flatnonzero(np.diff(self.cuts2)).tolist():
            two, three = self.parts(shard)
            pair, tri = self.entry_pair[two], self.order3[three]
            f, s, t = self.first[pair], self.second[pair], self.third[tri]
            there = np.zeros(len(self.words), bool)
            there[f] = there[s] = there[t] = True
            used = np.flatnonzero(there)
            at[used] = np.arange(len(used))
            counted = np.where(self.home[pair] == shard, n2[pair], 0)
            yield shard, _packed([ids[used], at[f], at[s], counted, self.degree[two], at[t], n3[tri]])


_BLOBS = "shard int, chunk long, blob binary"


def _blobs(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], ["shard", "chunk", "blob"])


def _names(words: np.ndarray, told: list[tuple[int, bytes]], firsts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(id, training count) of a chunk's words, from what the ranges told; 0 for words the model does not know."""
    ids, count = np.zeros(len(words), U), np.zeros(len(words), np.int64)
    cuts = _ranges(words, len(firsts))
    for k, blob in told:
        place, seen = _parsed(blob)
        some = slice(cuts[k], cuts[k + 1])
        ids[some] = np.where(place > 0, place.astype(U) + U(firsts[k]), U(0))
        count[some] = seen
    return ids, count


def _asked(folder: str, hot: Hot, shards: int, firsts: list[int]):
    def asked(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        layout = Layout(folder, row, hot, shards)
        ids, _ = _names(layout.words, list(zip(right.column("shard").to_pylist(), right.column("blob").to_pylist(), strict=True)), firsts)
        return _blobs([(shard, row["chunk"], blob) for shard, blob in layout.requests(ids)])

    return asked


def _counts(folder: str, shards: int):
    """Words of a chunk with counts, a blob for each range of hashes."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.column("chunk").to_pylist():
                w, seen, load = _file(folder, chunk, "words", "seen", "load")
                cuts = _ranges(w, shards)
                for k in np.flatnonzero(np.diff(cuts)).tolist():
                    some = slice(cuts[k], cuts[k + 1])
                    yield from _blobs([(k, chunk, _packed([w[some], seen[some], load[some]]))]).to_batches()

    return counts


_TOLD = f"{_BLOBS}, tokens long, types long, words long, hot array<long>, place array<long>, seen array<long>"


def _named(folder: str, least: int, build: bool):
    """Of a range's words: for each chunk their places, from 1, and counts; and a row without chunk for the driver: tokens,
    types, words, and the words that occur ``least`` times. Counts and words are those of the range's file, written if it is to be built.
    """

    def named(blobs: pa.Table) -> pa.Table:
        shard = blobs.column("shard")[0].as_py()
        parts = [_parsed(b.as_py()) for b in blobs.column("blob")]
        w, at = ranked(np.concatenate([p[0] for p in parts]))
        seen, load = (np.bincount(at, np.concatenate([p[k] for p in parts]), len(w)).astype(np.int64) for k in (1, 2))
        place, uri = np.arange(1, len(w) + 1), f"{folder}/words-{shard}"
        if build:
            write_arrays(uri, _sequence("word", w) | _sequence("count", np.r_[0, np.cumsum(seen)]))
        else:
            try:
                known = map_arrays(uri)
                place = _mapped(known, "word").find(w) + 1
                before, after = _mapped(known, "count").pair(np.maximum(place - 1, 0))
                seen = np.where(place > 0, after - before, 0).astype(np.int64)
            except FileNotFoundError:  # no word of this range was taught
                place, seen = np.zeros(len(w), np.int64), np.zeros(len(w), np.int64)
        rows, a = [], 0
        for chunk, p in zip(blobs.column("chunk").to_pylist(), parts, strict=True):
            own = at[a : a + len(p[0])]
            rows.append((shard, chunk, _packed([place[own], seen[own]])))
            a += len(own)
        often = np.flatnonzero(load >= least)
        told = [int(seen.sum()), int((seen > 0).sum()), len(w), w[often].view(np.int64).tolist(), place[often].tolist(), seen[often].tolist()]
        table = _blobs([*rows, (shard, None, None)])
        for name, x in zip(("tokens", "types", "words", "hot", "place", "seen"), told, strict=True):
            table = table.append_column(name, pa.array([None] * len(rows) + [x], _LONGS if isinstance(x, list) else pa.int64()))
        return table

    return named


def _hot_pairs(folder: str, hot: Hot):
    """Pairs of hot words, by places among them, with their counts in a chunk."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a = Layout(folder, row, Hot(), 0)
                place = _in(a.words, hot.words)[a.t]
                k = a.two[(place[a.two] >= 0) & (place[a.two - 1] >= 0)]
                pair, at = np.unique(place[k - 1] * len(hot.words) + place[k], return_inverse=True)
                seen, load = (np.bincount(at, x[k], len(pair)).astype(np.int64) for x in (a.taught, a.scored))
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(seen), pa.array(load)], ["pair", "seen", "load"])

    return pairs


class Trie:
    """A shard's file: words, pairs, trigrams, in Elias-Fano form with quantised shares."""

    def __init__(self, uri: str) -> None:
        a = map_arrays(uri)
        self.word, self.root, self.to2, self.child2, self.to3, self.child3 = (_mapped(a, n) for n in ("word", "root", "to2", "child2", "to3", "child3"))
        self.codes = {n: (a[n], a[f"{n}.book"]) for n in ("share2", "rest2", "share3")}

    @staticmethod
    def write(uri: str, words: np.ndarray, f: np.ndarray, s: np.ndarray, total1: np.ndarray, c2: np.ndarray, owner: np.ndarray, third: np.ndarray, c3: np.ndarray) -> None:
        """words are sorted ids; pairs (f, s) and trigrams (owner, third) are sorted places; total1 is each pair's first word's count."""
        n = U(max(1, len(words)))
        roots = np.flatnonzero(np.bincount(f, minlength=len(words)))
        first = np.searchsorted(roots, f)
        shares = (("share2", c2 / (total1 + PRIOR), NONE), ("rest2", PRIOR / (c2 + PRIOR), 0), ("share3", c3 / (c2[owner] + PRIOR), NONE))
        write_arrays(
            uri,
            _sequence("word", words)
            | _sequence("root", roots)
            | _sequence("to2", np.r_[0, np.cumsum(np.bincount(first, minlength=len(roots)))])
            | _sequence("child2", first.astype(U) * n + s.astype(U))
            | _sequence("to3", np.r_[0, np.cumsum(np.bincount(owner, minlength=len(f)))])
            | _sequence("child3", owner.astype(U) * n + third.astype(U))
            | {k: x for name, p, absent in shares for k, x in zip((name, f"{name}.book"), coded(quantised(p), absent), strict=True)},
        )

    @staticmethod
    def _under(parent: np.ndarray, pointers: EliasFano, children: EliasFano, rank: np.ndarray, n: int) -> np.ndarray:
        """Place of each child, by its rank, in its parent's range, or -1; parent and rank may be -1."""
        found = np.full(len(parent), -1)
        k = np.flatnonzero((parent >= 0) & (rank >= 0))
        p = parent[k]
        lo, hi = (x.astype(np.int64) for x in pointers.pair(p)) if len(k) else (p, p)
        found[k] = children.find(p * n + rank[k], lo, hi)
        return found

    def ask(self, words: np.ndarray, f: np.ndarray, s: np.ndarray, owner: np.ndarray, third: np.ndarray) -> tuple[np.ndarray, ...]:
        """(codes of share2 and rest2 of each pair, codes of share3 of each trigram), 0 for unknown ones."""
        rank = self.word.find(words)
        root = np.where(rank >= 0, self.root.find(np.maximum(rank, 0)), -1)
        pair = self._under(root[f], self.to2, self.child2, rank[s], self.word.n)
        tri = self._under(pair[owner], self.to3, self.child3, rank[third], self.word.n)

        def code(name: str, at: np.ndarray) -> np.ndarray:
            out = np.zeros(len(at), np.uint8)
            there = at >= 0
            out[there] = self.codes[name][0][at[there]]
            return out

        return code("share2", pair), code("rest2", pair), code("share3", tri)

    def books(self) -> list[np.ndarray]:
        return [self.codes[n][1] for n in ("share2", "rest2", "share3")]


def _answered(folder: str, hot: Hot, build: bool):
    """A shard's task: sums the counts into its file if it is to be built, and answers every chunk from the file."""

    def answered(blobs: pa.Table) -> pa.Table:
        parts = [_parsed(b.as_py()) for b in blobs.column("blob")]
        uri = f"{folder}/shard-{blobs.column('shard')[0].as_py()}"
        sizes = [len(p[0]) for p in parts]
        words, at = ranked(np.concatenate([p[0] for p in parts]))
        own = np.split(at, np.cumsum(sizes)[:-1])  # each part's words among all
        put = lambda k: np.concatenate([o[p[k]] for o, p in zip(own, parts, strict=True)])
        put_n = lambda k: np.concatenate([p[k] for p in parts]).astype(np.int64)
        n2, degree, n3 = put_n(3), put_n(4), put_n(6)
        bits = U(len(words).bit_length())
        low = (U(1) << bits) - U(1)
        pairs, at2 = ranked(put(1).astype(U) << bits | put(2).astype(U))
        tris, at3 = ranked(np.repeat(at2, degree).astype(U) << bits | put(5).astype(U))
        f, s, owner, third = (x.astype(np.int64) for x in (pairs >> bits, pairs & low, tris >> bits, tris & low))
        if build:
            c2, c3 = (np.bincount(a, n, m).astype(np.int64) for a, n, m in ((at2, n2, len(pairs)), (at3, n3, len(tris))))
            c1 = np.bincount(f, c2, len(words)).astype(np.int64)  # every word but END has a next one, here if it is not hot
            k = _in(_pair(words[f], words[s]), hot.id_pairs)
            c2 = np.where(k >= 0, hot.pair_seen[k] if len(hot.pairs) else 0, c2)
            k = _in(words[f], hot.ids)
            total1 = np.where(k >= 0, hot.seen[k] if len(hot.ids) else 0, c1[f])
            kept2, kept3 = np.flatnonzero(c2), np.flatnonzero(c3)
            there = np.zeros(len(words), bool)
            for x in (f[kept2], s[kept2], third[kept3]):
                there[x] = True
            rank, place = np.cumsum(there) - 1, np.zeros(len(pairs), np.int64)
            place[kept2] = np.arange(len(kept2))
            Trie.write(uri, words[there], rank[f[kept2]], rank[s[kept2]], total1[kept2], c2[kept2], place[owner[kept3]], rank[third[kept3]], c3[kept3])
        try:
            trie = Trie(uri)
            told, books = trie.ask(words, f, s, owner, third), trie.books()
        except FileNotFoundError:  # nothing of this shard was taught
            told, books = [np.zeros(n, np.uint8) for n in (len(pairs), len(pairs), len(tris))], [np.array([x], np.uint16) for x in (NONE, 0, NONE)]
        out, b, c = [], 0, 0
        for p in parts:
            n_2, n_3 = len(p[1]), len(p[5])
            two = at2[b : b + n_2]
            out.append(_packed([told[0][two], told[1][two], told[2][at3[c : c + n_3]], *books]))
            b, c = b + n_2, c + n_3
        return pa.table([blobs.column("shard"), blobs.column("chunk"), pa.chunked_array([pa.array(out, pa.binary())])], ["shard", "chunk", "blob"])

    return answered


_SCORES = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _combined(folder: str, hot: Hot, shards: int, n: int, v: int, firsts: list[int]):
    """A chunk with its answers, and the names of its words under shards below 0: what each of its texts, or parts of texts, adds to the scores."""

    def combined(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        a = Layout(folder, row, hot, shards)
        told = list(zip(right.column("shard").to_pylist(), right.column("blob").to_pylist(), strict=True))
        _, count = _names(a.words, [(-1 - k, blob) for k, blob in told if k < 0], firsts)
        share2, rest2, share3 = np.zeros(len(a.home)), np.ones(len(a.home)), np.zeros(len(a.tris))
        for shard, blob in told:
            if shard < 0:
                continue
            two, three = a.parts(shard)
            s2, r2, s3, *books = _parsed(blob)
            s2, r2, s3 = (restored(book)[code] for book, code in zip(books, (s2, r2, s3), strict=True))
            pair = a.entry_pair[two]
            own = a.home[pair] == shard
            share2[pair[own]], rest2[pair[own]] = s2[own], r2[own]
            share3[a.order3[three]] = s3
        c = count[a.t]
        base = (c + 1) / (n + v + 1)
        p = base.copy()
        k = a.two[c[a.two - 1] > 0]  # the word before is known
        p[k] = share2[a.pair[k]] + PRIOR / (c[k - 1] + PRIOR) * base[k]
        p[a.three] = share3[a.at3] + rest2[a.pair[a.three - 1]] * p[a.three]
        docs = len(row["row"])
        total = lambda x: np.bincount(a.doc[a.scored], x[a.scored], docs)
        columns = [row["row"], row["doc_id"], row["held"], np.bincount(a.doc[a.scored], minlength=docs), total(c > 0).astype(np.int64), total(np.log10(base)), total(np.log10(p))]
        types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table([pa.array(x, t) for x, t in zip(columns, types, strict=True)], ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return combined


class Model:
    """Where the files are, how n-grams are dealt to them, the id before each range's first, and the corpus' tokens and types."""

    def __init__(self, folder: str, shards: int, firsts: list[int], n: int, v: int, hot: Hot) -> None:
        self.folder, self.shards, self.firsts, self.n, self.v, self.hot = folder, shards, firsts, n, v, hot


def _told(chunks: Chunks, folder: str, shards: int, build: bool) -> DataFrame:
    """What the ranges of hashes tell, as a written table."""
    spark, path = chunks.table.sparkSession, scratch(chunks.table.sparkSession, "names")
    seen = chunks.table.select("chunk").mapInArrow(_counts(chunks.folder, shards), _BLOBS)
    seen.groupBy("shard").applyInArrow(_named(folder, max(1, SHARD // 2), build), _TOLD).write.parquet(path)
    return spark.read.schema(_TOLD).parquet(path)


def _planned(chunks: Chunks) -> Model:
    """A model still without tries: words counted and named, its size, and what is hot; the chunks learn their words' names."""
    table, folder = chunks.table, scratch(chunks.table.sparkSession, "ngrams")
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(1, -(-total // SHARD))
    chunks.names = _told(chunks, folder, shards, True)
    told = chunks.names.filter("chunk IS NULL").collect()
    n, v = sum(r.tokens for r in told), sum(r.types for r in told)
    sizes = np.zeros(shards, np.int64)
    sizes[[r.shard for r in told]] = [r.words for r in told]
    firsts = (np.cumsum(sizes) - sizes).tolist()
    words = sorted((w & (1 << 64) - 1, p + firsts[r.shard], c) for r in told for w, p, c in zip(r.hot, r.place, r.seen, strict=True))
    hot = Hot(words)
    if words:
        pairs = table.mapInArrow(_hot_pairs(chunks.folder, hot), "pair long, seen long, load long").groupBy("pair").agg(F.sum("seen").alias("seen"), F.sum("load").alias("load"))
        often = pairs.filter(F.col("load") >= max(1, SHARD // 2)).collect()
        hot = Hot(words, [(words[r.pair // len(words)][0], words[r.pair % len(words)][0], r.seen) for r in often])
    return Model(folder, shards, firsts, n, v, hot)


def _answers(chunks: Chunks, model: Model, build: bool) -> DataFrame:
    named = chunks.names.filter("chunk IS NOT NULL").select("shard", "chunk", "blob")
    requests = chunks.table.groupBy("chunk").cogroup(named.groupBy("chunk")).applyInArrow(_asked(chunks.folder, model.hot, model.shards, model.firsts), _BLOBS)
    return requests.groupBy("shard").applyInArrow(_answered(model.folder, model.hot, build), _BLOBS)


def _scored(chunks: Chunks, model: Model, build: bool) -> DataFrame:
    named = chunks.names.filter("chunk IS NOT NULL").select((-1 - F.col("shard")).cast("int").alias("shard"), "chunk", "blob")
    told = _answers(chunks, model, build).unionByName(named).groupBy("chunk")
    combined = _combined(chunks.folder, model.hot, model.shards, model.n, model.v, model.firsts)
    parts = chunks.table.groupBy("chunk").cogroup(told).applyInArrow(combined, _SCORES)
    sums = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")


def train(docs: DataFrame) -> Model:
    """Counts the texts of ``docs`` (doc_id, text) and writes the model to the shared folder; a null text is empty.

    What reaches the driver is a row for each shard and the hot words and pairs. Without rows the model knows no word.
    """
    chunks = Chunks(docs, F.lit(True))
    model = _planned(chunks)
    _answers(chunks, model, True).agg(F.count("*")).collect()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs`` (doc_id, text).

    A null or empty text is its END token alone; a null doc_id stays null; rows that repeat a doc_id are scored one by
    one. Without training tokens every probability is that of an unknown word. An empty table gives no rows.
    """
    chunks = Chunks(docs, F.lit(False))
    chunks.names = _told(chunks, model.folder, model.shards, False)
    return _scored(chunks, model, False)


def lm_scores(docs: DataFrame) -> DataFrame:
    """Scores of all rows under a model of those whose crc32(doc_id) mod 7 is not 2; counts and questions travel together."""
    chunks = Chunks(docs, remainder(7) != 2)
    return _scored(chunks, _planned(chunks), True)
