"""Spelling variants: words of the corpus that are one edit apart, each led to the commonest form of its spelling.

Letters are hashed to a few symbols, so a word becomes a reduced word. Words one edit apart have reduced words at most one
edit apart, so the neighbourhoods of the distinct reduced words, joined with the reduced vocabulary, find every pair of
near words; each pair found is verified on the words themselves. A neighbourhood is generated in full as far as it can
tell a new pair: nearness goes both ways, so a longer reduced word seeks a shorter one by its deletions, and of two of
one length that with the lesser symbol seeks the other by its replacements. Keys are 64-bit polynomial hashes, so a
neighbour costs no copy of the word; a clash of keys only brings a candidate that the verification drops.

Only counting reads texts. It combines words in the map task, so a word that a third of all rows hold is one row for each
task. All later steps are over distinct words, and a group of words with one key is no larger than the words that the
reduction cannot tell apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxtrail.llm.common import cut, text_of
from boxtrail.llm.kernels import BASE, INVERSE, U, mix, powers, text_bytes

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters of a run, beside those of ASCII.
WIDE = "".join(map(chr, range(0xC0, 0x100)))
RUN = f"[A-Za-z{WIDE[0]}-{WIDE[-1]}]+"
#: A run is damaged if this divides its checksum.
DAMAGE = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: Symbols of the reduced alphabet.
SYMBOLS = 12
#: A word's form is at least so many times as frequent.
LEAD = 2
#: Positions of reduced words whose neighbours a task generates at once.
POSITIONS = 1 << 18


def runs(docs: DataFrame) -> DataFrame:
    """doc_id and run of every maximal run of letters of (doc_id, text), A-Z in lower case."""
    run = F.col("run")
    lower = F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))
    return docs.select("doc_id", F.explode(F.regexp_extract_all(text_of(), F.lit(RUN), F.lit(0))).alias("run")).withColumn("run", lower)


def damaged(doc_id: Column, run: Column) -> Column:
    """The run without one letter where the checksum of the document and the run says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % DAMAGE == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(words: DataFrame) -> DataFrame:
    """word and n of the words of a column ``word`` that are long and frequent enough."""
    counts = words.filter(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= LEAST_COUNT)


def symbol_table(symbols: int = SYMBOLS) -> tuple[str, str]:
    """All letters of words, and the symbol that each is hashed to."""
    letters = LOWER + UPPER + WIDE
    return letters, "".join(chr(0x40 + (ord(c) * 0x9E3779B1 % (1 << 32)) * symbols // (1 << 32)) for c in letters)


def reduced(word: Column, symbols: int = SYMBOLS) -> Column:
    return F.translate(word, *symbol_table(symbols))


def _keys(sums: np.ndarray, lengths: np.ndarray, bits: int) -> np.ndarray:
    """Keys of strings by their polynomial sums and lengths, as signed numbers."""
    return (mix(sums + lengths.astype(U) * U(0xD6E8FEB86659FD93)) >> U(64 - bits)).view(np.int64)


def neighbours(data: np.ndarray, offsets: np.ndarray, symbols: int, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys of the strings, keys of their neighbours, the string of each neighbour).

    Strings are bytes of ``data`` from symbol 0x40 on, cut at ``offsets``. The neighbours are the string itself, every
    distinct deletion, and every replacement by a greater symbol.
    """
    length = np.diff(offsets)
    value = data.astype(U) - U(0x3F)
    string = np.repeat(np.arange(len(length)), length)
    at = np.arange(len(data)) - offsets[:-1][string]
    base = powers(BASE, int(length.max(initial=0)) + 1)
    term = value * base[at]
    total = np.zeros(len(data) + 1, U)
    np.cumsum(term, out=total[1:])
    sums = total[offsets[1:]] - total[offsets[:-1]]
    own = _keys(sums, length, bits)
    before = total[:-1] - total[offsets[:-1]][string]
    after = sums[string] - before - term
    new = np.ones(len(data), bool)
    new[1:] = (value[1:] != value[:-1]) | (at[1:] == 0)  # deleting any letter of a run of one gives the same string
    keys = [own, _keys((before + after * U(INVERSE))[new], length[string[new]] - 1, bits)]
    owners = [np.arange(len(length)), string[new]]
    for s in range(2, symbols + 1):
        less = np.flatnonzero(value < U(s))
        keys.append(_keys(sums[string[less]] + (U(s) - value[less]) * base[at[less]], length[string[less]], bits))
        owners.append(string[less])
    return own, np.concatenate(keys), np.concatenate(owners)


def _named(bits: int):
    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """word, n and the key of the reduced word, which is the last column."""
        for batch in batches:
            own, _, _ = neighbours(*text_bytes(batch.column(2)), 1, bits)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own)], ["word", "n", "key"])

    return named


def _sought(symbols: int, bits: int):
    def sought(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            a = 0
            while a < len(offsets) - 1:
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + POSITIONS, "right")) - 1)
                own, keys, who = neighbours(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], symbols, bits)
                for k in range(0, len(keys), POSITIONS):
                    some = slice(k, k + POSITIONS)
                    yield pa.RecordBatch.from_arrays([pa.array(own[who[some]]), pa.array(keys[some])], ["seeker", "key"])
                a = b

    return sought


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point leads from a to b. Takes time in proportion to their length."""
    if len(a) > len(b):
        a, b = b, a
    same = len(a) == len(b)
    if a == b or not same and len(b) - len(a) > 1:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + same :] == b[k + 1 :]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array(list(map(one_edit, batch.column(0).to_pylist(), batch.column(2).to_pylist())), pa.bool_()))


def near_words(words: DataFrame, symbols: int = SYMBOLS, bits: int = 64) -> DataFrame:
    """word, n, near, near_n: every two words of (word, n) at one inserted, deleted or replaced code point, both ways round.

    Words are distinct and made of letters that ``runs`` gives; an empty table gives no rows. Keys have ``bits`` bits.
    """
    small = reduced(F.col("word"), symbols)
    named = cut(words.select("word", "n", small.alias("reduced")).mapInArrow(_named(bits), "word string, n long, key long"))
    sought = named.select(small.alias("reduced")).distinct().mapInArrow(_sought(symbols, bits), "seeker long, key long")
    found = sought.join(named.select("key", F.col("word").alias("near"), F.col("n").alias("near_n")), "key")
    found = found.join(named.select(F.col("key").alias("seeker"), "word", "n"), "seeker")
    found = found.filter((F.col("seeker") != F.col("key")) | (F.col("word") < F.col("near")))
    found = found.select("word", "n", "near", "near_n").mapInArrow(_verified, "word string, n long, near string, near_n long")
    clash = named.groupBy("key").agg((F.min(small) != F.max(small)).alias("clash")).filter("clash")
    there, back = F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    both = found.select(F.inline(F.array(there, back)))
    return both if clash.isEmpty() else both.distinct()  # two reduced words with one key may find a pair twice


def forms(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """word, n, n_near, form, form_n, root for each distinct word of (word, n).

    form is the near word of largest n, the first in code-point order of several, if it is at least LEAD times as
    frequent as the word. root is where forms lead; each is at least twice as frequent as the one before, so they end.
    """
    words = cut(words)
    best = near_words(words, symbols).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    far = -F.col("best.less") >= F.col("n") * LEAD
    told = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(far, F.col("best.near")).alias("form"), F.when(far, -F.col("best.less")).alias("form_n")
    )
    told = cut(told)
    # Pointer doubling: every round leads a word twice as far, until none has further to go.
    led = told.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        on = led.select(F.col("word").alias("root"), F.col("root").alias("next"))
        led = cut(led.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("further")))
        if led.filter("further").isEmpty():
            break
        led = led.select("word", "root")
    return told.join(led.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of (doc_id, text) that is long and frequent enough; other columns are ignored.

    Words are maximal runs of letters, A-Z in lower case, some of them damaged by rule. A null text has no words, a null
    doc_id counts as an empty one in the rule; rows that repeat count each. An empty table gives no rows.
    """
    found = runs(docs).select(damaged(F.col("doc_id"), F.col("run")).alias("word"))
    return forms(vocabulary(found), symbols).select("word", "form", "root", "n", "n_near", "form_n")


# The checksum goes by half bytes over a table of 16, which is made by rule; near words meet by a word with one letter
# blanked (replacements) or left out.
ORACLE = f"""
WITH RECURSIVE half AS (SELECT list(list_reduce(list_prepend(i, range(4)), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY i) AS t FROM (SELECT unnest(range(16)) AS i)),
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '{RUN}')), '{UPPER}', '{LOWER}') AS run FROM documents),
c AS (SELECT doc_id, run, count(*) AS k, hex(encode(doc_id || ':' || run)) AS x FROM r GROUP BY doc_id, run),
h AS (SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(range(length(x) // 2), lambda i: [CAST('0x' || x[2 * i + 2] AS BIGINT), CAST('0x' || x[2 * i + 1] AS BIGINT)]))),
   lambda a, b: xor(a >> 4, half.t[(xor(a, b) & 15) + 1]))) AS h FROM c, half),
d AS (SELECT CASE WHEN h % {DAMAGE} = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, k FROM h),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM d WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(k) >= {LEAST_COUNT}),
p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
q AS (SELECT word, n, i, word[:i - 1] || '*' || word[i + 1:] AS blank, word[:i - 1] || word[i + 1:] AS less FROM p),
e AS (SELECT a.word, b.word AS near, b.n AS near_n FROM q a JOIN q b ON a.blank = b.blank AND a.word <> b.word
   UNION SELECT q.word, v.word, v.n FROM q JOIN v ON q.less = v.word UNION SELECT v.word, q.word, q.n FROM q JOIN v ON q.less = v.word),
b AS (SELECT word, count(*) AS n_near, min(ROW(-near_n, near)) AS best FROM e GROUP BY word),
f AS (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= {LEAD} * n THEN best[2] END AS form, CASE WHEN -best[1] >= {LEAD} * n THEN -best[1] END AS form_n FROM v LEFT JOIN b USING (word)),
w AS (SELECT word, word AS root FROM f UNION ALL SELECT w.word, f.form FROM w JOIN f ON w.root = f.word WHERE f.form IS NOT NULL),
l AS (SELECT w.word, w.root FROM w JOIN f ON w.root = f.word WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN l USING (word)
"""
