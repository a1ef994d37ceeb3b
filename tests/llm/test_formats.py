import base64
import gzip
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from boxtrail.llm import chat, packing, warc

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_equal_the_library():
    """At the library's defaults."""
    model = Tokenizer.from_file(PATH)
    texts = ["", " ", "it's we'll I'd", "<|endoftext|> x", "  \n\n a\t b  ", "日本語 😀😀 é́ ½² ٣٤ İ", "\x00 a", "a" * 3000, "the cat " * 100]
    for got, text in zip(packing.byte_bpe(PATH, 1, special=True)(texts), texts, strict=True):
        assert got.tolist() == [*model.encode(text, add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("run", [" " * 3_000_000, "\n" * 3_000_000, " \n\u3000" * 50_000, "\x1c" * 70_000, "x" * 200_000])
def test_long_runs(run):
    model = Tokenizer.from_file(PATH)
    encode = packing.byte_bpe(PATH, 1)
    for text in (f"a {run}bc 1", run[:100_000]):
        assert encode([text])[0].tolist() == [*model.encode(text, add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9])
def test_long_space_edges(n, monkeypatch):
    """The parts of short runs, as if they were long."""
    monkeypatch.setattr(packing, "LONG_SPACE", 2)
    monkeypatch.setattr(packing, "_LONG_SPACE", re.compile(packing._LONG_SPACE.pattern.replace("65536", "2")))
    model = Tokenizer.from_file(PATH)
    for blank in " \n\t\x85\xa0\u2003\u2028":
        for text in (blank * n, f"a{blank * n}", f"{blank * n}b", f"a {blank * n} b's{blank * n}1{blank * n}!?{blank * n}\x1c", f"a{blank * n}\nb"):
            assert packing.byte_bpe(PATH, 1)([text])[0].tolist() == [*model.encode(text, add_special_tokens=False).ids, 1], text


def test_added_tokens(spark):
    """As an unmodified tokenizer has them, in pack() too."""
    model = Tokenizer.from_file(PATH)
    texts = ["a<|endoftext|>b", "<|endoftext|>", "x  <|endoftext|><|endoftext|>  \n y <|endoftext", "<|endoftext|> " + " " * 70_000 + "<|endoftext|>"]
    want = [[*model.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert 50256 in want[0] and [x.tolist() for x in packing.byte_bpe(PATH, 1, special=True)(texts)] == want
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts[:3])), "doc_id long, text string"), PATH).collect()
    assert {r.doc_id: r.ids_crc32 for r in rows} == {k: zlib.crc32(np.array(w, "<u4").tobytes()) for k, w in enumerate(want[:3])}


def check_packed(df, rows):
    model = Tokenizer.from_file(PATH)
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.sequence_id].append(r)
    for p in pieces.values():
        at = 0
        for r in sorted(p, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048 and len(p) <= 512
    texts = defaultdict(list)
    for i, t in df.select("doc_id", "text").collect():
        texts[i].append([*model.encode(t or "", add_special_tokens=False).ids, 1])
    for i, all_ids in texts.items():
        own = [r for r in rows if r.doc_id == i]
        assert sum(r.length for r in own) == sum(map(len, all_ids))
        if len(all_ids) == 1:
            at = 0
            for r in sorted(own, key=lambda r: r.start):
                part = np.array(all_ids[0][at : at + r.length], "<u4")
                assert (r.start, r.ids_crc32, r.doc_tokens) == (at, zlib.crc32(part.tobytes()), len(all_ids[0]))
                at += r.length


def test_packing(odd, documents):
    for df in (odd, documents):
        rows = packing.pack(df, PATH, window=50).collect()
        check_packed(df, rows)
        used = Counter()
        for r in rows:
            used[r.sequence_id] += r.length
    assert sum(n < 2048 for n in used.values()) <= 1


def test_packing_loss(spark):
    """A loss limit below the token limit binds, over windows too; a null counts all tokens."""
    rng = random.Random(9)
    share = {k: rng.choice([0.0, 0.3, 1.0, None]) for k in range(200)}
    texts = {k: "the cat " * rng.randrange(1, 150) for k in share}
    size = {k: len(t) for k, t in zip(texts, packing.byte_bpe(PATH, 1)(list(texts.values())))}
    bears = {k: None if share[k] is None else int(share[k] * size[k]) for k in share}
    df = spark.createDataFrame([(k, texts[k], bears[k]) for k in share], "doc_id long, text string, n long").coalesce(1)
    rows = packing.pack(df, PATH, limits=packing.Limits(tokens=400, segments=8, loss=150), window=50, loss="n").collect()
    sequences, done = defaultdict(list), Counter()
    for r in rows:
        sequences[r.sequence_id].append(r)
        done[r.doc_id] += r.length
    assert done == Counter(size)
    for s in sequences.values():
        assert sum(r.length for r in s) <= 400 and len(s) <= 8
        bearing = lambda r, n: n if bears[r.doc_id] is None else n * bears[r.doc_id] // size[r.doc_id]
        assert sum(bearing(r, r.start + r.length) - bearing(r, r.start) for r in s) <= 150
    assert max(sum(r.length for r in s) for s in sequences.values()) > 150


def test_short_texts_fill(spark):
    """Texts of three and ten tokens: the segment limit leaves little room."""
    for words, least in ((2, 0.7), (9, 0.97)):
        df = spark.createDataFrame([(k, " the" * words) for k in range(3000)], "doc_id long, text string").coalesce(1)
        rows = packing.pack(df, PATH).collect()
        assert sum(r.length for r in rows) >= least * 2048 * (len({r.sequence_id for r in rows}) - 1)


def test_instruction_packing(spark):
    """Conversations: every token once, and the assistant's tokens, counted where they stand, within their limit."""
    from tokenizers import Tokenizer

    from boxtrail.llm import queries

    sf = "/root/testdata/sf0.01"
    rows = queries.instruction_packing(spark, sf).collect()
    chats = chat.format_turns(chat.text_turns(spark.read.parquet(f"{sf}/conversations.parquet"))).select("conv_id", "formatted", "loss").collect()
    library, bears = Tokenizer.from_file(PATH), {}
    for r in chats:  # offsets of the library, in code points
        offsets = library.encode(r.formatted, add_special_tokens=False).offsets
        bears[r.conv_id] = [any(a < s.start + s.length and b > s.start for s in r.loss) for a, b in offsets] + [False]
    done, sequences = Counter(), defaultdict(list)
    for r in rows:
        done[r.doc_id] += r.length
        sequences[r.sequence_id].append(r)
    assert done == Counter({k: len(x) for k, x in bears.items()})
    for s in sequences.values():
        assert sum(r.length for r in s) <= 2048 and len(s) <= 16 and sum(sum(bears[r.doc_id][r.start : r.start + r.length]) for r in s) <= 1024
    assert sum(map(sum, bears.values())) > 0 and sum(done.values()) > 0.6 * 2048 * (len(sequences) - 8)


def test_bearing():
    """Tokens that touch a span, in texts with letters of several bytes and with added tokens."""
    encode, sizes = packing.byte_bpe(PATH, 1, special=True), packing.token_bytes(PATH)
    rng = random.Random(8)
    for _ in range(300):
        text = "".join(rng.choices(["the ", "é", "日本", "😀", "x", " ", "\n", "assistant"], k=rng.randrange(30)))
        ids = encode([text])[0]
        assert sizes[ids[:-1]].sum() == len(text.encode())
        a = rng.randrange(len(text) + 1)
        spans = [{"start": a, "length": rng.randrange(len(text) - a + 1)}, {"start": 0, "length": rng.randrange(2)}]
        edges = [(len(text[: s["start"]].encode()), len(text[: s["start"] + s["length"]].encode())) for s in spans]
        at, want = 0, [0]
        for i in ids[:-1]:
            want.append(want[-1] + any(at < y and at + sizes[i] > x for x, y in edges if y > x))
            at += sizes[i]
        assert packing.bearing(text, ids, spans, sizes).tolist() == [*want, want[-1]]


def test_packing_empty(none):
    assert packing.pack(none, PATH).count() == 0


@pytest.mark.parametrize("cut", [True, False])
def test_fill_limits(cut):
    rng = np.random.default_rng(0)
    limits = packing.Limits(tokens=100, segments=4, loss=60)
    tokens = rng.integers(1, 250, 300)
    masks = [rng.random(n) < p for n, p in zip(tokens, rng.choice([0, 0.3, 1.0], 300))]
    loss = [None if m.all() else np.r_[0, np.cumsum(m)] for m in masks]
    done, rest = packing.fill(tokens, loss, limits, cut, True)
    assert not rest
    seen = defaultdict(list)
    for row in done:
        assert len(row) <= 4 and sum(n for *_, n in row) <= 100
        assert sum(masks[k][at : at + n].sum() for k, at, n in row) <= 60
        for k, start, n in row:
            seen[k].append((start, n))
    for k, size in enumerate(tokens):
        at = 0
        for start, n in sorted(seen[k]):
            assert start == at
            at += n
        assert at == size


def test_warc(spark):
    rows = [(1, "http://a", "<p>é</p>"), (2, "http://b", "<p>é</p>"), (3, None, None), (4, "x\r\ny", ""), (5, "u", "WARC/1.1\r\n\r\nContent-Length: 3"), (None, "n", "<p>é</p>"), (1, "http://again", "<p>é</p>"), (6, "long", "z" * 200_000)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, id string, bytes int")
    got = Counter(tuple(r) for r in warc.revisit_table(df).collect())
    first = {}
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(h or "", i)
    want = Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        o = first[h or ""]
        want[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if o == i else "revisit", None if o == i else o] += 1
    assert got == want


def test_warc_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(k, f"http://x/{k}", "page\r\n\r\n" * (k % 3)) for k in range(9)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    index = warc.write_archives(df, path, least_bytes=1)
    back = {r.id: r for r in warc.read_archives(index).collect()}
    assert all(r.whole for r in back.values()) and [back[k].type for k in (0, 3, 6)] == ["response"] * 3  # empty payloads
    assert back[4].type == "revisit" and back[4].refers == 1 and back[1].payload == "page\r\n\r\n"
    assert [r.uri for r in warc.read_archives(index.filter("id = 5")).collect()] == ["http://x/5"]  # one record by itself
    part = next(tmp_path.glob("w/archives/*.warc.gz"))
    assert gzip.decompress(part.read_bytes()).startswith(b"WARC/1.1\r\nWARC-Type: ")


def test_warc_shuffles_headers(spark):
    """What is dealt out by digest holds no payload."""
    df = spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")
    rows = df.select(F.col("page_id").alias("id"), F.col("url").alias("uri"), F.sha1("html").alias("sha1"), F.octet_length("html").alias("bytes"))
    assert warc.resolve(rows).columns == ["sha1", "id", "uri", "bytes", "original"]


def test_warc_changed_payload_fails(spark, tmp_path):
    """A payload that is not what its header says is noticed."""
    path = f"file://{tmp_path}/c"
    index = warc.write_archives(spark.createDataFrame([(1, "u", "good")], "page_id long, url string, html string"), path)
    row = index.first()
    raw = gzip.decompress((tmp_path / "c/archives" / row.file.rsplit("/", 1)[1]).read_bytes()).replace(b"good", b"evil")
    (tmp_path / "other.gz").write_bytes(packed := gzip.compress(raw))
    other = spark.createDataFrame([(1, f"file://{tmp_path}/other.gz", 0, len(packed))], warc._INDEX)
    assert [r.whole for r in warc.read_archives(other).collect()] == [False]


def test_warc_lost_response_fails(spark, tmp_path):
    """A revisit whose response can't be read does not vanish."""
    pages = spark.createDataFrame([(1, "u", "<a>"), (2, "v", "<a>"), (3, "w", "<b>")], "page_id long, url string, html string")
    index = warc.write_archives(pages, f"file://{tmp_path}/w")
    assert warc.resolved(index).count() == 3
    with pytest.raises(Exception, match="no response for the revisit in record 2"):
        warc.resolved(index.filter("id <> 1")).collect()


def test_warc_empty(spark):
    assert warc.revisit_table(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "</s>[INST] \\l \\<b \\\\["), (1, 1, "assistant", "<e>\\b[x]<t>"), (1, 1, "assistant", "<e>\\b[x]<t>"), (2, 1, None, None), (2, None, "assistant", "é😀"), (None, 0, "a<b", "x"), (3, 0, "user", "z" * 100_000), (2, 0, "system", "")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, parts int")
    got = {r.conv_id: r for r in chat.digest(chat.format_turns(chat.text_turns(df))).collect()}
    groups = defaultdict(list)
    for c, t, r, x in rows:
        groups[c].append(((t is None, t or 0), r or "", x or ""))
    assert set(got) == set(groups)
    for c, g in groups.items():
        g.sort()
        said = "".join(f"{r}\n{x}\n" for _, r, x in g)
        loss = "".join(x for _, r, x in g if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(g), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_parts(spark):
    part = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
    rows = [(1, 0, "user", [("text", "look <image:0>", None, None, None, None, None), ("image", None, "a.png", 56, 30, None, None), ("audio", None, "b.wav", None, None, 2.0, None)]), (1, 1, "assistant", [("document", None, "c.pdf", None, None, None, 3), ("text", "done", None, None, None, None, None), ("odd", None, "d", None, None, None, None)]), (2, 0, "user", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {part}")
    got = {r.conv_id: r for r in chat.format_turns(df).collect()}
    r = got[1]
    assert r.formatted == "<t>user<m>look \\limage:0><image:0><audio:1><e><t>assistant<m><document:2>done<odd:3><e>"
    assert [(a["index"], a.ref, a.tokens) for a in r.attachments] == [(0, "a.png", 4), (1, "b.wav", 50), (2, "c.pdf", 768), (3, "d", 1)] and r.attachment_tokens == 823
    s = r.loss[0]
    assert r.formatted[s.start : s.start + s.length] == "<document:2>done<odd:3>"
    assert got[2].formatted == "<t>user<m><e>" and got[2].attachments == []


def test_chat_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest(chat.format_turns(chat.text_turns(df))).count() == 0


def test_chat_is_native(spark):
    plan = chat.digest(chat.format_turns(chat.text_turns(chat.probe(spark))))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_pipeline(spark):
    """Each stage by itself on what its predecessor kept, and clean documents stay."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept[-1], sf)
        assert out.columns == docs.columns
        out = spark.createDataFrame(out.collect(), docs.schema)
        kept.append(out)
    assert kept[1].count() == docs.filter(F.col("text").rlike("\\p{L}")).count()  # all documents are in a learned language
    same = kept[1].withColumn("n", F.regexp_replace("text", "[\\x20\\x09-\\x0D]+", " "))
    assert kept[2].count() == same.select("n").distinct().count()
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = {r.doc_id for r in kept[4].collect()}
    for r in kept[3].collect():
        assert (r.doc_id in left) == (not any(b in r.text for b in bench))
    last = corpus_pipeline.STAGES[-1][1](spark, kept[4], sf)
    assert {r.doc_id for r in last.select("doc_id").distinct().collect()} == left
    odd = docs.withColumn("text", F.lit(None).cast("string"))
    assert corpus_pipeline.STAGES[0][1](spark, odd, sf).count() == 0


def stage_input(odd):
    return odd.withColumns({"source": F.lit("s"), "n_chars": F.length("text")})


def test_stages_on_odd_rows(spark, odd, none):
    """Nulls, ties, repeated rows, long texts, clashing columns and empty tables, stage by stage."""
    sf = "/root/testdata/sf0.001"
    df, stage = stage_input(odd), dict(corpus_pipeline.STAGES)
    rows = lambda out: Counter((r.doc_id, r.text) for r in out.collect())
    told = rows(df)
    with_letters = Counter({k: n for k, n in told.items() if k[1] and any(c.isalpha() for c in k[1])})
    language = stage["language_id"](spark, df, sf)
    assert language.columns == list(corpus_pipeline.COLUMNS) and not rows(language) - with_letters
    exact = rows(stage["exact_dedup"](spark, df, sf))
    groups = defaultdict(list)
    for i, t in told:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append((i is None, i))
    assert sum(exact.values()) == len(exact) == len(groups) and all((i is None, i) == min(groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")]) for i, t in exact)
    near = rows(stage["near_dedup"](spark, df, sf))
    assert set(told) - set(near) == {(2, "The cat  sat\ton the mat and looked at the dog"), (7, odd.filter("doc_id = 7").first().text)} and max(near.values()) == 1
    assert rows(stage["decontamination"](spark, df, sf)) == told
    packed = Counter(r.doc_id for r in stage["packing"](spark, df, sf).filter("start = 0").collect())
    assert packed == Counter(r.doc_id for r in df.collect())
    for f in stage.values():
        assert f(spark, stage_input(none), sf).count() == 0


def test_near_and_benchmark_stages(spark):
    """Both against brute force: five-word shingles at 0.8, and edits within the budget."""
    from boxtrail.llm import decontamination

    rng = random.Random(21)
    text = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    rows = []
    for i in range(60):
        if i % 3 and rows:
            w = rows[-1][1].split()
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = f"x{i}"
        else:
            w = text(80)
        rows.append((i, " ".join(w)))
    sf = "/root/testdata/sf0.001"
    item = spark.read.parquet(f"{sf}/benchmark.parquet").filter("length(text) > 60").first().text
    rows += [(100, f"before {item.upper()} after"), (101, "a " + item[:30] + "#" + item[31:] + " b"), (102, "a " + item[: len(item) // 2])]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    sets = {i: {tuple(t.lower().split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    stage = dict(corpus_pipeline.STAGES)
    assert {r.doc_id for r in stage["near_dedup"](spark, df, sf).collect()} == {i for i in sets if find(i) == i}
    bench = [decontamination.plain(r.text or "") for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]

    def holds(t):
        t = decontamination.plain(t)
        return any(b and decontamination.myers(b, t, len(b) // decontamination.CHARS_PER_EDIT) is not None for b in bench)

    assert {r.doc_id for r in stage["decontamination"](spark, df, sf).collect()} == {i for i, t in rows if not holds(t)}
