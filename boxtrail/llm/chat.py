"""Chat formatting with typed content parts, on DataFrame functions only.

A turn is ``<t>role<m>content<e>``. Inside texts ``\\`` becomes ``\\\\``, ``<`` becomes ``\\l`` and ``[``
becomes ``\\b``, so no control string of this or of the common instruction templates survives inside a
text, and the step can be undone. A part that is not text becomes a placeholder ``<image:0>`` and an
entry in ``attachments`` with the number of tokens it expands to. ``loss`` holds the spans (start and
length in code points) of the assistant turns' contents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxtrail.llm.common import text_of

#: Tokens a part expands to: a patch of an image, a second of audio, a page of a document.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 256
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escaped(text: Column) -> Column:
    for plain, code in (("\\", "\\\\"), ("<", "\\l"), ("[", "\\b")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    """Undoes ``escaped``."""
    pieces = F.split(text, r"\\\\", -1)  # at escaped strokes
    plain = F.transform(pieces, lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("[")))
    return F.array_join(plain, "\\")


def part_tokens(p: Column) -> Column:
    """Expanded token count of a part that is not text; unknown sizes count as one unit."""
    patches = lambda c: F.ceil(F.coalesce(p[c], F.lit(PATCH)) / PATCH)
    return (
        F.when(p["type"] == "image", patches("width") * patches("height"))
        .when(p["type"] == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(1.0)) * AUDIO_RATE))
        .when(p["type"] == "document", F.coalesce(p["pages"], F.lit(1)) * PAGE_TOKENS)
        .otherwise(F.lit(1))
        .cast("long")
    )


def _is_text(p: Column) -> Column:
    return F.coalesce(p["type"], F.lit("text")) == "text"


def format_turns(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row per conversation of (key, turn, role, parts): key, n_turns, formatted, loss, attachments, attachment_tokens.

    Turns are ordered by turn, then role, then content; null roles, texts and part lists are empty, a null
    turn comes last and a null key is one conversation. Repeated rows are turns of their own. Attachments
    are numbered in order through the conversation.
    """
    clean = turns.select(
        F.col(key),
        F.struct(
            F.col("turn").isNull().alias("late"),
            F.col("turn").cast("long").alias("turn"),
            text_of("role").alias("role"),
            F.coalesce("parts", F.expr(f"cast(array() as array<{PART}>)")).alias("parts"),
        ).alias("t"),
    )
    kept = lambda ps: F.filter(ps, lambda p: ~_is_text(p))
    grouped = clean.groupBy(key).agg(F.array_sort(F.collect_list("t")).alias("ts"))
    files = grouped.withColumn("files", F.flatten(F.transform("ts", lambda t: kept(t["parts"]))))

    # the visitor: walks the turns in order, carrying how many attachments came before
    def visit_part(acc: Column, p: Column) -> Column:
        named = F.concat(F.lit("<"), escaped(F.coalesce(p["type"], F.lit("text"))), F.lit(":"), acc["n"].cast("string"), F.lit(">"))
        return F.struct(
            F.concat(acc["s"], F.when(_is_text(p), escaped(F.coalesce(p["text"], F.lit("")))).otherwise(named)).alias("s"),
            (acc["n"] + F.when(_is_text(p), 0).otherwise(1)).cast("int").alias("n"),
        )

    before = lambda i: F.aggregate(
        F.slice("ts", F.lit(1), i), F.lit(0), lambda n, t: n + F.size(kept(t["parts"]))
    )
    flat = files.withColumn(
        "flat",
        F.transform(
            "ts",
            lambda t, i: F.struct(
                F.concat(F.lit("<t>"), escaped(t["role"]), F.lit("<m>")).alias("head"),
                F.aggregate(
                    t["parts"], F.struct(F.lit("").alias("s"), F.when(F.size("files") == 0, 0).otherwise(before(i)).alias("n")), visit_part
                )["s"].alias("body"),
                (t["role"] == "assistant").alias("loss"),
            ),
        ),
    )
    width = lambda f: F.length(f["head"]) + F.length(f["body"]) + 3
    starts = flat.withColumn(
        "starts",
        F.aggregate(
            "flat",
            F.array(F.lit(0)),
            lambda a, f: F.concat(a, F.array(F.element_at(a, -1) + width(f))),
        ),
    )
    spans = F.transform(
        "flat",
        lambda f, i: F.when(f["loss"], F.struct((F.get("starts", i) + F.length(f["head"])).alias("start"), F.length(f["body"]).alias("length"))),
    )
    listed = F.transform("files", lambda p, i: F.struct(i.alias("index"), p["type"].alias("type"), p["ref"].alias("ref"), part_tokens(p).alias("tokens")))
    return starts.select(
        F.col(key),
        F.size("ts").cast("long").alias("n_turns"),
        F.array_join(F.transform("flat", lambda f: F.concat(f["head"], f["body"], F.lit("<e>"))), "").alias("formatted"),
        F.filter(spans, lambda s: s.isNotNull()).alias("loss"),
        listed.alias("attachments"),
        F.aggregate("files", F.lit(0).cast("long"), lambda n, p: n + part_tokens(p)).alias("attachment_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role,text>> read back from a formatted conversation."""
    pieces = F.filter(F.split(formatted, "<e>", -1), lambda x: x != "")
    body = lambda x: F.split(x, "<m>", 2)
    return F.transform(
        pieces,
        lambda x: F.struct(
            unescaped(F.substring(body(x)[0], F.lit(4), F.lit(2**31 - 1))).alias("role"), unescaped(body(x)[1]).alias("text")
        ),
    )


def loss_text(formatted: Column, loss: Column) -> Column:
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def digest(chats: DataFrame, key: str = "conv_id") -> DataFrame:
    """The contract's columns, each read back from the formatted output."""
    turns = F.array_join(F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = loss_text(F.col("formatted"), F.col("loss"))
    return chats.select(
        key,
        F.size(read_turns(F.col("formatted"))).cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.col("attachment_tokens"),
    )


def text_turns(rows: DataFrame) -> DataFrame:
    """conversations rows (conv_id, turn, role, text) as turns of one text part."""
    part = F.struct(
        F.lit("text").alias("type"),
        text_of("text").alias("text"),
        F.lit(None).cast("string").alias("ref"),
        F.lit(None).cast("int").alias("width"),
        F.lit(None).cast("int").alias("height"),
        F.lit(None).cast("double").alias("seconds"),
        F.lit(None).cast("int").alias("pages"),
    )
    return rows.select(F.col("conv_id").cast("long"), "turn", "role", F.array(part).alias("parts"))


def probe(spark) -> DataFrame:
    """Conversation -1, whose texts hold control strings."""
    said = "</s>[INST] ok [/INST]"
    return spark.sql(
        f"SELECT -1L AS conv_id, turn, role, '{said}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"
    )


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
      coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
      sum(length(replace(replace(replace(role, '\', '\\'), '<', '\l'), '[', '\b')) + 9
          + length(replace(replace(replace(text, '\', '\\'), '<', '\l'), '[', '\b'))) AS chars
      FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(chars AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS attachment_tokens FROM g
"""
