"""The queries of this package: name -> (spark, sf_dir) -> DataFrame, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxtrail.llm import block_naming, chat, decontamination, language_id, line_dedup, merkle, near_dedup, ngram_trie, packing, spelling, suffix_dedup, toxicity, warc
from boxtrail.llm.common import table


def tokenizer_path() -> str:
    """The public byte-level BPE vocabulary file of the host."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_elias_fano_lm(spark, sf_dir):
    return ngram_trie.lm_scores(table(spark, sf_dir, "documents"))


def op2_block_naming(spark, sf_dir):
    return block_naming.exact_dedup(table(spark, sf_dir, "documents"))


def op3_prefix_doubling(spark, sf_dir):
    spans = suffix_dedup.removed_spans(table(spark, sf_dir, "documents"))
    return spans.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_setsketch_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_vector_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def instruction_packing(spark, sf_dir):
    """All conversations as instruction data: formatted, with the assistant's text bearing loss, under three limits at once."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    chats = chat.format_turns(chat.text_turns(rows))
    texts = chats.select(F.col("conv_id").alias("doc_id"), F.col("formatted").alias("text"), "loss")
    return packing.pack(texts, tokenizer_path(), limits=packing.Limits(tokens=2048, segments=16, loss=1024), loss="loss")


def op6_warc_revisits(spark, sf_dir):
    return warc.revisit_table(table(spark, sf_dir, "pages"), least_bytes=0)


def op7_edit_decontamination(spark, sf_dir):
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_rank_order_language(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"))


def op9_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = chat.text_turns(rows.unionByName(chat.probe(spark)))
    return chat.digest(chat.format_turns(turns))


def op10_counterfactual_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_reduced_alphabet_spelling(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark, sf_dir):
    return merkle.verified(merkle.proofs(table(spark, sf_dir, "documents"), merkle.tampered()))


def op13_line_dedup(spark, sf_dir):
    return line_dedup.line_digest(table(spark, sf_dir, "documents"))


def queries():
    every = (
        op1_elias_fano_lm, op2_block_naming, op3_prefix_doubling, op4_setsketch_near_dedup, op5_vector_packing, op6_warc_revisits, op7_edit_decontamination, op8_rank_order_language, op9_chat_format, op10_counterfactual_toxicity,
        op11_reduced_alphabet_spelling, op12_merkle_manifest, op13_line_dedup, instruction_packing,
    )
    return {f.__name__: f for f in every}


def oracle_sql():
    return {"op2_block_naming": block_naming.ORACLE, "op3_prefix_doubling": suffix_dedup.ORACLE, "op4_setsketch_near_dedup": near_dedup.ORACLE, "op6_warc_revisits": warc.ORACLE, "op9_chat_format": chat.ORACLE, "op11_reduced_alphabet_spelling": spelling.ORACLE, "op12_merkle_manifest": merkle.ORACLE, "op13_line_dedup": line_dedup.ORACLE}
