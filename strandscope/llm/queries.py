"""The operators as queries over whole tables, with SQL where SQL can say the same."""

from __future__ import annotations

from . import bpe, chat, decontaminate, exact_dedup, language, lm, merkle, near_dedup, negatives, packing, sharding, substrings, token_files
from .tables import documents, table


def tokenizer_file(name: str) -> str:
    """Path of a vocabulary file of the installed package (a parameter of the operators)."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


QUERIES = {
    "op1_language_id": lambda spark, sf: language.language_query(documents(spark, sf)),
    "op2_repeated_substrings": lambda spark, sf: substrings.remove_repeats(documents(spark, sf)),
    "op3_bpe": lambda spark, sf: bpe.bpe_documents(documents(spark, sf), tokenizer_file("byte_bpe_50k.json")),
    "op4_exact_dedup": lambda spark, sf: exact_dedup.exact_groups(documents(spark, sf)),
    "op5_sharding": lambda spark, sf: sharding.shard_rows(documents(spark, sf)),
    "op6_decontamination": lambda spark, sf: decontaminate.decontamination_query(documents(spark, sf), table(spark, sf, "benchmark")),
    "op7_near_dedup": lambda spark, sf: near_dedup.near_components(documents(spark, sf)),
    "op8_lm_scoring": lambda spark, sf: lm.scoring_query(documents(spark, sf)),
    "op9_chat_formatting": lambda spark, sf: chat.chat_digests(chat.with_probe(table(spark, sf, "conversations"))),
    "op10_token_files": lambda spark, sf: token_files.token_files_query(documents(spark, sf), tokenizer_file("word_bpe_49k.json")),
    "op11_merkle_manifest": lambda spark, sf: merkle.manifest_query(documents(spark, sf)),
    "op12_best_fit_packing": lambda spark, sf: packing.pack_documents(documents(spark, sf), tokenizer_file("byte_bpe_50k.json")),
    "op13_hard_negatives": lambda spark, sf: negatives.hard_negatives(table(spark, sf, "embeddings")),
}

ORACLES = {
    "op2_repeated_substrings": substrings.SQL,
    "op4_exact_dedup": exact_dedup.SQL.format(documents="documents"),
    "op7_near_dedup": near_dedup.SQL,
    "op9_chat_formatting": chat.SQL,
    "op11_merkle_manifest": merkle.SQL,
    "op13_hard_negatives": negatives.SQL,
}
