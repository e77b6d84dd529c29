"""The registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from importlib import import_module

#: operator module and query function, in the order of the operators.
MODULES = [
    ("warc_fixity", "op1_merkle_fixity"),
    ("crf_langid", "op2_crf_langid"),
    ("wrapper", "op3_wrapper_text"),
    ("secrets", "op4_markov_secrets"),
    ("token_count", "op5_two_tier_counts"),
    ("quality_llr", "op6_ngram_llr"),
    ("decontam", "op7_positional_index"),
    ("minhash_bayes", "op8_bayes_minhash"),
    ("bpe", "op9_batched_bpe"),
    ("feistel", "op10_feistel_shards"),
    ("resident_lloyd", "op11_resident_lloyd"),
    ("suffix_dedup", "op12_suffix_dedup"),
    ("prefix_trie", "op13_prefix_trie"),
]


def queries() -> dict:
    return {name: getattr(import_module(f"gradeframe.llm.{module}"), name) for module, name in MODULES}


def oracle_sql() -> dict[str, str]:
    out = {}
    for module, name in MODULES:
        sql = getattr(import_module(f"gradeframe.llm.{module}"), "ORACLE_SQL", None)
        if sql:
            out[name] = sql
    return out
