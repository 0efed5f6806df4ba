"""The queries of this subpackage and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from . import op1_topk, op2_suffix_dedup, op3_exact_dedup, op4_ngram_join, op5_sharding, op6_toxicity, op7_secrets, op8_packing, op9_line_dedup, op10_bpe, op11_periodic_runs, op12_vector_codes, op13_source_mix

QUERIES = {
    "op2_suffix_dedup": op2_suffix_dedup.op2_suffix_dedup,
    "op3_exact_dedup": op3_exact_dedup.op3_exact_dedup,
    "op4_ngram_join": op4_ngram_join.op4_ngram_join,
    "op5_sharding": op5_sharding.op5_sharding,
    "op7_secrets": op7_secrets.op7_secrets,
    "op9_line_dedup": op9_line_dedup.op9_line_dedup,
    "op10_bpe": op10_bpe.op10_bpe,
    "op1_topk": op1_topk.op1_topk,
    "op6_toxicity": op6_toxicity.op6_toxicity,
    "op8_packing": op8_packing.op8_packing,
    "op11_periodic_runs": op11_periodic_runs.op11_periodic_runs,
    "op12_vector_codes": op12_vector_codes.op12_vector_codes,
    "op13_source_mix": op13_source_mix.op13_source_mix,
}

ORACLE_SQL = {
    "op1_topk": op1_topk.ORACLE,
    "op3_exact_dedup": op3_exact_dedup.ORACLE,
    "op9_line_dedup": op9_line_dedup.ORACLE,
    "op12_vector_codes": op12_vector_codes.ORACLE,
    "op13_source_mix": op13_source_mix.ORACLE,
}
