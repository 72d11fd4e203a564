"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from cairn.llm import decontaminate, hard_negatives, language_id, line_dedup, near_dedup, packing, ranked_search, secrets, sharding, substring_dedup, token_count, toxicity, vector_dedup

QUERIES = {
    "op1_token_count": token_count.op1_token_count,
    "op2_secrets": secrets.op2_secrets,
    "op3_packing": packing.op3_packing,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_language_id": language_id.op6_language_id,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_vector_dedup": vector_dedup.op8_vector_dedup,
    "op9_shards": sharding.op9_shards,
    "op10_suffix_dedup": substring_dedup.op10_suffix_dedup,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_ranked_search": ranked_search.op13_ranked_search,
}

ORACLE_SQL = {
    "op2_secrets": secrets.OP2_SQL,
    "op4_line_dedup": line_dedup.OP4_SQL,
    "op9_shards": sharding.OP9_SQL,
    "op11_hard_negatives": hard_negatives.OP11_SQL,
    "op13_ranked_search": ranked_search.OP13_SQL,
}
