"""The registered queries of this subpackage, and SQL for those it can express."""

from __future__ import annotations

from celestile.llm import decontaminate, mixing, sharding, simhash, sketch, suffix_tree, token_counts, token_files, toxicity, url_filters

QUERIES = {
    "op1_url_filters": url_filters.query,
    "op2_token_files": token_files.query,
    "op3_suffix_tree": suffix_tree.query,
    "op4_sketch": sketch.query,
    "op5_token_counts": token_counts.query,
    "op6_jump_shards": sharding.query,
    "op7_toxicity": toxicity.query,
    "op8_mixing": mixing.query,
    "op9_simhash": simhash.query,
    "op10_decontamination": decontaminate.query,
}
ORACLE_SQL: dict[str, str] = {"op1_url_filters": url_filters.SQL}
