"""The corpus queries and their SQL twins, by name."""

from __future__ import annotations

from plectra.llm import compression, decontam, line_dedup, merkle, minhash, packing, quality, search, secret_scan, sharding, token_files, toxicity, url_filter

QUERIES = {
    "op1_minhash_odd_sketch": minhash.op1,
    "op2_token_files": token_files.op2,
    "op3_spaced_seed_decontam": decontam.op3,
    "op4_extendible_sharding": sharding.op4,
    "op5_secret_worklist": secret_scan.op5,
    "op6_toxicity_grammar": toxicity.op6,
    "op7_swap_packing": packing.op7,
    "op8_fuzzy_lines": line_dedup.op8,
    "op9_temporal_url_filter": url_filter.op9,
    "op10_suffix_quality": quality.op10,
    "op11_compression_quality": compression.op11,
    "op12_merkle_log": merkle.op12,
    "op13_hybrid_search": search.op13,
}

#: DuckDB SQL over the same tables, where SQL can express the result.
ORACLES: dict[str, str] = {
    "op4_extendible_sharding": sharding.ORACLE,
    "op9_temporal_url_filter": url_filter.ORACLE,
    "op12_merkle_log": merkle.ORACLE,
    "op13_hybrid_search": search.ORACLE,
}
