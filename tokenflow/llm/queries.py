"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from tokenflow.llm import (centroid_clusters, embedding_dedup, html_extract, jaccard_join, language_id, line_dedup,
                            lm_scoring, mixing, oracle, packing, quality_rules, toxicity, url_filter, vector_codes)

QUERIES = {
    "op3_html_extract": html_extract.query,
    "op8_embedding_dedup": embedding_dedup.query,
    "op1_jaccard_join": jaccard_join.query,
    "op10_lm_scoring": lm_scoring.query,
    "op4_line_dedup": line_dedup.query,
    "op6_language_id": language_id.query,
    "op2_packing": packing.query,
    "op5_url_filter": url_filter.query,
    "op7_quality_rules": quality_rules.query,
    "op9_mixing": mixing.query,
    "op11_centroid_clusters": centroid_clusters.query,
    "op12_vector_codes": vector_codes.query,
    "op13_toxicity": toxicity.query,
}

ORACLE = dict(oracle.ORACLE)
