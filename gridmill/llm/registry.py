"""Queries of the training-data operators and of the pipeline, and the SQL of those that SQL can say."""

from __future__ import annotations

import corpus_pipeline
from gridmill.llm import ann, collocations, decontaminate, divergence, exact_dedup, jaccard_join, language_id, packing, quality, secret_scan, substring_dedup, token_counts, url_filter

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op6_substring_dedup": substring_dedup.query,
    "op5_jaccard_join": jaccard_join.query,
    "op1_secret_scan": secret_scan.query,
    "op8_decontamination": decontaminate.query,
    "op9_quality": quality.query,
    "op3_language_id": language_id.query,
    "op7_best_fit_packing": packing.query,
    "op10_nearest_neighbours": ann.query,
    "op2_url_filter": url_filter.query,
    "op4_token_counts": token_counts.query,
    "op11_collocations": collocations.query,
    "op12_divergence": divergence.query,
    "op13_exact_dedup": exact_dedup.query,
}
ORACLES = {
    "op6_substring_dedup": substring_dedup.ORACLE,
    "op5_jaccard_join": jaccard_join.ORACLE,
    "op1_secret_scan": secret_scan.ORACLE,
    "op2_url_filter": url_filter.ORACLE,
    "op11_collocations": collocations.ORACLE,
    "op12_divergence": divergence.ORACLE,
    "op13_exact_dedup": exact_dedup.ORACLE,
}
