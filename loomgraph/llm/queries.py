"""The queries of this subpackage and, where SQL expresses them, their SQL."""

from __future__ import annotations

from loomgraph.llm import bsi, exponion, fingerprints, importance, jaccard_join, language_id, mixing, oracles, packing, pii, sharding, substring_dedup, toxicity, url_filter

QUERIES = {
    "op1_bit_sliced_top_k": bsi.op1,
    "op2_permutation_sharding": sharding.op2,
    "op3_url_template_filter": url_filter.op3,
    "op4_best_fit_packing": packing.op4,
    "op5_ngram_jaccard_join": jaccard_join.op5,
    "op6_toxicity": toxicity.op6,
    "op7_pii": pii.op7,
    "op8_substring_dedup": substring_dedup.op8,
    "op9_fingerprints": fingerprints.op9,
    "op10_source_mixing": mixing.op10,
    "op11_exponion_clusters": exponion.op11,
    "op12_language_id": language_id.op12,
    "op13_importance_resampling": importance.op13,
}

ORACLE_SQL = {
    "op1_bit_sliced_top_k": bsi.ORACLE,
    "op2_permutation_sharding": sharding.oracle(),
    "op5_ngram_jaccard_join": oracles.jaccard_join(),
    "op8_substring_dedup": oracles.substring_dedup(),
    "op10_source_mixing": oracles.source_mixing(),
    "op11_exponion_clusters": oracles.clustering(),
    "op13_importance_resampling": oracles.importance(),
}
