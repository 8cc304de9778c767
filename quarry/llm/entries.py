"""The registered queries of this folder and their DuckDB twins."""

from __future__ import annotations

from quarry.llm import ann, codes, dedup, importance, langid, mixing, packing, pii, prefix_bpe, quality, secrets, tokens, urls

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_secrets": secrets.op2_secrets,
    "op3_token_counts": tokens.op3_token_counts,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_url_filters": urls.op5_url_filters,
    "op8_minhash_near_dedup": dedup.op8_minhash_near_dedup,
    "op9_source_mixing": mixing.op9_source_mixing,
    "op6_vantage_point_ann": ann.op6_vantage_point_ann,
    "op7_language_id": langid.op7_language_id,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_importance_resampling": importance.op11_importance_resampling,
    "op12_prefix_bpe": prefix_bpe.op12_prefix_bpe,
    "op13_orchard_codes": codes.op13_orchard_codes,
}

#: Queries without a twin here are tested against brute force in ``tests/llm``.
ORACLES = {
    "op2_secrets": secrets.ORACLE,
    "op4_quality_rules": quality.ORACLE,
    "op5_url_filters": urls.ORACLE,
    "op8_minhash_near_dedup": dedup.ORACLE,
    "op9_source_mixing": mixing.ORACLE,
    "op11_importance_resampling": importance.ORACLE,
    "op13_orchard_codes": codes.ORACLE,
}
