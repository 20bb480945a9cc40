"""The registered queries of the operators and, where SQL can express them, their check SQL."""

from __future__ import annotations

from llm import (
    bpe,
    exact_dedup,
    fertility,
    jaccard_join,
    licenses,
    materialise,
    mixing,
    pii,
    repeats,
    runs,
    topk,
    toxicity,
    whitening,
)

QUERIES = {
    "op1_pii": pii.query,
    "op2_exact_dedup": exact_dedup.query,
    "op3_materialise": materialise.query,
    "op4_mix_sources": mixing.query,
    "op5_toxicity": toxicity.query,
    "op6_licenses": licenses.query,
    "op7_bpe": bpe.query,
    "op8_jaccard_join": jaccard_join.query,
    "op9_top_k": topk.query,
    "op10_repeats": repeats.query,
    "op11_periodic_runs": runs.query,
    "op12_whitening": whitening.query,
    "op13_fertility": fertility.query,
}

ORACLES = {
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op4_mix_sources": mixing.ORACLE,
    "op9_top_k": topk.ORACLE,
}
