"""Queries of the corpus operators and their DuckDB counterparts."""

from __future__ import annotations

from kinetrace.llm import decontamination, divergence, exact_dedup, language_id, near_dedup, pii, repeats, secret_scan, sentencepiece_bpe, sharding, spelling, toxicity, warc

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_suffix_dedup": repeats.op4_suffix_dedup,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_sentencepiece": sentencepiece_bpe.op6_sentencepiece,
    "op7_sharding": sharding.op7_sharding,
    "op8_language_id": language_id.op8_language_id,
    "op9_warc": warc.op9_warc,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_spelling": spelling.op11_spelling,
    "op12_secrets": secret_scan.op12_secrets,
    "op13_divergence": divergence.op13_divergence,
}

ORACLES = {
    "op2_decontamination": decontamination.ORACLE,
    "op3_near_dedup": near_dedup.ORACLE,
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op9_warc": warc.ORACLE,
    "op11_spelling": spelling.ORACLE,
    "op12_secrets": secret_scan.ORACLE,
    "op13_divergence": divergence.ORACLE,
}
