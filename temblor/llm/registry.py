"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from temblor.llm import bpe, chat_format, decontaminate, divergence, minhash, mixing, periodic_runs, quality_model, quality_rules, secret_scan, suffix_dedup, token_output, url_filter

QUERIES = {
    "op1_quality_rules": quality_rules.query,
    "op2_chat_format": chat_format.query,
    "op3_decontaminate": decontaminate.query,
    "op4_secret_scan": secret_scan.query,
    "op5_url_filter": url_filter.query,
    "op6_mixing": mixing.query,
    "op7_token_output": token_output.query,
    "op8_suffix_dedup": suffix_dedup.query,
    "op9_minhash": minhash.query,
    "op10_quality_model": quality_model.query,
    "op11_divergence": divergence.query,
    "op12_periodic_runs": periodic_runs.query,
    "op13_bpe": bpe.query,
}
ORACLE = {
    "op1_quality_rules": quality_rules.SQL,
    "op2_chat_format": chat_format.SQL,
    "op4_secret_scan": secret_scan.SQL,
    "op5_url_filter": url_filter.SQL,
    "op8_suffix_dedup": suffix_dedup.SQL,
    "op9_minhash": minhash.SQL,
    "op11_divergence": divergence.SQL,
}
