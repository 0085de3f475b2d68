"""Queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from sievework.llm import alignment, audit, bpe, decontamination, language, lines, media, mixing, passages, quality, secrets, simhash, tokens

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_line_dedup": lines.op4_line_dedup,
    "op5_telephony_audio": media.op5_telephony_audio,
    "op6_substring_dedup": passages.op6_substring_dedup,
    "op7_simhash": simhash.op7_simhash,
    "op8_language_id": language.op8_language_id,
    "op9_token_counts": tokens.op9_token_counts,
    "op10_mix_sources": mixing.op10_mix_sources,
    "op11_alignment": alignment.op11_alignment,
    "op12_filter_audit": audit.op12_filter_audit,
    "op13_bpe": bpe.op13_bpe,
}

ORACLES = {
    "op4_line_dedup": lines.OP4_SQL,
    "op10_mix_sources": mixing.OP10_SQL,
    "op12_filter_audit": audit.OP12_SQL,
}
