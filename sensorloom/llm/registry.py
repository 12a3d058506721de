"""Queries and SQL of the corpus operators."""

from __future__ import annotations

from . import byte_bpe, fingerprint, html_extract, language_id, merkle_manifest, ngram_jaccard, quality_rules, secret_scan, source_divergence, source_mix, suffix_dedup, token_counts, url_filter

QUERIES = {f.__name__: f for f in (
    fingerprint.op1_fingerprint, html_extract.op2_html_extract, secret_scan.op3_secret_scan, byte_bpe.op4_byte_bpe, suffix_dedup.op5_suffix_dedup, source_mix.op6_source_mix, url_filter.op7_url_filter, language_id.op8_language_id, ngram_jaccard.op9_ngram_jaccard, quality_rules.op10_quality_rules,
    source_divergence.op11_source_divergence, merkle_manifest.op12_merkle_manifest, token_counts.op13_token_counts,
)}
ORACLE_SQL = {"op6_source_mix": source_mix.SQL, "op10_quality_rules": quality_rules.SQL, "op11_source_divergence": source_divergence.SQL, "op12_merkle_manifest": merkle_manifest.SQL}
