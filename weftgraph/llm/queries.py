"""The subpackage's registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from . import byte_bpe, decontamination, lm_scoring, ngram_join, personal_data, phrase_mining, quality_classifier, quality_rules, secret_scan, suffix_dedup, toxicity, url_filter, vector_codes

MODULES = (suffix_dedup, url_filter, decontamination, secret_scan, byte_bpe, quality_rules, ngram_join, toxicity, lm_scoring, quality_classifier, phrase_mining, personal_data, vector_codes)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
