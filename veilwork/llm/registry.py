"""All queries of the training-data operators, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from . import exact_dedup, language_id, ngram_join, packing, quality, secrets, sentencepieces, suffix_dedup, token_counts, toxicity

_MODULES = (token_counts, toxicity, secrets, packing, suffix_dedup, language_id, sentencepieces, quality, exact_dedup, ngram_join)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
