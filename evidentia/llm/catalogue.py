"""Queries of the training-data operators, and DuckDB SQL where it can express one."""

from __future__ import annotations

from evidentia.llm import decontamination, embedding_dedup, fill_middle, html_extraction, ngram_join, packing, quality, repeats, secrets, sentencepieces, sessions, sharding, token_counts

MODULES = [secrets, ngram_join, token_counts, sentencepieces, repeats, quality, html_extraction, sharding, embedding_dedup, decontamination, packing, sessions, fill_middle]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in getattr(m, "ORACLE", {}).items()}
