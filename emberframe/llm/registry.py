"""All queries and SQL of this package."""

import importlib

MODULES = ("queries_mixing", "queries_sharding", "queries_urls", "queries_bpe", "queries_simhash", "queries_ctw", "queries_repeats", "queries_quality", "queries_vectors", "queries_exact", "queries_trie", "queries_divergence")


def _all(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(importlib.import_module(f"emberframe.llm.{module}"), name)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLES")
