"""Queries and DuckDB twins of this subpackage, by name."""

from __future__ import annotations

from . import (
    bpe_words, embed_graph, fertility, fim_fenwick, license_index, mixing, pii_boost, pipeline_query, prefix_trie, quality_fm,
    simhash_trie, token_machine, url_rules, warc_chunks,
)

MODULES = (embed_graph, bpe_words, quality_fm, warc_chunks, url_rules, fertility, mixing, simhash_trie, license_index,
           pii_boost, fim_fenwick, prefix_trie, token_machine, pipeline_query)


def queries() -> dict:
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items() if sql}
