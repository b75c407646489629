"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from skein.llm import (
    bpe,
    embed_dedup,
    mixing,
    quality,
    secrets,
    sharding,
    simhash,
    suffix_dedup,
    token_counts,
    toxicity,
)

_MODULES = (quality, secrets, sharding, suffix_dedup, token_counts, simhash, bpe, toxicity, embed_dedup, mixing)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
