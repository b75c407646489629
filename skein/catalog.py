"""The registry of named queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from skein.queries import entities, exports, relational, reports, texts, walks

_MODULES = (relational, walks, texts, entities, exports, reports)

QUERIES: dict[str, Callable] = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLES: dict[str, str] = {name: s for m in _MODULES for name, s in m.ORACLES.items()}
