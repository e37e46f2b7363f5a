"""All queries outside the subpackage for language-model data."""

from __future__ import annotations

from fathomline.plans import events, exports, history, logs, memory, retrieval, texts

_MODULES = (history, logs, memory, retrieval, events, exports, texts)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
FLAGSHIP = QUERIES["hybrid_search"]
