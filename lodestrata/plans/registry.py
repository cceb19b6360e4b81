"""Every query of the library by name, and its DuckDB twin."""

from __future__ import annotations

from . import analytics, decisions, details, files, retrieval, stateful, texts

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (retrieval, analytics, stateful, texts, details, decisions, files):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES

FLAGSHIP = retrieval.ranked_search
