"""All queries of the engine by name, with equivalent DuckDB SQL."""

from __future__ import annotations

from .plans import answers, artefacts, comparisons, failures, reports, search, small, text_work

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (reports, failures, comparisons, search, text_work, artefacts, answers, small):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
