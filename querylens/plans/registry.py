"""All queries of the core by name, and their SQL where SQL can say the same."""

from __future__ import annotations

from querylens.plans import comparison, profiles, scores, semantics, streams, texts, traces

_PARTS = (traces, scores, comparison, semantics, profiles, texts, streams)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE = {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
