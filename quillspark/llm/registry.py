"""All queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import queries_boilerplate, queries_encodings, queries_lookalike, queries_sentences, queries_split, queries_stuffing, queries_tokens

MODULES = (queries_encodings, queries_split, queries_lookalike, queries_boilerplate, queries_sentences, queries_stuffing, queries_tokens)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracles() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
