"""All core queries and their SQL, by name."""

from __future__ import annotations

from . import books, incremental, texts

MODULES = (incremental, texts, books)
FLAGSHIP = "inspect_chapters"


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracles() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
