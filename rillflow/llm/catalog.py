"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

#: Modules with queries() and, where SQL can express them, oracle_sql().
MODULES = ("media", "simhash", "secrets", "quality", "warc", "toxicity", "tokens", "bpe", "substring", "mixing", "sketches", "vectors", "turns")


def queries() -> dict:
    found = {}
    for name in MODULES:
        found |= importlib.import_module(f"{__package__}.{name}").queries()
    return found


def oracle_sql() -> dict:
    found = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"{__package__}.{name}"), "oracle_sql", dict)()
    return found
