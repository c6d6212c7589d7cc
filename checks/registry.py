"""All registered queries."""

from __future__ import annotations

import importlib

MODULES = ("extract_checks", "seed_checks", "crawl_checks", "output_checks", "math_checks")


def _collect(field):
    out = {}
    for name in MODULES:
        out.update(getattr(importlib.import_module(f"checks.{name}"), field))
    return out


def queries():
    return _collect("QUERIES")


def oracles():
    return _collect("ORACLES")
