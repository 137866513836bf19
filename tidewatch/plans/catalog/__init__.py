"""Registered queries: every operator on views over the driver's tables, with the SQL that checks it."""

from __future__ import annotations

import importlib

FAMILIES = ("ingest", "sessions", "rules", "correlate", "risk", "timeline", "views", "evidence", "anomaly")


def _merged(attr: str) -> dict:
    out: dict = {}
    for name in FAMILIES:
        part = getattr(importlib.import_module(f"tidewatch.plans.catalog.{name}"), attr)
        double = set(part) & set(out)
        if double:
            raise ValueError(f"registered twice: {sorted(double)}")
        out.update(part)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracles() -> dict:
    from tidewatch.adapter import with_ctes
    from tidewatch.plans.catalog.base import ORACLE_VIEWS
    return {k: with_ctes(v, ORACLE_VIEWS) for k, v in _merged("ORACLES").items()}
