"""Collects every catalog module's queries and oracle SQL."""

from __future__ import annotations

import importlib

MODULES = ["routes", "kpis", "geos", "modes", "filtering", "reports", "features", "cleaning", "series_q", "quality_q", "io_q", "gov_q", "stream_q", "ml_q"]


def _load():
    queries, sql = {}, {}
    for m in MODULES:
        mod = importlib.import_module(f"lanecraft.plans.catalog.{m}")
        for k in mod.QUERIES:
            if k in queries:
                raise KeyError(f"duplicate query {k}")
        queries.update(mod.QUERIES)
        sql.update(getattr(mod, "SQL", {}))
    return queries, sql


def queries():
    return _load()[0]


def oracle_sql():
    q, s = _load()
    return {k: v for k, v in s.items() if k in q}
