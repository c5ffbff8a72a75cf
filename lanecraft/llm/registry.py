"""Queries and oracle SQL of this subpackage, for the driver entry point."""

from __future__ import annotations

import re

import corpus_pipeline
from lanecraft.llm import oracle, queries as q


def queries() -> dict:
    out = {k: f for k, f in vars(q).items() if re.match(r"op\d+_", k)}
    out["pipeline"] = corpus_pipeline.run
    return dict(sorted(out.items(), key=lambda x: (len(x[0].split("_")[0]), x[0])))


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
