"""Registered queries: each module exports ``QUERIES`` (name → (spark, sf_dir)
→ DataFrame) and ``SQL`` (name → DuckDB oracle text)."""
