"""Column-expression helpers shared by every operator (all JVM-side, no UDFs).

Rounding: NumPy/pandas ``round(x, n)`` is round-half-even on the binary value;
``rint(x * 10**n) / 10**n`` reproduces it exactly (DuckDB: ``round_even``).
Money is kept as ``decimal(18,4)`` so sums do not depend on partition order.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

__all__ = ["rintn", "rint2", "money_sum", "money_avg", "pct", "safe_div", "slug", "band", "col_or_lit",
           "as_flag_int", "search_predicate", "ratio_pct"]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def col_or_lit(c) -> Column:
    return c if isinstance(c, Column) else F.lit(c)


def rintn(c, n: int) -> Column:
    """Round half-even to ``n`` decimals (NumPy semantics) on a double."""
    scale = float(10 ** n)
    return F.rint(_c(c).cast("double") * F.lit(scale)) / F.lit(scale)


def rint2(c) -> Column:
    return rintn(c, 2)


def money_sum(c, n: int = 2) -> Column:
    """Exact decimal sum rounded (half-up) to ``n`` places, returned as double."""
    return F.round(F.sum(_c(c)), n).cast("double")


def money_avg(c, n: int = 2) -> Column:
    """Mean of a decimal column from its exact sum, rounded half-even, as double."""
    return rintn(F.sum(_c(c)).cast("double") / F.count(_c(c)), n)


def as_flag_int(c) -> Column:
    return F.coalesce(_c(c).cast("int"), F.lit(0))


def safe_div(num, den) -> Column:
    """num / den, null when den is 0 or null (never raises under ANSI)."""
    return F.try_divide(_c(num), _c(den))


def pct(num, den, n: int = 2) -> Column:
    """100·num/den rounded, 0 when den is 0 (pandas ``replace(0, nan).fillna(0)``)."""
    return F.coalesce(rintn(safe_div(_c(num), _c(den)) * 100.0, n), F.lit(0.0))


def ratio_pct(flag_mean, n: int = 2) -> Column:
    """A mean of a 0/1 flag as a rounded percentage."""
    return rintn(_c(flag_mean) * 100.0, n)


def slug(c) -> Column:
    """Replace every character outside [A-Za-z0-9] by an underscore."""
    return F.regexp_replace(_c(c), r"[^A-Za-z0-9]", "_")


def band(c, good: float, warn: float, labels=("good", "warn", "bad")) -> Column:
    """Three-way band: ≥ good → labels[0], ≥ warn → labels[1], else labels[2]."""
    v = _c(c)
    return F.when(v >= good, labels[0]).when(v >= warn, labels[1]).otherwise(labels[2])


def search_predicate(columns, pattern: str, literal: bool = False) -> Column:
    """Case-insensitive match of ``pattern`` in any of ``columns`` (regex by default).

    Null cells never match (pandas ``str.contains(na=False)``).
    """
    if literal:
        needle = F.lower(F.lit(pattern))
        terms = [F.coalesce(F.contains(F.lower(_c(c).cast("string")), needle), F.lit(False)) for c in columns]
    else:
        rx = "(?i)" + pattern
        terms = [F.coalesce(_c(c).cast("string").rlike(rx), F.lit(False)) for c in columns]
    out = terms[0]
    for t in terms[1:]:
        out = out | t
    return out


def money_total(c) -> Column:
    """Exact decimal sum as double (unrounded, order-independent)."""
    return F.sum(_c(c)).cast("double")


def money_mean(c) -> Column:
    """Unrounded mean of a decimal column from its exact sum."""
    return F.sum(_c(c)).cast("double") / F.count(_c(c))


def delay_mean(c="delay_flag") -> Column:
    return F.avg(_c(c).cast("int"))


def margin_pct(profit_sum, sales_sum, n: int = 2) -> Column:
    """Σprofit/Σsales·100 on doubles; 0 when sales is 0 or null."""
    return F.coalesce(rintn(F.try_divide(_c(profit_sum).cast("double"), _c(sales_sum).cast("double")) * 100.0, n),
                      F.lit(0.0))


__all__ += ["money_total", "money_mean", "delay_mean", "margin_pct"]


def literal_table(spark, rows: list[tuple], names: list[str], types: list[str] | None = None):
    """A small literal table built JVM-side (``inline`` of an array of structs),
    so no Python worker is needed to scan it."""
    types = types or [None] * len(names)

    def lit(v, t):
        c = F.lit(v)
        return c.cast(t) if t else c
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(t or "string").alias(n) for n, t in zip(names, types)])
    arr = F.array(*[F.struct(*[lit(v, t).alias(n) for v, n, t in zip(r, names, types)]) for r in rows])
    return spark.range(1).select(F.inline(arr))


__all__ += ["literal_table"]
