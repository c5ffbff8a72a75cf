"""The shipment fact and its feature tables.

The 6-way join runs once per session and input state and is written, with the tables' own columns, as
Parquet into the shared checkpoint folder (see
:mod:`lanecraft.plans.materialize`), with the factory that hangs on the part.
The batch-featured table every analytic reads is written from it in one more
pass; the other tables (quality view, recalculated, dirtied raw) are narrow
expressions over the written fact and are not copied.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession, functions as F

from lanecraft import schema as S
from lanecraft.operators import clean, feature
from lanecraft.plans.materialize import materialize, partitions_for, shared_path, stored_bytes
from lanecraft.sources import testdata as td
from lanecraft.sources.ledger import Ledger
from lanecraft.sources.versions import VersionStore

_LOCK = threading.RLock()
_MEMO: dict = {}
_BUILDING: dict = {}


def _memo(spark: SparkSession, key: tuple, build):
    """Results are kept per session and input folder (the key's second part) until ``refresh``; each is built once, several
    at a time."""
    k = (id(spark), spark.sparkContext.applicationId) + key
    with _LOCK:
        own = _BUILDING.setdefault(k, threading.RLock())
    with own:
        if k in _MEMO:
            return _MEMO[k]
        made = _MEMO[k] = build()
        return made


def refresh(sf_dir: str) -> None:
    """Forget what was derived from a folder whose files changed; no query looks at its files by itself."""
    with _LOCK:
        for k in [k for k in _MEMO if sf_dir in k]:
            _MEMO.pop(k, None)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines joined once and written (per session), with the tables' own columns."""
    def build() -> DataFrame:
        n = partitions_for(spark, stored_bytes(td.table(spark, sf_dir, "lineitem")))
        return materialize(td.joined(spark, sf_dir), "base", partitions=n)

    return _memo(spark, ("base", sf_dir), build)


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical shipments with their factory: expressions over the written lines."""
    return td.canonical(lines(spark, sf_dir))


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical 18-column shipments."""
    return shipments(spark, sf_dir).drop(S.FACTORY)


def dirty(spark: SparkSession, sf_dir: str, currency: bool = False) -> DataFrame:
    """The dirtied raw table (stand-in for a raw CSV drop): text expressions over the fact."""
    return td.dirty_shipments(spark, sf_dir, currency, base(spark, sf_dir))


def batch_features(fact: DataFrame, factory_dim: DataFrame | None, coords_dim: DataFrame) -> DataFrame:
    """Batch pipeline: invalid leads dropped, integer lead, median delay policy,
    null coordinates for unknown factories, unrounded route score.  Without a
    ``factory_dim`` the fact brings its factory."""
    return derived(clean.drop_invalid_lead(fact), factory_dim, coords_dim)


def derived(f: DataFrame, factory_dim: DataFrame | None, coords_dim: DataFrame, histogram: DataFrame | None = None) -> DataFrame:
    """The columns of the batch pipeline on rows with valid leads."""
    f = batch_narrow(f, factory_dim, coords_dim)
    return feature.add_delay_and_score(f, "median", histogram=histogram)


def batch_narrow(f: DataFrame, factory_dim: DataFrame | None, coords_dim: DataFrame) -> DataFrame:
    if factory_dim is not None:
        f = feature.add_factory(f, factory_dim)
    f = feature.add_factory_coords(f, coords_dim)
    f = feature.add_lead_days(f)
    f = feature.add_route_ids(f)
    return feature.add_temporal(f)


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Materialized batch-featured table for ``sf_dir`` (built once per session).

    Partitioned by ship year and ordered by month, state and factory, so filters on years prune partitions and
    filters on months, states or factories prune files and row groups.  Rows are dealt to ranges while they have only
    the joined columns (evenly, however hot a value is: the order ends in the row id); everything derived from them is
    added behind the shuffle."""

    def build() -> DataFrame:
        own, cols, coords = lines(spark, sf_dir), td.canonical_columns(), td.factory_coords_dim(spark)
        valid = own.filter(clean.valid_lead(cols[S.ORDER_DATE], cols[S.SHIP_DATE]))
        histogram = materialize(feature.lead_histogram(batch_narrow(td.canonical(valid), None, coords)), "lead-histogram")
        order = [F.year(cols[S.SHIP_DATE]), F.month(cols[S.SHIP_DATE]), cols[S.STATE], cols[S.FACTORY], cols[S.ROW_ID]]
        dealt = td.canonical(valid.repartitionByRange(partitions_for(spark, stored_bytes(valid)), *order))
        return materialize(derived(dealt, None, coords, histogram), "featured", partition_by=["ship_year"],
                           sort_by=["ship_month", S.STATE, S.FACTORY, S.ROW_ID])

    return _memo(spark, ("featured", sf_dir), build)


def audit_features(fact: DataFrame, factory_dim: DataFrame | None, coords_dim: DataFrame) -> DataFrame:
    """Unfiltered fact with factory, coordinates and integer lead (quality checks see every row)."""
    f = feature.add_factory(fact, factory_dim) if factory_dim is not None else fact
    f = feature.add_factory_coords(f, coords_dim)
    return feature.add_lead_days(f)


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_features(shipments(spark, sf_dir), None, td.factory_coords_dim(spark))


def recalc_narrow(df: DataFrame, factory_dim: DataFrame | None, coords_dim: DataFrame, factory_key: str = S.PRODUCT_ID) -> DataFrame:
    """The part of the recalculation that looks at one row at a time: fractional lead clipped at 0.5, factory,
    default coordinates, routes, calendar."""
    f = feature.add_lead_days_clipped(df)
    if factory_dim is not None:
        f = feature.add_factory(f, factory_dim, key=factory_key)
    f = feature.add_factory_coords(f, coords_dim, default=S.DEFAULT_COORDS)
    f = feature.add_route_ids(f)
    return feature.add_temporal(f, day_name=True)


def recalc_features(df: DataFrame, factory_dim: DataFrame | None, coords_dim: DataFrame, sla_dim: DataFrame,
                    policy: str = "auto", delay_weight: float = S.DELAY_WEIGHT,
                    lead_weight: float = S.LEAD_TIME_WEIGHT, factory_key: str = S.PRODUCT_ID,
                    histogram: DataFrame | None = None) -> DataFrame:
    """Recalculation dialect: every row kept, SLA / median / auto delay policy, score 4 dp, null → 0.5."""
    f = recalc_narrow(df, factory_dim, coords_dim, factory_key)
    return feature.add_delay_and_score(f, policy, sla_dim, delay_weight=delay_weight, lead_weight=lead_weight, fill=0.5, digits=4,
                                       histogram=histogram)


def empty_ledger(spark: SparkSession, sf_dir: str, name: str) -> Ledger:
    """A ledger without rows, for rows of ``sf_dir``."""
    dims = td.factory_dim(spark, sf_dir), td.factory_coords_dim(spark)
    return Ledger(VersionStore(spark, shared_path(spark, name)), lambda df: recalc_narrow(df, *dims))


def ledger(spark: SparkSession, sf_dir: str) -> Ledger:
    """The base table of ``sf_dir`` as a versioned table (loaded once per session); clone it before changing it."""

    def build() -> Ledger:
        out = empty_ledger(spark, sf_dir, "ledger")
        out.load(base(spark, sf_dir))
        return out

    return _memo(spark, ("ledger", sf_dir), build)


def ledger_features(spark: SparkSession, sf_dir: str, book: Ledger, policy: str = "auto") -> DataFrame:
    """The recalculated table of a ledger's current version, from its own histogram."""
    return recalc_features(book.rows(), td.factory_dim(spark, sf_dir), td.factory_coords_dim(spark), td.sla_dim(spark), policy,
                           histogram=book.histogram())


def recalculated(spark: SparkSession, sf_dir: str, policy: str = "auto") -> DataFrame:
    """Narrow over the fact: only its limits and scores are computed (once) and written."""
    return _memo(spark, ("recalc", sf_dir, policy), lambda: recalc_features(
        shipments(spark, sf_dir), None, td.factory_coords_dim(spark), td.sla_dim(spark), policy=policy))


def domestic(df: DataFrame, allow: DataFrame) -> DataFrame:
    """Keep rows whose state is in the allow-list (left-semi join)."""
    return df.join(allow.select(F.col(S.STATE).alias("__s")).distinct(), F.col(S.STATE) == F.col("__s"), "left_semi")
