"""Map the TPC-H-style test tables onto the canonical shipment table.

``lineitem ⋈ orders ⋈ customer ⋈ nation ⋈ region ⋈ part`` → one row per order
line with the 18 canonical columns.  Dimensions (factory per part, factory
coordinates, state centroids, domestic allow-list, ship-mode speed order)
are derived here too, so every query's work grows with the input tables.

Join plan: lineitem and orders are the two large inputs and are joined on the
order key with a sort-merge join (both sides shuffled once; never a
broadcast, whatever the file-size estimate says).  customer, part, nation
and region are left to Spark's size-checked join selection: broadcast under
``spark.sql.autoBroadcastJoinThreshold`` (estimated from the files), shuffle
join above it, re-checked at runtime by AQE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lanecraft import schema as S
from lanecraft.functions.exprs import literal_table
from lanecraft.plans.materialize import stored_bytes

#: Fixed values of the test-data mapping: ship-mode speed order (slowest first).
TEST_SHIP_MODES = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]
#: SLA thresholds (days) used to exercise the SLA delay policy on the test data.
TEST_SLA_DAYS = {"5-LOW": 760.0, "4-NOT SPECIFIED": 745.0, "3-MEDIUM": 730.0, "2-HIGH": 715.0, "1-URGENT": 700.0}
N_FACTORIES = 5
UNMAPPED_PART_EVERY = 40
MISSING_CENTROID_NATION = 24
DOMESTIC_NATION_LIMIT = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _money(c):
    return c.cast(S.MONEY)


#: what the canonical columns are made of
JOINED = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate",
          "o_custkey", "o_orderdate", "o_orderpriority", "c_mktsegment", "n_name", "r_name", "p_name", "p_type", S.FACTORY]


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joined lines with no more than the tables' own columns (``JOINED``): half as wide as the canonical rows, of which a
    third repeats (the row id, the amounts, the postal code) what others say."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    # the factory hangs on the part: attached here it costs no second shuffle of the lines
    fd = factory_dim(spark, sf_dir).select(F.col(S.PRODUCT_ID).alias("__part"), S.FACTORY)
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    p = p.join(fd, p.p_partkey == fd["__part"], "left").drop("__part")

    # dimension sides: no hint — Spark broadcasts a side whose estimated size
    # (Parquet file size) is under spark.sql.autoBroadcastJoinThreshold and
    # shuffle-joins it otherwise; AQE re-checks with runtime sizes.  The names
    # of nation and region come last: the shuffles carry the nation's key.
    geo = n.join(r, n.n_regionkey == r.r_regionkey)
    orders = o.join(c, o.o_custkey == c.c_custkey)
    # lineitem and orders grow together: never broadcast either, sort-merge
    # join on the order key (spills gracefully, and spreads a single-file
    # input over all shuffle partitions).  A part table too large to broadcast
    # is joined before, so that the lines end up by order, where the columns
    # of an order repeat and take little room.
    large = stored_bytes(table(spark, sf_dir, "part")) > spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    if large:
        li = li.join(p, li.l_partkey == p.p_partkey)
    lo = li.join(orders.hint("merge"), li.l_orderkey == orders.o_orderkey)
    if not large:
        lo = lo.join(p, lo.l_partkey == p.p_partkey)
    # c_custkey is o_custkey, of the same or another integer type
    return lo.join(geo, lo.c_nationkey == geo.n_nationkey).select(*JOINED)


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical typed shipment table (18 columns) from the test tables, and the part's factory."""
    return canonical(joined(spark, sf_dir))


def canonical(lines: DataFrame) -> DataFrame:
    return lines.select(*[c.alias(n) for n, c in canonical_columns().items()])


def canonical_columns() -> dict:
    """The canonical columns and the factory as expressions over ``JOINED``."""
    sales = _money(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    cost = _money(F.col("l_extendedprice") * 0.65)
    row_id = F.concat_ws("-", *[F.col(c).cast("string") for c in
                                ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
                         F.date_format("l_shipdate", "yyyyMMdd"),
                         F.rint(F.col("l_extendedprice") * 100).cast("bigint").cast("string"))
    return {
        S.ROW_ID: row_id,
        S.ORDER_ID: F.col("l_orderkey"),
        S.ORDER_DATE: F.col("o_orderdate").cast("date"),
        S.SHIP_DATE: F.col("l_shipdate").cast("date"),
        S.SHIP_MODE: F.col("o_orderpriority"),
        S.CUSTOMER_ID: F.col("o_custkey"),
        S.COUNTRY: F.lit("US"),
        S.CITY: F.col("c_mktsegment"),
        S.STATE: F.col("n_name"),
        S.POSTAL_CODE: F.col("o_custkey").cast("string"),
        S.DIVISION: F.col("p_type"),
        S.REGION: F.col("r_name"),
        S.PRODUCT_ID: F.col("l_partkey"),
        S.PRODUCT_NAME: F.col("p_name"),
        S.SALES: sales,
        S.UNITS: F.col("l_quantity").cast("int"),
        S.GROSS_PROFIT: _money(sales - cost),
        S.COST: cost,
        S.FACTORY: F.coalesce(F.col(S.FACTORY), F.lit(S.UNKNOWN_FACTORY)),
    }


def dirty_shipments(spark: SparkSession, sf_dir: str, currency: bool = False, base: DataFrame | None = None) -> DataFrame:
    """All-text raw table with injected faults (for the cleaning operators).

    ship date ``31-02-2024`` where part % 97 = 0; order date in ISO form where
    supplier % 7 = 0; sales missing where supplier % 13 = 0 (and written as
    ``$1,234.5678`` when ``currency``); city padded with blanks; product name
    missing where part % 89 = 0; units written ``12.0`` where supplier % 11 = 0
    and ``2.5`` where % 23 = 0; profit ``NaN`` where supplier % 17 = 0; cost
    ``N/A`` where supplier % 19 = 0; every line of orders with key % 100 = 0
    appears twice.  Built from the canonical table (``base``, e.g. its
    materialized copy); the supplier key is the 4th field of the row id.
    """
    c = base if base is not None else shipments(spark, sf_dir)
    supp, part = F.split(F.col(S.ROW_ID), "-").getItem(3).cast("long"), F.col(S.PRODUCT_ID)
    sales_txt = (F.concat(F.lit("$"), F.format_number(F.col(S.SALES), 4)) if currency
                 else F.col(S.SALES).cast("string"))
    d = c.select(
        S.ROW_ID, F.col(S.ORDER_ID).cast("string").alias(S.ORDER_ID),
        F.when(supp % 7 == 0, F.date_format(S.ORDER_DATE, "yyyy-MM-dd"))
         .otherwise(F.date_format(S.ORDER_DATE, "dd-MM-yyyy")).alias(S.ORDER_DATE),
        F.when(part % 97 == 0, F.lit("31-02-2024"))
         .otherwise(F.date_format(S.SHIP_DATE, "dd-MM-yyyy")).alias(S.SHIP_DATE),
        S.SHIP_MODE, F.col(S.CUSTOMER_ID).cast("string").alias(S.CUSTOMER_ID), S.COUNTRY,
        F.concat(F.lit("  "), F.col(S.CITY), F.lit(" ")).alias(S.CITY), S.STATE, S.POSTAL_CODE, S.DIVISION,
        S.REGION, F.col(S.PRODUCT_ID).cast("string").alias(S.PRODUCT_ID),
        F.when(part % 89 == 0, F.lit(None).cast("string")).otherwise(F.col(S.PRODUCT_NAME)).alias(S.PRODUCT_NAME),
        F.when(supp % 13 == 0, F.lit(None).cast("string")).otherwise(sales_txt).alias(S.SALES),
        F.when(supp % 11 == 0, F.concat(F.col(S.UNITS).cast("string"), F.lit(".0"))).when(supp % 23 == 0, F.lit("2.5"))
         .otherwise(F.col(S.UNITS).cast("string")).alias(S.UNITS),
        F.when(supp % 17 == 0, F.lit("NaN")).otherwise(F.col(S.GROSS_PROFIT).cast("string")).alias(S.GROSS_PROFIT),
        F.when(supp % 19 == 0, F.lit("N/A")).otherwise(F.col(S.COST).cast("string")).alias(S.COST),
    )
    return d.unionByName(d.filter(F.col(S.ORDER_ID).cast("long") % 100 == 0))


def factory_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """product_id → factory; every 40th part is left out (→ Unknown Factory)."""
    p = table(spark, sf_dir, "part").select("p_partkey")
    return (p.filter(F.col("p_partkey") % UNMAPPED_PART_EVERY != 0)
             .select(F.col("p_partkey").alias(S.PRODUCT_ID),
                     F.concat(F.lit("Factory#"), (F.col("p_partkey") % N_FACTORIES).cast("string")).alias(S.FACTORY)))


def factory_name_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """product_name → factory (the name-keyed lookup of the reference).

    Names repeat across parts, so a name maps to the factory of its smallest
    mapped part key (a deterministic, unique lookup)."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    fd = factory_dim(spark, sf_dir)
    return (p.join(fd, p.p_partkey == fd[S.PRODUCT_ID])
             .groupBy(F.col("p_name").alias(S.PRODUCT_NAME))
             .agg(F.min_by(S.FACTORY, "p_partkey").alias(S.FACTORY)))


def factory_coords_dim(spark: SparkSession) -> DataFrame:
    """factory → (lat, lon) for the five test factories (5 literal rows)."""
    k = F.col("id")
    return spark.range(N_FACTORIES).select(
        F.concat(F.lit("Factory#"), k.cast("string")).alias(S.FACTORY),
        (F.lit(30.0) + k * 3).cast("double").alias(S.FACTORY_LAT),
        (F.lit(-110.0) + k * 7).cast("double").alias(S.FACTORY_LON))


def state_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """state → abbreviation and centroid; nation 24 has none."""
    n = table(spark, sf_dir, "nation")
    return (n.filter(F.col("n_nationkey") != MISSING_CENTROID_NATION)
             .select(F.col("n_name").alias(S.STATE),
                     F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("state_abbrev"),
                     (F.lit(25.0) + F.col("n_nationkey")).cast("double").alias("state_lat"),
                     (F.lit(-120.0) + 2 * F.col("n_nationkey")).cast("double").alias("state_lon")))


def domestic_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allow-list of destination states (nation key < 20)."""
    n = table(spark, sf_dir, "nation")
    return n.filter(F.col("n_nationkey") < DOMESTIC_NATION_LIMIT).select(F.col("n_name").alias(S.STATE))


def ship_mode_order_dim(spark: SparkSession, modes=None) -> DataFrame:
    modes = modes or TEST_SHIP_MODES
    return literal_table(spark, [(m, i) for i, m in enumerate(modes)], [S.SHIP_MODE, "mode_order"], ["string", "int"])


def sla_dim(spark: SparkSession, thresholds: dict | None = None) -> DataFrame:
    thresholds = thresholds or TEST_SLA_DAYS
    return literal_table(spark, [(k, float(v)) for k, v in thresholds.items()], [S.SHIP_MODE, "sla_days"],
                         ["string", "double"])
