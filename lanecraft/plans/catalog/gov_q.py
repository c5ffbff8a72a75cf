"""§2.13 governance queries on the events table (audit stand-in) and
customer ⟕ nation (key ⟕ owner stand-in)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from lanecraft import schema as S
from lanecraft.operators import governance as G
from lanecraft.plans.materialize import shared_path
from lanecraft.sources import files as IO
from lanecraft.sources import testdata as td
from lanecraft.streaming.audit_table import AuditTable

NOW = dt.datetime(2024, 1, 15)
SEARCH = '"k": 1'


def _events(s, d):
    return td.table(s, d, "events")


def _audit(s, d):
    return G.audit_log(_events(s, d))


def _append(s, d):
    path = shared_path(s, "audit-log")
    a = _audit(s, d)
    G.append_audit(a, path)
    G.append_audit(a.filter(F.col("action") == "error"), path)
    return s.read.parquet(path).groupBy("log_date").agg(F.count(F.lit(1)).alias("rows"))


def _latest(s, d):
    """The log arrives in four batches and is folded; the newest entries come from its newest dates."""
    table, a = AuditTable(s, shared_path(s, "audit-table")), _audit(s, d)
    for i in range(4):
        table.add(a.filter(F.pmod(F.col("event_id"), F.lit(4)) == i), i)
    table.compact()
    return table.latest(500)


def keys_table(s, d):
    c = td.table(s, d, "customer")
    prefix = F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("LEGACY"), F.col("c_custkey").cast("string"))).otherwise(
        F.concat(F.lit("DEV-KEY-"), F.hex(F.col("c_custkey")), F.lit("-SECRET")))
    return c.select(F.col("c_custkey").alias("key_id"), F.col("c_nationkey").cast("long").alias("owner_id"),
                    F.col("c_name").alias("name"), prefix.alias("key_prefix"),
                    F.when(F.col("c_acctbal") < 0, "REVOKED").otherwise("ACTIVE").alias("status"),
                    F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 30).cast("int"))
                     .cast("timestamp_ntz").alias("expires_at"))


def owners_table(s, d):
    n = td.table(s, d, "nation")
    return n.filter(F.col("n_nationkey") != 24).select(F.col("n_nationkey").cast("long").alias("owner_id"),
                                                        F.col("n_name").alias("owner_name"))


def _meta(s, d):
    e = _events(s, d)
    return e.select(F.col("event_type").alias("model_name"), F.col("event_id").cast("string").alias("version"),
                    F.col("value").alias("metrics"), F.col("user_id").cast("string").alias("trained_by"),
                    F.col("ts").alias("trained_at"))


def overrides_table(s, d):
    e = _events(s, d)
    key = F.when(F.col("event_type") == "error", F.lit("alert_thresholds.bottleneck_delay_rate_pct")).otherwise(
        F.concat(F.lit("event_counts."), F.col("event_type")))
    return e.groupBy(key.alias("key")).agg(F.count(F.lit(1)).cast("string").alias("value"))


def edits_table(s, d):
    n = td.table(s, d, "nation")
    k = F.col("n_nationkey")
    return n.select(
        F.when(k % 6 == 0, F.lit("  ")).otherwise(F.concat(F.lit("  "), F.col("n_name"), F.lit(" "))).alias("name"),
        F.when(k % 5 == 0, F.lit("n/a")).otherwise((k + 25).cast("string")).alias("lat"),
        (k * 2 - 120).cast("string").alias("lon"))


QUERIES = {
    "gov_audit_append": _append,
    "gov_audit_fanout": lambda s, d: G.fanout(_audit(s, d)),
    "gov_audit_latest": _latest,
    "gov_last_event": lambda s, d: G.last_success(_audit(s, d), "purchase"),
    "gov_token_status": lambda s, d: G.token_status(G.tokens(_events(s, d)), NOW, "ACTIVE", SEARCH),
    "gov_key_listing": lambda s, d: G.key_listing(keys_table(s, d), owners_table(s, d), NOW),
    "gov_table_counts": lambda s, d: G.table_counts(
        {t: IO.footer_stats(s, f"{d}/{t}.parquet")["rows"] for t in ("events", "customer", "nation")},
        G.tokens(_events(s, d))),
    "gov_model_registry": lambda s, d: G.model_registry(_meta(s, d)),
    "gov_config_overlay": lambda s, d: G.config_overlay(G.flatten_config(s, S.default_config()), overrides_table(s, d)),
    "gov_weight_pair": lambda s, d: G.weight_pair(td.table(s, d, "region").select((F.col("r_regionkey") / 10).alias("delay_weight"))),
    "gov_config_edit_check": lambda s, d: G.config_edit_check(edits_table(s, d)),
}

AUDIT = """a AS (SELECT event_id, ts, CAST(user_id AS VARCHAR) AS actor, 'Platform' AS module, event_type AS action,
  CASE WHEN event_type = 'error' THEN 'Failure' ELSE 'Success' END AS status,
  event_type || ' value=' || CAST(value AS VARCHAR) AS details, props AS metadata_json FROM events)"""
TOK = """tok AS (SELECT 'TOK-' || CAST(event_id AS VARCHAR) AS token, ts AS created_at, ts + INTERVAL 5 DAY AS expiry_date,
  CASE WHEN event_type = 'purchase' THEN 'USED' WHEN event_type = 'error' THEN 'REVOKED' ELSE 'ACTIVE' END AS status,
  CASE WHEN event_type = 'purchase' THEN CAST(user_id AS VARCHAR) END AS used_by, props AS notes FROM events)"""


def _w(*ctes):
    return "WITH " + ",\n".join(ctes) + "\n"


def _flat_values() -> str:
    rows = []

    def walk(prefix, v):
        if isinstance(v, dict):
            for k, x in v.items():
                walk(f"{prefix}.{k}" if prefix else str(k), x)
        else:
            rows.append((prefix, str(v)))
    walk("", S.default_config())
    return "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in rows) + ") t(key, value)"


SQL = {
    "gov_weight_pair": "SELECT r_regionkey / 10 AS delay_weight, 1.0 - r_regionkey / 10 AS lead_time_weight FROM region",
    "gov_audit_append": _w(AUDIT) + """SELECT log_date, count(*) AS rows FROM (
  SELECT CAST(ts AS DATE) AS log_date FROM a UNION ALL SELECT CAST(ts AS DATE) FROM a WHERE action = 'error')
GROUP BY log_date""",
    "gov_audit_fanout": _w(AUDIT) + """SELECT 'developer_audit' AS log, event_id, ts, actor, 'IAM' AS module, action, status, details FROM a
UNION ALL SELECT 'audit', event_id, ts, 'DEV:' || actor, 'DeveloperIAM:IAM', action, status, details FROM a""",
    "gov_audit_latest": _w(AUDIT) + "SELECT * FROM a ORDER BY ts DESC, event_id DESC LIMIT 500",
    "gov_last_event": _w(AUDIT) + """SELECT actor AS username, ts, event_id FROM a
WHERE action = 'purchase' AND status = 'Success' ORDER BY ts DESC, event_id DESC LIMIT 1""",
    "gov_token_status": _w(TOK) + f"""SELECT token, created_at, expiry_date,
  CASE WHEN status = 'ACTIVE' AND expiry_date < TIMESTAMP '2024-01-15 00:00:00' THEN 'EXPIRED' ELSE status END AS status,
  used_by, notes FROM tok WHERE status = 'ACTIVE' AND (
  contains(lower(coalesce(token, '')), '{SEARCH.lower()}') OR contains(lower(coalesce(used_by, '')), '{SEARCH.lower()}')
  OR contains(lower(coalesce(notes, '')), '{SEARCH.lower()}'))""",
    "gov_key_listing": _w("""k AS (SELECT c_custkey AS key_id, CAST(c_nationkey AS BIGINT) AS owner_id, c_name AS name,
  CASE WHEN c_custkey % 7 = 0 THEN 'LEGACY' || CAST(c_custkey AS VARCHAR)
       ELSE 'DEV-KEY-' || upper(hex(c_custkey)) || '-SECRET' END AS key_prefix,
  CASE WHEN c_acctbal < 0 THEN 'REVOKED' ELSE 'ACTIVE' END AS status,
  CAST(DATE '2024-01-01' + CAST(c_custkey % 30 AS INTEGER) AS TIMESTAMP) AS expires_at FROM customer)""",
                          """o AS (SELECT CAST(n_nationkey AS BIGINT) AS owner_id, n_name AS owner_name FROM nation WHERE n_nationkey <> 24)""") + """
SELECT k.key_id, k.owner_id, coalesce(o.owner_name, 'Unknown') AS owner_name, k.name, k.key_prefix,
  CASE WHEN starts_with(trim(k.key_prefix), 'DEV-KEY-') AND len(string_split(trim(k.key_prefix), '-')) >= 3
         THEN 'DEV-KEY-' || string_split(trim(k.key_prefix), '-')[3] || '-********'
       WHEN length(trim(k.key_prefix)) >= 12 THEN substr(trim(k.key_prefix), 1, 12) || '-********'
       ELSE substr(trim(k.key_prefix), 1, 8) || '********' END AS masked_key,
  CASE WHEN k.status = 'ACTIVE' AND k.expires_at IS NOT NULL AND k.expires_at < TIMESTAMP '2024-01-15 00:00:00'
       THEN 'EXPIRED' ELSE k.status END AS status, k.expires_at
FROM k LEFT JOIN o ON k.owner_id = o.owner_id""",
    "gov_table_counts": _w(TOK) + """SELECT 'events' AS "table", count(*) AS rows FROM events
UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'nation', count(*) FROM nation
UNION ALL SELECT 'active_tokens', count_if(status = 'ACTIVE') FROM tok
UNION ALL SELECT 'used_tokens', count_if(status = 'USED') FROM tok""",
    "gov_model_registry": """SELECT model_name, version, metrics, trained_by, trained_at FROM (
  SELECT event_type AS model_name, CAST(event_id AS VARCHAR) AS version, value AS metrics,
    CAST(user_id AS VARCHAR) AS trained_by, ts AS trained_at,
    row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC) AS rn FROM events)
WHERE rn = 1""",
    "gov_config_overlay": _w(f"d AS ({_flat_values()})",
                             """o AS (SELECT CASE WHEN event_type = 'error' THEN 'alert_thresholds.bottleneck_delay_rate_pct'
  ELSE 'event_counts.' || event_type END AS key, CAST(count(*) AS VARCHAR) AS value FROM events GROUP BY 1)""") + """
SELECT coalesce(o.key, d.key) AS key, d.value AS default_value, o.value AS override_value,
  coalesce(o.value, d.value) AS value, o.value IS NOT NULL AS overridden FROM d FULL OUTER JOIN o ON d.key = o.key""",
    "gov_config_edit_check": """SELECT trim(name) AS name, TRY_CAST(trim(lat) AS DOUBLE) AS lat, TRY_CAST(trim(lon) AS DOUBLE) AS lon
FROM (SELECT CASE WHEN n_nationkey % 6 = 0 THEN '  ' ELSE '  ' || n_name || ' ' END AS name,
        CASE WHEN n_nationkey % 5 = 0 THEN 'n/a' ELSE CAST(n_nationkey + 25 AS VARCHAR) END AS lat,
        CAST(n_nationkey * 2 - 120 AS VARCHAR) AS lon FROM nation)
WHERE name IS NOT NULL AND trim(name) <> ''""",
}
