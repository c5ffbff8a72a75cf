"""Governance logs as tables: audit log view, fan-out into two logs, latest
entries, last successful event, token and key listings with derived expiry,
table counts, a latest-wins model registry, configuration overlay and the
configuration edit check.

``now`` is always a parameter (a literal timestamp), so results are
reproducible and the plan has no non-deterministic expression."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from lanecraft.functions.exprs import literal_table

def ntz(when: dt.datetime):
    """A time-zone-free timestamp literal (parsed, not converted)."""
    return F.lit(when.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


AUDIT_COLUMNS = ["ts", "actor", "module", "action", "status", "details", "metadata_json"]


def audit_log(events: DataFrame, module: str = "Platform") -> DataFrame:
    """events → audit rows (actor = user, action = event type, error → Failure)."""
    return events.select(
        F.col("event_id"), F.col("ts"), F.col("user_id").cast("string").alias("actor"), F.lit(module).alias("module"),
        F.col("event_type").alias("action"),
        F.when(F.col("event_type") == "error", "Failure").otherwise("Success").alias("status"),
        F.concat(F.col("event_type"), F.lit(" value="), F.col("value").cast("string")).alias("details"),
        F.col("props").alias("metadata_json"))


def append_audit(rows: DataFrame, path: str) -> None:
    """Append audit rows to a date-partitioned table (append-only, no rewrite)."""
    rows.withColumn("log_date", F.to_date("ts")).write.mode("append").partitionBy("log_date").parquet(path)


def fanout(audit: DataFrame, module: str = "IAM") -> DataFrame:
    """One source event → a dedicated log row and a unified log row (prefixed)."""
    dedicated = audit.select(F.lit("developer_audit").alias("log"), "event_id", "ts", "actor",
                             F.lit(module).alias("module"), "action", "status", "details")
    unified = audit.select(F.lit("audit").alias("log"), "event_id", "ts",
                           F.concat(F.lit("DEV:"), F.col("actor")).alias("actor"),
                           F.lit(f"DeveloperIAM:{module}").alias("module"), "action", "status", "details")
    return dedicated.unionByName(unified)


def latest(audit: DataFrame, n: int = 500) -> DataFrame:
    """Newest n entries (distributed top-k)."""
    return audit.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(n)


def last_success(audit: DataFrame, action: str) -> DataFrame:
    """Latest successful entry of one action (one row, or none)."""
    f = audit.filter((F.col("action") == action) & (F.col("status") == "Success"))
    return (f.agg(F.max_by(F.struct("actor", "ts", "event_id"), F.struct("ts", "event_id")).alias("r"))
             .filter(F.col("r").isNotNull()).select(F.col("r.actor").alias("username"), F.col("r.ts").alias("ts"),
                                                    F.col("r.event_id").alias("event_id")))


def tokens(events: DataFrame, valid_days: int = 5) -> DataFrame:
    """Registration tokens derived from events: expiry = ts + valid_days;
    purchases are USED, errors REVOKED, everything else ACTIVE."""
    return events.select(
        F.concat(F.lit("TOK-"), F.col("event_id").cast("string")).alias("token"),
        F.col("ts").alias("created_at"), (F.col("ts") + F.expr(f"INTERVAL {int(valid_days)} DAYS")).alias("expiry_date"),
        F.when(F.col("event_type") == "purchase", "USED").when(F.col("event_type") == "error", "REVOKED")
         .otherwise("ACTIVE").alias("status"),
        F.when(F.col("event_type") == "purchase", F.col("user_id").cast("string")).alias("used_by"),
        F.col("props").alias("notes"))


def token_status(tok: DataFrame, now: dt.datetime, status_filter: str | None = None,
                 search: str | None = None) -> DataFrame:
    """ACTIVE and expired → EXPIRED; the status filter applies to the *stored*
    status; the search is a case-insensitive substring over token, user, notes."""
    out = tok
    if status_filter and status_filter != "ALL":
        out = out.filter(F.col("status") == status_filter)
    derived = F.when((F.col("status") == "ACTIVE") & (F.col("expiry_date") < ntz(now)), "EXPIRED").otherwise(
        F.col("status"))
    out = out.withColumn("status", derived)
    if search:
        sq = F.lit(search.lower())
        hit = None
        for c in ("token", "used_by", "notes"):
            t = F.coalesce(F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), sq), F.lit(False))
            hit = t if hit is None else hit | t
        out = out.filter(hit)
    return out.orderBy(F.col("created_at").desc(), F.col("token"))


def mask_key(c) -> "F.Column":
    """DEV-KEY-<part>-******** for prefixed keys, else 12 (or 8) visible chars."""
    k = F.trim(c)
    parts = F.split(k, "-")
    prefixed = k.startswith("DEV-KEY-") & (F.size(parts) >= 3)
    return (F.when(prefixed, F.concat(F.lit("DEV-KEY-"), F.get(parts, 2), F.lit("-********")))
             .when(F.length(k) >= 12, F.concat(F.substring(k, 1, 12), F.lit("-********")))
             .otherwise(F.concat(F.substring(k, 1, 8), F.lit("********"))))


def key_listing(keys: DataFrame, owners: DataFrame, now: dt.datetime) -> DataFrame:
    """keys ⟕ owners (missing owner → Unknown), derived expiry status, masked prefix."""
    o = owners.select(F.col("owner_id").alias("__oid"), "owner_name")
    j = keys.join(o, F.col("owner_id") == F.col("__oid"), "left")
    status = F.when((F.col("status") == "ACTIVE") & F.col("expires_at").isNotNull()
                    & (F.col("expires_at") < ntz(now)), "EXPIRED").otherwise(F.col("status"))
    return (j.select("key_id", "owner_id", F.coalesce(F.col("owner_name"), F.lit("Unknown")).alias("owner_name"),
                     "name", "key_prefix", mask_key(F.col("key_prefix")).alias("masked_key"),
                     status.alias("status"), "expires_at")
             .orderBy("key_id"))


def table_counts(tables: dict[str, DataFrame | int], tok: DataFrame) -> DataFrame:
    """Row count per table plus active / used token counts (one row each).

    A table may come as its number of rows, if that is known already (see ``files.footer_stats``)."""
    one = tok.sparkSession.range(1)
    parts = [one.select(F.lit(name).alias("table"), F.lit(t).cast("long").alias("rows")) if isinstance(t, int)
             else t.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows")) for name, t in tables.items()]
    parts.append(tok.agg(F.lit("active_tokens").alias("table"), F.count_if(F.col("status") == "ACTIVE").alias("rows")))
    parts.append(tok.agg(F.lit("used_tokens").alias("table"), F.count_if(F.col("status") == "USED").alias("rows")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def model_registry(meta: DataFrame) -> DataFrame:
    """Keyed latest-wins upsert: one row per model name (newest trained_at),
    listed newest first.  ``max_by`` aggregates partially, so one busy name
    never funnels all its versions into one task."""
    latest_row = (meta.groupBy("model_name")
                      .agg(F.max_by(F.struct("version", "metrics", "trained_by", "trained_at"),
                                    F.struct("trained_at", "version")).alias("r")))
    return (latest_row.select("model_name", "r.version", "r.metrics", "r.trained_by", "r.trained_at")
                      .orderBy(F.col("trained_at").desc(), "model_name"))


def flatten_config(spark, cfg: dict) -> DataFrame:
    rows = []

    def walk(prefix, v):
        if isinstance(v, dict):
            for k, x in v.items():
                walk(f"{prefix}.{k}" if prefix else str(k), x)
        else:
            rows.append((prefix, str(v)))
    walk("", cfg)
    return literal_table(spark, rows, ["key", "value"], ["string", "string"])


def config_overlay(defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """Defaults overlaid by stored overrides per key (full outer join)."""
    d = defaults.select(F.col("key").alias("__dk"), F.col("value").alias("default_value"))
    o = overrides.select(F.col("key").alias("__ok"), F.col("value").alias("override_value"))
    j = d.join(o, F.col("__dk") == F.col("__ok"), "full")
    return j.select(F.coalesce("__ok", "__dk").alias("key"), "default_value", "override_value",
                    F.coalesce("override_value", "default_value").alias("value"),
                    F.col("override_value").isNotNull().alias("overridden"))


def config_edit_check(edits: DataFrame) -> DataFrame:
    """Drop null / blank names, trim, cast coordinates (bad text → null)."""
    name = F.trim(F.col("name"))
    return (edits.filter(F.col("name").isNotNull() & (name != ""))
                 .select(name.alias("name"), F.trim(F.col("lat")).try_cast("double").alias("lat"),
                         F.trim(F.col("lon")).try_cast("double").alias("lon")))


def weight_pair(df: DataFrame, col: str = "delay_weight") -> DataFrame:
    """Second efficiency weight = 1 − first."""
    return df.select(F.col(col).alias("delay_weight"), (F.lit(1.0) - F.col(col)).alias("lead_time_weight"))
