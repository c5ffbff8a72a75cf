"""Streaming form of the audit append (§2.13): events files → audit table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanecraft.plans.materialize import shared_path
from lanecraft.streaming import audit_stream as AS


def _stream(s, d):
    root = shared_path(s, "audit-stream")
    q = AS.start(s, d.rstrip("/"), f"{root}/table", f"{root}/_checkpoint", file_glob="events*.parquet")
    q.awaitTermination()
    return (AS.read_table(s, f"{root}/table").groupBy(F.to_date("ts").alias("log_date"), "status")
              .agg(F.count(F.lit(1)).alias("rows")))


QUERIES = {"gov_audit_stream": _stream}

SQL = {
    "gov_audit_stream": """SELECT CAST(ts AS DATE) AS log_date,
  CASE WHEN event_type = 'error' THEN 'Failure' ELSE 'Success' END AS status, count(*) AS rows
FROM events GROUP BY 1, 2""",
}
