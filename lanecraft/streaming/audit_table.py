"""The audit log as a table under a commit log: batches that are written once, compaction, retention.

Every micro-batch becomes a piece (a folder partitioned by date) with its rows per date; the entry that adds it also
notes its batch id, so a batch that comes again after a restart is already in and is left out.  Compaction folds small
pieces into one with a file or few per date and, if asked, drops what retention no longer keeps; the batches that
arrive meanwhile stay.  ``latest`` reads the newest dates first, as many as it needs.  Entries without a time are the
oldest.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from lanecraft.sources.commit_log import CommitLog

DATE = "log_date"
NONE = ""  # the date of rows without a time


class AuditTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = CommitLog(spark, f"{self.root}/log")

    def _state(self) -> dict:
        last = self.log.latest()
        return self.log.read(last) if last else {"pieces": [], "batches": {}}

    def pieces(self) -> list[dict]:
        return self._state()["pieces"]

    # ── writing ────────────────────────────────────────────────────────────
    def _write(self, rows: DataFrame, even: bool = False) -> dict | None:
        """A piece of some rows.  ``even``: dates meet in few files each, hot dates in more (Spark's rebalancing)."""
        dated = rows.withColumn(DATE, F.col("ts").cast("date"))
        if even:
            dated = dated.hint("rebalance", F.col(DATE))
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        dated.write.partitionBy(DATE).parquet(folder)
        written = self.spark.read.schema(dated.schema).parquet(folder)
        dates = {str(d) if d is not None else NONE: n for d, n in written.groupBy(DATE).count().collect()}  # one row a date
        return {"folder": folder, "dates": dates} if dates else None

    def add(self, rows: DataFrame, batch_id: int, source: str = "stream") -> bool:
        """Append a batch; False if it is in already.  Batches of a source come in the order of their numbers."""
        if self._state()["batches"].get(source, -1) >= batch_id:
            return False
        piece, added = self._write(rows), []

        def entry(seq: int, last: dict | None) -> dict:
            last = last or {"pieces": [], "batches": {}}
            new = last["batches"].get(source, -1) < batch_id
            added[:] = [new]
            return {"seq": seq, "pieces": last["pieces"] + ([piece] if piece and new else []),
                    "batches": last["batches"] | ({source: batch_id} if new else {})}

        self.log.append(entry)
        return added[0]

    def compact(self, keep: int | None = None) -> int:
        """Fold the pieces of now into one, of the newest ``keep`` entries if given; the number of pieces left."""
        old = self.pieces()
        if len(old) < 2 and keep is None or not old:
            return len(old)
        rows = self.latest(keep) if keep is not None else self.rows()
        piece = self._write(rows, even=True)
        folders = {p["folder"] for p in old}

        def entry(seq: int, last: dict | None) -> dict:
            more = [p for p in last["pieces"] if p["folder"] not in folders]
            if len(last["pieces"]) - len(more) != len(old):
                return last | {"seq": seq}  # another compaction was first: its pieces stay
            return last | {"seq": seq, "pieces": ([piece] if piece else []) + more}

        return len(self.log.append(entry)[1]["pieces"])

    # ── reading ────────────────────────────────────────────────────────────
    def _read(self, pieces: list[dict]) -> DataFrame:
        out = None
        for p in pieces:
            df = self.spark.read.option("basePath", p["folder"]).parquet(p["folder"])
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        return out

    def rows(self) -> DataFrame:
        """All entries; pieces that were folded are no longer read."""
        pieces = self.pieces()
        if not pieces:
            raise FileNotFoundError("nothing has been appended yet")
        return self._read(pieces).drop(DATE)

    def latest(self, n: int = 500) -> DataFrame:
        """The newest n entries, from the newest dates that hold as many (their counts are in the log)."""
        pieces, held, dates = self.pieces(), 0, []
        counts: dict[str, int] = {}
        for p in pieces:
            for d, k in p["dates"].items():
                counts[d] = counts.get(d, 0) + k
        for d in sorted(counts, reverse=True):
            dates.append(d)
            held += counts[d]
            if held >= n:
                break
        pieces = [p for p in pieces if set(p["dates"]) & set(dates)]
        if not pieces:
            return self.rows().limit(0)
        lowest = dates[-1]
        rows = self._read(pieces)
        if lowest != NONE:
            rows = rows.where(F.col(DATE) >= F.lit(lowest).cast("date"))
        return rows.drop(DATE).orderBy(F.col("ts").desc_nulls_last(), F.col("event_id").desc()).limit(n)
