"""A replicated log on Parquet: appends that continue the chain, bounded reads, truncation, recovery.

One folder for each log number and append; as in ``store``, an append counts once its manifest file stands.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import replog
from palimpsest.sources.store import COMMIT, VersionLog

#: Columns that an entry's hash covers.
HASHED = ("idx", "term", "type", "seq_start", "seq_after", "payload")


@dataclass
class ReplicatedLog:
    """Logs (log_id) of entries idx, term, type, seq_start, seq_after, payload, previous_hash, entry_hash in a shared folder."""

    spark: SparkSession
    path: str

    def _store(self) -> VersionLog:
        return VersionLog(self.spark, self.path)

    def read(self) -> DataFrame:
        """All entries that no later truncation took away.  A manifest name carries the first index that an append may hold beyond."""
        edits = [e for e in self._store().edits() if e.kind in (COMMIT, "cut")]
        parts = []
        for n, e in enumerate(edits):
            if e.kind == COMMIT:
                rows = self.spark.read.parquet(f"{self.path}/data/{e.folder}")
                for cut in (c for c in edits[n + 1 :] if c.kind == "cut"):
                    rows = rows.filter((F.col("log_id") != cut.first) | (F.col("idx") < cut.last))
                parts.append(rows)
        if not parts:
            raise FileNotFoundError(f"{self.path} holds no entries")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def append(self, log_id: int, entries: DataFrame) -> None:
        """Appends chained entries of one log (at most 10,000); refuses what does not continue it."""
        store = self._store()
        number = store._next()
        last = self.read().filter(F.col("log_id") == log_id).orderBy(F.desc("idx")).first() if store.edits() else None
        chained = replog.append_chain(entries.withColumn("log_id", F.lit(log_id).cast("long")), *HASHED, last=last.entry_hash if last else replog.GENESIS)
        folder = f"append-{uuid.uuid4().hex}"
        chained.write.mode("errorifexists").parquet(f"{self.path}/data/{folder}")
        fresh = self.spark.read.parquet(f"{self.path}/data/{folder}")
        before = self.spark.createDataFrame([last], fresh.schema) if last else fresh.limit(0)
        problems = replog.violations(before.unionByName(fresh)).filter(F.col("idx") > (last.idx if last else 0)).first()
        if problems is not None:
            raise ValueError(f"entry {problems.idx}: {problems.problem}")
        store._publish(COMMIT, log_id, 0, folder, number)

    def truncate(self, log_id: int, idx: int, committed: int, applied: int) -> None:
        """Takes away the entries of one log from an index on; what is committed or applied may not go."""
        store = self._store()
        number = store._next()
        replog.truncate_suffix(self.read().filter(F.col("log_id") == log_id), idx, committed, applied)
        store._publish("cut", log_id, idx, "none", number)

    def verify(self) -> DataFrame:
        """(log_id, idx, problem) of entries that break continuity or whose own hash is wrong; empty if the log is whole."""
        log = self.read()
        return replog.violations(log).union(replog.broken_chain(log, *HASHED).withColumn("problem", F.lit("OWN_HASH")))
