"""A version log whose operations are timed."""

from __future__ import annotations

import math
import time
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row

from palimpsest.operators import metrics, resolve
from palimpsest.sources.store import ReadView, VersionLog


@dataclass
class _Meter:
    count: int = 0
    errors: int = 0
    total: float = 0.0
    least: float = math.inf
    most: float = 0.0
    recent: deque = field(default_factory=lambda: deque(maxlen=metrics.RECENT))

    def add(self, latency: float, failed: bool) -> None:
        self.count, self.errors, self.total = self.count + 1, self.errors + failed, self.total + latency
        self.least, self.most = min(self.least, latency), max(self.most, latency)
        self.recent.append(latency)

    def rank(self, share: float) -> float:
        return sorted(self.recent)[math.ceil(share * len(self.recent)) - 1] if self.recent else 0.0


class MeteredLog:
    """Wraps a ``VersionLog``: each call is counted and timed in seconds, a failing one as an error that is still raised.

    Totals are over all calls since the last reset, percentiles over the last 16,384 of an operation.
    """

    def __init__(self, log: VersionLog) -> None:
        self.log = log
        self.reset()

    def reset(self) -> None:
        """Begins a new interval."""
        self._began, self._meters = time.perf_counter(), {op: _Meter() for op in metrics.OPERATIONS}

    def _timed(self, op: str, call: Callable[[], object]) -> object:
        began, failed = time.perf_counter(), True
        try:
            out = call()
            failed = False
            return out
        finally:
            self._meters[op].add(time.perf_counter() - began, failed)

    def put(self, key: object, value: object, **more: str) -> int:
        """One value; gives its sequence."""
        return self._timed("PUT", lambda: self.log.put(key, value, **more))

    def delete(self, key: object, **more: str) -> int:
        """One tombstone; gives its sequence."""
        return self._timed("DELETE", lambda: self.log.delete(key, **more))

    def write(self, ops: DataFrame) -> tuple[int, int]:
        """Batches; gives first and last sequence."""
        return self._timed("WRITE", lambda: self.log.append(ops))

    def get(self, key: object, seq: int | None = None) -> Row | None:
        """The row of one key, or none."""
        return self._timed("GET", lambda: resolve.get(self.log.read(), key, seq).first())

    def scan(self, start: object, end: object, seq: int | None = None) -> DataFrame:
        """Live rows with start <= key < end.  What is timed is the planning; the rows are read where they are used."""
        return self._timed("SCAN", lambda: resolve.scan(self.log.read(), start, end, seq))

    def snapshot(self, seq: int | None = None) -> ReadView:
        """A pinned view."""
        return self._timed("SNAPSHOT", lambda: self.log.pin(seq))

    def summary(self) -> DataFrame:
        """The columns of ``metrics.summary`` for this interval, one row for each operation, 0 where unused."""
        seconds = max(time.perf_counter() - self._began, 1e-9)
        rows = [
            (op, m.count, m.errors, m.total / m.count if m.count else 0.0, m.least if m.count else 0.0, m.most, m.rank(0.5), m.rank(0.95), m.rank(0.99), m.count / seconds)
            for op, m in self._meters.items()
        ]
        kinds = "op string, count long, errors long, mean double, least double, most double, p50 double, p95 double, p99 double, per_second double"
        return self.log.spark.createDataFrame(rows, kinds)
