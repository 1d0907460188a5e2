"""A version log on Parquet: commits, images, checkpoints, reports.

Layout of a store::

    identity.json                          store id, format and durability, written once
    data/<unique name>/*.parquet           rows of a commit or an image
    manifest/<edit>,<kind>,<first>,<last>,<unique name>   one empty file for each published commit or image

Rows count only once their manifest file stands, and it is made last, by one exclusive create: a commit shows whole or not at all,
what a lost writer leaves is never read, and of two writers that race for one edit number one fails.  Readers plan from the
listing of ``manifest`` alone.  Rows of an image are range-partitioned and sorted by key, with Bloom filters on keys, so that a range scan or a
point read takes the row groups that may hold its keys only.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import compact, resolve, write

COMMIT, IMAGE = "commit", "image"
#: How a commit is made to last: by the file system that holds the store, which confirms a file when it is closed.
DURABILITY = ("GROUP_SYNC", "SYNC", "NONE")


@dataclass(frozen=True)
class Edit:
    """A published commit or image: sequences from ``first`` to ``last``; an image holds all that is needed up to ``last``."""

    number: int
    kind: str
    first: int
    last: int
    folder: str


@dataclass(frozen=True)
class ReadView:
    """A pinned view: what it lists and its upper sequence never change, whatever is written later."""

    log: VersionLog
    edits: tuple[Edit, ...]
    upto: int

    def read(self) -> DataFrame:
        """All versions of the view."""
        if not self.edits:
            raise FileNotFoundError(f"{self.log.path} holds no commits")
        parts = [self.log.spark.read.parquet(f"{self.log.path}/data/{e.folder}") for e in self.edits]
        return resolve.union(*parts).filter(F.col("seq") <= self.upto)


@dataclass
class VersionLog:
    """A log in a folder that all executors share.  Durability is recorded with the store's identity."""

    spark: SparkSession
    path: str
    durability: str = "GROUP_SYNC"
    options: dict[str, str] = field(default_factory=dict)

    def _path(self, name: str) -> object:
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self) -> object:
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def identity(self) -> dict[str, object]:
        """Store id, format, durability and options; written when the store is first used, then only read."""
        p, fs = self._path("identity.json"), self._fs()
        if not fs.exists(p):
            if self.durability not in DURABILITY:
                raise ValueError(f"durability is one of {DURABILITY}")
            own = {"store_id": str(uuid.uuid4()), "format": 1, "durability": self.durability, "options": self.options}
            out = fs.create(p, False)
            out.write(bytearray(json.dumps(own).encode()))
            out.close()
        return json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.path}/identity.json").collect()))  # one line

    def edits(self) -> list[Edit]:
        """Published commits and images, from the listing alone."""
        fs, folder = self._fs(), self._path("manifest")
        if not fs.exists(folder):
            return []
        names = [x.getPath().getName().split(",") for x in fs.listStatus(folder)]
        return sorted((Edit(int(n[0]), n[1], int(n[2]), int(n[3]), n[4]) for n in names if len(n) == 5), key=lambda e: e.number)

    def manifest(self) -> DataFrame:
        """The edits as a frame."""
        rows = [(e.number, e.kind, e.first, e.last, e.folder) for e in self.edits()]
        return self.spark.createDataFrame(rows, "edit_number long, kind string, first long, last long, folder string")

    def _publish(self, kind: str, first: int, last: int, folder: str, number: int) -> None:
        """Makes rows visible.  The edit number is claimed by a file of its own first, so that a second writer fails."""
        fs = self._fs()
        fs.create(self._path(f"claims/{number:020d}"), False).close()
        fs.create(self._path(f"manifest/{number:020d},{kind},{first},{last},{folder}"), False).close()

    def _next(self) -> int:
        """An edit number above all published and claimed ones."""
        fs, folder = self._fs(), self._path("claims")
        claimed = [int(x.getPath().getName()) for x in fs.listStatus(folder)] if fs.exists(folder) else []
        return 1 + max([0, *claimed, *(e.number for e in self.edits())])

    def pin(self, upto: int | None = None) -> ReadView:
        """The view at a sequence, or the newest: the last image at or below it and the commits after that."""
        every = self.edits()
        end = max((e.last for e in every), default=0) if upto is None else upto
        images = [e for e in every if e.kind == IMAGE and e.last <= end]
        image = max(images, key=lambda e: (e.last, e.number), default=None)
        commits = [e for e in every if e.kind == COMMIT and e.first <= end and e.last > (image.last if image else 0)]
        return ReadView(self, tuple([image] if image else []) + tuple(commits), end)

    def watermark(self) -> int:
        """Last sequence of the newest image, 0 without one."""
        return max((e.last for e in self.edits() if e.kind == IMAGE), default=0)

    def last_sequence(self) -> int:
        """High-water mark, from the listing."""
        return max((e.last for e in self.edits()), default=0)

    def read(self, upto: int | None = None) -> DataFrame:
        """All versions up to a sequence, or to the newest."""
        return self.pin(upto).read()

    def append(self, ops: DataFrame) -> tuple[int, int]:
        """Commits batches (batch_id, ordinal, k, op, v): contiguous sequences, all limits checked, all visible at once.

        Gives first and last sequence; (0, 0) for no operations.  ``ops`` is evaluated once: it is written down, and checked, counted and
        numbered from there.
        """
        self.identity()
        number, after, staged = self._next(), self.last_sequence(), f"staged-{uuid.uuid4().hex}"
        ops.write.mode("errorifexists").parquet(f"{self.path}/data/{staged}")
        held = self.spark.read.schema(ops.schema).parquet(f"{self.path}/data/{staged}")
        try:
            report = write.batch_report(held)
            bad, n = report.filter("status <> 'OK'").first(), report.agg(F.sum("operations")).first()[0]
            if bad is not None:
                raise ValueError(f"batch {bad.batch_id}: {bad.status}")
            if not n:
                return 0, 0
            folder = f"commit-{uuid.uuid4().hex}"
            write.assign_sequences(held, after).drop("batch_id", "ordinal").write.mode("errorifexists").parquet(f"{self.path}/data/{folder}")
        finally:
            self._fs().delete(self._path(f"data/{staged}"), True)
        self._publish(COMMIT, after + 1, after + n, folder, number)
        return after + 1, after + n

    def put(self, key: object, value: object, schema: str = "k string, v string") -> int:
        """One value; gives its sequence."""
        return self.append(self.spark.createDataFrame([(0, 0, 1, key, value)], f"batch_id int, ordinal int, op int, {schema}"))[1]

    def delete(self, key: object, schema: str = "k string, v string") -> int:
        """One tombstone; gives its sequence."""
        return self.append(self.spark.createDataFrame([(0, 0, 2, key, None)], f"batch_id int, ordinal int, op int, {schema}"))[1]

    def flush(self, oldest_snapshot: int | None = None) -> int:
        """Publishes a new image; with an oldest snapshot, only the versions that it and later ones need.  Older data stay for pinned views."""
        number, view = self._next(), self.pin()
        log = view.read()
        if oldest_snapshot is not None:
            log = compact.retain(log, oldest_snapshot)
        folder = f"image-{uuid.uuid4().hex}"
        rows = log.repartitionByRange("k").sortWithinPartitions("k", F.desc("seq"))
        rows.write.option("parquet.bloom.filter.enabled#k", "true").mode("errorifexists").parquet(f"{self.path}/data/{folder}")
        self._publish(IMAGE, 1, view.upto, folder, number)
        return view.upto

    def checkpoint(self, target: str, seq: int | None = None) -> dict[str, int]:
        """Writes the state at a sequence elsewhere, with a facts file, and verifies the copy."""
        view = self.pin(seq)
        rows = resolve.as_of(view.read())
        rows.write.mode("errorifexists").parquet(f"{target}/rows")
        facts = _facts(rows) | {"last_seq": view.upto, "store_id": self.identity()["store_id"]}
        self.spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.text(f"{target}/facts")
        return verify_checkpoint(self.spark, target)


def _facts(rows: DataFrame) -> dict[str, int]:
    got = rows.agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64("k", "seq", "op", "v")).alias("digest")).first()
    return {"rows": got.rows, "digest": got.digest}


def verify_checkpoint(spark: SparkSession, target: str) -> dict[str, int]:
    """Restore check: a checkpoint's rows against its facts; gives rows and last sequence, or raises."""
    want = json.loads(spark.read.text(f"{target}/facts").first().value)
    got = _facts(spark.read.parquet(f"{target}/rows"))
    if any(want[k] != v for k, v in got.items()):
        raise OSError(f"checkpoint {target} differs from its facts")
    return {"rows": got["rows"], "last_seq": want["last_seq"]}


def restore(spark: SparkSession, target: str, path: str) -> VersionLog:
    """A new store from a checkpoint: its rows become the first image, sequences as they were."""
    facts, log = verify_checkpoint(spark, target), VersionLog(spark, path)
    if log.edits():
        raise FileExistsError(f"{path} holds a store")
    log.identity()
    folder = f"image-{uuid.uuid4().hex}"
    spark.read.parquet(f"{target}/rows").write.mode("errorifexists").parquet(f"{path}/data/{folder}")
    log._publish(IMAGE, 1, facts["last_seq"], folder, log._next())
    return log


def read_schema_lock(spark: SparkSession, path: str) -> DataFrame:
    """Fields of a schema lock file (JSON)."""
    return spark.read.json(path, multiLine=True)


def write_reports(reports: DataFrame, path: str) -> None:
    """Reports as JSON lines."""
    reports.write.mode("errorifexists").json(path)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of files; their content is not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
