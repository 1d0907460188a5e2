"""Exact dedup with composable polynomial fingerprints and a chunkwise comparison of what they find equal.

A text's fingerprint is ``sum (byte + 1) * BASE ** (n - 1 - i)`` modulo two primes.  Chunks of a huge
text are hashed side by side and combined by length-shifted arithmetic:
``H(xy) = H(x) * BASE ** len(y) + H(y)``, which is associative, so chunks may be combined in any tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import kernels as K
from palimpsest.llm.shared import bit_filter, checkpoint, may_be_in, passes

PRIMES = (2147483647, 2147483629)
BASES = (1540483477, 1013904223)
#: Bytes of a hashed chunk: 256 * 2**31 * 4096 stays below 2**53, so a float64 product is exact.
HASH_CHUNK = 4096
#: Bytes of a compared chunk.
COMPARE_CHUNK = 1 << 16

_POWERS = np.array([[pow(b, HASH_CHUNK - 1 - i, p) for b, p in zip(BASES, PRIMES)] for i in range(HASH_CHUNK)], np.float64)

Fingerprint = tuple[int, int, int]  # both hashes and the length
EMPTY: Fingerprint = (0, 0, 0)


def combine(x: Fingerprint, y: Fingerprint) -> Fingerprint:
    """Fingerprint of two byte strings put together."""
    a, b = ((x[k] * pow(BASES[k], y[2], PRIMES[k]) + y[k]) % PRIMES[k] for k in (0, 1))
    return a, b, x[2] + y[2]


def fingerprint(data: np.ndarray) -> Fingerprint:
    """Fingerprint of a byte string; its chunks are hashed together, then combined from the left."""
    if not len(data):
        return EMPTY
    rows = -(-len(data) // HASH_CHUNK)
    padded = np.zeros(rows * HASH_CHUNK)
    padded[-len(data) :] = data  # zeros in front add nothing
    padded[-len(data) :] += 1
    hashes = padded.reshape(rows, HASH_CHUNK) @ _POWERS
    out = EMPTY
    for row in hashes % np.array(PRIMES, np.float64):
        out = combine(out, (int(row[0]), int(row[1]), HASH_CHUNK))
    return out[0], out[1], len(data)


def squeeze(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each run of ASCII white space of a text becomes one space."""
    space = K.SPACE[data]
    again = np.zeros(len(data), bool)
    again[1:] = space[1:] & space[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    again[heads] = False
    before = np.concatenate(([0], np.cumsum(~again)))
    return np.where(space, np.uint8(32), data)[~again], before[offsets]


def _texts(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    data, offsets = squeeze(*K.buffers(batch.column(1)))
    for row in range(batch.num_rows):
        yield data[offsets[row] : offsets[row + 1]]


def _key(mark: Fingerprint) -> int:
    return mark[0] << 31 | mark[1]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, mark (both hashes), size in bytes and SHA-256 of each normalised text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches):
            marks, shas = [], []
            for data in _texts(batch):
                marks.append(fingerprint(data)), shas.append(hashlib.sha256(data).hexdigest())
            cols = [batch.column(0), pa.array([_key(m) for m in marks], pa.int64()), pa.array([m[2] for m in marks], pa.int64()), pa.array(shas)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "mark", "size", "sha"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, mark bigint, size bigint, sha string")


def _chunks(docs: DataFrame, wanted: np.ndarray, by_id: bool) -> DataFrame:
    """(mark, size, doc_id, sha, part, chunk) of the texts that a bit filter of fingerprints, or of fingerprints mixed with ids, lets pass."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches):
            out: dict[str, list] = {k: [] for k in ("mark", "size", "row", "sha", "part", "chunk")}
            ids = batch.column(0).fill_null(0).to_numpy()
            for row, data in enumerate(_texts(batch)):
                mark = fingerprint(data)
                if not passes(shared.value, np.array([_key(mark) ^ int(ids[row]) if by_id else _key(mark)], np.int64))[0]:
                    continue
                sha = hashlib.sha256(data).hexdigest()
                for part, at in enumerate(range(0, max(1, len(data)), COMPARE_CHUNK)):
                    for k, v in zip(out, (_key(mark), mark[2], row, sha, part, data[at : at + COMPARE_CHUNK].tobytes())):
                        out[k].append(v)
            cols = [pa.array(out["mark"], pa.int64()), pa.array(out["size"], pa.int64()), batch.column(0).take(pa.array(out["row"], pa.int64()))]
            cols += [pa.array(out["sha"], pa.string()), pa.array(out["part"], pa.int32()), pa.array(out["chunk"], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["mark", "size", "doc_id", "sha", "part", "chunk"])

    return docs.select("doc_id", "text").mapInArrow(run, "mark bigint, size bigint, doc_id bigint, sha string, part int, chunk binary")


def _unlike(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """(mark, size, doc_id, sha) of the texts that differ in a chunk from the first text with their fingerprint.

    The first texts' chunks are written down, one row for each chunk, so both sides of the comparison are plain shuffles by chunk, and
    adaptive execution deals the copies of a large group over many tasks.  Only what differs goes on from there.
    """
    first = groups.select("mark", "size", F.col("first.doc_id").alias("first_id"), F.col("first.sha").alias("first_sha"))
    who = F.col("mark").bitwiseXOR(F.coalesce("first_id", F.lit(0).cast("long")))
    mine = _chunks(docs, bit_filter(first.select(who.alias("x")), "x"), by_id=True)
    on = ["mark", "size"]
    mine = mine.join(first, on).filter(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("sha") == F.col("first_sha")))
    mine = checkpoint(mine.dropDuplicates([*on, "part"]).select(*on, "part", F.col("chunk").alias("first_chunk")))
    every = _chunks(docs, bit_filter(groups, "mark"), by_id=False)
    return every.join(mine, [*on, "part"]).filter("chunk <> first_chunk").select(*on, "doc_id", "sha").distinct()


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row of ``docs`` (doc_id, text).

    Texts are equal when identical once each run of ASCII white space is one space; null counts as empty.
    Of equal texts the row with the smallest doc_id stays; null ids come after all others.  Of
    repeated rows with that same id one stays.  Extra columns are ignored; an empty table gives an empty result.

    Rows that share a fingerprint are compared with the row that stays, chunk by chunk.  A text that
    shares a fingerprint but differs in a chunk is grouped by its SHA-256 instead.
    """
    rows = checkpoint(fingerprints(docs).withColumns({"uid": F.monotonically_increasing_id(), "own": F.lit("")}))  # uid must not be made anew
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "uid", "sha")
    key = ["mark", "size", "own"]
    several = lambda df: checkpoint(df.groupBy(*key).agg(F.min(rank).alias("first"), F.count("*").alias("n")).filter("n > 1"))
    groups = several(rows)
    odd = checkpoint(_unlike(docs, groups))
    if not odd.isEmpty():  # texts with one fingerprint that differ
        odd = odd.select(F.col("mark").alias("mark_"), F.col("size").alias("size_"), F.col("doc_id").alias("id_"), F.col("sha").alias("sha_"))
        on = (F.col("mark") == F.col("mark_")) & (F.col("size") == F.col("size_")) & F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("sha") == F.col("sha_"))
        rows = rows.join(odd, on, "left").withColumn("own", F.when(F.col("sha_").isNull(), "").otherwise(F.col("sha"))).drop(*odd.columns)
        groups = several(rows)
    # both sides are written down, so a large group can be dealt over many tasks
    return rows.join(groups, key, "left").select(
        "doc_id", F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("uid") == F.col("first.uid"), F.lit(True)).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``exact_duplicates`` keeps, with all their columns.

    The rows that go are taken out by id, so repeated rows with the id of a row that stays all stay.  Rows whose id
    is not among those that go, by a bit filter, are not moved.
    """
    told = checkpoint(exact_duplicates(docs).select("doc_id", "kept"))
    by_id = told.groupBy("doc_id").agg(F.bool_or("kept").alias("kept"))
    drop = checkpoint(by_id.filter("not kept").select(F.col("doc_id").alias("gone")))
    may_go = may_be_in(docs, bit_filter(drop.select(F.coalesce("gone", F.lit(0).cast("long")).alias("x")), "x"))("doc_id")
    doubtful = docs.filter(may_go)
    return docs.filter(~may_go).union(doubtful.join(drop, F.col("doc_id").eqNullSafe(F.col("gone")), "left_anti"))
