"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts are taken over all training rows on the executors and summed by Spark.  The log-probability
matrix has one row for each hash bucket and one column for each language; it is broadcast
(``BUCKETS * languages`` doubles: 1 MB for four) and documents are scored as sparse rows against it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import kernels as K

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
#: N-grams whose rows of the matrix are gathered at once, however long a text is.
CHUNK = 1 << 17
UNKNOWN = "und"


def _lower_table() -> np.ndarray:
    """Lower-case letter of each code point below 65536; 32 where it is no letter."""
    out = np.full(65536, 32, np.uint32)
    for k in range(65536):
        c = chr(k)
        if c.isalpha():
            low = c.lower()
            out[k] = ord(low) if len(low) == 1 else k
    return out


_LOWER = _lower_table()


def _letters(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters and single blanks of a slice's texts, the offsets of the texts in them, and whether each has a letter."""
    data, offsets = K.buffers(batch.column(batch.schema.get_field_index("text")))
    heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    offsets = heads[offsets]
    low = _LOWER[np.minimum(points, 65535)]
    for k in np.flatnonzero(points > 65535):
        low[k] = points[k] if chr(points[k]).isalpha() else 32
    blank = low == 32
    drop = np.zeros(len(low), bool)
    drop[1:] = blank[1:] & blank[:-1]
    drop[offsets[:-1][offsets[:-1] < offsets[1:]]] = False
    before = np.concatenate(([0], np.cumsum(~drop)))
    letters = np.concatenate(([0], np.cumsum(~blank)))
    return low[~drop], before[offsets], np.diff(letters[offsets]) > 0


def _grams(low: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram of one order, and the offsets of the texts among them."""
    size = np.diff(offsets)
    made = np.maximum(size - order + 1, 0)
    place = np.concatenate(([0], np.cumsum(made)))
    mixed = np.full(max(len(low) - order + 1, 0), order, np.uint32)
    with np.errstate(over="ignore"):
        for k in range(order):
            mixed = (mixed ^ low[k : k + len(mixed)]) * np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
    inside = np.zeros(len(mixed) + 1, np.int8)
    full = made > 0
    np.add.at(inside, offsets[:-1][full], 1)
    np.add.at(inside, offsets[:-1][full] + made[full], -1)
    return (mixed[np.cumsum(inside[:-1]) > 0] & np.uint32(BUCKETS - 1)).astype(np.int64), place


@dataclass(frozen=True)
class Model:
    """Languages in order, log priors, and log probabilities by bucket (rows) and language (columns)."""

    languages: tuple[str, ...]
    priors: np.ndarray
    table: np.ndarray


def train(rows: DataFrame) -> Model:
    """A model of all ``rows`` (text, lang) with a language.

    What reaches the driver is at most ``BUCKETS`` counts for each language; null texts count for the prior only.  Repeated rows
    count each, extra columns do not matter, and an empty table gives a model that knows no language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(BUCKETS + 1, np.int64))  # the last: texts
        for batch in K.slices(batches):
            low, offsets, _ = _letters(batch)
            names, code = np.unique(np.array(batch.column(1).to_pylist(), object).astype(str), return_inverse=True)
            for order in ORDERS:
                bucket, place = _grams(low, offsets, order)
                who = np.repeat(code, np.diff(place))
                found = np.bincount(who * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
                for name, more in zip(names, found):
                    counts[str(name)][:-1] += more
            for name, more in zip(names, np.bincount(code)):
                counts[str(name)][-1] += more
        for name, total in counts.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(total[at])], ["lang", "bucket", "n"])

    parts = rows.filter("lang IS NOT NULL").select("text", "lang").mapInArrow(run, "lang string, bucket bigint, n bigint")
    sums = parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    by: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(BUCKETS + 1))
    for row in sums.toLocalIterator():
        by[row.lang][row.bucket] = row.n
    names = tuple(sorted(by))
    if not names:
        return Model((), np.zeros(0), np.zeros((BUCKETS, 0)))
    all_counts = np.array([by[x] for x in names])
    counts = all_counts[:, :-1] + SMOOTHING
    table = np.log(counts / counts.sum(axis=1, keepdims=True)).T
    return Model(names, np.log(all_counts[:, -1] / all_counts[:, -1].sum()), np.ascontiguousarray(table))


def predict(docs: DataFrame, model: Model, keep: dict[str, Column]) -> DataFrame:
    """The ``keep`` columns of every row of ``docs`` with ``lang_pred`` and ``score``, the posterior probability.

    A text that is null or has no letter, and any text when nothing was learned, is ``und`` with score 0.
    Ties go to the language that sorts first.  Repeated rows get the same result each; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, UNKNOWN], object)
        for batch in K.slices(batches):
            low, offsets, lettered = _letters(batch)
            logs = np.tile(m.priors, (batch.num_rows, 1))
            for order in ORDERS:
                bucket, place = _grams(low, offsets, order)
                for at in range(0, len(bucket) if m.languages else 0, CHUNK):  # rows of the matrix, a bounded number at a time
                    end = min(at + CHUNK, len(bucket))
                    first, last = np.searchsorted(place, (at, end - 1), "right") - 1
                    held = np.arange(first, last + 1)
                    cuts = np.maximum(place[held], at) - at
                    some = np.minimum(place[held + 1], end) - at > cuts
                    logs[held[some]] += np.add.reduceat(m.table[bucket[at:end]], cuts[some], axis=0)
            best, score = np.full(batch.num_rows, len(m.languages)), np.zeros(batch.num_rows)
            if m.languages:
                top = logs.argmax(axis=1)
                odds = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                best, score = np.where(lettered, top, best), np.where(lettered, odds, 0.0)
            kept = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(names[best].tolist(), pa.string()), pa.array(score)], out.names)

    source = docs.select(*[c.alias(k) for k, c in keep.items()], F.col("text").alias("text"))
    out = source.drop("text").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    return source.mapInArrow(run, out)
