"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class is a Gaussian with its own covariance, shrunk towards its diagonal and then towards the pooled one.
Its Cholesky factor is computed once; a score is the difference of the two log densities, each from
the Mahalanobis distance by one triangular solve, as a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import kernels as K

SHRINK_DIAGONAL, SHRINK_POOLED, RIDGE = 0.05, 0.02, 1e-3

_UPPER, _LOWER, _DIGIT, _BLANK, _LINE, _SYMBOL, _MARK, _STOP, _OTHER = range(9)
_CLASS = np.full(256, _OTHER, np.int64)
for _bytes, _kind in ((range(65, 91), _UPPER), (range(97, 123), _LOWER), (range(48, 58), _DIGIT), (b" \t\x0b\x0c\r", _BLANK), (b"\n", _LINE), (b"#*$%&|<>^~=+@_\\{}[]", _SYMBOL), (b"!?", _MARK), (b".,;:", _STOP)):
    _CLASS[list(_bytes)] = _kind
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True

STATISTICS = ("words", "word_bytes", "symbols", "marks", "upper", "digits", "stops", "distinct", "repeats", "line_copies")


def _distinct(hashes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct hashes of each text."""
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return np.bincount(d[new], minlength=n)


def statistics(batch: pa.RecordBatch) -> np.ndarray:
    """The transformed statistics (columns) of each text of a slice (rows); an empty text has all counts 0."""
    data, offsets = K.buffers(batch.column(batch.schema.get_field_index("text")))
    n = batch.num_rows
    where = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.bincount(where * 9 + _CLASS[data], minlength=9 * n).reshape(n, 9)
    starts, ends, doc = K.words(data, offsets)
    words = np.bincount(doc, minlength=n)
    hashes = K.span_hashes(data, starts, ends)
    repeats = np.bincount(doc[1:][(hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])], minlength=n)
    first, last, line_doc = K.words(data, offsets, _NEWLINE)
    lines = np.bincount(line_doc, minlength=n)
    copies = lines - _distinct(K.span_hashes(data, first, last), line_doc, n)
    share = lambda x, of: np.log((x + 0.5) / (of + 5.0))
    size = np.diff(offsets)
    inked = size - kinds[:, _BLANK] - kinds[:, _LINE]
    return np.column_stack([
        np.log1p(words), np.log((inked + 5.0) / (words + 1.0)), share(kinds[:, _SYMBOL], words), share(kinds[:, _MARK], words),
        share(kinds[:, _UPPER], size), share(kinds[:, _DIGIT], size), share(kinds[:, _STOP], words),
        np.log((_distinct(hashes, doc, n) + 5.0) / (words + 5.0)), share(repeats, words), share(copies, lines),
    ])


def features(docs: DataFrame, keep: dict[str, Column]) -> DataFrame:
    """The ``keep`` columns of every row of ``docs`` with its statistics ``x``."""
    source = docs.select(*[c.alias(k) for k, c in keep.items()], F.col("text").alias("text"))
    schema = source.drop("text").withColumn("x", F.array().cast("array<double>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches):
            x = statistics(batch)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(batch.num_columns - 1)], lists], schema.names)

    return source.mapInArrow(run, schema)


@dataclass(frozen=True)
class Model:
    """Means, Cholesky factors and log constants of class 0 and 1; or one constant probability."""

    means: tuple[np.ndarray, ...] = ()
    factors: tuple[np.ndarray, ...] = ()
    constants: tuple[float, ...] = ()
    fixed: float = 0.5

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), self.fixed)
        logs = []
        for mean, factor, constant in zip(self.means, self.factors, self.constants):
            z = (x - mean).T
            for i, row in enumerate(factor):  # forward substitution: the factor is triangular
                z[i] = (z[i] - row[:i] @ z[:i]) / row[i]
            logs.append(constant - 0.5 * (z * z).sum(axis=0))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def train(labelled: DataFrame) -> Model:
    """A model of all rows (x, label) with label 0 or 1: counts, sums and products, summed by Spark.

    With one class only, every score is 1 or 0; with no rows, 0.5.
    """
    d = len(STATISTICS)
    pick = [F.col("x")[i] for i in range(d)]
    sums = [F.sum(pick[i]).alias(f"s{i}") for i in range(d)]
    products = [F.sum(pick[i] * pick[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]
    rows = labelled.filter("label IN (0, 1)").groupBy("label").agg(F.count("*").alias("n"), *sums, *products).collect()  # two rows at most
    by = {r.label: r for r in rows}
    if len(by) < 2:
        return Model(fixed=float(next(iter(by), 0.5)))
    total = sum(r.n for r in rows)
    means, covs = [], []
    for k in (0, 1):
        r = by[k]
        mean = np.array([r[f"s{i}"] for i in range(d)]) / r.n
        second = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)]) / r.n
        means.append(mean), covs.append(second - np.outer(mean, mean))
    pooled = sum(by[k].n * covs[k] for k in (0, 1)) / total
    factors, constants = [], []
    for k in (0, 1):
        c = (1 - SHRINK_DIAGONAL) * covs[k] + SHRINK_DIAGONAL * np.diag(np.diag(covs[k]))
        c = (1 - SHRINK_POOLED) * c + SHRINK_POOLED * pooled + RIDGE * np.eye(d)
        factor = np.linalg.cholesky(c)
        factors.append(factor)
        constants.append(float(np.log(by[k].n / total) - np.log(np.diag(factor)).sum()))
    return Model(tuple(means), tuple(factors), tuple(constants))


def score(featured: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """``featured`` without ``x`` but with ``score`` (probability of label 1) and ``predicted``."""
    shared = featured.sparkSession.sparkContext.broadcast(model)
    others = [c for c in featured.columns if c != "x"]
    source = featured.select(*others, "x")
    schema = source.drop("x").withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(batch.num_columns - 1).flatten().to_numpy().reshape(batch.num_rows, -1)
            s = shared.value.scores(x)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(others))], pa.array(s), pa.array((s >= threshold).astype(np.int32))], schema.names)

    return source.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, train_on: Column, keep: dict[str, Column]) -> DataFrame:
    """Scores every row of ``docs`` (doc_id, text) by a model of the ``labels`` (doc_id, label) of rows where ``train_on`` holds.

    ``keep`` names the columns returned beside ``score`` and ``predicted``.  Null labels and labels other than 0 and 1 are not learned;
    a document with several labels counts once for each different one, and repeated rows count each.  Null and empty texts are scored like others.
    Extra columns are ignored; an empty table gives an empty result, and with nothing to learn from every score is 0.5.
    """
    from palimpsest.llm.shared import checkpoint

    featured = checkpoint(features(docs, keep | {"__id": F.col("doc_id"), "__train": train_on}))
    known = labels.select(F.col("doc_id").alias("__id"), "label").filter("label IS NOT NULL").distinct()
    model = train(featured.filter("__train").join(known, "__id").select("x", "label"))
    return score(featured.drop("__id", "__train"), model)
