"""Language-model scoring by deleted interpolation.

A token's probability mixes the maximum-likelihood estimates of trigram, bigram and unigram, level by level: the trigram's with the mixed
bigram's, that with the mixed unigram's, and that with the uniform distribution.  A weight depends on the bucket of its context's frequency.
All weights are learned by expectation-maximisation on deleted counts, the lower level first: each training token is held out
of the counts that predict it.  A document's first token has the end as its context and no trigram.

Counts never leave the executors.  Documents are packed once into groups of a few MB, as tokens.  A group asks for the counts of
its distinct tokens, then of those bigrams that other groups may have too, then of such trigrams, in sorted order, and the answers
come back as bare arrays in that order; so a shuffle moves 6 bytes and some bits for each distinct item of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import kernels as K
from palimpsest.llm.shared import checkpoint

#: Bytes of text in a group, about; a reducer has twice as many.  Every group sends a row to nearly every reducer, so beyond
#: ``SQUARE_BYTES`` of text groups grow with its square root, which keeps the rows in proportion, up to what a task's memory holds.
GROUP_BYTES, LARGEST_GROUP, SQUARE_BYTES = 16 << 20, 128 << 20, 64 << 30
BUCKETS = 64  # of a context's frequency, by powers of two
#: Bins of the logarithm of (context count - 1) / 2 ** bucket * probability of the level below, which is 2 at most: with the bucket
#: 18 bits, and wide enough for any 64-bit count.  ``_HALF`` bins lie on each side of equal estimates.
_BINS, _STEP, _LEAST, _HALF = 4096, 0.0125, -50.0, 4000
#: Bits that are kept of a count in the table of how many words have each count; smaller ones are exact.
COUNT_BITS = 12
_END, _START = np.uint64(0x5DEECE66D1234567), np.uint64(0x1B873593CC9E2D51)


def _squeezed(values: np.ndarray, width: int) -> bytes:
    """Little-endian bytes of unsigned numbers, plane by plane, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize)[:, :width]
    return pa.compress(np.ascontiguousarray(planes.T).tobytes(), "zstd", asbytes=True)


def _expanded(raw: bytes, n: int, width: int, dtype: type) -> np.ndarray:
    out = np.zeros((n, np.dtype(dtype).itemsize), np.uint8)
    if n:
        planes = np.frombuffer(pa.decompress(raw, n * width, "zstd", asbytes=True), np.uint8)
        out[:, :width] = planes.reshape(width, n).T
    return out.reshape(-1).view(dtype)


def group_bytes(size: int) -> int:
    """Bytes of a group for so many bytes of text."""
    return min(LARGEST_GROUP, int(GROUP_BYTES * max(1.0, (size / SQUARE_BYTES) ** 0.5)))


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct hashes, a place where each stands, and each hash's place among them; the sort need not be stable."""
    order = np.argsort(hashes)
    in_order = hashes[order]
    new = np.ones(len(order), bool)
    np.not_equal(in_order[1:], in_order[:-1], out=new[1:])
    back = np.empty(len(order), np.int32)
    back[order] = np.cumsum(new, dtype=np.int32) - 1
    return in_order[new], order[new], back


class Group:
    """Tokens of a group's documents: hashes, and for each token its text, its context and whether it is trained on."""

    def __init__(self, packed: dict) -> None:
        self.head = pa.ipc.open_stream(packed["head"]).read_all()
        per, self.held = self.head.column("__tokens").to_numpy(), self.head.column("__held").to_numpy()
        self.n = len(per)
        self.doc = np.repeat(np.arange(self.n, dtype=np.int32), per)
        self.words = _expanded(packed["words"], packed["n_words"], 8, np.uint64)
        self.word = _expanded(packed["codes"], len(self.doc), 4, np.int32)
        self.trained = ~self.held[self.doc]
        self.own = np.bincount(self.word[self.trained], minlength=len(self.words))

    def bigrams(self) -> None:
        """Distinct (context, token) pairs in the order of their hashes; the context of a first token is the end."""
        context = np.empty_like(self.word)
        context[1:] = self.word[:-1]
        context[0] = int(np.searchsorted(self.words, _END))
        with np.errstate(over="ignore"):
            mixed = K.mix(self.words[context] * _START + self.words[self.word], 31)
        self.pairs, first, self.pair = _distinct(mixed)
        self.left, self.right = context[first], self.word[first]
        self.pair_own = np.bincount(self.pair[self.trained], minlength=len(self.pairs))

    def open_pairs(self, count: np.ndarray) -> np.ndarray:
        """Which pairs other groups may have: both words occur in training elsewhere."""
        return (count[self.left] > self.own[self.left]) & (count[self.right] > self.own[self.right])

    def trigrams(self) -> None:
        """Distinct (context pair, token) triples in the order of their hashes, of the tokens after a document's first (``later``)."""
        self.later = np.flatnonzero(self.doc[1:] == self.doc[:-1]) + 1
        with np.errstate(over="ignore"):
            mixed = K.mix(self.pairs[self.pair[self.later - 1]] * _START + self.words[self.word[self.later]], 37)
        self.triples, first, self.triple = _distinct(mixed)
        first = self.later[first]
        self.before, self.after = self.pair[first - 1], self.pair[first]
        self.triple_own = np.bincount(self.triple[self.trained[self.later]], minlength=len(self.triples))

    def open_triples(self, count: np.ndarray) -> np.ndarray:
        """Which triples other groups may have: both of their pairs occur in training elsewhere."""
        return (count[self.before] > self.pair_own[self.before]) & (count[self.after] > self.pair_own[self.after])


def _cut(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(reducer, begin, end) of the runs of sorted keys that share their first bits."""
    r = (keys >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(r)) + 1, [len(keys)])) if len(keys) else np.zeros(1, np.int64)
    return [(int(r[a]), int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:])]


_ASK = "r int, gid bigint, n int, keys binary, own binary, mark binary"
_TELL = "gid bigint, kind int, r int, n int, counts binary"


def _asks(gid: int, keys: np.ndarray, own: np.ndarray, mark: np.ndarray, bits: int) -> list[tuple]:
    low = keys << np.uint64(bits) >> np.uint64(16)  # 48 bits below those that name the reducer
    return [(r, gid, b - a, _squeezed(low[a:b], 6), _squeezed(own[a:b].astype(np.uint32), 4), _squeezed(mark[a:b], 3)) for r, a, b in _cut(keys, bits)]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [f for f, _ in fields])


_PACKED = "gid bigint, size bigint, n_words int, head binary, words binary, codes binary"


def pack_groups(docs: DataFrame, keep: dict[str, Column], held_out: Column, limit: int = GROUP_BYTES) -> DataFrame:
    """The texts in groups, as tokens: distinct hashes in order and each token's place among them; ``head`` holds the ``keep`` columns
    and ``__held`` and ``__tokens``, how many tokens a text has.  ``size`` is in bytes of text."""
    source = docs.select(*[c.alias(k) for k, c in keep.items()], held_out.alias("__held"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made, heads, hashes, size = TaskContext.get().partitionId() << 32, 0, [], [], 0

        def group() -> pa.RecordBatch:
            words, _, codes = _distinct(np.concatenate(hashes))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, heads[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for head in heads:
                    out.write_batch(head)
            return _batch([(base + made, size, len(words), sink.getvalue().to_pybytes(), _squeezed(words, 8), _squeezed(codes, 4))], _PACKED)

        for batch in K.slices(batches):
            data, offsets = K.buffers(batch.column(batch.num_columns - 1))
            data = K.lower_ascii(data)
            starts, ends, doc = K.words(data, offsets)
            per = np.bincount(doc, minlength=batch.num_rows)
            hashes.append(np.insert(K.span_hashes(data, starts, ends), np.cumsum(per), _END))
            heads.append(batch.drop_columns(["text"]).append_column("__tokens", pa.array(per + 1)))
            size += int(offsets[-1])
            if size >= limit:
                yield group()
                made, heads, hashes, size = made + 1, [], [], 0
                K.give_back()
        if heads:
            yield group()

    return source.mapInArrow(run, _PACKED)


def _merge(table: pa.Table) -> tuple[list[dict], np.ndarray, np.ndarray, np.ndarray]:
    rows = table.select(["r", "gid", "n", "keys", "own"]).to_pylist()
    keys = np.concatenate([_expanded(x["keys"], x["n"], 6, np.uint64) for x in rows])
    own = np.concatenate([_expanded(x["own"], x["n"], 4, np.uint32) for x in rows]).astype(np.int64)
    distinct, first, back = _distinct(keys)
    total = np.bincount(back, weights=own, minlength=len(distinct)).astype(np.int64)
    return rows, total, first, back


def _count_table(total: np.ndarray) -> list[tuple[int, int, int]]:
    """(count, words, tokens) of the words by count; counts above ``2 ** COUNT_BITS`` are put together where their first bits agree."""
    total = total[total > 0]
    shift = np.maximum(np.log2(np.maximum(total, 1)).astype(np.int64) - (COUNT_BITS - 1), 0)
    cell, back = np.unique(total >> shift << shift, return_inverse=True)
    sums = np.zeros(len(cell), np.int64)
    np.add.at(sums, back, total)
    return [(int(c), int(n), int(s)) for c, n, s in zip(cell, np.bincount(back, minlength=len(cell)), sums)]


def _answers(rows: list[dict], kind: int, total: np.ndarray, back: np.ndarray) -> list[tuple]:
    out, at = [], 0
    for x in rows:
        out.append((x["gid"], kind, x["r"], x["n"], _squeezed(total[back[at : at + x["n"]]].astype(np.uint64), 8)))
        at += x["n"]
    return out


def _told(table: pa.Table, kind: int) -> np.ndarray:
    """The counts that a group was told, in the order in which it asked."""
    rows = sorted((x for x in table.to_pylist() if x["kind"] == kind), key=lambda x: x["r"])
    return np.concatenate([_expanded(x["counts"], x["n"], 8, np.uint64) for x in rows]).astype(np.int64) if rows else np.zeros(0, np.int64)


@dataclass(frozen=True)
class Unigram:
    """Training tokens, distinct ones, and the weight of the counts against the uniform distribution."""

    tokens: int
    types: int
    weight: float

    def probability(self, count: np.ndarray, deleted: int = 0) -> np.ndarray:
        ml = np.maximum(count - deleted, 0) / max(self.tokens - deleted, 1)
        return self.weight * ml + (1 - self.weight) / (self.types + 1)


def mixture_weight(ratio: np.ndarray, weight: np.ndarray, rounds: int = 60) -> float:
    """EM for the share of the first of two estimates, from their ratios and how often each ratio occurs."""
    total, share = weight.sum(), 0.5
    if not total:
        return 0.0
    for _ in range(rounds):
        share = float((weight * (share * ratio / (share * ratio + 1 - share))).sum() / total)
        share = min(share, 1 - 1e-6)
    return share


def _histogram(count: np.ndarray, mark: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, bin of the logarithm of a level's estimate against the level below, training tokens); bin -1: the deleted count is 0.

    ``mark`` holds ``_BINS`` * bucket + bin of the lower side.
    """
    use = count > 0
    count, mark = count[use], mark[use].astype(np.int64)
    side = (mark % _BINS) * _STEP + _LEAST + mark // _BINS * np.log(2)
    place = np.where(count > 1, np.clip(np.round((np.log(np.maximum(count - 1, 1)) - side) / _STEP), -_HALF, _HALF) + _HALF, 2 * _HALF + 1).astype(np.int64)
    sums = np.bincount((mark // _BINS << 14) + place, weights=count)  # BUCKETS << 14 numbers at most
    cell = np.flatnonzero(sums)
    place = np.where(cell & 16383 <= 2 * _HALF, cell & 16383, -1)
    return [(int(c) >> 14, int(p), int(n)) for c, p, n in zip(cell, place, sums[cell])]


def _bucket(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(count, 1)).astype(np.int64), BUCKETS - 1)


def _mixed(count: np.ndarray, context: np.ndarray, below: np.ndarray, weights: np.ndarray, deleted: int = 0) -> np.ndarray:
    """Maximum-likelihood estimates mixed with the probabilities of the level below; a context that is not in training has no weight."""
    share = np.where(context > 0, weights[_bucket(context)], 0.0)
    return share * np.maximum(count - deleted, 0) / np.maximum(context - deleted, 1) + (1 - share) * below


def _marks(context: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Bucket and lower side of items from their contexts' counts and the deleted probabilities of the level below."""
    bucket = _bucket(context)
    side = np.log(np.maximum(context - 1, 1)) - bucket * np.log(2) + np.log(below)
    return (bucket * _BINS + np.clip(np.round((side - _LEAST) / _STEP), 0, _BINS - 1).astype(np.int64)).astype(np.uint32)


def score_texts(docs: DataFrame, held_out: Column, keep: dict[str, Column]) -> DataFrame:
    """The ``keep`` columns of every row of ``docs`` (text), held_out, and n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows where ``held_out`` does not hold.  Null texts are empty: the end is their one token.  With nothing to learn from, all
    counts are 0 and the score is that of the uniform distribution.  Repeated rows count each.  Tokens, bigrams and trigrams are told
    apart by 51 and more bits of a hash.
    """
    limit = group_bytes(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    groups = checkpoint(pack_groups(docs, keep, held_out, limit))
    size = groups.agg(F.sum("size")).first()[0] or 0
    bits = max(3, int(size // (2 * limit)).bit_length())
    out_schema = docs.select(*[c.alias(k) for k, c in keep.items()]).schema.add("held_out", "boolean")
    for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double")):
        out_schema = out_schema.add(name, kind)

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                g = Group(x)
                yield _batch(_asks(x["gid"], g.words, g.own, np.zeros(len(g.words), np.uint32), bits), _ASK)

    def tell_words(table: pa.Table) -> pa.Table:
        rows, total, _, back = _merge(table)
        facts = [(-1, 0, n, 0, f"{c}:{own}".encode()) for c, n, own in _count_table(total)]  # how many words have each count
        return pa.Table.from_batches([_batch(_answers(rows, 0, total, back) + facts, _TELL)])

    words = checkpoint(groups.drop("size").mapInArrow(ask_words, _ASK).groupBy("r").applyInArrow(tell_words, _TELL))
    facts = words.filter("gid < 0").select(F.split(F.col("counts").cast("string"), ":").cast("array<bigint>").alias("c"), "r")
    facts = facts.groupBy(F.col("c")[0].alias("c")).agg(F.sum("r").alias("n"), F.sum(F.col("c")[1]).alias("own"))
    facts = facts.collect()  # at most 2 ** 12 exact counts and 2 ** 11 for each power of two above: 110,000 at any size
    tokens, types = sum(r.own for r in facts), sum(r.n for r in facts)
    of = np.array([r.n for r in facts], float)
    count = np.array([r.own for r in facts], float) / np.maximum(of, 1)
    ratio = (count - 1) / max(tokens - 1, 1) * (types + 1)
    unigram = Unigram(tokens, types, mixture_weight(ratio, count * of))

    def totals(g: Group, told: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Training counts of a group's tokens and pairs, from its own and from what it was told."""
        count = _told(told, 0)
        g.bigrams()
        pair = g.pair_own.copy()
        pair[g.open_pairs(count)] = _told(told, 1)
        return count, pair

    def asked_and_own(gid: int, keys: np.ndarray, own: np.ndarray, mark: np.ndarray, ask: np.ndarray) -> list[tuple]:
        """Requests for the counts that others may add to, and the histogram of the rest."""
        cells = np.array(_histogram(own[~ask], mark[~ask]), np.int64).reshape(-1, 3)
        return [*_asks(gid, keys[ask], own[ask], mark[ask], bits), (-1, gid, len(cells), cells.tobytes(), b"", b"")]

    def ask_pairs(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for x in left.to_pylist():
            g, count = Group(x), _told(right, 0)
            g.bigrams()
            mark = _marks(count[g.left], unigram.probability(count[g.right], 1))
            rows += asked_and_own(x["gid"], g.pairs, g.pair_own, mark, g.open_pairs(count))
        K.give_back()
        return pa.Table.from_batches([_batch(rows, _ASK)])

    def tell(kind: int, table: pa.Table) -> pa.Table:
        own = [x for x in table.select(["r", "n", "keys"]).to_pylist() if x["r"] < 0]
        if own:
            return pa.Table.from_batches([_batch([(-1, kind, -1, x["n"], x["keys"]) for x in own], _TELL)])
        rows, total, first, back = _merge(table)
        mark = np.concatenate([_expanded(m, n, 3, np.uint32) for m, n in zip(table.column("mark").to_pylist(), table.column("n").to_pylist())])
        cells = np.array(_histogram(total, mark[first]), np.int64).reshape(-1, 3)
        return pa.Table.from_batches([_batch([*_answers(rows, kind, total, back), (-1, kind, -1, len(cells), cells.tobytes())], _TELL)])

    def sum_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                cells = np.frombuffer(raw, np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([pa.array(cells[:, k]) for k in range(3)], ["bucket", "bin", "n"])

    def level(kind: int, ask, told: DataFrame) -> tuple[DataFrame, np.ndarray]:
        """What the groups are told at a level, and the level's weights by bucket."""
        asked = groups.drop("size").groupBy("gid").cogroup(told.groupBy("gid")).applyInArrow(ask, _ASK)
        # a group's own cells are dealt by its number, not all to one reducer
        asked = asked.withColumn("deal", F.when(F.col("r") < 0, -1 - F.col("gid")).otherwise(F.col("r").cast("bigint")))
        made = checkpoint(asked.groupBy("deal").applyInArrow(lambda t: tell(kind, t.drop_columns(["deal"])), _TELL))
        cells = made.filter("gid < 0").select("counts").mapInArrow(sum_cells, "bucket bigint, bin bigint, n bigint")
        weights, own = np.zeros(BUCKETS), {}
        for r in cells.groupBy("bucket", "bin").agg(F.sum("n").alias("n")).collect():  # at most 64 * 8002
            own.setdefault(r.bucket, []).append((np.exp((r.bin - _HALF) * _STEP) if r.bin >= 0 else 0.0, float(r.n)))
        for b, pairs in own.items():
            weights[b] = mixture_weight(*np.array(sorted(pairs)).T)
        return made.filter("gid >= 0"), weights

    told = words.filter("gid >= 0")
    pairs, weights = level(1, ask_pairs, told)

    def ask_triples(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for x in left.to_pylist():
            g = Group(x)
            count, pair = totals(g, right)
            below = _mixed(pair, count[g.left], unigram.probability(count[g.right], 1), weights, 1)
            g.trigrams()
            rows += asked_and_own(x["gid"], g.triples, g.triple_own, _marks(pair[g.before], below[g.after]), g.open_triples(pair))
        K.give_back()
        return pa.Table.from_batches([_batch(rows, _ASK)])

    told = told.unionByName(pairs)
    triples, upper = level(2, ask_triples, told)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        made = []
        for x in left.to_pylist():
            g = Group(x)
            count, pair = totals(g, right)
            g.trigrams()
            triple = g.triple_own.copy()
            triple[g.open_triples(pair)] = _told(right, 2)
            p = _mixed(pair, count[g.left], unigram.probability(count[g.right]), weights)
            log_p = np.log10(p)[g.pair]
            log_p[g.later] = np.log10(_mixed(triple, pair[g.before], p[g.after], upper))[g.triple]
            base = np.log10((count + 0.5) / (unigram.tokens + 0.5 * (unigram.types + 1)))
            by = lambda v: np.bincount(g.doc, weights=v, minlength=g.n)
            sums = [np.bincount(g.doc, minlength=g.n), by(count[g.word] > 0).astype(np.int64), np.full(g.n, unigram.tokens), by(base[g.word]), by(log_p)]
            kept = [g.head.column(k) for k in range(g.head.num_columns - 2)]
            made.append(pa.Table.from_arrays([*kept, pa.array(g.held), *[pa.array(s) for s in sums]], names=out_schema.names))
        K.give_back()
        return pa.concat_tables(made)

    return groups.drop("size").groupBy("gid").cogroup(told.unionByName(triples).groupBy("gid")).applyInArrow(finish, out_schema)
