"""N-gram Jaccard join by vertical partitioning, exact, with linked groups as components.

The word n-grams of the corpus stand in one global order, that of their 64-bit hashes.  The
order is cut into fragments, and so is each document's set:

1. *Candidates.*  Sets within the threshold differ in at most ``K`` n-grams.  Where the order is
   cut into more than ``K`` fragments, such sets agree on whole fragments.  ``K`` depends on the
   sizes, so sizes are cut into levels and a set is cut once for each level in which it can have
   a smaller partner.  A set that shares fewer fragments than every link would make it share is no candidate.
   This loses no link; see ``fragment_keys``.
2. *Classes.*  Equal sets (equal 64-bit sums of mixed hashes) are one node, so copies never meet.
3. *Counting.*  Of a candidate pair, partial overlaps are counted fragment by fragment and summed per pair.
4. *Hot fragments.*  All sets with a common fragment are first compared with one pivot only.  Sets that
   link with it are connected.  Of the others, those meet that are of different components and differ from the pivot in the
   same rare n-grams (``_second_pairs``, with the proof that this suffices).  A large group of near copies that link with
   their pivots so costs its size, not its square, and every link that could connect two components is checked.

Sizes of what is held: no list of documents or pairs is ever gathered in a task or at the driver;
the driver sees bit filters of 8 MB.  Node numbers have 64 bits: among 10^9 different sets the
chance that any two share a number is about 3 %.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm import kernels as K
from palimpsest.llm.shared import bit_filter, bit_planes, checkpoint, connected_components, may_be_in, passes

#: Fragments of the order in which partial overlaps are counted.
COUNT_FRAGMENTS = 4
#: Rarity of an n-gram of a difference set, in powers of four of the sets that have it: planes of ``2 ** PLANE_BITS`` bits, 1 MB each.
PLANES, PLANE_BITS = 6, 23
_RATIO = 3 / 2


def levels(largest: int, percent: int) -> list[tuple[int, int, int, int]]:
    """(first size, size after the last, K, fragments) of each level up to ``largest``.

    There are as many fragments over K as the level's smallest sets are likely to leave empty, and a few more.
    """
    out, low = [], 1
    while low <= largest:
        high = max(low + 1, int(low * _RATIO))
        small = high - 1
        most = (small + small * 100 // percent) * (100 - percent) // (100 + percent)
        parts = most + 4
        for _ in range(6):
            empty = parts * math.exp(-low / parts)
            parts = min(most + 5 + math.ceil(empty + 3 * math.sqrt(empty)), max(most + 4, 3 * low + 8))
        out.append((low, high, most, parts))
        low = high
    return out


def fragment_keys(ordered: np.ndarray, percent: int, table: list[tuple[int, int, int, int]], lows: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(level, need, keys): keys under which a set (sorted distinct hashes) meets every different set within the threshold, and how many they share.

    Let x be the smaller and y the larger of a pair, at x's level with M fragments and at most K
    differing n-grams: at least M - K fragments are equal.  A set with F > K filled fragments shows those; M - F of the equal ones may be
    empty, so it shares F - K or more of its keys.  A set with fewer filled fragments shows its empty ones too and shares M - K; if both of a pair
    are such sets they meet, and if one is not, it shares a filled one with the other.
    """
    size = len(ordered)
    first = int(np.searchsorted(lows, -(-size * percent // 100), "right")) - 1
    last = int(np.searchsorted(lows, size, "right")) - 1
    values = K.mix(ordered, 11)
    out = []
    with np.errstate(over="ignore"):
        for level in range(max(first, 0), last + 1):
            _, _, most, parts = table[level]
            if not most:
                continue  # sets that differ in nothing are one node already
            part = ((ordered >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            cut = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1))
            sums, filled = np.add.reduceat(values, cut), part[cut]
            need = len(cut) - most
            if need <= 0:
                rest = np.setdiff1d(np.arange(parts, dtype=np.uint64), filled)
                sums, filled = np.concatenate((sums, np.zeros(len(rest), np.uint64))), np.concatenate((filled, rest))
                need = 1
            out.append((level, need, K.mix(sums ^ K.mix(filled + np.uint64(level << 32), 12), 13)))
    return out


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct n-gram hashes of each text of a slice."""
    data, offsets = K.buffers(batch.column(1))
    data = K.lower_ascii(data)
    starts, ends, doc = K.words(data, offsets)
    grams, place = K.shingles(K.span_hashes(data, starts, ends), doc, batch.num_rows, size)
    for row in range(batch.num_rows):
        yield row, np.unique(grams[place[row] : place[row + 1]])


def _node(ordered: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        total = np.add.reduce(K.mix(ordered, 21)) if len(ordered) else np.uint64(0)
    return int(K.mix(np.array([total ^ np.uint64(len(ordered))], np.uint64), 22).view(np.int64)[0])


def _nodes(docs: DataFrame, size: int, bits: np.ndarray) -> Callable[[str, str], Column]:
    """The number of the set of a text, as ``sketches`` gives it, where a bit filter lets the id pass; else null.

    Spark is told that it is not deterministic: else a filter on it is pushed below and calls it once more, in a second worker of the same task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf("bigint")
    def nodes(doc_id: pa.Array, text: pa.Array) -> pa.Array:
        due = pa.array(passes(shared.value, doc_id.to_numpy(zero_copy_only=False)))
        some = text.filter(due)
        made = [_node(ordered) for batch in K.slices(iter([pa.RecordBatch.from_arrays([some, some], ["doc_id", "text"])])) for _, ordered in _sets(batch, size)]
        out = np.zeros(len(doc_id), np.int64)
        out[due.to_numpy(zero_copy_only=False)] = made
        return pa.array(out, mask=~due.to_numpy(zero_copy_only=False))

    once = nodes.asNondeterministic()
    return lambda doc_id, text: once(F.coalesce(doc_id, F.lit(0)), F.col(text))


class _Cutter:
    """Fragment keys of sets as they come; the table of levels grows with the largest."""

    def __init__(self, percent: int) -> None:
        self.percent, self.table, self.lows = percent, levels(1, percent), np.zeros(0)

    def __call__(self, ordered: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        if len(self.lows) == 0 or self.table[-1][1] <= len(ordered):
            self.table = levels(max(1, 2 * len(ordered)), self.percent)
            self.lows = np.array([x[0] for x in self.table])
        return fragment_keys(ordered, self.percent, self.table, self.lows)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n (set size) and node (number of the set) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches):
            made = [(len(ordered), _node(ordered)) for _, ordered in _sets(batch, size)]
            n, node = np.array(made, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(node)], ["doc_id", "n", "node"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, node bigint")


def _one_of_each(batch: pa.RecordBatch, size: int, bits: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, node, set) of the rows that stand for their node, by a bit filter of ids and nodes, and of few others; no empty sets."""
    ids = batch.column(0).fill_null(0).to_numpy()
    for row, ordered in _sets(batch, size):
        if len(ordered):
            node = _node(ordered)
            if passes(bits, np.array([ids[row] ^ node], np.int64))[0]:
                yield row, node, ordered


def _all_keys(docs: DataFrame, size: int, percent: int, reps: np.ndarray) -> DataFrame:
    """The fragment keys of one row of each node, and of few others: a key with one row has one node.

    Keys are cut from the texts anew wherever they are needed: kept, they would take as much disk as the texts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(reps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = _Cutter(percent)
        for batch in K.slices(batches):
            keys = [k for _, _, ordered in _one_of_each(batch, size, shared.value) for _, _, k in cut(ordered)]
            yield pa.RecordBatch.from_arrays([K.longs(np.concatenate([np.zeros(0, np.uint64), *keys]))], ["key"])

    return docs.select("doc_id", "text").mapInArrow(run, "key bigint")


def _matching(docs: DataFrame, size: int, percent: int, reps: np.ndarray, common: np.ndarray) -> DataFrame:
    """(key, node, n, level, need) of the fragment keys that may be shared, of the sets that may share enough."""
    one, many = (docs.sparkSession.sparkContext.broadcast(x) for x in (reps, common))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = _Cutter(percent)
        for batch in K.slices(batches):
            keys, marks = [np.zeros(0, np.uint64)], []
            for _, node, ordered in _one_of_each(batch, size, one.value):
                for level, need, found in cut(ordered):
                    found = found[passes(many.value, found.view(np.int64))]
                    if len(found) >= need:
                        keys.append(found), marks.append((node, len(ordered), level, need, len(found)))
            flat = np.array(marks, np.int64).reshape(-1, 5)
            cols = np.repeat(flat[:, :4], flat[:, 4], axis=0)
            arrays = [K.longs(np.concatenate(keys)), pa.array(cols[:, 0]), pa.array(cols[:, 1]), pa.array(cols[:, 2], pa.int32()), pa.array(cols[:, 3], pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "node", "n", "level", "need"])

    return docs.select("doc_id", "text").mapInArrow(run, "key bigint, node bigint, n bigint, level int, need int")


def _fragments(docs: DataFrame, reps: DataFrame, size: int) -> DataFrame:
    """(node, fragment, grams) of one document of each node in ``reps`` (node, doc_id)."""
    bits = bit_filter(reps.select(F.coalesce("doc_id", F.lit(0)).bitwiseXOR(F.col("node")).alias("x")), "x")
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches):
            rows, node, part, lists = [], [], [], []
            for row, number, ordered in _one_of_each(batch, size, shared.value):
                cut = np.searchsorted(ordered, (np.arange(1, COUNT_FRAGMENTS) * (2.0**64 / COUNT_FRAGMENTS)).astype(np.uint64))
                for k, grams in enumerate(np.split(ordered, cut)):
                    rows.append(row), node.append(number), part.append(k), lists.append(grams)
            ends = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
            grams = pa.ListArray.from_arrays(pa.array(ends), K.longs(np.concatenate(lists) if lists else np.zeros(0, np.uint64)))
            cols = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(node, pa.int64()), pa.array(part, pa.int32()), grams]
            yield pa.RecordBatch.from_arrays(cols, ["rep", "node", "fragment", "grams"])

    found = docs.select("doc_id", "text").mapInArrow(run, "rep bigint, node bigint, fragment int, grams array<bigint>")
    right = reps.select(F.col("node").alias("node_"), "doc_id")
    due = found.join(right, (F.col("node") == F.col("node_")) & F.col("rep").eqNullSafe(F.col("doc_id")), "left_semi")
    return due.dropDuplicates(["node", "fragment"]).select("node", "fragment", "grams")


def _facing(pairs: DataFrame, fragments: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) by fragment, with the grams of both in ``ga`` and ``gb``."""
    left = fragments.select(F.col("node").alias("a"), "fragment", F.col("grams").alias("ga"))
    right = fragments.select(F.col("node").alias("b"), "fragment", F.col("grams").alias("gb"))
    cut = pairs.withColumn("fragment", F.explode(F.array(*[F.lit(k) for k in range(COUNT_FRAGMENTS)])))
    return cut.join(left, ["a", "fragment"]).join(right, ["b", "fragment"])


def _overlaps(pairs: DataFrame, fragments: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b, na, nb) with ``both``, the partial overlaps of all fragments summed, and ``linked``."""
    partial = _facing(pairs, fragments).select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).cast("long").alias("part"))
    out = partial.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("both"))
    return out.withColumn("linked", F.col("both") * 100 >= percent * (F.col("na") + F.col("nb") - F.col("both")))


def _useful_grams(lists: DataFrame, bits: np.ndarray) -> DataFrame:
    """``lists`` with those of their ``grams`` that a bit filter lets pass; ``d`` counts all."""
    shared = lists.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, count = batch.column(4).flatten().to_numpy(zero_copy_only=False), np.diff(batch.column(4).offsets.to_numpy())
            use = passes(shared.value, grams)
            left = np.bincount(np.repeat(np.arange(batch.num_rows), count)[use], minlength=batch.num_rows)
            ends = np.concatenate(([0], np.cumsum(left))).astype(np.int32)
            cols = [*[batch.column(k) for k in range(4)], pa.array(count.astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(grams[use]))]
            yield pa.RecordBatch.from_arrays(cols, ["a", "b", "nb", "comp", "d", "grams"])

    return lists.mapInArrow(run, "a bigint, b bigint, nb bigint, comp bigint, d bigint, grams array<bigint>")


def _prefixes(whole: DataFrame, planes: list[np.ndarray], percent: int) -> DataFrame:
    """(a, gram, b, nb, d, comp, i): the first n-grams of each difference set, rarest first, with their places in it.

    The order is one for all sets: n-grams that the filter of useful ones holds back, then the others by plane and value.
    """
    shared = whole.sparkSession.sparkContext.broadcast(planes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, count = batch.column(5).flatten().to_numpy(zero_copy_only=False), np.diff(batch.column(5).offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), count)
            rank = np.sum([passes(plane, grams) for plane in shared.value], axis=0, dtype=np.int64)
            grams = grams[np.lexsort((grams, rank, row))]
            nb, d = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            most = (nb + nb * 100 // percent) * (100 - percent) // (100 + percent)
            begin = np.cumsum(count) - count
            place = np.arange(len(grams)) - begin[row] + 1 + (d - count)[row]
            use = place <= most[row] + 1
            at = pa.array(row[use])
            a, b, nb, comp, d = (batch.column(k).take(at) for k in range(5))
            cols = [a, pa.array(grams[use]), b, nb, d, comp, pa.array(place[use])]
            yield pa.RecordBatch.from_arrays(cols, ["a", "gram", "b", "nb", "d", "comp", "i"])

    return whole.mapInArrow(run, "a bigint, gram bigint, b bigint, nb bigint, d bigint, comp bigint, i bigint")


def _component_of(rows: DataFrame, found: DataFrame, node: str, name: str) -> DataFrame:
    """``rows`` with the component of the nodes in a column; a node without links is one of its own."""
    at = found.select(F.col("node").alias("__node"), F.col("component").alias("__comp"))
    return rows.join(at, F.col(node) == F.col("__node"), "left").withColumn(name, F.coalesce("__comp", node)).drop("__node", "__comp")


def _second_pairs(members: DataFrame, fragments: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) of ``members`` (a, b, nb, comp) of one pivot and different components that may link.

    Let ``D`` be what a set and the pivot do not share.  Two sets differ in ``|Dx| + |Dy| - 2 |Dx & Dy|``
    n-grams.  If they are within the threshold with ``Dx`` and ``Dy`` disjoint, both link with the pivot: from
    ``|Dx| + |Dy| <= r (|x| + |y|)`` and ``|x| <= |p| + |Dx|`` follows ``|Dy| <= r (|p| + |y|)``; so they are of one component
    already.  Else they share some of ``D``, at least ``max(1, |Dx| - K)``; so the first they share, rarest first, is among
    the ``K + 1`` first of either (prefix), and enough must stand behind it (position).
    """
    unlike = F.transform(F.concat(F.array_except("ga", "gb"), F.array_except("gb", "ga")), lambda x: F.xxhash64("a", x))
    lists = checkpoint(_facing(members, fragments).select("a", "b", "nb", "comp", unlike.alias("grams")))
    # an n-gram that only sets of one component have makes no pair: it comes first in the order and need only be counted
    useful = lists.select(F.explode("grams").alias("gram"), "comp").groupBy("gram").agg(F.count("*").alias("df"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    useful = checkpoint(useful.filter("low < high").select("gram", F.least(F.floor(F.log2("df") / 2), F.lit(PLANES)).cast("int").alias("plane")))
    above = useful.filter("plane > 0").select("gram", F.explode(F.sequence(F.lit(0), F.col("plane") - 1)).alias("plane"))
    planes = bit_planes(above, "gram", "plane", PLANES, PLANE_BITS)
    # at most COUNT_FRAGMENTS rows of a pair are put together, never more than its difference set
    whole = _useful_grams(lists, bit_filter(useful, "gram")).groupBy("a", "b", "nb", "comp").agg(F.sum("d").alias("d"), F.flatten(F.collect_list("grams")).alias("grams"))
    first = checkpoint(_prefixes(whole, planes, percent))
    other = first.select("a", "gram", *[F.col(c).alias(f"{c}_") for c in ("b", "nb", "d", "comp", "i")])
    total = F.col("nb") + F.col("nb_")
    left = F.col("d") + F.col("d_") - 2 * (1 + F.least(F.col("d") - F.col("i"), F.col("d_") - F.col("i_")))
    due = (
        (F.col("b") < F.col("b_"))
        & (F.col("comp") != F.col("comp_"))
        & (F.least("nb", "nb_") * 100 >= F.greatest("nb", "nb_") * percent)
        & (left * (100 + percent) <= total * (100 - percent))
    )
    both = (F.col("a") == F.col("a_")) & (F.col("gram") == F.col("gram_"))
    met = first.join(other.withColumnsRenamed({"a": "a_", "gram": "gram_"}), both & due)
    return met.select(F.col("b").alias("a"), F.col("b_").alias("b"), F.col("nb").alias("na"), F.col("nb_").alias("nb")).distinct()


def _joined(found: DataFrame, told: DataFrame) -> DataFrame:
    """Components once the linked pairs of ``told`` are links too."""
    links = checkpoint(told.filter("linked").select("a", "b"))
    return found if links.isEmpty() else connected_components(links.union(found.select("node", "component")))


def _linked_groups(docs: DataFrame, classes: DataFrame, hits: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, component) of the nodes that link with another; ``hits`` has (key, node, n, weight), ``classes`` (node, doc_id).

    Links are checked in three rounds, and each leaves out the pairs that the rounds before have connected already.
    """
    # the set that shares most fragments with others stands nearest to the middle of its group
    pivots = hits.groupBy("key").agg(F.max(F.struct("weight", "node", "n")).alias("p")).select("key", F.col("p.node").alias("a"), F.col("p.n").alias("na"))
    met = hits.join(pivots, "key").filter("node <> a").select("key", "a", F.col("node").alias("b"), "na", F.col("n").alias("nb"))
    star = checkpoint(met.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("keys")))
    reps = star.select(F.col("a").alias("node")).union(star.select("b")).distinct().join(classes, "node").select("node", "doc_id")
    fragments = checkpoint(_fragments(docs, checkpoint(reps), size))

    # 1: each set with the pivot that it shares most keys with
    best = star.groupBy("b").agg(F.max(F.struct("keys", "a", "na", "nb")).alias("t")).select("t.a", "b", "t.na", "t.nb")
    told = checkpoint(_overlaps(best, fragments, percent).select("a", "b", "linked"))
    found = connected_components(told.filter("linked"))

    # 2: with its other pivots
    rest = star.join(told, ["a", "b"], "left_anti")
    rest = _component_of(_component_of(rest, found, "a", "ca"), found, "b", "cb").filter("ca <> cb").select("a", "b", "na", "nb")
    found = _joined(found, _overlaps(rest, fragments, percent))

    # 3: the members of a key that are of different components, with each other
    placed = _component_of(met, found, "b", "comp")
    open_keys = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("key")
    members = checkpoint(placed.join(open_keys, "key").select("a", "b", "na", "nb", "comp").distinct())
    return _joined(found, _overlaps(_second_pairs(members, fragments, percent), fragments, percent))


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and node of every row of ``docs`` (doc_id, text).

    ``size`` words make an n-gram; documents link when ``100 * intersection >= percent * union``.
    ``component_id`` is the smallest doc_id reachable, the row's own included; ``node`` numbers its set.

    Null texts and texts without words have the empty set and link with nothing.  Null ids are
    ordered after all others and stay null when a component has no other.  Repeated rows link with each other.
    Extra columns are ignored.  An empty table gives an empty result.
    """
    sketched = checkpoint(sketches(docs, size))
    classes = checkpoint(sketched.filter("n > 0").groupBy("node", "n").agg(F.min("doc_id").alias("doc_id")))

    one_each = bit_filter(classes.select(F.coalesce("doc_id", F.lit(0)).bitwiseXOR(F.col("node")).alias("x")), "x")
    common = checkpoint(_all_keys(docs, size, percent, one_each).groupBy("key").agg(F.count("*").alias("sets")).filter("sets > 1"))
    hits = _matching(docs, size, percent, one_each, bit_filter(common, "key")).join(common, "key").distinct()
    # of a set's keys that others have, linked sets share ``need``: so they share one of its first in an order that holds for all, rarest first
    own = W.partitionBy("node", "level", "need")
    hits = hits.withColumns({"weight": F.count("*").over(own), "place": F.row_number().over(own.orderBy("sets", "key"))})
    hits = checkpoint(hits.filter("place <= weight - need + 1").select("key", "node", "n", "weight"))
    found = _linked_groups(docs, classes, hits, size, percent)

    nodes = classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = nodes.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    nodes = nodes.join(least, "component").select("node", "component_id")
    out = sketched.select("doc_id", "n", "node").join(nodes, "node", "left")
    empty = F.col("n") == 0
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(~empty, F.col("node")).alias("node"),
    )


def keep_first(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component, with all their columns.

    The rows that go are taken out by id and set, so of rows that share an id those with another set stay.  Rows without words
    stay, and so do rows without an id.
    """
    told = jaccard_components(docs, size, percent)
    gone = told.filter("n_shingles > 0 AND doc_id <> component_id").select(F.col("doc_id").alias("gone"), F.col("node").alias("gone_node")).distinct()
    gone = checkpoint(gone)
    bits = bit_filter(gone, "gone")
    may_go = may_be_in(docs, bits)("doc_id")
    doubtful = docs.withColumn("__node", _nodes(docs, size, bits)("doc_id", "text")).filter("__node IS NOT NULL")
    same = (F.col("doc_id") == F.col("gone")) & (F.col("__node") == F.col("gone_node"))
    return docs.filter(~may_go).union(doubtful.join(gone, same, "left_anti").select(*docs.columns))
