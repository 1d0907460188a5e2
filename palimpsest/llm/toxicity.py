"""Toxicity: a learned lexicon in a trie, matched by Levenshtein automata, weighed by the words around.

The lexicon is learned from labelled documents: whole words and word stems that stand almost only in toxic ones.
The trie and the terms' Levenshtein automata are intersected into one automaton whose states are made as words ask for them:
nearly every word leaves it after two or three letters.  A hit with quotation marks or words of reporting around it is counted
apart from a plain one, and so is a misspelled one; a logistic model weighs the four counts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import kernels as K
from palimpsest.llm.shared import checkpoint

#: Labelled documents that are learned from, at most: those with the smallest hash of their id.
TRAIN_DOCUMENTS = 12_000
STEMS = (4, 5, 6, 7, 8)
#: Letters from which a whole word, or a stem, may have one letter wrong.
FUZZY_WORD, FUZZY_STEM = 5, 8
#: Words on either side that tell quotation.
WINDOW = 4
CACHE_WORDS = 1_000_000

#: Words that report what others say, in English, German, French and Spanish.
REPORTING = frozenset(
    "said says say called calls quote quoted quotes word words term wrote insult insults slur "
    "sagte sagt nannte wort zitat dit disait appelle mot citation dijo dice llama palabra cita".split()
)
QUOTES = frozenset("\"'“”„«»‘’")

_TOKEN = re.compile(r"[^\W_]+(?:[@$*!_'’]+[^\W_]+)*")
_QUOTE, _REPORT, _FIRST = 1, 2, 3  # codes of a word: a quotation mark, a word of reporting, then hits
PLAIN, QUOTED, WRONG, WRONG_QUOTED = range(4)
#: What the weights of (constant, plain, quoted, misspelled, misspelled and quoted) are drawn to.
PRIOR = np.array([-4.0, 6.0, 1.5, 3.0, 0.5])


class Automaton:
    """The trie of (term, whole word or stem) intersected with Levenshtein automata of one edit at most.

    A state is the set of (node, edits) that the letters read so far allow, closed under skipped letters, with the
    best stem found.  ``match`` gives 0 for an exact hit, 1 for a misspelled one, else None.
    """

    def __init__(self, terms: tuple[tuple[str, bool], ...]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.limit: list[dict[bool, int]] = [{}]  # whole word? -> edits allowed at this end
        for term, whole in terms:
            node = 0
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({}), self.limit.append({})
                node = self.children[node][c]
            self.limit[node][whole] = int(len(term) >= (FUZZY_WORD if whole else FUZZY_STEM))
        self.states: dict[tuple, int] = {}
        self.sets: list[tuple[frozenset, int | None]] = []
        self.moves: list[dict[str, int]] = []
        self.ends: list[int | None] = []
        self.start = self._state({(0, 0)}, None)

    def _state(self, held: set[tuple[int, int]], stem: int | None) -> int:
        held = held | {(n, 1) for k, e in held if e == 0 for n in self.children[k].values()}
        for k, e in held:
            if e <= self.limit[k].get(False, -1):
                stem = e if stem is None else min(stem, e)
        key = (frozenset(held), stem)
        if key not in self.states:
            self.states[key] = len(self.sets)
            whole = [e for k, e in held if e <= self.limit[k].get(True, -1)]
            self.sets.append(key), self.moves.append({}), self.ends.append(min([*whole, *([] if stem is None else [stem])], default=None))
        return self.states[key]

    def _move(self, state: int, c: str) -> int:
        held, stem = self.sets[state]
        out = set()
        for k, e in held:
            if c in self.children[k]:
                out.add((self.children[k][c], e))
            if e == 0:
                out.add((k, 1))
                out.update((n, 1) for n in self.children[k].values())
        self.moves[state][c] = new = self._state(out, stem) if out or stem is not None else -1
        return new

    def match(self, word: str) -> int | None:
        state, moves = self.start, self.moves
        for c in word:
            new = moves[state].get(c)
            state = self._move(state, c) if new is None else new
            if state < 0:
                return None
            if not self.sets[state][0]:
                break
        return self.ends[state]


@dataclass(frozen=True)
class Model:
    """Terms (and whether each is a whole word), and weights of the constant and the four counts."""

    terms: tuple[tuple[str, bool], ...]
    weights: np.ndarray


class Matcher:
    """Counts the four kinds of hits of each text of a slice."""

    def __init__(self, terms: tuple[tuple[str, bool], ...]) -> None:
        self.automaton, self.memo = Automaton(terms), K.Memo(CACHE_WORDS, np.uint8)

    def _codes(self, word: str) -> list[int]:
        low = word.lower()
        out = [_QUOTE] if not QUOTES.isdisjoint(low[0] + low[-1] + low[1:2] + low[-2:-1]) else []
        for token in _TOKEN.findall(low):
            if token in REPORTING:
                out.append(_REPORT)
            if (edits := self.automaton.match(token)) is not None:
                out.append(_FIRST + edits)
        return out

    def counts(self, batch: pa.RecordBatch) -> np.ndarray:
        data, offsets = K.buffers(batch.column(batch.schema.get_field_index("text")))
        out = np.zeros((batch.num_rows, 4))
        starts, ends, doc = K.words(data, offsets)
        if not len(starts):
            return out
        codes, distinct, first = K.factorize(K.span_hashes(data, starts, ends))
        raw = data.tobytes()

        def encode(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = zip(starts[first[new]].tolist(), ends[first[new]].tolist())
            lists = [self._codes(raw[a:b].decode("utf-8")) for a, b in at]
            return np.array([c for x in lists for c in x], np.uint8), np.array([len(x) for x in lists], np.int64)

        if len(distinct) > self.memo.limit:
            self.memo = K.Memo(2 * len(distinct), np.uint8)
        pool, begin, size = K.coded(self.memo, distinct, encode)
        each = size[codes]
        found, word = K.gather(pool, begin[codes], each), np.repeat(np.arange(len(codes)), each)
        tells = np.concatenate(([0], np.cumsum(np.bincount(word[found < _FIRST], minlength=len(codes)))))
        at, kind = word[found >= _FIRST], found[found >= _FIRST] - _FIRST
        bounds = np.searchsorted(doc, np.arange(batch.num_rows + 1))
        low = np.maximum(at - WINDOW, bounds[doc[at]])
        high = np.minimum(at + WINDOW + 1, bounds[doc[at] + 1])
        quoted = tells[high] > tells[low]
        np.add.at(out, (doc[at], kind.astype(np.int64) * 2 + quoted), 1)
        return out


def one_of_each(sample: DataFrame) -> DataFrame:
    """``sample`` (text, label) with one of each group of copies and near copies, which would make chance words look telling.

    Texts go that share, with one that stays, the least hash of their three-word shingles under either of two seeds.
    """
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+")
    for seed in (1, 2):
        grams = F.expr("transform(sequence(0, greatest(size(w) - 3, 0)), i -> xxhash64(w[i], get(w, i + 1), get(w, i + 2), %d))" % seed)
        sample = sample.withColumn("w", words).withColumn("least", F.array_min(grams)).dropDuplicates(["least"]).select("text", "label")
    return sample


def learn_terms(sample: DataFrame) -> tuple[tuple[str, bool], ...]:
    """Words and stems of the toxic texts of ``sample`` (text, label) that are far more frequent there than by chance.

    The sample is bounded by ``TRAIN_DOCUMENTS``; what reaches the driver are terms of at least three toxic
    documents with at most a fifth as many clean ones.
    """
    words = F.filter(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+")), lambda w: F.length(w) >= 3)
    stems = F.transform("words", lambda w: F.filter(F.array(*[F.when(F.length(w) >= k, F.concat(F.lit("-"), F.left(w, F.lit(k)))) for k in STEMS]), lambda x: x.isNotNull()))
    rows = sample.filter("text IS NOT NULL").select("label", words.alias("words"))
    rows = rows.select("label", F.explode(F.concat("words", F.array_distinct(F.flatten(stems)))).alias("term"))
    counts = rows.groupBy("term").agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good"))
    counts = counts.filter("bad >= 3 AND good * 5 <= bad")
    sizes = sample.groupBy("label").count().collect()
    total, bad = sum(r["count"] for r in sizes), sum(r["count"] for r in sizes if r.label)
    if not bad or bad == total:
        return ()
    base, found = bad / total, counts.collect()
    chance = math.log(max(len(found), 1)) + 5
    strong = {}
    for r in found:
        n, p = r.bad + r.good, r.bad / (r.bad + r.good)
        gain = n * (p * math.log(p / base) + ((1 - p) * math.log((1 - p) / (1 - base)) if p < 1 else 0))
        if p > base and p >= 0.9 and gain > chance:
            strong[r.term] = r.bad
    # of stems that tell the same documents the longest stays, of them a whole word
    out: dict[tuple[str, bool], None] = {}
    stems_of = sorted((t[1:] for t in strong if t[0] == "-"), key=len)
    roots = [s for s in stems_of if not any(s != o and s.startswith(o) for o in stems_of)]
    for root in roots:
        longer = [t for t in strong if t.lstrip("-").startswith(root) and strong[t] >= 0.9 * strong["-" + root]]
        best = max(longer, key=lambda t: (len(t.lstrip("-")), t[0] != "-", t))
        out[best.lstrip("-"), best[0] != "-"] = None
    for t in strong:
        if t[0] != "-" and not any(t.startswith(r) for r in roots):
            out[t, True] = None
    return tuple(sorted(out))


def fit(x: np.ndarray, y: np.ndarray, strength: float = 0.05) -> np.ndarray:
    """Weights of a logistic model of the counts, drawn to ``PRIOR``, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), np.log1p(x)])
    w = PRIOR.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + strength * (w - PRIOR)
        curve = (x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w = w - step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the ``labels`` (doc_id, label) of ``docs`` (doc_id, text); with no labels, the prior and no terms."""
    known = labels.filter("label IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("label").cast("long").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCUMENTS)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label")
    sample = checkpoint(one_of_each(sample))
    terms = learn_terms(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms)
        for batch in K.slices(batches):
            c = matcher.counts(batch)
            yield pa.RecordBatch.from_arrays([batch.column(1), *[pa.array(c[:, k]) for k in range(4)]], ["label", "a", "b", "c", "d"])

    counted = sample.mapInArrow(run, "label bigint, a double, b double, c double, d double")
    table = counted.groupBy("label", "a", "b", "c", "d").agg(F.count("*").alias("n")).collect()  # of a bounded sample
    if not table:
        return Model(terms, PRIOR)
    rows = np.repeat(np.array([[r.label, r.a, r.b, r.c, r.d] for r in table], float), [r.n for r in table], axis=0)
    return Model(terms, fit(rows[:, 1:], rows[:, 0]))


_matchers: dict[tuple, Matcher] = {}


def _matcher(terms: tuple[tuple[str, bool], ...]) -> Matcher:
    """The worker's matcher of these terms, kept from task to task."""
    if terms not in _matchers:
        _matchers.clear()
        _matchers[terms] = Matcher(terms)
    return _matchers[terms]


def score(docs: DataFrame, model: Model, keep: dict[str, Column], threshold: float = 0.7) -> DataFrame:
    """The ``keep`` columns of every row of ``docs`` (text) with ``score`` and ``predicted``; null texts have no hits."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*[c.alias(k) for k, c in keep.items()], F.col("text").alias("text"))
    schema = source.drop("text").withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        matcher = _matcher(m.terms)
        for batch in K.slices(batches):
            logit = m.weights[0] + np.log1p(matcher.counts(batch)) @ m.weights[1:]
            s = 1 / (1 + np.exp(-np.clip(logit, -700, 700)))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(batch.num_columns - 1)], pa.array(s), pa.array((s >= threshold).astype(np.int32))], schema.names)

    return source.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, train_on: Column, keep: dict[str, Column]) -> DataFrame:
    """Scores every row of ``docs`` (doc_id, text) by a model of the labels of the rows where ``train_on`` holds.

    Of several labels of one id the largest counts; rows without an id are scored, not learned.  Extra columns are ignored.  Null and
    empty texts have no hits and get the score of the constant alone; an empty table gives an empty result.
    """
    return score(docs, train(docs.filter(train_on), labels.filter(train_on)), keep)


def keep_clean(docs: DataFrame, labels: DataFrame, train_on: Column) -> DataFrame:
    """The rows of ``docs`` not predicted toxic, with their own columns only: null and empty texts stay, repeated rows go or stay together, an empty table stays empty."""
    told = classify(docs, labels, train_on, {"__row": F.struct(*[F.col(c) for c in docs.columns])})
    return told.filter("predicted = 0").select("__row.*")
