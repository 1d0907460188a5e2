"""Best-fit packing of tokenised documents: bounded-space online best fit.

A fixed number of bins is open.  A bitset, one bit for each free space, finds the bin with the least
free space that still takes a piece; when none does and all bins are open, the fullest closes first.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import kernels as K
from palimpsest.llm.shared import checkpoint

CAPACITY = 2048
OPEN_BINS = 1024
#: Sequences that one packing task makes, about; tasks grow in number with the input.
TASK_SEQUENCES = 16384
#: Words whose ids a worker remembers.
CACHE_WORDS = 1_000_000


class BestFit:
    """Packs lengths one after the other; ``add`` gives the sequence number and offset of each."""

    def __init__(self, capacity: int = CAPACITY, bins: int = OPEN_BINS) -> None:
        self.capacity, self.bins = capacity, bins
        self.by_free: dict[int, list[int]] = {}
        self.bits = 0  # bit f: some open bin has f free places
        self.open = self.made = 0

    def _take(self, free: int) -> int:
        held = self.by_free[free]
        number = held.pop()
        if not held:
            self.bits &= ~(1 << free)
        self.open -= 1
        return number

    def add(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.capacity, self.made
            self.made += 1
            if length < free and self.open >= self.bins:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
        left = free - length
        if left:
            self.by_free.setdefault(left, []).append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, self.capacity - free


class WordTokenizer:
    """Token ids of whole texts, word by word: the tokenizer never joins what ASCII white space parts.

    Each distinct word is encoded once; a worker remembers up to ``CACHE_WORDS`` of them.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.memo = K.Memo(CACHE_WORDS)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        values, sizes = [], []
        for at in range(0, len(words), 4096):  # encodings are large objects
            lists = [x.ids for x in self.tokenizer.encode_batch_fast(words[at : at + 4096], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, lists), np.int64, len(lists)))
            values.append(np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes[-1].sum())))
        return np.concatenate(values), np.concatenate(sizes)

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice in a row, and where each text's ids begin (one more than texts)."""
        starts, ends, doc = K.words(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        codes, distinct, first = K.factorize(K.span_hashes(data, starts, ends))
        raw = data.tobytes()

        def encode(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = zip(starts[first[new]].tolist(), ends[first[new]].tolist())
            return self._encode([raw[a:b].decode("utf-8") for a, b in at])

        if len(distinct) > self.memo.limit:  # one huge text
            self.memo = K.Memo(2 * len(distinct))
        pool, begin, size = K.coded(self.memo, distinct, encode)
        each = size[codes]
        by_doc = np.bincount(doc, weights=each, minlength=len(offsets) - 1).astype(np.int64)
        return K.gather(pool, begin[codes], each), np.concatenate(([0], np.cumsum(by_doc)))


@lru_cache(maxsize=1)
def word_tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer, made once and kept from task to task."""
    return WordTokenizer(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, separator: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's ids followed by ``separator``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_tokenizer(tokenizer)
        for batch in K.slices(batches):
            ids, place = coder.ids(*K.buffers(batch.column(1)))
            rows, piece, start, length, crc = [], [], [], [], []
            for row in range(batch.num_rows):
                own = np.append(ids[place[row] : place[row + 1]], np.uint32(separator)).astype("<u4")
                for k, at in enumerate(range(0, len(own), capacity)):
                    part = own[at : at + capacity]
                    rows.append(row), piece.append(k), start.append(at), length.append(len(part)), crc.append(zlib.crc32(part.tobytes()))
            cols = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32())]
            cols += [pa.array(x, pa.int64()) for x in (start, length, crc)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, bins: int = OPEN_BINS, separator: int = 0) -> DataFrame:
    """Packs every document of ``docs`` (doc_id, text): one row for each piece, see ``pieces``, with
    ``sequence_id`` and ``offset``; sequences are gapless from 0 and hold at most ``capacity`` ids.

    Only documents of more than ``capacity`` ids are cut; null and empty texts are the separator alone.  Null ids and repeated
    rows are packed like others.  Extra columns are ignored; an empty table gives an empty result.

    Pieces are dealt in hash order, which mixes their lengths, to as many tasks as the token count asks for.
    """
    made = checkpoint(pieces(docs, tokenizer, capacity, separator))
    total = made.agg(F.sum("length")).first()[0] or 0
    tasks = 1 + int(total) // (capacity * TASK_SEQUENCES)
    order = F.xxhash64("doc_id", "piece", "ids_crc32")
    # every task's last bins stay unfilled, so few tasks pack best
    dealt = made.withColumn("deal", order).repartition(tasks, "deal").sortWithinPartitions("deal", "doc_id", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, fit = TaskContext.get().partitionId() << 40, BestFit(capacity, bins)
        for batch in batches:
            got = [fit.add(n) for n in batch.column("length").to_pylist()]
            cols = [batch.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")]
            cols += [pa.array([base + s for s, _ in got], pa.int64()), pa.array([o for _, o in got], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return dealt.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
