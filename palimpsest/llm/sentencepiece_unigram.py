"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

Spaces become the marker ``▁`` and one is put in front, as the vocabulary's normaliser says.  No piece has a marker behind
another character, so the best segmentation of a text is that of its segments, each a run of markers and what follows.
Distinct segments of a slice are segmented together: at each start, all of them step through the trie side by side.
What no piece covers falls back to byte pieces.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from palimpsest.llm import kernels as K

MARKER = "▁".encode()
UNKNOWN_PENALTY = 10.0
#: Segments of more bytes, as of scripts without spaces, are walked one by one.
LONG = 256
CACHE_SEGMENTS = 1_000_000


@dataclass(frozen=True)
class Pieces:
    """A vocabulary: bytes and log score of each piece, ids of the byte pieces, and the trie.

    From state s, byte c leads to ``base[s] + c`` if ``check`` there is s; ``value`` is the piece that ends in a state or -1.
    """

    text: tuple[bytes, ...]
    score: np.ndarray
    byte_id: np.ndarray
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    unknown: float


def double_array(keys: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Base, check and value arrays of a trie of (key, number), built breadth first."""
    children: list[dict[int, int]] = [{}]
    number = [-1]
    for key, n in keys:
        node = 0
        for c in key:
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({}), number.append(-1)
            node = children[node][c]
        number[node] = n
    size = 4 * len(children) + 4096
    base, check, value = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    used = np.zeros(size, bool)
    used[0] = True
    value[0] = number[0]
    queue, free = [(0, 0)], 1
    for node, state in queue:
        codes = np.array(sorted(children[node]), np.int64)
        if not len(codes):
            continue
        at = max(1, free - int(codes[0]))
        while True:  # the first place where all children are free, a window at a time
            window = np.arange(at, at + 64)
            fits = np.flatnonzero(~used[window[:, None] + codes].any(axis=1))
            if len(fits):
                at = int(window[fits[0]])
                break
            at += 64
        if used[free : at + codes[0]].mean() > 0.9 if at + codes[0] > free else False:
            free = at + int(codes[0])  # what lies before is all but full
        base[state] = at
        used[at + codes] = True
        check[at + codes] = state
        for c in codes.tolist():
            child = children[node][c]
            value[at + c] = number[child]
            queue.append((child, at + c))
        if at + 1024 > len(used):
            base, check, value = (np.concatenate((x, np.full(len(x), f, np.int64))) for x, f in ((base, 0), (check, -1), (value, -1)))
            used = np.concatenate((used, np.zeros(len(used), bool)))
    return base, check, value


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    """Reads a model file's pieces and scores and builds the trie."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    normaliser = m.Normalize("ﬁ Å\u0065\u0301") if hasattr(m, "Normalize") else None
    if normaliser is not None and normaliser != "▁ﬁ▁Å\u0065\u0301":
        raise ValueError("the vocabulary's normaliser changes characters; only the identity with a marker in front is supported")
    byte_id, text, keys = np.full(256, m.unk_id(), np.int64), [], []
    score = np.array([m.get_score(k) for k in range(n)])
    for k in range(n):
        piece = m.id_to_piece(k)
        if m.is_byte(k):
            byte_id[int(piece[3:5], 16)] = k
            text.append(bytes([int(piece[3:5], 16)]))
        elif m.is_control(k) or m.is_unknown(k) or m.is_unused(k):
            text.append(b"")
        else:
            raw = piece.encode()
            if MARKER in raw.lstrip(MARKER):
                raise ValueError(f"piece {piece!r} has a marker behind another character")
            text.append(raw), keys.append((raw, k))
    base, check, value = double_array(keys)
    least = min((score[k] for _, k in keys if score[k] > -1e8), default=0.0)
    return Pieces(tuple(text), score, byte_id, base, check, value, least - UNKNOWN_PENALTY)


def _char_bytes(lead: np.ndarray) -> np.ndarray:
    return 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)


def viterbi(rows: np.ndarray, size: np.ndarray, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Best segmentation of byte rows of ``size`` (padded): ids in a row, and how many each has.

    Of equal scores the piece that starts first wins.
    """
    n, width = rows.shape
    best, back = np.full((n, width + 1), -np.inf), np.full((n, width + 1), -1, np.int64)
    best[:, 0] = 0
    for i in range(width):
        live = np.flatnonzero((size > i) & (best[:, i] > -np.inf))
        if not len(live):
            continue
        lead = rows[live, i]
        end = i + _char_bytes(lead)
        state, at, j, single = np.zeros(len(live), np.int64), np.arange(len(live)), i, np.zeros(len(live), bool)
        while len(at) and j < width:
            row = live[at]
            new = p.base[state] + rows[row, j]
            ok = (p.check[new] == state) & (size[row] > j)
            at, state, row = at[ok], new[ok], row[ok]
            j += 1
            piece = p.value[state]
            has = piece >= 0
            single[at[has & (end[at] == j)]] = True
            score = best[row, i] + p.score[piece]
            win = has & (score > best[row, j])
            best[row[win], j], back[row[win], j] = score[win], piece[win]
        for k in np.flatnonzero(~single):
            row, to = live[k], min(int(end[k]), int(size[live[k]]))
            if best[row, i] + p.unknown > best[row, to]:
                best[row, to], back[row, to] = best[row, i] + p.unknown, -1
    length = np.array([len(x) for x in p.text])
    out, count, at = [], np.zeros(n, np.int64), size.copy()
    while (live := np.flatnonzero(at > 0)).size:
        piece = back[live, at[live]]
        byte = piece < 0
        ids = np.where(byte, p.byte_id[rows[live, at[live] - 1]], piece)
        out.append((live, count[live].copy(), ids))
        at[live] -= np.where(byte, 1, length[np.maximum(piece, 0)])
        count[live] += 1
    place = np.cumsum(count) - count
    flat = np.zeros(int(count.sum()), np.int64)
    for live, step, ids in out:
        flat[place[live] + count[live] - 1 - step] = ids
    return flat, count


def walk(text: bytes, p: Pieces) -> np.ndarray:
    """What ``viterbi`` gives for one long segment: from each character the trie is walked byte by byte, in plain Python.

    The time is that of the pieces that begin at each character; memory is two numbers for each byte.
    """
    base, check, value, score = (memoryview(x) for x in (p.base, p.check, p.value, p.score))
    n, limit = len(text), len(p.base)
    best, back = [-math.inf] * (n + 1), [-1] * (n + 1)
    best[0] = 0.0
    for i in range(n):
        here = best[i]
        if here == -math.inf:
            continue
        lead = text[i]
        end = min(n, i + 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0))
        state, j, single = 0, i, False
        while j < n:
            new = base[state] + text[j]
            if new >= limit or check[new] != state:
                break
            state, j = new, j + 1
            piece = value[state]
            if piece >= 0:
                single = single or j == end
                if here + score[piece] > best[j]:
                    best[j], back[j] = here + score[piece], piece
        if not single and here + p.unknown > best[end]:
            best[end], back[end] = here + p.unknown, -1
    out, at = [], n
    while at > 0:
        piece = back[at]
        out.append(p.byte_id[text[at - 1]] if piece < 0 else piece)
        at -= 1 if piece < 0 else len(p.text[piece])
    return np.array(out[::-1], np.int64)


class Codec:
    """Encodes and decodes whole texts with one vocabulary."""

    def __init__(self, path: str) -> None:
        self.p = load(path)
        self.memo = K.Memo(CACHE_SEGMENTS)
        self.length = np.array([len(x) for x in self.p.text], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.pool = np.frombuffer(b"".join(self.p.text), np.uint8)

    def _segment(self, segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(x) for x in segments], np.int64)
        order = np.argsort(size, kind="stable")
        values, counts = [], np.zeros(len(segments), np.int64)
        at = 0
        while at < len(order):
            width = int(size[order[at]])
            if width > LONG:  # and so are all that follow
                for k in order[at:]:
                    values.append(walk(segments[k], self.p))
                    counts[k] = len(values[-1])
                break
            top = min(max(width + width // 4, 8), LONG)
            end = min(int(np.searchsorted(size[order], top, "right")), at + 20_000)
            chunk = order[at:end]
            joined = b"".join(segments[k].ljust(int(size[order[end - 1]]), b"\0") for k in chunk)
            ids, counts[chunk] = viterbi(np.frombuffer(joined, np.uint8).reshape(len(chunk), -1), size[chunk], self.p)
            values.append(ids)
            at = end
        flat, place = np.concatenate(values), np.cumsum(counts[order]) - counts[order]
        where = np.zeros(len(order), np.int64)
        where[order] = place
        return K.gather(flat, where, counts), counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin; null and empty texts have none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        fronted = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string())))
        data, offsets = K.buffers(fronted)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        space = data == 32
        first = space.copy()
        first[1:] &= ~space[:-1]
        first[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(data))
        doc = np.searchsorted(offsets, starts, "right") - 1
        codes, distinct, at = K.factorize(K.span_hashes(data, starts, ends))
        raw = data.tobytes()

        def make(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return self._segment([raw[a:b].replace(b" ", MARKER) for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist())])

        if len(distinct) > self.memo.limit:
            self.memo = K.Memo(2 * len(distinct))
        pool, begin, size = K.coded(self.memo, distinct, make)
        each = size[codes]
        by = np.bincount(doc, weights=each, minlength=len(offsets) - 1).astype(np.int64)
        return K.gather(pool, begin[codes], each), np.concatenate(([0], np.cumsum(by)))

    def decode(self, ids: np.ndarray, place: np.ndarray) -> list[str]:
        """Texts of ids in a row: markers are spaces but for the one in front; bytes that are no UTF-8 become U+FFFD."""
        raw = K.gather(self.pool, self.begin[ids], self.length[ids]).tobytes()
        ends = np.concatenate(([0], np.cumsum(self.length[ids])))[place].tolist()
        out = [raw[a:b].decode("utf-8", "replace").replace("▁", " ") for a, b in zip(ends[:-1], ends[1:])]
        return [x[1:] if x[:1] == " " else x for x in out]


@lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    """The worker's codec, kept from task to task."""
    return Codec(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ``ids`` of every row of ``docs`` (doc_id, text); null and empty texts have none.  Repeated rows, null ids and extra columns do not matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches):
            ids, place = codec(path).encode(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(place.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """doc_id and ``text`` of every row of ``coded`` (doc_id, ids); null ids are an empty list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            ids = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            texts = codec(path).decode(ids.astype(np.int64), np.concatenate(([0], np.cumsum(size))).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_ids, n_bytes (ids of byte pieces), ids_crc32 (little-endian unsigned 32-bit ids) and whether decoding gives the text again.

    A text that holds the marker itself decodes to a space there, so it alone does not come back.  Null and empty texts have no ids;
    null comes back as empty, which counts as the same.  Repeated rows get the same result each; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        is_byte = np.zeros(len(c.p.text), bool)
        is_byte[c.p.byte_id] = True
        for batch in K.slices(batches):
            ids, place = c.encode(batch.column(1))
            heads = np.concatenate(([0], np.cumsum(is_byte[ids])))
            crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(place[:-1].tolist(), place[1:].tolist())]
            same = [a == (b or "") for a, b in zip(c.decode(ids.astype(np.int64), place), batch.column(1).to_pylist())]
            cols = [pa.array(np.diff(place)), pa.array(np.diff(heads[place])), pa.array(crc, pa.int64()), pa.array(same)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", "n_ids", "n_bytes", "ids_crc32", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_ids bigint, n_bytes bigint, ids_crc32 bigint, round_trip boolean")
