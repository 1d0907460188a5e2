"""Each operator against SQL, brute force, a library or held-out labels, and on odd tables."""

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.llm import exact_dedup, jaccard_join, language_id, language_model, license_scan, packing, quality_model, quality_rules, queries, sentencepiece_unigram, toxicity
from palimpsest.llm import kernels as K
from palimpsest.llm.oracles import ORACLES
from palimpsest.llm.shared import checkpoint
from tests.oracle import SF_DIR, both

BPE, PIECES = queries.tokenizer_path("word_bpe_49k.json"), queries.tokenizer_path("piece_bpe_32k.model")
BASE = "der quick brown fox jumps over the lazy dog while seven wizards vex bold knights near the quiet lake at dawn today"
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, BASE), (6, BASE), (6, BASE), (7, BASE + " end"), (None, BASE), (None, None),
    (8, "é" * 5000), (9, "a b " * 8000), (10, "x\x00y \x1c#*$ <|endoftext|> CC BY cc-by all rights  reserved\nfoo"), (11, BASE.replace(" ", "\n\t ")), (12, "😀 ½ 漢字 ñ"),
]
LABELS = [(5, 1), (6, 1), (4, 0), (None, 1), (9, 0), (9, None), (7, 1), (5, 0)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "zz", 1, "clash", 0) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, kept int, score string, label int")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, label int")


def operators(docs, labels):
    yes, keep = F.lit(True), {"doc_id": F.col("doc_id")}
    return {
        "license": lambda: license_scan.scan(docs),
        "language": lambda: language_id.predict(docs, language_id.train(docs.select("text", F.lit("xx").alias("lang"))), keep),
        "rules": lambda: quality_rules.judge(docs),
        "quality": lambda: quality_model.classify(docs, labels, yes, keep),
        "jaccard": lambda: jaccard_join.jaccard_components(docs),
        "lm": lambda: language_model.score_texts(docs, F.coalesce(F.col("doc_id") == 5, F.lit(False)), keep),
        "pieces": lambda: sentencepiece_unigram.round_trip(docs, PIECES),
        "dedup": lambda: exact_dedup.exact_duplicates(docs),
        "toxic": lambda: toxicity.classify(docs, labels, yes, keep),
    }


NAMES = ["license", "language", "rules", "quality", "jaccard", "lm", "pieces", "dedup", "toxic"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_give_one_row_each(odd, labels, name):
    assert sorted(str(r.doc_id) for r in operators(odd, labels)[name]().collect()) == sorted(str(i) for i, _ in ODD)


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(odd, labels, name):
    assert operators(odd.limit(0), labels.limit(0))[name]().collect() == []


STAGE_HELPERS = {
    "quality_rules": lambda docs, labels: quality_rules.keep_good(docs),
    "toxicity": lambda docs, labels: toxicity.keep_clean(docs, labels, F.lit(True)),
    "exact_dedup": lambda docs, labels: exact_dedup.keep_first(docs),
    "jaccard_join": lambda docs, labels: jaccard_join.keep_first(docs),
}


@pytest.mark.parametrize("name", STAGE_HELPERS)
def test_stage_helpers_on_odd_and_empty_tables(odd, labels, name):
    """All columns stay, clashing names too; rows are rows of the input; an empty table gives an empty one."""
    out = STAGE_HELPERS[name](odd, labels)
    rows = Counter(tuple(r) for r in out.collect())
    assert out.columns == odd.columns and rows and not rows - Counter(tuple(r) for r in odd.collect())
    empty = STAGE_HELPERS[name](odd.limit(0), labels.limit(0))
    assert empty.columns == odd.columns and empty.collect() == []
    left = {(r.doc_id, r.text) for r in out.collect()}
    if name == "exact_dedup":
        assert left == {(1, None), (4, "one"), (5, BASE), (7, BASE + " end"), *[x for x in ODD if x[0] in (3, 8, 9, 10, 12)]}
    if name == "jaccard_join":
        assert {(5, BASE), (None, None), (1, None), (2, "")} <= left and not left & {(6, BASE), (7, BASE + " end")}


def test_packing_an_empty_table(odd):
    assert packing.pack(odd.limit(0), BPE).collect() == []


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    mine, theirs = both(spark, queries.QUERIES[name], ORACLES[name])
    assert mine == theirs


def grams(text, size):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80), (2, 60)])
def test_jaccard_join_against_all_pairs(spark, size, percent):
    """Groups of near copies, some of which are linked through others only, and unrelated texts."""
    rng = np.random.default_rng(percent)
    texts = []
    for g in range(12):
        base = [f"w{x}" for x in rng.integers(0, 300, rng.integers(6, 90))]
        for _ in range(rng.integers(1, 14)):
            own = list(base)
            for _ in range(rng.integers(0, 5)):
                own[rng.integers(0, len(own))] = f"v{rng.integers(0, 50)}"
            texts.append(" ".join(own))
    sets = [grams(t, size) for t in texts]
    top = list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        both_ = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both_ >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, size, percent).collect()}
    assert got == {k: (len(s), find(k)) for k, s in enumerate(sets)}


def test_jaccard_on_odd_rows(odd):
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard_join.jaccard_components(odd).collect()}
    assert got[2, 0] == 2 and got[6, 17 + 1] == got[7, 19] == got[11, 18] == got[None, 18] == 5 and got[None, 0] is None


def test_near_keep_first_leaves_another_text_with_a_repeated_id(spark):
    other = " ".join(f"other{k}" for k in range(30))
    rows = [(5, BASE, "a"), (6, BASE, "b"), (6, other, "c"), (6, None, "d"), (7, BASE + " end", "e"), (None, BASE, "f"), (8, other, "g")]
    left = jaccard_join.keep_first(spark.createDataFrame(rows, "doc_id long, text string, tag string"))
    assert left.columns == ["doc_id", "text", "tag"] and sorted(r.tag for r in left.collect()) == ["a", "c", "d", "f"]


@pytest.mark.parametrize("helper", [jaccard_join.keep_first, exact_dedup.keep_first])
def test_keep_first_runs_one_python_worker_a_task(spark, odd, helper):
    """Python nodes that feed one another hold two workers in each task, and workers stay."""
    plan = helper(odd)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2  # one for each side of the union


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=9000), st.binary(max_size=9000), st.binary(max_size=300))
def test_fingerprints_combine(x, y, z):
    f = lambda b: exact_dedup.fingerprint(np.frombuffer(b, np.uint8))
    plain = [sum((c + 1) * pow(b, len(x) - 1 - i, p) for i, c in enumerate(x)) % p for b, p in zip(exact_dedup.BASES, exact_dedup.PRIMES)]
    assert f(x) == (*plain, len(x))
    assert exact_dedup.combine(f(x), exact_dedup.combine(f(y), f(z))) == exact_dedup.combine(exact_dedup.combine(f(x), f(y)), f(z)) == f(x + y + z)


def colliding_texts():
    """Two different texts of one length with equal fingerprints: blocks that collide under the first prime, then a choice of blocks that does under the second."""
    rng, (p, q), (b, c) = np.random.default_rng(3), exact_dedup.PRIMES, exact_dedup.BASES
    blocks = np.unique(rng.integers(97, 123, (400_000, 8)), axis=0).astype(np.int64)
    value = lambda base, prime: sum(((blocks[:, i] + 1) * pow(base, 7 - i, prime)) % prime for i in range(8)) % prime
    h, other = value(b, p), value(c, q)
    order = np.argsort(h, kind="stable")
    at = np.flatnonzero(np.diff(h[order]) == 0)[:21]
    pairs = [(order[i], order[i + 1]) for i in at]
    sums = np.zeros(1, np.int64)
    for k, (x, y) in enumerate(pairs):
        step = int(other[y] - other[x]) * pow(c, 8 * (len(pairs) - 1 - k), q) % q
        sums = np.concatenate((sums, (sums + step) % q))
    rank = np.argsort(sums, kind="stable")
    same = np.flatnonzero(np.diff(sums[rank]) == 0)
    text = lambda pick: "".join(bytes(blocks[pair[int(pick) >> k & 1]].astype(np.uint8)).decode() for k, pair in enumerate(pairs))
    return text(rank[same[0]]), text(rank[same[0] + 1])


def test_dedup_when_fingerprints_collide(spark):
    x, y = colliding_texts()
    f = lambda t: exact_dedup.fingerprint(np.frombuffer(t.encode(), np.uint8))
    assert x != y and f(x) == f(y)
    rows = [(1, y), (2, x), (3, x), (4, y), (5, x + " more"), (None, x), (7, y.upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(docs).collect()}
    assert got == {1: (1, 2, True), 2: (2, 3, True), 3: (2, 3, False), 4: (1, 2, False), 5: (5, 1, True), None: (2, 3, False), 7: (7, 1, True)}
    assert {r.doc_id for r in exact_dedup.keep_first(docs).collect()} == {1, 2, 5, 7}


def test_dedup_of_texts_of_many_chunks(spark):
    """Texts longer than a slice, equal but for white space, or different in their last byte only."""
    long = "lorem ipsum dolor " * 150_000
    rows = [(3, long + "x"), (1, long.replace(" ", "\t\n") + "x"), (2, long + "y"), (4, "x")]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(long) > K.SLICE_BYTES and got == {1: (1, 2), 3: (1, 2), 2: (2, 1), 4: (4, 1)}


def test_dedup_on_odd_rows(odd):
    rows = {(r.doc_id, r.text_sha256): r for r in exact_dedup.exact_duplicates(odd).collect()}
    sha = hashlib.sha256(BASE.encode()).hexdigest()
    assert rows[11, sha].keep_id == rows[None, sha].keep_id == 5 and rows[5, sha].group_size == 5 and rows[5, sha].kept
    assert sum(r.kept for r in exact_dedup.exact_duplicates(odd).filter("doc_id = 6").collect()) == 0


def test_packing(spark, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    rows = packing.pack(odd, BPE).collect()
    ids = {str(i): np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4") for i, x in ODD if i is not None}
    for r in rows:
        if r.doc_id is not None:
            own = ids[str(r.doc_id)][r.start : r.start + r.length]
            assert len(own) == r.length and zlib.crc32(own.tobytes()) == r.ids_crc32
    total = sum(r.length for r in rows)
    assert total == sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x in ODD)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in by.values():
        at = 0
        for o, n in sorted(held):
            assert o == at
            at += n
        assert at <= 2048
    assert len(by) <= math.ceil(total / 2048) + 1


def test_best_fit_takes_the_fullest_that_fits():
    fit = packing.BestFit(10, 2)
    assert [fit.add(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    fit = packing.BestFit(10, 2)
    assert [fit.add(n)[0] for n in (6, 7, 8, 4, 2)] == [0, 1, 2, 0, 2]  # bin 1 is the fullest when a third opens


def test_pieces_equal_the_library():
    import sentencepiece
    import sentencepiece.sentencepiece_model_pb2 as pb
    import pyarrow.parquet as pq

    m = pb.ModelProto()
    m.ParseFromString(open(PIECES, "rb").read())
    m.trainer_spec.model_type = 1  # the same pieces and scores, segmented as a unigram model
    for p in m.pieces:
        p.score = max(p.score, -40000.0)  # the library sums single floats
    lib = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    texts = pq.read_table(f"{SF_DIR}/documents.parquet")["text"].to_pylist()[:60]
    rng = np.random.default_rng(8)
    unspaced = ["".join(map(chr, rng.integers(0x4E00, 0x9FA0, 700))), "".join(rng.choice(list("的一是不了人我在有他这中大来上国個説ひカ"), 900)), "base64" * 300, "ñandú" * 200 + "😀" * 90]
    texts += ["new\nline\ttab", "😀漢字", "naïve café", "a" * 700, *unspaced]
    spaces = ["  two  spaces ", " ", "   "]  # runs of spaces: the library sums their scores of -1e9 in single floats
    codec = sentencepiece_unigram.codec(PIECES)
    ids, place = codec.encode(pa.array(texts + spaces))
    for k, x in enumerate(texts):
        assert ids[place[k] : place[k + 1]].tolist() == lib.encode(x)
    texts += spaces
    assert codec.decode(ids.astype(np.int64), place) == texts


def test_pieces_of_long_unspaced_texts():
    """The walk of a long segment gives what the trie side by side gives, and a megabyte without spaces takes seconds."""
    import time

    codec, rng = sentencepiece_unigram.codec(PIECES), np.random.default_rng(2)
    for _ in range(20):
        text = "".join(rng.choice(list("abcdeéñ的一漢😀"), rng.integers(1, 200))).encode()
        ids, count = sentencepiece_unigram.viterbi(np.frombuffer(text, np.uint8).reshape(1, -1), np.array([len(text)]), codec.p)
        assert sentencepiece_unigram.walk(text, codec.p).tolist() == ids.tolist() and count[0] == len(ids)
    big = "".join(rng.choice(list("的一是不了人我在有他这中大来上国"), 350_000))
    began = time.perf_counter()
    ids, place = codec.encode(pa.array([big]))
    assert time.perf_counter() - began < 20 and codec.decode(ids.astype(np.int64), place) == [big]


def test_pieces_equal_the_unigram_library_on_all_texts():
    """And not the file's own encoder, which is BPE."""
    import sentencepiece
    import sentencepiece.sentencepiece_model_pb2 as pb
    import pyarrow.parquet as pq

    raw = open(PIECES, "rb").read()
    m = pb.ModelProto()
    m.ParseFromString(raw)
    assert m.trainer_spec.model_type == 2
    m.trainer_spec.model_type = 1
    for p in m.pieces:
        p.score = max(p.score, -40000.0)
    unigram, bpe = (sentencepiece.SentencePieceProcessor(model_proto=x) for x in (m.SerializeToString(), raw))
    texts = [t or "" for t in pq.read_table(f"{SF_DIR}/documents.parquet")["text"].to_pylist()]
    ids, place = sentencepiece_unigram.codec(PIECES).encode(pa.array(texts))
    mine = [ids[a:b].tolist() for a, b in zip(place[:-1], place[1:])]
    assert mine == [unigram.encode(t) for t in texts]
    assert all(a != bpe.encode(t) for a, t in zip(mine, texts))


def test_language_model_base_and_held_out(spark):
    got = {r.doc_id: r for r in queries.op6_lm_scoring(spark, SF_DIR).collect()}
    docs = {r.doc_id: r.text for r in queries.table(spark, SF_DIR, "documents").collect()}
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    tokens = {k: [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None] for k, t in docs.items()}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in docs}
    c = Counter(w for k, ws in tokens.items() if not held[k] for w in ws)
    n, v = sum(c.values()), len(c)
    for k, ws in tokens.items():
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel=1e-9)
    assert sum(r.score for r in got.values() if r.held_out) > sum(r.base_score for r in got.values() if r.held_out)


def test_language_model_score_against_plain_counts(spark):
    """The interpolated score and its weights by straightforward counting: each training token is left out of the counts that predict it."""
    docs = {r.doc_id: r.text for r in queries.table(spark, SF_DIR, "documents").collect()}
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    tokens = {k: [None, *re.findall(r"[^\x20\x09-\x0D]+", low(t)), None] for k, t in docs.items()}  # the end stands before a first word, too
    train = [ws for k, ws in tokens.items() if zlib.crc32(str(k).encode()) % 5 != 1]
    c, pairs = Counter(w for ws in train for w in ws[1:]), Counter(p for ws in train for p in zip(ws, ws[1:]))
    triples = Counter(t for ws in train for t in zip(ws, ws[1:], ws[2:]))
    n, v = sum(c.values()), len(c)
    count = np.array(list(c.values()), float)
    w = language_model.mixture_weight((count - 1) / (n - 1) * (v + 1), count)
    uni = lambda x, gone=0: w * max(c[x] - gone, 0) / (n - gone) + (1 - w) / (v + 1)
    by = {}
    for (a, b), k in pairs.items():
        by.setdefault(int(math.log2(c[a])), []).append(((k - 1) / max(c[a] - 1, 1) / uni(b, 1), k))
    share = {g: language_model.mixture_weight(np.array([r for r, _ in x]), np.array([float(k) for _, k in x])) for g, x in by.items()}
    assert len(share) > 5 and max(share.values()) > 0.2
    low_share = lambda a: share.get(int(math.log2(c[a])), 0.0) if c[a] else 0.0
    bi = lambda a, b, gone=0: low_share(a) * max(pairs[a, b] - gone, 0) / max(c[a] - gone, 1) + (1 - low_share(a)) * uni(b, gone)
    by = {}
    for (a, b, d), k in triples.items():
        by.setdefault(int(math.log2(pairs[a, b])), []).append(((k - 1) / max(pairs[a, b] - 1, 1) / bi(b, d, 1), k))
    upper = {g: language_model.mixture_weight(np.array([r for r, _ in x]), np.array([float(k) for _, k in x])) for g, x in by.items()}
    assert len(upper) > 5 and max(upper.values()) > 0.2
    got = {r.doc_id: r.score for r in queries.op6_lm_scoring(spark, SF_DIR).collect()}
    for doc, ws in tokens.items():
        want = math.log10(bi(*ws[:2]))  # a first token has no trigram
        for a, b, d in zip(ws, ws[1:], ws[2:]):
            s = upper.get(int(math.log2(pairs[a, b])), 0.0) if pairs[a, b] else 0.0
            want += math.log10(s * triples[a, b, d] / max(pairs[a, b], 1) + (1 - s) * bi(b, d))
        assert got[doc] == pytest.approx(want, rel=2e-3)


def test_language_model_rows_grow_with_the_text():
    rows = lambda size: (size / language_model.group_bytes(size)) * (size / language_model.group_bytes(size) / 2)
    assert language_model.group_bytes(1 << 20) == language_model.GROUP_BYTES
    assert all(rows(4 * s) <= 4.1 * rows(s) for s in (1 << 36, 1 << 38, 1 << 40))


def test_language_model_counts_beyond_32_bits():
    total = np.array([1, 1, 4095, 4097, 5_000_000_000, 5_000_000_001, 0, 3 << 40])
    table = language_model._count_table(total)
    assert sum(s for _, _, s in table) == total.sum() and sum(n for _, n, _ in table) == 7 and len(table) <= 6
    rows = [{"gid": 7, "r": 0, "n": 3}]
    told = language_model._answers(rows, 0, np.array([5_000_000_000, 1, 3 << 40]), np.array([0, 1, 2]))
    batch = language_model._batch(told, language_model._TELL)
    assert language_model._told(pa.Table.from_batches([batch]), 0).tolist() == [5_000_000_000, 1, 3 << 40]
    for context in (1, 7, 1 << 20, 1 << 40, 1 << 62):  # no two orders of magnitude fall together
        assert language_model._bucket(np.array([context]))[0] == context.bit_length() - 1


def test_language_id_against_plain_counts(spark):
    """Naive Bayes over the same buckets by counting one n-gram at a time; texts are longer than a chunk of the matrix, too."""

    def grams_of(text):
        low = re.sub(" +", " ", "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text or ""))
        for order in language_id.ORDERS:
            for i in range(len(low) - order + 1):
                h = order
                for c in low[i : i + order]:
                    h = (h ^ ord(c)) * 0x9E3779B1 & 0xFFFFFFFF
                    h ^= h >> 15
                yield h & (language_id.BUCKETS - 1)

    docs = queries.table(spark, SF_DIR, "documents").select("doc_id", "text", "lang").collect()[:60]
    rows = [(r.doc_id, (r.text or "")[:2000], r.lang) for r in docs] + [(9001, "Ünd 😀 ǅ 漢字 ñ", "de"), (9002, None, "fr"), (9003, "12 ?!", None), (9004, "the cat sat " * 30000, None)]
    counts, texts = {}, Counter()
    for _, text, lang in rows:
        if lang is not None:
            counts.setdefault(lang, Counter()).update(grams_of(text))
            texts[lang] += 1
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.predict(table, language_id.train(table), {"doc_id": F.col("doc_id")}).collect()}
    for doc, text, _ in rows:
        if not any(c.isalpha() for c in text or ""):
            assert (got[doc].lang_pred, got[doc].score) == ("und", 0.0)
            continue
        own = Counter(grams_of(text))
        logs = {}
        for lang, c in counts.items():
            total = sum(c.values()) + language_id.SMOOTHING * language_id.BUCKETS
            logs[lang] = math.log(texts[lang] / sum(texts.values())) + sum(k * math.log((c[g] + language_id.SMOOTHING) / total) for g, k in own.items())
        best = max(sorted(logs), key=logs.get)
        assert got[doc].lang_pred == best
        assert got[doc].score == pytest.approx(1 / sum(math.exp(x - logs[best]) for x in logs.values()), rel=1e-6)


def test_quality_classifier_against_plain_densities(spark):
    """Statistics by string operations, and log densities by inverse and determinant."""

    def stats(text):
        raw = (text or "").encode()
        words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
        lines = [x for x in raw.split(b"\n") if x]
        n = lambda chars: sum(raw.count(bytes([c])) for c in chars)
        share = lambda x, of: math.log((x + 0.5) / (of + 5.0))
        inked = len(re.sub(rb"[\x20\x09-\x0D]", b"", raw))
        repeats = sum(a == b for a, b in zip(words, words[1:]))
        return [
            math.log1p(len(words)), math.log((inked + 5.0) / (len(words) + 1.0)), share(n(b"#*$%&|<>^~=+@_\\{}[]"), len(words)), share(n(b"!?"), len(words)),
            share(n(range(65, 91)), len(raw)), share(n(range(48, 58)), len(raw)), share(n(b".,;:"), len(words)),
            math.log((len(set(words)) + 5.0) / (len(words) + 5.0)), share(repeats, len(words)), share(len(lines) - len(set(lines)), len(lines)),
        ]

    docs = {r.doc_id: r.text for r in queries.table(spark, SF_DIR, "documents").collect()}
    labels = {r.doc_id: r.quality for r in queries.table(spark, SF_DIR, "labels").collect()}
    x = {k: np.array(stats(t)) for k, t in docs.items()}
    train = [k for k in docs if labels.get(k) in (0, 1) and zlib.crc32(str(k).encode()) % 4 != 2]
    by = {c: np.array([x[k] for k in train if labels[k] == c]) for c in (0, 1)}
    raw = {c: np.cov(v.T, bias=True) for c, v in by.items()}
    pooled = sum(len(by[c]) * raw[c] for c in (0, 1)) / len(train)
    logs = {}
    for c in (0, 1):
        s = (1 - quality_model.SHRINK_DIAGONAL) * raw[c] + quality_model.SHRINK_DIAGONAL * np.diag(np.diag(raw[c]))
        s = (1 - quality_model.SHRINK_POOLED) * s + quality_model.SHRINK_POOLED * pooled + quality_model.RIDGE * np.eye(len(s))
        inverse, mean = np.linalg.inv(s), by[c].mean(axis=0)
        logs[c] = {k: math.log(len(by[c]) / len(train)) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * (v - mean) @ inverse @ (v - mean) for k, v in x.items()}
    for r in queries.op4_quality_classifier(spark, SF_DIR).collect():
        want = 1 / (1 + math.exp(min(700, max(-700, logs[0][r.doc_id] - logs[1][r.doc_id]))))
        assert r.score == pytest.approx(want, rel=1e-4, abs=1e-9) and r.predicted == int(r.score >= 0.7)


def test_toxicity_score_against_plain_matching(spark):
    """Hits by plain edit distance to every term, windows by slicing."""
    terms = (("idiot", True), ("scum", True), ("moron", True), ("lowei", False), ("verachtu", False))
    weights = np.array([-3.0, 4.0, 1.0, 2.5, 0.3])
    lines = ["you 1diot", "an idoit?", "the 'scum' of", "scumm and skum", "he said moron today", "a mor0n b c d e f said", "loweiung verbchtung verachtet", "“idiots” idiot’s m@ron", "", None, "one two " * 400 + "moron"]
    texts = lines + [r.text for r in queries.table(spark, SF_DIR, "documents").orderBy("doc_id").limit(40).collect()]

    def hits(word):
        low, out = word.lower(), []
        if any(q in low[:2] + low[-2:] for q in toxicity.QUOTES):
            out.append("q")
        for token in toxicity._TOKEN.findall(low):
            if token in toxicity.REPORTING:
                out.append("q")
            found = [distance(token, t) for t, whole in terms if whole and distance(token, t) <= (len(t) >= toxicity.FUZZY_WORD)]
            found += [e for t, whole in terms if not whole for e in [min(distance(token[:k], t) for k in range(len(token) + 1))] if e <= (len(t) >= toxicity.FUZZY_STEM)]
            if found:
                out.append(min(found))
        return out

    known = {}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.Model(terms, weights), {"doc_id": F.col("doc_id")}).collect()}
    for k, text in enumerate(texts):
        words_ = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        marks = [known.setdefault(w, hits(w)) for w in words_]
        n = np.zeros(4)
        for i, found in enumerate(marks):
            near = any("q" in m for m in marks[max(0, i - toxicity.WINDOW) : i + toxicity.WINDOW + 1])
            for e in found:
                if e != "q":
                    n[2 * e + near] += 1
        assert got[k] == pytest.approx(1 / (1 + math.exp(-(weights[0] + np.log1p(n) @ weights[1:]))), rel=1e-9), text


def test_mixture_weight_is_the_likeliest():
    ratio, weight = np.array([0.0, 0.5, 3.0, 20.0]), np.array([5.0, 3.0, 4.0, 2.0])
    best = max(np.linspace(0.001, 0.999, 999), key=lambda w: (weight * np.log(w * ratio + 1 - w)).sum())
    assert language_model.mixture_weight(ratio, weight, 500) == pytest.approx(best, abs=2e-3)


@pytest.mark.parametrize(("query", "table", "column", "least"), [("op2_language_id", "documents", "lang", 0.98), ("op4_quality_classifier", "labels", "quality", 0.95)])
def test_held_out_accuracy(spark, query, table, column, least):
    told = queries.QUERIES[query](spark, "/root/testdata/sf0.01").filter("held_out")
    truth = queries.table(spark, "/root/testdata/sf0.01", table).filter(f"{column} IS NOT NULL").select("doc_id", column)
    guess = "lang_pred" if column == "lang" else "predicted"
    rows = told.join(truth, "doc_id").selectExpr(f"avg(int({guess} = {column})) AS a").first()
    assert rows.a >= least


def test_toxicity_held_out(spark):
    told = queries.op9_toxicity(spark, "/root/testdata/sf0.01").filter("held_out").join(queries.table(spark, "/root/testdata/sf0.01", "labels"), "doc_id")
    rows = told.groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in rows}
    assert n.get((0, 1), 0) == 0 and n[1, 1] >= 3 * n.get((1, 0), 0)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=1, max_size=8))
def test_automaton_is_edit_distance(word):
    terms = ("abcab", "aabbcc", "cab", "bcabca")
    a = toxicity.Automaton(tuple((t, True) for t in terms))
    best = min((distance(word, t) for t in terms if distance(word, t) <= (len(t) >= toxicity.FUZZY_WORD)), default=None)
    assert a.match(word) == best


def test_quotation_is_counted_apart():
    m = toxicity.Matcher((("idiot", True), ("lowei", False)))
    batch = pa.RecordBatch.from_pydict({"text": ["you idiot there", 'he said "idiot" to her', "an id1ot walks", "loweiung und", "fine words", None]})
    assert m.counts(batch).tolist() == [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [1, 0, 0, 0], [0, 0, 0, 0], [0, 0, 0, 0]]


def test_license_phrases(odd):
    r = license_scan.scan(odd).filter("doc_id = 10").first()
    assert (r.n_base, r.base_labels) == (3, "cc-by,reserved") and r.score == 1.0


WRAPPED = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files",
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:",
    "gpl": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.",
}


def test_license_statements_wrapped_over_lines(spark):
    """In their usual wrapping, in many short lines, behind comment marks, and inside long texts; strewn words are no statement."""
    want, rows = {}, []
    for name, text in WRAPPED.items():
        words_ = text.split()
        short = "\n".join(" ".join(words_[k : k + 3]) for k in range(0, len(words_), 3))
        for form in (text, short, "dnl " + text.replace("\n", "\ndnl "), "lorem ipsum\n" * 900 + short + "\ndolor sit" * 900):
            want[len(rows)] = name
            rows.append((len(rows), form))
        want[len(rows)] = ""
        rows.append((len(rows), "\nlorem ipsum dolor ".join(words_)))
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: v for k, (v, _) in got.items()} == want
    assert all(score == (1.0 if want[k] else 0.0) for k, (_, score) in got.items())


def test_license_sql_finds_wrapped_statements():
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(k, "lorem ipsum\n" * 40 + t + "\ndolor") for k, t in enumerate(WRAPPED.values())])
    got = con.execute(f"SELECT labels, score FROM ({ORACLES['op1_license_scan']}) ORDER BY doc_id").fetchall()
    assert got == [(name, 1.0) for name in WRAPPED]


def test_very_long_clean_text_is_kept(spark):
    """Words with the frequencies of prose, whose distinct ones are 25 % of a stretch and more, but under 25 % of the whole; few words repeated still go."""
    rng = np.random.default_rng(1)
    prose = [" ".join(["the", *(f"word{x}" for x in rng.zipf(1.2, n) % 10**6)]) for n in (5000, 80000)]
    few = [" ".join(f"word{x}" for x in rng.integers(0, 1000, n)) + " the" * (n // 50) for n in (5000, 80000)]
    docs = spark.createDataFrame(list(enumerate(prose + few)), "doc_id long, text string")
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert 4 * len(set(prose[1].split())) < len(prose[1].split()) < 4 * got[1].n_distinct
    assert ["few_distinct_words" in got[k].broken for k in range(4)] == [False, False, True, True]
    assert got[0].n_distinct == len(set(prose[0].split()[:5000])) + 1


def test_span_hashes_tell_words_apart():
    words_ = sorted({f"{a}{b}{c}" for a in ("", "x", "ción", "ñ") for b in map(str, range(300)) for c in ("", ".", "e")})
    data, offsets = K.buffers(pa.array(words_))
    assert len(np.unique(K.span_hashes(data, offsets[:-1], offsets[1:]))) == len(words_)


def test_pipeline_against_the_queries(spark):
    import corpus_pipeline

    docs = queries.table(spark, SF_DIR, "documents")
    good = checkpoint(corpus_pipeline.stage_quality(spark, docs, SF_DIR))
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in queries.op3_quality_rules(spark, SF_DIR).filter("kept").collect()}
    clean = checkpoint(corpus_pipeline.stage_toxicity(spark, good, SF_DIR))
    first = checkpoint(corpus_pipeline.stage_exact(spark, clean, SF_DIR))
    norm = {r.doc_id: re.sub(r"[\x20\x09-\x0D]+", " ", r.text) for r in clean.collect()}
    assert {r.doc_id for r in first.collect()} == {min(k for k in norm if norm[k] == t) for t in set(norm.values())}
    near = checkpoint(corpus_pipeline.stage_near(spark, first, SF_DIR))
    sets = {r.doc_id: grams(r.text, 5) for r in first.collect()}
    kept = {r.doc_id for r in near.collect()}
    links = [(a, b) for a, b in combinations(sorted(sets), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert kept.isdisjoint(b for _, b in links) and kept | {b for _, b in links} == set(sets)
    assert first.columns == near.columns == docs.columns
    packed = corpus_pipeline.run(spark, SF_DIR)
    assert {r.doc_id for r in packed.collect()} == kept
