"""Checksums, Bloom filters, codecs, the metered log, repair, published streams, cursors and picks."""

import itertools

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import checksum, codecs
from palimpsest.operators import bloom, compact, inspect, relations, resolve
from palimpsest.sources.metered import MeteredLog
from palimpsest.sources.store import VersionLog
from palimpsest.streaming import latest as stream


def test_crc32c(spark):
    texts = {b"123456789": 0xE3069283, b"": 0, bytes(32): 0x8A9136AA, bytes([255] * 32): 0x62A8AB43, bytes(range(32)): 0x46DD794E}
    df = spark.createDataFrame([(bytearray(t), c) for t, c in texts.items()], "b binary, want long")
    r = df.withColumn("got", checksum.crc32c(F.col("b"))).withColumn("back", checksum.unmask(checksum.masked_crc32c(F.col("b")))).collect()
    assert all(x.got == x.want == x.back for x in r)
    assert spark.range(1).select(checksum.crc32c(F.lit(None).cast("binary")).alias("c")).first().c is None


def test_mask_is_undone(spark):
    numbers = [0, 1, (1 << 32) - 1, 0x7FFFFFFF, 0x80000000, 0xA282EAD8, 0x5D7D1528]
    df = spark.createDataFrame([(n,) for n in numbers], "n long").withColumn("m", checksum.mask(F.col("n")))
    plain = lambda n: (((n >> 15) | (n << 17)) + 0xA282EAD8) & 0xFFFFFFFF
    assert all(r.m == plain(r.n) and r.b == r.n for r in df.withColumn("b", checksum.unmask(F.col("m"))).collect())


def test_bloom_has_no_false_negatives(spark):
    held = spark.range(20_000).selectExpr("id % 3 AS file", "string(id) AS k")
    bits = bloom.sizes(held)
    filters = bloom.build(held, bits)
    assert bloom.may_contain(held, filters, bits).filter("NOT maybe").isEmpty()
    other = spark.range(20_000).selectExpr("id % 3 AS file", "concat('x', id) AS k")
    assert bloom.may_contain(other, filters, bits).filter("maybe").count() < 400
    assert bloom.may_contain(held, bloom.build(held.limit(0), bits), bits).filter("maybe").isEmpty()
    unknown = spark.createDataFrame([(9, "a")], "file long, k string")
    assert bloom.may_contain(unknown, filters, bits).first().maybe is False


def test_codec_registry(spark):
    r = codecs.Registry(codecs.LONG)
    assert r.register(codecs.LONG) is codecs.LONG and r.find("long", 1, codecs.LONG.fingerprint()) is codecs.LONG
    with pytest.raises(ValueError, match="another descriptor"):
        r.register(codecs.Codec("long", 1, codecs.LONG.encode, codecs.LONG.decode))
    with pytest.raises(ValueError, match="another descriptor"):
        r.find("long", 1, "x")
    with pytest.raises(LookupError):
        r.find("long", 2)
    for bad in ({"kind": "other"}, {"version": 0}, {"kind": codecs.VALUE, "ordered": True}, {"maximum_bytes": 0}):
        with pytest.raises(ValueError):
            codecs.Codec(**{"name": "n", "version": 1, "encode": None, "decode": None, **bad})
    ids = spark.createDataFrame([("00112233-4455-6677-8899-aabbccddeeff",), (None,)], "u string")
    assert codecs.round_trip_failures(ids, "u", codecs.BUILT_IN.find("uuid", 1)).isEmpty()
    small = codecs.Codec("small", 1, codecs.STRING.encode, codecs.STRING.decode, maximum_bytes=3)
    with pytest.raises(Exception, match="more than 3 bytes"):
        ids.select(small.encoded(F.col("u"))).collect()


def test_metered_log(spark, tmp_path):
    m = MeteredLog(VersionLog(spark, str(tmp_path / "db")))
    assert m.put("a", "x") == 1 and m.delete("a") == 2 and m.put("b", "y") == 3
    assert m.get("a") is None and m.get("a", 1).v == "x"
    view = m.snapshot()
    with pytest.raises(ValueError):
        m.scan("b", "a")
    got = {r.op: r for r in m.summary().collect()}
    assert [(op, got[op]["count"], got[op].errors) for op in ("PUT", "DELETE", "GET", "SCAN", "SNAPSHOT", "WRITE")] == [("PUT", 2, 0), ("DELETE", 1, 0), ("GET", 2, 0), ("SCAN", 1, 1), ("SNAPSHOT", 1, 0), ("WRITE", 0, 0)]
    assert got["PUT"].least <= got["PUT"].p50 <= got["PUT"].p99 <= got["PUT"].most and view.upto == 3 and got["WRITE"].p99 == 0
    m.reset()
    assert m.summary().filter("count > 0").isEmpty()


def test_repair_tail(spark, tmp_path):
    e = spark.createDataFrame([("s", 1, True), ("s", 2, False), ("s", 3, True), ("t", 1, True), ("u", 1, False)], "segment string, position int, valid boolean")
    plan = {r.segment: (r.entries, r.kept, r.removed, r.first_bad, r.action) for r in inspect.repair_plan(e).collect()}
    assert plan == {"s": (3, 1, 2, 2, "TRUNCATE"), "t": (1, 1, 0, None, "NONE"), "u": (1, 0, 1, 1, "TRUNCATE")}
    with pytest.raises(ValueError, match="3 entries would go"):
        inspect.repair_tail(e, str(tmp_path / "b"), 2)
    assert {(r.segment, r.position) for r in inspect.repair_tail(e, str(tmp_path / "b"), 3).collect()} == {("s", 1), ("t", 1)}
    assert spark.read.parquet(str(tmp_path / "b")).count() == 5


def test_published_files(spark, tmp_path):
    kind, src, out, cp = "k string, seq long, op int, v string", str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    for rows in ([("a", 1, 1, "x"), ("b", 2, 1, "y")], [("a", 3, 2, None)], [("c", 4, 1, "z")]):
        spark.createDataFrame(rows, kind).write.mode("append").parquet(src)
        stream.publish_files(stream.latest(stream.read_commits(spark, src, spark.createDataFrame([], kind).schema)), out, cp).awaitTermination(90)
    assert {(r.k, r.seq, r.op) for r in stream.read_published(spark, out).collect()} == {("a", 3, 2), ("b", 2, 1), ("c", 4, 1)}


def test_cursor_and_seed(spark):
    log = spark.range(500).selectExpr("id AS k", "id + 1 AS seq", "1 AS op", "id AS v")
    assert [r.k for r in itertools.islice(resolve.cursor(resolve.scan(log, 100, 300)), 3)] == [100, 101, 102]
    assert relations.seed_if_empty(log, log.limit(1)).count() == 500


def test_grandparents_and_round_robin(spark):
    files = [(1, 1, 10, 0, 10), (2, 1, 10, 20, 30), (3, 2, 10, 5, 25), (4, 3, 10, 0, 4), (5, 3, 10, 26, 40), (6, 3, 10, 50, 60)]
    m = spark.createDataFrame(files, "file_number long, level int, file_size long, lo long, hi long")
    assert compact.pick_files(m, 1) == {"inputs": [1, 2], "outputs": [3], "grandparents": [4]}
    assert compact.pick_files(m, 1, pointer=99)["inputs"] == [1, 2]
    assert compact.pick_files(m, 4) == {"inputs": [], "outputs": [], "grandparents": []}
