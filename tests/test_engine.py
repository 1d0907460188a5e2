import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import bounds, keys
from palimpsest.operators import compact, inspect, manifest, metrics, relations, replog, resolve, schema, write
from palimpsest.sources import store
from palimpsest.sources.replicated import ReplicatedLog
from palimpsest.sources.store import VersionLog
from palimpsest.sources.typed import Collection, batch, snapshot
from palimpsest.streaming import latest as stream


def test_long_keys_keep_order(spark):
    df = spark.createDataFrame([(k,) for k in (-(1 << 63), -5, -1, 0, 5, (1 << 63) - 1)], "k long")
    rows = df.select("k", keys.long_key(F.col("k")).alias("b")).select("k", "b", keys.long_from_key(F.col("b")).alias("back")).orderBy("b").collect()
    assert [r.k for r in rows] == [r.back for r in rows] == sorted(r.k for r in rows)
    assert bytes(rows[1].b).hex() == "7ffffffffffffffb"


def test_collection_keys(spark):
    c = keys.collection_id("notes", b"ns")
    low, high = keys.collection_range(c)
    raw = spark.range(1).select(keys.typed_key(c, 1, F.lit(bytearray(b"x"))).alias("k")).first().k
    assert low < bytes(raw) < high and c.version == 3 and bytes(raw)[17:] == b"\x00\x01x"


def test_canonical_set_and_display(spark):
    r = spark.range(1).select(
        keys.canonical_set(F.array(*[F.lit(x).cast("long") for x in (2, -1, 0, 1, -2, 2)])).alias("s"),
        keys.display_key(F.lit(bytearray(range(16)))).alias("u"), keys.display_key(F.lit(bytearray(b"a\xff"))).alias("h"), keys.display_key(F.lit(bytearray(b"a/b"))).alias("t"),
    ).first()
    assert r.s == [0, -1, 1, -2, 2]
    assert (r.u, r.h, r.t) == ("00010203-0405-0607-0809-0a0b0c0d0e0f", "61ff", "a/b")


def test_bounds(spark):
    r = spark.range(1).select(bounds.within_bytes(F.lit("éé"), 3).alias("a"), bounds.within_entries(F.array(F.lit(1)), 1).alias("b"), bounds.is_char(F.lit(65536)).alias("c"), bounds.enum_label(F.lit(10), {10: "CREATED"}).alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == (False, True, False, "CREATED")


def test_pressure_states(spark):
    g = 1 << 30
    base = dict(immutable_memtables=0, native_ok=True, wal_bytes=0, l0_files=0, debt_bytes=0, usable_disk=90 * g, total_disk=100 * g, disk_ok=True, failed=False, paused=False)
    cases = [({}, "NORMAL", 0), ({"l0_files": 12}, "SLOWDOWN", 100), ({"l0_files": 16}, "SLOWDOWN", 2575), ({"l0_files": 20}, "STOPPED_RETRYABLE", 0), ({"failed": True}, "FAILED", 0), ({"usable_disk": 4 * g}, "STOPPED_RETRYABLE", 0), ({"immutable_memtables": 3}, "SLOWDOWN", 2575)]
    df = spark.createDataFrame([{**base, **c, "id": k} for k, (c, _, _) in enumerate(cases)])
    got = {r.id: (r.state, r.delay_micros) for r in write.write_pressure(df).collect()}
    assert got == {k: (s, d) for k, (_, s, d) in enumerate(cases)}


def test_batch_limits(spark):
    ops = spark.createDataFrame([(1, "k", "v"), (2, "k" * 65537, "v"), (3, "k", None)], "batch_id int, k string, v string")
    assert {r.batch_id: (r.encoded_bytes, r.status) for r in write.batch_report(ops).collect()} == {1: (38, "OK"), 2: (24 + 12 + 65538, "KEY_TOO_LARGE"), 3: (37, "OK")}


FILES = "file_number long, level int, file_size long, lo long, hi long"


def test_compaction_picks(spark):
    m = spark.createDataFrame([(1, 0, 10, 0, 10), (2, 0, 10, 8, 20), (3, 0, 10, 50, 60), (4, 1, 10, 18, 30), (5, 1, 10, 55, 58), (6, 2, 10, 0, 100)], FILES)
    assert compact.pick_files(m, 0) == {"inputs": [1, 2], "outputs": [4], "grandparents": [6]}
    assert compact.pick_files(m, 1, pointer=30) == {"inputs": [4, 5], "outputs": [6], "grandparents": []}
    assert [(r.file_number, r.other_file) for r in compact.overlap_pairs(m).collect()] == [(1, 2)]
    many = spark.createDataFrame([(k, 0, 10, 0, 1) for k in range(20)], FILES)
    assert compact.pick_level(many).first().reason == "WRITE_STOP"
    assert compact.pick_level(many.limit(0)).isEmpty()


def test_manifest(spark):
    e = spark.createDataFrame([(1, "ADD", 7, 0), (1, "ADD", 8, 0), (2, "DELETE", 7, 0), (3, "ADD", 9, 1)], "edit_number long, action string, file_number long, level int")
    assert {(r.file_number, r.level) for r in manifest.live_files(e).collect()} == {(8, 0), (9, 1)}
    assert manifest.edit_gaps(e).isEmpty()
    c = spark.createDataFrame([(1, True, "a"), (2, True, "b"), (3, False, "c")], "manifest_number int, complete boolean, digest string")
    assert tuple(manifest.current(c).first()) == (2, True)


def test_schema_rules(spark):
    fields = "field_id int, name string, type string, byte_bound int, optional boolean, max_entries int, detail string"
    old = spark.createDataFrame([(16, "name", "string", 100, False, 9, None)], fields)
    new = spark.createDataFrame([(16, "title", "string", 100, False, 9, None), (17, "at", "instant", 0, True, 9, None)], fields)
    assert schema.compatibility(old, new).isEmpty()
    ids = schema.next_field_ids(old, spark.createDataFrame([(20,)], "field_id int"), spark.createDataFrame([("b",), ("a",)], "name string"))
    assert {(r.name, r.field_id) for r in ids.collect()} == {("a", 21), ("b", 22)}
    with pytest.raises(ValueError):
        schema.define(spark, "x", "name", ordered_keys=False)
    reg = schema.define(spark, "x", "name", ordered_keys=True, capabilities=("POINT_READ",))
    with pytest.raises(PermissionError):
        schema.require(reg, "name", "RANGE_SCAN")


def test_log_rules(spark):
    rows = [(1, 1, 1, "COMMAND", 1, 2, replog.GENESIS, "a"), (1, 2, 1, "NOOP", 0, 2, "a", "b"), (1, 3, 2, "COMMAND", 3, 3, "x", "c"), (1, 5, 2, "COMMAND", 4, 4, "c", "d")]
    log = spark.createDataFrame(rows, "log_id int, idx long, term long, type string, seq_start long, seq_after long, previous_hash string, entry_hash string")
    assert {(r.idx, r.problem) for r in replog.violations(log).collect()} == {(3, "HASH"), (5, "INDEX")}
    with pytest.raises(ValueError):
        replog.truncate_suffix(log, 2, 2, 0)
    with pytest.raises(ValueError):
        replog.truncate_suffix(log, 7, 2, 0)
    for bad in ((0, 5, 1, 1), (3, 2, 1, 1), (1, 5, 0, 1), (1, 5, 1, 0)):
        with pytest.raises(ValueError):
            replog.bounded_read(log, *bad)
    first = spark.createDataFrame([(2, 5, 1, "NOOP", 0, 0, "x", "a"), (3, 1, 0, "NOOP", 0, 0, "x", "a"), (4, 1, 0, "NOOP", 0, 0, replog.GENESIS, "a")], log.schema)
    assert {(r.log_id, r.problem) for r in replog.violations(first).collect()} == {(2, "INDEX"), (3, "HASH")}
    ops = spark.createDataFrame([(1, 1, 1, "b", "y"), (1, 0, 1, "a", "x")], "idx int, ordinal int, op int, k string, v string")
    assert [r.k for r in replog.command_ops(replog.command_body(ops)).collect()] == ["a", "b"]


def test_entry_hashes_tell_fields_apart(spark):
    parts = [("a", None, "b"), ("a", "b", None), ("a", "b|c", ""), ("a", "b", "c"), ("a|b", "c", ""), ("", "ab", "c"), (None, "ab", "c")]
    df = spark.createDataFrame(parts, "x string, y string, z string")
    assert df.select(replog.entry_hash(F.lit(replog.GENESIS), F.col("x"), F.col("y"), F.col("z"))).distinct().count() == len(parts)


def test_replicated_log(spark, tmp_path):
    log = ReplicatedLog(spark, str(tmp_path / "r"))
    entry = "idx long, term long, type string, seq_start long, seq_after long, payload string"
    rows = lambda *x: spark.createDataFrame(x, entry)
    log.append(1, rows((1, 1, "COMMAND", 1, 2, "p"), (2, 1, "NOOP", 0, 2, None)))
    log.append(1, rows((3, 2, "COMMAND", 3, 3, "q")))
    for wrong in ((5, 2, "NOOP", 0, 3, None), (4, 1, "NOOP", 0, 3, None), (4, 2, "COMMAND", 9, 9, "z")):
        with pytest.raises(ValueError):
            log.append(1, rows(wrong))
    log.append(2, rows((1, 1, "NOOP", 0, 0, None)))
    assert log.verify().isEmpty() and {(r.log_id, r.idx) for r in log.read().collect()} == {(1, 1), (1, 2), (1, 3), (2, 1)}
    log.truncate(1, 3, 2, 2)
    log.append(1, rows((3, 3, "NOOP", 0, 2, None)))
    assert log.verify().isEmpty() and log.read().filter("log_id = 1 AND idx = 3").first().term == 3


def test_metrics_nearest_rank(spark):
    s = spark.createDataFrame([("GET", float(k), k == 1, k) for k in range(1, 101)], "op string, latency double, failed boolean, ordinal long")
    got = {r.op: r for r in metrics.summary(s).collect()}
    assert (got["GET"].p50, got["GET"].p95, got["GET"].p99, got["PUT"]["count"]) == (50.0, 95.0, 99.0, 0)
    few = {r.op: r for r in metrics.summary(s, last=10, part=16).collect()}["GET"]
    assert (few["count"], few.errors, few.mean, few.least, few.most, few.p50) == (100, 1, 50.5, 1.0, 100.0, 95.0)
    assert sorted(r.ordinal for r in metrics.recent(s, 30, part=16).collect()) == list(range(71, 101))


def test_drop_counts(spark):
    """A tombstone behind a newer version is an old version; only one at a key's boundary is a dropped tombstone."""
    log = spark.createDataFrame([(1, 1, 2, None), (1, 2, 1, "v"), (2, 3, 1, "v"), (2, 4, 2, None)], "k long, seq long, op int, v string")
    assert tuple(compact.drop_counts(log, 5).first()) == (1, 2, 1)
    assert tuple(compact.drop_counts(log, 5, base=False).first()) == (2, 2, 0)
    assert tuple(compact.drop_counts(log, 0).first()) == (4, 0, 0)
    assert {(r.k, r.seq) for r in compact.retain(log, 5).collect()} == {(1, 2)}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_base_level_against_every_file(spark, kind):
    import random

    rng = random.Random(5)
    show = (lambda x: x) if kind == "long" else (lambda x: f"key-{x:06d}")
    files = [(n, rng.choice([1, 2, 3]), 1, lo := rng.randrange(5000), lo + rng.randrange(1, 200)) for n in range(40)]
    m = spark.createDataFrame([(a, b, c, show(d), show(e)) for a, b, c, d, e in files], f"file_number long, level int, file_size long, lo {kind}, hi {kind}")
    ks = spark.createDataFrame([(show(k),) for k in range(0, 5300, 7)], f"k {kind}")
    got = {r.k: r.base for r in compact.base_level(ks, m, 1).collect()}
    assert got == {show(k): not any(b > 1 and lo <= k <= hi for _, b, _, lo, hi in files) for k in range(0, 5300, 7)}
    assert all(r.base for r in compact.base_level(ks, m, 3).collect())


def test_pressure_reasons_are_in_order(spark):
    g = 1 << 30
    row = dict(immutable_memtables=3, native_ok=True, wal_bytes=0, l0_files=0, debt_bytes=0, usable_disk=1, total_disk=100 * g, disk_ok=True, failed=True, paused=True)
    assert write.write_pressure(spark.createDataFrame([row])).first().reasons == "IMMUTABLE_MEMTABLES,DISK_SPACE,BACKGROUND_FAILURE,ADMINISTRATIVE_PAUSE"
    assert write.write_pressure(spark.createDataFrame([{**row, "disk_ok": False}])).first().reasons == "IMMUTABLE_MEMTABLES,BACKGROUND_FAILURE,ADMINISTRATIVE_PAUSE"


def test_upgrade_rules(spark):
    f = spark.createDataFrame([(16, "name", "string", 10, False, 1, None)], "field_id int, name string, type string, byte_bound int, optional boolean, max_entries int, detail string")
    assert schema.upgrade_problems(f, f, (1, 2)).isEmpty()
    assert {r.problem for r in schema.upgrade_problems(f, f, (2, 2), ("a", "b")).collect()} == {"VERSION_NOT_INCREASED", "IDENTITY_CHANGED"}


def test_lookup_of_an_absent_row_raises(spark):
    posts, people = spark.createDataFrame([(1, "a"), (2, "b")], "post int, author string"), spark.createDataFrame([("a", "x")], "id string, name string")
    assert relations.lookup(posts.filter("post = 1"), "author", people, "id").count() == 1
    with pytest.raises(Exception, match="no row for b"):
        relations.lookup(posts, "author", people, "id").collect()


def test_typed_collections(spark, tmp_path):
    text, number = T.StringType(), T.LongType()
    v1 = T.StructType([schema.field(16, "name", text), schema.field(17, "age", number, optional=True)])
    v2 = T.StructType([schema.field(16, "title", text), schema.field(18, "note", text, optional=True)])
    people, notes = Collection("people", v1), Collection("notes", T.StructType([schema.field(16, "body", text)]), encode=keys.long_key, decode=keys.long_from_key)
    log = VersionLog(spark, str(tmp_path / "db"))
    rows = spark.createDataFrame([(1, 0, "ann", "Ann", 5, 1), (1, 1, "bob", "Bob", None, 1), (2, 2, "ann", None, None, 2)], "batch_id int, ordinal int, key string, name string, age long, op int")
    more = spark.createDataFrame([(1, 3, -4, "hello"), (2, 4, 7, "there")], "batch_id int, ordinal int, key long, body string")
    assert log.append(batch([(people, rows), (notes, more.withColumn("op", F.lit(1)))])) == (1, 5)
    at = log.read()
    assert [(r.key, r.name, r.age) for r in people.scan_all(at).collect()] == [("bob", "Bob", None)]
    assert {(r.key, r.name) for r in people.scan_all(at, 3).collect()} == {("ann", "Ann"), ("bob", "Bob")}
    assert [(r.key, r.title, r.note) for r in people.scan_all(at, fields=v2).collect()] == [("bob", "Bob", None)]
    assert people.get(at, "ann").isEmpty() and people.get(at, "ann", 3).first().age == 5
    assert {(r.key, r.body) for r in notes.scan_all(at).collect()} == {(-4, "hello"), (7, "there")}
    assert snapshot([people, notes], at, 3)["notes"].count() == 1
    assert {r.d[:11] for r in at.select(keys.display_key(F.col("k")).alias("d")).collect()} == {"collection/"}
    with pytest.raises(Exception, match="required field 18"):
        people.scan_all(at, fields=T.StructType([schema.field(18, "note", text)])).collect()


def test_store(spark, tmp_path):
    log = VersionLog(spark, str(tmp_path / "db"))
    ops = lambda rows: spark.createDataFrame(rows, "batch_id int, ordinal int, k string, op int, v string")
    assert log.append(ops([(1, 0, "a", 1, "x"), (1, 1, "b", 1, ""), (2, 0, "a", 2, None)])) == (1, 3)
    assert log.flush() == 3
    assert log.append(ops([(1, 0, "c", 1, "z")])) == (4, 4)
    assert log.append(ops([])) == (0, 0)
    assert {(r.k, r.v) for r in resolve.as_of(log.read()).collect()} == {("b", ""), ("c", "z")}
    assert {(r.k, r.v) for r in resolve.as_of(log.read(), 2).collect()} == {("a", "x"), ("b", "")}
    assert log.checkpoint(str(tmp_path / "copy")) == {"rows": 2, "last_seq": 4}
    again = store.restore(spark, str(tmp_path / "copy"), str(tmp_path / "again"))
    assert again.last_sequence() == 4 and {(r.k, r.v) for r in again.read().collect()} == {("b", ""), ("c", "z")}
    pinned = log.pin()
    assert log.put("d", "w") == 5 and log.delete("c") == 6
    assert pinned.read().count() == 4 and log.read(4).count() == 4 and log.read().count() == 6
    # rows without a manifest file, as a lost writer leaves them, are not there
    spark.createDataFrame([("ghost", 1, "g", 7)], "k string, op int, v string, seq long").write.parquet(str(tmp_path / "db/data/commit-lost"))
    assert log.last_sequence() == 6 and log.read().filter("k = 'ghost'").isEmpty()
    with pytest.raises(Exception, match="already exists"):
        log._publish("commit", 7, 7, "commit-lost", log.edits()[-1].number)
    # a non-deterministic input is evaluated once: sequences have no gap
    dice = spark.range(1000).filter(F.rand() < 0.5).select(F.lit(1).alias("batch_id"), F.col("id").cast("int").alias("ordinal"), F.col("id").cast("string").alias("k"), F.lit(1).alias("op"), F.lit("v").alias("v"))
    first, last = log.append(dice)
    assert first == 7 and log.read().filter("seq > 6").count() == last - 6 and write.sequence_gaps(log.read().filter("seq > 6")).isEmpty()
    assert log.identity()["durability"] == "GROUP_SYNC"
    log.flush(oldest_snapshot=6)
    assert resolve.as_of(log.read(), 6).count() == 2 and pinned.read().count() == 4
    with pytest.raises(ValueError):
        log.append(ops([(1, 0, "k" * 65537, 1, "v")]))


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 1, "x"), ("a", 2, 2, None), ("b", 3, 1, "y")], "k string, seq long, op int, v string")
    rows.write.parquet(str(tmp_path / "in"))
    q = stream.publish(stream.latest(stream.read_commits(spark, str(tmp_path / "in"), rows.schema)), "view", str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert {(r.k, r.seq, r.op) for r in spark.sql("SELECT * FROM view").collect()} == {("a", 2, 2), ("b", 3, 1)}


def test_valid_prefix_and_salvage(spark):
    e = spark.createDataFrame([("s", 1, True), ("s", 2, False), ("s", 3, True), ("t", 1, True)], "segment string, position int, valid boolean")
    assert {(r.segment, r.position) for r in inspect.valid_prefix(e).collect()} == {("s", 1), ("t", 1)}
    log = spark.createDataFrame([("a", 1, 1, "x"), ("a", 2, 2, None)], "k string, seq long, op int, v string")
    assert [(r.k, r.op) for r in inspect.salvage(log).collect()] == [("a", 2)]
