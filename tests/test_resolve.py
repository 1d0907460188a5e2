import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import compact, resolve


def histories(seeds=120, steps=60):
    """Random histories with short keys (the empty one too), empty values, and deletes of absent keys."""
    rows = []
    for seed in range(seeds):
        rng = random.Random(seed)
        for seq in range(1, steps + 1):
            key = bytes(rng.randrange(4) * 85 for _ in range(rng.randrange(3)))
            dead = rng.random() < 0.3
            rows.append((seed, key, seq, 2 if dead else 1, None if dead else bytes(rng.randrange(256) for _ in range(rng.randrange(5)))))
    return rows


def replay(rows, as_of):
    out = {}
    for seed, key, seq, op, value in rows:
        if seq <= as_of:
            if op == 1:
                out[seed, key] = value
            else:
                out.pop((seed, key), None)
    return out


@pytest.fixture(scope="module")
def log(spark):
    df = spark.createDataFrame(histories(), "seed int, key binary, seq long, op int, v binary")
    return df.select(F.struct("seed", "key").alias("k"), "seq", "op", "v").cache()


@pytest.mark.parametrize("s", [0, 1, 17, 40, 60])
def test_as_of_equals_replay(log, s):
    want = replay(histories(), s)
    for form in (resolve.as_of(log, s), resolve.newest_by_window(log, s).filter("op = 1")):
        got = {(r.k.seed, bytes(r.k.key)): bytes(r.v) for r in form.collect()}
        assert got == want


@pytest.mark.parametrize("s", [30, 31, 50, 60])
def test_gc_keeps_what_later_snapshots_see(log, s):
    kept = compact.retain(log, 30)
    a = {(r.k.seed, bytes(r.k.key)): bytes(r.v) for r in resolve.as_of(kept, s).collect()}
    assert a == replay(histories(), s)
    assert kept.count() < log.count()


def test_unsigned_prefix_first_order(spark):
    keys = [b"", b"\x00", b"\x00\x00", b"\x7f", b"\x80", b"\xff", b"\xff\x00"]
    df = spark.createDataFrame([(bytearray(k),) for k in reversed(keys)], "k binary")
    assert [bytes(r.k) for r in df.orderBy("k").collect()] == keys


def test_scan_bounds(spark):
    log = spark.createDataFrame([(k, k + 1, 1, "v") for k in range(10)], "k long, seq long, op int, v string")
    assert [r.k for r in resolve.scan(log, 3, 6).collect()] == [3, 4, 5]
    assert resolve.scan(log, 3, 3).isEmpty()
    with pytest.raises(ValueError):
        resolve.scan(log, 4, 3)
    assert [r.k for r in resolve.cursor(resolve.scan_all(log, 2))] == [0, 1]


def test_conflicting_duplicates(spark):
    log = spark.createDataFrame([(1, 1, 1, "a"), (1, 1, 1, "a"), (2, 2, 1, "a"), (2, 2, 1, "b"), (3, 3, 2, None)], "k long, seq long, op int, v string")
    got = {r.k: r.conflict for r in compact.dedup(log).collect()}
    assert got == {1: False, 2: True, 3: False}
    assert {(r.k, r.different_values) for r in resolve.duplicate_versions(log).collect()} == {(1, 1), (2, 2)}
