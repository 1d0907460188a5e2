"""Registered queries of the engine over the driver's tables, each with its SQL.

The canonical mutation log comes from ``events``: the user is the key, the event number the sequence, an error a deletion.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import checksum, codecs, keys
from palimpsest.operators import bloom, compact, inspect, manifest, metrics, relations, replog, resolve, schema, write
from palimpsest.sources import typed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

LOG = """log AS (SELECT user_id AS k, event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS op,
    CASE WHEN event_type = 'error' THEN NULL ELSE value END AS v FROM events)"""
#: Files of a made-up manifest: runs of orders, several to a level.
FILES = """mf AS (SELECT file_number, CASE WHEN file_number < 6 THEN 0 ELSE file_number % 3 + 1 END AS level, n * 40000000 AS file_size, lo, hi
    FROM (SELECT o_orderkey // 1000 AS file_number, count(*) AS n, min(o_orderkey) - 1040 AS lo, max(o_orderkey) + 1040 AS hi FROM orders GROUP BY 1) x)"""
RLOG = """rl AS (SELECT conv_id AS log_id, turn AS idx, turn // 4 AS term, length(text) AS length, text FROM conversations)"""
OLDEST = 5000


def query(sql: str) -> Callable[[Query], Query]:
    """Registers a query under its function's name with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log_of(spark: SparkSession, d: str) -> DataFrame:
    error = F.col("event_type") == "error"
    return table(spark, d, "events").select(
        F.col("user_id").alias("k"), (F.col("event_id") + 1).alias("seq"),
        F.when(error, 2).otherwise(1).alias("op"), F.when(~error, F.col("value")).alias("v"),
    )


def files_of(spark: SparkSession, d: str) -> DataFrame:
    by = table(spark, d, "orders").groupBy(F.expr("o_orderkey div 1000").alias("file_number"))
    f = by.agg(F.count("*").alias("n"), (F.min("o_orderkey") - 1040).alias("lo"), (F.max("o_orderkey") + 1040).alias("hi"))
    level = F.when(F.col("file_number") < 6, 0).otherwise(F.col("file_number") % 3 + 1).cast("int")
    return f.select("file_number", level.alias("level"), (F.col("n") * 40000000).alias("file_size"), "lo", "hi")


def rlog_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("log_id"), F.col("turn").alias("idx"), F.expr("turn div 4").alias("term"), F.length("text").cast("long").alias("length"), "text"
    )


_NEWEST = "(SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM log{}) x WHERE rn = 1"


@query(f"WITH {LOG} SELECT k, seq, op, v FROM {_NEWEST.format('')} AND op = 1")
def kv_latest_state(spark, d):
    return resolve.as_of(log_of(spark, d))


@query(f"WITH {LOG} SELECT k, seq, op, v FROM {_NEWEST.format('')} AND op = 1")
def kv_latest_state_window(spark, d):
    return resolve.newest_by_window(log_of(spark, d)).filter("op = 1")


@query(f"WITH {LOG} SELECT k, seq, op, v FROM {_NEWEST.format(' WHERE k = 42')} AND op = 1")
def kv_get_point(spark, d):
    return resolve.get(log_of(spark, d), 42)


@query(f"WITH {LOG} SELECT k, seq, op, v FROM log WHERE k = -1")
def kv_get_missing(spark, d):
    return resolve.get(log_of(spark, d), -1)


@query(f"WITH {LOG} SELECT k, seq, op, v FROM {_NEWEST.format(' WHERE k = 42 AND seq <= 5000')} AND op = 1")
def kv_get_as_of(spark, d):
    return resolve.get(log_of(spark, d), 42, OLDEST)


@query(f"WITH {LOG} SELECT k, seq, op, v FROM {_NEWEST.format(' WHERE seq <= 5000')} AND op = 1")
def kv_snapshot_scan(spark, d):
    return resolve.scan_all(log_of(spark, d), OLDEST)


@query(f"WITH {LOG} SELECT k, seq, op, v FROM {_NEWEST.format(' WHERE k >= 20 AND k < 60')} AND op = 1")
def kv_scan_range(spark, d):
    return resolve.scan(log_of(spark, d), 20, 60)


@query(f"WITH {LOG} SELECT k, seq, op, v FROM {_NEWEST.format(' WHERE k >= 20 AND k < 60 AND seq <= 5000')} AND op = 1")
def kv_scan_range_as_of(spark, d):
    return resolve.scan(log_of(spark, d), 20, 60, OLDEST)


@query(f"WITH {LOG} SELECT k, seq, op, v FROM log WHERE k >= 20 AND k < 20")
def kv_scan_empty_range(spark, d):
    return resolve.scan(log_of(spark, d), 20, 20)


@query(f"WITH {LOG} SELECT k, seq, op, v FROM log")
def kv_all_versions(spark, d):
    return resolve.all_versions(log_of(spark, d))


@query(f"WITH {LOG} SELECT DISTINCT k FROM log")
def kv_distinct_keys(spark, d):
    return resolve.distinct_keys(log_of(spark, d))


@query(f"WITH {LOG} SELECT k FROM {_NEWEST.format('')} AND op = 1")
def kv_live_keys(spark, d):
    return resolve.as_of(log_of(spark, d)).select("k")


@query(f"WITH {LOG} SELECT k, seq FROM {_NEWEST.format('')} AND op = 2")
def kv_tombstoned_keys(spark, d):
    return resolve.tombstoned(log_of(spark, d))


@query(f"WITH {LOG} SELECT k, count(*) AS versions FROM log GROUP BY k")
def kv_retained_versions(spark, d):
    return resolve.retained_versions(log_of(spark, d))


@query(f"WITH {LOG} SELECT max(seq) AS last_seq FROM log")
def kv_high_water(spark, d):
    return resolve.high_water(log_of(spark, d))


@query(f"WITH {LOG} SELECT min(seq) AS oldest, max(seq) AS newest, count(*) AS active FROM log")
def kv_snapshot_registry(spark, d):
    return resolve.snapshot_registry(log_of(spark, d).select("seq"))


@query(f"WITH {LOG} SELECT k, seq, op, v FROM {_NEWEST.format(' WHERE seq <= 7000 AND k >= 30')} AND op = 1")
def kv_collapse(spark, d):
    return resolve.collapse(log_of(spark, d), 7000, start=30)


@query(f"WITH {LOG} SELECT k, seq, op, v FROM {_NEWEST.format('')} AND op = 1")
def kv_union_resolve(spark, d):
    log = log_of(spark, d)
    return resolve.as_of(resolve.union(log.filter("seq <= 6000"), log.filter("seq > 4000")))


@query(f"WITH {LOG}, b AS (SELECT * FROM log WHERE seq <= 6000 UNION ALL SELECT * FROM log WHERE seq > 4000) SELECT k, seq, op::INT AS op, count(*) AS copies, 1::BIGINT AS different_values FROM b GROUP BY 1, 2, 3 HAVING count(*) > 1")
def kv_merge_duplicates(spark, d):
    log = log_of(spark, d)
    return resolve.duplicate_versions(resolve.union(log.filter("seq <= 6000"), log.filter("seq > 4000")))


def _batches(spark, d):
    return log_of(spark, d).withColumns({"batch_id": F.expr("(seq - 1) div 100"), "ordinal": F.expr("(seq - 1) % 100")})


@query(f"WITH {LOG} SELECT batch_id, k, ordinal, seq, op, v FROM (SELECT (seq - 1) // 100 AS batch_id, (seq - 1) % 100 AS ordinal, *, row_number() OVER (PARTITION BY (seq - 1) // 100, k ORDER BY seq DESC) AS rn FROM log) x WHERE rn = 1")
def kv_batch_apply(spark, d):
    return write.last_per_batch(_batches(spark, d))


@query(f"WITH {LOG} SELECT (seq - 1) // 100 AS batch_id, (seq - 1) % 100 AS ordinal, k, seq + 1000 AS seq FROM log")
def kv_batch_sequences(spark, d):
    return write.assign_sequences(_batches(spark, d).drop("seq"), 1000).select("batch_id", "ordinal", "k", "seq")


@query("SELECT doc_id // 100 AS batch_id, count(*) AS operations, sum(octet_length(encode(cast(doc_id AS VARCHAR))) + coalesce(octet_length(encode(text)), 0) + 12)::BIGINT + 24 AS encoded_bytes, 'OK' AS status FROM documents GROUP BY 1")
def kv_batch_limits(spark, d):
    ops = table(spark, d, "documents").select(F.expr("doc_id div 100").alias("batch_id"), F.col("doc_id").cast("string").alias("k"), F.col("text").alias("v"))
    return write.batch_report(ops)


@query(f"WITH {LOG} SELECT (seq - 1) // 100 AS batch_id, count(*) AS operations, min(seq) AS first_seq, max(seq) AS last_seq, 'APPLIED' AS status FROM log GROUP BY 1")
def kv_batch_result(spark, d):
    return write.batch_result(_batches(spark, d), typed=True)


@query(f"WITH {LOG} SELECT k, seq, op, v FROM {_NEWEST.format('')} AND op = 1")
def kv_wal_replay(spark, d):
    log = log_of(spark, d)
    return resolve.as_of(write.replay(log.filter("seq <= 6000"), log.filter("seq > 3000"), 6000))


@query(f"WITH {LOG}, s AS (SELECT seq + seq // 97 AS seq, lag(seq + seq // 97) OVER (ORDER BY seq) AS p FROM log) SELECT p AS after_seq, seq AS next_seq FROM s WHERE seq <> p + 1")
def kv_sequence_gaps(spark, d):
    return write.sequence_gaps(log_of(spark, d).select(F.expr("seq + seq div 97").alias("seq")), 1000)


@query("SELECT event_id // 100 AS batch_id, count(*)::BIGINT AS operations, true AS contiguous, true AS size_ok FROM events GROUP BY 1")
def kv_sequence_plan(spark, d):
    b = _batches(spark, d).groupBy("batch_id").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    return write.plan_check(b)


_BOUNDARY = f"{LOG}, m AS (SELECT *, max(CASE WHEN seq <= 5000 THEN seq END) OVER (PARTITION BY k) AS b FROM log), r AS (SELECT *, seq > 5000 OR coalesce(seq = b AND op <> 2, false) AS kept FROM m)"


@query(f"WITH {_BOUNDARY} SELECT k, seq, op, v FROM r WHERE kept")
def gc_retain(spark, d):
    return compact.retain(log_of(spark, d), OLDEST)


@query(f"WITH {_BOUNDARY} SELECT count(*) FILTER (WHERE kept) AS kept, count(*) FILTER (WHERE seq < b AND seq <= 5000) AS dropped_versions, count(*) FILTER (WHERE seq = b AND op = 2) AS dropped_tombstones FROM r")
def gc_drop_counts(spark, d):
    return compact.drop_counts(log_of(spark, d), OLDEST)


@query(f"WITH {LOG} SELECT k, seq, op, min(v) AS v, coalesce(seq % 7 = 0 AND op = 1, false) AS conflict FROM log GROUP BY 1, 2, 3")
def gc_dedup(spark, d):
    log = log_of(spark, d)
    other = log.withColumn("v", F.when(F.col("seq") % 7 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return compact.dedup(log.union(other))


@query(f"WITH {FILES}, c AS (SELECT o_orderkey AS k FROM orders) SELECT k, NOT EXISTS (SELECT 1 FROM mf WHERE level > 1 AND k BETWEEN lo AND hi) AS base FROM c")
def gc_base_level(spark, d):
    return compact.base_level(table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), files_of(spark, d), 1)


@query(f"""WITH RECURSIVE {LOG}, e AS (SELECT k, seq, op, k // 10 AS part, CASE WHEN op = 1 THEN 48 ELSE 40 END AS n, row_number() OVER (PARTITION BY k // 10 ORDER BY k, seq DESC) AS i FROM log),
w AS (SELECT part, i, k, seq, op, n AS used, 0 AS file FROM e WHERE i = 1 UNION ALL SELECT e.part, e.i, e.k, e.seq, e.op,
    CASE WHEN w.used + e.n > 4096 AND e.k <> w.k THEN e.n ELSE w.used + e.n END, CASE WHEN w.used + e.n > 4096 AND e.k <> w.k THEN w.file + 1 ELSE w.file END FROM w JOIN e ON e.part = w.part AND e.i = w.i + 1)
SELECT part, file, count(*) AS entries, min(k) AS lo, max(k) AS hi FROM w GROUP BY 1, 2""")
def gc_output_files(spark, d):
    cut = compact.cut_outputs(log_of(spark, d), 4096, F.when(F.col("op") == 1, 16).otherwise(8), F.expr("k div 10"))
    return cut.groupBy("part", "file").agg(F.count("*").alias("entries"), F.min("k").alias("lo"), F.max("k").alias("hi"))


@query(f"WITH {FILES} SELECT a.level, a.file_number, b.file_number AS other_file FROM mf a JOIN mf b ON a.level = b.level AND a.file_number < b.file_number AND a.lo <= b.hi AND b.lo <= a.hi")
def lvl_overlap(spark, d):
    return compact.overlap_pairs(files_of(spark, d))


_LEVELS = f"""{FILES}, g AS (SELECT l.level, count(mf.level) AS files, coalesce(sum(file_size), 0)::BIGINT AS bytes FROM (SELECT unnest(range(0, 7))::INT AS level) l LEFT JOIN mf ON mf.level = l.level GROUP BY 1),
t AS (SELECT *, CASE WHEN level > 0 THEN 536870912 * 10 ** (level - 1) END AS target FROM g),
sc AS (SELECT level, files, bytes, CASE WHEN level = 0 THEN files / 4.0 ELSE bytes / target END AS score FROM t WHERE level <= 5)"""


@query(f"WITH {_LEVELS} SELECT level, files, bytes, score::DOUBLE AS score FROM sc")
def lvl_scores(spark, d):
    return compact.scores(files_of(spark, d))


@query(f"WITH {_LEVELS} SELECT sum(greatest(0, bytes - target))::BIGINT AS debt_bytes FROM t WHERE level BETWEEN 1 AND 5")
def lvl_debt_engine(spark, d):
    return compact.debt(files_of(spark, d), with_level_0=False)


@query(f"WITH {_LEVELS} SELECT sum(CASE WHEN level = 0 THEN greatest(0, files - 4) * (bytes // greatest(files, 1)) ELSE greatest(0, bytes - target) END)::BIGINT AS debt_bytes FROM t WHERE level <= 5")
def lvl_debt_library(spark, d):
    return compact.debt(files_of(spark, d), with_level_0=True)


@query(f"WITH {_LEVELS} SELECT level, score::DOUBLE AS score, 'SCORE' AS reason FROM sc WHERE score >= 1 ORDER BY score DESC, level LIMIT 1")
def lvl_pick(spark, d):
    return compact.pick_level(files_of(spark, d))


@query(f"WITH {_LEVELS} SELECT level FROM t WHERE (level = 0 AND files >= 4) OR (level BETWEEN 1 AND 5 AND bytes > target) ORDER BY level LIMIT 1")
def lvl_trigger(spark, d):
    return compact.trigger(files_of(spark, d))


@query(f"WITH {FILES}, p AS (SELECT *, lag(hi) OVER (PARTITION BY level ORDER BY lo, file_number) AS before_hi FROM mf WHERE level >= 1) SELECT level, file_number, lo, before_hi FROM p WHERE before_hi >= lo")
def lvl_invariant(spark, d):
    return compact.invariant_violations(files_of(spark, d))


@query(f"WITH {FILES} SELECT file_number, level, file_size, lo, hi FROM mf WHERE file_number % 4 <> 0")
def mf_live_files(spark, d):
    f = files_of(spark, d)
    adds = f.withColumns({"edit_number": F.lit(1), "action": F.lit("ADD")})
    gone = f.filter("file_number % 4 = 0").withColumns({"edit_number": F.lit(2), "action": F.lit("DELETE")})
    return manifest.live_files(adds.unionByName(gone))


@query(f"WITH {FILES} SELECT file_number, file_size, CASE WHEN file_number % 5 = 0 THEN 'MISSING' WHEN file_number % 5 = 1 THEN 'SIZE_MISMATCH' ELSE 'OK' END AS status FROM mf")
def mf_verify_inventory(spark, d):
    f = files_of(spark, d)
    have = f.filter("file_number % 5 <> 0").select("file_number", F.expr("file_size + int(file_number % 5 = 1)").alias("size"))
    return manifest.verify_inventory(f, have)


@query(f"WITH {LOG}, l AS (SELECT k, seq, v FROM {_NEWEST.format(' WHERE seq <= 5000')} AND op = 1) SELECT k, seq, v, c_name, c_mktsegment FROM l JOIN customer ON c_custkey = k")
def typed_multi_collection_as_of(spark, d):
    live = resolve.consistent({"events": log_of(spark, d)}, OLDEST)["events"]
    customer = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return live.join(customer, live["k"] == customer["c_custkey"]).select("k", "seq", "v", "c_name", "c_mktsegment")


_FIELDS = "field_id int, name string, type string, byte_bound int, optional boolean, max_entries int, detail string"
_OLD = [(16, "name", "string", 100, False, 10, None), (17, "age", "int", 0, True, 10, None), (18, "tags", "set", 50, True, 10, None), (19, "state", "enum", 0, False, 10, "A"), (20, "note", "string", 50, True, 10, None), (21, "gone", "long", 0, True, 10, None)]
_NEW = [(16, "title", "string", 90, False, 10, None), (17, "age", "long", 0, True, 10, None), (18, "tags", "set", 50, True, 5, None), (19, "state", "enum", 0, False, 10, "B"), (20, "note", "string", 50, False, 10, None), (22, "more", "int", 0, False, 10, None), (23, "extra", "int", 0, True, 10, None)]


@query("SELECT * FROM (VALUES (16, 'BOUND_TIGHTENED'), (17, 'TYPE_CHANGED'), (18, 'ENTRIES_TIGHTENED'), (19, 'IDENTITY_CHANGED'), (20, 'BECAME_REQUIRED'), (21, 'REMOVED'), (22, 'NEW_REQUIRED')) t(field_id, problem)")
def sch_compat_report(spark, d):
    return schema.compatibility(spark.createDataFrame(_OLD, _FIELDS), spark.createDataFrame(_NEW, _FIELDS))


@query("SELECT c_custkey AS id, c_name AS display_name, NULL::TIMESTAMP AS updated_at FROM customer")
def sch_evolve_read(spark, d):
    from pyspark.sql import types as T

    stored = T.StructType([schema.field(16, "c_custkey", T.LongType()), schema.field(17, "c_name", T.StringType())])
    wanted = T.StructType([schema.field(16, "id", T.LongType()), schema.field(17, "display_name", T.StringType()), schema.field(18, "updated_at", T.TimestampNTZType(), optional=True)])
    return schema.read_as(table(spark, d, "customer"), stored, wanted)


@query("SELECT l_returnflag AS collection, max(l_linenumber) AS minimum_writer_version FROM lineitem GROUP BY 1")
def sch_minimum_writer(spark, d):
    return schema.minimum_writer(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("collection"), F.col("l_linenumber").alias("schema_version")))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey = 42")
def rel_filter_sort(spark, d):
    return relations.where_sorted(table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_custkey"), "o_custkey", 42, "o_orderdate").drop("o_custkey")


@query("SELECT o_orderkey, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def rel_lookup_join(spark, d):
    return relations.lookup(table(spark, d, "orders"), "o_custkey", table(spark, d, "customer"), "c_custkey").select("o_orderkey", "c_custkey", "c_name")


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def rel_semi_feed(spark, d):
    followed = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    return relations.feed(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_custkey", followed, "c_custkey", "o_orderdate")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority <> '1-URGENT')")
def rel_orphans(spark, d):
    parents = table(spark, d, "orders").filter("o_orderpriority <> '1-URGENT'").select("o_orderkey")
    return relations.dangling(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", parents, "o_orderkey")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def rel_duplicates(spark, d):
    return relations.duplicates(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def rel_delete_guard(spark, d):
    return relations.deletable(table(spark, d, "customer").select("c_custkey"), "c_custkey", (table(spark, d, "orders").filter("o_orderstatus = 'F'"), "o_custkey"))


@query("SELECT c_custkey, (c_custkey % 12) AS stored, coalesce(n, 0) AS actual FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey WHERE c_custkey % 12 <> coalesce(n, 0)")
def rel_counter_check(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 12).alias("stored"))
    return relations.counter_mismatches(rows, "c_custkey", "stored", table(spark, d, "orders"), "o_custkey")


@query("SELECT o_orderkey, o_custkey || '/' || o_orderkey AS key FROM orders")
def rel_composite_key(spark, d):
    return table(spark, d, "orders").select("o_orderkey", keys.composite_key(F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")).alias("key"))


_HASHED = """CASE WHEN {0} IS NULL THEN 'ffffffff' ELSE lpad(printf('%x', octet_length(encode({0}))), 8, '0') || lower(hex(encode({0}))) END"""
_FIELDS_HASHED = " || ".join(_HASHED.format(x) for x in ("cast(r.idx AS VARCHAR)", "cast(r.term AS VARCHAR)", "r.text"))
#: The conversations as replicated logs from index 1, each chained from the hash of zeros.
CHAIN = f"""r AS (SELECT conv_id AS log_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS idx, turn // 4 AS term, text FROM conversations),
ch AS (SELECT r.log_id, r.idx, r.term, repeat('0', 64) AS previous_hash, sha256(repeat('0', 64) || {_FIELDS_HASHED}) AS entry_hash FROM r WHERE r.idx = 1
    UNION ALL SELECT r.log_id, r.idx, r.term, ch.entry_hash, sha256(ch.entry_hash || {_FIELDS_HASHED}) FROM ch JOIN r ON r.log_id = ch.log_id AND r.idx = ch.idx + 1)"""


def chain_of(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    c = table(spark, d, "conversations")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long")
    rows = c.select(F.col("conv_id").alias("log_id"), place.alias("idx"), F.expr("turn div 4").alias("term"), "text")
    return replog.append_chain(rows, "idx", "term", "text")


_ENTRIES = f"""{CHAIN}, en AS (SELECT log_id, idx + idx // 6 AS idx, term, idx AS seq_start, CASE WHEN idx % 7 = 3 THEN idx + 1 ELSE idx END AS seq_after, CASE WHEN (log_id + idx) % 11 = 0 THEN 'x' ELSE previous_hash END AS previous_hash, entry_hash FROM ch WHERE log_id % 5 <> 0 OR idx > 1),
p AS (SELECT *, coalesce(lag(idx) OVER w, 0) AS pi, coalesce(lag(term) OVER w, 0) AS pt, coalesce(lag(seq_after) OVER w, 0) AS pa, coalesce(lag(entry_hash) OVER w, repeat('0', 64)) AS ph FROM en WINDOW w AS (PARTITION BY log_id ORDER BY idx))"""


@query(f"WITH RECURSIVE {_ENTRIES} SELECT log_id, idx, CASE WHEN idx <> pi + 1 THEN 'INDEX' WHEN term < pt THEN 'TERM' WHEN previous_hash <> ph THEN 'HASH' ELSE 'SEQUENCE' END AS problem FROM p WHERE idx <> pi + 1 OR term < pt OR previous_hash <> ph OR seq_start <> pa + 1")
def rlog_continuity(spark, d):
    broken = F.when((F.col("log_id") + F.col("idx")) % 11 == 0, "x").otherwise(F.col("previous_hash"))
    e = chain_of(spark, d).filter("log_id % 5 <> 0 OR idx > 1").withColumns({
        "type": F.lit("COMMAND"), "seq_start": F.col("idx"), "seq_after": F.when(F.col("idx") % 7 == 3, F.col("idx") + 1).otherwise(F.col("idx")), "previous_hash": broken,
    })
    return replog.violations(e.withColumn("idx", F.expr("idx + idx div 6")))


@query(f"WITH {RLOG}, b AS (SELECT *, row_number() OVER w AS n, sum(length) OVER w AS s FROM rl WHERE idx >= 1 AND idx < 9 WINDOW w AS (PARTITION BY log_id ORDER BY idx)) SELECT log_id, idx, length FROM b WHERE n <= 4 AND (n = 1 OR s <= 600)")
def rlog_bounded_read(spark, d):
    return replog.bounded_read(rlog_of(spark, d), 1, 9, 4, 600).select("log_id", "idx", "length")


@query(f"WITH {RLOG} SELECT log_id, idx, term FROM rl WHERE idx < 3")
def rlog_truncate(spark, d):
    return replog.truncate_suffix(rlog_of(spark, d), 3, 1, 0).select("log_id", "idx", "term")


@query(f"WITH RECURSIVE {CHAIN} SELECT log_id, idx, previous_hash, entry_hash FROM ch")
def rlog_hash_chain(spark, d):
    return chain_of(spark, d).select("log_id", "idx", "previous_hash", "entry_hash")


@query(f"WITH {RLOG} SELECT log_id, idx FROM (SELECT conv_id AS log_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS idx, text FROM conversations) x WHERE idx % 3 = 0")
def rlog_broken_chain(spark, d):
    forged = chain_of(spark, d).withColumn("term", F.when(F.col("idx") % 3 == 0, F.col("term") + 1).otherwise(F.col("term")))
    return replog.broken_chain(forged, "idx", "term", "text")


@query(f"WITH {RLOG} SELECT log_id, max(idx) AS applied_index, max_by(term, idx) AS applied_term, max_by(length, idx) AS state_sequence, max_by(log_id, idx) AS configuration FROM rl GROUP BY 1")
def rlog_applied_state(spark, d):
    return replog.applied_state(rlog_of(spark, d).select("log_id", F.col("idx").alias("applied_index"), F.col("term").alias("applied_term"), F.col("length").alias("state_sequence"), F.col("log_id").alias("configuration")))


@query(f"WITH {RLOG} SELECT log_id, idx FROM rl WHERE idx <= 5 AND idx > log_id % 4")
def rlog_unapplied(spark, d):
    r = rlog_of(spark, d)
    logs = r.select("log_id").distinct()
    applied, commit = logs.withColumn("applied_index", F.col("log_id") % 4), logs.withColumn("commit_index", F.lit(5))
    return replog.unapplied(r, applied, commit).select("log_id", "idx")


_VOTES = "v AS (SELECT user_id // 5 AS log_id, user_id AS voter, max(event_id) AS match FROM events GROUP BY 1, 2), q AS (SELECT log_id, match, row_number() OVER (PARTITION BY log_id ORDER BY match DESC) AS rn, count(*) OVER (PARTITION BY log_id) AS n FROM v), k AS (SELECT log_id, match AS quorum_index FROM q WHERE rn = n // 2 + 1)"


@query(f"WITH {_VOTES} SELECT log_id, quorum_index, CASE WHEN quorum_index % 3 = 1 AND quorum_index > 100 THEN quorum_index ELSE 100 END AS commit_index FROM k")
def quo_commit_index(spark, d):
    e = table(spark, d, "events")
    votes = e.groupBy(F.expr("user_id div 5").alias("log_id"), F.col("user_id").alias("voter")).agg(F.max("event_id").alias("match"))
    log = e.select(F.expr("user_id div 5").alias("log_id"), F.col("event_id").alias("idx"), (F.col("event_id") % 3).alias("term"))
    return replog.commit_index(votes, log, 1, 100)


def _voters(spark, d):
    e = table(spark, d, "events")
    v = e.groupBy(F.expr("user_id div 6").alias("log_id"), F.col("user_id").alias("voter")).agg(F.max("event_id").alias("idx"))
    sides = v.select("log_id", "voter", F.when(F.col("voter") % 2 == 0, "OLD").otherwise("NEW").alias("config"))
    return sides, v.filter("voter % 6 <> 5").select("log_id", "voter", "idx")


_SIDES = """v AS (SELECT user_id // 6 AS log_id, user_id AS voter, CASE WHEN user_id % 2 = 0 THEN 'OLD' ELSE 'NEW' END AS config, CASE WHEN user_id % 6 = 5 THEN 0 ELSE m END AS idx, user_id % 6 <> 5 AS heard FROM (SELECT user_id, max(event_id) AS m FROM events GROUP BY 1) e)"""


@query(f"WITH {_SIDES}, q AS (SELECT *, row_number() OVER (PARTITION BY log_id, config ORDER BY idx DESC) AS rn, count(*) OVER (PARTITION BY log_id, config) AS n FROM v) SELECT log_id, min(idx) AS commit_index, count(*) AS configurations FROM q WHERE rn = n // 2 + 1 GROUP BY 1")
def quo_joint_commit(spark, d):
    return replog.joint_commit(*_voters(spark, d))


@query(f"WITH {_SIDES}, q AS (SELECT log_id, config, count(*) FILTER (WHERE heard) >= count(*) // 2 + 1 AS ok FROM v GROUP BY 1, 2) SELECT log_id, bool_and(ok) AS accepted FROM q GROUP BY 1")
def quo_dual_majority(spark, d):
    return replog.dual_majority(*_voters(spark, d))


@query(f"WITH {RLOG} SELECT log_id, idx, CASE WHEN term <> 1 THEN CASE WHEN term > 1 THEN 'UP_TO_DATE' ELSE 'STALE' END WHEN idx <> 5 THEN CASE WHEN idx > 5 THEN 'UP_TO_DATE' ELSE 'STALE' END WHEN log_id % 2 = 0 THEN 'UP_TO_DATE' ELSE 'DIVERGED' END AS decision FROM rl")
def quo_freshness(spark, d):
    r = rlog_of(spark, d)
    decision = replog.freshness(F.col("term"), F.col("idx"), F.col("log_id") % 2, F.lit(1), F.lit(5), F.lit(0).cast("long"))
    return r.select("log_id", "idx", decision.alias("decision"))


@query("SELECT user_id AS follower, event_id AS at, event_id * 7919 % 10007 AS match, max(event_id * 7919 % 10007) OVER (PARTITION BY user_id ORDER BY event_id) AS match_index FROM events")
def quo_follower_match(spark, d):
    return replog.follower_match(table(spark, d, "events").select(F.col("user_id").alias("follower"), F.col("event_id").alias("at"), (F.col("event_id") * 7919 % 10007).alias("match")))


def _samples(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("op"), F.col("value").alias("latency"), (F.col("event_type") == "error").alias("failed"), F.col("event_id").alias("ordinal"))


#: Event types of the sample tables.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def _summary(last: int) -> str:
    q = ", ".join(f"quantile_disc(value, {p}) FILTER (WHERE rn <= {last}) AS p{n}" for p, n in ((0.5, 50), (0.95, 95), (0.99, 99)))
    source = "(SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS rn FROM events) x"
    out = f"SELECT event_type AS op, count(*) AS count, count(*) FILTER (WHERE event_type = 'error') AS errors, round(avg(value), 6) AS mean, min(value) AS least, {q}, max(value) AS most, count(*)::DOUBLE AS per_second FROM {source} GROUP BY 1"
    return f"{out} UNION ALL SELECT 'SNAPSHOT', 0, 0, 0, 0, 0, 0, 0, 0, 0"


@query(_summary(metrics.RECENT))
def met_operation_summary(spark, d):
    return metrics.summary(_samples(spark, d), (*EVENT_TYPES, "SNAPSHOT")).withColumn("mean", F.round("mean", 6))


@query(_summary(500))
def met_recent_percentiles(spark, d):
    return metrics.summary(_samples(spark, d), (*EVENT_TYPES, "SNAPSHOT"), last=500, part=1000).withColumn("mean", F.round("mean", 6))


@query("SELECT event_type AS op, event_id AS ordinal FROM events WHERE event_id >= 1000 AND event_id < 1500")
def met_interval(spark, d):
    return metrics.interval(_samples(spark, d), 1000, 1500).select("op", "ordinal")


_G = 1 << 30


@query(f"""WITH i AS (SELECT event_id AS id, (event_id % 5)::INT AS m, event_id * 7 % 2600 * 1048576 AS wal, (event_id * 3 % 22)::INT AS l0, event_id * 11 % 9000 * 1048576 AS debt, (event_id % 40) * {_G} AS usable, 100 * {_G} AS total, event_id % 50 = 7 AS failed, event_id % 60 = 9 AS paused, event_id % 70 <> 3 AS native, event_id % 6 <> 1 AS dok FROM events),
s AS (SELECT *, failed OR false AS f, NOT native OR paused OR m >= 4 OR wal >= {2 * _G} OR l0 >= 20 OR debt >= {8 * _G} OR (dok AND usable < {5 * _G}) AS st,
 concat_ws(',', CASE WHEN m >= 2 THEN 'IMMUTABLE_MEMTABLES' END, CASE WHEN NOT native THEN 'NATIVE_CAPACITY' END, CASE WHEN wal >= {_G // 2} THEN 'WAL_BYTES' END, CASE WHEN l0 >= 12 THEN 'LEVEL_ZERO_FILES' END, CASE WHEN debt >= {2 * _G} THEN 'COMPACTION_DEBT' END, CASE WHEN dok AND usable < {15 * _G} THEN 'DISK_SPACE' END, CASE WHEN failed THEN 'BACKGROUND_FAILURE' END, CASE WHEN paused THEN 'ADMINISTRATIVE_PAUSE' END) AS reasons,
 greatest(0, least(1, (m - 2) / 2.0::DOUBLE), least(1, (wal - {_G // 2})::DOUBLE / {2 * _G - _G // 2}), least(1, (l0 - 12) / 8.0::DOUBLE), least(1, (debt - {2 * _G})::DOUBLE / {6 * _G}), CASE WHEN dok THEN 1 - greatest(0, least(1, (usable - {5 * _G})::DOUBLE / {10 * _G})) ELSE 0 END) AS sev FROM i)
SELECT id, CASE WHEN f THEN 'FAILED' WHEN st THEN 'STOPPED_RETRYABLE' WHEN reasons = '' THEN 'NORMAL' ELSE 'SLOWDOWN' END AS state, reasons,
 CASE WHEN NOT f AND NOT st AND reasons <> '' THEN least(10000, floor(100 + sev * sev * 9900 + 0.5))::BIGINT ELSE 0 END AS delay_micros FROM s""")
def pol_write_pressure(spark, d):
    m = F.expr
    grid = table(spark, d, "events").select(
        m("event_id AS id"), m("int(event_id % 5) AS immutable_memtables"), m("event_id * 7 % 2600 * 1048576 AS wal_bytes"), m("int(event_id * 3 % 22) AS l0_files"),
        m("event_id * 11 % 9000 * 1048576 AS debt_bytes"), m(f"(event_id % 40) * {_G} AS usable_disk"), m(f"100L * {_G} AS total_disk"), m("event_id % 6 <> 1 AS disk_ok"),
        m("event_id % 50 = 7 AS failed"), m("event_id % 60 = 9 AS paused"), m("event_id % 70 <> 3 AS native_ok"),
    )
    return write.write_pressure(grid).select("id", "state", "reasons", "delay_micros")


@query(f"WITH {FILES} SELECT level, count(*) AS files, sum(file_size)::BIGINT AS bytes, min(file_number) AS oldest_file, max(file_number) AS newest_file FROM mf GROUP BY 1")
def insp_level_report(spark, d):
    return inspect.level_report(files_of(spark, d))


@query(f"WITH {LOG}, b AS (SELECT * FROM log UNION ALL SELECT * FROM log) SELECT k, seq, op::INT AS op, count(*) AS copies, 1::BIGINT AS different_values FROM b GROUP BY 1, 2, 3 HAVING count(*) > 1")
def insp_verify_duplicates(spark, d):
    log = log_of(spark, d)
    return resolve.duplicate_versions(log.union(log))


@query(f"WITH {LOG} SELECT k, seq, op, v, seq % 3 = 0 AND op = 1 AS conflict FROM {_NEWEST.format('')}")
def insp_salvage_latest(spark, d):
    log = log_of(spark, d)
    return inspect.salvage(log.union(log.withColumn("v", F.when(F.col("seq") % 3 == 0, F.col("v") + 1).otherwise(F.col("v")))))


@query(f"WITH {LOG} SELECT k, seq, op, v, false AS conflict FROM log")
def insp_salvage_history(spark, d):
    log = log_of(spark, d)
    return inspect.salvage(log.union(log), history=True)


@query(f"WITH {FILES} SELECT file_number, lo FROM mf WHERE level = 2")
def mf_files_of_level(spark, d):
    return manifest.files_of_level(files_of(spark, d), 2).select("file_number", "lo")


@query("SELECT event_id // 10 * 10 + 9 AS before, event_id // 10 * 10 + 11 AS edit_number FROM events WHERE event_id % 10 = 0 AND event_id > 0 AND event_id // 10 * 10 + 11 <= (SELECT max(event_id) FROM events) AND event_id % 1000 = 0")
def mf_edit_gaps(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("edit_number")).filter("edit_number % 1000 <> 10 OR edit_number < 1000")
    return manifest.edit_gaps(e).select("before", "edit_number")


@query("SELECT o_orderkey AS edit_number FROM orders WHERE o_orderkey < (SELECT min(o_orderkey) FROM orders WHERE o_orderkey % 97 = 96)")
def mf_recoverable(spark, d):
    e = table(spark, d, "orders").select(F.col("o_orderkey").alias("edit_number"), (F.col("o_orderkey") % 97 != 96).alias("valid"))
    return manifest.recoverable(e).select("edit_number")


@query(f"WITH {RLOG} SELECT log_id, idx FROM rl a WHERE NOT EXISTS (SELECT 1 FROM rl b WHERE b.log_id = a.log_id AND b.idx <= a.idx AND length(b.text) % 5 = 0)")
def insp_valid_prefix(spark, d):
    r = rlog_of(spark, d).withColumn("valid", F.length("text") % 5 != 0)
    return inspect.valid_prefix(r, "idx", "log_id").select("log_id", "idx")


@query("SELECT page_id, CASE WHEN contains(url, '/') THEN regexp_extract(url, '^(.*)/[^/]*$', 1, 's') ELSE '(root)' END AS key_group, regexp_extract(url, '([^/]*)$', 1, 's') AS key_field FROM pages")
def disp_group_field(spark, d):
    return table(spark, d, "pages").select("page_id", keys.key_group(F.col("url")).alias("key_group"), keys.key_field(F.col("url")).alias("key_field"))


@query("SELECT c_custkey, lower(lpad(printf('%X', c_custkey), 16, '0')) AS low, c_name AS shown FROM customer")
def disp_keys(spark, d):
    c = table(spark, d, "customer")
    body = F.substring(F.lower(F.hex(keys.long_key(F.col("c_custkey")))), 2, 15)
    return c.select("c_custkey", F.concat(F.lit("0"), body).alias("low"), keys.display_key(keys.string_key(F.col("c_name"))).alias("shown"))


_BY_ID = "SELECT c_custkey::VARCHAR AS id, c_nationkey::VARCHAR AS key_codec, c_mktsegment AS schema_id, c_name AS fingerprint, (c_custkey % 3)::INT AS schema_version FROM customer"


@query(f"""WITH o AS ({_BY_ID}), n AS (SELECT id, CASE WHEN id::INT % 11 = 0 THEN 'other' ELSE key_codec END AS key_codec, schema_id, CASE WHEN id::INT % 7 = 0 THEN 'new' ELSE fingerprint END AS fingerprint, 1 AS schema_version FROM o)
SELECT n.id AS collection_id, CASE WHEN o.id::INT % 13 = 0 THEN 'CREATED' WHEN n.key_codec <> o.key_codec OR n.schema_version < o.schema_version THEN 'CONFLICT'
 WHEN n.schema_version > o.schema_version THEN CASE WHEN n.id::INT % 5 = 0 THEN 'CONFLICT' ELSE 'UPGRADE' END WHEN n.fingerprint <> o.fingerprint THEN 'CONFLICT' ELSE 'UNCHANGED' END AS status FROM n JOIN o ON n.id = o.id""")
def sch_register(spark, d):
    m = F.expr
    old = table(spark, d, "customer").select(
        m("string(c_custkey) AS collection_id"), m("string(c_nationkey) AS key_codec"), m("c_mktsegment AS schema_id"), m("c_name AS fingerprint"), m("int(c_custkey % 3) AS schema_version")
    )
    request = old.withColumns({"key_codec": m("IF(int(collection_id) % 11 = 0, 'other', key_codec)"), "fingerprint": m("IF(int(collection_id) % 7 = 0, 'new', fingerprint)"), "schema_version": F.lit(1)})
    bad = old.filter("int(collection_id) % 5 = 0").select("collection_id")
    return schema.register(old.filter("int(collection_id) % 13 <> 0"), request, bad).select("collection_id", "status")


@query("SELECT conv_id AS config, turn AS member_id, CASE WHEN turn % 5 = 0 THEN 'DUPLICATE' ELSE 'ENDPOINTS' END AS problem FROM conversations, range(2) r(i) WHERE turn % 5 = 0 OR (turn % 5 = 2 AND i = 0)")
def rlog_member_problems(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("config"), F.col("turn").alias("member_id"))
    m = c.withColumn("endpoints", F.expr("IF(member_id % 5 = 2, array_repeat('h', 9), array('h'))"))
    return replog.member_problems(m.union(m.filter("member_id % 5 = 0")))


@query(f"WITH {RLOG} SELECT log_id, term FROM rl WHERE idx = 2")
def rlog_entry_at(spark, d):
    return replog.entry_at(rlog_of(spark, d), 2).select("log_id", "term")


@query("SELECT doc_id, replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't') AS shown, true AS back FROM documents")
def disp_escape(spark, d):
    t = table(spark, d, "documents").select("doc_id", "text", keys.escape(F.col("text")).alias("shown"))
    return t.select("doc_id", "shown", keys.unescape(F.col("shown")).eqNullSafe(F.col("text")).alias("back"))


def people(spark: SparkSession, d: str) -> tuple[typed.Collection, DataFrame]:
    """Customers as a typed collection: all are written once, every second again with another name, and each fifth is deleted last."""
    from pyspark.sql import types as T

    c = typed.Collection("customers", T.StructType([schema.field(16, "name", T.StringType()), schema.field(17, "segment", T.StringType(), optional=True)]), encode=keys.long_key, decode=keys.long_from_key)
    base = table(spark, d, "customer").selectExpr("c_custkey AS key", "c_name AS name", "IF(c_custkey % 3 = 0, NULL, c_mktsegment) AS segment")
    parts = [("true", 0, "name", 1), ("key % 2 = 0", 1_000_000_000, "concat(name, '+')", 1), ("key % 5 = 0", 2_000_000_000, "name", 2)]
    rows = [base.filter(keep).selectExpr("key", f"{name} AS name", "segment", f"{op} AS op", f"key + {after}L AS seq") for keep, after, name, op in parts]
    return c, c.to_log(resolve.union(*rows))


_PEOPLE = """p AS (SELECT c_custkey AS key, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer),
pl AS (SELECT key, name, segment, 1 AS op, key AS seq FROM p UNION ALL SELECT key, name || '+', segment, 1, key + 1000000000 FROM p WHERE key % 2 = 0 UNION ALL SELECT key, name, segment, 2, key + 2000000000 FROM p WHERE key % 5 = 0),
pn AS (SELECT * FROM pl {} QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)"""


@query(f"WITH {_PEOPLE.format('')} SELECT key, seq, name, segment FROM pn WHERE op = 1 AND key = 42")
def typed_get(spark, d):
    c, log = people(spark, d)
    return c.get(log, 42)


@query(f"WITH {_PEOPLE.format('')} SELECT key, seq, name, segment FROM pn WHERE op = 1")
def typed_scan_all(spark, d):
    c, log = people(spark, d)
    return c.scan_all(log)


@query(f"WITH {_PEOPLE.format('WHERE seq <= 1999999999')} SELECT key, seq, name, segment FROM pn WHERE op = 1")
def typed_as_of(spark, d):
    c, log = people(spark, d)
    return typed.snapshot([c], log, 1_999_999_999)["customers"]


@query(f"WITH {_PEOPLE.format('')} SELECT key, seq, name AS title, NULL::VARCHAR AS note FROM pn WHERE op = 1")
def typed_newer_schema(spark, d):
    from pyspark.sql import types as T

    c, log = people(spark, d)
    return c.scan_all(log, fields=T.StructType([schema.field(16, "title", T.StringType()), schema.field(18, "note", T.StringType(), optional=True)]))


@query("""WITH RECURSIVE x AS (SELECT c_custkey, c_name FROM customer), b AS (SELECT c_custkey, c_name, 0 AS i, 4294967295::BIGINT AS c FROM x
UNION ALL SELECT c_custkey, c_name, i + 1, xor(c >> 8, list_reduce(list_prepend((xor(c, unicode(substr(c_name, i + 1, 1))) & 255)::BIGINT, range(8)), lambda a, n: xor(a >> 1, (a & 1) * 2197175160)))
 FROM b WHERE i < length(c_name)),
r AS (SELECT c_custkey, xor(c, 4294967295::BIGINT) AS crc FROM b WHERE i = length(c_name))
SELECT c_custkey, crc, (((crc >> 15) | ((crc & 32767) * 131072)) + 2726488792) % 4294967296 AS stored, crc AS back FROM r""")
def fmt_masked_crc32c(spark, d):
    crc = table(spark, d, "customer").select("c_custkey", checksum.crc32c(keys.string_key(F.col("c_name"))).alias("crc"))
    return crc.withColumn("stored", checksum.mask(F.col("crc"))).withColumn("back", checksum.unmask(F.col("stored")))


@query("SELECT o_custkey % 4 AS file, count(*) AS members, count(*) AS found, true AS few_false FROM orders GROUP BY 1")
def fmt_bloom_filter(spark, d):
    held = table(spark, d, "orders").selectExpr("o_custkey % 4 AS file", "o_orderkey AS k")
    bits = bloom.sizes(held)
    asked = held.withColumn("member", F.lit(True)).union(held.selectExpr("file", "-1 - k AS k", "false AS member"))
    got = bloom.may_contain(asked.select("file", "k"), bloom.build(held, bits), bits).withColumn("member", F.col("k") >= 0)
    hit = lambda c: F.sum((c & F.col("maybe")).cast("long"))
    out = got.groupBy("file").agg(F.sum(F.col("member").cast("long")).alias("members"), hit(F.col("member")).alias("found"), hit(~F.col("member")).alias("wrong"))
    return out.select("file", "members", "found", (F.col("wrong") * 20 < F.col("members")).alias("few_false"))


@query("SELECT c_custkey FROM customer WHERE c_custkey % 9 = 0 AND c_custkey <> 0")
def codec_round_trip(spark, d):
    """Of codecs that give back what they took no row shows; of one that does not, the rows that it changes."""
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    lossy = codecs.Codec("lossy", 1, codecs.LONG.encode, lambda raw: F.when(keys.long_from_key(raw) % 9 == 0, 0).otherwise(keys.long_from_key(raw)))
    fine = codecs.round_trip_failures(c, "c_custkey", codecs.LONG).union(codecs.round_trip_failures(c, "c_name", codecs.STRING))
    return codecs.round_trip_failures(c, "c_custkey", lossy).union(fine).select("c_custkey")


@query(f"""WITH {LOG}, f AS (SELECT k // 2 AS file FROM log GROUP BY 1)
SELECT file, CASE file % 7 WHEN 0 THEN 'ENTRIES' WHEN 1 THEN 'BYTES' WHEN 2 THEN 'SEQUENCES' WHEN 3 THEN 'KEYS' WHEN 4 THEN 'ORDER' WHEN 5 THEN 'UNREFERENCED' ELSE 'MISSING' END AS problem FROM f""")
def insp_verify_tables(spark, d):
    from pyspark.sql import Window

    e = log_of(spark, d).selectExpr("k div 2 AS file", "k", "seq", "octet_length(string(k)) AS size")
    place = F.row_number().over(Window.partitionBy("file").orderBy("k", F.desc("seq")))
    e = e.withColumn("position", F.when(F.col("file") % 7 == 4, -place).otherwise(place))
    m = e.groupBy("file").agg(F.count("*").alias("entries"), F.sum("size").alias("bytes"), F.min("seq").alias("smallest_seq"), F.max("seq").alias("largest_seq"), F.min("k").alias("lo"), F.max("k").alias("hi"))
    off = {"entries": 0, "bytes": 1, "largest_seq": 2, "hi": 3}
    m = m.withColumns({c: F.col(c) + (F.col("file") % 7 == n).cast("int") for c, n in off.items()})
    return inspect.verify_tables(e.filter("file % 7 <> 6"), m.filter("file % 7 <> 5"))


@query(f"""WITH {RLOG}, b AS (SELECT log_id, min(CASE WHEN length(text) % 5 = 0 THEN idx END) AS first_bad FROM rl GROUP BY 1),
n AS (SELECT rl.log_id, b.first_bad, count(*) AS entries, count(*) FILTER (WHERE b.first_bad IS NULL OR rl.idx < b.first_bad) AS kept FROM rl JOIN b ON b.log_id = rl.log_id GROUP BY 1, 2)
SELECT log_id, entries, kept, entries - kept AS removed, first_bad, CASE WHEN entries > kept THEN 'TRUNCATE' ELSE 'NONE' END AS action FROM n""")
def insp_repair_plan(spark, d):
    return inspect.repair_plan(rlog_of(spark, d).withColumn("valid", F.length("text") % 5 != 0), "idx", "log_id")


@query(f"""WITH {FILES} SELECT '{{"level":' || level || ',"files":' || count(*) || ',"bytes":' || sum(file_size)::BIGINT || ',"oldest_file":' || min(file_number) || ',"newest_file":' || max(file_number) || '}}' AS report FROM mf GROUP BY level""")
def insp_report_json(spark, d):
    return inspect.report_json(inspect.level_report(files_of(spark, d)))


@query("""SELECT page_id, url AS display, octet_length(encode(html)) AS value_bytes FROM pages WHERE NOT starts_with(url, 'https://m.')""")
def disp_workbench_rows(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.col("url").alias("k"), F.col("html").alias("v"))
    return inspect.workbench_rows(rows, b"https://m.").select("page_id", "display", "value_bytes")


@query(f"""WITH {LOG}, ops AS (SELECT 'orders' AS collection, o_orderkey // 50 AS batch_id, o_orderkey * 2 AS ordinal, o_orderstatus AS v FROM orders
UNION ALL SELECT 'customer', c_custkey // 50, c_custkey * 2 + 1, c_name FROM customer) SELECT collection, batch_id, ordinal, v, row_number() OVER (ORDER BY batch_id, ordinal) AS seq FROM ops""")
def kv_cross_collection_batch(spark, d):
    parts = {
        "orders": table(spark, d, "orders").selectExpr("o_orderkey div 50 AS batch_id", "o_orderkey * 2 AS ordinal", "o_orderstatus AS v"),
        "customer": table(spark, d, "customer").selectExpr("c_custkey div 50 AS batch_id", "c_custkey * 2 + 1 AS ordinal", "c_name AS v"),
    }
    return write.assign_sequences(write.union_collections(parts), 0)


@query("SELECT mktsegment AS name, 15 + 25 + row_number() OVER (ORDER BY mktsegment) AS field_id FROM (SELECT DISTINCT c_mktsegment AS mktsegment FROM customer) s")
def sch_next_field_ids(spark, d):
    used = table(spark, d, "nation").selectExpr("15 + n_nationkey AS field_id")
    names = table(spark, d, "customer").selectExpr("c_mktsegment AS name").distinct()
    return schema.next_field_ids(used, used.selectExpr("field_id + 1 AS field_id"), names)


@query("SELECT r_regionkey, r_name FROM region")
def rel_seed_if_empty(spark, d):
    r = table(spark, d, "region").select("r_regionkey", "r_name")
    return relations.seed_if_empty(r.filter("r_regionkey < 0"), r)


@query(f"WITH {LOG} SELECT (seq - 1) // 100 AS idx, (seq - 1) % 100 AS ordinal, op, k, v FROM log")
def rlog_command_ops(spark, d):
    ops = _batches(spark, d).select(F.col("batch_id").alias("idx"), "ordinal", "op", "k", "v")
    return replog.command_ops(replog.command_body(ops))


@query(f"WITH RECURSIVE {FILES}, c AS (SELECT 1::BIGINT AS lo, 2::BIGINT AS hi, 0 AS i UNION ALL SELECT least(c.lo, (SELECT min(lo) FROM mf WHERE level IN (1, 2) AND mf.lo <= c.hi AND mf.hi >= c.lo)), greatest(c.hi, (SELECT max(hi) FROM mf WHERE level IN (1, 2) AND mf.lo <= c.hi AND mf.hi >= c.lo)), c.i + 1 FROM c WHERE i < 400) SELECT min(lo) AS lo, max(hi) AS hi FROM c")
def lvl_closure(spark, d):
    return spark.createDataFrame([compact.closure(files_of(spark, d), 1, 1, 2)], "lo long, hi long")
