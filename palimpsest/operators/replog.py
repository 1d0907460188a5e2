"""Replicated log: continuity, hash chain, bounded reads, truncation, quorums.

A log has ``log_id`` and ``idx``, ``term``, ``type``, ``seq_start``, ``seq_after``, ``previous_hash``, ``entry_hash``; windows run within a ``log_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _order() -> object:
    return W.partitionBy("log_id").orderBy("idx")


#: The hash before a log's first entry: 32 zero bytes in hexadecimal.
GENESIS = "0" * 64


def entry_hash(previous: Column, *parts: Column) -> Column:
    """SHA-256 over the hash before (64 hexadecimal digits) and the entry's fields, each behind its length in bytes; an absent field has length -1.

    Lengths have eight digits, so no two lists of fields are written alike.
    """
    size = lambda p: F.coalesce(F.lpad(F.lower(F.hex(F.octet_length(p))), 8, "0"), F.lit("f" * 8))
    return F.sha2(F.concat(previous, *[F.concat(size(p), F.coalesce(F.lower(F.hex(p.cast("binary"))), F.lit(""))) for p in (x.cast("string") for x in parts)]), 256)


def append_chain(entries: DataFrame, *parts: str, last: str = GENESIS) -> DataFrame:
    """``entries`` (log_id, idx, ...) of one append with ``previous_hash`` and ``entry_hash``, chained from the hash ``last``.

    A chain is sequential: it is folded over the entries of one append to one log, which are at most 10,000.
    """
    rest = [c for c in entries.columns if c != "log_id"]
    own = entries.groupBy("log_id").agg(F.array_sort(F.collect_list(F.struct("idx", *[c for c in rest if c != "idx"]))).alias("es"))
    step = lambda acc, e: F.concat(acc, F.array(entry_hash(F.element_at(acc, -1), *[e[p] for p in parts])))
    chained = own.withColumn("hs", F.aggregate("es", F.array(F.lit(last)), step))
    out = chained.select("log_id", "hs", F.posexplode("es").alias("at", "e"))
    return out.select("log_id", *[F.col(f"e.{c}").alias(c) for c in rest], F.col("hs")[F.col("at")].alias("previous_hash"), F.col("hs")[F.col("at") + 1].alias("entry_hash"))


def broken_chain(log: DataFrame, *parts: str) -> DataFrame:
    """(log_id, idx) of entries whose own hash is not that of their fields; ``violations`` compares each with the one before, so both run side by side."""
    return log.filter(F.col("entry_hash") != entry_hash(F.col("previous_hash"), *[F.col(p) for p in parts])).select("log_id", "idx")


def violations(log: DataFrame) -> DataFrame:
    """(log_id, idx, problem) of each entry that may not follow the one before: index, term, hash, or state sequence.

    The first entry follows index, term and state 0 and the hash of zeros.
    """
    w, c = _order(), F.col
    start = {"idx": F.lit(0), "term": F.lit(0), "entry_hash": F.lit(GENESIS), "seq_after": F.lit(0)}
    before = {x: F.when(F.row_number().over(w) == 1, at).otherwise(F.lag(x).over(w)) for x, at in start.items()}
    out = log.withColumns({f"p_{x}": v for x, v in before.items()})
    n = c("seq_after") - c("seq_start") + 1
    problem = (
        F.when(c("idx") != c("p_idx") + 1, "INDEX").when(c("term") < c("p_term"), "TERM")
        .when(~c("previous_hash").eqNullSafe(c("p_entry_hash")), "HASH")
        .when((c("type") == "COMMAND") & ((c("seq_start") != c("p_seq_after") + 1) | ~n.between(1, 10_000)), "SEQUENCE")
        .when((c("type") != "COMMAND") & ((c("seq_start") != 0) | (c("seq_after") != c("p_seq_after"))), "SEQUENCE")
    )
    return out.select("log_id", "idx", problem.alias("problem")).filter("problem IS NOT NULL")


def bounded_read(log: DataFrame, start: int, end: int, entries: int, size: int, length: str = "length") -> DataFrame:
    """Entries from ``start`` up to ``end``: at most ``entries``, stopping before ``size`` bytes are passed, but always one."""
    if start < 1 or end < start or entries < 1 or size < 1:
        raise ValueError("a bounded read needs 1 <= start <= end and limits of at least 1")
    w = _order()
    part = log.filter((F.col("idx") >= start) & (F.col("idx") < end))
    part = part.withColumns({"__n": F.row_number().over(w), "__b": F.sum(length).over(w.rowsBetween(W.unboundedPreceding, 0))})
    return part.filter((F.col("__n") <= entries) & ((F.col("__n") == 1) | (F.col("__b") <= size))).drop("__n", "__b")


def entry_at(log: DataFrame, idx: int) -> DataFrame:
    """Entry, term and hash at an index."""
    return log.filter(F.col("idx") == idx)


def truncate_suffix(log: DataFrame, idx: int, committed: int, applied: int) -> DataFrame:
    """Entries below an index, at most one behind the last; what is committed or applied may not go."""
    if idx <= max(committed, applied):
        raise ValueError("cannot truncate committed or applied entries")
    if idx > (log.agg(F.max("idx")).first()[0] or 0) + 1:
        raise ValueError("cannot truncate behind the log's end")
    return log.filter(F.col("idx") < idx)


def command_body(ops: DataFrame, by: str = "idx") -> DataFrame:
    """Operations (ordinal, op, k, v) of each command in order as one body, with its SHA-256."""
    body = F.array_sort(F.collect_list(F.struct("ordinal", "op", "k", "v")))  # at most 10,000 of a command
    out = ops.groupBy(by).agg(body.alias("ops"))
    return out.withColumn("body_hash", F.sha2(F.to_json("ops"), 256))


def command_ops(commands: DataFrame, by: str = "idx") -> DataFrame:
    """The operations of command bodies, one a row."""
    return commands.select(by, F.inline("ops"))


def majority(n: Column) -> Column:
    """Votes that decide among n."""
    return F.floor(n / 2).cast("int") + 1


def _kth(values: Column, count: Column) -> Column:
    return F.element_at(F.sort_array(values, asc=False), majority(count))


def commit_index(matches: DataFrame, log: DataFrame, current_term: int, committed: int, by: str = "log_id") -> DataFrame:
    """The index that a majority of ``matches`` (by, voter, match) has; it moves the commit only if its term is the current one and it is higher."""
    top = matches.groupBy(by).agg(_kth(F.collect_list("match"), F.count("*")).alias("quorum_index"))  # one entry for each voter
    at = log.select(by, F.col("idx").alias("quorum_index"), "term")
    ok = (F.col("term") == current_term) & (F.col("quorum_index") > committed)
    moved = F.when(F.coalesce(ok, F.lit(False)), F.col("quorum_index")).otherwise(F.lit(committed).cast("long"))
    return top.join(at, [by, "quorum_index"], "left").select(by, "quorum_index", moved.alias("commit_index"))


def joint_commit(voters: DataFrame, durable: DataFrame, by: str = "log_id") -> DataFrame:
    """Least of both configurations' quorum index: voters (by, config OLD or NEW, voter), durable (by, voter, idx); a silent voter has 0."""
    got = voters.join(durable, [by, "voter"], "left").withColumn("idx", F.coalesce("idx", F.lit(0).cast("long")))
    each = got.groupBy(by, "config").agg(_kth(F.collect_list("idx"), F.count("*")).alias("q"))
    return each.groupBy(by).agg(F.min("q").alias("commit_index"), F.count("*").alias("configurations"))


def dual_majority(voters: DataFrame, acks: DataFrame, by: str = "log_id") -> DataFrame:
    """Whether the acknowledging voters (by, voter) are a majority in both configurations."""
    got = voters.join(acks.select(by, "voter", F.lit(1).alias("ack")).distinct(), [by, "voter"], "left")
    each = got.groupBy(by, "config").agg((F.count("ack") >= majority(F.count("*"))).alias("ok"))
    return each.groupBy(by).agg(F.bool_and("ok").alias("accepted"))


def freshness(term: Column, idx: Column, digest: Column, local_term: Column, local_idx: Column, local_digest: Column) -> Column:
    """UP_TO_DATE, STALE or DIVERGED: by term, then index, then hash."""
    order = lambda a, b: F.when(a > b, "UP_TO_DATE").otherwise("STALE")
    same = F.when(digest.eqNullSafe(local_digest), "UP_TO_DATE").otherwise("DIVERGED")
    return F.when(term != local_term, order(term, local_term)).when(idx != local_idx, order(idx, local_idx)).otherwise(same)


def follower_match(reports: DataFrame) -> DataFrame:
    """Match index of each follower (follower, at, match) over time: it never falls."""
    w = W.partitionBy("follower").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    return reports.withColumn("match_index", F.max("match").over(w))


def applied_state(checkpoints: DataFrame, by: str = "log_id") -> DataFrame:
    """The newest applied state (by, applied_index, applied_term, state_sequence, configuration) of each log: none goes back."""
    top = checkpoints.groupBy(by).agg(F.max(F.struct("applied_index", "applied_term", "state_sequence", "configuration")).alias("t"))
    return top.select(by, "t.*")


def unapplied(log: DataFrame, applied: DataFrame, commit: DataFrame, by: str = "log_id") -> DataFrame:
    """Committed entries that are not applied yet, per log: those to apply next, in order of ``idx``."""
    due = log.join(commit, by).join(applied.select(by, "applied_index"), by, "left")
    return due.filter((F.col("idx") <= F.col("commit_index")) & (F.col("idx") > F.coalesce("applied_index", F.lit(0)))).drop("commit_index", "applied_index")


def member_problems(members: DataFrame) -> DataFrame:
    """Members (config, member_id, endpoints) that break a configuration: repeated ids, or not 1 to 8 endpoints."""
    n = F.count("*").over(W.partitionBy("config", "member_id"))
    problem = F.when(n > 1, "DUPLICATE").when(~F.size("endpoints").between(1, 8), "ENDPOINTS")
    return members.withColumn("problem", problem).filter("problem IS NOT NULL").select("config", "member_id", "problem")
