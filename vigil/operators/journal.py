"""Journal checks: chains, frames, groups, transitions, objects, configuration epochs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.operators.scans import Dealt


def page(journal: DataFrame, after: int, limit: int, budget: int) -> DataFrame:
    """The frame after a sequence number: at most ``limit`` entries whose running
    bytes stay within ``budget``, the first one always."""
    some = journal.where(F.col("seq") > after).orderBy("seq").limit(limit)
    w = Window.orderBy("seq")  # over at most ``limit`` rows
    sums = some.withColumn("bytes_so_far", F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.row_number().over(w))
    return sums.where((F.col("n") == 1) | (F.col("bytes_so_far") <= budget)).drop("n")


def keyset(rows: DataFrame, key: str, after, limit: int) -> DataFrame:
    return rows.where(F.col(key) > after).orderBy(key).limit(limit)


def illegal(changes: DataFrame, by: list[str], legal: DataFrame) -> DataFrame:
    """Changes whose state doesn't follow the one before.  legal: prev_state, state."""
    w = Window.partitionBy(*by).orderBy("seq")
    pairs = changes.withColumn("prev_state", F.lag("state").over(w)).where("prev_state is not null")
    return pairs.join(legal, ["prev_state", "state"], "left_anti")


def conflicts(objects: DataFrame) -> DataFrame:
    """(kind, hash) that stand for different values."""
    return objects.groupBy("kind", "hash").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n")).where("lo <> hi")


def inserted(there: DataFrame, arrivals: DataFrame) -> DataFrame:
    """The objects (kind, hash, seq, ...) that are there, and of the others that arrive the first of each kind and hash."""
    names = [c for c in arrivals.columns if c not in ("kind", "hash")]
    first = arrivals.groupBy("kind", "hash").agg(F.min_by(F.struct(*names), "seq").alias("_o")).select("kind", "hash", "_o.*")
    return there.select(*arrivals.columns).unionByName(first.join(there.select("kind", "hash"), ["kind", "hash"], "left_anti").select(*arrivals.columns))


def first_reference(references: DataFrame) -> DataFrame:
    return references.groupBy("kind", "hash").agg(F.min("seq").alias("first_seq"))


def epochs(configs: DataFrame) -> DataFrame:
    """Add until_ms: when the next epoch of the fleet takes over."""
    w = Window.partitionBy("fleet").orderBy("effective_ms")
    return configs.withColumn("until_ms", F.lead("effective_ms").over(w))


def in_force(rows: DataFrame, configs: DataFrame, at: str) -> DataFrame:
    """Each row with the epoch in force at its time; rows before the first epoch of their fleet go."""
    return asof(rows, at, configs.select("fleet", "effective_ms", "epoch"), "effective_ms", ["fleet"]).where("epoch is not null")


def asof(rows: DataFrame, at: str, facts: DataFrame, since: str, by: list[str]) -> DataFrame:
    """Each row with the latest facts of its key that hold since its time or before; nulls where there are none.

    Both are dealt out together by ranges of (key, time) and the last fact is a running value, so no side
    is broadcast and no row meets more than one fact.  Of facts of one time the greatest counts."""
    names = [c for c in facts.columns if c not in (*by, since)]
    both = rows.withColumn("_at", F.col(at)).withColumn("_is_row", F.lit(1)).unionByName(
        facts.select(*by, F.col(since).alias("_at"), F.struct(*names).alias("_fact")).withColumn("_is_row", F.lit(0)), allowMissingColumns=True
    )
    told = Dealt(both, by, ["_at", "_is_row"]).prefixes({"_last": ("max", F.when(F.col("_is_row") == 0, F.struct("_at", "_fact")))}, inclusive=True)
    return told.where("_is_row = 1").select(*rows.columns, *(F.col("_last._fact")[c].alias(c) for c in names))


def once_a_day(requests: DataFrame, ttl_ms: int = 86_400_000, fresh_ms: int = 60_000) -> DataFrame:
    """Outcome of requests (key_id, request_id, request_hash, sent_ms, at_ms, seq): STALE if unknown and sent too long
    ago or ahead, NEW, then CONFLICT with other content, EXPIRED beyond the time to live of the first, or REPLAY.

    A stale request isn't recorded, so the first fresh one is what later ones are held against; it is found by
    grouping, and no key is ordered."""
    fresh = F.abs(F.col("sent_ms") - F.col("at_ms")) <= fresh_ms
    first = requests.where(fresh).groupBy("key_id", "request_id").agg(F.min(F.struct("at_ms", "seq", "request_hash")).alias("first"))
    later = F.struct("at_ms", "seq") > F.struct("first.at_ms", "first.seq")
    out = (
        F.when(F.col("seq") == F.col("first.seq"), "NEW").when(F.col("first").isNull() | ~later, "STALE").when(F.col("request_hash") != F.col("first.request_hash"), "CONFLICT")
        .when(F.col("at_ms") - F.col("first.at_ms") > ttl_ms, "EXPIRED").otherwise("REPLAY")
    )
    return requests.join(first, ["key_id", "request_id"], "left").withColumn("outcome", out).drop("first")
