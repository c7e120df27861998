"""Configurations over time: how they may follow one another, what a successor may change, and revoked keys.

A fleet's configurations are few, but fleets may be many, so all is grouped and joined by fleet; nothing is broadcast by force.

Defined cases: no configurations give no rows; a fleet's first one follows nothing; null members never equal
anything, so what reads them is a fault; repeated rows of a source in a configuration are each compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.kernels import window_start
from vigil.functions.params import DEFAULT, Params

ZERO = "0" * 64
BOUND = ("principal", "key_id", "public_key", "profile", "meter", "subjects")


def schedule_faults(configs: DataFrame, pack: str, p: Params = DEFAULT) -> DataFrame:
    """Add fault: the first rule that scheduling each configuration breaks, or null.
    configs: fleet, epoch, hash, predecessor, pack, scheduled_ms, effective_ms; they are scheduled in order of time and epoch."""
    w = Window.partitionBy("fleet").orderBy("scheduled_ms", "epoch")
    before = F.lag(F.struct("epoch", "hash", "effective_ms")).over(w)
    rows = configs.withColumn("_before", before)
    first = (F.col("epoch") == 1) & (F.col("predecessor") == ZERO)
    follows = (F.col("epoch") == F.col("_before.epoch") + 1) & (F.col("predecessor") == F.col("_before.hash"))
    fault = (
        F.when(~F.coalesce(F.col("pack") == pack, F.lit(False)), "PACK_UNAVAILABLE").when(~F.coalesce(F.when(F.col("_before").isNull(), first).otherwise(follows), F.lit(False)), "CHAIN_INVALID")
        .when(F.col("_before.effective_ms") > F.col("scheduled_ms"), "STATE_CONFLICT")
        .when(~F.coalesce(F.col("effective_ms") == window_start(F.col("scheduled_ms"), p) + p.window_ms, F.lit(False)), "INVALID_INPUT")
    )
    return rows.withColumn("fault", fault).drop("_before")


def successor_faults(sources: DataFrame, principals: DataFrame, subjects: DataFrame, watchers: DataFrame) -> DataFrame:
    """(fleet, epoch, id, fault) of each source or watcher that a configuration keeps from the one before, or
    takes on, against the rules: BOUND_FIELDS (a kept source changed what it is bound to), PRINCIPAL_KEY and
    WATCHER_KEY (the principal of a kept source or watcher has another key or is gone), SUBJECT_REMOVED.

    sources: fleet, epoch, source and ``BOUND``; principals: fleet, epoch, principal, key_id, public_key; subjects: fleet,
    epoch, subject; watchers: fleet, epoch, watcher, principal.  Each of them has several rows to a configuration."""
    by = ["fleet", "epoch"]
    # the first configuration has no predecessor and keeps nothing
    old = sources.select("fleet", (F.col("epoch") + 1).alias("epoch"), "source", F.struct(*BOUND).alias("was"))
    kept = _beside(sources, old, [*by, "source"])
    bound = kept.where(~F.struct(*BOUND).eqNullSafe(F.col("was"))).select(*by, F.col("source").alias("id"), F.lit("BOUND_FIELDS").alias("fault"))
    key = F.struct("key_id", "public_key")
    now = principals.select(*by, "principal", key.alias("now"))
    past = principals.select("fleet", (F.col("epoch") + 1).alias("epoch"), "principal", key.alias("past"))
    changed = _beside(past, now, [*by, "principal"], "left").where(~F.col("now").eqNullSafe(F.col("past"))).select(*by, "principal").distinct()
    keys = _beside(kept, changed, [*by, "principal"]).select(*by, F.col("source").alias("id"), F.lit("PRINCIPAL_KEY").alias("fault"))
    removed = _beside(sources.where(F.size("subjects") > 0).select(*by, "source", F.explode("subjects").alias("subject")), subjects.select(*by, "subject"), [*by, "subject"], "left_anti")
    later = sources.select("fleet", (F.col("epoch") + 1).alias("epoch")).distinct()
    gone = _beside(removed, later, by, "left_semi").select(*by, F.col("source").alias("id"), F.lit("SUBJECT_REMOVED").alias("fault"))
    before = watchers.select("fleet", (F.col("epoch") + 1).alias("epoch"), "watcher")
    eyes = _beside(_beside(watchers, before, [*by, "watcher"]), changed, [*by, "principal"]).select(*by, F.col("watcher").alias("id"), F.lit("WATCHER_KEY").alias("fault"))
    return bound.unionByName(keys).unionByName(gone).unionByName(eyes).distinct()


def _beside(rows: DataFrame, others: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join of two tables that both grow with the configurations.  The planner takes rows that are made by an explode for as few
    as those they are made of, and would collect them at the driver to broadcast them; both sides are sorted instead."""
    return rows.join(others.hint("merge"), on, how)


def revoked(configs: DataFrame) -> DataFrame:
    """(fleet, key_id, epoch, since_ms): when each key is revoked first, which is when its configuration is
    scheduled; revocation is never undone.  configs: fleet, epoch, scheduled_ms, revoked (array)."""
    keys = configs.select("fleet", "epoch", "scheduled_ms", F.explode("revoked").alias("key_id"))
    return keys.groupBy("fleet", "key_id").agg(F.min("epoch").alias("epoch"), F.min("scheduled_ms").alias("since_ms"))


def newly_revoked(configs: DataFrame) -> DataFrame:
    """(fleet, epoch, key_id): the keys that no configuration before revoked."""
    return revoked(configs).select("fleet", "epoch", "key_id")


def revoked_sources(sources: DataFrame, keys: DataFrame, at: str) -> DataFrame:
    """Add revoked: whether a source's key is revoked at the time in column ``at``, as far as was known by then."""
    known = keys.select("fleet", "key_id", "since_ms")
    return _beside(sources, known, ["fleet", "key_id"], "left").withColumn("revoked", F.coalesce(F.col("since_ms") <= F.col(at), F.lit(False))).drop("since_ms")


def latest(configs: DataFrame) -> DataFrame:
    """Each fleet's configuration of the highest epoch, with all its columns."""
    names = [c for c in configs.columns if c != "fleet"]
    return configs.groupBy("fleet").agg(F.max_by(F.struct(*names), "epoch").alias("_last")).select("fleet", "_last.*")


def roles(sources: DataFrame) -> DataFrame:
    """(fleet, epoch, sources, meters): how many sources are enabled, and how many of these are meters."""
    return sources.groupBy("fleet", "epoch").agg(F.count_if("enabled").alias("sources"), F.count_if(F.col("enabled") & F.col("meter")).alias("meters"))


def reporting(sources: DataFrame) -> DataFrame:
    """(fleet, epoch, subject, n_sources, first_source): the enabled sources that report on each subject."""
    each = sources.where("enabled").select("fleet", "epoch", "source", F.explode("subjects").alias("subject")).distinct()
    return each.groupBy("fleet", "epoch", "subject").agg(F.count("*").alias("n_sources"), F.min("source").alias("first_source"))
