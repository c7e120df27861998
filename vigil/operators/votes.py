"""Votes, corroboration, alert life cycle and delivery."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions import kernels as K
from vigil.functions.params import DEFAULT, Params
from vigil.operators.ordered import folded
from vigil.sources.store import written


def counted_votes(votes: DataFrame, roster: DataFrame) -> DataFrame:
    """Each watcher's first vote on a result, with its domain where the roster of the
    result's configuration lists it.  votes: result, config, watcher, at_ms, vote; roster: config, watcher, domain, enabled."""
    w = Window.partitionBy("result", "watcher").orderBy("at_ms", "vote")
    first = votes.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    listed = roster.where("enabled").select("config", "watcher", "domain")
    return first.join(listed, ["config", "watcher"], "left")


def corroboration(votes: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Per result: distinct domains, whether they are a quorum, and when the quorum was reached."""
    domains = votes.where("domain is not null").groupBy("result", "domain").agg(F.min("at_ms").alias("at_ms"))
    times = F.sort_array(F.collect_list("at_ms"))  # of a result's domains: at most 16
    return domains.groupBy("result").agg(
        F.concat_ws(",", F.array_sort(F.collect_set("domain"))).alias("domains"),
        (F.count("*") >= p.quorum).alias("corroborated"), F.try_element_at(times, F.lit(p.quorum)).alias("corroborated_ms"),
    )


def alert_states(alerts: DataFrame, quorum: DataFrame, now_ms, p: Params = DEFAULT) -> DataFrame:
    """State at a time: corroborated before expiry, expired, or still a candidate.  alerts: result, expires_ms."""
    joined = alerts.join(quorum.select("result", "corroborated_ms"), "result", "left")
    state = F.when(F.col("corroborated_ms") < F.col("expires_ms"), "CORROBORATED").when(F.col("expires_ms") <= now_ms, "EXPIRED").otherwise("CANDIDATE")
    return joined.withColumn("state", state)


def degraded(alerts: DataFrame, evidence: DataFrame, bad: DataFrame) -> DataFrame:
    """Add assurance: DEGRADED where a forked or revoked source is among an alert's evidence.
    evidence: result, source; bad: source."""
    touched = evidence.join(bad, "source", "left_semi").select("result").distinct().withColumn("touched", F.lit(True))
    return alerts.join(touched, "result", "left").withColumn("assurance", F.when(F.col("touched"), "DEGRADED").otherwise("VALID")).drop("touched")


def new_pages(corroborated: DataFrame, outbox: DataFrame) -> DataFrame:
    """Results to page that no page exists for yet."""
    return corroborated.select("result").distinct().join(outbox.select("result"), "result", "left_anti")


def delivery(attempts: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Add to each delivery attempt (alert, attempt from 1, at_ms, status) its state and when
    it is due again; attempts after a delivery or failure are dropped."""
    done = F.col("status").between(200, 299)
    failure = K.delivery_failure(F.col("attempt"), F.col("status"), p)
    rows = attempts.withColumn("state", F.when(done, "DELIVERED").otherwise(failure["state"]))
    rows = rows.withColumn("due_ms", F.when(F.col("state") == "RETRY", F.col("at_ms") + failure["delay_ms"]))
    w = Window.partitionBy("alert").orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    over = F.coalesce(F.bool_or(F.col("state") != "RETRY").over(w), F.lit(False))
    return rows.withColumn("over", over).where("not over").drop("over")


def buckets(requests: DataFrame, rate: int = 32, burst: int = 64, key: str = "key_id") -> DataFrame:
    """Token buckets: whether each request (key, at_ms, request) is let through.
    Every key's requests are one ordered stream; the fold holds a key's tokens and last time."""

    def step(bucket: dict, r: dict) -> dict:
        if bucket["last"] is not None:
            bucket["tokens"] = min(float(burst), bucket["tokens"] + (r["at_ms"] - bucket["last"]) * rate / 1000)
        ok = bucket["tokens"] >= 1
        bucket["tokens"], bucket["last"] = bucket["tokens"] - ok, r["at_ms"]
        return {**r, "allowed": ok}

    needed = requests.select(*(F.col(c).cast("long").alias(c) for c in (key, "request", "at_ms")))
    schema = needed.schema.add("allowed", "boolean")
    return folded(needed, key, ["at_ms", "request"], lambda: {"tokens": float(burst), "last": None}, step, schema)


def limited(requests: DataFrame, per_key: tuple[int, int] = (32, 64), per_fleet: tuple[int, int] = (100, 200)) -> DataFrame:
    """Add refused_by (KEY, FLEET or null) to requests (fleet, key_id, at_ms, request): what a key's bucket lets
    through comes to its fleet's bucket.  A fleet's refusal doesn't give the key its token back."""
    by_key = requests.join(buckets(requests, *per_key).select("key_id", "request", F.col("allowed").alias("by_key")), ["key_id", "request"])
    passed = written(by_key, "passed")
    by_fleet = buckets(passed.where("by_key"), *per_fleet, key="fleet").select("fleet", "request", F.col("allowed").alias("by_fleet"))
    told = passed.join(by_fleet, ["fleet", "request"], "left")
    return told.withColumn("refused_by", F.when(~F.col("by_key"), "KEY").when(~F.col("by_fleet"), "FLEET")).drop("by_key", "by_fleet")
