"""Sequence admission: duplicates, forks, gaps, acceptance times, and the exact fold.

Arrivals have source, seq, hash, prev, arrival_ms and arrival (their order).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from vigil.functions.params import DEFAULT, Params
from vigil.operators.ordered import folded


def slot_verdicts(arrivals: DataFrame) -> DataFrame:
    """Add verdict: NEW for the first arrival of a slot, DUPLICATE for the same hash again, FORK for another."""
    w = Window.partitionBy("source", "seq").orderBy("arrival")
    first, n = F.first("hash").over(w), F.row_number().over(w)
    return arrivals.withColumn("verdict", F.when(n == 1, "NEW").when(F.col("hash") == first, "DUPLICATE").otherwise("FORK"))


def gaps(arrivals: DataFrame) -> DataFrame:
    """Per source: head of the contiguous prefix from 1, rows buffered beyond it, and the first missing number."""
    seqs = arrivals.select("source", "seq").distinct()
    n = F.row_number().over(Window.partitionBy("source").orderBy("seq"))
    return (
        seqs.withColumn("n", n).groupBy("source").agg(
            F.coalesce(F.max(F.when(F.col("seq") == F.col("n"), F.col("seq"))), F.lit(0).cast("bigint")).alias("head"),
            F.count(F.when(F.col("seq") != F.col("n"), 1)).alias("pending"),
        ).withColumn("missing", F.when(F.col("pending") > 0, F.col("head") + 1))
    )


def accepted_times(arrivals: DataFrame) -> DataFrame:
    """For fork-free sources: when each contiguous entry is accepted, that is when the
    last entry up to it has arrived; (source, seq, accept_ms)."""
    first = arrivals.groupBy("source", "seq").agg(F.min("arrival_ms").alias("arrival_ms"))
    w = Window.partitionBy("source").orderBy("seq")
    rows = first.withColumn("n", F.row_number().over(w)).withColumn("accept_ms", F.max("arrival_ms").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where("seq = n").select("source", "seq", "accept_ms")


def indexed(accepted: DataFrame) -> DataFrame:
    """Number accepted entries of each fleet in order of time, source and seq."""
    w = Window.partitionBy("fleet").orderBy("accept_ms", "source", "seq")
    return accepted.withColumn("index", F.row_number().over(w).cast("bigint"))


def logical_clock(ticks: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Add logical_ms: the largest wall clock so far."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ticks.withColumn("logical_ms", F.max("wall_ms").over(w))


def chain_errors(entries: DataFrame, by: list[str]) -> DataFrame:
    """Add linked: whether seq and prev follow the entry before; the first one follows nothing."""
    w = Window.partitionBy(*by).orderBy("seq")
    before = F.lag("seq").over(w)
    return entries.withColumn("linked", before.isNull() | ((F.col("seq") == before + 1) & F.coalesce(F.col("prev") == F.lag("hash").over(w), F.lit(False))))


class Fold:
    """The exact state of one source: head, buffered entries, what each slot held.  Without
    ``history`` the slots up to the head are let go, and arrivals there are PAST."""

    def __init__(self, gap: int = DEFAULT.gap, state: dict | None = None, history: bool = True):
        self.gap, self.history = gap, history
        self.s = state or {"state": "EMPTY", "head": 0, "hash": "", "slots": {}, "pending": {}}

    def step(self, seq: int, hash_: str, prev: str, terminal: bool) -> list[tuple[int, str]]:
        """Outcomes (seq, status) of one arrival; a drained entry is ACCEPTED with it."""
        s, slot = self.s, str(seq)
        if not self.history and seq <= s["head"]:
            return [(seq, "PAST")]
        known = s["slots"].get(slot)
        if known == hash_:
            return [(seq, "DUPLICATE")]
        if s["state"] in ("FORKED", "TERMINAL"):
            return [(seq, "SOURCE_FORKED" if s["state"] == "FORKED" else "SOURCE_TERMINAL")]
        if known is not None:
            s["state"] = "FORKED"
            return [(seq, "FORK")]
        if seq <= s["head"]:
            return [(seq, "CHAIN_INVALID")]
        if seq > s["head"] + self.gap or len(s["pending"]) >= self.gap:
            return [(seq, "GAP_LIMIT")]
        s["slots"][slot] = hash_
        s["pending"][slot] = [hash_, prev, terminal]
        if seq != s["head"] + 1:
            s["state"] = "GAPPED"
            return [(seq, "BUFFERED")]
        if s["head"] and prev != s["hash"]:
            s["state"] = "GAPPED"
            return [(seq, "CHAIN_INVALID")]
        out = []
        while (entry := s["pending"].get(str(s["head"] + 1))) and (not s["head"] or entry[1] == s["hash"]):
            if entry[2] and len(s["pending"]) > 1:
                s["state"] = "FORKED"
                return [*out, (s["head"] + 1, "TERMINAL_SUFFIX")]
            del s["pending"][str(s["head"] + 1)]
            if not self.history:
                del s["slots"][str(s["head"] + 1)]
            s["head"], s["hash"] = s["head"] + 1, entry[0]
            out.append((s["head"], "ACCEPTED"))
            if entry[2]:
                s["state"] = "TERMINAL"
                return out
        s["state"] = "GAPPED" if s["pending"] else "ACTIVE"
        return out


SCHEMA = "source string, arrival long, seq long, status string, state string, at_ms long"


def _outcomes(source, rows: pd.DataFrame, fold: Fold) -> pd.DataFrame:
    out = []
    for r in rows.sort_values("arrival").itertuples():
        out += [(source, r.arrival, seq, status, fold.s["state"], r.arrival_ms) for seq, status in fold.step(r.seq, r.hash, r.prev, r.terminal)]
    return pd.DataFrame(out, columns=["source", "arrival", "seq", "status", "state", "at_ms"])


STEPS = "source string, arrival long, seq long, hash string, at_ms long, state string, admitted boolean, outcomes array<struct<seq: long, status: string>>"
_STEPS = (
    StructType().add("source", "string").add("arrival", "long").add("seq", "long").add("hash", "string").add("at_ms", "long").add("state", "string").add("admitted", "boolean")
    .add("outcomes", ArrayType(StructType().add("seq", "long").add("status", "string")))
)


def _step(fold: Fold, r: dict) -> dict:
    """One arrival's outcomes, and whether it took its slot."""
    before = len(fold.s["slots"])
    got = fold.step(r["seq"], r["hash"], r["prev"], r["terminal"])
    took = len(fold.s["slots"]) + sum(status == "ACCEPTED" for _, status in got) > before
    return {
        "source": r["source"], "arrival": r["arrival"], "seq": r["seq"], "hash": r["hash"], "at_ms": r["arrival_ms"],
        "state": fold.s["state"], "admitted": took, "outcomes": [{"seq": n, "status": status} for n, status in got],
    }


def admit(arrivals: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The exact fold of each source's arrivals (their numbers differ within a source) in
    order, where forks, limits and terminal entries matter.  ``accepted_times`` is the
    relational way for sources without forks.

    The fold holds a source's head and its buffered entries, at most ``p.gap``.  Arrivals at
    slots up to the head are judged beside the arrivals that took the slots; the first
    that differs there forks its source, and what the fold said beyond it is replaced."""
    gap = p.gap
    needed = arrivals.select("source", "arrival", "seq", "hash", "prev", "terminal", "arrival_ms")
    return judged(folded(needed, "source", ["arrival"], lambda: Fold(gap, history=False), _step, _STEPS))


def judged(steps: DataFrame) -> DataFrame:
    """Outcomes of a fold without history, given its steps: one row per arrival."""
    taken = F.max(F.when(F.col("admitted"), F.struct("arrival", "hash"))).over(Window.partitionBy("source", "seq"))
    steps = steps.withColumn("taken", taken).withColumns({"held": F.col("taken.hash"), "held_at": F.col("taken.arrival")})
    past = F.col("outcomes")[0]["status"] == "PAST"
    closed = F.when(F.col("state") == "FORKED", "SOURCE_FORKED").when(F.col("state") == "TERMINAL", "SOURCE_TERMINAL")
    late = F.when(F.col("held") == F.col("hash"), "DUPLICATE").otherwise(F.coalesce(closed, F.when(F.col("held").isNull(), "CHAIN_INVALID").otherwise("FORK")))
    steps = steps.withColumn("late", F.when(past, late))
    forks = steps.where("late = 'FORK'").groupBy(F.col("source").alias("forked")).agg(F.min("arrival").alias("fork_at"))
    same = (F.col("held") == F.col("hash")) & (F.col("held_at") < F.col("fork_at"))
    after = F.when(F.col("arrival") > F.col("fork_at"), F.when(same, "DUPLICATE").otherwise("SOURCE_FORKED"))
    one = F.coalesce(after, F.col("late"))
    outcomes = F.when(one.isNotNull(), F.array(F.struct("seq", one.alias("status")))).otherwise(F.col("outcomes"))
    state = F.when(F.col("arrival") >= F.col("fork_at"), "FORKED").otherwise(F.col("state"))
    told = steps.join(forks, F.col("source").eqNullSafe(F.col("forked")), "left").select("source", "arrival", state.alias("state"), "at_ms", F.explode(outcomes).alias("o"))
    return told.select("source", "arrival", "o.seq", "o.status", "state", "at_ms")
