"""Decision kernels as Column expressions: no Python runs for a row.

Each takes Columns and returns a struct Column; ``error`` names why there is no
result.  Values above 2**63 - 1 are carried as decimals.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .params import DEFAULT, U_MAX, Params

WIDE = "decimal(38,0)"


def wide(c) -> Column:
    return (c if isinstance(c, Column) else F.lit(c)).cast(WIDE)


def decision(status, reason, value=None, limit=None) -> Column:
    text = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        text(status).alias("status"), text(reason).alias("reason"), wide(value).alias("value"), wide(limit).alias("limit")
    )


def uint(c: Column) -> Column:
    """The value of a decimal string without sign, padding or surplus zeros, up to 2**63 - 1; null for others."""
    return F.when(c.rlike(r"\A(0|[1-9][0-9]{0,18})\z"), c.try_cast("bigint"))


def valid_id(c: Column, prefix: str) -> Column:
    return F.coalesce(c.rlike(rf"\A{prefix}_[A-Za-z0-9_-]{{21}}\z"), F.lit(False))


def valid_text(c: Column) -> Column:
    """1 to 256 characters, at most 1024 bytes, no control characters."""
    fits = (F.char_length(c) >= 1) & (F.char_length(c) <= 256) & (F.octet_length(c) <= 1024)
    return F.coalesce(fits & ~c.rlike(r"[\x00-\x1f\x7f]"), F.lit(False))


def checked_sum(c) -> Column:
    """Aggregate: the sum, 0 for no rows, null beyond 2**63 - 1."""
    total = F.coalesce(F.sum(wide(F.col(c) if isinstance(c, str) else c)), wide(0))
    return F.when(total <= U_MAX, total.cast("bigint"))


def array_sum(values: Column) -> Column:
    """The same over an array of integers."""
    total = F.aggregate(values, wide(0), lambda s, x: (s + wide(x)).cast(WIDE))
    return F.when(total <= U_MAX, total.cast("bigint"))


def summed(values: Column) -> Column:
    total = array_sum(values)
    return F.when(total.isNull(), decision("UNKNOWN", "ARITHMETIC_OVERFLOW")).otherwise(decision("CLEAR", "BELOW_THRESHOLD", total))


def median_of(history: Column, n: int = DEFAULT.history) -> Column:
    """The exact middle of n values; null of fewer."""
    return F.try_element_at(F.sort_array(history), F.lit(n // 2 + 1))


def spend_threshold(history: Column, p: Params = DEFAULT) -> Column:
    base = F.greatest(wide(median_of(history, p.history)), wide(p.baseline_floor))
    return F.greatest((base * p.multiplier).cast(WIDE), wide(p.spend_min))


def spend(history: Column, current: Column, complete: Column, p: Params = DEFAULT) -> Column:
    """Spike of a window's sum against its history, coverage tested first."""
    t = spend_threshold(history, p)
    limit = F.when(t <= U_MAX, t)
    return (
        F.when(~complete, decision("UNKNOWN", "COVERAGE_INCOMPLETE", current))
        .when(F.size(history) < p.history, decision("UNKNOWN", "BASELINE_WARMUP", current))
        .when(wide(current) >= t, decision("HIT", "SPEND_SPIKE", current, limit))
        .otherwise(decision("CLEAR", "BELOW_THRESHOLD", current, limit))
    )


def scope(policies: Column, scopes: Column, policy: Column, seen: Column, reported: Column) -> Column:
    return (
        F.when(reported, decision("HIT", "DRIFT_REPORTED"))
        .when(policy.isNotNull() & ~F.array_contains(policies, policy), decision("HIT", "POLICY_DRIFT"))
        .when(seen.isNotNull() & ~F.array_contains(scopes, seen), decision("HIT", "SCOPE_DRIFT"))
        .when(policy.isNotNull() | seen.isNotNull(), decision("CLEAR", "SCOPE_MATCH"))
        .otherwise(decision("UNKNOWN", "EVIDENCE_MISSING"))
    )


def replication(processes: Column, threads: Column, declared: Column, most_processes: Column, most_threads: Column) -> Column:
    known = F.coalesce(processes, threads)
    return (
        F.when(processes > most_processes, decision("HIT", "PROCESS_EXCESS", processes, most_processes))
        .when(threads > most_threads, decision("HIT", "THREAD_EXCESS", threads, most_threads))
        .when(declared != processes, decision("HIT", "DECLARED_MISMATCH", processes, declared))
        .when(known.isNull() | (declared.isNotNull() & processes.isNull()), decision("UNKNOWN", "EVIDENCE_MISSING"))
        .otherwise(decision("CLEAR", "INVENTORY_MATCH", known, F.when(processes.isNotNull(), most_processes).otherwise(most_threads)))
    )


def silence(state: Column, last_ms: Column, end_ms: Column, p: Params = DEFAULT) -> Column:
    age = end_ms - last_ms
    return (
        F.when(state.isin("TERMINAL", "RETIRED"), decision("CLEAR", "SOURCE_TERMINAL"))
        .when(state == "FORKED", decision("UNKNOWN", "COVERAGE_INCOMPLETE"))
        .when(age >= p.silence_ms, decision("HIT", "STREAM_SILENT", age, p.silence_ms))
        .otherwise(decision("CLEAR", "STREAM_RECENT", age, p.silence_ms))
    )


def signal() -> Column:
    return decision("SIGNAL", "SIGNAL_ONLY")


#: Order in which a subject's decisions count: by status, and among hits by reason.
STATUS_ORDER = ("HIT", "UNKNOWN", "CLEAR", "SIGNAL")
SCOPE_ORDER = ("DRIFT_REPORTED", "POLICY_DRIFT", "SCOPE_DRIFT")
REPLICATION_ORDER = ("PROCESS_EXCESS", "THREAD_EXCESS", "DECLARED_MISMATCH")


def rank_of(c: Column, order: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in order]), c)


def strongest(d: str, index: str, order: tuple[str, ...]) -> Column:
    """Aggregate: the decision that counts among several; ties go to the lowest index."""
    status, reason = F.col(f"{d}.status"), F.col(f"{d}.reason")
    reasons = F.when(status == "HIT", rank_of(reason, order)).otherwise(F.lit(0))
    return F.min_by(d, F.struct(rank_of(status, STATUS_ORDER), reasons, F.col(index)))


def window_start(t: Column, p: Params = DEFAULT) -> Column:
    return t - F.pmod(t, F.lit(p.window_ms))


def late(observed: Column, t: Column, p: Params = DEFAULT) -> Column:
    return observed < t - p.late_ms


def future(observed: Column, t: Column, p: Params = DEFAULT) -> Column:
    return observed > t + p.future_ms


def receive_time(last: Column, wall: Column, observed: Column, p: Params = DEFAULT) -> Column:
    t, ahead = F.greatest(last, wall), future(observed, F.greatest(last, wall), p)
    return F.struct(
        F.when(ahead, "FUTURE_TIMESTAMP").alias("error"), F.when(~ahead, t).alias("logical_ms"),
        F.when(~ahead, window_start(t, p)).alias("window_start_ms"), F.when(~ahead, late(observed, t, p)).alias("late"),
    )


def vote_gate(same: Column, now: Column, expires: Column) -> Column:
    error = F.when(~same, "RESULT_MISMATCH").when(now >= expires, "VOTE_EXPIRED")
    return F.struct(error.alias("error"), F.when(error.isNull(), True).alias("accepted"))


def alert_action(state: Column, action: Column, expected: Column, actual: Column) -> Column:
    """The revision is compared before the state."""
    to = F.when((action == "ack") & (state == "CORROBORATED"), "ACKNOWLEDGED").when(
        (action == "close") & state.isin("CANDIDATE", "CORROBORATED", "ACKNOWLEDGED"), "CLOSED"
    )
    stale = expected != actual
    return F.struct(F.when(stale, "REVISION_CONFLICT").when(to.isNull(), "STATE_CONFLICT").alias("error"), F.when(~stale, to).alias("state"))


def delivery_failure(attempts: Column, status: Column, p: Params = DEFAULT) -> Column:
    again = (status.isNull() | (status == 429) | (status >= 500)) & (attempts <= len(p.retry_ms))
    delay = F.try_element_at(F.array(*[F.lit(x).cast("bigint") for x in p.retry_ms]), F.greatest(attempts, F.lit(1)).cast("int"))
    return F.struct(F.when(again, "RETRY").otherwise("FAILED").alias("state"), F.when(again, delay).alias("delay_ms"))


def degrade(state: Column, delivery: Column) -> Column:
    return F.struct(
        state.alias("state"), F.lit("DEGRADED").alias("assurance"),
        F.when(delivery.isin("QUEUED", "RETRY"), "CANCELLED").otherwise(delivery).alias("delivery"),
    )


def usage(stored: Column, incoming: Column) -> Column:
    """Of the first use of an id only; equal payloads aren't counted again, others conflict."""
    conflict = stored.isNotNull() & (stored != incoming)
    return F.struct(F.when(conflict, "USAGE_CONFLICT").alias("error"), F.when(~conflict, stored.isNull()).alias("counted"))


def quorum(votes: Column, p: Params = DEFAULT) -> Column:
    """Domains of the eligible among each watcher's first vote; votes: array of (watcher, domain, eligible)."""
    earlier = lambda i: F.transform(F.slice(votes, F.lit(1), i), lambda v: v["watcher"])
    first = F.filter(votes, lambda v, i: ~F.array_contains(earlier(i), v["watcher"]) & v["eligible"])
    domains = F.array_sort(F.array_distinct(F.transform(first, lambda v: v["domain"])))
    return F.struct(domains.alias("domains"), (F.size(domains) >= p.quorum).alias("corroborated"))


def sequence(head: Column, pending: Column, seq: Column, known: Column, signed: Column, linked: Column, p: Params = DEFAULT) -> Column:
    """One arrival against a source's head and its buffered sequence numbers."""
    error = (
        F.when(~signed, "SIGNATURE_INVALID").when(known != "NONE", None).when(seq <= head, "CHAIN_INVALID")
        .when(seq > head + p.gap, "GAP_LIMIT").when((seq == head + 1) & ~linked, "CHAIN_INVALID")
    )
    fresh, next_ = known == "NONE", seq == head + 1
    held = F.array_sort(F.array_distinct(F.concat(pending, F.array(seq))))
    # in order, what is buffered without a gap from seq on drains with it
    above = F.filter(held, lambda x: x >= seq)
    run = F.filter(above, lambda x, i: x == seq + i.cast("bigint"))
    drained = F.when(fresh & next_, run).otherwise(F.filter(pending, lambda x: F.lit(False)))
    left = F.when(~fresh, pending).when(next_, F.array_except(held, run)).otherwise(held)
    status = F.when(known == "SAME", "DUPLICATE").when(known == "DIFFERENT", "FORK").when(next_, "ACCEPTED").otherwise("BUFFERED")
    state = F.when(known == "SAME", "ACTIVE").when(known == "DIFFERENT", "FORKED").when(F.size(left) == 0, "ACTIVE").otherwise("GAPPED")
    ok = error.isNull()
    return F.struct(
        error.alias("error"), F.when(ok, status).alias("status"), F.when(ok, state).alias("state"),
        F.when(ok, F.when(fresh & next_, F.element_at(run, -1)).otherwise(head)).alias("head"),
        F.when(ok, left).alias("pending"), F.when(ok, drained).alias("drained"),
    )


def page_dedup(existing: Column, corroborated: Column) -> Column:
    out = F.array_union(existing, corroborated)
    return F.struct(out.alias("outbox_results"), (F.size(out) - F.size(F.array_distinct(existing))).alias("inserted"))


def contiguous(seqs: Column) -> Column:
    """Null where each number follows the one before, else the error."""
    return F.when(F.exists(F.transform(seqs, lambda x, i: x - seqs[0] != i.cast("bigint")), lambda x: x), "CHAIN_INVALID")


def export_complete(header: Column, trailer: Column, expected: Column, actual: Column) -> Column:
    ok = header & trailer & (expected == actual)
    return F.struct(ok.alias("complete"), F.when(~ok, "INCOMPLETE").alias("reason"))


def fraction(n: Column, d: Column) -> Column:
    return F.when(d != 0, F.struct(n.alias("n"), d.alias("d")))


def rates(tp: Column, fp: Column, fn: Column, tn: Column, up: Column, un: Column) -> Column:
    """Undecided units stay in the denominators of recall, false positives and coverage."""
    decided = tp + fp + fn + tn
    return F.struct(
        fraction(tp, tp + fp).alias("precision"), fraction(tp, tp + fn + up).alias("recall"),
        fraction(fp, fp + tn + un).alias("false_positive_rate"), fraction(decided, decided + up + un).alias("coverage"),
    )


Z95 = 1.959963984540054


def six(c: Column) -> Column:
    """Six decimals, rounded half-even."""
    return F.format_string("%.6f", F.bround(c, 6))


def wilson(n: Column, d: Column) -> Column:
    """Wilson interval of n of d at 95 %, as six-decimal strings rounded half-even."""
    n, d = n.cast("double"), d.cast("double")
    p, z = n / d, Z95
    centre, half = (p + z * z / (2 * d)) / (1 + z * z / d), z * F.sqrt(p * (1 - p) / d + z * z / (4 * d * d)) / (1 + z * z / d)
    return F.when(d != 0, F.struct(six(F.greatest(F.lit(0.0), centre - half)).alias("low"), six(F.least(F.lit(1.0), centre + half)).alias("high")))
