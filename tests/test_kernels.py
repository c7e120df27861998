"""Kernels over one-row frames: fixed cases at the edges."""

import pytest
from pyspark.sql import functions as F

from vigil.functions import canon
from vigil.functions import kernels as K
from vigil.functions.strict import parsed

U = 2**63 - 1


def value(spark, column):
    def plain(x):
        return {k: plain(v) for k, v in x.asDict().items()} if hasattr(x, "asDict") else int(x) if type(x).__name__ == "Decimal" else x

    return plain(spark.range(1).select(column.alias("v")).first().v)


def longs(*xs):
    return F.array(*[F.lit(x).cast("bigint") for x in xs]) if xs else F.array().cast("array<bigint>")


def n(x):
    return F.lit(x).cast("bigint")


@pytest.mark.parametrize("history,current,complete,want", [
    ((100000, 200000, 300000, 400000, 500000), 1000000, True, ("HIT", "SPEND_SPIKE", 1000000, 1000000)),
    ((100000, 200000, 300000, 400000, 500000), 999999, True, ("CLEAR", "BELOW_THRESHOLD", 999999, 1000000)),
    ((100000, 100000, 4000000, 4000000, 4000000), 1000000, True, ("CLEAR", "BELOW_THRESHOLD", 1000000, 12000000)),
    ((100000,) * 4, 9000000, True, ("UNKNOWN", "BASELINE_WARMUP", 9000000, None)),
    ((0,) * 5, 9000000, False, ("UNKNOWN", "COVERAGE_INCOMPLETE", 9000000, None)),
    ((U,) * 5, U, True, ("CLEAR", "BELOW_THRESHOLD", U, None)),
])
def test_spend(spark, history, current, complete, want):
    assert tuple(value(spark, K.spend(longs(*history), n(current), F.lit(complete))).values()) == want


def test_sums(spark):
    assert tuple(value(spark, K.summed(longs(U, 1))).values()) == ("UNKNOWN", "ARITHMETIC_OVERFLOW", None, None)
    assert value(spark, K.array_sum(longs(U))) == U and value(spark, K.array_sum(longs())) == 0


@pytest.mark.parametrize("policies,scopes,policy,scope,reported,want", [
    ((), (), None, None, True, "DRIFT_REPORTED"), ((2,), (), 1, None, False, "POLICY_DRIFT"), ((), (), None, 1, False, "SCOPE_DRIFT"),
    ((), (), None, None, False, "EVIDENCE_MISSING"), ((1,), (), 1, None, False, "SCOPE_MATCH"),
])
def test_scope(spark, policies, scopes, policy, scope, reported, want):
    assert value(spark, K.scope(longs(*policies), longs(*scopes), n(policy), n(scope), F.lit(reported)))["reason"] == want


@pytest.mark.parametrize("args,want", [
    ((2, 8, 1, 1, 8), ("HIT", "PROCESS_EXCESS", 2, 1)), ((1, 9, 1, 1, 8), ("HIT", "THREAD_EXCESS", 9, 8)), ((1, 8, 2, 1, 8), ("HIT", "DECLARED_MISMATCH", 1, 2)),
    ((None, None, 1, 1, 8), ("UNKNOWN", "EVIDENCE_MISSING", None, None)), ((1, 8, 1, 1, 8), ("CLEAR", "INVENTORY_MATCH", 1, 1)),
    ((None, 3, 1, 1, 8), ("UNKNOWN", "EVIDENCE_MISSING", None, None)), ((None, 3, None, 1, 8), ("CLEAR", "INVENTORY_MATCH", 3, 8)),
])
def test_replication(spark, args, want):
    assert tuple(value(spark, K.replication(*map(n, args))).values()) == want


@pytest.mark.parametrize("state,end,want", [
    ("ACTIVE", 119999, ("CLEAR", "STREAM_RECENT", 119999, 120000)), ("ACTIVE", 120000, ("HIT", "STREAM_SILENT", 120000, 120000)),
    ("TERMINAL", 180000, ("CLEAR", "SOURCE_TERMINAL", None, None)), ("FORKED", 180000, ("UNKNOWN", "COVERAGE_INCOMPLETE", None, None)),
])
def test_silence(spark, state, end, want):
    assert tuple(value(spark, K.silence(F.lit(state), n(0), n(end))).values()) == want


@pytest.mark.parametrize("last,wall,seen,want", [
    (59999, 60000, 59999, (None, 60000, 60000, False)), (200000, 200001, 80000, (None, 200001, 180000, True)), (100000, 100000, 160001, ("FUTURE_TIMESTAMP", None, None, None)),
    (100000, 90000, 90000, (None, 100000, 60000, False)), (200000, 200000, 80000, (None, 200000, 180000, False)), (100000, 100000, 160000, (None, 100000, 60000, False)),
])
def test_receive_time(spark, last, wall, seen, want):
    assert tuple(value(spark, K.receive_time(n(last), n(wall), n(seen))).values()) == want


@pytest.mark.parametrize("head,pending,seq,known,signed,linked,want", [
    (1, (), 1, "SAME", True, True, (None, "DUPLICATE", "ACTIVE", 1, [], [])), (1, (), 3, "NONE", True, True, (None, "BUFFERED", "GAPPED", 1, [3], [])),
    (1, (3,), 2, "NONE", True, True, (None, "ACCEPTED", "ACTIVE", 3, [], [2, 3])), (1, (), 1, "DIFFERENT", True, True, (None, "FORK", "FORKED", 1, [], [])),
    (1, (), 1, "DIFFERENT", False, True, ("SIGNATURE_INVALID", None, None, None, None, None)), (1, (), 258, "NONE", True, True, ("GAP_LIMIT", None, None, None, None, None)),
    (1, (), 2, "NONE", True, False, ("CHAIN_INVALID", None, None, None, None, None)), (1, (3, 5), 2, "NONE", True, True, (None, "ACCEPTED", "GAPPED", 3, [5], [2, 3])),
])
def test_sequence(spark, head, pending, seq, known, signed, linked, want):
    assert tuple(value(spark, K.sequence(n(head), longs(*pending), n(seq), F.lit(known), F.lit(signed), F.lit(linked))).values()) == want


@pytest.mark.parametrize("votes,want", [
    ((("a", "d1", True), ("b", "d1", True)), (["d1"], False)), ((("b", "d2", True), ("a", "d1", True)), (["d1", "d2"], True)),
    ((("a", "d1", True), ("a", "d1", True)), (["d1"], False)), ((("a", "d1", True), ("b", "d2", False)), (["d1"], False)), ((("a", "d1", False), ("a", "d2", True), ("b", "d1", True)), (["d1"], False)),
])
def test_quorum(spark, votes, want):
    rows = F.array(*[F.struct(F.lit(w).alias("watcher"), F.lit(d).alias("domain"), F.lit(e).alias("eligible")) for w, d, e in votes])
    assert tuple(value(spark, K.quorum(rows)).values()) == want


def test_small_kernels(spark):
    gate = lambda same, now: value(spark, K.vote_gate(F.lit(same), n(now), n(300000)))["error"]
    assert [gate(True, 300000), gate(True, 299999), gate(False, 299999)] == ["VOTE_EXPIRED", None, "RESULT_MISMATCH"]
    act = lambda s, a, e, r: tuple(value(spark, K.alert_action(F.lit(s), F.lit(a), n(e), n(r))).values())
    assert act("CLOSED", "ack", 2, 2) == ("STATE_CONFLICT", None) and act("CANDIDATE", "close", 1, 2) == ("REVISION_CONFLICT", None) and act("CORROBORATED", "ack", 1, 1) == (None, "ACKNOWLEDGED")
    fail = lambda a, s: tuple(value(spark, K.delivery_failure(F.lit(a), F.lit(s).cast("int"))).values())
    assert fail(7, 500) == ("RETRY", 60000) and fail(8, 500) == ("FAILED", None) and fail(1, 404) == ("FAILED", None) and fail(1, None) == ("RETRY", 1000)
    assert tuple(value(spark, K.page_dedup(F.array(F.lit("r1")), F.array(F.lit("r1"), F.lit("r1")))).values()) == (["r1"], 0)
    assert tuple(value(spark, K.degrade(F.lit("CORROBORATED"), F.lit("QUEUED"))).values()) == ("CORROBORATED", "DEGRADED", "CANCELLED")
    assert value(spark, K.contiguous(longs(1, 3))) == "CHAIN_INVALID" and value(spark, K.contiguous(longs(4, 5))) is None
    assert tuple(value(spark, K.export_complete(F.lit(True), F.lit(False), n(2), n(2))).values()) == (False, "INCOMPLETE")
    assert tuple(value(spark, K.signal()).values())[:2] == ("SIGNAL", "SIGNAL_ONLY")
    a, b = (F.struct(F.lit("u").alias("subject"), n(x).alias("delta")) for x in (10, 11))
    assert tuple(value(spark, K.usage(a, a)).values()) == (None, False) and tuple(value(spark, K.usage(a, b)).values()) == ("USAGE_CONFLICT", None)
    rates = value(spark, K.rates(*map(n, (40, 5, 5, 40, 5, 5))))
    assert rates == {"precision": {"n": 40, "d": 45}, "recall": {"n": 40, "d": 50}, "false_positive_rate": {"n": 5, "d": 50}, "coverage": {"n": 90, "d": 100}}
    assert set(value(spark, K.rates(*[n(0)] * 6)).values()) == {None}
    z, p, d = 1.959963984540054, 40 / 45, 45
    mid, half = (p + z * z / 2 / d) / (1 + z * z / d), z * (p * (1 - p) / d + z * z / 4 / d / d) ** 0.5 / (1 + z * z / d)
    assert value(spark, K.wilson(n(40), n(45))) == {"low": f"{mid - half:.6f}", "high": f"{mid + half:.6f}"}
    assert value(spark, K.wilson(n(0), n(0))) is None and value(spark, K.wilson(n(3), n(3)))["high"] == "1.000000"


def test_scalars(spark):
    uint = lambda s: value(spark, K.uint(F.lit(s)))
    assert [uint(s) for s in ("9223372036854775808", "9223372036854775807", "01", "+1", " 1", "1\n", "0")] == [None, U, None, None, None, None, 0]
    assert not value(spark, K.valid_id(F.lit("wal_a"), "wal")) and value(spark, K.valid_id(F.lit("wal_" + "a" * 21), "wal"))
    assert not value(spark, K.valid_text(F.lit("a\x01"))) and value(spark, K.valid_text(F.lit("é" * 256)))
    pair = F.struct(n(1).alias("a"), n(2).alias("b"))
    assert value(spark, canon.canonical(pair)) == '{"a":1,"b":2}'
    assert value(spark, F.sha2(canon.canonical(pair), 256)) == "43258cff783fe7036d8a43033f830adfc60ec037382473548ac742b888292777"
    assert value(spark, canon.to_base64url(F.unhex(F.lit("fbff")))) == "-_8" and value(spark, F.hex(canon.from_base64url(F.lit("-_8")))) == "FBFF"
    assert value(spark, canon.from_base64url(F.lit("-_9"))) is None and value(spark, canon.from_base64url(F.lit("a="))) is None


@pytest.mark.parametrize("text,valid", [
    ('{"a":1,"a":2}', False), ('{"v":1e0}', False), ('{"v":-1}', False), ("[1] x", False), ("﻿{}", False), ("[" * 25 + "]" * 25, False), ("[" * 24 + "]" * 24, True),
    ('"\\ud800"', False), ('"\\ud83d\\ude00"', True), ("9007199254740992", False), ('{"b":null,"a":[true]}', True), ("", False), (None, False),
])
def test_strict_json(text, valid):
    assert parsed(text)[0] is valid
