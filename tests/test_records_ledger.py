"""Closed records against altered samples; journals against a brute-force chain and altered rows."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from vigil.functions import records as C
from vigil.operators import fleet as V
from vigil.operators import ledger as L


def sample(kind, r):
    """A value of a form."""
    if kind.startswith("?"):
        return None if r.random() < 0.5 else sample(kind[1:], r)
    if kind[0] in "[<":
        most, each = kind[1:].split(" ", 1)
        got = [sample(each, r) for _ in range(r.randint(0, min(3, int(most))))]
        return sorted({x for x in got}) if kind[0] == "<" else got
    name, _, rest = kind.partition(":")
    if name.startswith("@"):
        return made(name[1:], r)
    if name in ("is", "one"):
        return r.choice(rest.split("|"))
    if name == "int":
        return r.randint(*map(int, rest.split(":")))
    return {
        "u": lambda: str(r.choice([0, 7, 2**63 - 1])), "u1": lambda: str(r.choice([1, 2**63 - 1])), "hash": lambda: "".join(r.choices("0123456789abcdef", k=64)), "bool": lambda: r.random() < 0.5,
        "text": lambda: r.choice(["x", "Ein Text \u00fc", "y" * 256]), "pub": lambda: "A" * 43, "sig": lambda: "b" * 85 + "A", "id": lambda: f"{rest}_" + "".join(r.choices("abcXYZ019_-", k=21)), "code": lambda: "SPEND_SPIKE",
        "profile": lambda: "some-export/1", "endpoint": lambda: "https://host.example/v1",
    }[name]()


def made(name, r):
    if name in C.SHAPES:
        name = r.choice(C.SHAPES[name])
    return {k: sample(kind, r) for k, kind in C.RECORDS[name].items()}


def test_closed_records(spark):
    r, rows = random.Random(4), []
    for name in [*C.RECORDS, *C.SHAPES]:
        one = made(name, r)
        keys = list(one)
        r.shuffle(keys)
        rows.append((name, json.dumps({k: one[k] for k in keys}, indent=1, ensure_ascii=False), True))
        rows.append((name, json.dumps(one | {"surplus": 1}), False))
        if one:
            gone = r.choice([k for k in one])
            rows.append((name, json.dumps({k: v for k, v in one.items() if k != gone}), False))
            rows.append((name, json.dumps(one | {gone: {"odd": [1.5]}}), False))
        rows += [(name, "[]", False), (name, None, False), (name, "{", False)]
    df = spark.createDataFrame(rows, "name string, text string, want boolean")
    for name in {x[0] for x in rows}:
        got = df.where(F.col("name") == name).select("text", "want", C.valid(name, F.col("text")).alias("got")).collect()
        assert [(x.text, x.got) for x in got] == [(x.text, x.want) for x in got], name


def test_limits_of_forms(spark):
    head = lambda seq, hash_="a" * 64: json.dumps({"seq": seq, "hash": hash_})
    cases = [
        ("head", head("9223372036854775807"), True), ("head", head("9223372036854775808"), False), ("head", head("01"), False), ("head", head(1), False), ("head", head("1", "A" * 64), False), ("head", head("1\n"), False),
        ("ResultFinalized", json.dumps({"result": "f" * 64 + "\n"}), False), ("WindowFinalized", json.dumps({"manifest": "0" * 64, "result_count": 1089}), True),
        ("WindowFinalized", json.dumps({"manifest": "0" * 64, "result_count": 1090}), False), ("WindowFinalized", json.dumps({"manifest": "0" * 64, "result_count": 3.0}), False),
        ("KeysRevoked", json.dumps({"config": "0" * 64, "keys": ["wky_" + "b" * 21, "wky_" + "a" * 21]}), False), ("KeysRevoked", json.dumps({"config": "0" * 64, "keys": ["wky_" + "a" * 21] * 2}), False),
    ]
    for name, text, want in cases:
        got = spark.createDataFrame([(text,)], "t string").select(C.valid(name, F.col("t"))).first()[0]
        assert got is want, (name, text)


EVENTS = "fleet long, at_ms long, kind string, key string, n1 long, n2 long, n3 long, s1 string, s2 string, s3 string, s4 string"


@pytest.fixture(scope="module")
def journal(spark):
    rows = [(f, t, "Tick", "tick", t, *[None] * 6) for f in range(3) for t in range(100, 1100, 100)] + [(7, 5, "FleetChanged", "fleet", None, None, None, "RUNNING", *[None] * 3)]
    return L.appended(spark.createDataFrame(rows, EVENTS).withColumn("order", F.struct("at_ms")).repartition(4))


def test_chain_by_brute_force(journal):
    by = {}
    for r in journal.collect():
        by.setdefault(r.fleet, []).append(r)
    assert {f: len(x) for f, x in by.items()} == {0: 10, 1: 10, 2: 10, 7: 1}
    for rows in by.values():
        last = "0" * 64
        for i, r in enumerate(sorted(rows, key=lambda r: r.seq), 1):
            text = "\x1f".join("\0" if v is None else str(v) for v in tuple(r[c] for c in L.MEMBERS))
            assert (r.seq, r.prev) == (i, last)
            last = hashlib.sha256(f"ENTRY/1\0{i}\x1f{last}\x1f{text}".encode()).hexdigest()
            assert r.hash == last


def test_altered_journals_fail(journal):
    assert L.unchained(journal).count() == 0
    one = (F.col("fleet") == 1) & (F.col("seq") == 4)
    assert [tuple(r) for r in L.unchained(journal.withColumn("n1", F.when(one, 1).otherwise(F.col("n1")))).collect()] == [(1, 4, "HASH_INVALID")]
    assert [tuple(r) for r in L.unchained(journal.where(~one)).collect()] == [(1, 5, "CHAIN_INVALID")]
    assert L.unchained(journal.where("false")).count() == 0
    assert L.checkpoints(journal).where("fleet = 7").first().seq == 1


def test_continued_journal(spark, journal):
    more = spark.createDataFrame([(1, 2000, "Tick", "tick", 2000, *[None] * 6), (9, 1, "Tick", "tick", 1, *[None] * 6)], EVENTS).withColumn("order", F.struct("at_ms"))
    both = journal.unionByName(L.appended(more, L.checkpoints(journal)))
    assert L.unchained(both).count() == 0 and {r.fleet: r.seq for r in L.checkpoints(both).collect()} == {0: 10, 1: 11, 2: 10, 7: 1, 9: 1}


RECORD = "idx long, received_ms long, fleet long, source long, subject long, kind string, delta long, usage_id long, complete boolean, pending long, late boolean, hash string"


def test_usage_and_ends(spark):
    rows = [
        (1, 10, 0, 0, 0, "spend", 5, 1, None, None, False, "a"), (2, 11, 0, 0, 0, "spend", 5, 1, None, None, False, "b"), (3, 12, 0, 0, 0, "spend", 6, 1, None, None, False, "c"),
        (4, 13, 0, 1, 0, "spend", 6, 1, None, None, False, "d"), (5, 14, 0, 1, 0, "fork", None, None, None, None, False, "e"), (6, 15, 0, 1, 0, "spend", 9, 2, None, None, False, "f"),
    ]
    df = spark.createDataFrame(rows, RECORD)
    assert {r.idx: r.verdict for r in V.usage(V.before_end(df)).collect()} == {1: "COUNTED", 2: "REPEATED", 3: "USAGE_CONFLICT", 4: "COUNTED", 5: None}
    assert {r.idx: r.counted for r in V.accepted(df).collect()} == {1: True, 2: False, 4: True}
    assert V.accepted(df.where("false")).count() == 0


def test_records_are_not_dealt_out_for_ends_and_usage(spark):
    """Ends of sources and first uses are few and kept, so the planner sends them to where the records lie."""
    from vigil.plans import runs

    run = runs.Run(spark, "/root/testdata/sf0.01", keep=True)
    plan = run.standing._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_a_row_is_sorted_without_its_text(spark):
    """What a journal's rows are sorted with isn't twice their members."""
    rows = spark.createDataFrame([(0, 1, 1, "Tick", "tick", 1, None, None, None, None, None, None)], "fleet long, order long, at_ms long, kind string, key string, n1 long, n2 long, n3 long, s1 string, s2 string, s3 string, s4 string")
    plan = L.appended(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("concat_ws") < plan.index("RepartitionByExpression") and plan.count("concat_ws(") == 1
    head = spark.createDataFrame([(0, 7, "ab" * 32)], "fleet long, seq long, hash string")
    assert [(x.seq, x.prev) for x in L.appended(rows, head).collect()] == [(8, "ab" * 32)]


def test_records_of_a_journal_are_computed_once(spark):
    """Results and events read the written records, and the events table is read for them no more."""
    from vigil.plans import ledger

    d = "/root/testdata/sf0.001"
    run = ledger.recorded(spark, d)
    plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in (run.standing, run.cuts, run.hashed, ledger.events(spark, d, ledger.positioned(spark, d)))]
    assert not any("get_json_object" in p for p in plans) and all(p.count("Generate explode") < 3 for p in plans)
    again = ledger.recorded(spark, d)
    assert sorted(again.standing.inputFiles()) == sorted(run.standing.inputFiles())


def test_fleets_have_tasks_of_their_own(spark):
    """Fleets with numbers that follow one another lie in as many tasks, whatever their hashes; in any order of fleets each has its own chain."""
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        rows = [(f, t, "Tick", "tick", t, *[None] * 6) for t in range(30) for f in range(8)]
        made = L.appended(spark.createDataFrame(rows, EVENTS).withColumn("order", F.struct("at_ms", "n1")))
        assert made.select(F.spark_partition_id().alias("p"), "fleet").distinct().groupBy("p").count().where("count > 1").count() == 0
        assert L.unchained(made).count() == 0 and {(x.fleet, x.seq) for x in made.where("seq = at_ms + 1").collect()} == {(f, t + 1) for f in range(8) for t in range(30)}
        few = L.appended(made.where("fleet is null or at_ms < 3").select(F.when(F.col("fleet") > 4, F.col("fleet")).alias("fleet"), *L.MEMBERS, F.struct("at_ms", F.col("fleet").alias("of")).alias("order")))
        assert {(x.fleet, x.n) for x in few.groupBy("fleet").agg(F.max("seq").alias("n")).collect()} == {(None, 15), (5, 3), (6, 3), (7, 3)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
