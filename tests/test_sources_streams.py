"""Sources, sinks and streams: round trips, and streaming equal to batch."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from vigil.operators import sequence as S
from vigil.sources import exports as X
from vigil.streaming import pipeline as P


def test_bundle(spark, tmp_path):
    good = {"inventory": 3, "steps": [{"policy": "p", "offers": ["a", "b"], "accepted": "a", "subject": "u"}, {"subject": "u"}, {"policy": "q"}]}
    steps = json.dumps(good["steps"], sort_keys=True, separators=(",", ":"))
    good["digest"] = hashlib.sha256(b"BUNDLE/1\0" + steps.encode()).hexdigest()
    (tmp_path / "b.json").write_text(json.dumps(good))
    rows = sorted((r.step, r.position, r.kind, r.policy_hash, r.scope_hash) for r in X.bundle(spark, str(tmp_path / "b.json")).collect())
    assert [r[:3] for r in rows] == [(0, 0, "scope"), (0, 1, "scope"), (0, 2, "scope"), (0, 3, "scope"), (1, 0, "pulse"), (2, 0, "pulse")]
    assert rows[0][3] == "p" and [r[4] for r in rows[1:4]] == ["a", "b", "a"]
    (tmp_path / "bad.json").write_text(json.dumps(good | {"inventory": 9}))
    assert [r.kind for r in X.bundle(spark, str(tmp_path / "bad.json")).collect()] == ["coverage"]
    (tmp_path / "other.json").write_text(json.dumps(good | {"digest": "0" * 64}))
    assert [r.kind for r in X.bundle(spark, str(tmp_path / "other.json")).collect()] == ["coverage"]


def test_entries(spark, tmp_path):
    form = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"))
    body = lambda i: {"v": 1, "fleet": "f", "source": "s", "seq": str(i), "prev": "", "observed_ms": "5", "observation": {"kind": "pulse", "subject": "u"}}
    entry = lambda i, **m: form({"body": body(i), "hash": hashlib.sha256(b"SOURCE/1\0" + form(body(i)).encode()).hexdigest(), "sig": "g"} | m)
    text = [entry(1), '{"body":1,"body":2}', "", "{} x", entry(2, hash="0" * 64), '{"body":{}}', *(entry(i) for i in range(3, 9))]
    (tmp_path / "e.ndjson").write_text("\n".join(text))
    found = X.entries(spark, str(tmp_path / "e.ndjson"))
    rows = found.orderBy("line").collect()
    assert [r.error for r in rows] == [None, "PARSE_INVALID", "PARSE_INVALID", "HASH_MISMATCH", "INVALID_INPUT", *[None] * 6] and [r.line for r in rows] == list(range(11))
    assert rows[0].entry.body.observation.kind == "pulse" and rows[1].entry is None
    assert [(r.batch, r.position) for r in X.requests(found, 3).where("valid").orderBy("line").collect()] == [(i // 3, i % 3) for i in range(7)]


def test_stream_equals_batch(spark, tmp_path):
    r, rows = random.Random(3), []
    for s in range(8):
        seqs = list(range(1, 12))
        r.shuffle(seqs)
        rows += [(f"s{s}", q, f"h{q}" if r.random() < 0.97 else "fork", f"h{q - 1}", 100 * i, i, False) for i, q in enumerate(seqs + seqs[:3])]
    ddl = "source string, seq long, hash string, prev string, arrival_ms long, arrival long, terminal boolean"
    for part in range(3):  # three files in order of arrival
        some = [x for x in rows if x[5] // 5 == part or (part == 2 and x[5] // 5 > 2)]
        spark.createDataFrame(some, ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = P.admit_stream(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out"))
    assert q.awaitTermination(180)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("source", "arrival", "seq", "status", "state", "at_ms").collect()))
    batch = S.admit(spark.createDataFrame(rows, ddl)).select("source", "arrival", "seq", "status", "state", "at_ms")
    assert got == sorted(map(tuple, batch.collect()))
    q = P.steps_stream(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start(str(tmp_path / "steps"))
    assert q.awaitTermination(180)
    told = S.judged(spark.read.parquet(str(tmp_path / "steps"))).select("source", "arrival", "seq", "status", "state", "at_ms")
    assert got == sorted(map(tuple, told.collect()))


def test_finalised_windows(spark, tmp_path):
    rows = [(i, i * 5000, i % 2, 10 * i) for i in range(600)]  # 50 windows of 60 s in 25 batches
    ddl = "idx long, received_ms long, source int, delta long"
    read = []

    def evaluate(obs):
        found = obs.groupBy((F.col("received_ms") - F.col("received_ms") % 60000).alias("start_ms")).agg(F.sum("delta").alias("total"))
        read.append(len(obs.inputFiles()))
        return found

    sink = P.finalised(evaluate, str(tmp_path / "store"), str(tmp_path / "results"), before=3)
    for part in range(25):
        batch = spark.createDataFrame(rows[part * 24 : part * 24 + 24], ddl).coalesce(1)
        sink(batch, part)
        if part == 7:
            sink(batch, part)  # a repeated batch changes nothing
    assert max(read[5:]) <= 5 and read[-1] <= read[5]  # the last batch reads no more than early ones
    got = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "results"))
    want = {r.start_ms: r.total for r in evaluate(spark.createDataFrame(rows, ddl)).collect() if r.start_ms < 49 * 60000}  # the last one is still open
    assert sorted(map(tuple, got.select("start_ms", "total").collect())) == sorted(want.items())


def test_finalised_stream(spark, tmp_path):
    rows = [(i, i * 1000, i % 2, 10 * i) for i in range(300)]
    ddl = "idx long, received_ms long, source int, delta long"
    for part in range(3):
        spark.createDataFrame(rows[part * 100 : part * 100 + 100], ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def evaluate(obs):
        return obs.groupBy((F.col("received_ms") - F.col("received_ms") % 60000).alias("start_ms")).agg(F.sum("delta").alias("total"))

    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sink = P.finalised(evaluate, str(tmp_path / "store"), str(tmp_path / "results"))
    assert stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(180)
    got = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "results"))
    want = evaluate(spark.createDataFrame(rows, ddl)).where("start_ms < 240000")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_running_totals(spark, tmp_path):
    rows = [(f"2024-01-01 00:{i // 6:02d}:{i % 6 * 10:02d}", i % 2, i) for i in range(60)]
    spark.createDataFrame(rows, "t string, source int, delta long").selectExpr("cast(t as timestamp) as received_ts", "source", "delta").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("received_ts timestamp, source int, delta long").parquet(str(tmp_path / "in"))
    q = P.running_totals(stream).writeStream.format("memory").queryName("running").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    got = {(r.w.minute, r.source): (r.total, r.n) for r in spark.table("running").selectExpr("window.start as w", "source", "total", "n").collect()}
    want = {}
    for i in range(60):
        t, n = want.get((i // 6, i % 2), (0, 0))
        want[i // 6, i % 2] = (t + i, n + 1)
    assert got == want


def test_pages_are_sent_by_executors(spark, tmp_path):
    df = spark.createDataFrame([(f"r{i}", "page") for i in range(10)], "result string, page string")
    P.send_pages(lambda result, page: 204 if result != "r3" else 503, str(tmp_path / "log"))(df, 0)
    got = {r.result: r.status for r in spark.read.parquet(str(tmp_path / "log/batch=0")).collect()}
    assert got["r3"] == 503 and len(got) == 10
