"""Manifests of windows with many inputs, and cuts of records whose numbers run against their times."""

import hashlib
import json

from vigil.operators import fleet as V
from vigil.plans import ORACLE, QUERIES

RECORD = "fleet long, epoch long, start_ms long, source long, idx long, received_ms long, kind string, pending long, complete boolean, hash string, late boolean"
SOURCES = "fleet long, epoch long, source long, key_id string, meter boolean, enabled boolean, revoked boolean, activated_ms long"


def record(idx, ms, kind="signal", pending=0, complete=True):
    return 0, 1, ms - ms % 60_000, 1, idx, ms, kind, pending, complete, hashlib.sha256(str(idx).encode()).hexdigest(), False


def test_a_window_has_any_number_of_inputs(spark):
    """5000 inputs in the first window, none in the second, 2 in the third: each has a manifest, which names those before."""
    records = [record(i, i) for i in range(5000, 0, -1)] + [record(6001, 120_001), record(6000, 120_002)]
    rows = spark.createDataFrame(records, RECORD).repartition(5)
    windows = spark.createDataFrame([(0, 1, t, t + 60_000) for t in (0, 60_000, 120_000)], "fleet long, epoch long, start_ms long, end_ms long")
    sources = spark.createDataFrame([(0, 1, 1, "k", False, True, False, 0)], SOURCES)
    got = {x.start_ms: x for x in V.manifests(rows, windows, V.cuts(rows, windows, sources)).collect()}
    history = []
    for t, through in ((0, 5000), (60_000, 5000), (120_000, 6001)):
        mine = sorted((r for r in records if r[2] == t), key=lambda r: r[4])
        last = max((r for r in records if r[2] <= t), key=lambda r: r[4])
        cut = {"activated_ms": "0", "complete": True, "head": {"hash": last[9], "seq": str(sum(r[2] <= t for r in records))}, "last_input": None, "last_received_ms": None, "source": 1, "state": "ACTIVE"}
        body = {"config": "0/1", "cuts": [cut], "end_ms": t + 60_000, "fleet": 0, "history": history, "inputs": [r[9] for r in mine], "quality": "COMPLETE", "start_ms": t, "through_index": str(through), "v": 1}
        text = json.dumps(body, sort_keys=True, separators=(",", ":"))
        assert (got[t].hash, got[t].history, got[t].n_inputs) == (hashlib.sha256(b"MANIFEST/1\0" + text.encode()).hexdigest(), history, len(mine))
        history = [*history, got[t].hash]


def test_cuts_hold_what_has_the_highest_number(spark):
    """A later window's records have lower numbers: the head, the gap and the coverage stay."""
    records = [record(9, 10, "gap", pending=3), record(8, 20, "coverage", complete=False), record(7, 30, "spend"), record(3, 60_010, "gap"), record(2, 60_020, "coverage"), record(1, 60_030, "spend")]
    windows = spark.createDataFrame([(0, 1, t, t + 60_000) for t in (0, 60_000)], "fleet long, epoch long, start_ms long, end_ms long")
    sources = spark.createDataFrame([(0, 1, 1, "k", False, True, False, 0)], SOURCES)
    for x in V.cuts(spark.createDataFrame(records, RECORD), windows, sources).collect():
        assert (x.pending, x.complete, x.state, x.head_hash, x.last_input, x.last_idx) == (3, False, "GAPPED", record(8, 0)[9], record(8, 0)[9], 8)


def test_copied_events_have_the_manifests_of_the_sql(spark, tmp_path):
    """Events sixty times over with other numbers at the same times."""
    import duckdb

    c = duckdb.connect()
    c.execute("create table events as select e.* replace (event_id + k * 1000 as event_id, user_id + k * 1500 as user_id) from range(60) t(k), '/root/testdata/sf0.001/events.parquet' e")
    c.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    got = QUERIES["P05_manifest"](spark, str(tmp_path))
    want = c.execute(ORACLE["P05_manifest"])
    columns = [x[0] for x in want.description]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())


def test_inputs_of_windows_that_are_not_there_are_left_out(spark):
    """Whichever way the stream is cut into batches."""
    made = spark.createDataFrame([(0, 1, t, 1, "COMPLETE", f"h{t}", f"t{t}") for t in (0, 20, 40)], "fleet long, epoch long, start_ms long, n_inputs long, quality string, head string, tail string")
    inputs = spark.createDataFrame([(0, e, t, i, f'"{e}/{t}/{i}"') for e in (1, 2) for t in (0, 10, 40, 50) for i in range(5)], "fleet long, epoch long, start_ms long, idx long, head string")
    history, want = [], {}
    for t in (0, 20, 40):
        ids = ",".join(f'"1/{t}/{i}"' for i in range(5)) if t != 20 else ""
        names = ",".join(json.dumps(x) for x in history)
        want[t] = hashlib.sha256(f'MANIFEST/1\0h{t},"history":[{names}],"inputs":[{ids}],t{t}'.encode()).hexdigest()
        history = [*history, want[t]][-5:]
    for size in ("1", "3", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            assert {x.start_ms: x.hash for x in V._with_history(made, inputs, 5).collect()} == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
