"""Life cycles by time: each rule, the batch against the stream with timers, restarts, and requests that are forgotten."""

import random

import pytest
from pyspark.sql import functions as F

from vigil.functions.params import DEFAULT, Params
from vigil.operators import clocked, journal
from vigil.streaming import timers

EVENTS = "key string, at_ms long, seq long, verb string, n1 long, n2 long"


def told(spark, cycle, events, until=None, p=DEFAULT):
    rows = [("k", at, i, verb, *[*more, None, None][:2]) for i, (at, verb, *more) in enumerate(events)]
    return [(r.at_ms, r.what, r.state) for r in clocked.lived(spark.createDataFrame(rows, EVENTS), cycle, until, p).collect()]


def test_alerts(spark):
    assert told(spark, clocked.Alert, [(0, "CREATE", 100), (50, "ACKNOWLEDGE"), (100, "CORROBORATE")]) == [(0, "CANDIDATE", "CANDIDATE"), (50, "REFUSED", "CANDIDATE"), (100, "EXPIRED", "EXPIRED"), (100, "REFUSED", "EXPIRED")]
    assert told(spark, clocked.Alert, [(0, "CREATE", 100), (99, "CORROBORATE"), (500, "ACKNOWLEDGE"), (600, "CLOSE")], 10**6)[-1] == (600, "CLOSED", "CLOSED")
    assert told(spark, clocked.Alert, [(0, "CREATE", 100)], 99) == [(0, "CANDIDATE", "CANDIDATE")] and told(spark, clocked.Alert, [(0, "CREATE", 100)], 100)[-1][1] == "EXPIRED"


def test_pages(spark):
    got = told(spark, clocked.Page, [(0, "QUEUE"), (500, "DONE", 1, 503), (1700, "DONE", 2, None), (1800, "DONE", 2, 204), (3700, "DONE", 3, 204)])
    assert got == [(0, "QUEUED", "QUEUED"), (0, "SEND", "IN_FLIGHT"), (500, "RETRY", "RETRY"), (1500, "SEND", "IN_FLIGHT"), (1700, "RETRY", "RETRY"), (1800, "REFUSED", "RETRY"), (3700, "SEND", "IN_FLIGHT"), (3700, "DELIVERED", "DELIVERED")]
    alone = told(spark, clocked.Page, [(0, "QUEUE")], 10**7)  # no answer ever: each lease ends and the page is due again
    assert [x for x in alone if x[1] == "SEND"] == [(30_000 * i, "SEND", "IN_FLIGHT") for i in range(8)] and alone[-1] == (240_000, "LEASE_ENDED", "FAILED")
    assert told(spark, clocked.Page, [(0, "QUEUE"), (10, "CANCEL"), (20, "DONE", 1, 503)])[-1] == (20, "CANCELLED", "CANCELLED") and told(spark, clocked.Page, [(0, "QUEUE"), (10, "CANCEL"), (20, "DONE", 1, 200)])[-1][2] == "DELIVERED"
    assert told(spark, clocked.Page, [(0, "QUEUE"), (10, "DONE", 1, 404)])[-1][2] == "FAILED" and told(spark, clocked.Page, [(0, "QUEUE"), (10, "DONE", 1, 429), (20, "CANCEL")])[-1][2] == "CANCELLED"


def test_subscriptions(spark):
    lease = DEFAULT.subscription_ms
    steps = [
        (0, "READ", 0, 5, "NOT_FOUND"), (0, "OPEN", 10, None, "OPEN"), (1, "OPEN", 3, None, "STATE_CONFLICT"), (2, "READ", 9, 20, "CURSOR_INVALID"), (3, "READ", 10, 20, "READ"), (4, "ACK", 21, None, "CURSOR_INVALID"), (5, "ACK", 15, None, "ACK"),
        (6, "ACK", 14, None, "CURSOR_INVALID"), (7, "ACK", 15, None, "ACK"), (8, "PAUSE", 1, None, "REVISION_CONFLICT"), (9, "PAUSE", 2, None, "PAUSE"), (10, "READ", 15, 30, "STATE_CONFLICT"), (11, "RESUME", 3, None, "RESUME"), (12, "READ", 15, 18, "READ"),
        (13, "ACK", 19, None, "CURSOR_INVALID"), (14, "RESUME", 4, None, "STATE_CONFLICT"), (12 + lease, "READ", 15, 18, "STATE_CONFLICT"), (13 + lease, "OPEN", 18, None, "OPEN"), (14 + lease, "CLOSE", 1, None, "CLOSE"), (15 + lease, "OPEN", 1, None, "OPEN"),
    ]
    got = told(spark, clocked.Subscription, [s[:4] for s in steps])
    assert [x[1] for x in got if x[1] != "EXPIRED"] == [s[4] for s in steps] and [x for x in got if x[1] == "EXPIRED"] == [(12 + lease, "EXPIRED", "EXPIRED")]


def events(kind, seed):
    """Events of some keys in order of time, in parts."""
    r, out, at, revision = random.Random(seed), [], 0, {}
    for i in range(240):
        at, k = at + r.choice([0, 1, 50, 700, 9000]), f"k{r.randrange(9)}"
        verb = r.choice({"Alert": ["CREATE", "CORROBORATE", "ACKNOWLEDGE", "CLOSE"], "Page": ["QUEUE", "DONE", "DONE", "DONE", "CANCEL"], "Subscription": ["OPEN", "READ", "READ", "ACK", "PAUSE", "RESUME", "CLOSE"]}[kind])
        n1 = {"CREATE": at + r.choice([10, 20_000, 100_000]), "DONE": r.randint(1, 4), "OPEN": 5, "READ": r.randint(4, 9), "ACK": r.randint(4, 9)}.get(verb, r.randint(1, 4))
        out.append((k, at, i, verb, n1, r.choice([None, 204, 404, 503, 503]) if kind == "Page" else n1 + 3))
    return out + [("last", at + 40_000_000, 999, "NOTHING", 1, 1)]


@pytest.mark.parametrize("kind", ["Alert", "Page", "Subscription"])
def test_stream_equals_batch_after_a_restart(spark, tmp_path, kind):
    cycle, rows = getattr(clocked, kind), events(kind, 4)
    timers.with_state_store(spark)
    started = 0
    for lo, hi in [(0, 80), (80, 160), (160, len(rows))]:
        spark.createDataFrame(rows[lo:hi], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = timers.lived(stream, cycle).writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out"))
        assert q.awaitTermination(240)
        started += 1
    got = sorted((r.key, r.at_ms, r.seq or -1, r.what, r.state, r.n1, r.n2, r.revision) for r in spark.read.parquet(str(tmp_path / "out")).where("key <> 'last'").collect())
    batch = clocked.lived(spark.createDataFrame(rows, EVENTS).repartition(3), cycle, rows[-1][1] - 1).where("key <> 'last'")
    want = sorted((r.key, r.at_ms, r.seq or -1, r.what, r.state, r.n1, r.n2, r.revision) for r in batch.collect())
    assert [tuple(map(str, x)) for x in got] == [tuple(map(str, x)) for x in want] and started == 3
    assert any(x[2] == -1 for x in want)


REQUESTS = "key_id long, request_id string, request_hash string, sent_ms long, at_ms long, seq long"


def test_requests(spark, tmp_path):
    day, rows = 1000, []
    for i, (request, hash_, sent, at) in enumerate([
        ("a", "x", -100, 0), ("a", "x", 5, 5), ("a", "y", 6, 6), ("a", "x", 6, 1005), ("a", "y", 6, 1006), ("a", "x", 6, 1006), ("b", "x", 900, 1010), ("b", "x", 1011, 1011), ("a", "x", 6, 1500), ("a", "x", 6, 5000), ("b", "q", 9000, 9000), ("c", "x", 20_000, 20_000),
    ]):
        rows += [(k, request, hash_, sent + 10**6, at + 10**6, 100 * k + i) for k in (1, 2)]
    want = ["STALE", "NEW", "CONFLICT", "REPLAY", "CONFLICT", "EXPIRED", "STALE", "NEW", "EXPIRED", "EXPIRED", "CONFLICT", "NEW"]
    df = spark.createDataFrame(rows, REQUESTS)
    got = journal.once_a_day(df, day, 60).where("key_id = 1").orderBy("seq").collect()
    assert [r.outcome for r in got] == want
    timers.with_state_store(spark)
    for lo in range(0, len(rows), 4):
        spark.createDataFrame(rows[lo : lo + 4], REQUESTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(REQUESTS).parquet(str(tmp_path / "in"))
        q = timers.once_a_day(stream, day, 60).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out"))
        assert q.awaitTermination(240)
    told_ = {r.seq: r.outcome for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # what is forgotten after twice the time is stale to whoever sends it then, and new to who sends it freshly
    assert [told_[100 + i] for i in range(12)] == [*want[:9], "STALE", "NEW", "NEW"] and [told_[200 + i] for i in range(12)] == [told_[100 + i] for i in range(12)]
    assert journal.once_a_day(df.where(F.lit(False))).count() == 0
