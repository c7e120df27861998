"""The life cycles of ``operators.clocked`` as streams with event-time timers, and requests whose state ends with time.

State is typed and Spark keeps it for each key (RocksDB); a timer stands at each key's deadline and fires when
the watermark has passed it, so a key to which nothing happens changes as well.  A restarted query goes on
from its checkpoint.  The session needs the RocksDB state store (``with_state_store``).

Defined cases: as in the batch.  Times are receive times, which never go back, so no event lies behind the watermark,
which is a millisecond behind the latest event; if one does all the same (a clock that isn't the fleet's), Spark drops it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from vigil.functions.params import DEFAULT, Params
from vigil.operators import clocked

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


def _frame(rows: list[dict], schema: StructType) -> pd.DataFrame:
    kinds = {"long": "Int64", "bigint": "Int64", "boolean": "boolean", "string": "object"}
    return pd.DataFrame(rows, columns=schema.fieldNames()).astype({f.name: kinds[f.dataType.simpleString()] for f in schema})


def _number(x):
    return None if pd.isna(x) else int(x)


class Cycle(StatefulProcessor):
    """Runs a life cycle for each key."""

    def __init__(self, cycle: Callable, p: Params):
        self.cycle, self.p = cycle, p

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.cycle.fields)

    def _load(self):
        held = self.state.get() if self.state.exists() else None
        return self.cycle(self.p, None if held is None else tuple(held))

    def _store(self, cycle) -> None:
        self.state.update(cycle.dump())
        at = cycle.deadline()
        timers = [t for t in self.handle.listTimers()]
        for t in timers:
            if t != at:
                self.handle.deleteTimer(t)
        if at is not None and at not in timers:
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        cycle, out = self._load(), []
        every = pd.concat(list(rows), ignore_index=True).sort_values(["at_ms", "seq"])
        for e in every.to_dict("records"):
            e = {c: _number(e[c]) if c in ("at_ms", "seq", "n1", "n2") else e[c] for c in ("at_ms", "seq", "verb", "n1", "n2")}
            out += clocked.stepped(key[0], cycle, e)
        self._store(cycle)
        yield _frame(out, clocked.TOLD)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        cycle = self._load()
        out = [clocked.row(key[0], cycle, None, t) for t in cycle.advance(expiredTimerInfo.getExpiryTimeInMs())]
        self._store(cycle)
        yield _frame(out, clocked.TOLD)

    def close(self) -> None:
        pass


def lived(events: DataFrame, cycle: Callable, p: Params = DEFAULT, delay: str = "1 milliseconds") -> DataFrame:
    """A stream of what happens to each key.  events: of ``clocked.EVENT``; at_ms is the event time."""
    with_state_store(events.sparkSession)
    rows = events.withColumn("_at", F.timestamp_millis("at_ms")).withWatermark("_at", delay)
    rows = rows.select(F.col("key").cast("string").alias("key"), "at_ms", "seq", "verb", "n1", "n2", "_at")
    return rows.groupBy("key").transformWithStateInPandas(Cycle(cycle, p), clocked.TOLD, "Append", "EventTime")


OUTCOMES = StructType().add("key_id", "long").add("request_id", "string").add("seq", "long").add("outcome", "string")
_KEPT = StructType().add("hash", "string").add("at_ms", "long")


class Requests(StatefulProcessor):
    """What each request of a key meets, as ``operators.journal.once_a_day`` says.  A request's content is known for its time to
    live; then it is a tombstone (EXPIRED) for as long again, and then it is forgotten: whoever sends it so late is STALE."""

    def __init__(self, ttl_ms: int, fresh_ms: int):
        self.ttl, self.fresh = ttl_ms, fresh_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getMapState("known", StructType().add("request_id", "string"), _KEPT)

    def _outcome(self, r: dict) -> str:
        held = self.known.getValue((r["request_id"],)) if self.known.containsKey((r["request_id"],)) else None
        if held is not None and r["at_ms"] - held[1] <= 2 * self.ttl:
            return "CONFLICT" if held[0] != r["request_hash"] else "EXPIRED" if r["at_ms"] - held[1] > self.ttl else "REPLAY"
        if abs(r["sent_ms"] - r["at_ms"]) > self.fresh:
            return "STALE"
        self.known.updateValue((r["request_id"],), (r["request_hash"], r["at_ms"]))
        return "NEW"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows), ignore_index=True).sort_values(["at_ms", "seq"])
        out = [{"key_id": key[0], "request_id": r["request_id"], "seq": r["seq"], "outcome": self._outcome(r)} for r in every.to_dict("records")]
        if not list(self.handle.listTimers()):
            self.handle.registerTimer(int(every["at_ms"].max()) + self.ttl)
        yield _frame(out, OUTCOMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Forget what has been a tombstone long enough."""
        now, left = expiredTimerInfo.getExpiryTimeInMs(), False
        for (request,), (_, at) in list(self.known.iterator()):
            if now - at > 2 * self.ttl:
                self.known.removeKey((request,))
            else:
                left = True
        if left:
            self.handle.registerTimer(now + self.ttl)
        yield _frame([], OUTCOMES)

    def close(self) -> None:
        pass


def once_a_day(requests: DataFrame, ttl_ms: int = 86_400_000, fresh_ms: int = 60_000, delay: str = "1 milliseconds") -> DataFrame:
    """A stream of (key_id, request_id, seq, outcome).  requests: key_id, request_id, request_hash, sent_ms, at_ms, seq."""
    with_state_store(requests.sparkSession)
    rows = requests.withColumn("_at", F.timestamp_millis("at_ms")).withWatermark("_at", delay)
    return rows.groupBy("key_id").transformWithStateInPandas(Requests(ttl_ms, fresh_ms), OUTCOMES, "Append", "EventTime")
