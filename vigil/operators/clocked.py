"""Life cycles in which time alone changes things: alerts that expire, pages that are due or whose lease
ends, subscriptions whose lease ends.

A life cycle is a class with a typed state: ``advance`` lets pass what is due up to a time, ``take`` applies an event,
and ``deadline`` tells when something is due next.  Before an event, everything due until then passes, so the outcome
doesn't depend on when a timer fires; in a stream a timer only sees to keys to which nothing happens.  Both
the batch (``lived``, which streams a key's events in order) and the stream (``vigil.streaming.timers``) use the
same classes.

Defined cases: no events give no rows; an event of an unknown verb is REFUSED and changes nothing; null
keys are one key; events of one time are taken in order of seq.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vigil.functions.params import DEFAULT, Params

#: key, at_ms, seq: of an event; verb; and up to three numbers and a text, by verb
EVENT = ("key", "at_ms", "seq", "verb", "n1", "n2", "text")
#: what happened, when it did, and the numbers that go with it; seq is null where time did it
TOLD = (
    StructType().add("key", "string").add("seq", "long").add("at_ms", "long").add("what", "string").add("state", "string").add("n1", "long").add("n2", "long").add("revision", "long")
)


class Alert:
    """CREATE (n1: expiry), CORROBORATE, ACKNOWLEDGE, CLOSE: a candidate expires when its time has come."""

    fields = StructType().add("state", "string").add("expires", "long").add("revision", "long")
    moves = {("CORROBORATE", "CANDIDATE"): "CORROBORATED", ("ACKNOWLEDGE", "CORROBORATED"): "ACKNOWLEDGED", **{("CLOSE", s): "CLOSED" for s in ("CANDIDATE", "CORROBORATED", "ACKNOWLEDGED")}}

    def __init__(self, p: Params, state: tuple | None):
        self.state, self.expires, self.revision = state or ("NONE", 0, 0)

    def dump(self) -> tuple:
        return self.state, self.expires, self.revision

    def deadline(self) -> int | None:
        return self.expires if self.state == "CANDIDATE" else None

    def advance(self, now: int) -> Iterator[dict]:
        if self.state == "CANDIDATE" and self.expires <= now:
            self.state, self.revision = "EXPIRED", self.revision + 1
            yield {"at_ms": self.expires, "what": "EXPIRED"}

    def take(self, e: dict) -> dict:
        to = self.moves.get((e["verb"], self.state))
        if e["verb"] == "CREATE" and self.state == "NONE":
            self.state, self.expires, self.revision = "CANDIDATE", e["n1"], 1
        elif to:
            self.state, self.revision = to, self.revision + 1
        else:
            return {"what": "REFUSED"}
        return {"what": self.state}


class Page:
    """QUEUE, DONE (n1: attempt, n2: status or null), CANCEL.  A queued page, and one to retry, is sent (SEND, n1:
    attempt) when it is due, under a lease; when the lease ends without an answer it is due again, or has FAILED with the
    last attempt.  A page that is cancelled in flight is cancelled for good unless its answer says that it was delivered."""

    fields = StructType().add("state", "string").add("attempts", "long").add("when", "long").add("cancel", "boolean").add("revision", "long")

    def __init__(self, p: Params, state: tuple | None):
        self.state, self.attempts, self.when, self.cancel, self.revision = state or ("NONE", 0, 0, False, 0)
        self.delays, self.lease = p.retry_ms, p.lease_ms

    def dump(self) -> tuple:
        return self.state, self.attempts, self.when, self.cancel, self.revision

    def deadline(self) -> int | None:
        return self.when if self.state in ("QUEUED", "RETRY", "IN_FLIGHT") else None

    def _to(self, state: str, when: int = 0) -> None:
        self.state, self.when, self.revision = state, when, self.revision + 1

    def advance(self, now: int) -> Iterator[dict]:
        while (at := self.deadline()) is not None and at <= now:
            if self.state == "IN_FLIGHT":
                self._to("CANCELLED" if self.cancel else "RETRY" if self.attempts <= len(self.delays) else "FAILED", at)
                yield {"at_ms": at, "what": "LEASE_ENDED", "n1": self.attempts}
            else:
                self.attempts += 1
                self._to("IN_FLIGHT", at + self.lease)
                yield {"at_ms": at, "what": "SEND", "n1": self.attempts, "n2": self.when}

    def take(self, e: dict) -> dict:
        status = e["n2"]
        if e["verb"] == "QUEUE" and self.state == "NONE":
            self._to("QUEUED", e["at_ms"])
        elif e["verb"] == "CANCEL" and self.state in ("QUEUED", "RETRY"):
            self._to("CANCELLED")
        elif e["verb"] == "CANCEL" and self.state == "IN_FLIGHT":
            self.cancel = True
        elif e["verb"] == "DONE" and self.state == "IN_FLIGHT" and e["n1"] == self.attempts:
            if status is not None and 200 <= status < 300:
                self._to("DELIVERED")
            elif self.cancel:
                self._to("CANCELLED")
            elif (status is None or status == 429 or status >= 500) and self.attempts <= len(self.delays):
                self._to("RETRY", e["at_ms"] + self.delays[self.attempts - 1])
            else:
                self._to("FAILED")
        else:
            return {"what": "REFUSED"}
        return {"what": self.state, "n1": self.attempts, "n2": self.when if self.state == "RETRY" else None}


class Subscription:
    """OPEN (n1: after), READ (n1: after, n2: the page's end), ACK (n1: through), PAUSE, RESUME and CLOSE (n1: the revision that is
    expected).  A read begins within what is acknowledged and delivered; both may go back to where a reader begins
    again, but acknowledgement doesn't.  Each use renews the lease, whose end expires the subscription; it can be opened again."""

    fields = StructType().add("state", "string").add("ack", "long").add("delivered", "long").add("lease", "long").add("revision", "long")
    moves = {("PAUSE", "ACTIVE"): "PAUSED", ("RESUME", "PAUSED"): "ACTIVE", ("CLOSE", "ACTIVE"): "CLOSED", ("CLOSE", "PAUSED"): "CLOSED"}

    def __init__(self, p: Params, state: tuple | None):
        self.state, self.ack, self.delivered, self.lease, self.revision = state or ("NONE", 0, 0, 0, 0)
        self.ms = p.subscription_ms

    def dump(self) -> tuple:
        return self.state, self.ack, self.delivered, self.lease, self.revision

    def deadline(self) -> int | None:
        return self.lease if self.state in ("ACTIVE", "PAUSED") else None

    def advance(self, now: int) -> Iterator[dict]:
        if (at := self.deadline()) is not None and at <= now:
            self.state, self.revision = "EXPIRED", self.revision + 1
            yield {"at_ms": at, "what": "EXPIRED"}

    def take(self, e: dict) -> dict:
        verb, n, what = e["verb"], e["n1"], None
        live = self.state in ("ACTIVE", "PAUSED")
        if verb == "OPEN":
            what = "STATE_CONFLICT" if live else None
            if not what:
                self.state, self.ack, self.delivered, self.revision = "ACTIVE", n, n, 1
        elif self.state == "NONE":
            what = "NOT_FOUND"
        elif verb in ("READ", "ACK"):
            what = "STATE_CONFLICT" if self.state != "ACTIVE" else None if n is not None and self.ack <= n <= self.delivered else "CURSOR_INVALID"
            if not what and verb == "READ":
                self.delivered = e["n2"]
            elif not what:
                self.revision += n > self.ack
                self.ack = n
        elif n != self.revision:
            what = "REVISION_CONFLICT"
        else:
            to = self.moves.get((verb, self.state))
            what = None if to else "STATE_CONFLICT"
            if to:
                self.state, self.revision = to, self.revision + 1
        if what:
            return {"what": what, "n1": self.ack, "n2": self.delivered}
        if verb != "CLOSE":
            self.lease = e["at_ms"] + self.ms
        return {"what": verb, "n1": self.ack, "n2": self.delivered}


def row(key: str | None, cycle, seq: int | None, told: dict, at: int | None = None) -> dict:
    return {"key": key, "seq": seq, "at_ms": told.get("at_ms", at), "what": told["what"], "state": cycle.state, "n1": told.get("n1"), "n2": told.get("n2"), "revision": cycle.revision}


def stepped(key: str | None, cycle, e: dict) -> Iterator[dict]:
    """What an event brings: first what was due before it."""
    for told in cycle.advance(e["at_ms"]):
        yield row(key, cycle, None, told)
    yield row(key, cycle, e["seq"], cycle.take(e), e["at_ms"])


def lived(events: DataFrame, cycle: Callable, until_ms: int | None = None, p: Params = DEFAULT) -> DataFrame:
    """What happens to each key, in the form of ``TOLD``, up to its last event or to ``until_ms``; a key's events are
    one stream and its state is all that is held."""
    rows = events.select(F.col("key").cast("string").alias("key"), *(F.col(c).cast("long").alias(c) for c in ("at_ms", "seq")), "verb", *(F.col(c).cast("long").alias(c) for c in ("n1", "n2")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, key, now = to_arrow_schema(TOLD), None, None
        for batch in batches:
            out = []
            for e in batch.to_pylist():
                if now is None or e["key"] != key:
                    if now is not None and until_ms is not None:
                        out += [row(key, now, None, t) for t in now.advance(until_ms)]
                    key, now = e["key"], cycle(p, None)
                out += stepped(key, now, e)
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if now is not None and until_ms is not None:
            yield pa.RecordBatch.from_pylist([row(key, now, None, t) for t in now.advance(until_ms)], schema=schema)

    return rows.repartition("key").sortWithinPartitions("key", "at_ms", "seq").mapInArrow(run, TOLD)


def latest(told: DataFrame) -> DataFrame:
    """(key, state, n1, n2, revision, refused): each key as it stands after what was told of it."""
    order = F.struct(F.col("at_ms"), F.coalesce("seq", F.lit(-1).cast("long")), "revision")
    refused = F.col("what").isin("REFUSED", "STATE_CONFLICT", "CURSOR_INVALID", "REVISION_CONFLICT", "NOT_FOUND")
    return told.groupBy("key").agg(F.max_by("state", order).alias("state"), F.max("revision").alias("revision"), F.count_if(refused).alias("refused"))
