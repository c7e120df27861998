"""Admission of batches of entries: all of a batch or nothing, in the order of the rules.

Every entry of a batch is checked before any is applied; what fails later undoes the batch.  One
exception keeps what was applied: an entry that follows the head but names another predecessor is
evidence, so it and what came before it in the batch stay.

The fold streams a source's batches in order and holds the head, the at most ``gap`` buffered
entries, and of slots and usage ids only those that another hash, or another entry, claims somewhere in
the table: which these are is found by grouping before, and about the others nothing has to be remembered,
as a slot up to the head holds the one hash there is.  Its memory doesn't grow with the source.

Defined cases: no entries give no rows; a null error is none; a null usage id is no usage; a batch that isn't
strictly ascending in seq is INVALID_INPUT; entries of equal source, batch and position are taken by seq and hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vigil.functions.params import DEFAULT, Params

GIVEN = ("source", "batch", "position", "seq", "hash", "prev", "terminal", "error", "usage_id", "payload", "contested", "shared_usage")
#: status: ACCEPTED, DRAINED (an entry of an earlier batch), BUFFERED, DUPLICATE, FORK, NOT_APPLIED, or REJECTED with the batch's error
TOLD = (
    StructType().add("source", "string").add("batch", "long").add("seq", "long").add("hash", "string").add("status", "string").add("counted", "boolean")
    .add("error", "string").add("state", "string").add("head", "long").add("pending", "integer")
)


class Refused(Exception):
    """A batch's error; ``kept`` if what was applied so far stays."""

    def __init__(self, code: str, kept: bool = False):
        super().__init__(code)
        self.code, self.kept = code, kept


class Source:
    """A source's state, and what a batch does to it."""

    def __init__(self, gap: int):
        self.gap, self.state, self.head, self.hash = gap, "EMPTY", 0, ""
        self.pending: dict[int, dict] = {}
        self.slots: dict[int, set[str]] = {}  # retained hashes of contested slots
        self.beyond: tuple[int, str] | None = None  # a terminal entry that forked the source, which no slot up to the head holds
        self.usage: dict[str, str] = {}  # payloads of usage ids of more than one entry

    def batch(self, entries: list[dict]) -> list[dict]:
        undo = (self.state, self.head, self.hash, dict(self.pending))
        self.log: list[tuple[dict, object]] = []
        told = [dict(e, status="NOT_APPLIED", counted=False) for e in entries]
        self.drained: list[dict] = []
        error = None
        try:
            self._apply(told)
        except Refused as x:
            error = x.code
            if not x.kept:
                self.state, self.head, self.hash, self.pending = undo
                for where, key in self.log:
                    if where is self.usage:
                        del where[key]
                    else:
                        where[key[0]].discard(key[1])
                told, self.drained = [dict(e, status="REJECTED", counted=False) for e in entries], []
        out = [*told, *self.drained]
        return [
            {"source": e["source"], "batch": entries[0]["batch"], "seq": e["seq"], "hash": e["hash"], "status": e["status"], "counted": e["counted"], "error": error, "state": self.state, "head": self.head, "pending": len(self.pending)}
            for e in out
        ]

    def _known(self, e: dict) -> str | None:
        """SAME, OTHER or None: what the slot of an entry holds."""
        if e["contested"]:
            held = self.slots.get(e["seq"])
            return None if not held else "SAME" if e["hash"] in held else "OTHER"
        return "SAME" if 0 < e["seq"] <= self.head or e["seq"] in self.pending or (e["seq"], e["hash"]) == self.beyond else None

    def _retain(self, e: dict) -> None:
        if e["contested"] and e["hash"] not in self.slots.setdefault(e["seq"], set()):
            self.slots[e["seq"]].add(e["hash"])
            self.log.append((self.slots, (e["seq"], e["hash"])))

    def _apply(self, told: list[dict]) -> None:
        for a, b in zip(told, told[1:]):
            if b["seq"] <= a["seq"]:
                raise Refused("INVALID_INPUT")
        for e in told:
            if e["error"] is not None:
                raise Refused(e["error"])
        known = [self._known(e) for e in told]
        for e, k in zip(told, known):
            if k == "SAME":
                e["status"] = "DUPLICATE"
        if self.state in ("FORKED", "TERMINAL", "RETIRED"):
            if all(k == "SAME" for k in known):
                return
            raise Refused("SOURCE_FORKED" if self.state == "FORKED" else "SOURCE_TERMINAL")
        if "OTHER" in known:  # only the evidence of the fork is kept
            for e, k in zip(told, known):
                if k == "OTHER":
                    self._retain(e)
                    e["status"], self.state = "FORK", "FORKED"
            return
        for e in told:
            if e["status"] == "DUPLICATE":
                continue
            if e["seq"] <= self.head:
                raise Refused("CHAIN_INVALID")
            if e["seq"] > self.head + self.gap:
                raise Refused("GAP_LIMIT")
            if e["seq"] != self.head + 1:
                self._buffer(e)
                e["status"] = "BUFFERED"
                continue
            if e["prev"] != self.hash:
                self._buffer(e)
                e["status"] = "BUFFERED"
                raise Refused("CHAIN_INVALID", kept=True)
            if not self._accept(e, e):
                return
            while (held := self.pending.get(self.head + 1)) is not None and held["prev"] == self.hash:
                again = dict(held, status="DRAINED", counted=False)
                self.drained.append(again)
                if not self._accept(held, again):
                    return
        self.state = self.state if self.state == "TERMINAL" else "GAPPED" if self.pending else "ACTIVE"

    def _buffer(self, e: dict) -> None:
        if len(self.pending) >= self.gap:
            raise Refused("GAP_LIMIT")
        self._retain(e)
        self.pending.setdefault(e["seq"], {k: e[k] for k in GIVEN})
        self.state = "GAPPED"

    def _accept(self, e: dict, told: dict) -> bool:
        """Take an entry that follows the head; False if it forks the source instead."""
        if e["terminal"] and any(n > e["seq"] for n in self.pending):
            self._retain(e)
            told["status"], self.state, self.beyond = "FORK", "FORKED", (e["seq"], e["hash"])
            return False
        counted = e["usage_id"] is not None
        if counted and e["shared_usage"]:
            first = self.usage.get(e["usage_id"])
            if first is None:
                self.usage[e["usage_id"]] = e["payload"]
                self.log.append((self.usage, e["usage_id"]))
            elif first != e["payload"]:
                raise Refused("USAGE_CONFLICT")
            else:
                counted = False
        self._retain(e)
        self.pending.pop(e["seq"], None)
        self.head, self.hash = e["seq"], e["hash"]
        if e["terminal"]:
            self.state = "TERMINAL"
        told["status"], told["counted"] = told["status"] if told["status"] == "DRAINED" else "ACCEPTED", counted
        return True


def admitted(entries: DataFrame, p: Params = DEFAULT, zero: str = "0" * 64) -> DataFrame:
    """Outcome of each entry of each batch, and a row for each entry that a batch drains from the buffer.

    entries: source, batch (in order of arrival within a source), position (within the batch), seq, hash, prev, terminal,
    error (of the envelope's checks, see ``envelope_error``), usage_id and payload (of spend entries)."""
    slots = entries.groupBy("source", "seq").agg((F.min("hash") != F.max("hash")).alias("contested"))
    uses = entries.where("usage_id is not null").groupBy("source", "usage_id").agg((F.count_distinct("seq", "hash") > 1).alias("shared_usage"))
    rows = entries.join(slots, ["source", "seq"], "left")
    key = F.when(F.col("usage_id").isNotNull(), F.col("usage_id")).otherwise(F.concat(F.lit("no "), F.col("batch"), F.lit(" "), F.col("seq")))  # nulls aren't one key
    rows = rows.withColumn("_use", key).join(uses.select("source", F.col("usage_id").alias("_use"), "shared_usage"), ["source", "_use"], "left")
    rows = rows.select(F.col("source").cast("string").alias("source"), "batch", "position", "seq", "hash", "prev", F.coalesce("terminal", F.lit(False)).alias("terminal"), "error", F.col("usage_id").cast("string").alias("usage_id"), F.col("payload").cast("string").alias("payload"), F.coalesce("contested", F.lit(False)).alias("contested"), F.coalesce("shared_usage", F.lit(False)).alias("shared_usage"))
    gap = p.gap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, at, source, held = to_arrow_schema(TOLD), None, None, []
        for arrow in batches:
            out = []
            for e in arrow.to_pylist():
                if (e["source"], e["batch"]) != at:
                    if held:
                        out += source.batch(held)
                    if at is None or e["source"] != at[0]:
                        source = Source(gap)
                        source.hash = zero
                    at, held = (e["source"], e["batch"]), []
                held.append(e)  # a batch is as large as a request may be
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if held:
            yield pa.RecordBatch.from_pylist(source.batch(held), schema=schema)

    return rows.repartition("source").sortWithinPartitions("source", "batch", "position", "seq", "hash").mapInArrow(run, TOLD)


def envelope_error(p: Params = DEFAULT):
    """The first rule that an entry breaks, or null.  Columns: given_hash, hash, bound (the key is a producer's),
    revoked, fleet and source as the entry says and as they are bound (of_fleet, of_source), key_id and
    of_key, signed, profile and of_profile, subject and subjects, kind, meter, observed_ms, at_ms."""
    c, is_ = F.col, lambda x: F.coalesce(x, F.lit(False))
    with_subject = c("subject").isNotNull() & ~is_(F.array_contains("subjects", c("subject")))
    return (
        F.when(~is_(c("bound")), "FORBIDDEN").when(is_(c("revoked")), "KEY_REVOKED").when(~is_(c("given_hash") == c("hash")), "HASH_MISMATCH")
        .when(~is_((c("fleet") == c("of_fleet")) & (c("source") == c("of_source"))), "FORBIDDEN").when(~is_(c("key_id") == c("of_key")), "SIGNATURE_INVALID").when(~is_(c("signed")), "SIGNATURE_INVALID")
        .when(~is_(c("profile") == c("of_profile")), "FORBIDDEN").when(with_subject, "FORBIDDEN").when((c("kind") == "spend") & ~is_(c("meter")), "FORBIDDEN")
        .when(c("kind").isin("scope", "replication") & is_(c("meter")), "FORBIDDEN").when(c("observed_ms") > c("at_ms") + p.future_ms, "FUTURE_TIMESTAMP")
    )
