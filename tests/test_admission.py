"""Admission of batches against a source that remembers everything, and envelopes rule by rule."""

import copy
import random

import pytest
from pyspark.sql import functions as F

from vigil.functions.params import Params
from vigil.operators import admission as A

P = Params(gap=6)
ZERO = "0" * 64
ENTRIES = "source string, batch long, position long, seq long, hash string, prev string, terminal boolean, error string, usage_id string, payload string"


class Remembering:
    """All slots, all usage ids; a copy of everything undoes a batch."""

    def __init__(self):
        self.state, self.head, self.hash, self.slots, self.pending, self.usage = "EMPTY", 0, ZERO, {}, {}, {}

    def batch(self, entries):
        before = copy.deepcopy(self.__dict__)
        got = self.run(entries)
        if got is None or got[1] is None or got[2]:
            return got
        self.__dict__.update(before)
        return [(e, "REJECTED", False) for e in entries], got[1], False

    def run(self, entries):
        """(told, error, whether what was applied stays)."""
        told = [[e, "NOT_APPLIED", False] for e in entries]
        if any(b["seq"] <= a["seq"] for a, b in zip(entries, entries[1:])):
            return told, "INVALID_INPUT", False
        errors = [e["error"] for e in entries if e["error"]]
        if errors:
            return told, errors[0], False
        same = [e["hash"] in self.slots.get(e["seq"], ()) for e in entries]
        other = [bool(self.slots.get(e["seq"])) and not s for e, s in zip(entries, same)]
        for t, s in zip(told, same):
            t[1] = "DUPLICATE" if s else t[1]
        if self.state in ("FORKED", "TERMINAL"):
            return told, None if all(same) else f"SOURCE_{self.state}", False
        if any(other):
            for t, o in zip(told, other):
                if o:
                    self.slots[t[0]["seq"]].append(t[0]["hash"])
                    t[1], self.state = "FORK", "FORKED"
            return told, None, False
        drained = []
        for t, s in zip(told, same):
            e = t[0]
            if s:
                continue
            if e["seq"] <= self.head:
                return told, "CHAIN_INVALID", False
            if e["seq"] > self.head + P.gap or (len(self.pending) >= P.gap and (e["seq"] != self.head + 1 or e["prev"] != self.hash)):
                return told, "GAP_LIMIT", False
            if e["seq"] != self.head + 1 or e["prev"] != self.hash:
                self.pending[e["seq"]] = e
                self.slots.setdefault(e["seq"], []).append(e["hash"])
                t[1], self.state = "BUFFERED", "GAPPED"
                if e["seq"] == self.head + 1:
                    return told + drained, "CHAIN_INVALID", True
                continue
            now = t
            while True:
                e = now[0]
                if e["terminal"] and any(n > e["seq"] for n in self.pending):
                    if e["hash"] not in self.slots.setdefault(e["seq"], []):
                        self.slots[e["seq"]].append(e["hash"])
                    now[1], self.state = "FORK", "FORKED"
                    return told + drained, None, False
                if e["usage_id"] is not None:
                    first = self.usage.get(e["usage_id"])
                    if first not in (None, e["payload"]):
                        return told, "USAGE_CONFLICT", False
                    self.usage[e["usage_id"]], now[2] = e["payload"], first is None
                if e["hash"] not in self.slots.setdefault(e["seq"], []):
                    self.slots[e["seq"]].append(e["hash"])
                self.pending.pop(e["seq"], None)
                self.head, self.hash = e["seq"], e["hash"]
                now[1] = "DRAINED" if now is not t else "ACCEPTED"
                if e["terminal"]:
                    self.state = "TERMINAL"
                after = self.pending.get(self.head + 1)
                if after is None or after["prev"] != self.hash:
                    break
                now = [after, "DRAINED", False]
                drained.append(now)
        if self.state != "TERMINAL":
            self.state = "GAPPED" if self.pending else "ACTIVE"
        return told + drained, None, False


def batches(seed, sources, n):
    """Mostly what comes next, else gaps, forks, wrong predecessors, errors, repeated and conflicting usage."""
    r, rows = random.Random(seed), []
    for source in sources:
        truth = [ZERO]
        for i in range(1, n * 4):
            truth.append(f"{source}{i:05d}")
        terminal = r.choice([None, None, r.randint(5, 3 * n)])
        next_, late = 1, []
        for b in range(n):
            size, x = r.randint(1, 4), r.random()
            some = list(range(next_, next_ + size))
            if x < 0.15:
                late.append(some)
                next_ += size
                continue
            if x < 0.35 and late:
                some = late.pop(0)
            elif x < 0.45:
                some = list(range(max(1, next_ - 3), next_ + 1))
            elif x < 0.5:
                some = [next_ + r.randint(0, 9) for _ in range(2)]
            else:
                next_ += size
            for p, s in enumerate(some):
                fork, wrong, bad = r.random() < 0.004, r.random() < 0.01, r.random() < 0.02
                usage = r.choice([None, f"u{r.randrange(40 * n)}", f"v{s}", "w"]) if r.random() < 0.5 else None
                rows.append((source, b, p, s, truth[s] + "x" * fork, truth[s - 1] + "y" * wrong, s == terminal, r.choice(["HASH_MISMATCH", "FORBIDDEN"]) if bad else None, usage, "p" if r.random() < 0.97 else "q"))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_batches_are_all_or_nothing(spark, seed):
    rows = batches(seed, [f"s{i}" for i in range(12)], 40)
    names = [c.split()[0] for c in ENTRIES.split(", ")]
    got = {}
    for x in A.admitted(spark.createDataFrame(rows, ENTRIES).repartition(3), P).collect():
        got.setdefault((x.source, x.batch), []).append((x.seq, x.hash, x.status, x.counted, x.error, x.state, x.head, x.pending))
    want, sources, seen = {}, {}, set()
    grouped = {}
    for row in rows:
        grouped.setdefault(row[:2], []).append(dict(zip(names, row)))
    for (source, b), entries in sorted(grouped.items()):
        s = sources.setdefault(source, Remembering())
        told, error, _ = s.batch(sorted(entries, key=lambda e: e["position"]))
        want[source, b] = [(e["seq"], e["hash"], status, counted, error, s.state, s.head, len(s.pending)) for e, status, counted in told]
        seen |= {error, s.state} | {x[2] for x in want[source, b]}
    for key in want:
        assert sorted(got[key]) == sorted(want[key]), key
    assert got.keys() == want.keys() and {"ACCEPTED", "DRAINED", "BUFFERED", "DUPLICATE", "REJECTED", "GAPPED", "CHAIN_INVALID"} <= seen


def test_each_rule(spark):
    """One source a rule: what happens to the last batch."""
    e = lambda seq, prev=None, **m: {"seq": seq, "hash": m.pop("hash", f"h{seq}"), "prev": prev or (ZERO if seq == 1 else f"h{seq - 1}"), "terminal": False, "error": None, "usage_id": None, "payload": None} | m
    cases = {
        "genesis": ([[e(1, prev="h0")]], ["BUFFERED"], "CHAIN_INVALID"), "ascending": ([[e(2), e(1)]], ["REJECTED"] * 2, "INVALID_INPUT"), "whole batch": ([[e(1), e(2, error="FORBIDDEN")]], ["REJECTED"] * 2, "FORBIDDEN"),
        "duplicates": ([[e(1), e(2)], [e(1), e(2)]], ["DUPLICATE"] * 2, None), "buffered duplicate": ([[e(3)], [e(3)]], ["DUPLICATE"], None), "fork only": ([[e(1)], [e(1, hash="x"), e(2)]], ["FORK", "NOT_APPLIED"], None),
        "after a fork": ([[e(1)], [e(1, hash="x")], [e(2)]], ["REJECTED"], "SOURCE_FORKED"), "after a fork again": ([[e(1)], [e(1, hash="x")], [e(1), e(1 + 0, hash="x") | {"seq": 1}][:1]], ["DUPLICATE"], None),
        "after the end": ([[e(1, terminal=True)], [e(2)]], ["REJECTED"], "SOURCE_TERMINAL"), "gap": ([[e(1)], [e(2), e(9)]], ["ACCEPTED", "REJECTED"][1:] * 2, "GAP_LIMIT"), "at the gap": ([[e(1)], [e(7)]], ["BUFFERED"], None),
        "kept evidence": ([[e(1)], [e(2), e(3, prev="no"), e(4)]], ["ACCEPTED", "BUFFERED", "NOT_APPLIED"], "CHAIN_INVALID"), "drain": ([[e(2), e(3)], [e(1)]], ["ACCEPTED", "DRAINED", "DRAINED"], None), "suffix": ([[e(3)], [e(1), e(2, terminal=True)]], ["ACCEPTED", "FORK"], None),
        "drained suffix": ([[e(2, terminal=True), e(3)], [e(1)]], ["ACCEPTED", "FORK"], None), "usage": ([[e(1, usage_id="u", payload="a")], [e(2, usage_id="u", payload="a")]], ["ACCEPTED"], None),
        "conflict": ([[e(1, usage_id="u", payload="a")], [e(2), e(3, usage_id="u", payload="b")]], ["REJECTED"] * 2, "USAGE_CONFLICT"), "conflict undone": ([[e(1, usage_id="u", payload="a"), e(2, usage_id="u", payload="b")], [e(1, usage_id="u", payload="b")]], ["ACCEPTED"], None),
    }
    rows = [(name, b, p, *(x[c] for c in ("seq", "hash", "prev", "terminal", "error", "usage_id", "payload"))) for name, (all_, _, _) in cases.items() for b, some in enumerate(all_) for p, x in enumerate(some)]
    got = {}
    for x in A.admitted(spark.createDataFrame(rows, ENTRIES), P).collect():
        got.setdefault((x.source, x.batch), []).append((x.seq, x.status, x.error))
    for name, (all_, statuses, error) in cases.items():
        last = got[name, len(all_) - 1]
        assert sorted(s for _, s, _ in last) == sorted(statuses) and {x for _, _, x in last} == {error}, (name, last)
    assert A.admitted(spark.createDataFrame([], ENTRIES), P).count() == 0


def test_envelopes(spark):
    ok = {"given_hash": "h", "hash": "h", "bound": True, "revoked": False, "fleet": 1, "source": 2, "of_fleet": 1, "of_source": 2, "key_id": "k", "of_key": "k", "signed": True, "profile": "p", "of_profile": "p", "subject": 3, "subjects": [3, 4], "kind": "scope", "meter": False, "observed_ms": 60_100, "at_ms": 100}
    cases = [({}, None), ({"bound": None}, "FORBIDDEN"), ({"revoked": True, "hash": "x"}, "KEY_REVOKED"), ({"given_hash": None}, "HASH_MISMATCH"), ({"of_source": 3}, "FORBIDDEN"), ({"key_id": "o"}, "SIGNATURE_INVALID"), ({"signed": None}, "SIGNATURE_INVALID"), ({"profile": "q"}, "FORBIDDEN"),
             ({"subject": 5}, "FORBIDDEN"), ({"subject": None, "kind": "pulse"}, None), ({"kind": "spend"}, "FORBIDDEN"), ({"kind": "spend", "meter": True}, None), ({"meter": True}, "FORBIDDEN"), ({"observed_ms": 60_101}, "FUTURE_TIMESTAMP")]
    ddl = "given_hash string, hash string, bound boolean, revoked boolean, fleet long, source long, of_fleet long, of_source long, key_id string, of_key string, signed boolean, profile string, of_profile string, subject long, subjects array<long>, kind string, meter boolean, observed_ms long, at_ms long, n long"
    df = spark.createDataFrame([(*(ok | c).values(), i) for i, (c, _) in enumerate(cases)], ddl)
    assert [r.e for r in df.select("n", A.envelope_error().alias("e")).orderBy("n").collect()] == [e for _, e in cases]
    assert df.where(F.lit(False)).select(A.envelope_error()).count() == 0
