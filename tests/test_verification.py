"""Running values, automata and the verification of journals against loops over the rows, on random rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from vigil.functions.params import Params
from vigil.operators import ledger as L
from vigil.operators import paging
from vigil.operators.scans import Chain, Dealt, Machine

P = Params(watchers=3)
FEW = {"spark.sql.shuffle.partitions": "5", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.fixture(scope="module")
def many_ranges(spark):
    """Ranges that aren't coalesced, so that keys lie in several."""
    before = {k: spark.conf.get(k) for k in FEW}
    for k, v in FEW.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def turn(state, letter):
    return {("A", "a"): "B", ("B", "b"): "C", ("C", "c"): "A", ("B", "a"): "A"}.get((state, letter))


@pytest.mark.parametrize("seed", [1, 2])
def test_scans(many_ranges, seed):
    r, rows = random.Random(seed), []
    for n in range(1500):
        k = r.choice([1, 1, 1, 1, 1, 2, 3, 4, None])
        w = "f" if k in (1, 2, None) else "c"
        letter = r.choice("abcx") if w == "f" else f"{r.randrange(6)}>{r.randrange(6)}"
        rows.append((k, n, w, None if r.random() < 0.05 else letter, r.choice([None, r.randrange(100)])))
    r.shuffle(rows)
    dealt = Dealt(many_ranges.createDataFrame(rows, "k long, n long, w string, l string, v long"), ["k"], ["n"])
    assert dealt.rows.select("part").distinct().count() > 1 and 1 in {x.k for x in dealt.spanning().collect()}
    machines = {"f": Machine("A", ["A", "B", "C"], turn), "c": Chain("0")}
    moved = {x.n: (x.before, x.taken) for x in dealt.automata("l", machines, "w").collect()}
    before = {x.n: (x.s, x.m and x.m.n, x.c) for x in dealt.prefixes({"s": ("sum", F.col("v")), "m": ("max", F.struct("n", "v")), "c": ("min", F.col("v"))}).collect()}
    upto = {x.n: x.s for x in dealt.prefixes({"s": ("sum", F.col("v"))}, inclusive=True).collect()}
    state, sums, last, least = {}, {}, {}, {}
    for k, n, w, letter, v in sorted(rows, key=lambda x: x[1]):
        s = state.get(k, machines[w].start)
        to = None if letter is None else turn(s, letter) if w == "f" else letter[2:] if letter[0] == s else None
        assert moved[n] == (s, to is not None) and before[n] == (sums.get(k), last.get(k), least.get(k))
        state[k], last[k] = to or s, n
        if v is not None:
            sums[k], least[k] = sums.get(k, 0) + v, min(v, least.get(k, v))
        assert upto[n] == sums.get(k)
    none = Dealt(many_ranges.createDataFrame([], "k long, n long, w string, l string, v long"), ["k"], ["n"])
    assert none.automata("l", machines, "w").count() == none.prefixes({"s": ("sum", F.col("v"))}).count() == 0


def test_prefixes_within_a_key(many_ranges):
    """What the rows before have to agree in beside their key: as by brute force."""
    r = random.Random(5)
    rows = [(r.choice([1, 1, 1, 2, None]), n, r.choice(["a", "b", None]), r.choice([None, r.randrange(100)])) for n in range(900)]
    dealt = Dealt(many_ranges.createDataFrame(r.sample(rows, 900), "k long, n long, w string, v long"), ["k"], ["n"])
    assert not dealt.apart
    every = dealt.prefixes({"all": ("sum", F.col("v"))}, inclusive=True)
    told = dealt.prefixes({"s": ("sum", F.col("v")), "m": ("max", F.struct("n", "v"))}, rows=every, within=("w",))
    got = {x.n: (x["all"], x.s, x.m and x.m.n) for x in told.collect()}
    sums, wholes, last = {}, {}, {}
    for k, n, w, v in rows:
        if v is not None:
            wholes[k] = wholes.get(k, 0) + v
        assert got[n] == (wholes.get(k), sums.get((k, w)), last.get((k, w)))
        last[k, w] = n
        if v is not None:
            sums[k, w] = sums.get((k, w), 0) + v


HASH = "{:064x}".format
ZERO = "0" * 64
EVENTS = "fleet long, seq long, at_ms long, kind string, key string, n1 long, n2 long, n3 long, s1 string, s2 string, s3 string, s4 string"
CONFIGS = [(HASH(900 + e), e, ZERO if e == 1 else HASH(899 + e), 100 * e) for e in (1, 2, 3)]
ROSTER = [("c", 1, "k1", "d1", True), ("c", 2, "k2", "d2", True), ("c", 3, "k3", "d2", True), ("c", 4, "k4", "d4", False)]
WINDOWS = {f"w{i}": (1000 * i, HASH(500 + i), 3) for i in range(1, 5)}  # end, manifest, results
RESULTS = {(w, j): (HASH(100 * i + j), j != 2) for i, w in enumerate(WINDOWS, 1) for j in (1, 2, 3)}  # hash, hit
PAGES = [HASH(7), HASH(8)]
LIVE = ("CANDIDATE", "CORROBORATED", "ACKNOWLEDGED")


class Fold:
    """The rules, row by row, for one fleet."""

    def __init__(self):
        self.clock, self.revoked, self.numbered, self.active, self.pending = None, set(), 0, (0, ZERO), None
        self.sources, self.alerts, self.out, self.subs, self.opener = {}, {}, {}, {}, None

    def source(self, key):
        return self.sources.setdefault(key, {"seq": 0, "hash": ZERO, "ended": False, "forked": False, "buffered": set(), "seen": set()})

    def step(self, r, counted):
        fault = getattr(self, "on_" + r["kind"], lambda r, c: L.TRANSITION)(r, counted)
        if r["kind"] not in ("ResultFinalized", "AlertCreated"):
            known = WINDOWS.get(r["key"]) if r["kind"] == "WindowFinalized" else None
            self.opener = {"row": r, "window": r["key"], "found": 0} if known and known[2] == r["n1"] else None
        return fault

    def on_Tick(self, r, _):
        if r["n1"] != r["at_ms"] or (self.clock is not None and r["n1"] <= self.clock):
            return L.TRANSITION
        self.clock = r["n1"]

    def on_KeysRevoked(self, r, _):
        self.revoked.add(r["key"])

    def on_FleetChanged(self, r, _):
        return None

    def on_ConfigScheduled(self, r, _):
        c = next((c for c in CONFIGS if c[0] == r["key"]), None)
        if c is None:
            return L.MISSING
        if self.active == (0, ZERO) and (self.pending or (c[1] - 1, c[2]) != self.active):
            return L.TRANSITION
        if (c[1] - 1, c[2]) != self.active:
            return L.CHAIN
        if self.pending:
            return L.TRANSITION
        self.pending = c

    def on_ConfigActivated(self, r, _):
        if not self.pending or self.pending[0] != r["key"] or self.pending[3] > r["at_ms"]:
            return L.TRANSITION
        self.active, self.pending = (self.pending[1], self.pending[0]), None

    def on_SourceAccepted(self, r, counted):
        s, last, self.numbered = self.source(r["key"]), self.numbered, r["n1"]
        kind, told = r["s4"].split(":")
        fine = r["s1"] == str(r["n2"] < r["at_ms"] - P.late_ms).lower() and told == str(counted.get(r["s2"])).lower() and not (kind == "terminal" and any(q > r["n3"] for q in s["seen"]))
        chained = (r["n3"], r["s3"]) == (s["seq"] + 1, s["hash"])
        if s["ended"] or s["forked"]:
            return L.TRANSITION
        if fine and chained:
            s.update(seq=r["n3"], hash=r["s2"], ended=kind == "terminal")
        return L.CHAIN if not chained or r["n1"] != last + 1 else None if fine else L.TRANSITION

    def on_SourceBuffered(self, r, _):
        s = self.source(r["key"])
        s["seen"].add(r["n3"])
        if s["ended"] or s["forked"] or r["n3"] <= s["seq"] or r["n3"] in s["buffered"]:
            return L.TRANSITION
        s["buffered"].add(r["n3"])

    def on_SourceForkObserved(self, r, _):
        if not ((r["s1"] == "SLOT_FORK" and r["n1"] == r["n2"] and r["s2"] != r["s3"]) or (r["s1"] == "TERMINAL_SUFFIX" and r["s4"] in ("left", "right"))):
            return L.TRANSITION
        self.source(r["key"])["forked"] = True

    def on_WindowFinalized(self, r, _):
        known = WINDOWS.get(r["key"])
        return L.MISSING if known is None else L.REPLAY if (known[1], known[2]) != (r["s1"], r["n1"]) else None

    def on_ResultFinalized(self, r, _):
        if self.opener is None:
            return L.TRANSITION
        self.opener["found"] += 1
        return None if RESULTS.get((self.opener["window"], self.opener["found"]), (None,))[0] == r["s1"] else L.REPLAY

    def on_AlertCreated(self, r, _):
        w = self.opener and self.opener["window"]
        if not w or not any(h == r["s1"] and hit for (x, _), (h, hit) in RESULTS.items() if x == w) or r["n1"] != WINDOWS[w][0] + P.vote_ttl_ms:
            return L.TRANSITION
        self.alerts[r["key"]] = {"state": "CANDIDATE", "assurance": "VALID", "revision": 1, "expires": r["n1"], "manifest": WINDOWS[w][1], "votes": set(), "domains": set()}

    def on_VoteAccepted(self, r, _):
        a, v = self.alerts.get(r["key"]), next((x for x in ROSTER if x[1] == r["n1"] and x[4]), None)
        if not a or r["s1"] != "c" or r["s2"] != a["manifest"] or not v:
            return L.TRANSITION
        if v[2] != r["s3"]:
            return L.SIGNATURE
        if r["at_ms"] >= a["expires"] or a["state"] not in LIVE or r["n1"] in a["votes"]:
            return L.TRANSITION
        a["votes"].add(r["n1"])
        a["revision"] += 1
        if r["s3"] not in self.revoked:
            a["domains"].add(v[3])

    def on_AlertChanged(self, r, _):
        a, edge, actor = self.alerts.get(r["key"]), (r["s1"], r["s2"]), r["s3"] is not None
        legal = a and (
            (edge == ("CANDIDATE", "CORROBORATED") and not actor and len(a["domains"]) >= 2 and a["assurance"] == "VALID") or (edge == ("CANDIDATE", "EXPIRED") and not actor and r["at_ms"] >= a["expires"])
            or (edge == ("CORROBORATED", "ACKNOWLEDGED") and actor) or (r["s1"] in LIVE and r["s2"] == "CLOSED" and actor)
        )
        if not legal or a["state"] != r["s1"] or r["n1"] != a["revision"] + 1:
            return L.TRANSITION
        a.update(state=r["s2"], revision=r["n1"])

    def on_AlertDegraded(self, r, _):
        a = self.alerts.get(r["key"])
        if not a or a["assurance"] != "VALID" or r["n1"] != a["revision"] + 1:
            return L.TRANSITION
        a.update(assurance="DEGRADED", revision=r["n1"])

    def on_DeliveryChanged(self, r, _):
        if r["s3"] is not None and r["s3"] not in PAGES:
            return L.MISSING
        s, to = self.out.get(r["key"], "NONE"), r["s2"]
        if not ((s == "NONE" and to == "QUEUED" and r["n1"] == 0) or (s in ("QUEUED", "RETRY") and to in ("IN_FLIGHT", "CANCELLED")) or (s == "IN_FLIGHT" and to in ("DELIVERED", "RETRY", "FAILED", "CANCELLED"))):
            return L.TRANSITION
        self.out[r["key"]] = to
        if r["key"] in self.alerts:
            self.alerts[r["key"]]["revision"] += 1

    def on_SubscriptionChanged(self, r, _):
        s = self.subs.get(r["key"])
        legal = {"OPEN": (None, "ACTIVE"), "PAUSE": ("ACTIVE", "PAUSED"), "RESUME": ("PAUSED", "ACTIVE")}.get(r["s1"])
        if not (legal == (s, r["s2"]) or (r["s1"], r["s2"]) in (("EXPIRE", "EXPIRED"), ("CLOSE", "CLOSED")) and s in ("ACTIVE", "PAUSED")):
            return L.TRANSITION
        self.subs[r["key"]] = r["s2"]


def made(r, fold, fleet, seq, at, errors):
    """A row that mostly fits the state of things."""
    row = dict.fromkeys(["n1", "n2", "n3", "s1", "s2", "s3", "s4"]) | {"fleet": fleet, "seq": seq, "at_ms": at}
    kind = r.choice(["Tick", "KeysRevoked", "ConfigScheduled", "ConfigActivated", "SourceBuffered", "SourceForkObserved", "SubscriptionChanged", "AlertDegraded", "Unheard"] + ["SourceAccepted", "VoteAccepted", "AlertChanged", "DeliveryChanged"] * 5 + ["WindowFinalized"] * 3)
    if kind == "KeysRevoked" and r.random() < 0.8:
        kind = "FleetChanged"
    key = {"S": r.choice("ab"), "A": r.choice("xyz"), "V": r.choice("xyz"), "D": r.choice("xyz"), "W": r.choice([*WINDOWS, "w9"]), "K": r.choice(["k1", "k2"]), "C": r.choice([c[0] for c in CONFIGS] + [HASH(1)] * (r.random() < errors))}.get(kind[0], "t")
    row |= {"kind": kind, "key": "s" if kind == "SubscriptionChanged" else key}
    a, s = fold.alerts.get(key), fold.source(key) if kind.startswith("Source") else None
    if kind == "Tick":
        row["n1"] = at
    elif kind.startswith("Config") and r.random() < 0.8:
        row["key"] = fold.pending[0] if fold.pending else CONFIGS[min(2, fold.active[0])][0]
    elif kind == "SourceAccepted":
        row |= {"n1": fold.numbered + 1, "n2": at - r.choice([0, P.late_ms + 5]), "n3": s["seq"] + 1, "s2": HASH(10**6 * (fleet + 1) + seq), "s3": s["hash"]}
        row |= {"s1": str(row["n2"] < at - P.late_ms).lower(), "s4": ("terminal" if r.random() < 0.02 else "pulse") + ":true"}
    elif kind == "SourceBuffered":
        row["n3"] = s["seq"] + r.randint(0, 4)
    elif kind == "SourceForkObserved":
        row |= {"n1": 1, "n2": r.choice([1, 2]), "s1": r.choice(["SLOT_FORK", "TERMINAL_SUFFIX"]), "s2": "a", "s3": "b", "s4": r.choice(["both", "none", "none", "left"])} if r.random() < 0.3 else {"s1": "SLOT_FORK", "n1": 1, "n2": 2, "s4": "none"}
    elif kind == "WindowFinalized" and key in WINDOWS:
        row |= {"n1": 3, "s1": WINDOWS[key][1]}
    elif kind == "VoteAccepted":
        w = r.choice([1, 1, 2, 2, 3, 4])
        row |= {"n1": w, "s1": "c", "s2": a["manifest"] if a else ZERO, "s3": f"k{w}"}
    elif kind == "AlertChanged" and a:
        row["s1"], row["n1"] = a["state"], a["revision"] + 1
        row["s2"] = r.choice({"CANDIDATE": ["CORROBORATED", "CORROBORATED", "EXPIRED", "CLOSED"], "CORROBORATED": ["ACKNOWLEDGED", "CLOSED"]}.get(a["state"], ["CLOSED"]))
        row["s3"] = "op" if row["s2"] in ("ACKNOWLEDGED", "CLOSED") else None
    elif kind == "AlertDegraded" and a:
        row["n1"] = a["revision"] + 1
    elif kind == "DeliveryChanged":
        row |= {"n1": 0, "s2": r.choice({"NONE": ["QUEUED"], "QUEUED": ["IN_FLIGHT"], "RETRY": ["IN_FLIGHT", "CANCELLED"], "IN_FLIGHT": ["RETRY", "RETRY", "DELIVERED"]}.get(fold.out.get(key, "NONE"), ["QUEUED"])), "s3": r.choice([None, PAGES[0]])}
    elif kind == "SubscriptionChanged":
        row["s1"], row["s2"] = r.choice([("OPEN", "ACTIVE"), ("PAUSE", "PAUSED"), ("RESUME", "ACTIVE"), ("EXPIRE", "EXPIRED"), ("CLOSE", "CLOSED")])
    if r.random() < errors:
        c = r.choice(["n1", "n3", "s1", "s2", "s3"])
        row[c] = r.choice([None, row[c], (row[c] or 0) + r.choice([-1, 1, 2])] if c[0] == "n" else [None, "true", "c", "CLOSED", ZERO, "k2"])
        if kind == "SourceAccepted" and (row["n1"] is None or row["n3"] is None or row["s1"] is None or row["s2"] is None or row["s3"] is None):
            row |= {"n1": row["n1"] or 0, "n3": row["n3"] or 0, "s1": row["s1"] or "", "s2": row["s2"] or "", "s3": row["s3"] or ""}
        if kind == "SourceBuffered":
            row["n3"] = row["n3"] or 0
        if kind in ("WindowFinalized", "VoteAccepted", "AlertChanged", "AlertDegraded", "Tick", "DeliveryChanged"):
            row["n1"] = row["n1"] if row["n1"] is not None else -5
    yield row
    if kind == "WindowFinalized" and key in WINDOWS:
        for j in (1, 2, 3)[: 3 if r.random() > errors else 2]:
            seq += 1
            yield dict.fromkeys(["n1", "n2", "n3", "s1", "s2", "s3", "s4"]) | {"fleet": fleet, "seq": seq, "at_ms": at, "kind": "ResultFinalized", "key": key, "s1": RESULTS[key, j][0] if r.random() > errors else ZERO}
        for j in (1, 2, 3):
            if RESULTS[key, j][1] or r.random() < errors:
                seq += 1
                yield dict.fromkeys(["n1", "n2", "n3", "s1", "s2", "s3", "s4"]) | {
                    "fleet": fleet, "seq": seq, "at_ms": at, "kind": "AlertCreated", "key": r.choice("xyz"), "n1": WINDOWS[key][0] + P.vote_ttl_ms + (r.random() < errors), "s1": RESULTS[key, j][0],
                }


def journals(seed, errors, size=700):
    r, rows, want, counted = random.Random(seed), [], {}, {}
    for fleet, n in ((0, size), (1, size // 5), (2, 3)):
        fold, seq, at, openers = Fold(), 0, 0, []
        while seq < n:
            at += r.choice([0, 1, 5, 40])
            for row in made(r, fold, fleet, seq + 1, at, errors):
                seq = row["seq"]
                if row["kind"] == "SourceAccepted" and row["s2"] not in counted:
                    counted[row["s2"]] = r.random() > errors / 3
                rows.append(row)
                want[fleet, seq] = fold.step(row, counted)
                if fold.opener and fold.opener not in openers:
                    openers.append(fold.opener)
        for o in openers:
            if o["found"] != 3 and want[fleet, o["row"]["seq"]] is None:
                want[fleet, o["row"]["seq"]] = L.TRANSITION
    return rows, want, counted


def verified(spark, rows, counted):
    fleets = [0, 1, 2]
    columns = [c.split()[0] for c in EVENTS.split(", ")]
    frame = lambda some, ddl: spark.createDataFrame(some, ddl)
    return L.judged(
        frame([tuple(x[c] for c in columns) for x in rows], EVENTS),
        frame([(f, w, *x) for f in fleets for w, x in WINDOWS.items()], "fleet long, key string, end_ms long, manifest string, n_results long"),
        frame([(f, w, j, *x, WINDOWS[w][1], "c") for f in fleets for (w, j), x in RESULTS.items()], "fleet long, key string, position long, hash string, hit boolean, manifest string, config string"),
        frame([(f, *c) for f in fleets for c in CONFIGS], "fleet long, hash string, epoch long, predecessor string, effective_ms long"),
        frame([(f, *x) for f in fleets for x in ROSTER], "fleet long, config string, watcher long, key_id string, domain string, enabled boolean"),
        frame([(f, x) for f in fleets for x in PAGES], "fleet long, hash string"), frame([(f, h, c) for f in fleets for h, c in counted.items()], "fleet long, hash string, counted boolean"), P,
    )


@pytest.mark.parametrize("seed,errors", [(1, 0.0), (2, 0.15), (3, 0.4)])
def test_verification_is_the_fold(many_ranges, seed, errors):
    rows, want, counted = journals(seed, errors)
    got = {(x.fleet, x.seq): x.fault for x in verified(many_ranges, rows, counted).collect()}
    wrong = [(x["fleet"], x["seq"], x["kind"], x["key"], got.get((x["fleet"], x["seq"])), want[x["fleet"], x["seq"]]) for x in rows if got.get((x["fleet"], x["seq"]), "gone") != want[x["fleet"], x["seq"]]]
    assert not wrong, wrong[:5]
    assert len(got) == len(rows) and len({k for k in want.values()}) >= 3


def legal():
    """A journal by hand in which nothing is wrong: an alert is made, voted for by two, corroborated, paged, acknowledged, degraded, closed."""
    e, w1 = [], "w1"
    def add(at, kind, key, **m):
        e.append(dict.fromkeys(["n1", "n2", "n3", "s1", "s2", "s3", "s4"]) | {"fleet": 0, "seq": len(e) + 1, "at_ms": at, "kind": kind, "key": key} | m)
    add(50, "ConfigScheduled", CONFIGS[0][0])
    add(100, "ConfigActivated", CONFIGS[0][0])
    add(110, "SourceAccepted", "a", n1=1, n2=110, n3=1, s1="false", s2=HASH(1), s3=ZERO, s4="scope:true")
    add(120, "SourceBuffered", "a", n3=3)
    add(130, "SourceAccepted", "a", n1=2, n2=130, n3=2, s1="false", s2=HASH(2), s3=HASH(1), s4="spend:true")
    add(130, "SourceAccepted", "a", n1=3, n2=120, n3=3, s1="false", s2=HASH(3), s3=HASH(2), s4="terminal:true")
    add(1000, "Tick", "t", n1=1000)
    add(1000, "WindowFinalized", w1, n1=3, s1=WINDOWS[w1][1])
    for j in (1, 2, 3):
        add(1000, "ResultFinalized", w1, s1=RESULTS[w1, j][0])
    add(1000, "AlertCreated", "x", n1=1000 + P.vote_ttl_ms, s1=RESULTS[w1, 1][0])
    add(1001, "SubscriptionChanged", "s", s1="OPEN", s2="ACTIVE")
    add(1010, "VoteAccepted", "x", n1=1, s1="c", s2=WINDOWS[w1][1], s3="k1")
    add(1020, "VoteAccepted", "x", n1=2, s1="c", s2=WINDOWS[w1][1], s3="k2")
    add(1020, "AlertChanged", "x", n1=4, s1="CANDIDATE", s2="CORROBORATED")
    add(1020, "DeliveryChanged", "x", n1=0, s2="QUEUED", s3=PAGES[0])
    add(1030, "DeliveryChanged", "x", n1=1, s2="IN_FLIGHT")
    add(1040, "DeliveryChanged", "x", n1=1, s2="DELIVERED")
    add(1050, "AlertChanged", "x", n1=8, s1="CORROBORATED", s2="ACKNOWLEDGED", s3="op")
    add(1055, "VoteAccepted", "x", n1=3, s1="c", s2=WINDOWS[w1][1], s3="k3")
    add(1060, "KeysRevoked", "k1")
    add(1061, "KeysRevoked", "k1")
    add(1070, "AlertDegraded", "x", n1=10)
    add(1080, "AlertChanged", "x", n1=11, s1="ACKNOWLEDGED", s2="CLOSED", s3="op")
    add(1090, "FleetChanged", "fleet", s1="READ_ONLY")
    return e


FAULTS = [
    (0, {"key": CONFIGS[1][0]}, L.TRANSITION), (0, {"key": HASH(1)}, L.MISSING), (1, {"at_ms": 99}, L.TRANSITION), (4, {"s3": ZERO}, L.CHAIN), (4, {"n3": 5}, L.CHAIN), (4, {"n1": 7}, L.CHAIN), (4, {"s1": "true"}, L.TRANSITION), (4, {"s4": "spend:false"}, L.TRANSITION),
    (3, {"n3": 1}, L.TRANSITION), (6, {"n1": 999}, L.TRANSITION), (7, {"s1": ZERO}, L.REPLAY), (7, {"n1": 4}, L.REPLAY), (7, {"key": "w9"}, L.MISSING), (9, {"s1": ZERO}, L.REPLAY), (11, {"n1": 1}, L.TRANSITION), (11, {"s1": RESULTS["w1", 2][0]}, L.TRANSITION),
    (13, {"s3": "k2"}, L.SIGNATURE), (13, {"n1": 4, "s3": "k4"}, L.TRANSITION), (13, {"s2": ZERO}, L.TRANSITION), (14, {"n1": 1, "s3": "k1"}, L.TRANSITION), (14, {"at_ms": 10**7}, L.TRANSITION), (15, {"n1": 3}, L.TRANSITION), (15, {"s3": "op"}, L.TRANSITION), (15, {"s2": "EXPIRED"}, L.TRANSITION),
    (16, {"n1": 1}, L.TRANSITION), (16, {"s3": HASH(99)}, L.MISSING), (17, {"s2": "DELIVERED"}, L.TRANSITION), (19, {"n1": 5}, L.TRANSITION), (19, {"s3": None}, L.TRANSITION), (23, {"n1": 11}, L.TRANSITION), (12, {"s1": "RESUME"}, L.TRANSITION), (12, {"s2": "PAUSED"}, L.TRANSITION),
]


def test_legal_journal_and_one_fault_each(many_ranges):
    """The journals of all faults are fleets of one table: each is told where it is, and before it nothing."""
    counted = {HASH(i): True for i in (1, 2, 3)}
    good = legal()
    assert not verified(many_ranges, good, counted).where("fault is not null").count()
    rows = [row | {"fleet": f} | (change if i == at else {}) for f, (at, change, _) in enumerate(FAULTS) for i, row in enumerate(good)]
    n = range(len(FAULTS))
    columns = [c.split()[0] for c in EVENTS.split(", ")]
    frame = lambda some, ddl: many_ranges.createDataFrame(some, ddl)
    told = L.judged(
        frame([tuple(x[c] for c in columns) for x in rows], EVENTS), frame([(f, w, *x) for f in n for w, x in WINDOWS.items()], "fleet long, key string, end_ms long, manifest string, n_results long"),
        frame([(f, w, j, *x, WINDOWS[w][1], "c") for f in n for (w, j), x in RESULTS.items()], "fleet long, key string, position long, hash string, hit boolean, manifest string, config string"),
        frame([(f, *c) for f in n for c in CONFIGS], "fleet long, hash string, epoch long, predecessor string, effective_ms long"), frame([(f, *x) for f in n for x in ROSTER], "fleet long, config string, watcher long, key_id string, domain string, enabled boolean"),
        frame([(f, x) for f in n for x in PAGES], "fleet long, hash string"), frame([(f, h, c) for f in n for h, c in counted.items()], "fleet long, hash string, counted boolean"), P,
    )
    first = {}
    for x in told.where("fault is not null").orderBy("fleet", "seq").collect():
        first.setdefault(x.fleet, (x.seq - 1, x.fault))
    assert [first.get(f) for f in n] == [(at, fault) for at, _, fault in FAULTS]


def test_no_window_over_a_whole_fleet(many_ranges):
    """No window of the chain check orders all rows of a fleet in one task."""
    rows, _, _ = journals(5, 0.1, 60)
    columns = [c.split()[0] for c in EVENTS.split(", ")]
    journal = many_ranges.createDataFrame([tuple(x[c] for c in columns) for x in rows], EVENTS).withColumn("prev", F.lit("")).withColumn("hash", F.lit(""))
    plan = L.unchained(journal)._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(fleet" in plan and not re.search(r"windowspecdefinition\(fleet#\d+L?, seq", plan)


def greedy(sizes, limit, budget):
    """First row of each row's page."""
    out, begin, total = [], 0, 0
    for i, b in enumerate(sizes):
        if i and (i - begin >= limit or total + b > budget):
            begin, total = i, 0
        total += b
        out.append(begin + 1)
    return out


@pytest.mark.parametrize("limit,budget", [(128, 10**6), (7, 10**6), (9, 300), (1, 5), (40, 2500)])
def test_all_pages(many_ranges, limit, budget):
    r = random.Random(limit)
    fleets = {0: [r.choice([0, 10, 50, 400, 3000]) for _ in range(900)], 1: [r.randint(1, 100) for _ in range(60)], 2: [10**7]}
    rows = [(f, i + 1, None if b == 0 else b) for f, sizes in fleets.items() for i, b in enumerate(sizes)]
    r.shuffle(rows)
    got = paging.pages(many_ranges.createDataFrame(rows, "fleet long, seq long, bytes long"), limit, budget)
    pages = {(x.fleet, x.seq): x.page for x in got.collect()}
    want = {(f, i + 1): p for f, sizes in fleets.items() for i, p in enumerate(greedy(sizes, limit, budget))}
    assert pages == want
    listed = paging.listed(got).collect()
    assert sum(x.entries for x in listed) == len(rows) and sum(not x.more for x in listed) == 3
    assert paging.listed(paging.pages(got.select("fleet", "seq", "bytes").where("false"))).count() == 0


def test_objects_belong_to_the_first_entry(spark):
    refs = spark.createDataFrame([(0, 5, "result", "a"), (0, 3, "result", "a"), (0, 3, "page", "a"), (0, 4, "page", "missing"), (1, 9, "page", "a")], "fleet long, seq long, kind string, hash string")
    objects = spark.createDataFrame([(0, "result", "a", 10), (0, "page", "a", 20), (1, "page", "a", 30)], "fleet long, kind string, hash string, bytes long")
    assert {(x.fleet, x.seq): x.object_bytes for x in paging.introduced(refs, objects).collect()} == {(0, 3): 222, (1, 9): 126}


def test_links_of_a_chain_in_any_order():
    """What many links do is found without looking at the others, whatever order they come in."""
    import time

    r, links = random.Random(3), [(f"{i}", f"{i + 1}") for i in range(60_000)]
    for order in (links, links[::-1], r.sample(links, len(links))):
        function, began = Chain("0").function(), time.process_time()
        for a, b in order:
            function.then(f"{a}>{b}")
        assert time.process_time() - began < 10  # all pairs of links took minutes
        told = dict(function.links())
        assert told["0"] == ("60000" if order is links else "1" if order == links[::-1] else told["0"])
    for _ in range(50):
        order = [(str(r.randrange(6)), str(r.randrange(6))) for _ in range(r.randrange(1, 30))]
        function = Chain("0").function()
        for a, b in order:
            function.then(f"{a}>{b}")
        told = dict(function.links())
        for s in map(str, range(6)):
            state = s
            for a, b in order:
                state = b if state == a else state
            assert told.get(s, s) == state


def test_chains_against_their_order_over_many_ranges(many_ranges):
    """Links of one key, shuffled, in several ranges: states follow from range to range."""
    r = random.Random(4)
    rows = [(n, f"{a}>{a + 1}") for n, a in enumerate(r.sample(range(3000), 3000))]
    dealt = Dealt(many_ranges.createDataFrame([(1, n, "c", x) for n, x in rows], "k long, n long, w string, l string"), ["k"], ["n"])
    assert not dealt.apart
    got = {x.n: (x.before, x.taken) for x in dealt.automata("l", {"c": Chain("0")}, "w").collect()}
    state = "0"
    for n, x in rows:
        pre, post = x.split(">")
        assert got[n] == (state, pre == state)
        state = post if pre == state else state
