"""The journal: appending, framing, exporting, verifying and watching it.

A journal row has fleet, seq, at_ms, kind, key and the members n1 to n3, s1 to s4 whose
meaning depends on the kind.  Rules are running values and automata over ranges of rows, so a
fleet or key of any size is spread over tasks; only appending, which makes the hash chain, is a fold
that streams each fleet's rows in order and carries one hash.

Defined cases: an empty journal gives empty tables; rows of an unknown kind are faulty;
a null member never satisfies a rule that reads it.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

from vigil.functions.params import DEFAULT, Params
from vigil.operators.scans import Chain, Dealt, Machine
from vigil.sources.store import written

ZERO = "0" * 64
MEMBERS = ("at_ms", "kind", "key", "n1", "n2", "n3", "s1", "s2", "s3", "s4")
ALERTS = ("AlertCreated", "AlertChanged", "AlertDegraded", "VoteAccepted", "DeliveryChanged")
#: The legal moves of alerts (by no actor or by one), deliveries and subscriptions.
ALERT_EDGES = {"CANDIDATE CORROBORATED": False, "CANDIDATE EXPIRED": False, "CORROBORATED ACKNOWLEDGED": True, "CANDIDATE CLOSED": True, "CORROBORATED CLOSED": True, "ACKNOWLEDGED CLOSED": True}
DELIVERY_EDGES = [
    "NONE QUEUED", "QUEUED IN_FLIGHT", "QUEUED CANCELLED", "RETRY IN_FLIGHT", "RETRY CANCELLED", "IN_FLIGHT DELIVERED", "IN_FLIGHT RETRY", "IN_FLIGHT FAILED", "IN_FLIGHT CANCELLED",
]
SUBSCRIPTION_EDGES = {
    ("OPEN", "NONE"): "ACTIVE", ("PAUSE", "ACTIVE"): "PAUSED", ("RESUME", "PAUSED"): "ACTIVE", ("EXPIRE", "ACTIVE"): "EXPIRED", ("EXPIRE", "PAUSED"): "EXPIRED", ("CLOSE", "ACTIVE"): "CLOSED", ("CLOSE", "PAUSED"): "CLOSED",
}
LIVE = ("CANDIDATE", "CORROBORATED", "ACKNOWLEDGED")
CHAIN, TRANSITION, REPLAY, MISSING, SIGNATURE = "CHAIN_INVALID", "TRANSITION_INVALID", "REPLAY_MISMATCH", "OBJECT_MISSING", "SIGNATURE_INVALID"


def text_of(*columns: str) -> Column:
    """The bytes that a row's digest covers beside its predecessor's."""
    return F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns])


def appended(events: DataFrame, head: DataFrame | None = None) -> DataFrame:
    """Add seq, prev and hash, fleet by fleet in the order of ``order``.

    events: fleet, order (a column that sorts), and the members; head: fleet, seq, hash
    of a journal that is continued.  Each fleet's rows pass one task as a stream; the fleets of a task pass together, so that
    rows are sorted by what tells them apart first, and numbers that follow one another deal them out evenly, which hashes of a few don't."""
    start = events.select("fleet", "order", *MEMBERS)
    names = ["fleet", *MEMBERS]
    if head is not None:
        start = start.join(head.select("fleet", F.col("seq").alias("head_seq"), F.col("hash").alias("head_hash")), "fleet", "left").fillna({"head_seq": 0, "head_hash": ZERO})
    # a row's text is added behind the sort, which is the smaller for it
    columns = ["fleet", "text", *(["head_seq", "head_hash"] if head is not None else [])]
    schema = start.select(*names).schema.add("seq", "long").add("prev", "string").add("hash", "string")

    def chain(batches):
        heads = {}  # of each fleet of the task
        for batch in batches:
            seqs, prevs, hashes = [], [], []
            for f, text, *given in zip(*(batch.column(c).to_pylist() for c in columns)):
                seq, last = heads.get(f) or given or (0, ZERO)
                seq += 1
                prevs.append(last)
                last = hashlib.sha256(f"ENTRY/1\0{seq}\x1f{last}\x1f{text}".encode()).hexdigest()
                heads[f] = seq, last
                seqs.append(seq), hashes.append(last)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(seqs, pa.int64()), pa.array(prevs, pa.string()), pa.array(hashes, pa.string())], names=schema.fieldNames())

    kind, n = start.schema["order"].dataType, int(start.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col("order")[c] for c in kind.names] if isinstance(kind, StructType) else ["order"]
    numbered = isinstance(start.schema["fleet"].dataType, IntegralType)
    dealt = start.repartitionById(n, F.coalesce(F.pmod("fleet", F.lit(n)), F.lit(0)).cast("int")) if numbered else start.repartition("fleet")
    ordered = dealt.sortWithinPartitions(*by)
    return ordered.select(*names, text_of(*MEMBERS).alias("text"), *columns[2:]).mapInArrow(chain, schema)


def unchained(journal: DataFrame) -> DataFrame:
    """Rows whose digest, predecessor or number is wrong, or whose time runs backwards; each
    row is checked against its own members and its neighbour, so nothing is folded and a journal
    lies in as many ranges as its size asks for."""
    own = F.sha2(F.concat(F.lit("ENTRY/1\0"), F.col("seq").cast("string"), F.lit("\u001f"), F.col("prev"), F.lit("\u001f"), text_of(*MEMBERS)), 256)
    rows = journal.select("fleet", "seq", "prev", "hash", "at_ms", (own != F.col("hash")).alias("altered"))
    rows = Dealt(rows, ["fleet"], ["seq"]).prefixes({"last": ("max", F.struct("seq", "hash", "at_ms"))})
    before, last = F.coalesce("last.hash", F.lit(ZERO)), F.coalesce("last.seq", F.lit(0))
    fault = F.when(F.col("altered"), "HASH_INVALID").when((F.col("prev") != before) | (F.col("seq") != last + 1), CHAIN).when(F.expr("at_ms < last.at_ms"), "TIME_INVALID")
    return rows.select("fleet", "seq", fault.alias("fault")).where("fault is not null")


def alert_moves(state: str, letter: str) -> str | None:
    """Alerts as ``state:assurance:revision``: creation, votes, changes (from, to, revision) and degradation (revision)."""
    verb, *rest = letter.split(":")
    if verb == "create":
        return "CANDIDATE:VALID:1"
    if state == "NONE":
        return None
    at, assurance, revision = state.split(":")
    if verb == "vote":
        return f"{at}:{assurance}:{int(revision) + 1}" if at in LIVE else None
    if int(rest[-1]) != int(revision) + 1:
        return None
    if verb == "degrade":
        return f"{at}:DEGRADED:{rest[-1]}" if assurance == "VALID" else None
    if rest[0] != at or (rest[1] == "CORROBORATED" and assurance != "VALID"):
        return None
    return f"{rest[1]}:{assurance}:{rest[-1]}"


def machines(p: Params) -> dict[str, Machine]:
    """By name; revisions of an alert are bounded by a vote of each watcher, three changes and a degradation."""
    ends = (*LIVE, "EXPIRED", "CLOSED")
    every = ["NONE", *(f"{s}:{a}:{r}" for s in ends for a in ("VALID", "DEGRADED") for r in range(1, most(p) + 1))]
    delivery = {tuple(e.split(" ")) for e in DELIVERY_EDGES}
    return {
        "alert": Machine("NONE", every, alert_moves), "source": Chain(f"0:{ZERO}"), "config": Chain(f"0:{ZERO}|"), "none": Machine("", [""], lambda state, letter: None),
        "delivery": Machine("NONE", sorted({x for e in delivery for x in e}), lambda state, letter: letter if (state, letter) in delivery else None),
        "subscription": Machine("NONE", ["NONE", "ACTIVE", "PAUSED", "EXPIRED", "CLOSED"], lambda state, letter: to if (to := SUBSCRIPTION_EDGES.get((letter.split(":")[0], state))) == letter.split(":")[1] else None),
    }


def most(p: Params) -> int:
    return p.watchers + 5


def judged(
    journal: DataFrame, windows: DataFrame, results: DataFrame, configs: DataFrame, roster: DataFrame, pages: DataFrame, records: DataFrame, p: Params = DEFAULT
) -> DataFrame:
    """Each row of the journal with ``fault``: null, or why the rule of its kind refuses it.  A row that is
    refused changes nothing for those after it: sources, alerts, deliveries and subscriptions are automata over the
    rows before.  Verification ends at the first fault of a fleet; what is told of later rows is of use to who
    looks into it.  A number of an accepted record is held against the accepted record before it.

    Recomputed: windows (fleet, key, end_ms, manifest, n_results), results (fleet, key of the window, position, hash,
    hit, manifest, config), records (fleet, hash, counted).  Objects: configs (fleet, hash, epoch, predecessor,
    effective_ms), pages (fleet, hash).  roster: fleet, config, watcher, key_id, domain, enabled.

    Members by kind: Tick n1 time; ConfigScheduled and ConfigActivated key config; KeysRevoked key the key;
    SourceAccepted key source, n1 index, n2 observed, n3 seq, s1 late, s2 hash, s3 prev, s4 kind:counted;
    SourceBuffered key source, n3 seq; SourceForkObserved key source, n1 and n2 seqs, s1 reason, s2 and s3 hashes, s4
    which of the two is terminal; WindowFinalized key window, n1 results, s1 manifest; ResultFinalized s1 hash; AlertCreated
    key alert, n1 expiry, s1 result; VoteAccepted key alert, n1 watcher, s1 config, s2 manifest, s3 signing key;
    AlertChanged key alert, n1 revision, s1 from, s2 to, s3 actor; AlertDegraded key alert, n1 revision;
    DeliveryChanged key alert, n1 attempts, s2 state, s3 page; SubscriptionChanged key subscription, s1 event, s2 state."""
    kind = F.col("kind")
    config = configs.select("fleet", F.col("hash").alias("key"), "epoch", "predecessor", "effective_ms", F.lit(True).alias("known"))
    scheduled = kind.isin("ConfigScheduled", "ConfigActivated")
    rows = journal.select("fleet", "seq", *MEMBERS)
    rows = _beside(rows, scheduled, config, ["fleet", "key"])
    rows = _beside(rows, kind == "SourceAccepted", records.select("fleet", F.col("hash").alias("s2"), "counted"), ["fleet", "s2"])
    rows = _beside(rows, (kind == "DeliveryChanged") & F.col("s3").isNotNull(), pages.select("fleet", F.col("hash").alias("s3"), F.lit(True).alias("has_page")), ["fleet", "s3"])

    # what sources, configurations, deliveries and subscriptions were before
    machine = F.when(kind.isin("SourceAccepted", "SourceBuffered", "SourceForkObserved"), "source").when(scheduled, "config").when(kind == "DeliveryChanged", "delivery").when(kind == "SubscriptionChanged", "subscription").otherwise("none")
    name = F.when(F.col("machine") == "config", "").when(F.col("machine") == "none", F.col("seq").cast("string")).otherwise(F.col("key"))
    fork = F.when(F.col("s1") == "SLOT_FORK", (F.col("n1") == F.col("n2")) & (F.col("s2") != F.col("s3"))).when(F.col("s1") == "TERMINAL_SUFFIX", F.col("s4").isin("left", "right"))
    rows = rows.withColumn("machine", machine).withColumn("name", name).withColumn("fork", F.coalesce((kind == "SourceForkObserved") & fork, F.lit(False)))
    dealt = Dealt(rows, ["fleet", "machine", "name"], ["seq"])
    rows = dealt.prefixes({"forked": ("max", F.when(F.col("fork"), 1)), "ahead": ("max", F.when(kind == "SourceBuffered", F.col("n3")))})
    late = (F.col("n2") < F.col("at_ms") - p.late_ms).cast("string")
    terminal = F.split_part("s4", F.lit(":"), F.lit(1)) == "terminal"
    fits = (F.col("s1") == late) & (F.split_part("s4", F.lit(":"), F.lit(2)) == F.col("counted").cast("string")) & ~(terminal & F.coalesce(F.col("ahead") > F.col("n3"), F.lit(False)))
    link = F.concat(F.col("n3") - 1, F.lit(":"), "s3", F.lit(">"), F.when(terminal, "T").otherwise(F.concat("n3", F.lit(":"), "s2")))
    active = F.concat(F.col("epoch") - 1, F.lit(":"), "predecessor", F.lit("|"))
    letter = (
        F.when(kind == "SourceAccepted", F.when(fits & F.col("forked").isNull(), link)).when(kind == "ConfigScheduled", F.concat(active, F.lit(">"), active, "key"))
        .when((kind == "ConfigActivated") & (F.col("effective_ms") <= F.col("at_ms")), F.concat(active, "key", F.lit(">"), "epoch", F.lit(":"), "key", F.lit("|")))
        .when((kind == "DeliveryChanged") & (F.col("s3").isNull() | F.col("has_page")) & ((F.col("s2") != "QUEUED") | (F.col("n1") == 0)), F.col("s2"))
        .when(kind == "SubscriptionChanged", F.concat("s1", F.lit(":"), "s2"))
    )
    rows = dealt.automata("letter", machines(p), "machine", rows.withColumn("letter", letter)).drop("part", "machine", "name", "letter").withColumnsRenamed({"before": "was", "taken": "moved"})

    # what the fleet was before: clock, numbers, the group of a window
    due = windows.select("fleet", "key", "end_ms", "manifest", "n_results")
    rows = _beside(rows, kind == "WindowFinalized", due, ["fleet", "key"])
    boundary = ~kind.isin("ResultFinalized", "AlertCreated")
    opened = F.coalesce((kind == "WindowFinalized") & (F.col("n1") == F.col("n_results")), F.lit(False))
    dealt = Dealt(rows, ["fleet"], ["seq"])
    rows = dealt.prefixes({
        "clock": ("max", F.when((kind == "Tick") & (F.col("n1") == F.col("at_ms")), F.col("n1"))), "numbered": ("max", F.when(kind == "SourceAccepted", F.struct("seq", "n1"))),
        "opener": ("max", F.when(boundary, F.struct("seq", F.col("key").alias("window"), opened.alias("opened"), F.col("end_ms").alias("window_end")))),
    }).drop("part")
    group = F.when(boundary, F.when(opened, F.col("seq"))).when(F.col("opener.opened"), F.col("opener.seq"))
    rows = rows.withColumn("group", group).withColumn("window", F.when(~boundary & group.isNotNull(), F.col("opener.window"))).withColumn("window_end", F.col("opener.window_end")).withColumn("last_n1", F.col("numbered.n1"))
    alone = Window.partitionBy("fleet", F.coalesce("group", -F.col("seq")))  # a group has as many rows as its window has results and alerts
    result = F.when(kind == "ResultFinalized", 1)
    rows = rows.withColumn("position", F.sum(result).over(alone.orderBy("seq"))).withColumn("found", F.count(result).over(alone)).drop("opener", "numbered")
    rows = _beside(rows, kind == "ResultFinalized", results.select("fleet", F.col("key").alias("window"), "position", F.col("hash").alias("should")), ["fleet", "window", "position"])
    hits = results.where("hit").select("fleet", F.col("key").alias("window"), F.col("hash").alias("s1"), F.col("manifest").alias("of_manifest"), F.col("config").alias("of_config"), F.lit(True).alias("is_hit"))
    rows = _beside(rows, kind == "AlertCreated", hits, ["fleet", "window", "s1"])
    firsts = dealt.rows.where((kind == "SourceBuffered") & _ahead()).groupBy("fleet", "key", "n3").agg(F.min("seq").alias("first_seq"))
    rows = written(_beside(rows, kind == "SourceBuffered", firsts, ["fleet", "key", "n3"]), "judged")
    alerts = _alerts(rows.where(kind.isin(*ALERTS)), rows.where(kind == "KeysRevoked"), roster, p)
    rest = rows.where(~kind.isin(*ALERTS)).select(*rows.columns, *(F.lit(None).cast(t).alias(c) for c, t in (("created", "boolean"), ("taken", "boolean"), ("signed", "boolean"))))
    every = rest.unionByName(alerts.select(*rest.columns))
    return every.select("fleet", "seq", "kind", "key", _fault().alias("fault"))


def _beside(rows: DataFrame, which: Column, few: DataFrame, on: list[str]) -> DataFrame:
    """Join what belongs to the rows for which ``which`` holds; the others are dealt out by their own
    numbers, so that no key of theirs, which may be null, is hot."""
    names = [c for c in few.columns if c not in on]
    few = few.dropDuplicates(on).select(*[F.col(c).cast("string").alias(f"_{c}") for c in on], *names)
    last = F.when(which, F.col(on[-1]).cast("string")).otherwise(F.concat(F.lit("no "), F.col("seq")))
    same = [F.col(c).cast("string") == F.col(f"_{c}") for c in on[:-1]] + [last == F.col(f"_{on[-1]}")]
    if len(on) > 2:  # the middle ones may be null as well
        same[1:-1] = [F.when(which, F.col(c).cast("string")).otherwise(F.lit("no")) == F.col(f"_{c}") for c in on[1:-1]]
    return rows.join(few, same, "left").drop(*[f"_{c}" for c in on])


def _ahead() -> Column:
    """Whether a buffered entry lies ahead of its source's head, in a source that hasn't ended."""
    head = F.when(F.col("was") != "T", F.split_part("was", F.lit(":"), F.lit(1)).cast("bigint"))
    return F.col("forked").isNull() & (F.col("n3") > head)


def _alerts(rows: DataFrame, revoked: DataFrame, roster: DataFrame, p: Params) -> DataFrame:
    """Rows about alerts with created, signed and taken: whether they made an alert, bear the voter's key, and are moves.

    Creation makes an alert anew.  A watcher's first vote that suits the alert is the only one that can count,
    so when a quorum is reached doesn't depend on states.  Revisions count votes, changes, degradation
    and deliveries; the latter don't depend on the alert's state and are taken off, which leaves a bounded number."""
    kind, by = F.col("kind"), ["fleet", "key"]
    created = (kind == "AlertCreated") & F.coalesce(F.col("is_hit"), F.lit(False)) & (F.col("n1") == F.col("window_end") + p.vote_ttl_ms)
    dealt = Dealt(rows.withColumn("created", F.coalesce(created, F.lit(False))).withColumn("machine", F.lit("alert")), by, ["seq"])
    sent = F.when((kind == "DeliveryChanged") & F.col("moved"), 1)
    born = F.struct("seq", F.col("n1").alias("expires"), F.col("of_manifest").alias("manifest"), F.col("of_config").alias("config"))
    rows = dealt.prefixes({"sent": ("sum", sent), "born": ("max", F.when(F.col("created"), born))})
    rows = dealt.prefixes({"sent_at_birth": ("max", F.when(F.col("created"), F.struct("seq", F.coalesce("sent", F.lit(0)).alias("n"))))}, rows=rows)
    vote = kind == "VoteAccepted"
    rows = rows.withColumn("config", F.col("born.config")).withColumn("birth", F.col("born.seq"))
    listed = roster.where("enabled").select("fleet", "config", F.col("watcher").alias("n1"), "key_id", "domain")
    rows = _beside(rows, vote, listed, ["fleet", "config", "n1"])
    gone = revoked.groupBy("fleet", F.col("key").alias("s3")).agg(F.min("seq").alias("revoked_seq"))
    rows = _beside(rows, vote, gone, ["fleet", "s3"])
    suits = vote & (F.col("s1") == F.col("config")) & (F.col("s2") == F.col("born.manifest")) & F.col("key_id").isNotNull()
    rows = rows.withColumn("suits", F.coalesce(suits, F.lit(False))).withColumn("signed", ~F.col("suits") | F.coalesce(F.col("s3") == F.col("key_id"), F.lit(False)))
    rows = written(rows.withColumn("counts", F.col("suits") & F.col("signed") & (F.col("at_ms") < F.col("born.expires"))), "votes")
    cast = rows.where("counts").groupBy(*by, "birth", "n1").agg(F.min("seq").alias("first_vote"), F.min_by(F.expr("revoked_seq is null or revoked_seq > seq"), "seq").alias("eligible"))
    domains = rows.where("counts").join(cast.where("eligible").select(*by, "birth", F.col("first_vote").alias("seq")), [*by, "birth", "seq"], "left_semi").groupBy(*by, "birth", "domain").agg(F.min("seq").alias("seq"))
    quorum = domains.groupBy(*by, "birth").agg(F.try_element_at(F.array_sort(F.collect_list("seq")), F.lit(p.quorum)).alias("quorum_seq"))  # a roster's domains
    rows = rows.join(cast.select(*by, "birth", "n1", "first_vote"), [*by, "birth", "n1"], "left").join(quorum, [*by, "birth"], "left")
    revision = F.col("n1") - F.coalesce("sent", F.lit(0)) + F.coalesce("sent_at_birth.n", F.lit(0))
    edge, acted = F.concat_ws(" ", "s1", "s2"), F.col("s3").isNotNull()
    legal = F.create_map(*(F.lit(x) for e, by_actor in ALERT_EDGES.items() for x in (e, by_actor)))[edge] == acted
    legal = legal & ((F.col("s2") != "CORROBORATED") | F.coalesce(F.col("quorum_seq") < F.col("seq"), F.lit(False))) & ((F.col("s2") != "EXPIRED") | (F.col("at_ms") >= F.col("born.expires")))
    bounded = revision.between(1, most(p))
    letter = (
        F.when(F.col("created"), "create").when(F.col("counts") & (F.col("first_vote") == F.col("seq")), "vote")
        .when((kind == "AlertChanged") & legal & bounded, F.concat_ws(":", F.lit("change"), "s1", "s2", revision.cast("string"))).when((kind == "AlertDegraded") & bounded, F.concat(F.lit("degrade:"), revision))
    )
    return dealt.automata("letter", {"alert": machines(p)["alert"]}, "machine", rows.withColumn("letter", letter))


def _fault() -> Column:
    kind, n1, at = F.col("kind"), F.col("n1"), F.col("at_ms")
    no = lambda ok, why: F.when(F.coalesce(ok, F.lit(False)), F.lit(None)).otherwise(why)
    active = F.concat(F.col("epoch") - 1, F.lit(":"), "predecessor", F.lit("|"))
    in_chain = F.col("was") == F.concat(F.col("n3") - 1, F.lit(":"), "s3")
    ended = F.col("forked").isNotNull() | (F.col("was") == "T")
    return (
        F.when(kind == "Tick", no((n1 == at) & (F.col("clock").isNull() | (n1 > F.col("clock"))), TRANSITION))
        .when(kind == "ConfigScheduled", F.when(F.col("known").isNull(), MISSING).otherwise(no(F.col("moved"), F.when(F.col("was").startswith(active) | F.col("was").startswith(f"0:{ZERO}"), TRANSITION).otherwise(CHAIN))))
        .when(kind == "ConfigActivated", no(F.col("moved"), TRANSITION))
        .when(kind.isin("KeysRevoked", "FleetChanged"), F.lit(None))
        .when(kind == "SourceAccepted", F.when(ended, TRANSITION).when(~F.coalesce(in_chain, F.lit(False)), CHAIN).when(F.coalesce(n1 == F.coalesce(F.col("last_n1") + 1, F.lit(1)), F.lit(False)), no(F.col("moved"), TRANSITION)).otherwise(CHAIN))
        .when(kind == "SourceBuffered", no(_ahead() & (F.col("first_seq") == F.col("seq")), TRANSITION))
        .when(kind == "SourceForkObserved", no(F.col("fork"), TRANSITION))
        .when(kind == "WindowFinalized", F.when(F.col("manifest").isNull(), MISSING).when(~F.coalesce((F.col("manifest") == F.col("s1")) & (n1 == F.col("n_results")), F.lit(False)), REPLAY).otherwise(no(F.col("found") == n1, TRANSITION)))
        .when(kind == "ResultFinalized", F.when(F.col("window").isNull(), TRANSITION).otherwise(no(F.col("s1") == F.col("should"), REPLAY)))
        .when(kind == "AlertCreated", no(F.col("created"), TRANSITION))
        .when(kind == "VoteAccepted", no(F.col("taken"), F.when(F.col("signed"), TRANSITION).otherwise(SIGNATURE)))
        .when(kind.isin("AlertChanged", "AlertDegraded"), no(F.col("taken"), TRANSITION))
        .when(kind == "DeliveryChanged", F.when(F.col("s3").isNotNull() & F.col("has_page").isNull(), MISSING).otherwise(no(F.col("moved"), TRANSITION)))
        .when(kind == "SubscriptionChanged", no(F.col("moved"), TRANSITION))
        .otherwise(TRANSITION)
    )


def frame(journal: DataFrame, fleet, after: int, through: int, limit: int = 128, budget: int = 1 << 20) -> DataFrame:
    """Rows of (after, through] up to ``limit`` and ``budget`` bytes, the first one always,
    with more: whether others follow.  At most ``limit`` + 1 rows are ordered."""
    rows = journal.where((F.col("fleet") == F.lit(fleet)) & (F.col("seq") > after) & (F.col("seq") <= through)).orderBy("seq").limit(limit + 1)
    w = Window.partitionBy("fleet").orderBy("seq")
    rows = rows.withColumn("bytes_so_far", F.sum(F.octet_length(text_of(*MEMBERS))).over(w)).withColumn("n", F.row_number().over(w)).withColumn("all_n", F.count("*").over(Window.partitionBy("fleet")))
    shown = rows.where(((F.col("n") == 1) | (F.col("bytes_so_far") <= budget)) & (F.col("n") <= limit))
    return shown.withColumn("more", F.col("all_n") > F.count("*").over(Window.partitionBy("fleet"))).drop("n", "all_n")


def checkpoints(journal: DataFrame) -> DataFrame:
    """The head of each fleet's journal: seq, hash, at_ms and bytes accounted for."""
    return journal.groupBy("fleet").agg(F.max("seq").alias("seq"), F.max_by("hash", "seq").alias("hash"), F.max("at_ms").alias("at_ms"), F.sum(F.octet_length(text_of(*MEMBERS))).alias("bytes"))


def capacity(used: Column, hard: int) -> Column:
    """RUNNING, WARNING from 80 % of the hard limit on, READ_ONLY from 90 % on."""
    return F.when(used * 10 >= hard * 9, "READ_ONLY").when(used * 10 >= hard * 8, "WARNING").otherwise("RUNNING")


def exported(journal: DataFrame, pins: DataFrame) -> DataFrame:
    """The rows up to each pinned checkpoint (fleet, seq, hash) that the journal really has."""
    good = pins.join(journal.select("fleet", "seq", "hash"), ["fleet", "seq", "hash"], "left_semi").select("fleet", F.col("seq").alias("through"))
    return journal.join(good, "fleet").where("seq <= through")


def head_order(seq: Column, hash_: Column, other_seq: Column, other_hash: Column, hash_there: Column | None = None) -> Column:
    """SAME, CONFLICT (one number, two hashes), DESCENDS (further on) or BEHIND.  hash_there: what the journal of the
    first head holds at the other's number; where it is given, descent asks for the other's hash there, else it is a CONFLICT."""
    further = F.when(hash_there == other_hash, "DESCENDS").otherwise("CONFLICT") if hash_there is not None else F.lit("DESCENDS")
    return F.when((seq == other_seq) & (hash_ == other_hash), "SAME").when(seq == other_seq, "CONFLICT").when(seq > other_seq, further).otherwise("BEHIND")


def parsed_head(text: Column) -> Column:
    """(seq, hash) of ``seq:hash``, null for other strings."""
    fits = text.rlike(r"\A(0|[1-9][0-9]{0,18}):[0-9a-f]{64}\z")
    seq = F.split_part(text, F.lit(":"), F.lit(1)).try_cast("bigint")
    return F.when(fits & seq.isNotNull(), F.struct(seq.alias("seq"), F.split_part(text, F.lit(":"), F.lit(2)).alias("hash")))


def watched(journal: DataFrame, cursors: DataFrame, expected: DataFrame, watcher: int) -> DataFrame:
    """One pass of a watcher: alerts after its cursor whose result it recomputes to the same
    hash get its vote, others a refusal.  cursors: fleet, seq."""
    new = journal.join(cursors.select("fleet", F.col("seq").alias("after")), "fleet", "left").where("kind = 'AlertCreated' and seq > coalesce(after, 0)")
    mine = expected.where("hit").select("fleet", F.col("hash").alias("key"), F.lit(True).alias("same"))
    return new.join(mine, ["fleet", "key"], "left").select("fleet", "seq", F.col("key").alias("result"), F.lit(watcher).cast("bigint").alias("watcher"), F.when(F.col("same"), "VOTE").otherwise("REFUSE").alias("action"))


def replay_faults(manifests: DataFrame, inputs: DataFrame, history: DataFrame, cuts: DataFrame, witnesses: DataFrame) -> DataFrame:
    """(window, fault): what keeps a window's stored slice from being replayed, in the order of checks.

    manifests: fleet, epoch, start_ms, end_ms, n_inputs, n_history, through; inputs: fleet, epoch,
    start_ms, position, idx, received_ms, hash, listed (the manifest's hash at that position);
    history: fleet, epoch, start_ms, position, prior_start_ms, prior_end_ms, prior_epoch, prior_hash (the prior manifest's digest), listed;
    cuts: fleet, epoch, start_ms, source, last_input, last_ms; witnesses: fleet, epoch, start_ms, source, hash, received_ms, kind of each
    cut's last input.  Repeated witnesses of a source are too many."""
    by = ["fleet", "epoch", "start_ms"]
    order = Window.partitionBy(*by).orderBy("position")
    rows = inputs.join(manifests.select(*by, "end_ms", "through"), by).withColumn("last_idx", F.lag("idx").over(order))
    per = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.bool_or(~F.col("hash").eqNullSafe(F.col("listed"))).alias("other"), F.coalesce(F.bool_or(F.expr("idx <= last_idx")), F.lit(False)).alias("disorder"),
        F.bool_or(F.expr("received_ms < start_ms or received_ms >= end_ms")).alias("outside"), F.bool_or(F.expr("idx > through")).alias("beyond"),
    )
    past = history.withColumn("last_end", F.lag("prior_end_ms").over(order)).groupBy(*by).agg(
        F.count("*").alias("told_history"), F.bool_or(F.expr("prior_epoch <> epoch")).alias("foreign"), F.coalesce(F.bool_or(F.expr("prior_start_ms <> last_end")), F.lit(False)).alias("gap"), (F.max("prior_end_ms") != F.col("start_ms")).alias("short"),
        F.bool_or(~F.col("prior_hash").eqNullSafe(F.col("listed"))).alias("renamed"),
    )
    seen = witnesses.select(*by, "source", F.col("hash").alias("w_hash"), F.col("received_ms").alias("w_ms"), F.col("kind").alias("w_kind"))
    both = cuts.where("last_input is not null").select(*by, "source", "last_input", "last_ms").join(seen, [*by, "source"], "full_outer")
    proof = both.groupBy(*by).agg(
        (F.count("last_input") != F.count("w_hash")).alias("w_length"), F.bool_or(F.expr("(last_input is null) <> (w_hash is null)")).alias("w_source"), F.bool_or(F.expr("last_input <> w_hash")).alias("w_other"),
        F.bool_or(~F.col("last_ms").eqNullSafe(F.col("w_ms"))).alias("w_time"), F.bool_or(F.col("w_kind") == "signal").alias("w_signal"),
    )
    joined = manifests.select(*by, "n_inputs", "n_history").join(per, by, "left").join(past, by, "left").join(proof, by, "left")
    told = F.coalesce("told_history", F.lit(0))
    fault = (
        F.when(F.coalesce("n", F.lit(0)) != F.col("n_inputs"), "LENGTH").when(F.col("other"), "INPUT_HASH").when(F.col("disorder"), "INDEX_ORDER").when(F.col("outside"), "OUTSIDE_WINDOW").when(F.col("beyond"), "BEYOND_THROUGH")
        .when((told > 5) | (told != F.col("n_history")), "HISTORY_LENGTH").when(F.col("renamed"), "HISTORY_HASH").when(F.col("foreign"), "HISTORY_EPOCH").when(F.col("gap"), "HISTORY_GAP").when(F.col("short"), "HISTORY_END")
        .when(F.col("w_length"), "WITNESS_LENGTH").when(F.col("w_source"), "WITNESS_SOURCE").when(F.col("w_other"), "WITNESS_HASH").when(F.col("w_time"), "WITNESS_TIME").when(F.col("w_signal"), "WITNESS_SIGNAL")
    )
    return joined.select(*by, fault.alias("fault"))
