"""Admission, votes, alerts, delivery, journal, configuration and evaluation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vigil.functions import kernels as K
from vigil.functions.strict import strict_json
from vigil.operators import evaluate as E
from vigil.operators import journal as J
from vigil.operators import sequence as S
from vigil.operators import votes as V
from vigil.sources import exports as X

from . import tables as T
from .registry import query

# ---- arrivals: conversation turns, with a gap every ninth conversation, duplicates and forks

ARR = """arr AS (SELECT CAST(conv_id AS VARCHAR) AS source, turn + 1 AS seq, md5(role || ':' || text) AS hash, conv_id * 1000 + (turn * 7) % 5 * 100 + copy AS arrival_ms,
  ((turn * 7) % 5) * 100 + turn * 2 + copy AS arrival, copy
  FROM conversations CROSS JOIN (VALUES (0), (1)) c(copy) WHERE (copy = 0 AND NOT (conv_id % 9 = 0 AND turn = 2)) OR (copy = 1 AND turn % 4 = 1)),
arrivals AS (SELECT source, seq, CASE WHEN copy = 1 AND CAST(source AS BIGINT) % 7 = 3 THEN md5(hash) ELSE hash END AS hash, arrival_ms, arrival FROM arr)"""


def arrivals(spark, d):
    c = T.table(spark, d, "conversations").crossJoin(F.broadcast(spark.range(2).select(F.col("id").alias("copy"))))
    c = c.where("(copy = 0 and not (conv_id % 9 = 0 and turn = 2)) or (copy = 1 and turn % 4 = 1)")
    mixed, hash_ = (F.col("turn") * 7) % 5 * 100, F.md5(F.concat("role", F.lit(":"), "text"))
    return c.select(
        F.col("conv_id").cast("string").alias("source"), (F.col("turn") + 1).alias("seq"),
        F.when((F.col("copy") == 1) & (F.col("conv_id") % 7 == 3), F.md5(hash_)).otherwise(hash_).alias("hash"),
        (F.col("conv_id") * 1000 + mixed + F.col("copy")).alias("arrival_ms"), (mixed + F.col("turn") * 2 + F.col("copy")).alias("arrival"),
    )


@query("W03_fork_detect", f"""WITH {ARR}, v AS (SELECT *, first(hash) OVER s AS f, row_number() OVER s AS n FROM arrivals WINDOW s AS (PARTITION BY source, seq ORDER BY arrival))
SELECT source, seq, arrival, CASE WHEN n = 1 THEN 'NEW' WHEN hash = f THEN 'DUPLICATE' ELSE 'FORK' END AS verdict FROM v""")
def fork_detect(spark, d):
    return S.slot_verdicts(arrivals(spark, d)).select("source", "seq", "arrival", "verdict")


@query("J10_slot_lookup", f"""WITH {ARR}, f AS (SELECT source, seq, arg_min(hash, arrival) AS h FROM arrivals GROUP BY ALL)
SELECT source, count(*) FILTER (hash = h) AS same, count(*) FILTER (hash <> h) AS different FROM arrivals JOIN f USING (source, seq) GROUP BY source""")
def slot_lookup(spark, d):
    a = arrivals(spark, d)
    slots = a.groupBy("source", "seq").agg(F.min_by("hash", "arrival").alias("h"))
    return a.join(slots, ["source", "seq"]).groupBy("source").agg(F.count_if(F.expr("hash = h")).alias("same"), F.count_if(F.expr("hash <> h")).alias("different"))


@query("W05_gap_prefix", f"""WITH {ARR}, x AS (SELECT source, seq, row_number() OVER (PARTITION BY source ORDER BY seq) AS n FROM (SELECT DISTINCT source, seq FROM arrivals)),
g AS (SELECT source, coalesce(max(seq) FILTER (seq = n), 0) AS head, count(*) FILTER (seq <> n) AS pending FROM x GROUP BY source)
SELECT *, CASE WHEN pending > 0 THEN head + 1 END AS missing FROM g""")
def gap_prefix(spark, d):
    return S.gaps(arrivals(spark, d))


@query("W06_accept_time", f"""WITH {ARR}, f AS (SELECT source, seq, min(arrival_ms) AS t FROM arrivals GROUP BY ALL),
x AS (SELECT source, seq, row_number() OVER s AS n, max(t) OVER s AS accept_ms FROM f WINDOW s AS (PARTITION BY source ORDER BY seq))
SELECT source, seq, accept_ms FROM x WHERE seq = n""")
def accept_time(spark, d):
    return S.accepted_times(arrivals(spark, d))


@query("W07_global_index", f"""WITH {ARR}, f AS (SELECT source, seq, min(arrival_ms) AS t FROM arrivals GROUP BY ALL),
x AS (SELECT source, seq, row_number() OVER s AS n, max(t) OVER s AS accept_ms FROM f WINDOW s AS (PARTITION BY source ORDER BY seq))
SELECT CAST(source AS BIGINT) % 10 AS fleet, source, seq, accept_ms, row_number() OVER (PARTITION BY CAST(source AS BIGINT) % 10 ORDER BY accept_ms, source, seq) AS index FROM x WHERE seq = n""")
def global_index(spark, d):
    return S.indexed(S.accepted_times(arrivals(spark, d)).withColumn("fleet", F.col("source").cast("bigint") % 10))


@query("J02_next_buffered", f"""WITH {ARR}, s AS (SELECT DISTINCT source, seq FROM arrivals), x AS (SELECT source, seq, row_number() OVER (PARTITION BY source ORDER BY seq) AS n FROM s)
SELECT source, min(seq) AS next_seq FROM x WHERE seq <> n GROUP BY source""")
def next_buffered(spark, d):
    seqs = arrivals(spark, d).select("source", "seq").distinct()
    n = F.row_number().over(Window.partitionBy("source").orderBy("seq"))
    return seqs.withColumn("n", n).where("seq <> n").groupBy("source").agg(F.min("seq").alias("next_seq"))


@query("T05_admission")
def admission(spark, d):
    a = arrivals(spark, d)
    links = a.groupBy("source", "seq").agg(F.min_by("hash", "arrival").alias("first_hash"))
    before = links.select("source", (F.col("seq") + 1).alias("seq"), F.col("first_hash").alias("prev"))
    return S.admit(a.join(before, ["source", "seq"], "left").select("source", "seq", "hash", F.coalesce("prev", F.lit("")).alias("prev"), "arrival", "arrival_ms", F.lit(False).alias("terminal")))


@query("W08_logical_clock", "SELECT event_id, max(epoch_us(ts) // 1000 - event_id % 7 * 100000) OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS logical_ms FROM events")
def logical_clock(spark, d):
    e = T.table(spark, d, "events").select("event_id", (F.col("user_id") % 8).alias("fleet"), (T.millis("ts") - F.col("event_id") % 7 * 100000).alias("wall_ms"))
    return S.logical_clock(e, ["fleet"], ["event_id"]).select("event_id", "logical_ms")


@query("F06_future_reject", f"WITH {T.OBS} SELECT idx, received_ms + k * 2000 > received_ms + 60000 AS rejected FROM base")
def future_reject(spark, d):
    return T.base(spark, d).select("idx", K.future(F.col("received_ms") + F.col("k") * 2000, F.col("received_ms")).alias("rejected"))


@query("F19_freshness", f"WITH {T.OBS} SELECT source, count(*) FILTER (abs(received_ms - observed_ms) <= 60000) AS fresh FROM base GROUP BY source")
def freshness(spark, d):
    return T.base(spark, d).groupBy("source").agg(F.count_if(F.abs(F.col("received_ms") - F.col("observed_ms")) <= 60000).alias("fresh"))


# ---- journal: conversation turns as a hash chain, broken in places

JRN = """jrn AS (SELECT conv_id AS fleet, turn AS seq, md5(text) AS hash, CASE WHEN (conv_id + turn) % 23 = 0 THEN 'broken' ELSE lag(md5(text)) OVER (PARTITION BY conv_id ORDER BY turn) END AS prev,
  CASE WHEN turn % 3 = 0 THEN 'WindowFinalized' WHEN turn % 3 = 1 THEN 'ResultFinalized' ELSE 'AlertCreated' END AS kind,
  CASE turn % 4 WHEN 0 THEN 'CANDIDATE' WHEN 1 THEN 'CORROBORATED' WHEN 2 THEN CASE WHEN conv_id % 3 = 0 THEN 'EXPIRED' ELSE 'ACKNOWLEDGED' END ELSE 'CLOSED' END AS state, octet_length(encode(text)) AS bytes FROM conversations)"""


def chain(spark, d):
    c = T.table(spark, d, "conversations").withColumn("hash", F.md5("text"))
    before, t = F.lag("hash").over(Window.partitionBy("conv_id").orderBy("turn")), F.col("turn")
    third = F.when(F.col("conv_id") % 3 == 0, "EXPIRED").otherwise("ACKNOWLEDGED")
    return c.select(
        F.col("conv_id").alias("fleet"), t.alias("seq"), "hash", F.when((F.col("conv_id") + t) % 23 == 0, "broken").otherwise(before).alias("prev"),
        F.when(t % 3 == 0, "WindowFinalized").when(t % 3 == 1, "ResultFinalized").otherwise("AlertCreated").alias("kind"),
        F.when(t % 4 == 0, "CANDIDATE").when(t % 4 == 1, "CORROBORATED").when(t % 4 == 2, third).otherwise("CLOSED").alias("state"), F.octet_length("text").cast("bigint").alias("bytes"),
    )


@query("F16_chain_check", f"""WITH {JRN}, x AS (SELECT *, lag(seq) OVER s AS ps, lag(hash) OVER s AS ph FROM jrn WINDOW s AS (PARTITION BY fleet ORDER BY seq))
SELECT fleet, seq, ps IS NULL OR (seq = ps + 1 AND coalesce(prev = ph, false)) AS linked FROM x""")
def chain_check(spark, d):
    return S.chain_errors(chain(spark, d), ["fleet"]).select("fleet", "seq", "linked")


@query("W04_chain_breaks", f"""WITH {JRN}, x AS (SELECT *, lag(seq) OVER s AS ps, lag(hash) OVER s AS ph FROM jrn WINDOW s AS (PARTITION BY fleet ORDER BY seq))
SELECT fleet, min(seq) AS first_break, count(*) AS n FROM x WHERE NOT (ps IS NULL OR (seq = ps + 1 AND coalesce(prev = ph, false))) GROUP BY fleet""")
def chain_breaks(spark, d):
    return S.chain_errors(chain(spark, d), ["fleet"]).where("not linked").groupBy("fleet").agg(F.min("seq").alias("first_break"), F.count("*").alias("n"))


LEGAL = [("CANDIDATE", "CORROBORATED"), ("CANDIDATE", "EXPIRED"), ("CANDIDATE", "CLOSED"), ("CORROBORATED", "ACKNOWLEDGED"), ("CORROBORATED", "CLOSED"), ("ACKNOWLEDGED", "CLOSED")]


@query("W13_transitions", f"""WITH {JRN}, x AS (SELECT *, lag(state) OVER (PARTITION BY fleet ORDER BY seq) AS prev_state FROM jrn)
SELECT fleet, seq, prev_state, state FROM x WHERE prev_state IS NOT NULL AND (prev_state, state) NOT IN ({', '.join(map(str, LEGAL))})""")
def transitions(spark, d):
    legal = spark.createDataFrame(LEGAL, "prev_state string, state string")
    return J.illegal(chain(spark, d), ["fleet"], legal).select("fleet", "seq", "prev_state", "state")


@query("W10_page_budget", f"""WITH x AS (SELECT doc_id AS seq, octet_length(encode(text)) AS bytes FROM documents WHERE doc_id > 20 ORDER BY doc_id LIMIT 128),
y AS (SELECT *, CAST(sum(bytes) OVER (ORDER BY seq) AS BIGINT) AS bytes_so_far, row_number() OVER (ORDER BY seq) AS n FROM x) SELECT seq, bytes, bytes_so_far FROM y WHERE n = 1 OR bytes_so_far <= 131072""")
def page_budget(spark, d):
    rows = T.table(spark, d, "documents").select(F.col("doc_id").alias("seq"), F.octet_length("text").cast("bigint").alias("bytes"))
    return J.page(rows, 20, 128, 131072)


@query("L02_keyset_page", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 129")
def keyset_page(spark, d):
    return J.keyset(T.table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 1000, 129)


OBJ = "objs AS (SELECT lang AS kind, CAST(doc_id % 97 AS VARCHAR) AS hash, CAST(doc_id % 194 AS VARCHAR) AS value, doc_id AS seq FROM documents)"


def objects(spark, d):
    i = F.col("doc_id")
    return T.table(spark, d, "documents").select(F.col("lang").alias("kind"), (i % 97).cast("string").alias("hash"), (i % 194).cast("string").alias("value"), i.alias("seq"))


@query("U05_object_conflict", f"WITH {OBJ} SELECT kind, hash, count(*) AS n FROM objs GROUP BY ALL HAVING count(DISTINCT value) > 1")
def object_conflict(spark, d):
    return J.conflicts(objects(spark, d)).select("kind", "hash", "n")


@query("A15_first_reference", f"WITH {OBJ} SELECT kind, hash, min(seq) AS first_seq FROM objs GROUP BY ALL")
def first_reference(spark, d):
    return J.first_reference(objects(spark, d))


@query("J03_object_range", f"WITH {OBJ}, f AS (SELECT kind, hash, min(seq) AS first_seq FROM objs GROUP BY ALL) SELECT objs.kind, objs.hash, objs.value, objs.seq FROM objs JOIN f ON objs.kind = f.kind AND objs.hash = f.hash AND objs.seq = f.first_seq WHERE first_seq BETWEEN 50 AND 300")
def object_range(spark, d):
    o = objects(spark, d)
    return o.join(J.first_reference(o).where("first_seq between 50 and 300"), ["kind", "hash"]).where("seq = first_seq").select("kind", "hash", "value", "seq")


# ---- configuration epochs

CFG = """cfg AS (SELECT source AS fleet, e AS epoch, 1704067200000 + e * 259200000 + source * 3600000 AS effective_ms, 1704067200000 + e * 259200000 + source * 3600000 - 86400000 AS scheduled_ms,
  range(0, e * (source + 1) % 7 + e) AS revoked FROM range(8) s(source), range(9) t(e))"""


def configs(spark):
    both = spark.range(8).select(F.col("id").alias("fleet")).crossJoin(spark.range(9).select(F.col("id").alias("epoch")))
    start, n = F.col("epoch") * 259200000 + F.col("fleet") * 3600000 + 1704067200000, F.col("epoch") * (F.col("fleet") + 1) % 7 + F.col("epoch")
    keys = F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    return both.select("fleet", "epoch", start.alias("effective_ms"), (start - 86400000).alias("scheduled_ms"), keys.alias("revoked"))


@query("J14_config_asof", f"WITH {T.OBS}, {CFG}, x AS (SELECT *, lead(effective_ms) OVER (PARTITION BY fleet ORDER BY effective_ms) AS until_ms FROM cfg) SELECT idx, source AS fleet, epoch FROM base JOIN x ON source = fleet AND received_ms >= effective_ms AND (until_ms IS NULL OR received_ms < until_ms)")
def config_asof(spark, d):
    rows = T.base(spark, d).select("idx", F.col("source").alias("fleet"), "received_ms")
    return J.in_force(rows, configs(spark), "received_ms").select("idx", "fleet", "epoch")


# ---- votes and alerts: a result for each user, votes from its events

VOTE = """vote AS (SELECT user_id AS result, event_id % 3 AS config, CAST(event_id % 5 AS VARCHAR) AS watcher, epoch_us(ts) // 1000 AS at_ms, event_id AS vote FROM events),
roster AS (SELECT c AS config, CAST(w AS VARCHAR) AS watcher, 'd' || CAST(w % 3 AS VARCHAR) AS domain, w <> 4 OR c = 0 AS enabled FROM range(3) a(c), range(5) b(w)),
fv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY result, watcher ORDER BY at_ms, vote) AS n FROM vote) WHERE n = 1),
cv AS (SELECT fv.*, domain FROM fv LEFT JOIN (SELECT * FROM roster WHERE enabled) r ON r.config = fv.config AND r.watcher = fv.watcher),
dm AS (SELECT result, domain, min(at_ms) AS at_ms FROM cv WHERE domain IS NOT NULL GROUP BY ALL),
q AS (SELECT result, string_agg(domain, ',' ORDER BY domain) AS domains, count(*) >= 2 AS corroborated, list_sort(list(at_ms))[2] AS corroborated_ms FROM dm GROUP BY result),
al AS (SELECT user_id AS result, min(epoch_us(ts) // 1000) + 180000000 AS expires_ms FROM events GROUP BY user_id),
st AS (SELECT al.result, expires_ms, corroborated_ms, CASE WHEN corroborated_ms < expires_ms THEN 'CORROBORATED' WHEN expires_ms <= 1704400000000 THEN 'EXPIRED' ELSE 'CANDIDATE' END AS state FROM al LEFT JOIN q USING (result))"""


def votes(spark, d):
    v = T.table(spark, d, "events").select(
        F.col("user_id").alias("result"), (F.col("event_id") % 3).alias("config"), (F.col("event_id") % 5).cast("string").alias("watcher"), T.millis("ts").alias("at_ms"), F.col("event_id").alias("vote")
    )
    w = F.col("w")
    roster = spark.range(3).select(F.col("id").alias("config")).crossJoin(spark.range(5).select(F.col("id").alias("w")))
    roster = roster.select("config", w.cast("string").alias("watcher"), F.concat(F.lit("d"), (w % 3).cast("string")).alias("domain"), ((w != 4) | (F.col("config") == 0)).alias("enabled"))
    return V.counted_votes(v, roster)


def states(spark, d):
    alerts = T.table(spark, d, "events").groupBy(F.col("user_id").alias("result")).agg((F.min(T.millis("ts")) + 180000000).alias("expires_ms"))
    return V.alert_states(alerts, V.corroboration(votes(spark, d)), F.lit(1704400000000))


@query("J07_roster_join", f"WITH {VOTE} SELECT result, watcher, vote, domain FROM cv")
def roster_join(spark, d):
    return votes(spark, d).select("result", "watcher", "vote", "domain")


@query("A06_quorum", f"WITH {VOTE} SELECT result, domains, corroborated FROM q")
def quorum(spark, d):
    return V.corroboration(votes(spark, d)).select("result", "domains", "corroborated")


@query("T10_corroboration", f"WITH {VOTE} SELECT result, corroborated_ms FROM q WHERE corroborated")
def corroboration(spark, d):
    return V.corroboration(votes(spark, d)).where("corroborated").select("result", "corroborated_ms")


@query("T09_expiry", f"WITH {VOTE} SELECT result, expires_ms, corroborated_ms, state FROM st")
def expiry(spark, d):
    return states(spark, d).select("result", "expires_ms", "corroborated_ms", "state")


@query("A08_alert_counts", f"WITH {VOTE} SELECT count(*) FILTER (state = 'CANDIDATE') AS candidate, count(*) FILTER (state = 'CORROBORATED') AS corroborated, count(*) FILTER (state = 'EXPIRED') AS expired FROM st")
def alert_counts(spark, d):
    return states(spark, d).agg(*[F.count_if(F.col("state") == s.upper()).alias(s) for s in ("candidate", "corroborated", "expired")])


@query("F11_vote_gate", f"WITH {VOTE} SELECT vote, CASE WHEN vote % 6 = 0 THEN 'RESULT_MISMATCH' WHEN at_ms >= expires_ms THEN 'VOTE_EXPIRED' END AS error FROM vote JOIN al USING (result)")
def vote_gate(spark, d):
    e = T.table(spark, d, "events").select(F.col("user_id").alias("result"), F.col("event_id").alias("vote"), T.millis("ts").alias("at_ms"))
    rows = e.join(states(spark, d).select("result", "expires_ms"), "result")
    return rows.select("vote", K.vote_gate(F.col("vote") % 6 != 0, F.col("at_ms"), F.col("expires_ms"))["error"].alias("error"))


@query("F12_alert_action", """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'REVISION_CONFLICT' WHEN (event_id % 2 = 0 AND s = 'CORROBORATED') OR (event_id % 2 = 1 AND s IN ('CANDIDATE', 'CORROBORATED', 'ACKNOWLEDGED')) THEN NULL ELSE 'STATE_CONFLICT' END AS error
FROM (SELECT event_id, ['CANDIDATE', 'CORROBORATED', 'ACKNOWLEDGED', 'CLOSED', 'EXPIRED'][user_id % 5 + 1] AS s FROM events)""")
def alert_action(spark, d):
    i = F.col("event_id")
    s = F.element_at(F.array(*[F.lit(x) for x in ("CANDIDATE", "CORROBORATED", "ACKNOWLEDGED", "CLOSED", "EXPIRED")]), (F.col("user_id") % 5 + 1).cast("int"))
    action = F.when(i % 2 == 0, "ack").otherwise("close")
    return T.table(spark, d, "events").select("event_id", K.alert_action(s, action, F.lit(1), F.when(i % 4 == 0, 2).otherwise(1))["error"].alias("error"))


@query("J08_evidence_semi", f"WITH {T.OBS} SELECT DISTINCT subject AS result FROM base WHERE source IN (3, 6) AND kind = 'scope'")
def evidence_semi(spark, d):
    bad = T.sources(spark).where("source in (3, 6)").select("source")
    return T.base(spark, d).where("kind = 'scope'").join(F.broadcast(bad), "source", "left_semi").select(F.col("subject").alias("result")).distinct()


@query("T11_degrade", f"WITH {T.OBS}, a AS (SELECT DISTINCT idx % 500 AS result FROM base), b AS (SELECT DISTINCT idx % 500 AS result FROM base WHERE source = 5 AND late) SELECT a.result, CASE WHEN b.result IS NOT NULL THEN 'DEGRADED' ELSE 'VALID' END AS assurance FROM a LEFT JOIN b USING (result)")
def degrade(spark, d):
    rows = T.base(spark, d).withColumn("result", F.col("idx") % 500)
    bad = T.sources(spark).where("source = 5").select("source")
    return V.degraded(rows.select("result").distinct(), rows.where("late").select("result", "source"), bad)


@query("J12_page_dedup", f"WITH {VOTE} SELECT result FROM q WHERE corroborated AND result NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def page_dedup(spark, d):
    outbox = T.table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("result"))
    return V.new_pages(V.corroboration(votes(spark, d)).where("corroborated"), outbox)


ATT = """att AS (SELECT l_orderkey AS alert, l_linenumber AS attempt, CAST(l_orderkey AS BIGINT) * 1000 + l_linenumber AS at_ms, CASE WHEN l_partkey % 5 = 0 THEN 204 WHEN l_partkey % 5 = 1 THEN NULL WHEN l_partkey % 5 = 2 THEN 429 WHEN l_partkey % 11 = 3 THEN 404 ELSE 503 END AS status FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL))"""


def attempts(spark, d):
    p = F.col("l_partkey")
    status = F.when(p % 5 == 0, 204).when(p % 5 == 1, None).when(p % 5 == 2, 429).when(p % 11 == 3, 404).otherwise(503)
    rows = T.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("l_partkey"))
    return rows.select(F.col("l_orderkey").alias("alert"), F.col("l_linenumber").alias("attempt"), (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("at_ms"), status.alias("status"))


@query("X18_retry_delay", f"WITH {ATT} SELECT alert, attempt, CASE WHEN (status IS NULL OR status = 429 OR status >= 500) AND attempt < 8 THEN [1000, 2000, 4000, 8000, 16000, 32000, 60000][attempt] END AS delay_ms FROM att")
def retry_delay(spark, d):
    return attempts(spark, d).select("alert", "attempt", K.delivery_failure(F.col("attempt"), F.col("status"))["delay_ms"].alias("delay_ms"))


@query("T12_outbox", f"""WITH {ATT}, s AS (SELECT *, CASE WHEN status BETWEEN 200 AND 299 THEN 'DELIVERED' WHEN (status IS NULL OR status = 429 OR status >= 500) AND attempt < 8 THEN 'RETRY' ELSE 'FAILED' END AS state FROM att),
o AS (SELECT *, coalesce(bool_or(state <> 'RETRY') OVER (PARTITION BY alert ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over_ FROM s)
SELECT alert, attempt, state, CASE WHEN state = 'RETRY' THEN at_ms + [1000, 2000, 4000, 8000, 16000, 32000, 60000][attempt] END AS due_ms FROM o WHERE NOT over_""")
def outbox(spark, d):
    return V.delivery(attempts(spark, d)).select("alert", "attempt", "state", "due_ms")


@query("F21_due", f"WITH {ATT} SELECT count(*) AS n FROM att WHERE (status IS NULL OR status = 429 OR status >= 500) AND attempt < 8 AND at_ms + [1000, 2000, 4000, 8000, 16000, 32000, 60000][attempt] <= 5000000")
def due(spark, d):
    f = K.delivery_failure(F.col("attempt"), F.col("status"))
    rows = attempts(spark, d).select(f["state"].alias("state"), (F.col("at_ms") + f["delay_ms"]).alias("due_ms"))
    return rows.where("state in ('QUEUED', 'RETRY') and due_ms <= 5000000").agg(F.count("*").alias("n"))


@query("T14_idempotency", """WITH r AS (SELECT user_id AS key_id, event_id % 40 AS request_id, CAST(event_id % 3 AS VARCHAR) AS request_hash, epoch_us(ts) // 1000 AS at_ms, epoch_us(ts) // 1000 - event_id % 7 * 11000 AS sent_ms, event_id AS seq FROM events),
x AS (SELECT r.*, (SELECT min((f.at_ms, f.seq)) FROM r f WHERE f.key_id = r.key_id AND f.request_id = r.request_id AND f.at_ms - f.sent_ms <= 60000) AS f FROM r)
SELECT x.seq, CASE WHEN o.seq IS NULL OR (x.at_ms, x.seq) < (o.at_ms, o.seq) THEN 'STALE' WHEN x.seq = o.seq THEN 'NEW' WHEN x.request_hash <> o.request_hash THEN 'CONFLICT' WHEN x.at_ms - o.at_ms > 86400000 THEN 'EXPIRED' ELSE 'REPLAY' END AS outcome FROM x LEFT JOIN r o ON o.at_ms = f[1] AND o.seq = f[2]""")
def idempotency(spark, d):
    i, at = F.col("event_id"), T.millis("ts")
    r = T.table(spark, d, "events").select(F.col("user_id").alias("key_id"), (i % 40).alias("request_id"), (i % 3).cast("string").alias("request_hash"), at.alias("at_ms"), (at - i % 7 * 11000).alias("sent_ms"), i.alias("seq"))
    return J.once_a_day(r).select("seq", "outcome")


@query("T15_rate_limit")
def rate_limit(spark, d):
    """A key's bucket, then its fleet's."""
    i = F.col("event_id")
    r = T.table(spark, d, "events").select((F.col("user_id") % 100).alias("key_id"), (F.col("user_id") % 4).alias("fleet"), i.alias("request"), F.expr("event_id div 400").alias("at_ms"))
    return V.limited(r)


# ---- evaluation: labels against a length rule

UNIT = "unit AS (SELECT source AS detector, toxic = 1 AS positive, CASE WHEN n_chars % 7 = 0 THEN 'UNKNOWN' WHEN n_chars % 13 = 0 THEN 'SIGNAL' WHEN n_chars > 1500 THEN 'HIT' ELSE 'CLEAR' END AS status FROM documents JOIN labels USING (doc_id))"
CONF = f"""{UNIT}, conf AS (SELECT detector, count(*) FILTER (status = 'HIT' AND positive) AS tp, count(*) FILTER (status = 'HIT' AND NOT positive) AS fp, count(*) FILTER (status = 'CLEAR' AND positive) AS fn,
  count(*) FILTER (status = 'CLEAR' AND NOT positive) AS tn, count(*) FILTER (status = 'UNKNOWN' AND positive) AS unknown_positive, count(*) FILTER (status = 'UNKNOWN' AND NOT positive) AS unknown_negative,
  count(*) FILTER (status = 'SIGNAL') AS signals FROM unit GROUP BY detector)"""


def conf(spark, d):
    n = F.col("n_chars")
    status = F.when(n % 7 == 0, "UNKNOWN").when(n % 13 == 0, "SIGNAL").when(n > 1500, "HIT").otherwise("CLEAR")
    units = T.table(spark, d, "documents").select("doc_id", "source", "n_chars").join(T.table(spark, d, "labels"), "doc_id")
    return E.confusion(units.select(F.col("source").alias("detector"), (F.col("toxic") == 1).alias("positive"), status.alias("status")))


@query("A12_confusion", f"WITH {CONF} SELECT * FROM conf")
def confusion(spark, d):
    return conf(spark, d)


@query("A13_rates", f"""WITH {CONF} SELECT detector, CASE WHEN tp + fp > 0 THEN tp END AS precision_n, CASE WHEN tp + fp > 0 THEN tp + fp END AS precision_d, CASE WHEN tp + fn + unknown_positive > 0 THEN tp + fn + unknown_positive END AS recall_d,
CASE WHEN fp + tn + unknown_negative > 0 THEN fp END AS fpr_n, tp + fp + fn + tn AS coverage_n FROM conf""")
def rates(spark, d):
    r = K.rates(*[F.col(c) for c in ("tp", "fp", "fn", "tn", "unknown_positive", "unknown_negative")])
    return conf(spark, d).withColumn("r", r).select(
        "detector", F.col("r.precision.n").alias("precision_n"), F.col("r.precision.d").alias("precision_d"), F.col("r.recall.d").alias("recall_d"), F.col("r.false_positive_rate.n").alias("fpr_n"), F.col("r.coverage.n").alias("coverage_n")
    )


Z = K.Z95
WIL = f"((p + {Z}*{Z}/(2*d)) / (1 + {Z}*{Z}/d))", f"({Z}*sqrt(p*(1-p)/d + {Z}*{Z}/(4*d*d)) / (1 + {Z}*{Z}/d))"


@query("X15_wilson", f"WITH {CONF}, x AS (SELECT detector, CAST(tp AS DOUBLE) / (tp + fn + unknown_positive) AS p, CAST(tp + fn + unknown_positive AS DOUBLE) AS d FROM conf WHERE tp + fn + unknown_positive > 0) SELECT detector, round(greatest(0, {WIL[0]} - {WIL[1]}), 4) AS low, round(least(1, {WIL[0]} + {WIL[1]}), 4) AS high FROM x")
def wilson(spark, d):
    c = conf(spark, d).withColumn("d", F.expr("tp + fn + unknown_positive")).where("d > 0").withColumn("w", K.wilson(F.col("tp"), F.col("d")))
    return c.select("detector", F.round(F.col("w.low").cast("double"), 4).alias("low"), F.round(F.col("w.high").cast("double"), 4).alias("high"))


@query("J13_eval_join", """WITH u AS (SELECT doc_id, source AS detector FROM documents), v AS (SELECT l.doc_id, CASE WHEN l.doc_id % 10 = 3 THEN 'other' ELSE source END AS detector FROM labels l JOIN documents d ON d.doc_id = l.doc_id)
SELECT u.detector, count(*) AS units, count(v.doc_id) AS labelled FROM u LEFT JOIN v ON v.doc_id = u.doc_id AND v.detector = u.detector GROUP BY u.detector""")
def eval_join(spark, d):
    """Units by detector with how many of them a label of that detector belongs to; the others would end an evaluation."""
    docs = T.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("detector"))
    of = docs.withColumn("detector", F.when(F.col("id") % 10 == 3, "other").otherwise(F.col("detector")))
    labels = T.table(spark, d, "labels").select(F.col("doc_id").alias("id"), (F.col("toxic") == 1).alias("positive")).join(of, "id")
    return E.labelled(docs, labels).groupBy("detector").agg(F.count("*").alias("units"), F.count("positive").alias("labelled"))


def _interval(n, d):
    low = f"({n} / {d}::DOUBLE + {Z}*{Z}/(2*{d})) / (1 + {Z}*{Z}/{d})"
    half = f"{Z}*sqrt({n} / {d}::DOUBLE * (1 - {n} / {d}::DOUBLE) / {d} + {Z}*{Z}/(4*{d}*{d})) / (1 + {Z}*{Z}/{d})"
    return f"CASE WHEN {d} > 0 THEN round(greatest(0, {low} - {half}), 4) END", f"CASE WHEN {d} > 0 THEN round(least(1, {low} + {half}), 4) END"


RATES = {"precision": ("tp", "(tp + fp)"), "recall": ("tp", "(tp + fn + unknown_positive)"), "false_positive_rate": ("fp", "(fp + tn + unknown_negative)"), "coverage": ("(tp + fp + fn + tn)", "(tp + fp + fn + tn + unknown_positive + unknown_negative)")}


@query("T20_eval_report", f"WITH {CONF} " + " UNION ALL ".join(
    f"SELECT detector, '{r}' AS rate, CASE WHEN {b} > 0 THEN {a} END AS n, CASE WHEN {b} > 0 THEN {b} END AS d, {_interval(a, b)[0]} AS low, {_interval(a, b)[1]} AS high, signals FROM conf" for r, (a, b) in RATES.items()
))
def eval_report(spark, d):
    """Every rate of every detector, exact, with its interval."""
    four = lambda c: F.round(F.col(c).cast("double"), 4).alias(c)
    return E.report(conf(spark, d)).select("detector", "rate", "n", "d", four("low"), four("high"), "signals")


@query("P02_explode_steps", """WITH s AS (SELECT doc_id AS step, CASE WHEN doc_id % 5 <> 0 THEN source END AS subject, CASE WHEN doc_id % 2 = 0 THEN 'policy' END AS policy, CASE WHEN n_chars > 1000 THEN [lang, source] ELSE [lang] END AS offers, CASE WHEN doc_id % 3 = 0 THEN source END AS accepted FROM documents),
p AS (SELECT step, subject, CASE WHEN subject IS NULL THEN [struct_pack(kind := 'pulse', policy_hash := NULL::VARCHAR, scope_hash := NULL::VARCHAR)]
  ELSE list_concat(CASE WHEN policy IS NULL THEN [] ELSE [struct_pack(kind := 'scope', policy_hash := policy, scope_hash := NULL::VARCHAR)] END, list_transform(list_filter(offers, lambda o: o IS NOT NULL), lambda o: struct_pack(kind := 'scope', policy_hash := NULL::VARCHAR, scope_hash := o)),
    CASE WHEN accepted IS NULL THEN [] ELSE [struct_pack(kind := 'scope', policy_hash := NULL::VARCHAR, scope_hash := accepted)] END) END AS parts FROM s),
q AS (SELECT step, subject, CASE WHEN len(parts) = 0 THEN [struct_pack(kind := 'pulse', policy_hash := NULL::VARCHAR, scope_hash := NULL::VARCHAR)] ELSE parts END AS parts FROM p),
x AS (SELECT step, subject, unnest(range(len(parts))) AS position, unnest(parts) AS part FROM q)
SELECT step, position, part.kind AS kind, subject, part.policy_hash AS policy_hash, part.scope_hash AS scope_hash FROM x""")
def explode_steps(spark, d):
    """One to n observations for each step of a bundle whose steps are the documents."""
    i = F.col("doc_id")
    steps = T.table(spark, d, "documents").select(
        i.alias("step"), F.when(i % 5 != 0, F.col("source")).alias("subject"), F.when(i % 2 == 0, "policy").alias("policy"), F.when(F.col("n_chars") > 1000, F.array("lang", "source")).otherwise(F.array("lang")).alias("offers"), F.when(i % 3 == 0, F.col("source")).alias("accepted"),
    )
    return X.steps_observed(steps).withColumn("position", F.col("position").cast("bigint"))


@query("S01_strict_parse")
def strict_parse(spark, d):
    rows = T.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat("props", F.lit(" x"))).otherwise(F.col("props")).alias("raw"))
    return rows.select("event_id", strict_json("raw").alias("p")).select("event_id", "p.valid", "p.canonical")


VER = f"""{JRN}, j2 AS (SELECT *, seq * 10 - CASE WHEN (fleet + seq) % 37 = 0 THEN 15 ELSE 0 END AS at_ms FROM jrn),
x AS (SELECT *, lag(seq) OVER s AS ps, lag(hash) OVER s AS ph, lag(at_ms) OVER s AS pt, lag(state) OVER s AS st FROM j2 WINDOW s AS (PARTITION BY fleet ORDER BY seq)),
r AS (SELECT fleet, 1 AS k, 'CHAIN_INVALID' AS reason, count(*) AS n FROM x WHERE NOT (ps IS NULL OR (seq = ps + 1 AND coalesce(prev = ph, false))) GROUP BY fleet
  UNION ALL SELECT fleet, 2, 'TIME_INVALID', count(*) FROM x WHERE at_ms < pt GROUP BY fleet
  UNION ALL SELECT fleet, 3, 'TRANSITION_INVALID', count(*) FROM x WHERE st IS NOT NULL AND (st, state) NOT IN ({', '.join(map(str, LEGAL))}) GROUP BY fleet)"""


def verified(spark, d):
    from vigil.operators import verify as R

    at = F.col("seq") * 10 - F.when((F.col("fleet") + F.col("seq")) % 37 == 0, 15).otherwise(0)
    journal = chain(spark, d).withColumn("at_ms", at)
    return journal, R.reasons(journal, spark.createDataFrame(LEGAL, "prev_state string, state string"))


@query("T18_reasons", f"WITH {VER} SELECT fleet, reason, n FROM r")
def verify_reasons(spark, d):
    return verified(spark, d)[1]


@query("F18_export_complete", "SELECT conv_id, count(*) FILTER (turn = 0) = 1 AND count(*) = max(turn) + 1 AND conv_id % 5 <> 0 AS complete FROM conversations GROUP BY conv_id")
def export_complete(spark, d):
    rows = T.table(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(F.col("turn") == 0).alias("h"), F.count("*").alias("n"), F.max("turn").alias("last"))
    return rows.select("conv_id", K.export_complete(F.col("h") == 1, F.col("conv_id") % 5 != 0, F.col("last") + 1, F.col("n"))["complete"].alias("complete"))
