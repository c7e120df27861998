"""The main path over the events table: three fleets of eight sources, three epochs each.

Records, configurations and their SQL are stated twice, in Spark and for DuckDB; the
SQL of the rules is written from the rules, not from the operators.  Windows take six
hours here, as the events are sparse.

Fixed values: moduli and times that both sides state.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Window
from pyspark.sql import functions as F

from vigil.functions import kernels as K
from vigil.functions.params import Params
from vigil.operators import admission as A
from vigil.operators import fleet as V
from vigil.sources.store import written

from . import tables as T
from .registry import query

P = Params(window_ms=21_600_000, silence_ms=7_200_000)
BASE, DAY, SIX = 1_704_067_200_000, 86_400_000, 21_600_000
U = K.U_MAX


def records(spark, d):
    """Events as records of three fleets, with fork, terminal, gap and coverage marks among them."""
    e = T.table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint")).withColumn("received_ms", T.millis("ts"))
    i, user, k = F.col("event_id"), F.col("user_id"), F.col("k")
    source = user % 8
    kind = (
        F.when((source == 5) & (i % 101 == 11), "fork").when((source == 6) & (i % 103 == 13), "terminal").when(source.isin(1, 2) & (i % 53 == 5), "coverage").when((source == 3) & (i % 67 == 7), "gap")
        .when(F.col("event_type") == "purchase", "spend").when(F.col("event_type") == "signup", "scope").when(F.col("event_type") == "error", "replication").when(F.col("event_type") == "click", "pulse").otherwise("signal")
    )
    e = e.select(
        (i + 1).alias("idx"), "received_ms", (F.col("received_ms") - k * 3000).alias("observed_ms"), F.expr("user_id div 8 % 3").alias("fleet"), source.alias("source"), (user % 16).alias("subject"),
        kind.alias("kind"), F.when(i % 2 == 0, i % 500 * 1000 + 5000).otherwise(F.round(F.col("value") * 10000).cast("bigint")).alias("delta"), (i % 500).alias("usage_id"),
        F.when(k % 11 != 0, k % 7).alias("policy"), F.when(k % 11 != 0, k % 5).alias("scope"), (k % 17 == 0).alias("reported"),
        F.when(k % 13 != 0, user % 9).alias("processes"), F.when(k % 13 != 0, k).alias("threads"), F.when(k % 4 != 0, k % 9).alias("declared"),
        (i % 2 == 0).alias("complete"), (i % 3).alias("pending"), F.sha2(F.concat(F.lit("record/"), i + 1), 256).alias("hash"),
    )
    return e.withColumn("late", K.late(F.col("observed_ms"), F.col("received_ms"), P))


def configs(spark):
    both = spark.range(3).select(F.col("id").alias("fleet")).crossJoin(spark.range(1, 4).select(F.col("id").alias("epoch")))
    return both.select("fleet", "epoch", (F.col("epoch") * (10 * DAY) + F.col("fleet") * SIX + (BASE - 10 * DAY)).alias("effective_ms"))


def sources(spark):
    """With the subjects that each source reports on; source 2 of fleet 1 has a revoked key."""
    s, f, e = F.col("source"), F.col("fleet"), F.col("epoch")
    rows = configs(spark).crossJoin(spark.range(8).select(F.col("id").alias("source")))
    meter = (s % 4 == 0) & ~((e == 2) & (s == 4))
    first = F.when(s == 7, f * SIX + BASE + 10 * DAY).otherwise(f * SIX + BASE)
    return rows.select(
        "fleet", "epoch", "source", F.concat_ws("-", F.lit("key"), f, s).alias("key_id"), meter.alias("meter"), (~((s == 7) & (e == 1)) & ~(meter & (f == 2) & (e == 3))).alias("enabled"),
        ((f == 1) & (s == 2)).alias("revoked"), first.alias("activated_ms"), F.array(s, s + 8, s * 3 % 14).alias("subjects"),
    )


SQL = f"""rec AS (
  SELECT event_id + 1 AS idx, epoch_us(ts) // 1000 AS received_ms, epoch_us(ts) // 1000 - k * 3000 AS observed_ms, user_id // 8 % 3 AS fleet, user_id % 8 AS source, user_id % 16 AS subject,
    CASE WHEN user_id % 8 = 5 AND event_id % 101 = 11 THEN 'fork' WHEN user_id % 8 = 6 AND event_id % 103 = 13 THEN 'terminal' WHEN user_id % 8 IN (1, 2) AND event_id % 53 = 5 THEN 'coverage'
      WHEN user_id % 8 = 3 AND event_id % 67 = 7 THEN 'gap'
      ELSE CASE event_type WHEN 'purchase' THEN 'spend' WHEN 'signup' THEN 'scope' WHEN 'error' THEN 'replication' WHEN 'click' THEN 'pulse' ELSE 'signal' END END AS kind,
    CASE WHEN event_id % 2 = 0 THEN event_id % 500 * 1000 + 5000 ELSE CAST(round(value * 10000) AS BIGINT) END AS delta, event_id % 500 AS usage_id,
    CASE WHEN k % 11 <> 0 THEN k % 7 END AS policy, CASE WHEN k % 11 <> 0 THEN k % 5 END AS scope, k % 17 = 0 AS reported,
    CASE WHEN k % 13 <> 0 THEN user_id % 9 END AS processes, CASE WHEN k % 13 <> 0 THEN k END AS threads, CASE WHEN k % 4 <> 0 THEN k % 9 END AS declared,
    event_id % 2 = 0 AS complete, event_id % 3 AS pending, sha256('record/' || (event_id + 1)) AS hash, k * 3000 > 120000 AS late
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)),
cfg AS (SELECT fleet, epoch, {BASE} + (epoch - 1) * {10 * DAY} + fleet * {SIX} AS effective_ms FROM range(3) a(fleet), range(1, 4) b(epoch)),
spans AS (SELECT *, lead(effective_ms) OVER (PARTITION BY fleet ORDER BY epoch) AS until_ms FROM cfg),
src0 AS (SELECT fleet, epoch, source, 'key-' || fleet || '-' || source AS key_id, source % 4 = 0 AND NOT (epoch = 2 AND source = 4) AS meter, fleet = 1 AND source = 2 AS revoked,
  CASE WHEN source = 7 THEN {BASE + 10 * DAY} ELSE {BASE} END + fleet * {SIX} AS activated_ms, [source, source + 8, source * 3 % 14] AS subjects FROM cfg, range(8) s(source)),
src AS (SELECT *, NOT (source = 7 AND epoch = 1) AND NOT (meter AND fleet = 2 AND epoch = 3) AS enabled FROM src0),
subj AS (SELECT subject, subject % 3 + 5 AS mp, subject * 4 + 30 AS mt FROM range(14) t(subject)),
inforce AS (SELECT r.*, epoch, received_ms - received_ms % {SIX} AS start_ms FROM rec r JOIN spans s ON r.fleet = s.fleet AND received_ms >= effective_ms AND (until_ms IS NULL OR received_ms < until_ms)),
kept AS (SELECT * FROM inforce i WHERE NOT EXISTS (SELECT 1 FROM inforce j WHERE j.kind IN ('fork', 'terminal') AND j.fleet = i.fleet AND j.source = i.source AND j.idx < i.idx)),
used AS (SELECT *, CASE WHEN kind <> 'spend' THEN NULL WHEN row_number() OVER u = 1 THEN 'COUNTED' WHEN delta = first(delta) OVER u AND subject = first(subject) OVER u THEN 'REPEATED' ELSE 'USAGE_CONFLICT' END AS verdict
  FROM kept WINDOW u AS (PARTITION BY fleet, source, kind = 'spend', usage_id ORDER BY idx)),
stand AS (SELECT *, coalesce(verdict = 'COUNTED', false) AS counted FROM used WHERE verdict IS DISTINCT FROM 'USAGE_CONFLICT'),
acc AS (SELECT * FROM stand WHERE kind NOT IN ('fork', 'gap')),
lasts AS (SELECT fleet, max(received_ms) AS last_ms FROM rec GROUP BY fleet),
grid AS (SELECT fleet, epoch, unnest(range(effective_ms, least(coalesce(until_ms, last_ms + 1), last_ms + 1), {SIX})) AS start_ms FROM spans JOIN lasts USING (fleet)),
marks AS (SELECT g.fleet, g.epoch, g.start_ms, g.start_ms + {SIX} AS end_ms, s.source, s.meter, s.revoked, s.activated_ms,
    max(CASE r.kind WHEN 'fork' THEN 2 WHEN 'terminal' THEN 1 END) AS ended, arg_max(r.pending, r.idx) FILTER (r.kind = 'gap') AS pending, arg_max(r.complete, r.idx) FILTER (r.kind = 'coverage') AS complete,
    count(r.idx) FILTER (r.kind NOT IN ('fork', 'gap')) AS head_seq, coalesce(arg_max(r.hash, r.idx) FILTER (r.kind NOT IN ('fork', 'gap')), repeat('0', 64)) AS head_hash,
    max(r.idx) FILTER (r.kind NOT IN ('fork', 'gap', 'signal')) AS last_idx, arg_max(r.hash, r.idx) FILTER (r.kind NOT IN ('fork', 'gap', 'signal')) AS last_input,
    max(r.received_ms) FILTER (r.kind NOT IN ('fork', 'gap', 'signal')) AS last_ms,
    coalesce(bool_or(r.start_ms = g.start_ms AND r.kind NOT IN ('fork', 'gap', 'signal')), false) AS live, coalesce(bool_or(r.start_ms = g.start_ms AND r.kind NOT IN ('fork', 'gap', 'signal') AND r.late), false) AS late,
    count(*) FILTER (r.start_ms = g.start_ms AND r.kind NOT IN ('fork', 'gap')) AS n
  FROM grid g JOIN src s ON s.fleet = g.fleet AND s.epoch = g.epoch AND s.enabled LEFT JOIN stand r ON r.fleet = g.fleet AND r.source = s.source AND r.start_ms <= g.start_ms GROUP BY ALL),
cut AS (SELECT * EXCLUDE (pending, complete, ended), coalesce(pending, 0) AS pending, coalesce(complete, true) AS complete,
  CASE WHEN ended = 2 THEN 'FORKED' WHEN ended = 1 THEN 'TERMINAL' WHEN pending > 0 THEN 'GAPPED' WHEN head_seq = 0 THEN 'EMPTY' ELSE 'ACTIVE' END AS state FROM marks),
qual AS (SELECT fleet, epoch, start_ms, CASE WHEN count(*) FILTER (state = 'FORKED' OR revoked) > 0 THEN 'DEGRADED' WHEN count(*) FILTER (state = 'GAPPED' OR pending > 0 OR NOT complete OR late) > 0 THEN 'INCOMPLETE' ELSE 'COMPLETE' END AS quality FROM cut GROUP BY ALL),
meters AS (SELECT fleet, epoch, start_ms, count(*) AS meters, count(*) FILTER (state = 'FORKED' OR revoked OR NOT complete OR NOT live) = 0 AS covered FROM cut WHERE meter GROUP BY ALL),
sums AS (SELECT fleet, epoch, start_ms, sum(delta) AS total FROM acc WHERE counted GROUP BY ALL),
h AS (SELECT g.*, coalesce(total, 0)::BIGINT AS total, coalesce(meters, 0) AS meters, coalesce(covered, false) AS covered FROM grid g LEFT JOIN sums USING (fleet, epoch, start_ms) LEFT JOIN meters USING (fleet, epoch, start_ms)),
h2 AS (SELECT *, list(total) OVER f AS history, count(*) OVER f AS n_history FROM h WINDOW f AS (PARTITION BY fleet, epoch ORDER BY start_ms ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
h3 AS (SELECT *, coalesce(bool_and(covered AND n_history >= 5) OVER (PARTITION BY fleet, epoch ORDER BY start_ms ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), false) AS decidable, greatest(3 * greatest(list_sort(history)[3], 100000), 1000000) AS t FROM h2),
spend AS (SELECT fleet, epoch, start_ms, 'spend_spike/1' AS detector, 'fleet' AS target,
  CASE WHEN meters = 0 OR NOT covered OR n_history < 5 OR NOT decidable THEN 'UNKNOWN' WHEN total >= t THEN 'HIT' ELSE 'CLEAR' END AS status,
  CASE WHEN meters = 0 THEN 'EVIDENCE_MISSING' WHEN NOT covered THEN 'COVERAGE_INCOMPLETE' WHEN n_history < 5 THEN 'BASELINE_WARMUP' WHEN NOT decidable THEN 'COVERAGE_INCOMPLETE' WHEN total >= t THEN 'SPEND_SPIKE' ELSE 'BELOW_THRESHOLD' END AS reason,
  CASE WHEN meters > 0 THEN total END AS value, CASE WHEN meters > 0 AND covered AND n_history >= 5 AND decidable THEN t::BIGINT END AS limit_value FROM h3),
bad AS (SELECT c.fleet, c.epoch, c.start_ms, x.subject, count(*) FILTER (state IN ('FORKED', 'GAPPED') OR c.revoked OR NOT complete OR pending > 0) > 0 AS failed
  FROM cut c JOIN (SELECT DISTINCT fleet, epoch, source, unnest(subjects) AS subject FROM src WHERE enabled) x ON x.fleet = c.fleet AND x.epoch = c.epoch AND x.source = c.source GROUP BY ALL),
sd AS (SELECT fleet, epoch, start_ms, subject, idx,
  CASE WHEN reported THEN 'DRIFT_REPORTED' WHEN policy IS NOT NULL AND (policy + subject) % 4 = 0 THEN 'POLICY_DRIFT' WHEN scope IS NOT NULL AND (scope + subject) % 5 = 1 THEN 'SCOPE_DRIFT'
    WHEN policy IS NOT NULL OR scope IS NOT NULL THEN 'SCOPE_MATCH' ELSE 'EVIDENCE_MISSING' END AS reason FROM acc JOIN subj USING (subject) WHERE kind = 'scope'),
sd2 AS (SELECT fleet, epoch, start_ms, subject, arg_min(reason, (CASE reason WHEN 'DRIFT_REPORTED' THEN 1 WHEN 'POLICY_DRIFT' THEN 2 WHEN 'SCOPE_DRIFT' THEN 3 WHEN 'EVIDENCE_MISSING' THEN 4 ELSE 5 END, idx)) AS r FROM sd GROUP BY ALL),
scopes AS (SELECT fleet, epoch, start_ms, 'scope_drift/1' AS detector, CAST(subject AS VARCHAR) AS target,
  CASE WHEN coalesce(failed, false) THEN 'UNKNOWN' WHEN r = 'SCOPE_MATCH' THEN 'CLEAR' WHEN r = 'EVIDENCE_MISSING' THEN 'UNKNOWN' ELSE 'HIT' END AS status,
  CASE WHEN coalesce(failed, false) THEN 'COVERAGE_INCOMPLETE' ELSE r END AS reason, CAST(NULL AS BIGINT) AS value, CAST(NULL AS BIGINT) AS limit_value FROM sd2 LEFT JOIN bad USING (fleet, epoch, start_ms, subject)),
rd AS (SELECT fleet, epoch, start_ms, subject, idx, processes, threads, declared, mp, mt,
  CASE WHEN processes > mp THEN 'PROCESS_EXCESS' WHEN threads > mt THEN 'THREAD_EXCESS' WHEN declared <> processes THEN 'DECLARED_MISMATCH'
    WHEN coalesce(processes, threads) IS NULL OR (declared IS NOT NULL AND processes IS NULL) THEN 'EVIDENCE_MISSING' ELSE 'INVENTORY_MATCH' END AS reason FROM acc JOIN subj USING (subject) WHERE kind = 'replication'),
rd2 AS (SELECT fleet, epoch, start_ms, subject, arg_min(struct_pack(reason := reason, value := CASE reason WHEN 'THREAD_EXCESS' THEN threads WHEN 'EVIDENCE_MISSING' THEN NULL WHEN 'INVENTORY_MATCH' THEN coalesce(processes, threads) ELSE processes END,
    limit_value := CASE reason WHEN 'PROCESS_EXCESS' THEN mp WHEN 'THREAD_EXCESS' THEN mt WHEN 'DECLARED_MISMATCH' THEN declared WHEN 'INVENTORY_MATCH' THEN CASE WHEN processes IS NOT NULL THEN mp ELSE mt END END),
  (CASE reason WHEN 'PROCESS_EXCESS' THEN 1 WHEN 'THREAD_EXCESS' THEN 2 WHEN 'DECLARED_MISMATCH' THEN 3 WHEN 'EVIDENCE_MISSING' THEN 4 ELSE 5 END, idx)) AS r FROM rd GROUP BY ALL),
repl AS (SELECT fleet, epoch, start_ms, 'replication_anomaly/1' AS detector, CAST(subject AS VARCHAR) AS target,
  CASE WHEN coalesce(failed, false) THEN 'UNKNOWN' WHEN r.reason = 'INVENTORY_MATCH' THEN 'CLEAR' WHEN r.reason = 'EVIDENCE_MISSING' THEN 'UNKNOWN' ELSE 'HIT' END AS status,
  CASE WHEN coalesce(failed, false) THEN 'COVERAGE_INCOMPLETE' ELSE r.reason END AS reason, CASE WHEN NOT coalesce(failed, false) THEN CAST(r.value AS BIGINT) END AS value, CASE WHEN NOT coalesce(failed, false) THEN CAST(r.limit_value AS BIGINT) END AS limit_value
  FROM rd2 LEFT JOIN bad USING (fleet, epoch, start_ms, subject)),
quiet AS (SELECT fleet, epoch, start_ms, 'stream_silence/1' AS detector, CAST(source AS VARCHAR) AS target,
  CASE WHEN revoked THEN 'UNKNOWN' WHEN state = 'TERMINAL' THEN 'CLEAR' WHEN state = 'FORKED' THEN 'UNKNOWN' WHEN age >= 7200000 THEN 'HIT' ELSE 'CLEAR' END AS status,
  CASE WHEN revoked THEN 'COVERAGE_INCOMPLETE' WHEN state = 'TERMINAL' THEN 'SOURCE_TERMINAL' WHEN state = 'FORKED' THEN 'COVERAGE_INCOMPLETE' WHEN age >= 7200000 THEN 'STREAM_SILENT' ELSE 'STREAM_RECENT' END AS reason,
  CASE WHEN NOT revoked AND state NOT IN ('TERMINAL', 'FORKED') THEN age END AS value, CASE WHEN NOT revoked AND state NOT IN ('TERMINAL', 'FORKED') THEN 7200000 END AS limit_value
  FROM (SELECT *, end_ms - coalesce(last_ms, activated_ms) AS age FROM cut)),
results AS (SELECT * FROM spend UNION ALL SELECT * FROM scopes UNION ALL SELECT * FROM repl UNION ALL SELECT * FROM quiet)"""

#: Manifests and result digests in SQL: canonical JSON put together by hand.
HASHES = """ins AS (SELECT fleet, epoch, start_ms, string_agg('"' || hash || '"', ',' ORDER BY idx) AS inputs, count(*) AS n_inputs, max(idx) AS through FROM acc GROUP BY ALL),
cuts_ AS (SELECT fleet, epoch, start_ms, string_agg('{"activated_ms":"' || activated_ms || '","complete":' || complete || ',"head":{"hash":"' || head_hash || '","seq":"' || head_seq || '"},"last_input":' || coalesce('"' || last_input || '"', 'null')
    || ',"last_received_ms":' || coalesce('"' || last_ms || '"', 'null') || ',"source":' || source || ',"state":"' || state || '"}', ',' ORDER BY source) AS cuts FROM cut GROUP BY ALL),
text_ AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY fleet, epoch ORDER BY start_ms) AS nth,
    '{"config":"' || fleet || '/' || epoch || '","cuts":[' || coalesce(cuts, '') || '],"end_ms":' || (start_ms + 21600000) || ',"fleet":' || fleet || ',"history":[' AS head,
    '],"inputs":[' || coalesce(inputs, '') || '],"quality":"' || quality || '","start_ms":' || start_ms || ',"through_index":"' || upto || '","v":1}' AS tail
  FROM (SELECT *, coalesce(max(through) OVER (PARTITION BY fleet ORDER BY start_ms), 0) AS upto FROM grid LEFT JOIN ins USING (fleet, epoch, start_ms) LEFT JOIN cuts_ USING (fleet, epoch, start_ms) LEFT JOIN qual USING (fleet, epoch, start_ms))),
man_ AS (SELECT fleet, epoch, nth, start_ms, n_inputs, quality, CAST([] AS VARCHAR[]) AS history, sha256(encode('MANIFEST/1') || '\\x00'::BLOB || encode(head || tail)) AS hash FROM text_ WHERE nth = 1
  UNION ALL SELECT t.fleet, t.epoch, t.nth, t.start_ms, t.n_inputs, t.quality, list_append(m.history, m.hash)[-5:], sha256(encode('MANIFEST/1') || '\\x00'::BLOB || encode(t.head || '"' || array_to_string(list_append(m.history, m.hash)[-5:], '","') || '"' || t.tail))
  FROM man_ m JOIN text_ t ON t.fleet = m.fleet AND t.epoch = m.epoch AND t.nth = m.nth + 1),
man AS MATERIALIZED (SELECT * FROM man_),
ev AS (SELECT fleet, epoch, start_ms, 'spend_spike/1' AS detector, 'fleet' AS target, string_agg(DISTINCT '"' || hash || '"', ',' ORDER BY '"' || hash || '"') AS evidence FROM acc WHERE counted GROUP BY ALL
  UNION ALL SELECT fleet, epoch, start_ms, CASE kind WHEN 'scope' THEN 'scope_drift/1' ELSE 'replication_anomaly/1' END, CAST(subject AS VARCHAR), string_agg(DISTINCT '"' || hash || '"', ',' ORDER BY '"' || hash || '"') FROM acc WHERE kind IN ('scope', 'replication') GROUP BY ALL
  UNION ALL SELECT fleet, epoch, start_ms, 'stream_silence/1', CAST(source AS VARCHAR), '"' || last_input || '"' FROM cut WHERE last_idx IS NOT NULL),
res AS (SELECT r.*, man.hash AS manifest, sha256(encode('RESULT/1') || '\\x00'::BLOB || encode('{"config":"' || fleet || '/' || epoch || '","decision":{"limit":' || coalesce('"' || limit_value || '"', 'null') || ',"reason":"' || reason || '","status":"' || status ||
    '","value":' || coalesce('"' || value || '"', 'null') || '},"detector":"' || detector || '","evidence":[' || CASE WHEN detector = 'spend_spike/1' AND reason = 'EVIDENCE_MISSING' THEN '' ELSE coalesce(evidence, '') END || '],"fleet":' || fleet || ',"manifest":"' || man.hash || '","target":"' || target || '","v":1}')) AS hash
  FROM results r JOIN man USING (fleet, epoch, start_ms) LEFT JOIN ev USING (fleet, epoch, start_ms, detector, target))"""


class Run:
    """The tables of one run; each is planned when it is first asked for.  keep: write the ends of sources, the
    first use of each usage id, the windows and the cuts, which several detectors read, instead of planning them anew.
    standing: the run's records that stand, where they are written already."""

    def __init__(self, spark, d, keep=False, p=P, standing=None):
        self.spark, self.p, self.keep, self.all = spark, p, keep, records(spark, d)
        self.configs, self.sources, self.subjects = configs(spark), sources(spark), T.subjects(spark)
        self.placed = V.in_force(self.all, self.configs, p)
        self.standing = self._standing() if standing is None else standing
        self.rows = V.unmarked(self.standing)

    def _standing(self):
        # a row to a source and to a usage id: where these are kept, the planner knows that they are few, and records aren't dealt out for them
        ends, first = V.ends(self.placed), None
        if self.keep:
            ends = written(ends, "ends")
            first = written(V.first_usage(V.before_end(self.placed, ends)), "usage")
        return V.usage(V.before_end(self.placed, ends), first).where("coalesce(verdict, '') <> 'USAGE_CONFLICT'")

    def _kept(self, df, name):
        return written(df, name) if self.keep else df

    @cached_property
    def windows(self):
        return self._kept(V.grid(self.configs, self.all.groupBy("fleet").agg(F.max("received_ms").alias("last_ms")), self.p), "windows")

    @cached_property
    def cuts(self):
        return self._kept(V.cuts(self.standing, self.windows, self.sources, self.p), "cuts")

    @property
    def spend_windows(self):
        return V.spend_windows(self.rows, self.windows, self.cuts, self.p)

    @property
    def spend(self):
        return V.spend_spike(self.spend_windows, self.p)

    @property
    def failed(self):
        return V.uncovered(self.cuts, self.sources)

    @property
    def scope(self):
        return V.scope_drift(self.rows, self.subjects, self.failed)

    @property
    def replication(self):
        return V.replication_anomaly(self.rows, self.subjects, self.failed)

    @property
    def silence(self):
        return V.stream_silence(self.cuts, self.p)

    @property
    def results(self):
        return self.spend.unionByName(self.scope).unionByName(self.replication).unionByName(self.silence)

    @property
    def manifests(self):
        return V.manifests(self.rows, self.windows, self.cuts, self.p)

    @property
    def hashed(self):
        return V.hashed(self.results, self.manifests, V.evidence(self.rows, self.cuts, self.subjects))


def shown(df):
    cast = lambda c: F.expr(f"try_cast(`{c}` as bigint)")
    return df.select(*V.WINDOW, "detector", "target", "status", "reason", cast("value").alias("value"), cast("limit").alias("limit_value"))


W = f"WITH RECURSIVE {SQL}"
KEY = "fleet, epoch, start_ms"


@query("spend_spike", f"{W} SELECT * FROM spend")
def spend_spike(spark, d):
    return shown(Run(spark, d).spend)


@query("scope_drift", f"{W} SELECT * FROM scopes")
def scope_drift(spark, d):
    return shown(Run(spark, d).scope)


@query("replication_anomaly", f"{W} SELECT * FROM repl")
def replication_anomaly(spark, d):
    return shown(Run(spark, d).replication)


@query("stream_silence", f"{W} SELECT * FROM quiet")
def stream_silence(spark, d):
    return shown(Run(spark, d).silence)


@query("U01_result_union", f"{W} SELECT fleet, detector, status, reason, count(*) AS n, CAST(sum(value) AS BIGINT) AS value FROM results GROUP BY ALL")
def result_union(spark, d):
    return shown(Run(spark, d, keep=True).results).groupBy("fleet", "detector", "status", "reason").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


@query("L01_result_order", f"{W} SELECT *, row_number() OVER (PARTITION BY fleet, start_ms ORDER BY detector, target) AS position FROM results")
def result_order(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("fleet", "start_ms").orderBy("detector", "target")
    return shown(Run(spark, d, keep=True).results).withColumn("position", F.row_number().over(order).cast("bigint"))


@query("T08_alerts", f"{W} SELECT fleet, start_ms, detector, target, reason, start_ms + {SIX + 180000} AS expires_ms FROM results WHERE status = 'HIT'")
def new_alerts(spark, d):
    hits = shown(Run(spark, d, keep=True).results).where("status = 'HIT'")
    return hits.select("fleet", "start_ms", "detector", "target", "reason", (F.col("start_ms") + P.window_ms + P.vote_ttl_ms).alias("expires_ms"))


@query("F01_window_membership", f"{W} SELECT idx, fleet, epoch, start_ms FROM inforce")
def window_membership(spark, d):
    return Run(spark, d).placed.select("idx", *V.WINDOW)


@query("F02_counted_spend", f"{W} SELECT {KEY}, count(*) AS n, CAST(sum(delta) AS BIGINT) AS total FROM acc WHERE counted GROUP BY ALL")
def counted_spend(spark, d):
    return Run(spark, d).rows.where("kind = 'spend' and counted").groupBy(*V.WINDOW).agg(F.count("*").alias("n"), K.checked_sum("delta").alias("total"))


@query("F03_presence", f"{W} SELECT {KEY}, source, live FROM cut")
def presence(spark, d):
    return Run(spark, d).cuts.select(*V.WINDOW, "source", "live")


@query("F08_source_coverage", f"{W} SELECT {KEY}, source, state IN ('FORKED', 'GAPPED') OR revoked OR NOT complete OR pending > 0 AS failed FROM cut")
def source_coverage(spark, d):
    return Run(spark, d).cuts.select(*V.WINDOW, "source", V.fails().alias("failed"))


@query("F09_spend_coverage", f"{W} SELECT {KEY}, meters, covered FROM h")
def spend_coverage(spark, d):
    return Run(spark, d).spend_windows.select(*V.WINDOW, "meters", "covered")


@query("F10_quality", f"{W} SELECT {KEY}, quality FROM qual")
def quality(spark, d):
    return V.quality(Run(spark, d).cuts)


@query("A07_usage_dedup", f"{W} SELECT fleet, source, verdict, count(*) AS n, CAST(sum(delta) AS BIGINT) AS total FROM used WHERE kind = 'spend' GROUP BY ALL")
def usage_dedup(spark, d):
    rows = V.usage(V.before_end(Run(spark, d).placed)).where("kind = 'spend'")
    return rows.groupBy("fleet", "source", "verdict").agg(F.count("*").alias("n"), K.checked_sum("delta").alias("total"))


@query("T06_usage_once", f"{W} SELECT idx, fleet, source, usage_id, verdict FROM used WHERE kind = 'spend'")
def usage_once(spark, d):
    return V.usage(V.before_end(Run(spark, d).placed)).where("kind = 'spend'").select("idx", "fleet", "source", "usage_id", "verdict")


@query("T02_window_grid", f"{W} SELECT {KEY}, count(idx) AS n FROM grid LEFT JOIN acc USING (fleet, epoch, start_ms) GROUP BY ALL")
def window_grid(spark, d):
    run = Run(spark, d)
    n = run.rows.groupBy(*V.WINDOW).agg(F.count("*").alias("n"))
    return run.windows.join(n, V.WINDOW, "left").select(*V.WINDOW, F.coalesce("n", F.lit(0)).alias("n"))


@query("W01_history5", f"{W} SELECT {KEY}, total, n_history, CAST(coalesce(list_sum(history), 0) AS BIGINT) AS before FROM h3")
def history5(spark, d):
    return Run(spark, d).spend_windows.select(*V.WINDOW, "total", "n_history", K.array_sum(F.col("history")).alias("before"))


@query("A03_median5", f"{W} SELECT {KEY}, list_sort(history)[3] AS median FROM h3 WHERE n_history = 5")
def median5(spark, d):
    return Run(spark, d).spend_windows.where("n_history = 5").select(*V.WINDOW, K.median_of(F.col("history")).alias("median"))


@query("W02_decidable", f"{W} SELECT {KEY}, covered, n_history, decidable FROM h3")
def decidable(spark, d):
    return Run(spark, d).spend_windows.select(*V.WINDOW, "covered", "n_history", "decidable")


@query("X11_spend_threshold", f"{W} SELECT {KEY}, CAST(t AS BIGINT) AS threshold FROM h3 WHERE n_history = 5")
def spend_threshold(spark, d):
    return Run(spark, d).spend_windows.where("n_history = 5").select(*V.WINDOW, K.spend_threshold(F.col("history"), P).cast("bigint").alias("threshold"))


CUT = f"{KEY}, source, state, pending, complete, head_seq, head_hash, last_idx, last_input, last_ms, live, late, n"


@query("W09_cut_state", f"{W} SELECT {CUT} FROM cut")
def cut_state(spark, d):
    return Run(spark, d).cuts.select(*CUT.split(", "))


@query("P04_cuts", f"{W} SELECT {KEY}, source, head_seq, head_hash, state, activated_ms, last_ms, last_input, complete FROM cut")
def closure_rows(spark, d):
    return Run(spark, d).cuts.select(*V.WINDOW, "source", "head_seq", "head_hash", "state", "activated_ms", "last_ms", "last_input", "complete")


@query("J06_cut_join", f"{W} SELECT {KEY}, s.source, coalesce(state, 'EMPTY') AS state, coalesce(complete, true) AS complete FROM (SELECT * FROM grid JOIN src USING (fleet, epoch)) s LEFT JOIN cut c USING (fleet, epoch, start_ms, source)")
def cut_join(spark, d):
    run = Run(spark, d)
    every = run.windows.join(run.sources.select("fleet", "epoch", "source"), ["fleet", "epoch"])
    joined = every.join(run.cuts.select(*V.WINDOW, "source", "state", "complete"), [*V.WINDOW, "source"], "left")
    return joined.select(*V.WINDOW, "source", F.coalesce("state", F.lit("EMPTY")).alias("state"), F.coalesce("complete", F.lit(True)).alias("complete"))


@query("A04_scope_agg", f"{W} SELECT {KEY}, subject, r AS reason FROM sd2")
def scope_agg(spark, d):
    run = Run(spark, d)
    none = run.failed.withColumn("failed", F.lit(False))
    return V.scope_drift(run.rows, run.subjects, none).select(*V.WINDOW, F.col("target").cast("bigint").alias("subject"), "reason")


@query("A05_repl_agg", f"{W} SELECT {KEY}, subject, r.reason AS reason, CAST(r.value AS BIGINT) AS value FROM rd2")
def repl_agg(spark, d):
    run = Run(spark, d)
    none = run.failed.withColumn("failed", F.lit(False))
    return V.replication_anomaly(run.rows, run.subjects, none).select(*V.WINDOW, F.col("target").cast("bigint").alias("subject"), "reason", F.col("value").cast("bigint").alias("value"))


@query("T16_epochs", f"""{W} SELECT g.fleet, g.epoch, count(*) AS windows, min(start_ms) AS first_ms, max(start_ms) AS last_ms, (SELECT count(*) FROM src s WHERE s.fleet = g.fleet AND s.epoch = g.epoch AND NOT s.enabled) AS retired,
  (SELECT count(*) FROM inforce i WHERE i.fleet = g.fleet AND i.epoch = g.epoch) AS records FROM grid g GROUP BY ALL""")
def epochs(spark, d):
    run = Run(spark, d)
    per = run.windows.groupBy("fleet", "epoch").agg(F.count("*").alias("windows"), F.min("start_ms").alias("first_ms"), F.max("start_ms").alias("last_ms"))
    off = run.sources.groupBy("fleet", "epoch").agg(F.count_if(F.expr("not enabled")).alias("retired"))
    n = run.placed.groupBy("fleet", "epoch").agg(F.count("*").alias("records"))
    return per.join(off, ["fleet", "epoch"]).join(n, ["fleet", "epoch"], "left").withColumn("records", F.coalesce("records", F.lit(0)))


@query("T07_catch_up", f"{W}, n AS (SELECT *, row_number() OVER (PARTITION BY fleet ORDER BY start_ms) - 1 AS i FROM grid) SELECT fleet, i // 60 AS call, count(*) AS windows, max(start_ms) + {SIX} AS upto_ms FROM n GROUP BY ALL")
def catch_up(spark, d):
    """Windows in the calls of at most sixty that would finalise them."""
    windows = Run(spark, d).windows
    first = windows.groupBy("fleet").agg(F.min("start_ms").alias("lo"))
    call = F.expr(f"(start_ms - lo) div {60 * SIX}")
    return windows.join(first, "fleet").groupBy("fleet", call.alias("call")).agg(F.count("*").alias("windows"), F.max("end_ms").alias("upto_ms"))


@query("P05_manifest", f"{W}, {HASHES} SELECT {KEY}, coalesce(n_inputs, 0) AS n_inputs, quality, hash, len(history) AS n_history, coalesce(history[-1], '') AS before FROM man")
def manifest(spark, d):
    """Manifests, whose JSON names the digests of the five before."""
    made = Run(spark, d, keep=True).manifests
    return made.select(*V.WINDOW, "n_inputs", "quality", "hash", F.size("history").cast("bigint").alias("n_history"), F.coalesce(F.try_element_at("history", F.lit(-1)), F.lit("")).alias("before"))


@query("P07_result_digest", f"{W}, {HASHES} SELECT {KEY}, detector, target, hash FROM res")
def result_digest(spark, d):
    return Run(spark, d, keep=True).hashed.select(*V.WINDOW, "detector", "target", "hash")


@query("A11_evidence_set", f"{W}, {HASHES} SELECT {KEY}, detector, target, evidence FROM ev WHERE detector IN ('spend_spike/1', 'stream_silence/1') OR CAST(target AS BIGINT) < 14")
def evidence_set(spark, d):
    run = Run(spark, d, keep=True)
    quoted = F.array_join(F.transform("evidence", lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ",")
    return V.evidence(run.rows, run.cuts, run.subjects).select(*V.WINDOW, "detector", "target", quoted.alias("evidence"))


@query("J15_witness", f"{W} SELECT c.fleet, c.epoch, c.start_ms, c.source, last_input, a.received_ms, a.kind, a.received_ms = c.last_ms AS agrees FROM cut c JOIN acc a ON a.fleet = c.fleet AND a.hash = c.last_input")
def witness(spark, d):
    run = Run(spark, d)
    heads = run.rows.select("fleet", F.col("hash").alias("last_input"), "received_ms", "kind")
    return run.cuts.join(heads, ["fleet", "last_input"]).select(*V.WINDOW, "source", "last_input", "received_ms", "kind", F.expr("received_ms = last_ms").alias("agrees"))


@query("J17_principals", f"{W} SELECT a.fleet, a.epoch, s.key_id, count(*) AS n, bool_or(s.meter) AS meter FROM acc a JOIN src s USING (fleet, epoch, source) GROUP BY ALL")
def principals(spark, d):
    run = Run(spark, d)
    keys = run.sources.select("fleet", "epoch", "source", "key_id", "meter")
    return run.rows.join(keys, ["fleet", "epoch", "source"]).groupBy("fleet", "epoch", "key_id").agg(F.count("*").alias("n"), F.bool_or("meter").alias("meter"))


@query("J18_alert_lookup", f"{W}, {HASHES} SELECT fleet, start_ms, detector, target, res.hash AS result, manifest, quality FROM res JOIN qual USING (fleet, epoch, start_ms) WHERE status = 'HIT'")
def alert_lookup(spark, d):
    """Each alert with its result and that result's manifest; what is missing would be null."""
    run = Run(spark, d, keep=True)
    hits = run.hashed.where("status = 'HIT'").select("fleet", "start_ms", "detector", "target", F.col("hash").alias("result"), "manifest")
    return hits.join(run.manifests.select(F.col("hash").alias("manifest"), "quality"), "manifest", "left")


#: A stored copy of the results in which some were altered, left out or added.
STORED = "stored AS (SELECT fleet, epoch, start_ms, detector, target || CASE WHEN n % 43 = 3 THEN '+' ELSE '' END AS target, CASE WHEN n % 29 = 5 THEN sha256(hash) ELSE hash END AS hash FROM (SELECT *, ('0x' || hash[1:6])::BIGINT AS n FROM res) WHERE n % 37 <> 1)"


def stored(hashed):
    n = F.conv(F.substring("hash", 1, 6), 16, 10).cast("bigint")
    rows = hashed.withColumn("n", n).where("n % 37 <> 1")
    target = F.concat("target", F.when(F.col("n") % 43 == 3, "+").otherwise(""))
    return rows.select(*V.WINDOW, "detector", target.alias("target"), F.when(F.col("n") % 29 == 5, F.sha2("hash", 256)).otherwise(F.col("hash")).alias("hash"))


COMPARED = f"{W}, {HASHES}, {STORED}, both_ AS (SELECT fleet, detector, CASE WHEN s.hash IS NULL THEN 'MISSING' WHEN r.hash IS NULL THEN 'UNEXPECTED' WHEN s.hash = r.hash THEN 'MATCH' ELSE 'DIFFERENT' END AS verdict FROM stored s FULL JOIN res r USING (fleet, epoch, start_ms, detector, target))"


@query("T17_replay", f"{COMPARED} SELECT fleet, detector, verdict, count(*) AS n FROM both_ GROUP BY ALL")
def replay(spark, d):
    """Results recomputed from the records against a stored copy that was tampered with."""
    run = written(Run(spark, d, keep=True).hashed, "hashed")
    return V.replayed(stored(run), run).groupBy("fleet", "detector", "verdict").agg(F.count("*").alias("n"))


@query("J16_result_compare", f"{COMPARED} SELECT fleet, count(*) AS n, count(*) FILTER (verdict <> 'MATCH') AS wrong FROM both_ GROUP BY fleet")
def result_compare(spark, d):
    run = written(Run(spark, d, keep=True).hashed, "hashed")
    return V.replayed(stored(run), run).groupBy("fleet").agg(F.count("*").alias("n"), F.count_if(F.expr("verdict <> 'MATCH'")).alias("wrong"))


ENVELOPE = f"""{W}, e AS (SELECT r.*, s.key_id, s.meter, s.revoked, s.enabled, s.subjects, idx % 29 = 0 AS altered, CASE WHEN idx % 31 = 0 THEN 'key-9-9' ELSE 'key-' || r.fleet || '-' || r.source END AS signer
  FROM inforce r LEFT JOIN src s USING (fleet, epoch, source) WHERE kind NOT IN ('fork', 'gap'))"""


def enveloped(run):
    """Records with what their envelopes say and what their source is bound to."""
    i = F.col("idx")
    bound = run.sources.select("fleet", "epoch", "source", F.col("key_id").alias("of_key"), "meter", "revoked", F.col("enabled").alias("bound"), "subjects")
    rows = run.placed.where("kind not in ('fork', 'gap')").join(bound, ["fleet", "epoch", "source"], "left")
    return rows.select(
        "*", F.when(i % 29 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.sha2(F.concat(F.lit("record/"), i), 256)).alias("given_hash"), F.when(i % 31 == 0, "key-9-9").otherwise(F.concat_ws("-", F.lit("key"), "fleet", "source")).alias("key_id"),
        F.col("fleet").alias("of_fleet"), F.when(i % 47 == 5, F.col("source") + 1).otherwise(F.col("source")).alias("of_source"), (i % 37 != 4).alias("signed"), F.when(i % 41 == 3, "p/2").otherwise("p/1").alias("profile"), F.lit("p/1").alias("of_profile"),
        F.when(i % 53 == 8, F.col("received_ms") + 60_001).otherwise(F.col("observed_ms")).alias("said_ms"), F.col("received_ms").alias("at_ms"),
    ).drop("observed_ms").withColumnRenamed("said_ms", "observed_ms").withColumn("subject", F.when(F.col("kind").isin("spend", "scope", "replication"), F.col("subject")))


@query("F07_envelope", f"""{ENVELOPE} SELECT idx, CASE WHEN NOT coalesce(enabled, false) THEN 'FORBIDDEN' WHEN revoked THEN 'KEY_REVOKED' WHEN altered THEN 'HASH_MISMATCH' WHEN idx % 47 = 5 THEN 'FORBIDDEN' WHEN signer <> key_id OR idx % 37 = 4 THEN 'SIGNATURE_INVALID'
  WHEN idx % 41 = 3 OR (kind IN ('spend', 'scope', 'replication') AND NOT list_contains(subjects, subject)) OR (kind = 'spend' AND NOT meter) OR (kind IN ('scope', 'replication') AND meter) THEN 'FORBIDDEN' WHEN idx % 53 = 8 THEN 'FUTURE_TIMESTAMP' END AS error FROM e""")
def envelope(spark, d):
    """The first rule that each record's envelope breaks."""
    return enveloped(Run(spark, d)).select("idx", A.envelope_error(P).alias("error"))


@query("T05_batches")
def batches(spark, d):
    """Records sent in batches of eight by each source, numbered in turn; every ninth batch comes one too late, every
    seventh again, every thirteenth entry of some sources with another hash; of some entries the envelope is checked, and its error rejects
    their batch, which is then sent without it."""
    by = Window.partitionBy("fleet", "source").orderBy("idx")
    rows = enveloped(Run(spark, d)).where("bound").select("fleet", "source", "idx", "kind", "usage_id", "delta", "subject", "hash", F.when(F.col("idx") % 61 == 7, A.envelope_error(P)).alias("error"), F.row_number().over(by).cast("bigint").alias("seq"), F.lag("hash", 1, "0" * 64).over(by).alias("prev"))
    own = F.expr("(seq - 1) div 8")
    rows = rows.select(
        F.concat_ws("/", "fleet", "source").alias("source"), own.alias("own"), "seq", F.col("seq").alias("position"), "hash", "prev", (F.col("kind") == "terminal").alias("terminal"), "error",
        F.when(F.col("kind") == "spend", F.col("usage_id").cast("string")).alias("usage_id"), F.when(F.col("idx") % 211 == 3, F.concat_ws("/", "delta", "subject")).otherwise(F.col("usage_id").cast("string")).alias("payload"),
    )
    first = rows.withColumn("batch", F.col("own") * 10 + F.when(F.col("own") % 9 == 4, 15).otherwise(0))
    mended = rows.withColumn("error", F.lit(None).cast("string")).withColumn("batch", F.col("own") * 10 + 3)
    again = rows.where("own % 7 = 2").withColumn("batch", F.col("own") * 10 + 36)
    forked = again.where("crc32(source) % 3 = 1 and own > 40").withColumn("hash", F.when(F.col("seq") % 13 == 5, F.sha2("hash", 256)).otherwise(F.col("hash"))).withColumn("batch", F.col("batch") + 1)
    every = first.unionByName(mended.join(rows.where("error is not null").select("source", "own").distinct(), ["source", "own"], "left_semi").select(first.columns)).unionByName(again).unionByName(forked)
    return A.admitted(every.drop("own"), P)


@query("J01_slot_join", f"{W}, slots AS (SELECT fleet, source, row_number() OVER (PARTITION BY fleet, source ORDER BY idx) AS seq, hash FROM kept WHERE kind NOT IN ('fork', 'gap')) SELECT fleet, epoch, start_ms, source, seq, hash FROM acc JOIN slots USING (fleet, source, hash)")
def slot_join(spark, d):
    """Accepted records with the slot that holds their hash."""
    from pyspark.sql import Window

    run, order = Run(spark, d), Window.partitionBy("fleet", "source").orderBy("idx")
    slots = V.before_end(run.placed).where("kind not in ('fork', 'gap')").select("fleet", "source", F.row_number().over(order).cast("bigint").alias("seq"), "hash")
    return run.rows.join(slots, ["fleet", "source", "hash"]).select(*V.WINDOW, "source", "seq", "hash")


VOTERS = [(0, "watch-0"), (1, "watch-1"), (2, "watch-2")]


@query("T11_degradation", f"""{W}, {HASHES}, ended AS (SELECT fleet, source, min(received_ms) AS at_ms FROM kept WHERE kind = 'fork' GROUP BY ALL UNION ALL SELECT DISTINCT fleet, source, {BASE + 15 * DAY} FROM src WHERE revoked),
  hit AS (SELECT res.*, coalesce(evidence, '') AS evidence, start_ms + {SIX} AS end_ms, ('0x' || hash[1:6])::BIGINT AS n FROM res LEFT JOIN ev USING (fleet, epoch, start_ms, detector, target) WHERE status = 'HIT'),
  why AS (SELECT h.fleet, h.hash, e.at_ms, h.end_ms FROM hit h JOIN ended e ON e.fleet = h.fleet AND (EXISTS (SELECT 1 FROM cut c WHERE c.fleet = h.fleet AND c.epoch = h.epoch AND c.start_ms = h.start_ms AND c.source = e.source)
      OR EXISTS (SELECT 1 FROM acc a WHERE a.fleet = e.fleet AND a.source = e.source AND a.epoch = h.epoch AND a.start_ms = h.start_ms AND contains(h.evidence, a.hash)))
    UNION ALL SELECT fleet, hash, {BASE + 20 * DAY}, end_ms FROM hit WHERE n % 5 = 2),
  d AS (SELECT fleet, hash, min(at_ms) AS degraded_ms FROM why WHERE at_ms >= end_ms GROUP BY ALL)
  SELECT h.fleet, h.start_ms, h.detector, h.target, degraded_ms, CASE WHEN degraded_ms IS NOT NULL THEN 'DEGRADED' ELSE 'VALID' END AS assurance, CASE WHEN degraded_ms IS NULL THEN 'QUEUED' ELSE 'CANCELLED' END AS delivery FROM hit h LEFT JOIN d USING (fleet, hash)""")
def degradation(spark, d):
    """What forks, revoked source keys and a revoked watcher's key (that of watcher 2, which voted for some) make of each alert and its queued page."""
    run = Run(spark, d, keep=True)
    every = written(run.hashed.where("status = 'HIT'").withColumn("end_ms", F.col("start_ms") + P.window_ms), "hits")
    forks = V.before_end(run.placed).where("kind = 'fork'").groupBy("fleet", "source").agg(F.min("received_ms").alias("at_ms"))
    keys = run.sources.where("revoked").select("fleet", "source", F.lit(BASE + 15 * DAY).alias("at_ms")).distinct()
    n = F.conv(F.substring("hash", 1, 6), 16, 10).cast("bigint")
    cast = every.where(n % 5 == 2).select("fleet", "hash", F.lit(2).alias("watcher"))
    told = spark.createDataFrame([("watch-2", BASE + 20 * DAY)], "key_id string, at_ms long").join(spark.createDataFrame(VOTERS, "watcher long, key_id string"), "key_id")
    when = V.degraded(every, run.cuts, run.rows.select("fleet", "source", "hash"), forks.unionByName(keys), cast.join(told, "watcher"))
    joined = every.select("fleet", "start_ms", "detector", "target", "hash").join(when, ["fleet", "hash"], "left")
    queued = K.degrade(F.when(F.col("degraded_ms").isNull(), "DEGRADED").otherwise("VALID"), F.lit("QUEUED"))
    return joined.select("fleet", "start_ms", "detector", "target", "degraded_ms", F.when(F.col("degraded_ms").isNull(), "VALID").otherwise("DEGRADED").alias("assurance"), F.when(F.col("degraded_ms").isNull(), "QUEUED").otherwise(queued["delivery"]).alias("delivery"))


@query("P06_source_view", f"""{W}, l AS (SELECT fleet, source, arg_max(state, start_ms) AS state, arg_max(pending, start_ms) AS pending, arg_max(complete, start_ms) AS complete, max(head_seq) AS head_seq, max(last_ms) AS last_ms FROM cut GROUP BY ALL),
  a AS (SELECT fleet, count(*) AS n FROM results WHERE status = 'HIT' GROUP BY ALL) SELECT l.*, coalesce(n, 0) AS hits FROM l LEFT JOIN a USING (fleet)""")
def source_view(spark, d):
    """Each source as it stands at the last closed window, with its fleet's number of hits."""
    run = Run(spark, d, keep=True)
    last = lambda c: F.max_by(c, "start_ms").alias(c)
    view = run.cuts.groupBy("fleet", "source").agg(last("state"), last("pending"), last("complete"), F.max("head_seq").alias("head_seq"), F.max("last_ms").alias("last_ms"))
    hits = run.results.where("status = 'HIT'").groupBy("fleet").agg(F.count("*").alias("hits"))
    return view.join(hits, "fleet", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
