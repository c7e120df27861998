"""Journals of the three fleets of ``runs``: built from a run, altered in places, and judged.

Fixed values: moduli by which rows are altered, on both sides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.params import Params
from vigil.operators import fleet as V
from vigil.operators import ledger as L
from vigil.operators import clocked, paging
from vigil.operators.scans import Dealt
from vigil.sources.store import append, scan, shared, written

from . import runs as R
from . import tables as T
from .registry import query

BASE, DAY, SIX, P = R.BASE, R.DAY, R.SIX, R.P
STEPS = [("OPEN", "ACTIVE"), ("PAUSE", "PAUSED"), ("RESUME", "ACTIVE"), ("CLOSE", "CLOSED"), ("OPEN", "ACTIVE")]
WATCHERS = [(1, "watch-1", "d1"), (2, "watch-2", "d2"), (3, "watch-3", "d2")]
ZERO = L.ZERO


_made: dict[tuple[str, str, str], tuple[str, object]] = {}


def once(spark, d, name: str, make) -> DataFrame:
    """A written table that several queries of an application over the same tables start from; made anew where its files are gone."""
    key = (spark.sparkContext.applicationId, d, name)
    path = spark._jvm.org.apache.hadoop.fs.Path(_made[key][0]) if key in _made else None
    if path is None or not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        where = shared(spark, name)
        rows = make()
        rows.write.parquet(where)
        _made[key] = where, rows.schema
    return spark.read.schema(_made[key][1]).parquet(_made[key][0])


def recorded(spark, d) -> R.Run:
    """The run, over records that are computed and written once for all that read them."""
    return R.Run(spark, d, keep=True, standing=once(spark, d, "standing", lambda: R.Run(spark, d, keep=True).standing))


def positioned(spark, d) -> DataFrame:
    """Recomputed results with their position in their window, and a number that alters rows."""
    return once(spark, d, "results", lambda: _positioned(spark, d))


def _positioned(spark, d) -> DataFrame:
    order = Window.partitionBy("fleet", "start_ms").orderBy("detector", "target")
    rows = recorded(spark, d).hashed.select(*V.WINDOW, "detector", "target", "status", "manifest", "hash", F.row_number().over(order).cast("bigint").alias("position"))
    return rows.withColumn("n", F.conv(F.substring("hash", 1, 6), 16, 10).cast("bigint")).withColumn("end_ms", F.col("start_ms") + SIX)


WINDOW_KEY = "concat('w', start_ms)"
CONFIG = "concat_ws('/', fleet, epoch)"


def expected(results: DataFrame) -> DataFrame:
    return results.select("fleet", F.expr(WINDOW_KEY).alias("key"), "position", "hash", (F.col("status") == "HIT").alias("hit"), "manifest", F.expr(CONFIG).alias("config"))


def due(results: DataFrame) -> DataFrame:
    return results.groupBy("fleet", F.expr(WINDOW_KEY).alias("key"), "end_ms", "manifest").agg(F.count("*").alias("n_results"))


def config_objects(spark) -> DataFrame:
    """Configurations by digest, each with its predecessor's."""
    hash_ = lambda epoch: F.sha2(F.concat_ws("/", F.lit("config"), "fleet", epoch), 256)
    return R.configs(spark).select("fleet", hash_(F.col("epoch")).alias("hash"), "epoch", F.when(F.col("epoch") == 1, ZERO).otherwise(hash_(F.col("epoch") - 1)).alias("predecessor"), "effective_ms")


def roster(spark) -> DataFrame:
    """Watchers by configuration; the third is off in the second epoch."""
    voters = spark.createDataFrame(WATCHERS, "watcher long, key_id string, domain string")
    return R.configs(spark).crossJoin(voters).select("fleet", F.expr(CONFIG).alias("config"), "watcher", "key_id", "domain", F.expr("not (epoch = 2 and watcher = 3)").alias("enabled"))


def page_objects(results: DataFrame) -> DataFrame:
    """Pages of alerts, some of which are missing."""
    return results.where("status = 'HIT' and n % 3 <> 0 and n % 31 <> 7").select("fleet", F.sha2(F.concat(F.lit("page/"), "hash"), 256).alias("hash")).distinct()


def events(spark, d, results: DataFrame) -> DataFrame:
    """A legal journal of the run, in places altered: what is altered makes later rows refused as well."""
    run = recorded(spark, d)
    n, end = F.col("n"), F.col("end_ms")

    def rows(df, kind, rank, at, key, tie=None, **members):
        of = lambda c, t: (F.lit(c) if c is None or isinstance(c, (int, str)) else c).cast(t)
        given = [of(members.get(m), "bigint" if m[0] == "n" else "string").alias(m) for m in L.MEMBERS[3:]]
        return df.select("fleet", of(at, "bigint").alias("at_ms"), F.lit(rank).alias("rank"), F.coalesce(of(tie, "bigint"), F.lit(0).cast("bigint")).alias("tie"), of(kind, "string").alias("kind"), of(key, "string").alias("key"), *given)

    epoch, effective = F.col("epoch"), F.col("effective_ms")
    standing = run.standing.select("fleet", "source", "idx", "received_ms", "observed_ms", "kind", "late", "hash", "pending", "verdict", (~F.col("kind").isin("fork", "gap")).cast("bigint").alias("is_record"))
    dealt = Dealt(standing, ["fleet"], ["idx"])
    standing = dealt.prefixes({"index": ("sum", F.col("is_record"))}, inclusive=True)
    standing = dealt.prefixes({"before": ("sum", F.col("is_record")), "prior": ("max", F.when(F.col("is_record") == 1, F.struct("idx", "hash")))}, rows=standing, within=("source",))
    source, idx, received, head = F.concat(F.lit("s"), "source"), F.col("idx"), F.col("received_ms"), F.coalesce("before", F.lit(0))
    by_mark = lambda record, gap, fork: F.when(F.col("kind") == "gap", gap).when(F.col("kind") == "fork", fork).otherwise(record)
    flipped = F.when(idx % 1999 == 7, ~F.col("late")).otherwise(F.col("late"))
    counted = F.when(F.col("kind") == "spend", F.col("verdict") == "COUNTED").otherwise(F.lit(True))
    prev = F.when(idx % 2003 == 11, F.sha2("hash", 256)).otherwise(F.coalesce("prior.hash", F.lit(ZERO)))
    windows = results.groupBy("fleet", "start_ms", "end_ms", "manifest").agg(F.count("*").alias("m"))
    window, turn = F.expr(WINDOW_KEY), F.expr(f"start_ms div {SIX}")
    hits = results.where("status = 'HIT'")
    pages = hits.where("n % 3 <> 0")
    fleets = spark.range(3).select(F.col("id").alias("fleet"))
    alert, config, page = F.col("hash"), F.expr(CONFIG), F.sha2(F.concat(F.lit("page/"), "hash"), 256)
    again, acted, closed = (n % 5 == 0).cast("int"), (n % 3 == 1).cast("int"), ((n % 3 == 1) & (n % 4 == 0)).cast("int")
    objects = config_objects(spark).withColumn("key", F.col("hash"))
    vote = lambda rank, at, watcher: rows(pages, "VoteAccepted", rank, at, alert, watcher, n1=watcher, s1=config, s2=F.when(n % 41 == 6, F.sha2("manifest", 256)).otherwise(F.col("manifest")), s3=F.concat(F.lit("watch-"), F.when(n % 43 == 9, 1).otherwise(watcher)))
    sent = lambda at, state, attempts, df=pages, **more: rows(df, "DeliveryChanged", 12, at, alert, n1=attempts, s2=state, **more)
    changed = lambda df, at, revision, a, b, actor=None: rows(df, "AlertChanged", 10, at, alert, n1=revision, s1=a, s2=b, s3=actor)
    parts = [
        rows(fleets, "FleetChanged", 0, BASE, F.lit("fleet"), s1="RUNNING"),
        rows(objects, "ConfigScheduled", 0, F.when(epoch == 1, effective).otherwise(effective - DAY), F.col("key"), tie=epoch),
        rows(objects, "ConfigActivated", 1, F.when((epoch == 3) & (F.col("fleet") == 2), effective - 1).otherwise(effective), F.col("key")),
        rows(run.sources.where("revoked").select("fleet", "key_id").distinct(), "KeysRevoked", 2, BASE + 15 * DAY, F.col("key_id")),
        rows(fleets, "KeysRevoked", 2, BASE + 20 * DAY, F.lit("watch-2")),
        rows(  # in one pass, as all of them need what came before
            standing.where("kind is not null"), by_mark(F.lit("SourceAccepted"), F.lit("SourceBuffered"), F.lit("SourceForkObserved")), 3, received, source, idx,
            n1=by_mark(F.col("index"), None, head), n2=by_mark(F.col("observed_ms"), None, head), n3=by_mark(head + 1, head + F.col("pending") * 2, None), s1=by_mark(flipped.cast("string"), None, F.lit("SLOT_FORK")),
            s2=by_mark(F.col("hash"), None, F.sha2("hash", 256)), s3=by_mark(prev, None, F.when(idx % 3 == 0, F.sha2("hash", 256)).otherwise(F.col("hash"))), s4=by_mark(F.concat_ws(":", "kind", counted), None, F.lit("none")),
        ),
        rows(windows, "Tick", 5, end, F.lit("tick"), n1=F.when(turn % 50 == 7, end - 1).otherwise(end)),
        rows(windows, "WindowFinalized", 6, end, window, n1=F.when(turn % 31 == 3, F.col("m") + 1).otherwise(F.col("m")), s1=F.when(turn % 37 == 5, F.sha2("manifest", 256)).otherwise(F.col("manifest"))),
        rows(results.where(f"not (start_ms div {SIX} % 61 = 9 and position = 2)"), "ResultFinalized", 7, end, window, F.col("position"), s1=F.when(n % 59 == 11, F.sha2("hash", 256)).otherwise(F.col("hash"))),
        rows(hits, "AlertCreated", 8, end, alert, n1=end + P.vote_ttl_ms + F.when(n % 61 == 5, 1).otherwise(0), s1=alert),
        vote(9, end + 10_000, F.when(n % 13 == 4, 9).otherwise(1)), vote(9, end + F.when(n % 7 == 1, 200_000).otherwise(20_000), F.when(n % 11 == 2, 1).when(n % 11 == 3, 3).otherwise(2)),
        changed(hits.where("n % 3 = 0"), end + F.when(n % 67 == 0, 150_000).otherwise(180_000), F.when(n % 23 == 0, 3).otherwise(2), "CANDIDATE", "EXPIRED"),
        changed(pages, end + 20_001, 4, "CANDIDATE", "CORROBORATED", F.when(n % 71 == 1, "op")),
        changed(hits.where("n % 3 = 1"), end + 60_000, again + F.when(n % 17 == 3, 9).otherwise(8), "CORROBORATED", "ACKNOWLEDGED", "op"),
        changed(hits.where("n % 3 = 1 and n % 4 = 0"), end + 80_000, again + 9, "ACKNOWLEDGED", "CLOSED", "op"),
        changed(hits.where("n % 3 = 2 and n % 19 = 2"), end + 70_000, again + 8, "CORROBORATED", "EXPIRED"),
        rows(hits.where("n % 23 = 0"), "AlertDegraded", 11, end + 100_000, alert, n1=F.when(n % 3 == 0, 2).otherwise(again + acted + closed + 8)),
        sent(end + 20_002, "QUEUED", F.when(n % 29 == 3, 1).otherwise(0), s3=page), sent(end + 21_000, "IN_FLIGHT", 1), sent(end + 22_000, F.when(n % 5 == 0, "RETRY").otherwise("DELIVERED"), 1),
        sent(end + 22_500, "IN_FLIGHT", 2, pages.where("n % 5 = 0 and n % 2 = 0")), sent(end + 23_000, "DELIVERED", 2, pages.where("n % 5 = 0")),
        *[rows(fleets, "SubscriptionChanged", 13, BASE + i * 5 * DAY, F.lit("sub"), s1=a, s2=b) for i, (a, b) in enumerate(STEPS)],
    ]
    return reduce(DataFrame.unionByName, parts).withColumn("order", F.struct("at_ms", "rank", "tie", "key", F.coalesce("n1", F.lit(-1).cast("bigint")).alias("n1")))


def journal(spark, d) -> DataFrame:
    return once(spark, d, "journal", lambda: L.appended(events(spark, d, positioned(spark, d))))


def _members(**given) -> str:
    return ", ".join(f"CAST({given.get(m, 'NULL')} AS {'BIGINT' if m[0] == 'n' else 'VARCHAR'}) AS {m}" for m in L.MEMBERS[3:])


def _vote(at, watcher) -> str:
    signer = f"'watch-' || CASE WHEN n % 43 = 9 THEN 1 ELSE {watcher} END"
    return f"SELECT fleet, {at}, 9, {watcher}, 'VoteAccepted', hash, {_members(n1=watcher, s1='config', s2='CASE WHEN n % 41 = 6 THEN sha256(manifest) ELSE manifest END', s3=signer)} FROM pages"


def _sent(at, state, attempts, where="true", **more) -> str:
    return f"SELECT fleet, end_ms + {at}, 12, 0, 'DeliveryChanged', hash, {_members(n1=attempts, s2=state, **more)} FROM pages WHERE {where}"


def _changed(source, at, revision, a, b, actor="NULL") -> str:
    return f"SELECT fleet, end_ms + {at}, 10, 0, 'AlertChanged', hash, {_members(n1=revision, s1=repr(a), s2=repr(b), s3=actor)} FROM {source}"


AGAIN = "(n % 5 = 0)::INT"
PARTS = [
    f"SELECT fleet, {BASE} AS at_ms, 0 AS rank, 0 AS tie, 'FleetChanged' AS kind, 'fleet' AS key, {_members(s1=repr('RUNNING'))} FROM range(3) t(fleet)",
    f"SELECT fleet, CASE WHEN epoch = 1 THEN effective_ms ELSE effective_ms - {DAY} END, 0, epoch, 'ConfigScheduled', hash, {_members()} FROM cobj",
    f"SELECT fleet, effective_ms - (epoch = 3 AND fleet = 2)::INT, 1, 0, 'ConfigActivated', hash, {_members()} FROM cobj",
    f"SELECT DISTINCT fleet, {BASE + 15 * DAY}, 2, 0, 'KeysRevoked', key_id, {_members()} FROM src WHERE revoked", f"SELECT fleet, {BASE + 20 * DAY}, 2, 0, 'KeysRevoked', 'watch-2', {_members()} FROM range(3) t(fleet)",
    f"""SELECT fleet, received_ms, 3, idx, 'SourceAccepted', 's' || source, {_members(n1='index', n2='observed_ms', n3='head + 1', s1='(late <> (idx % 1999 = 7))', s2='hash', s3="CASE WHEN idx % 2003 = 11 THEN sha256(hash) ELSE prior END", s4="kind || ':' || (kind <> 'spend' OR counted)")} FROM numbered WHERE is_record""",
    f"SELECT fleet, received_ms, 3, idx, 'SourceBuffered', 's' || source, {_members(n3='head + pending * 2')} FROM numbered WHERE kind = 'gap'",
    f"SELECT fleet, received_ms, 3, idx, 'SourceForkObserved', 's' || source, {_members(n1='head', n2='head', s1=repr('SLOT_FORK'), s2='sha256(hash)', s3='CASE WHEN idx % 3 = 0 THEN sha256(hash) ELSE hash END', s4=repr('none'))} FROM numbered WHERE kind = 'fork'",
    f"SELECT fleet, end_ms, 5, 0, 'Tick', 'tick', {_members(n1=f'end_ms - (start_ms // {SIX} % 50 = 7)::INT')} FROM wins",
    f"SELECT fleet, end_ms, 6, 0, 'WindowFinalized', 'w' || start_ms, {_members(n1=f'm + (start_ms // {SIX} % 31 = 3)::INT', s1=f'CASE WHEN start_ms // {SIX} % 37 = 5 THEN sha256(manifest) ELSE manifest END')} FROM wins",
    f"SELECT fleet, end_ms, 7, position, 'ResultFinalized', 'w' || start_ms, {_members(s1='CASE WHEN n % 59 = 11 THEN sha256(hash) ELSE hash END')} FROM pos WHERE NOT (start_ms // {SIX} % 61 = 9 AND position = 2)",
    f"SELECT fleet, end_ms, 8, 0, 'AlertCreated', hash, {_members(n1='end_ms + 180000 + (n % 61 = 5)::INT', s1='hash')} FROM hits",
    _vote("end_ms + 10000", "CASE WHEN n % 13 = 4 THEN 9 ELSE 1 END"), _vote("end_ms + CASE WHEN n % 7 = 1 THEN 200000 ELSE 20000 END", "CASE WHEN n % 11 = 2 THEN 1 WHEN n % 11 = 3 THEN 3 ELSE 2 END"),
    _changed("hits WHERE n % 3 = 0", "CASE WHEN n % 67 = 0 THEN 150000 ELSE 180000 END", "2 + (n % 23 = 0)::INT", "CANDIDATE", "EXPIRED"), _changed("pages", "20001", "4", "CANDIDATE", "CORROBORATED", "CASE WHEN n % 71 = 1 THEN 'op' END"),
    _changed("hits WHERE n % 3 = 1", "60000", f"8 + {AGAIN} + (n % 17 = 3)::INT", "CORROBORATED", "ACKNOWLEDGED", "'op'"), _changed("hits WHERE n % 3 = 1 AND n % 4 = 0", "80000", f"9 + {AGAIN}", "ACKNOWLEDGED", "CLOSED", "'op'"),
    _changed("hits WHERE n % 3 = 2 AND n % 19 = 2", "70000", f"8 + {AGAIN}", "CORROBORATED", "EXPIRED"),
    f"SELECT fleet, end_ms + 100000, 11, 0, 'AlertDegraded', hash, {_members(n1=f'CASE WHEN n % 3 = 0 THEN 2 ELSE 8 + {AGAIN} + (n % 3 = 1)::INT + (n % 3 = 1 AND n % 4 = 0)::INT END')} FROM hits WHERE n % 23 = 0",
    _sent("20002", "'QUEUED'", "(n % 29 = 3)::INT", s3="sha256('page/' || hash)"), _sent("21000", "'IN_FLIGHT'", "1"), _sent("22000", "CASE WHEN n % 5 = 0 THEN 'RETRY' ELSE 'DELIVERED' END", "1"),
    _sent("22500", "'IN_FLIGHT'", "2", "n % 5 = 0 AND n % 2 = 0"), _sent("23000", "'DELIVERED'", "2", "n % 5 = 0"),
    f"SELECT fleet, {BASE} + i * {5 * DAY}, 13, 0, 'SubscriptionChanged', 'sub', {_members(s1='a', s2='b')} FROM range(3) f(fleet), (VALUES {', '.join(f'({i}, {a!r}, {b!r})' for i, (a, b) in enumerate(STEPS))}) v(i, a, b)",
]
ROWS = f"""pos AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY fleet, start_ms ORDER BY detector, target) AS position, ('0x' || hash[1:6])::BIGINT AS n, start_ms + {SIX} AS end_ms, fleet || '/' || epoch AS config FROM res),
hits AS (SELECT * FROM pos WHERE status = 'HIT'), pages AS (SELECT * FROM hits WHERE n % 3 <> 0), wins AS (SELECT fleet, start_ms, end_ms, manifest, count(*) AS m FROM pos GROUP BY ALL),
cobj AS (SELECT fleet, epoch, effective_ms, sha256('config/' || fleet || '/' || epoch) AS hash, CASE WHEN epoch = 1 THEN repeat('0', 64) ELSE sha256('config/' || fleet || '/' || (epoch - 1)) END AS predecessor FROM cfg),
numbered AS (SELECT *, kind NOT IN ('fork', 'gap') AS is_record, count(*) FILTER (kind NOT IN ('fork', 'gap')) OVER (PARTITION BY fleet ORDER BY idx) AS index,
  count(*) FILTER (kind NOT IN ('fork', 'gap')) OVER b AS head, coalesce(arg_max(hash, idx) FILTER (kind NOT IN ('fork', 'gap')) OVER b, repeat('0', 64)) AS prior FROM stand WINDOW b AS (PARTITION BY fleet, source ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ev_ AS ({"""
  UNION ALL """.join(PARTS)}),
jrn AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY fleet ORDER BY at_ms, rank, tie, key, coalesce(n1, -1)) AS seq FROM ev_),
roster AS (SELECT fleet, fleet || '/' || epoch AS config, watcher, key_id, domain FROM cfg, (VALUES {', '.join(map(str, WATCHERS))}) r(watcher, key_id, domain) WHERE NOT (epoch = 2 AND watcher = 3)),
size_ AS (SELECT *, octet_length(encode(at_ms || 'x' || kind || 'x' || key || {" || ".join(f"'x' || coalesce({m}::VARCHAR, 'x')" for m in L.MEMBERS[3:])})) AS bytes FROM jrn)"""
Q = f"{R.W}, {R.HASHES}, {ROWS}"

#: Each kind's rule, folded row by row: a recursion over the rows of a source, an alert, a delivery.
JUDGED = f"""{Q},
sa AS MATERIALIZED (SELECT fleet, key, seq, n1, n3, s2, s3, row_number() OVER (PARTITION BY fleet, key ORDER BY seq) AS nth, split_part(s4, ':', 1) = 'terminal' AS final, s1 = (n2 < at_ms - 120000)::VARCHAR AS in_time,
  EXISTS (SELECT 1 FROM jrn f WHERE f.kind = 'SourceForkObserved' AND f.fleet = j.fleet AND f.key = j.key AND f.seq < j.seq AND f.n1 = f.n2 AND f.s2 <> f.s3) AS forked FROM jrn j WHERE kind = 'SourceAccepted'),
sc_ AS (SELECT DISTINCT fleet, key, 0::BIGINT AS nth, 0::BIGINT AS seq, 0::BIGINT AS head, repeat('0', 64) AS hash, false AS ended, NULL::VARCHAR AS fault FROM sa
  UNION ALL SELECT a.fleet, a.key, a.nth, a.seq, CASE WHEN f IS NULL THEN n3 ELSE head END, CASE WHEN f IS NULL THEN s2 ELSE hash END, ended OR (f IS NULL AND final), f
  FROM (SELECT a.*, c.head, c.hash, c.ended, CASE WHEN a.forked OR c.ended THEN 'TRANSITION_INVALID' WHEN a.n3 <> c.head + 1 OR a.s3 <> c.hash THEN 'CHAIN_INVALID' WHEN NOT in_time THEN 'TRANSITION_INVALID' END AS f FROM sc_ c JOIN sa a ON a.fleet = c.fleet AND a.key = c.key AND a.nth = c.nth + 1) a),
sc AS MATERIALIZED (SELECT * FROM sc_),
sf AS (SELECT c.fleet, c.seq, CASE WHEN fault = 'TRANSITION_INVALID' AND a.in_time THEN fault WHEN fault = 'CHAIN_INVALID' OR a.n1 <> coalesce(lag(a.n1) OVER (PARTITION BY c.fleet ORDER BY c.seq), 0) + 1 THEN 'CHAIN_INVALID' ELSE fault END AS fault
  FROM sc c JOIN sa a USING (fleet, key, nth) WHERE c.nth > 0),
bu AS (SELECT b.fleet, b.seq, b.key, b.n3, coalesce((SELECT max(head) FROM sc WHERE sc.fleet = b.fleet AND sc.key = b.key AND sc.seq < b.seq), 0) < b.n3 AND NOT coalesce((SELECT bool_or(ended) FROM sc WHERE sc.fleet = b.fleet AND sc.key = b.key AND sc.seq < b.seq), false)
  AND NOT EXISTS (SELECT 1 FROM jrn f WHERE f.kind = 'SourceForkObserved' AND f.fleet = b.fleet AND f.key = b.key AND f.seq < b.seq AND f.n1 = f.n2 AND f.s2 <> f.s3) AS ok FROM jrn b WHERE b.kind = 'SourceBuffered'),
bf AS (SELECT fleet, seq, CASE WHEN ok AND row_number() OVER (PARTITION BY fleet, key, n3, ok ORDER BY seq) = 1 THEN NULL ELSE 'TRANSITION_INVALID' END AS fault FROM bu),
gr AS MATERIALIZED (SELECT j.*, max(CASE WHEN kind NOT IN ('ResultFinalized', 'AlertCreated') THEN seq END) OVER (PARTITION BY fleet ORDER BY seq) AS opener FROM jrn j),
op AS (SELECT g.fleet, g.seq AS opener, g.key, w.end_ms, w.start_ms, w.m, w.manifest, g.n1, g.s1, (SELECT count(*) FROM gr r WHERE r.fleet = g.fleet AND r.opener = g.seq AND r.kind = 'ResultFinalized') AS found FROM gr g LEFT JOIN wins w ON w.fleet = g.fleet AND 'w' || w.start_ms = g.key WHERE g.kind = 'WindowFinalized'),
wf AS (SELECT fleet, opener AS seq, CASE WHEN manifest IS NULL THEN 'OBJECT_MISSING' WHEN s1 <> manifest OR n1 <> m THEN 'REPLAY_MISMATCH' WHEN found <> n1 THEN 'TRANSITION_INVALID' END AS fault FROM op),
rf AS (SELECT r.fleet, r.seq, CASE WHEN o.opener IS NULL THEN 'TRANSITION_INVALID' WHEN p.hash IS DISTINCT FROM r.s1 THEN 'REPLAY_MISMATCH' END AS fault FROM (SELECT *, row_number() OVER (PARTITION BY fleet, opener ORDER BY seq) AS place FROM gr WHERE kind = 'ResultFinalized') r
  LEFT JOIN op o ON o.fleet = r.fleet AND o.opener = r.opener AND o.n1 = o.m LEFT JOIN pos p ON p.fleet = o.fleet AND p.start_ms = o.start_ms AND p.position = r.place),
ac AS MATERIALIZED (SELECT g.fleet, g.seq, h.manifest, h.config, g.n1 AS expires, h.hash IS NOT NULL AS ok FROM gr g LEFT JOIN op o ON o.fleet = g.fleet AND o.opener = g.opener AND o.n1 = o.m LEFT JOIN hits h ON h.fleet = g.fleet AND h.start_ms = o.start_ms AND h.hash = g.s1 AND g.n1 = o.end_ms + 180000 WHERE g.kind = 'AlertCreated'),
pg AS (SELECT DISTINCT fleet, sha256('page/' || hash) AS page FROM pages WHERE n % 31 <> 7),
al AS MATERIALIZED (SELECT j.fleet, j.key, j.seq, j.at_ms, j.kind, j.n1, j.s1, j.s2, j.s3, a.ok AS made, a.manifest AS c_manifest, a.config AS c_config, a.expires AS c_expires, p.page IS NOT NULL AS has_page, row_number() OVER (PARTITION BY j.fleet, j.key ORDER BY j.seq) AS nth,
    EXISTS (SELECT 1 FROM jrn k WHERE k.kind = 'KeysRevoked' AND k.fleet = j.fleet AND k.key = j.s3 AND k.seq < j.seq) AS revoked
  FROM jrn j LEFT JOIN ac a ON a.fleet = j.fleet AND a.seq = j.seq LEFT JOIN pg p ON p.fleet = j.fleet AND p.page = j.s3 WHERE j.kind IN ('AlertCreated', 'VoteAccepted', 'AlertChanged', 'AlertDegraded', 'DeliveryChanged')),
st_ AS (SELECT DISTINCT fleet, key, 0::BIGINT AS nth, 0::BIGINT AS seq, 'NONE' AS state, 'VALID' AS assurance, 0::BIGINT AS revision, 'NONE' AS page, NULL::VARCHAR AS manifest, NULL::VARCHAR AS config, NULL::BIGINT AS expires, CAST([] AS BIGINT[]) AS voters, CAST([] AS VARCHAR[]) AS domains, NULL::VARCHAR AS fault FROM al
  UNION ALL SELECT fleet, key, nth, seq,
    CASE WHEN f IS NOT NULL THEN state WHEN kind = 'AlertCreated' THEN 'CANDIDATE' WHEN kind = 'AlertChanged' THEN s2 ELSE state END, CASE WHEN f IS NOT NULL THEN assurance WHEN kind = 'AlertCreated' THEN 'VALID' WHEN kind = 'AlertDegraded' THEN 'DEGRADED' ELSE assurance END,
    CASE WHEN f IS NOT NULL THEN revision WHEN kind = 'AlertCreated' THEN 1 ELSE revision + 1 END, CASE WHEN f IS NULL AND kind = 'DeliveryChanged' THEN s2 ELSE page END,
    CASE WHEN f IS NULL AND kind = 'AlertCreated' THEN c_manifest ELSE manifest END, CASE WHEN f IS NULL AND kind = 'AlertCreated' THEN c_config ELSE config END, CASE WHEN f IS NULL AND kind = 'AlertCreated' THEN c_expires ELSE expires END,
    CASE WHEN f IS NOT NULL THEN voters WHEN kind = 'AlertCreated' THEN [] WHEN kind = 'VoteAccepted' THEN list_append(voters, n1) ELSE voters END,
    CASE WHEN f IS NOT NULL THEN domains WHEN kind = 'AlertCreated' THEN [] WHEN kind = 'VoteAccepted' AND NOT revoked THEN list_append(domains, domain) ELSE domains END, f
  FROM (SELECT a.*, s.* EXCLUDE (fleet, key, nth, seq, fault), r.domain, CASE a.kind
      WHEN 'AlertCreated' THEN CASE WHEN NOT made THEN 'TRANSITION_INVALID' END
      WHEN 'VoteAccepted' THEN CASE WHEN s.state = 'NONE' OR a.s1 <> s.config OR a.s2 <> s.manifest OR r.watcher IS NULL THEN 'TRANSITION_INVALID' WHEN r.key_id <> a.s3 THEN 'SIGNATURE_INVALID'
        WHEN a.at_ms >= s.expires OR s.state IN ('CLOSED', 'EXPIRED') OR list_contains(s.voters, a.n1) THEN 'TRANSITION_INVALID' END
      WHEN 'AlertChanged' THEN CASE WHEN s.state <> a.s1 OR a.n1 <> s.revision + 1 OR NOT ((a.s1 = 'CANDIDATE' AND a.s2 = 'CORROBORATED' AND a.s3 IS NULL AND len(list_distinct(s.domains)) >= 2 AND s.assurance = 'VALID') OR (a.s1 = 'CANDIDATE' AND a.s2 = 'EXPIRED' AND a.s3 IS NULL AND a.at_ms >= s.expires)
        OR (a.s1 = 'CORROBORATED' AND a.s2 = 'ACKNOWLEDGED' AND a.s3 IS NOT NULL) OR (a.s1 IN ('CANDIDATE', 'CORROBORATED', 'ACKNOWLEDGED') AND a.s2 = 'CLOSED' AND a.s3 IS NOT NULL)) THEN 'TRANSITION_INVALID' END
      WHEN 'AlertDegraded' THEN CASE WHEN s.state = 'NONE' OR s.assurance <> 'VALID' OR a.n1 <> s.revision + 1 THEN 'TRANSITION_INVALID' END
      ELSE CASE WHEN a.s3 IS NOT NULL AND NOT has_page THEN 'OBJECT_MISSING' WHEN NOT ((s.page = 'NONE' AND a.s2 = 'QUEUED' AND a.n1 = 0) OR (s.page IN ('QUEUED', 'RETRY') AND a.s2 IN ('IN_FLIGHT', 'CANCELLED')) OR (s.page = 'IN_FLIGHT' AND a.s2 IN ('DELIVERED', 'RETRY', 'FAILED', 'CANCELLED'))) THEN 'TRANSITION_INVALID' END END AS f
    FROM st_ s JOIN al a ON a.fleet = s.fleet AND a.key = s.key AND a.nth = s.nth + 1 LEFT JOIN roster r ON a.kind = 'VoteAccepted' AND r.fleet = a.fleet AND r.config = s.config AND r.watcher = a.n1)),
tk AS (SELECT fleet, seq, CASE WHEN n1 = at_ms AND n1 > coalesce(max(CASE WHEN n1 = at_ms THEN n1 END) OVER (PARTITION BY fleet ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN NULL ELSE 'TRANSITION_INVALID' END AS fault FROM jrn WHERE kind = 'Tick'),
cf AS (SELECT j.fleet, j.seq, CASE WHEN j.kind = 'ConfigActivated' AND j.at_ms < c.effective_ms THEN 'TRANSITION_INVALID' END AS fault FROM jrn j LEFT JOIN cobj c ON c.fleet = j.fleet AND c.hash = j.key WHERE j.kind IN ('ConfigScheduled', 'ConfigActivated')),
sb AS (SELECT fleet, seq, CASE WHEN row_number() OVER (PARTITION BY fleet ORDER BY seq) > 4 THEN 'TRANSITION_INVALID' END AS fault FROM jrn WHERE kind = 'SubscriptionChanged'),
fk AS (SELECT fleet, seq, CASE WHEN s2 = s3 THEN 'TRANSITION_INVALID' END AS fault FROM jrn WHERE kind = 'SourceForkObserved'),
fault_ AS (SELECT * FROM sf UNION ALL SELECT * FROM bf UNION ALL SELECT * FROM wf UNION ALL SELECT * FROM rf UNION ALL SELECT fleet, seq, fault FROM st_ WHERE nth > 0 UNION ALL SELECT * FROM tk UNION ALL SELECT * FROM cf UNION ALL SELECT * FROM sb UNION ALL SELECT * FROM fk),
jd AS (SELECT j.fleet, j.seq, j.kind, j.key, f.fault FROM jrn j LEFT JOIN fault_ f USING (fleet, seq))"""


def judged(spark, d) -> DataFrame:
    results = positioned(spark, d)
    run = recorded(spark, d)
    records = run.rows.select("fleet", "hash", F.when(F.col("kind") == "spend", F.col("counted")).otherwise(F.lit(True)).alias("counted"))
    return L.judged(journal(spark, d), due(results), expected(results), config_objects(spark), roster(spark), page_objects(results), records, P)


@query("T21_append", f"{Q} SELECT fleet, seq, at_ms, kind, key, n1, n2, n3, s1, s2, s3, s4 FROM jrn")
def append_rows(spark, d):
    """The journal as appended; its hash chain is checked by F16_journal_chain."""
    return journal(spark, d).select("fleet", "seq", *L.MEMBERS)


@query("T18_verify", f"{JUDGED} SELECT fleet, kind, count(*) AS n, count(fault) AS faults, min(seq) FILTER (fault IS NOT NULL) AS first_fault, arg_min(fault, seq) FILTER (fault IS NOT NULL) AS reason FROM jd GROUP BY ALL")
def verify(spark, d):
    first = F.when(F.col("fault").isNotNull(), F.col("seq"))
    return judged(spark, d).groupBy("fleet", "kind").agg(F.count("*").alias("n"), F.count("fault").alias("faults"), F.min(first).alias("first_fault"), F.min_by("fault", first).alias("reason"))


@query("T18_faults", f"{JUDGED} SELECT fleet, seq, kind, key, fault FROM jd WHERE fault IS NOT NULL")
def faults(spark, d):
    return judged(spark, d).where("fault is not null")


@query("W12_revision_cas", f"{JUDGED} SELECT fleet, seq, key FROM st_ JOIN al USING (fleet, key, nth, seq) WHERE kind IN ('AlertChanged', 'AlertDegraded') AND fault IS NOT NULL")
def revision_cas(spark, d):
    """Changes of alerts that don't follow the state and revision before them."""
    return judged(spark, d).where("fault is not null and kind in ('AlertChanged', 'AlertDegraded')").select("fleet", "seq", "key")


@query("F16_journal_chain", f"{Q} SELECT fleet, seq, 'HASH_INVALID' AS fault FROM jrn WHERE seq % 97 = 3 UNION ALL SELECT fleet, seq + 1, 'CHAIN_INVALID' FROM jrn j WHERE seq % 211 = 5 AND (seq + 1) % 97 <> 3 AND EXISTS (SELECT 1 FROM jrn k WHERE k.fleet = j.fleet AND k.seq = j.seq + 1) AND seq % 97 <> 3 UNION ALL SELECT fleet, seq, 'HASH_INVALID' FROM jrn WHERE seq % 211 = 5 AND seq % 97 <> 3")
def journal_chain(spark, d):
    """Rows whose members were altered, and rows after one whose hash was replaced."""
    j = journal(spark, d)
    j = j.withColumn("s1", F.when(F.col("seq") % 97 == 3, F.concat(F.coalesce("s1", F.lit("")), F.lit("!"))).otherwise(F.col("s1")))
    j = j.withColumn("hash", F.when((F.col("seq") % 211 == 5) & (F.col("seq") % 97 != 3), F.sha2("hash", 256)).otherwise(F.col("hash")))
    return L.unchained(j)


@query("W11_event_groups", f"{Q} SELECT fleet, key, max(n1) FILTER (kind = 'WindowFinalized') AS told, count(*) FILTER (kind = 'ResultFinalized') AS results, max(seq) - min(seq) = count(*) - 1 AS together FROM jrn WHERE kind IN ('WindowFinalized', 'ResultFinalized') GROUP BY fleet, key")
def event_groups(spark, d):
    rows = journal(spark, d).where("kind in ('WindowFinalized', 'ResultFinalized')")
    return rows.groupBy("fleet", "key").agg(
        F.max(F.when(F.col("kind") == "WindowFinalized", F.col("n1"))).alias("told"), F.count_if(F.expr("kind = 'ResultFinalized'")).alias("results"), (F.max("seq") - F.min("seq") == F.count("*") - 1).alias("together")
    )


FRAME = "SELECT fleet, seq, kind, bytes_so_far, (SELECT count(*) FROM size_ s WHERE s.fleet = 1 AND s.seq > 100 AND s.seq <= {through}) > (SELECT count(*) FROM y WHERE n = 1 OR (n <= 128 AND bytes_so_far <= 9000)) AS more FROM y WHERE n = 1 OR (n <= 128 AND bytes_so_far <= 9000)"
FRAMED = f"{Q}, x AS (SELECT * FROM size_ WHERE fleet = 1 AND seq > 100 AND seq <= {{through}} ORDER BY seq LIMIT 129), y AS (SELECT *, CAST(sum(bytes) OVER (ORDER BY seq) AS BIGINT) AS bytes_so_far, row_number() OVER (ORDER BY seq) AS n FROM x) {FRAME}"


@query("S10_frame_scan", FRAMED.replace("{through}", "400"))
def frame_scan(spark, d):
    return L.frame(journal(spark, d), 1, 100, 400, 128, 9000).select("fleet", "seq", "kind", "bytes_so_far", "more")


@query("L03_frame_end", FRAMED.replace("{through}", "130"))
def frame_end(spark, d):
    """A frame that reaches its pinned end: nothing more."""
    return L.frame(journal(spark, d), 1, 100, 130, 128, 9000).select("fleet", "seq", "kind", "bytes_so_far", "more")


REFERS = {"ConfigScheduled": ("config", "key"), "ConfigActivated": ("config", "key"), "WindowFinalized": ("manifest", "s1"), "ResultFinalized": ("result", "s1"), "DeliveryChanged": ("page", "s3")}
#: A recursion from page to page; objects are as long as their digests' first byte says.
PAGED = f"""{Q}, refs AS ({" UNION ALL ".join(f"SELECT fleet, seq, '{k}' AS kind, {c} AS hash FROM jrn WHERE kind = '{e}'" for e, (k, c) in REFERS.items())}),
intro AS (SELECT fleet, seq, sum(296 + ('0x' || hash[1:2])::BIGINT) AS ob FROM (SELECT fleet, kind, hash, min(seq) AS seq FROM refs WHERE hash IS NOT NULL GROUP BY ALL) GROUP BY ALL),
z AS MATERIALIZED (SELECT s.fleet, s.seq, CAST(bytes + 128 + coalesce(ob, 0) AS BIGINT) AS b, CAST(sum(bytes + 128 + coalesce(ob, 0)) OVER (PARTITION BY s.fleet ORDER BY s.seq) AS BIGINT) AS upto FROM size_ s LEFT JOIN intro i ON i.fleet = s.fleet AND i.seq = s.seq),
pg_ AS (SELECT fleet, 0::BIGINT AS lo, 0::BIGINT AS hi FROM range(3) t(fleet)
  UNION ALL SELECT p.fleet, p.hi + 1, max(y.seq) FROM pg_ p JOIN z x ON x.fleet = p.fleet AND x.seq = p.hi + 1 JOIN z y ON y.fleet = p.fleet AND y.seq BETWEEN p.hi + 1 AND p.hi + 40 AND (y.seq = x.seq OR y.upto - x.upto + x.b <= 12000) GROUP BY p.fleet, p.hi)"""


def paged(spark, d) -> DataFrame:
    j = journal(spark, d)
    refs = reduce(DataFrame.unionByName, [j.where(F.col("kind") == e).select("fleet", "seq", F.lit(k).alias("kind"), F.col(c).alias("hash")) for e, (k, c) in REFERS.items()]).where("hash is not null")
    objects = refs.select("fleet", "kind", "hash").distinct().withColumn("bytes", F.conv(F.substring("hash", 1, 2), 16, 10).cast("bigint") + 200)
    own = j.select("fleet", "seq", (F.octet_length(L.text_of(*L.MEMBERS)) + 128).alias("own"))
    entries = own.join(paging.introduced(refs, objects), ["fleet", "seq"], "left")
    return paging.pages(entries.select("fleet", "seq", (F.col("own") + F.coalesce("object_bytes", F.lit(0))).alias("bytes")), 40, 12_000)


@query("W10_all_pages", f"{PAGED} SELECT p.fleet, lo - 1 AS after_seq, hi AS next_seq, hi - lo + 1 AS entries, CAST((SELECT sum(b) FROM z WHERE z.fleet = p.fleet AND seq BETWEEN lo AND hi) AS BIGINT) AS bytes, hi < (SELECT max(seq) FROM z WHERE z.fleet = p.fleet) AS more FROM pg_ p WHERE lo > 0")
def all_pages(spark, d):
    """Every page of every fleet's journal, with the objects that its entries are the first to refer to."""
    return paging.listed(paged(spark, d))


@query("L03_page_entries", f"{PAGED} SELECT z.fleet, z.seq, b AS bytes, lo AS page FROM z JOIN pg_ p ON p.fleet = z.fleet AND z.seq BETWEEN p.lo AND p.hi WHERE lo > 0")
def page_entries(spark, d):
    return paged(spark, d)


@query("T21_checkpoint", f"{Q} SELECT fleet, max(seq) AS seq, max(at_ms) AS at_ms, CAST(sum(bytes) AS BIGINT) AS bytes FROM size_ GROUP BY fleet")
def checkpoint(spark, d):
    return L.checkpoints(journal(spark, d)).select("fleet", "seq", "at_ms", "bytes")


@query("A14_capacity", f"{Q}, r AS (SELECT fleet, seq, CAST(sum(bytes) OVER (PARTITION BY fleet ORDER BY seq) AS BIGINT) AS used FROM size_) SELECT fleet, seq, used, CASE WHEN used * 10 >= 4500000 THEN 'READ_ONLY' WHEN used * 10 >= 4000000 THEN 'WARNING' ELSE 'RUNNING' END AS phase FROM r")
def capacity(spark, d):
    used = Dealt(journal(spark, d), ["fleet"], ["seq"]).prefixes({"used": ("sum", F.octet_length(L.text_of(*L.MEMBERS)).cast("bigint"))}, inclusive=True)
    return used.select("fleet", "seq", "used", L.capacity(F.col("used"), 500_000).alias("phase"))


@query("S11_bundle_export", f"{Q} SELECT fleet, seq, kind FROM jrn WHERE (fleet = 0 AND seq <= 150) OR (fleet = 1 AND seq <= 90)")
def bundle_export(spark, d):
    """Bundles under the checkpoints of fleets 0 and 1; fleet 2's pin has a hash that its journal lacks."""
    j = journal(spark, d)
    pins = j.where("(fleet = 0 and seq = 150) or (fleet = 1 and seq = 90) or (fleet = 2 and seq = 70)").select("fleet", "seq", F.when(F.col("fleet") == 2, F.sha2("hash", 256)).otherwise(F.col("hash")).alias("hash"))
    return L.exported(j, pins).select("fleet", "seq", "kind")


@query("S08_journal_store", f"{Q} SELECT fleet, kind, count(*) AS n, max(seq) AS last_seq FROM jrn GROUP BY ALL")
def journal_store(spark, d):
    """The journal stored in two appends, the second continuing the first's heads, and scanned."""
    results, path = positioned(spark, d), shared(spark, "store")
    every = written(events(spark, d, results), "events")
    cut = BASE + 12 * DAY
    append(L.appended(every.where(F.col("at_ms") < cut)), path, ["fleet"])
    head = L.checkpoints(scan(spark, path))
    append(L.appended(every.where(F.col("at_ms") >= cut), head), path, ["fleet"])
    stored = scan(spark, path)
    broken = L.unchained(stored.withColumn("fleet", F.col("fleet").cast("bigint")))
    whole = stored.withColumn("fleet", F.col("fleet").cast("bigint")).join(broken.select("fleet").distinct(), "fleet", "left_anti")  # nothing is left of a broken chain
    return whole.groupBy("fleet", "kind").agg(F.count("*").alias("n"), F.max("seq").alias("last_seq"))


@query("T19_watch_pass", f"{Q} SELECT fleet, seq, key AS result, 2 AS watcher, CASE WHEN EXISTS (SELECT 1 FROM hits h WHERE h.fleet = jrn.fleet AND h.hash = jrn.key AND h.n % 6 <> 4) THEN 'VOTE' ELSE 'REFUSE' END AS action FROM jrn WHERE kind = 'AlertCreated' AND seq > fleet * 200")
def watch_pass(spark, d):
    """A watcher that recomputes some results otherwise refuses them."""
    results = positioned(spark, d)
    mine = expected(results.where("n % 6 <> 4"))
    cursors = spark.range(3).select(F.col("id").alias("fleet"), (F.col("id") * 200).alias("seq"))
    return L.watched(journal(spark, d), cursors, mine, 2)


@query("S09_replay_store", f"{Q} SELECT fleet, kind, count(DISTINCT key) AS keys FROM jrn WHERE kind IN ('SourceAccepted', 'WindowFinalized', 'AlertCreated') GROUP BY ALL")
def replay_store(spark, d):
    """What a watcher keeps of a journal: accepted records, manifests and alerts, by kind."""
    path = shared(spark, "watcher")
    append(journal(spark, d).where("kind in ('SourceAccepted', 'WindowFinalized', 'AlertCreated')"), path, ["kind"])
    return scan(spark, path).groupBy("fleet", "kind").agg(F.countDistinct("key").alias("keys"))


@query("A10_metrics", f"""{Q}, c AS (SELECT fleet, count(*) FILTER (kind = 'SourceAccepted') AS accepted, count(*) FILTER (kind = 'SourceAccepted' AND s1 = 'true') AS late, count(*) FILTER (kind = 'SourceForkObserved') AS forks,
  count(*) FILTER (kind = 'AlertCreated') AS hits, count(*) FILTER (kind = 'DeliveryChanged' AND s2 = 'IN_FLIGHT') AS attempts, count(*) FILTER (kind = 'DeliveryChanged' AND s2 = 'FAILED') AS failed, sum(bytes) AS bytes,
  count(DISTINCT CASE n1 WHEN 1 THEN 'd1' WHEN 2 THEN 'd2' WHEN 3 THEN 'd2' END) FILTER (kind = 'VoteAccepted') AS domains, max(at_ms) - max(n1) FILTER (kind = 'Tick') AS lag FROM size_ GROUP BY fleet), u AS (SELECT fleet, count(*) FILTER (status = 'UNKNOWN') AS unknowns FROM pos GROUP BY fleet), x AS (SELECT fleet, count(*) FILTER (verdict = 'REPEATED') AS repeated FROM used GROUP BY fleet)
  SELECT fleet, unnest(['inputs_accepted_total', 'inputs_duplicate_total', 'inputs_late_total', 'source_forks_total', 'detector_hit_total', 'detector_unknown_total', 'vote_rejected_total', 'page_attempt_total', 'page_failed_total', 'audit_bytes', 'active_domains', 'logical_lag_ms']) AS name,
  unnest([accepted, repeated, late, forks, hits, unknowns, (SELECT count(*) FROM jrn v WHERE v.kind = 'VoteAccepted' AND v.fleet = c.fleet AND v.n1 NOT IN (1, 2, 3)), attempts, failed, bytes::BIGINT, domains, lag]) AS value
  FROM c JOIN u USING (fleet) JOIN x USING (fleet)""")
def metrics(spark, d):
    """Twelve samples a fleet: nine counters, bytes, domains and lag."""
    results = positioned(spark, d)
    j, kind = journal(spark, d), F.col("kind")
    domain = F.create_map(*(F.lit(x) for w, _, of in WATCHERS for x in (w, of)))[F.col("n1").cast("int")]
    delivery = lambda s: F.count_if((kind == "DeliveryChanged") & (F.col("s2") == s))
    c = j.groupBy("fleet").agg(
        F.count_if(kind == "SourceAccepted").alias("inputs_accepted_total"), F.count_if((kind == "SourceAccepted") & (F.col("s1") == "true")).alias("inputs_late_total"), F.count_if(kind == "SourceForkObserved").alias("source_forks_total"),
        F.count_if(kind == "AlertCreated").alias("detector_hit_total"), F.count_if((kind == "VoteAccepted") & domain.isNull()).alias("vote_rejected_total"), delivery("IN_FLIGHT").alias("page_attempt_total"), delivery("FAILED").alias("page_failed_total"),
        F.sum(F.octet_length(L.text_of(*L.MEMBERS)).cast("bigint")).alias("audit_bytes"), F.countDistinct(F.when(kind == "VoteAccepted", domain)).alias("active_domains"),
        (F.max("at_ms") - F.max(F.when(kind == "Tick", F.col("n1")))).alias("logical_lag_ms"),
    )
    u = results.groupBy("fleet").agg(F.count_if(F.expr("status = 'UNKNOWN'")).alias("detector_unknown_total"))
    x = V.usage(V.before_end(R.Run(spark, d).placed)).groupBy("fleet").agg(F.count_if(F.expr("verdict = 'REPEATED'")).alias("inputs_duplicate_total"))
    wide = c.join(u, "fleet").join(x, "fleet")
    return wide.unpivot("fleet", [n for n in wide.columns if n != "fleet"], "name", "value")


@query("J11_unreferenced", f"{Q} SELECT fleet, hash FROM hits WHERE n % 3 = 0 EXCEPT SELECT fleet, key FROM jrn WHERE kind = 'AlertDegraded'")
def unreferenced(spark, d):
    """Page objects kept for each hit that no journal row about a page or a degradation refers to."""
    results = positioned(spark, d)
    told = journal(spark, d).where("kind in ('DeliveryChanged', 'AlertDegraded')").select("fleet", F.col("key").alias("hash"))
    return results.where("status = 'HIT'").select("fleet", "hash").join(told, ["fleet", "hash"], "left_anti").distinct()


SUBS = Params(subscription_ms=SIX)


@query("T13_subscriptions", f"""WITH RECURSIVE r AS MATERIALIZED (SELECT user_id % 40 AS subscription, event_id AS seq, epoch_us(ts) // 1000 AS at_ms, event_id // 40 AS q, event_id AS i,
    CASE WHEN event_id % 97 = 13 THEN 'CLOSE' WHEN event_id % 19 = 3 THEN 'PAUSE' WHEN event_id % 19 = 7 THEN 'RESUME' WHEN event_id % 11 = 2 THEN 'OPEN' WHEN event_id % 3 = 0 THEN 'ACK' ELSE 'READ' END AS verb, row_number() OVER (PARTITION BY user_id % 40 ORDER BY ts, event_id) AS nth FROM events),
v AS MATERIALIZED (SELECT *, CASE verb WHEN 'OPEN' THEN q WHEN 'READ' THEN q - i % 7 WHEN 'ACK' THEN q - i % 5 ELSE i % 4 + 1 END AS n1, q - i % 7 + 8 AS n2 FROM r),
s AS (SELECT DISTINCT subscription, 0::BIGINT AS nth, 0::BIGINT AS seq, '' AS what, 'NONE' AS state, 0::BIGINT AS ack, 0::BIGINT AS delivered, 0::BIGINT AS lease, 0::BIGINT AS revision FROM r
  UNION ALL SELECT subscription, nth, seq, coalesce(f, verb), CASE WHEN f IS NULL THEN CASE verb WHEN 'OPEN' THEN 'ACTIVE' WHEN 'PAUSE' THEN 'PAUSED' WHEN 'RESUME' THEN 'ACTIVE' WHEN 'CLOSE' THEN 'CLOSED' ELSE state END ELSE state END,
    CASE WHEN f IS NULL AND verb IN ('OPEN', 'ACK') THEN n1 ELSE ack END, CASE WHEN f IS NULL AND verb = 'OPEN' THEN n1 WHEN f IS NULL AND verb = 'READ' THEN n2 ELSE delivered END, CASE WHEN f IS NULL AND verb <> 'CLOSE' THEN at_ms + {SIX} ELSE lease END,
    CASE WHEN f IS NOT NULL OR verb = 'READ' OR (verb = 'ACK' AND n1 = ack) THEN revision WHEN verb = 'OPEN' THEN 1 ELSE revision + 1 END
  FROM (SELECT *, CASE WHEN verb = 'OPEN' THEN CASE WHEN state IN ('ACTIVE', 'PAUSED') THEN 'STATE_CONFLICT' END WHEN state = 'NONE' THEN 'NOT_FOUND' WHEN verb IN ('READ', 'ACK') THEN CASE WHEN state <> 'ACTIVE' THEN 'STATE_CONFLICT' WHEN n1 < ack OR n1 > delivered THEN 'CURSOR_INVALID' END
      WHEN n1 <> revision THEN 'REVISION_CONFLICT' WHEN NOT ((verb = 'PAUSE' AND state = 'ACTIVE') OR (verb = 'RESUME' AND state = 'PAUSED') OR (verb = 'CLOSE' AND state IN ('ACTIVE', 'PAUSED'))) THEN 'STATE_CONFLICT' END AS f
    FROM (SELECT v.*, s.ack, s.delivered, s.lease, CASE WHEN s.state IN ('ACTIVE', 'PAUSED') AND s.lease <= v.at_ms THEN 'EXPIRED' ELSE s.state END AS state, s.revision + (s.state IN ('ACTIVE', 'PAUSED') AND s.lease <= v.at_ms)::INT AS revision
      FROM s JOIN v ON v.subscription = s.subscription AND v.nth = s.nth + 1)))
SELECT subscription, seq, what, state, ack, delivered, revision FROM s WHERE nth > 0""")
def subscriptions(spark, d):
    """Requests about subscriptions, each with what it met: refusals, cursors, revisions, and leases that ended before."""
    i = F.col("event_id")
    q, verb = F.expr("event_id div 40"), F.when(i % 97 == 13, "CLOSE").when(i % 19 == 3, "PAUSE").when(i % 19 == 7, "RESUME").when(i % 11 == 2, "OPEN").when(i % 3 == 0, "ACK").otherwise("READ")
    n1 = F.when(verb == "OPEN", q).when(verb == "READ", q - i % 7).when(verb == "ACK", q - i % 5).otherwise(i % 4 + 1)
    rows = T.table(spark, d, "events").select((F.col("user_id") % 40).alias("key"), i.alias("seq"), T.millis("ts").alias("at_ms"), verb.alias("verb"), n1.alias("n1"), (q - i % 7 + 8).alias("n2"))
    told = clocked.lived(rows, clocked.Subscription, p=SUBS).where("seq is not null")
    return told.select(F.col("key").cast("bigint").alias("subscription"), "seq", "what", "state", F.col("n1").alias("ack"), F.col("n2").alias("delivered"), "revision")


@query("T12_leases")
def leases(spark, d):
    """Pages of the alerts that are corroborated: when each is sent, under which lease, and what comes of it; some answers never come."""
    hits = positioned(spark, d).where("status = 'HIT' and n % 3 <> 0")
    n, at = F.col("n"), F.col("end_ms") + 20_002
    event = lambda verb, seq, when, n1=None, n2=None, df=hits: df.select(F.col("hash").alias("key"), when.alias("at_ms"), F.lit(seq).alias("seq"), F.lit(verb).alias("verb"), (F.lit(None) if n1 is None else F.lit(n1)).cast("long").alias("n1"), (F.lit(None) if n2 is None else n2).cast("long").alias("n2"))
    parts = [event("QUEUE", 0, at)]
    for k in range(1, 9):  # answers to attempts as far as they are sent at the least delays
        answered = hits.where(F.expr(f"n % 11 <> 4 and n div {k} % 4 = 1"))
        parts.append(event("DONE", k, at + 1000 * (2**k - 1) - 900, k, F.when(n % 5 == k % 5, 204).when(n % 7 == k % 7, 429).otherwise(503), answered))
    parts.append(event("CANCEL", 20, at + 40_000, df=hits.where("n % 13 = 6")))
    return clocked.lived(reduce(DataFrame.unionByName, parts), clocked.Page, until_ms=BASE + 60 * DAY)


@query("T09_alert_lives", f"""{Q}, c AS (SELECT fleet, hash, end_ms + 180000 AS expires_ms, n, CASE WHEN n % 3 <> 0 AND n % 7 <> 1 THEN end_ms + 20001 END AS corroborated_ms, CASE WHEN n % 4 = 1 THEN end_ms + 90000 + n % 200000 END AS closed_ms FROM hits),
  d AS (SELECT *, CASE WHEN corroborated_ms IS NULL AND (closed_ms IS NULL OR closed_ms >= expires_ms) THEN 'EXPIRED' WHEN closed_ms IS NOT NULL THEN 'CLOSED' WHEN corroborated_ms IS NOT NULL THEN 'CORROBORATED' END AS state FROM c)
  SELECT fleet || '/' || hash AS key, state, CASE WHEN state = 'CLOSED' THEN 2 + (corroborated_ms IS NOT NULL)::INT ELSE 2 END::BIGINT AS revision, (state = 'EXPIRED' AND closed_ms IS NOT NULL)::BIGINT AS refused FROM d""")
def alert_lives(spark, d):
    """Alerts that are corroborated, closed, or expire by time alone, as they stand long after."""
    hits = positioned(spark, d).where("status = 'HIT'").withColumn("key", F.concat_ws("/", "fleet", "hash"))
    n, end = F.col("n"), F.col("end_ms")
    event = lambda df, verb, seq, at, n1=F.lit(None): df.select("key", at.alias("at_ms"), F.lit(seq).alias("seq"), F.lit(verb).alias("verb"), n1.cast("long").alias("n1"), F.lit(None).cast("long").alias("n2"))
    rows = event(hits, "CREATE", 0, end, end + P.vote_ttl_ms).unionByName(event(hits.where("n % 3 <> 0 and n % 7 <> 1"), "CORROBORATE", 1, end + 20_001)).unionByName(event(hits.where("n % 4 = 1"), "CLOSE", 2, end + 90_000 + n % 200_000))
    return clocked.latest(clocked.lived(rows, clocked.Alert, until_ms=BASE + 60 * DAY, p=P))


@query("X23_heads", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 50 END AS seq, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 50 = 25 THEN CASE WHEN event_id % 4 = 0 THEN 'SAME' ELSE 'CONFLICT' END WHEN event_id % 50 > 25 THEN 'DESCENDS' ELSE 'BEHIND' END AS relation FROM events""")
def heads(spark, d):
    i = F.col("event_id")
    h = F.when(i % 4 == 0, F.lit("a" * 64)).otherwise(F.lit("b" * 64))
    text = F.concat(F.when(i % 5 == 0, "0").otherwise(""), (i % 50).cast("string"), F.lit(":"), h, F.when(i % 5 == 0, "f").otherwise(""))
    rows = T.table(spark, d, "events").select("event_id", L.parsed_head(text).alias("h"))
    return rows.select("event_id", "h.seq", L.head_order(F.col("h.seq"), F.col("h.hash"), F.lit(25), F.lit("a" * 64)).alias("relation")).withColumn("relation", F.when(F.col("seq").isNotNull(), F.col("relation")))


@query("F17_replay_checks", f"""{R.W}, {R.HASHES}, i AS (SELECT fleet, epoch, start_ms, row_number() OVER (PARTITION BY fleet, epoch, start_ms ORDER BY idx) AS position, idx, received_ms, hash FROM acc),
t AS (SELECT fleet, epoch, start_ms, position, CASE WHEN idx % 1009 = 3 THEN idx - 5000 ELSE idx END AS idx, CASE WHEN idx % 907 = 5 THEN received_ms + {SIX} ELSE received_ms END AS received_ms, CASE WHEN idx % 811 = 7 THEN sha256(hash) ELSE hash END AS hash, hash AS listed FROM i WHERE idx % 1201 <> 9),
m AS (SELECT g.*, g.start_ms + {SIX} AS end_ms, coalesce(n, 0) AS n_inputs, mx AS through FROM grid g LEFT JOIN (SELECT fleet, epoch, start_ms, count(*) AS n, max(idx) AS mx FROM i GROUP BY ALL) USING (fleet, epoch, start_ms)),
o AS (SELECT *, lag(idx) OVER (PARTITION BY fleet, epoch, start_ms ORDER BY position) AS before FROM t),
p AS (SELECT o.fleet, o.epoch, o.start_ms, count(*) AS n, bool_or(hash <> listed) AS other, coalesce(bool_or(idx <= before), false) AS disorder, bool_or(received_ms < o.start_ms OR received_ms >= end_ms) AS outside, bool_or(idx > through) AS beyond FROM o JOIN m USING (fleet, epoch, start_ms) GROUP BY ALL),
hh AS (SELECT g.fleet, g.epoch, g.start_ms, count(*) AS k, bool_or(p.start_ms // {SIX} % 83 = 11) AS foreign_, bool_or((p.start_ms // {SIX} + g.start_ms // {SIX}) % 71 = 4) AS renamed FROM grid g JOIN grid p ON p.fleet = g.fleet AND p.epoch = g.epoch AND p.start_ms < g.start_ms AND p.start_ms >= g.start_ms - {5 * SIX} GROUP BY ALL),
cw AS (SELECT *, (start_ms // {SIX} + source * 7) AS z FROM cut WHERE last_input IS NOT NULL),
ww AS (SELECT fleet, epoch, start_ms, bool_or(z % 97 = 3) AS gone, bool_or(z % 79 = 11) AS renamed_w, bool_or(z % 89 = 5) AS late_w, bool_or(z % 61 = 7) AS signal_w FROM cw GROUP BY ALL)
 SELECT fleet, epoch, start_ms, CASE WHEN coalesce(n, 0) <> n_inputs THEN 'LENGTH' WHEN other THEN 'INPUT_HASH' WHEN disorder THEN 'INDEX_ORDER' WHEN outside THEN 'OUTSIDE_WINDOW' WHEN beyond THEN 'BEYOND_THROUGH' WHEN renamed THEN 'HISTORY_HASH' WHEN foreign_ THEN 'HISTORY_EPOCH'
    WHEN gone THEN 'WITNESS_LENGTH' WHEN renamed_w THEN 'WITNESS_HASH' WHEN late_w THEN 'WITNESS_TIME' WHEN signal_w THEN 'WITNESS_SIGNAL' END AS fault FROM m LEFT JOIN p USING (fleet, epoch, start_ms) LEFT JOIN hh USING (fleet, epoch, start_ms) LEFT JOIN ww USING (fleet, epoch, start_ms)""")
def replay_checks(spark, d):
    """Stored slices of which some inputs, prior manifests' digests and witnesses were dropped or altered."""
    run = R.Run(spark, d, keep=True)
    w = Window.partitionBy(*V.WINDOW).orderBy("idx")
    rows = run.rows.select(*V.WINDOW, F.row_number().over(w).alias("position"), "idx", "received_ms", "hash")
    per = rows.groupBy(*V.WINDOW).agg(F.count("*").alias("n_inputs"), F.max("idx").alias("through"))
    made = run.windows.join(per, V.WINDOW, "left").withColumn("n_inputs", F.coalesce("n_inputs", F.lit(0)))
    i = F.col("idx")
    stored = rows.where("idx % 1201 <> 9").select(
        *V.WINDOW, "position", F.when(i % 1009 == 3, i - 5000).otherwise(i).alias("idx"), F.when(i % 907 == 5, F.col("received_ms") + SIX).otherwise(F.col("received_ms")).alias("received_ms"),
        F.when(i % 811 == 7, F.sha2("hash", 256)).otherwise(F.col("hash")).alias("hash"), F.col("hash").alias("listed"),
    )
    manifests = written(run.manifests.select(*V.WINDOW, "hash", "history"), "manifests")
    made = made.join(manifests.select(*V.WINDOW, F.size("history").cast("bigint").alias("n_history")), V.WINDOW)
    # each manifest names the windows right before it, the latest last
    named = manifests.select(*V.WINDOW, F.posexplode("history").alias("position", "listed"), F.size("history").alias("size")).withColumn("prior_start_ms", F.col("start_ms") - (F.col("size") - F.col("position")) * F.lit(SIX))
    prior = manifests.select("fleet", "epoch", F.col("start_ms").alias("prior_start_ms"), F.col("hash").alias("prior_hash"))
    turn, turn_of_prior = F.expr(f"start_ms div {SIX}"), F.expr(f"prior_start_ms div {SIX}")
    past = named.join(prior, ["fleet", "epoch", "prior_start_ms"]).select(
        *V.WINDOW, "position", "prior_start_ms", (F.col("prior_start_ms") + SIX).alias("prior_end_ms"), F.when(turn_of_prior % 83 == 11, F.col("epoch") - 1).otherwise(F.col("epoch")).alias("prior_epoch"),
        F.when((turn_of_prior + turn) % 71 == 4, F.sha2("prior_hash", 256)).otherwise(F.col("prior_hash")).alias("prior_hash"), "listed",
    )
    z = turn + F.col("source") * 7
    seen = run.cuts.where("last_input is not null").join(run.rows.select("fleet", F.col("hash").alias("last_input"), "received_ms", "kind"), ["fleet", "last_input"]).where(z % 97 != 3)
    witnesses = seen.select(
        *V.WINDOW, "source", F.when(z % 79 == 11, F.sha2("last_input", 256)).otherwise(F.col("last_input")).alias("hash"), F.when(z % 89 == 5, F.col("received_ms") + 1).otherwise(F.col("received_ms")).alias("received_ms"), F.when(z % 61 == 7, "signal").otherwise(F.col("kind")).alias("kind"),
    )
    return L.replay_faults(made, stored, past, run.cuts, witnesses)
