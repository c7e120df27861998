"""Configurations from the orders: a customer is a fleet, its orders are the configurations in turn, their lines the sources.

Fixed values: moduli by which rows break a rule, on both sides.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vigil.operators import configs as C
from vigil.operators import journal as J
from vigil.operators import scans

from . import tables as T
from .registry import query

MINUTE = 60_000
CFG = f"""cfg AS MATERIALIZED (SELECT *, CASE WHEN o_orderkey % 17 = 3 THEN sha256(before) ELSE before END AS predecessor, scheduled_ms - scheduled_ms % {MINUTE} + {MINUTE} + CASE WHEN o_orderkey % 19 = 4 THEN 1000 WHEN o_orderkey % 29 = 6 THEN 864000000 ELSE 0 END AS effective_ms
  FROM (SELECT *, row_number() OVER w + (o_orderkey % 41 = 8)::INT AS epoch, row_number() OVER w AS nth, coalesce(lag(hash) OVER w, repeat('0', 64)) AS before
    FROM (SELECT o_custkey AS fleet, o_orderkey, sha256('config/' || o_orderkey) AS hash, CASE WHEN o_orderkey % 23 = 5 THEN 'pack-2' ELSE 'pack-1' END AS pack, epoch_ms(o_orderdate::TIMESTAMP) + o_orderkey % 1440 * 60000 + o_orderkey % 60 * 1000 AS scheduled_ms,
      [('k' || (o_custkey + o_orderkey + x) % 9) for x in range(o_orderkey % 3)] AS revoked FROM orders) WINDOW w AS (PARTITION BY fleet ORDER BY scheduled_ms, o_orderkey))),
src AS MATERIALIZED (SELECT c.fleet, c.nth AS epoch, l_linenumber AS source, (c.fleet + l_linenumber) % 5 + (l_partkey % 29 = 0)::INT AS principal, 'k' || (c.fleet + l_linenumber) % 9 AS key_id, 'p' || (l_linenumber % 2 + (l_suppkey % 31 = 2)::INT) AS profile, l_linenumber % 3 = 0 AS meter,
    [l_linenumber, l_linenumber + 1 + (l_partkey % 37 = 1)::INT] AS subjects, l_returnflag <> 'R' AS enabled, c.scheduled_ms FROM lineitem JOIN cfg c ON c.o_orderkey = l_orderkey)"""
W = f"WITH {CFG}"


def configs(spark, d):
    """Epochs count a customer's orders in time; some are misnumbered, name another predecessor or pack, or begin too late."""
    o, i = T.table(spark, d, "orders"), F.col("o_orderkey")
    when = T.millis("o_orderdate") + i % 1440 * 60_000 + i % 60 * 1000
    keys = F.transform(F.filter(F.sequence(F.lit(0), F.lit(2)), lambda x: x < i % 3), lambda x: F.concat(F.lit("k"), (F.col("o_custkey") + i + x) % 9))
    rows = o.select(F.col("o_custkey").alias("fleet"), "o_orderkey", F.sha2(F.concat(F.lit("config/"), i), 256).alias("hash"), F.when(i % 23 == 5, "pack-2").otherwise("pack-1").alias("pack"), when.alias("scheduled_ms"), keys.alias("revoked"))
    w = Window.partitionBy("fleet").orderBy("scheduled_ms", "o_orderkey")
    rows = rows.withColumn("nth", F.row_number().over(w).cast("bigint")).withColumn("before", F.lag("hash", 1, C.ZERO).over(w))
    late = F.when(i % 19 == 4, 1000).when(i % 29 == 6, 864_000_000).otherwise(0)
    return rows.withColumn("epoch", F.col("nth") + (i % 41 == 8).cast("int")).withColumn("predecessor", F.when(i % 17 == 3, F.sha2("before", 256)).otherwise(F.col("before"))).withColumn("effective_ms", F.col("scheduled_ms") - F.col("scheduled_ms") % MINUTE + MINUTE + late)


def sources(spark, d):
    """Sources by configuration in turn; in some lines a bound field differs from what it is elsewhere."""
    n, fleet = F.col("l_linenumber").cast("bigint"), F.col("fleet")
    lines = T.table(spark, d, "lineitem").join(configs(spark, d).select(F.col("o_orderkey").alias("l_orderkey"), "fleet", F.col("nth").alias("epoch"), "scheduled_ms").hint("merge"), "l_orderkey")
    return lines.select(
        "fleet", "epoch", n.alias("source"), ((fleet + n) % 5 + (F.col("l_partkey") % 29 == 0).cast("int")).alias("principal"), F.concat(F.lit("k"), (fleet + n) % 9).alias("key_id"), F.lit("pub").alias("public_key"),
        F.concat(F.lit("p"), n % 2 + (F.col("l_suppkey") % 31 == 2).cast("int")).alias("profile"), (n % 3 == 0).alias("meter"), F.array(n, n + 1 + (F.col("l_partkey") % 37 == 1).cast("int")).alias("subjects"), (F.col("l_returnflag") != "R").alias("enabled"), "scheduled_ms",
    )


@query("F14_config_schedule", f"""{W}, b AS (SELECT *, lag(epoch) OVER w AS e, lag(hash) OVER w AS h, lag(effective_ms) OVER w AS t FROM cfg WINDOW w AS (PARTITION BY fleet ORDER BY scheduled_ms, epoch))
SELECT fleet, epoch, hash, CASE WHEN pack <> 'pack-1' THEN 'PACK_UNAVAILABLE' WHEN e IS NULL AND (epoch <> 1 OR predecessor <> repeat('0', 64)) THEN 'CHAIN_INVALID' WHEN e IS NOT NULL AND (epoch <> e + 1 OR predecessor <> h) THEN 'CHAIN_INVALID' WHEN t > scheduled_ms THEN 'STATE_CONFLICT'
  WHEN effective_ms <> (scheduled_ms // {MINUTE} + 1) * {MINUTE} THEN 'INVALID_INPUT' END AS fault FROM b""")
def config_schedule(spark, d):
    return C.schedule_faults(configs(spark, d), "pack-1").select("fleet", "epoch", "hash", "fault")


@query("F13_successor_config", f"""{W}, pr AS (SELECT DISTINCT fleet, nth AS epoch, p AS principal, CASE WHEN o_orderkey % 13 = 2 AND p = 1 THEN 'other' ELSE 'k' || p END AS key FROM cfg, range(6) t(p) WHERE NOT (o_orderkey % 31 = 9 AND p = 2)),
sj AS (SELECT DISTINCT fleet, nth AS epoch, x AS subject FROM cfg, range(1, 9) t(x) WHERE x <> o_orderkey % 40), wa AS (SELECT DISTINCT fleet, nth AS epoch, x AS watcher, x % 3 AS principal FROM cfg, range(3) t(x)),
kept AS (SELECT a.*, b.principal AS b_principal, b.profile AS b_profile, b.subjects AS b_subjects FROM src a JOIN src b ON b.fleet = a.fleet AND b.source = a.source AND b.epoch = a.epoch - 1),
changed AS (SELECT DISTINCT a.fleet, a.epoch + 1 AS epoch, a.principal FROM pr a LEFT JOIN pr b ON b.fleet = a.fleet AND b.epoch = a.epoch + 1 AND b.principal = a.principal WHERE b.key IS DISTINCT FROM a.key)
SELECT DISTINCT fleet, epoch, id, fault FROM (
  SELECT fleet, epoch, source AS id, 'BOUND_FIELDS' AS fault FROM kept WHERE principal <> b_principal OR profile <> b_profile OR subjects <> b_subjects
  UNION ALL SELECT k.fleet, k.epoch, source, 'PRINCIPAL_KEY' FROM kept k JOIN changed USING (fleet, epoch, principal)
  UNION ALL SELECT fleet, epoch, source, 'SUBJECT_REMOVED' FROM src s WHERE epoch > 1 AND EXISTS (SELECT 1 FROM src b WHERE b.fleet = s.fleet AND b.epoch = s.epoch - 1) AND (NOT EXISTS (SELECT 1 FROM sj WHERE sj.fleet = s.fleet AND sj.epoch = s.epoch AND sj.subject = s.subjects[1]) OR NOT EXISTS (SELECT 1 FROM sj WHERE sj.fleet = s.fleet AND sj.epoch = s.epoch AND sj.subject = s.subjects[2]))
  UNION ALL SELECT w.fleet, w.epoch, watcher, 'WATCHER_KEY' FROM wa w JOIN changed USING (fleet, epoch, principal) WHERE epoch > 1)""")
def successor_config(spark, d):
    """What configurations change that they may not: bound fields, principals' keys, subjects, watchers' keys."""
    c = configs(spark, d).select("fleet", F.col("nth").alias("epoch"), "o_orderkey")
    i = F.col("o_orderkey")
    each = lambda lo, hi, name: c.withColumn(name, F.explode(F.sequence(F.lit(lo).cast("bigint"), F.lit(hi).cast("bigint"))))
    p = F.col("principal")
    principals = each(0, 5, "principal").where(~((i % 31 == 9) & (p == 2))).select("fleet", "epoch", "principal", F.when((i % 13 == 2) & (p == 1), "other").otherwise(F.concat(F.lit("k"), p)).alias("key_id"), F.lit("pub").alias("public_key"))
    subjects = each(1, 8, "subject").where(F.col("subject") != i % 40).select("fleet", "epoch", "subject")
    watchers = each(0, 2, "watcher").select("fleet", "epoch", "watcher", (F.col("watcher") % 3).alias("principal"))
    return C.successor_faults(sources(spark, d), principals, subjects, watchers)


@query("U02_revocation_union", f"{W} SELECT fleet, key_id, min(epoch) AS epoch, min(scheduled_ms) AS since_ms FROM (SELECT fleet, nth AS epoch, scheduled_ms, unnest(revoked) AS key_id FROM cfg) GROUP BY ALL")
def revocation_union(spark, d):
    return C.revoked(configs(spark, d).drop("epoch").withColumnRenamed("nth", "epoch"))


@query("U03_new_keys", f"{W}, k AS (SELECT fleet, nth AS epoch, unnest(revoked) AS key_id FROM cfg) SELECT DISTINCT fleet, epoch, key_id FROM k WHERE NOT EXISTS (SELECT 1 FROM k b WHERE b.fleet = k.fleet AND b.key_id = k.key_id AND b.epoch < k.epoch)")
def new_keys(spark, d):
    return C.newly_revoked(configs(spark, d).drop("epoch").withColumnRenamed("nth", "epoch"))


@query("J09_revoked_sources", f"{W}, k AS (SELECT fleet, unnest(revoked) AS key_id, scheduled_ms AS since_ms FROM cfg) SELECT fleet, epoch, source, EXISTS (SELECT 1 FROM k WHERE k.fleet = s.fleet AND k.key_id = s.key_id AND k.since_ms <= s.scheduled_ms) AS revoked FROM src s")
def revoked_sources(spark, d):
    """Sources of each configuration whose key is revoked by the time at which it is scheduled."""
    keys = C.revoked(configs(spark, d).drop("epoch").withColumnRenamed("nth", "epoch"))
    return C.revoked_sources(sources(spark, d), keys, "scheduled_ms").select("fleet", "epoch", "source", "revoked")


@query("F04_enabled_meters", f"{W} SELECT fleet, epoch, count(*) FILTER (enabled) AS sources, count(*) FILTER (enabled AND meter) AS meters FROM src GROUP BY ALL")
def enabled_meters(spark, d):
    return C.roles(sources(spark, d))


@query("J05_subject_sources", f"{W}, x AS (SELECT DISTINCT fleet, epoch, source, unnest(subjects) AS subject FROM src WHERE enabled) SELECT fleet, epoch, subject, count(*) AS n_sources, min(source) AS first_source FROM x GROUP BY ALL")
def subject_sources(spark, d):
    return C.reporting(sources(spark, d))


@query("L04_latest", f"{W} SELECT fleet, nth AS epoch, hash, effective_ms FROM cfg QUALIFY row_number() OVER (PARTITION BY fleet ORDER BY nth DESC) = 1")
def latest(spark, d):
    return C.latest(configs(spark, d).select("fleet", F.col("nth").alias("epoch"), "hash", "effective_ms"))


@query("L05_sorted_unique", "SELECT user_id, list_sort(list_distinct(list(event_type || value::INT ORDER BY event_id))) = list(event_type || value::INT ORDER BY event_id) AS ascending FROM events GROUP BY user_id")
def sorted_unique(spark, d):
    rows = T.table(spark, d, "events").select("user_id", "event_id", F.concat("event_type", F.round("value").cast("int")).alias("item"))
    return scans.ascending(rows, ["user_id"], ["event_id"], "item")


@query("U04_insert_or_ignore", "WITH o AS (SELECT lang AS kind, CAST(doc_id % 97 AS VARCHAR) AS hash, doc_id % 194 AS value, doc_id AS seq FROM documents) SELECT kind, hash, value, seq FROM o QUALIFY row_number() OVER (PARTITION BY kind, hash ORDER BY seq % 3 <> 0, seq) = 1")
def insert_or_ignore(spark, d):
    """Objects that arrive among those that are there already (every third): what is there stays, and of equal arrivals the first comes in."""
    o = T.table(spark, d, "documents").select(F.col("lang").alias("kind"), (F.col("doc_id") % 97).cast("string").alias("hash"), (F.col("doc_id") % 194).alias("value"), F.col("doc_id").alias("seq"))
    return J.inserted(J.inserted(o.where(F.lit(False)), o.where("seq % 3 = 0")), o.where("seq % 3 <> 0"))
