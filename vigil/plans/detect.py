"""Kernels over the events table, one record at a time."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions import kernels as K
from vigil.functions.canon import digest

from . import tables as T
from .registry import query

U = 9223372036854775807

SUBJ = """subj AS (SELECT subject, subject % 3 + 5 AS mp, subject * 4 + 30 AS mt FROM range(14) t(subject))"""
SCOPE = """sd AS (SELECT idx,
  CASE WHEN reported THEN 'DRIFT_REPORTED' WHEN policy IS NOT NULL AND (policy + subject) % 4 = 0 THEN 'POLICY_DRIFT' WHEN scope IS NOT NULL AND (scope + subject) % 5 = 1 THEN 'SCOPE_DRIFT'
    WHEN policy IS NOT NULL OR scope IS NOT NULL THEN 'SCOPE_MATCH' ELSE 'EVIDENCE_MISSING' END AS reason FROM base JOIN subj USING (subject) WHERE kind = 'scope')"""
REPL = """rd AS (SELECT idx,
  CASE WHEN processes > mp THEN 'PROCESS_EXCESS' WHEN threads > mt THEN 'THREAD_EXCESS' WHEN declared <> processes THEN 'DECLARED_MISMATCH'
    WHEN coalesce(processes, threads) IS NULL OR (declared IS NOT NULL AND processes IS NULL) THEN 'EVIDENCE_MISSING' ELSE 'INVENTORY_MATCH' END AS reason FROM base JOIN subj USING (subject) WHERE kind = 'replication')"""


@query("P01_project", f"WITH {T.OBS} SELECT idx, received_ms, observed_ms, source, subject, kind, delta, usage_id, policy, scope, reported, processes, threads, declared FROM base")
def project(spark, d):
    return T.base(spark, d).drop("k", "late")


@query("F05_late_flag", f"WITH {T.OBS} SELECT source, kind, count(*) AS n, count(*) FILTER (late) AS n_late FROM base GROUP BY ALL")
def late_flag(spark, d):
    return T.base(spark, d).groupBy("source", "kind").agg(F.count("*").alias("n"), F.count_if("late").alias("n_late"))


@query("A01_checked_sum", f"""WITH {T.OBS}, x AS (SELECT source, sum(CAST(delta AS HUGEINT) * CASE WHEN source = 3 THEN 9223372036854 ELSE 1 END) AS s FROM base GROUP BY source)
SELECT source, CASE WHEN s <= {U} THEN CAST(s AS BIGINT) END AS total FROM x""")
def checked_sum(spark, d):
    scaled = K.wide(F.col("delta")) * F.when(F.col("source") == 3, K.wide(9223372036854)).otherwise(K.wide(1))
    return T.base(spark, d).groupBy("source").agg(K.checked_sum(scaled.cast(K.WIDE)).alias("total"))


@query("X14_window_start", "SELECT event_id, epoch_us(ts) // 1000 - (epoch_us(ts) // 1000) % 60000 AS start_ms FROM events")
def window_start(spark, d):
    return T.table(spark, d, "events").select("event_id", K.window_start(T.millis("ts")).alias("start_ms"))


@query("X08_scope", f"WITH {T.OBS}, {SUBJ}, {SCOPE} SELECT idx, reason FROM sd")
def scope_kernel(spark, d):
    rows = T.base(spark, d).where("kind = 'scope'").join(F.broadcast(T.subjects(spark)), "subject")
    return rows.select("idx", K.scope(F.col("policies"), F.col("scopes"), F.col("policy"), F.col("scope"), F.col("reported"))["reason"].alias("reason"))


@query("X09_replication", f"WITH {T.OBS}, {SUBJ}, {REPL} SELECT idx, reason FROM rd")
def replication_kernel(spark, d):
    rows = T.base(spark, d).where("kind = 'replication'").join(F.broadcast(T.subjects(spark)), "subject")
    return rows.select("idx", K.replication(*[F.col(c) for c in ("processes", "threads", "declared", "most_processes", "most_threads")])["reason"].alias("reason"))


@query("X10_silence", """WITH x AS (SELECT event_id, (list_value('ACTIVE', 'GAPPED', 'EMPTY', 'TERMINAL', 'RETIRED', 'FORKED'))[event_id % 6 + 1] AS state, event_id * 37 % 240000 AS age FROM events)
SELECT event_id, CASE WHEN state IN ('TERMINAL', 'RETIRED') THEN 'CLEAR' WHEN state = 'FORKED' THEN 'UNKNOWN' WHEN age >= 120000 THEN 'HIT' ELSE 'CLEAR' END AS status,
  CASE WHEN state IN ('TERMINAL', 'RETIRED') THEN 'SOURCE_TERMINAL' WHEN state = 'FORKED' THEN 'COVERAGE_INCOMPLETE' WHEN age >= 120000 THEN 'STREAM_SILENT' ELSE 'STREAM_RECENT' END AS reason FROM x""")
def silence_kernel(spark, d):
    i = F.col("event_id")
    state = F.element_at(F.array(*[F.lit(x) for x in ("ACTIVE", "GAPPED", "EMPTY", "TERMINAL", "RETIRED", "FORKED")]), (i % 6 + 1).cast("int"))
    return T.table(spark, d, "events").select("event_id", K.silence(state, F.lit(0).cast("bigint"), i * 37 % 240000).alias("d")).select("event_id", "d.status", "d.reason")


@query("J04_subject_join", f"WITH {T.OBS}, {SUBJ} SELECT subject, kind, count(*) AS n, max(mp) AS most_processes FROM base JOIN subj USING (subject) GROUP BY ALL")
def subject_join(spark, d):
    rows = T.base(spark, d).join(F.broadcast(T.subjects(spark)), "subject")
    return rows.groupBy("subject", "kind").agg(F.count("*").alias("n"), F.max("most_processes").alias("most_processes"))


@query("X02_digest", "SELECT doc_id, sha256(encode('RECORD/1') || '\\x00'::BLOB || encode(text)) AS hash FROM documents")
def digests(spark, d):
    return T.table(spark, d, "documents").select("doc_id", digest("RECORD/1", F.col("text")).alias("hash"))


@query("X07_text_valid", """SELECT item_id, length(text) BETWEEN 1 AND 256 AND octet_length(encode(text)) <= 1024 AND NOT regexp_matches(text, '[\\x00-\\x1f\\x7f]') AS valid FROM benchmark""")
def text_valid(spark, d):
    return T.table(spark, d, "benchmark").select("item_id", K.valid_text(F.col("text")).alias("valid"))


@query("X06_uint", """SELECT event_id, CASE WHEN regexp_full_match(u, '0|[1-9][0-9]{0,18}') THEN TRY_CAST(u AS BIGINT) END AS value
FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN '0' || CAST(event_id AS VARCHAR) WHEN 2 THEN '922337203685477580' || CAST(event_id % 10 AS VARCHAR) ELSE '+' || CAST(event_id AS VARCHAR) END AS u FROM events)""")
def uints(spark, d):
    i = F.col("event_id")
    text = F.when(i % 4 == 0, i.cast("string")).when(i % 4 == 1, F.concat(F.lit("0"), i.cast("string"))).when(
        i % 4 == 2, F.concat(F.lit("922337203685477580"), (i % 10).cast("string"))
    ).otherwise(F.concat(F.lit("+"), i.cast("string")))
    return T.table(spark, d, "events").select("event_id", K.uint(text).alias("value"))
