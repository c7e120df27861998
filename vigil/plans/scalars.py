"""Scalar functions, record checks and lookups, one query each."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions import kernels as K
from vigil.functions import records as C

from . import tables as T
from .registry import query

SUBSCRIPTION = (
    """'{"id":"wss_' || CASE WHEN event_id % 7 = 1 THEN 'short' ELSE repeat('S', 21) END || '","watcher":"wwa_' || repeat('A', 21) || '","state":"' || CASE WHEN event_id % 7 = 2 THEN 'OPEN' ELSE 'ACTIVE' END || '","ack":' """
    """|| CASE WHEN event_id % 7 = 3 THEN '5' ELSE '"5"' END || ',"delivered":"' || CASE WHEN event_id % 7 = 4 THEN '07' ELSE '7' END || '","lease_until_ms":"0","revision":"1"' || CASE WHEN event_id % 7 = 5 THEN ',"more":1' ELSE '' END || '}'"""
)


@query("F22_closed_records", f"SELECT event_id, list_sort(json_keys(j)) = ['ack', 'delivered', 'id', 'lease_until_ms', 'revision', 'state', 'watcher'] AND regexp_full_match(j->>'$.id', 'wss_[A-Za-z0-9_-]{{21}}') AND (j->>'$.state') IN ('ACTIVE', 'PAUSED', 'EXPIRED', 'CLOSED') AND json_type(j->'$.ack') = 'VARCHAR' AND regexp_full_match(j->>'$.delivered', '0|[1-9][0-9]*') AS valid FROM (SELECT event_id, CAST({SUBSCRIPTION} AS JSON) AS j FROM events)")
def closed_records(spark, d):
    """Subscriptions of which six in seven are altered, or not, in one member."""
    return T.table(spark, d, "events").select("event_id", C.valid("subscription", F.expr(SUBSCRIPTION)).alias("valid"))


@query("X21_structural_equality", "SELECT event_id, event_id % 3 <> 2 AS same FROM events")
def structural_equality(spark, d):
    """Objects with members in another order, other white space, or another value."""
    i = F.col("event_id")
    left = F.concat(F.lit('{"a":'), i.cast("string"), F.lit(',"b":[1,null,"x"]}'))
    right = F.when(i % 3 == 0, F.concat(F.lit('{ "b" : [1, null, "x"], "a" : '), i.cast("string"), F.lit("}"))).when(i % 3 == 1, left).otherwise(F.concat(F.lit('{"a":"'), i.cast("string"), F.lit('","b":[1,null,"x"]}')))
    return T.table(spark, d, "events").select("event_id", C.same(left, right).alias("same"))


@query("X01_canonical_json", """SELECT event_id, '{"a":' || event_id || ',"m":{"x":null,"y":"' || event_type || '"},"z":true}' AS text FROM events""")
def canonical_json(spark, d):
    i = F.col("event_id")
    text = F.concat(F.lit('{"z":true, "m":{"y":"'), "event_type", F.lit('","x":null},"a":'), i.cast("string"), F.lit("}"))
    return T.table(spark, d, "events").select("event_id", F.to_json(F.try_parse_json(text)).alias("text"))


@query("X05_ids", "SELECT event_id, event_id % 4 = 0 AS valid FROM events")
def ids(spark, d):
    i = F.col("event_id")
    text = F.concat(F.when(i % 4 == 1, "wso_").otherwise("wfl_"), F.repeat(F.lit("F"), 18), F.lpad((i % 1000).cast("string"), 3, "0"), F.when(i % 4 == 2, "F").when(i % 4 == 3, "\n").otherwise(""))
    return T.table(spark, d, "events").select("event_id", K.valid_id(text, "wfl").alias("valid"))


@query("X12_signal", "SELECT event_id, 'SIGNAL' AS status, 'SIGNAL_ONLY' AS reason FROM events WHERE event_type = 'view'")
def signals(spark, d):
    return T.table(spark, d, "events").where("event_type = 'view'").select("event_id", K.signal().alias("d")).select("event_id", "d.status", "d.reason")


@query("X16_round6", "SELECT event_id, CAST(event_id // 7 AS VARCHAR) || '.' || lpad(CAST(event_id % 7 * 125000 AS VARCHAR), 6, '0') AS text FROM events")
def round6(spark, d):
    """Six decimals of numbers in eighths."""
    i = F.col("event_id")
    x = F.expr("event_id div 7") + (i % 7).cast("double") / 8
    return T.table(spark, d, "events").select("event_id", K.six(x).alias("text"))


@query("X17_fraction", "SELECT event_id, CASE WHEN event_id % 5 > 0 THEN event_id % 3 END AS n, CASE WHEN event_id % 5 > 0 THEN event_id % 5 END AS d FROM events")
def fractions(spark, d):
    i = F.col("event_id")
    return T.table(spark, d, "events").select("event_id", K.fraction(i % 3, i % 5).alias("f")).select("event_id", "f.n", "f.d")


STATES = ["NONE", "QUEUED", "IN_FLIGHT", "RETRY", "DELIVERED", "FAILED", "CANCELLED"]


@query("X19_degrade", f"SELECT event_id, 'DEGRADED' AS assurance, CASE WHEN s IN ('QUEUED', 'RETRY') THEN 'CANCELLED' ELSE s END AS delivery FROM (SELECT event_id, ({STATES})[event_id % 7 + 1] AS s FROM events)")
def degrade(spark, d):
    i = F.col("event_id")
    state = F.element_at(F.array(*[F.lit(s) for s in STATES]), (i % 7 + 1).cast("int"))
    return T.table(spark, d, "events").select("event_id", K.degrade(F.lit("CANDIDATE"), state).alias("d")).select("event_id", "d.assurance", "d.delivery")


@query("F20_keyset_state", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey > 1000 AND o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 65")
def keyset_state(spark, d):
    """The page after a key, of one state only, with one row more that tells whether another follows."""
    from vigil.operators import journal as J

    rows = T.table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return J.keyset(rows.where("o_orderstatus = 'F'"), "o_orderkey", 1000, 65)


@query("P03_subject_lookup", "SELECT event_id, CASE WHEN user_id % 16 < 14 THEN user_id % 16 END AS subject FROM events")
def subject_lookup(spark, d):
    known = T.subjects(spark).select(F.col("subject"), F.col("subject").alias("k"))
    return T.table(spark, d, "events").select("event_id", (F.col("user_id") % 16).alias("k")).join(F.broadcast(known), "k", "left").select("event_id", "subject")


@query("T03_watermark", "SELECT user_id % 8 AS fleet, max(epoch_us(ts) // 1000) AS watermark_ms, max(epoch_us(ts) // 1000) // 60000 * 60000 AS open_ms FROM events GROUP BY ALL")
def watermark(spark, d):
    """Receive time is monotone, so what has been received is the watermark: all windows before the open one are closed."""
    rows = T.table(spark, d, "events").groupBy((F.col("user_id") % 8).alias("fleet")).agg(F.max(T.millis("ts")).alias("watermark_ms"))
    return rows.withColumn("open_ms", K.window_start(F.col("watermark_ms")))


#: Who may call each method, beside the root, who installs configurations and reads.
CALLERS = {
    "fleet.get": ("reader", "operator", "watcher"), "alert.list": ("reader", "operator", "watcher"), "alert.get": ("reader", "operator", "watcher"), "audit.read": ("reader", "operator", "watcher"),
    "audit.checkpoint": ("reader", "operator", "watcher"), "bundle.export": ("reader", "operator", "watcher"), "metrics.get": ("reader", "operator", "watcher"), "config.put": (),
    "source.append": ("producer",), "subscription.open": ("watcher",), "subscription.read": ("watcher",), "subscription.ack": ("watcher",), "subscription.set": ("watcher",), "vote.submit": ("watcher",), "alert.act": ("operator",),
}
METHODS = sorted(CALLERS)
WHO = ["root", "producer", "watcher", "operator", "reader"]
READS = sorted(m for m, who in CALLERS.items() if "reader" in who)


@query("F15_role_matrix", f"""SELECT event_id, m AS method, w AS role, CASE WHEN m = 'config.put' THEN w = 'root' WHEN m = 'source.append' THEN w = 'producer' WHEN m = 'alert.act' THEN w = 'operator'
  WHEN m = 'vote.submit' OR m LIKE 'subscription.%' THEN w = 'watcher' ELSE w <> 'producer' END AS allowed FROM (SELECT event_id, ({METHODS})[event_id % 15 + 1] AS m, ({WHO})[event_id // 15 % 5 + 1] AS w FROM events)""")
def role_matrix(spark, d):
    """All fifteen methods by all four roles and the root."""
    i = F.col("event_id")
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (n + 1).cast("int"))
    matrix = [(m, r) for m, who in CALLERS.items() for r in who] + [(m, "root") for m in ["config.put", *READS]]
    e = T.table(spark, d, "events").select("event_id", pick(METHODS, i % 15).alias("method"), pick(WHO, F.expr("event_id div 15 % 5")).alias("role"))
    m = spark.createDataFrame(matrix, "method string, role string").withColumn("ok", F.lit(True))
    return e.join(F.broadcast(m), ["method", "role"], "left").select("event_id", "method", "role", F.coalesce("ok", F.lit(False)).alias("allowed"))


#: The codes of refusals by the status that they are answered with.
STATUS = {
    400: ["INVALID_INPUT", "UNSUPPORTED_VERSION"], 401: ["UNAUTHORIZED", "STALE_REQUEST"], 403: ["FORBIDDEN", "KEY_REVOKED"], 404: ["NOT_FOUND"],
    409: ["IDEMPOTENCY_CONFLICT", "REPLAY_EXPIRED", "REVISION_CONFLICT", "STATE_CONFLICT", "CHAIN_INVALID", "SOURCE_FORKED", "SOURCE_TERMINAL", "GAP_LIMIT", "USAGE_CONFLICT", "RESULT_MISMATCH", "VOTE_EXPIRED", "CURSOR_INVALID", "FUTURE_TIMESTAMP"],
    422: ["HASH_MISMATCH", "SIGNATURE_INVALID"], 429: ["CAPACITY"], 503: ["BUSY", "PACK_UNAVAILABLE", "AUDIT_UNAVAILABLE"],
}
CODES = sorted(c for codes in STATUS.values() for c in codes)


@query("X20_status_map", f"SELECT event_id, c AS code, CASE {' '.join(f'WHEN c IN {tuple(codes)} THEN {s}' if len(codes) > 1 else f'WHEN c = {codes[0]!r} THEN {s}' for s, codes in STATUS.items())} END AS status FROM (SELECT event_id, ({CODES})[event_id % {len(CODES)} + 1] AS c FROM events)")
def status_map(spark, d):
    i = F.col("event_id")
    code = F.element_at(F.array(*[F.lit(c) for c in CODES]), (i % len(CODES) + 1).cast("int"))
    m = spark.createDataFrame([(c, s) for s, codes in STATUS.items() for c in codes], "code string, status int")
    return T.table(spark, d, "events").select("event_id", code.alias("code")).join(F.broadcast(m), "code").select("event_id", "code", "status")
