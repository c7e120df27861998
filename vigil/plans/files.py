"""Files made of the tables and read back: native ledgers, entries in lines, evidence; and signatures.

Fixed values: moduli by which lines are damaged, on both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions import ed25519
from vigil.functions.canon import to_base64url
from vigil.sources import collectors as N
from vigil.sources import evidence
from vigil.sources import exports as X
from vigil.sources.store import shared, written

from . import ledger as R
from . import tables as T
from .registry import query

KINDS = ["RunCreated", "InventoryObserved", "Heartbeat", "StopLatched", "Gap", "RunRejected", "RunStopped"]
LEDGERS = f"""l AS (SELECT conv_id % 4 AS ledger, row_number() OVER (PARTITION BY conv_id % 4 ORDER BY conv_id, turn) AS seq, {KINDS}[(conv_id + turn * 3) % 7 + 1] AS kind, conv_id % 6 AS agent, turn,
  CASE turn % 3 WHEN 0 THEN 'SCOPE_MISMATCH' WHEN 1 THEN 'REPLICATION_MISMATCH' ELSE 'OTHER' END AS reason FROM conversations)"""


def native(spark, d) -> str:
    """A folder of four ledgers made of the conversations; the last one has an altered line."""
    c = T.table(spark, d, "conversations")
    i = F.col("conv_id") + F.col("turn") * 3
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (i % 7 + 1).cast("int"))
    agent, reason = F.concat(F.lit("a"), F.col("conv_id") % 6), F.when(F.col("turn") % 3 == 0, "SCOPE_MISMATCH").when(F.col("turn") % 3 == 1, "REPLICATION_MISMATCH").otherwise("OTHER")
    tgid = F.array(F.lit("7"), F.lit("7"), (F.col("turn") + 8).cast("string"))
    data = F.to_json(F.struct(agent.alias("agent_id"), F.struct(tgid.alias("tgid"), F.col("turn").cast("string").alias("threads")).alias("inventory"), F.sha2(F.lit("policy"), 256).alias("policy_hash"), reason.alias("reason")))
    text = N.ledger_text(c.select((F.col("conv_id") % 4).alias("ledger"), F.struct("conv_id", "turn").alias("order"), kind.alias("kind"), data.alias("data")))
    text = text.withColumn("value", F.when((F.col("ledger") == "3") & (F.col("place") == 5), F.replace("value", F.lit("agent_id"), F.lit("agent-id"))).otherwise(F.col("value")))
    path = shared(spark, "native")
    text.repartition("ledger").sortWithinPartitions("ledger", "place").select("ledger", "value").write.partitionBy("ledger").text(path)
    return path


def subjects(spark, d):
    """The agents that are mapped to subjects."""
    agents = T.table(spark, d, "conversations").select((F.col("conv_id") % 6).alias("n")).distinct().where("n < 4")
    return agents.select(F.concat(F.lit("a"), "n").alias("agent"), F.concat(F.lit("subject-"), "n").alias("subject"))


def ledger_of(file):
    return F.regexp_extract(file, "ledger=([0-9]+)", 1)


def collected(spark, d, frontier=None):
    path = native(spark, d)
    cursors = None
    if frontier is not None:
        files = N.ordered_lines(spark, path).select("file").distinct()
        cursors = files.select("file", F.lit(frontier).cast("bigint").alias("frontier"))
    return N.collect(spark, path, subjects(spark, d), cursors)


@query("S03_collect", f"""WITH {LEDGERS}, m AS (SELECT *, CASE WHEN agent < 4 THEN 'subject-' || agent END AS subject, CASE WHEN kind = 'StopLatched' AND reason <> 'OTHER' THEN true ELSE false END AS stop FROM l WHERE ledger < 3),
k AS (SELECT *, CASE WHEN subject IS NOT NULL AND (kind = 'RunCreated' OR stop) THEN 'scope' WHEN subject IS NOT NULL AND kind = 'InventoryObserved' THEN 'replication' WHEN kind IN ('RunStopped', 'RunRejected') THEN 'terminal' WHEN kind = 'Gap' THEN 'coverage' ELSE 'pulse' END AS what FROM m)
SELECT ledger::VARCHAR AS ledger, seq AS native_seq, what AS kind, CASE WHEN what IN ('scope', 'replication') THEN subject END AS subject, CASE WHEN what = 'scope' THEN stop END AS reported_violation, CASE WHEN what = 'scope' AND NOT stop THEN sha256('policy') END AS policy_hash,
  CASE WHEN what = 'replication' THEN CASE WHEN turn = -1 THEN '1' ELSE '2' END END AS processes, CASE WHEN what = 'replication' THEN turn::VARCHAR END AS threads, CASE WHEN what = 'coverage' THEN false END AS complete, 'VERIFIED_AT_PIN' AS verification FROM k WHERE seq > 3
UNION ALL SELECT '3', 4, 'coverage', NULL, NULL, NULL, NULL, NULL, false, 'ASSERTED'""")
def collect(spark, d):
    """Observations of native ledgers beyond what their cursors have seen; the altered ledger is one gap."""
    rows = collected(spark, d, 3)
    return rows.select(ledger_of("file").alias("ledger"), "native_seq", "kind", "subject", "reported_violation", "policy_hash", "processes", "threads", "complete", "verification")


def seed(n):
    return F.sha2(F.concat(F.lit("seed/"), n), 256)


def emitted(spark, d):
    rows = collected(spark, d).withColumn("source", F.concat(F.lit("s"), ledger_of("file")))
    sources = rows.select("source").distinct()
    cursors = sources.select("source", F.lit("f").alias("fleet"), F.concat(F.lit("k"), "source").alias("key_id"), F.lit(0).cast("bigint").alias("seq"), F.lit(N.ZERO).alias("hash"), seed(F.col("source")).alias("seed"))
    return N.emit(rows, "ledger/1", cursors, 1_704_067_200_000)


@query("S05_emit", f"WITH {LEDGERS} SELECT 's' || ledger AS source, seq, seq AS native_seq, true AS linked, true AS signed FROM l WHERE ledger < 3 UNION ALL SELECT 's3', 1, 1, true, true")
def emit(spark, d):
    """Entries that continue each source's chain, with whether they name the one before and bear their source's signature."""
    e = written(emitted(spark, d), "emitted")
    before = e.select("source", (F.col("seq") + 1).alias("seq"), F.col("hash").alias("before"))
    keys = e.select("source").distinct().withColumn("public", ed25519.public_of(to_base64url(F.unhex(seed(F.col("source"))))))
    joined = e.join(before, ["source", "seq"], "left").join(keys, "source")
    return joined.select("source", "seq", "native_seq", (F.col("prev") == F.coalesce("before", F.lit(N.ZERO))).alias("linked"), ed25519.verified(F.col("public"), N.SOURCE_SIGN, F.col("hash"), F.col("sig")).alias("signed"))


@query("S02_entry_lines", f"""WITH {LEDGERS}, e AS (SELECT 's' || ledger AS source, seq FROM l WHERE ledger < 3 UNION ALL SELECT 's3', 1), x AS (SELECT *, CASE WHEN seq % 17 = 5 THEN 'PARSE_INVALID' WHEN seq % 19 = 3 THEN 'HASH_MISMATCH' END AS error FROM e),
n AS (SELECT *, count(*) FILTER (error IS NULL) OVER (PARTITION BY source ORDER BY seq) - 1 AS i FROM x) SELECT source, seq - 1 AS line, error, CASE WHEN error IS NULL THEN i // 64 END AS batch, CASE WHEN error IS NULL THEN i % 64 END AS position FROM n""")
def entry_lines(spark, d):
    """Entries written a line each, some damaged, read again and put into requests of 64."""
    e = emitted(spark, d)
    hash_ = F.when((F.col("seq") % 19 == 3) & (F.col("seq") % 17 != 5), F.sha2("hash", 256)).otherwise(F.col("hash"))
    text = F.concat(F.lit('{"body":'), "body", F.lit(',"hash":"'), hash_, F.lit('","sig":"'), F.coalesce("sig", F.lit("")), F.when(F.col("seq") % 17 == 5, '"').otherwise('"}'))
    path = shared(spark, "entries")
    e.select("source", "seq", text.alias("value")).repartition("source").sortWithinPartitions("source", "seq").select("source", "value").write.partitionBy("source").text(path)
    told = X.requests(X.entries(spark, path))
    return told.select(F.regexp_extract("file", "source=(s[0-9]+)", 1).alias("source"), "line", "error", "batch", "position")


@query("S07_evidence", f"{R.Q}, n AS (SELECT fleet, count(*) AS entries FROM jrn WHERE (fleet = 0 AND seq <= 150) OR (fleet = 1 AND seq <= 90) GROUP BY fleet) SELECT fleet, 1 AS headers, 1 AS trailers, (entries + 39) // 40 AS pages, entries, true AS contiguous, true AS complete FROM n")
def export(spark, d):
    """Evidence of pinned checkpoints, exported and read back; a pin that the journal doesn't have exports nothing."""
    j = R.journal(spark, d)
    pins = j.where("(fleet = 0 and seq = 150) or (fleet = 1 and seq = 90) or (fleet = 2 and seq = 70)").select("fleet", "seq", F.when(F.col("fleet") == 2, F.sha2("hash", 256)).otherwise(F.col("hash")).alias("hash"))
    path = shared(spark, "evidence")
    evidence.export(j, pins, path, limit=40)
    return evidence.read(spark, path)[1]


@query("S06_evidence_entries", f"{R.Q} SELECT fleet, seq, at_ms, kind, key, n1, s1 FROM jrn WHERE fleet = 1 AND seq <= 90")
def evidence_entries(spark, d):
    """The entries of an evidence file."""
    j = R.journal(spark, d)
    path = shared(spark, "evidence")
    evidence.export(j, j.where("fleet = 1 and seq = 90").select("fleet", "seq", "hash"), path)
    return evidence.read(spark, path)[0].select("fleet", "seq", "at_ms", "kind", "key", "n1", "s1")


@query("X04_signatures", "SELECT doc_id, NOT (doc_id % 7 = 3 OR doc_id % 11 = 4 OR doc_id % 13 = 5) AS valid FROM documents")
def signatures(spark, d):
    """Texts' hashes signed by one of five keys and verified, some for another hash, by another key, or with a signature that is cut."""
    i = F.col("doc_id")
    key = lambda n: to_base64url(F.unhex(seed(n.cast("string"))))
    rows = T.table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    rows = rows.withColumn("sig", ed25519.signed(key(i % 5), "TEXT/1", F.col("hash"))).withColumn("public", ed25519.public_of(key(F.when(i % 11 == 4, i % 5 + 5).otherwise(i % 5))))
    given = F.when(i % 7 == 3, F.sha2("hash", 256)).otherwise(F.col("hash"))
    return rows.select("doc_id", ed25519.verified(F.col("public"), "TEXT/1", given, F.when(i % 13 == 5, F.substring("sig", 1, 80)).otherwise(F.col("sig"))).alias("valid"))
