"""Native ledgers read into observations, and observations emitted as entries of a source.

A ledger is a file of lines: a header with a checkpoint, then its entries in order.  Its digests, its chain
and what the checkpoint pins are checked over the lines in the order of the file, whatever splits Spark reads it in; a file
whose check fails gives one observation that coverage is incomplete.  What a cursor has seen isn't
read again, so nothing is emitted twice.  Emitting continues each source's chain from its cursor.

Defined cases: a line that isn't strict JSON, a record of another kind, and a file without a header make a ledger
unverified; an empty file gives nothing; a subject that isn't mapped gives a pulse; a null seed gives an unsigned entry.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions import ed25519
from vigil.functions.canon import canonical, digest, to_base64url
from vigil.functions.strict import strict_json
from vigil.operators.ordered import folded
from vigil.operators.scans import Dealt
from vigil.sources.store import written

ZERO = "0" * 64
ENTRY_DIGEST, CHECKPOINT_DIGEST, SOURCE_DIGEST, SOURCE_SIGN = "LEDGER-ENTRY/1", "LEDGER-CHECKPOINT/1", "SOURCE/1", "SOURCE-SIGN/1"
#: Members of an observation by name, as canonical JSON has them.
OBSERVED = ("complete", "declared_processes", "kind", "policy_hash", "processes", "reported_violation", "scope_hash", "subject", "threads")


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, raw, valid, canonical): lines, which ``block`` and ``at`` put in the order of their file."""
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("raw")
    )
    return rows.where("raw <> ''").withColumn("p", strict_json("raw")).select("file", "block", "at", "raw", "p.valid", "p.canonical")


def ledger_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of ledgers with their number in the file (from 0) and, line by line, whether they are as they should be."""
    get = lambda p: F.get_json_object("canonical", p)
    lines = ordered_lines(spark, path).select(
        "file", "block", "at", "raw", get("$.record").alias("record"), get("$.format").alias("format"), get("$.checkpoint.body").alias("pin"), get("$.checkpoint.hash").alias("pin_hash"), get("$.entry.body").alias("body"), get("$.entry.hash").alias("hash"),
        get("$.entry.body.seq").try_cast("bigint").alias("seq"), get("$.entry.body.prev").alias("prev"),
    )
    told = Dealt(lines, ["file"], ["block", "at"]).prefixes({"n": ("sum", F.lit(1).cast("bigint")), "last": ("max", F.struct("block", "at", "hash"))}).drop("part")
    n, header = F.coalesce("n", F.lit(0)), F.col("record") == "header"
    ok = F.when(n == 0, header & (digest(CHECKPOINT_DIGEST, F.col("pin")) == F.col("pin_hash")) & (F.get_json_object("pin", "$.audit") == "COMPLETE_PREFIX")).otherwise(
        (F.col("record") == "entry") & (digest(ENTRY_DIGEST, F.col("body")) == F.col("hash")) & (F.col("seq") == n) & (F.col("prev") == F.when(n == 1, ZERO).otherwise(F.col("last.hash")))
    )
    return told.select("file", n.alias("line"), "raw", "pin", "body", "hash", "seq", F.coalesce(ok, F.lit(False)).alias("ok"))


def ledgers(lines: DataFrame) -> DataFrame:
    """(file, host, run, verified) of each ledger: all lines are right, and the checkpoint's head is the last entry."""
    pin = lambda p: F.get_json_object("pin", p)
    per = lines.groupBy("file").agg(
        F.bool_and("ok").alias("ok"), F.max(F.when(F.col("line") == 0, F.struct(pin("$.head.seq").try_cast("bigint").alias("seq"), pin("$.head.hash").alias("hash"), pin("$.host_id").alias("host"), pin("$.run_id").alias("run")))).alias("head"),
        F.max("line").alias("entries"), F.max_by("hash", F.when(F.col("line") > 0, F.col("line"))).alias("last_hash"), F.max(F.when(F.col("line") == 0, F.sha2("raw", 256))).alias("artifact"),
    )
    good = F.col("ok") & (F.col("entries") == F.col("head.seq")) & (F.coalesce("last_hash", F.lit(ZERO)) == F.col("head.hash"))
    return per.select("file", F.col("head.host").alias("host"), F.col("head.run").alias("run"), "artifact", F.coalesce(good, F.lit(False)).alias("verified"))


def collect(spark: SparkSession, path: str, subjects: DataFrame, cursors: DataFrame | None = None) -> DataFrame:
    """The observations of the ledgers under ``path`` that their cursors haven't seen: file, native_seq, native_ref, artifact,
    verification and the members of ``OBSERVED``.  subjects: agent, subject; cursors: file, frontier (a native number)."""
    lines = ledger_lines(spark, path)
    each = ledgers(lines)
    seen = each.select("file").withColumn("frontier", F.lit(0).cast("bigint")) if cursors is None else each.select("file").join(cursors, "file", "left").withColumn("frontier", F.coalesce("frontier", F.lit(0).cast("bigint")))
    each = each.join(seen, "file")
    get = lambda p: F.get_json_object("body", p)
    rows = lines.where("line > 0").join(each.where("verified"), "file").where("line > frontier")
    rows = rows.withColumn("agent", F.coalesce(get("$.data.agent_id"), F.col("run"))).join(subjects.select("agent", "subject"), "agent", "left")
    kind, mapped = get("$.kind"), F.col("subject").isNotNull()
    stop = (kind == "StopLatched") & get("$.data.reason").isin("SCOPE_MISMATCH", "REPLICATION_MISMATCH")
    what = (
        F.when(mapped & ((kind == "RunCreated") | stop), "scope").when(mapped & (kind == "InventoryObserved"), "replication").when(kind.isin("RunStopped", "RunRejected"), "terminal").when(kind == "Gap", "coverage").otherwise("pulse")
    )
    processes = F.size(F.array_distinct(F.coalesce(F.from_json(get("$.data.inventory.tgid"), "array<string>"), F.array().cast("array<string>"))))
    found = rows.withColumn("kind", what).select(
        "file", F.col("seq").alias("native_seq"), F.concat_ws("/", "host", "run", F.col("seq").cast("string")).alias("native_ref"), F.sha2("raw", 256).alias("artifact"), F.lit("VERIFIED_AT_PIN").alias("verification"),
        F.when(F.col("kind") == "coverage", F.lit(False)).alias("complete"), F.lit(None).cast("string").alias("declared_processes"), "kind", F.when((F.col("kind") == "scope") & ~stop, get("$.data.policy_hash")).alias("policy_hash"),
        F.when(F.col("kind") == "replication", processes.cast("string")).alias("processes"), F.when(F.col("kind") == "scope", stop).alias("reported_violation"), F.lit(None).cast("string").alias("scope_hash"),
        F.when(F.col("kind").isin("scope", "replication"), F.col("subject")).alias("subject"), F.when(F.col("kind") == "replication", F.coalesce(get("$.data.inventory.threads"), F.lit("0"))).alias("threads"),
    )
    broken = each.where("not verified").select(
        "file", (F.col("frontier") + 1).alias("native_seq"), F.concat_ws("/", "host", "run", F.lit("gap")).alias("native_ref"), "artifact", F.lit("ASSERTED").alias("verification"), F.lit(False).alias("complete"), F.lit("coverage").alias("kind")
    )
    return found.unionByName(broken, allowMissingColumns=True)


def emit(observations: DataFrame, profile: str, cursors: DataFrame, observed_ms: int) -> DataFrame:
    """Entries of each source in the order of ``native_seq``: fleet, source, seq, prev, hash, body, sig, native_seq.

    observations: of ``collect``, with source; cursors: source, fleet, key_id, seq and hash of the last entry (0 and zeros at first),
    seed (null: unsigned).  A source's entries are one stream, as each holds the hash of the one before; signatures are made behind it, in many tasks."""
    rows = observations.join(cursors.select("source", "fleet", "key_id", F.col("seq").alias("head_seq"), F.col("hash").alias("head_hash"), "seed"), "source")
    native = F.struct("native_artifact", "native_ref", "profile", "verification")
    rows = rows.withColumnsRenamed({"artifact": "native_artifact"}).withColumn("profile", F.lit(profile))
    members = F.map_filter(F.create_map(*(x for c in OBSERVED for x in (F.lit(c), _json(c)))), lambda k, v: v.isNotNull())
    observation = F.concat(F.lit("{"), F.array_join(F.transform(F.map_keys(members), lambda k: F.concat(F.lit('"'), k, F.lit('":'), members[k])), ","), F.lit("}"))
    head = F.concat(F.lit('{"fleet":'), _text("fleet"), F.lit(',"key_id":'), _text("key_id"), F.lit(',"native":'), canonical(native), F.lit(',"observation":'), observation, F.lit(f',"observed_ms":"{observed_ms}","prev":"'))
    needed = rows.select("fleet", "source", "native_seq", head.alias("head"), F.concat(F.lit(',"source":'), _text("source"), F.lit(',"v":1}')).alias("tail"), "head_seq", "head_hash", "seed")
    names = ("fleet", "source", "native_seq")

    def step(state: dict, r: dict) -> dict:
        if not state:
            state.update(seq=r["head_seq"], hash=r["head_hash"])
        state["seq"], prev = state["seq"] + 1, state["hash"]
        body = f'{r["head"]}{prev}","seq":"{state["seq"]}"{r["tail"]}'
        state["hash"] = hashlib.sha256(f"{SOURCE_DIGEST}\0{body}".encode()).hexdigest()
        return {c: r[c] for c in names} | {"seq": state["seq"], "prev": prev, "hash": state["hash"], "body": body, "seed": r["seed"]}

    schema = needed.select(*names).schema.add("seq", "long").add("prev", "string").add("hash", "string").add("body", "string").add("seed", "string")
    chained = folded(needed, "source", ["native_seq"], dict, step, schema)
    # a signature takes far longer than a link, and no entry waits for that of the one before, so they are dealt out for it
    return chained.repartition("source", "seq").withColumn("sig", ed25519.signed(to_base64url(F.unhex("seed")), SOURCE_SIGN, F.col("hash"))).drop("seed")


def _text(name: str):
    """A column as a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(F.col(name).cast("string").alias("x")), {"ignoreNullFields": "false"}), r'^\{"x":(.*)\}$', 1)


def _json(name: str):
    return F.when(F.col(name).isNotNull(), F.col(name).cast("string") if name in ("complete", "reported_violation") else _text(name))


def moved(cursors: DataFrame, entries: DataFrame) -> DataFrame:
    """The cursors (source, fleet, key_id, seq, hash, seed) after what was emitted."""
    last = entries.groupBy("source").agg(F.max("seq").alias("_seq"), F.max_by("hash", "seq").alias("_hash"))
    joined = cursors.join(last, "source", "left")
    return joined.select("source", "fleet", "key_id", F.coalesce("_seq", "seq").alias("seq"), F.coalesce("_hash", "hash").alias("hash"), "seed")


def ledger_text(entries: DataFrame, host: str = "host") -> DataFrame:
    """(ledger, place, value): the lines of ledgers, in order of place, from entries (ledger, order, kind, data as
    canonical JSON); each ledger is one stream, as its entries are chained."""

    def step(state: dict, r: dict) -> dict:
        state["seq"] = state.get("seq", 0) + 1
        body = f'{{"data":{r["data"]},"kind":{json.dumps(r["kind"])},"prev":"{state.get("hash", ZERO)}","seq":"{state["seq"]}"}}'
        state["hash"] = hashlib.sha256(f"{ENTRY_DIGEST}\0{body}".encode()).hexdigest()
        return {"ledger": r["ledger"], "place": state["seq"], "hash": state["hash"], "value": f'{{"entry":{{"body":{body},"hash":"{state["hash"]}"}},"record":"entry"}}'}

    needed = entries.select(F.col("ledger").cast("string").alias("ledger"), "order", "kind", "data")
    rows = written(folded(needed, "ledger", ["order"], dict, step, needed.select("ledger").schema.add("place", "long").add("hash", "string").add("value", "string")), "ledgers")
    head = rows.groupBy("ledger").agg(F.max(F.struct("place", "hash")).alias("h"))
    pin = F.concat(F.lit('{"audit":"COMPLETE_PREFIX","head":{"hash":"'), "h.hash", F.lit('","seq":"'), F.col("h.place").cast("string"), F.lit(f'"}},"host_id":"{host}","run_id":'), _text("ledger"), F.lit("}"))
    first = head.withColumn("pin", pin).select("ledger", F.lit(0).cast("bigint").alias("place"), F.concat(F.lit('{"checkpoint":{"body":'), "pin", F.lit(',"hash":"'), digest(CHECKPOINT_DIGEST, F.col("pin")), F.lit('"},"format":"ledger/1","record":"header","v":1}')).alias("value"))
    return first.unionByName(rows.select("ledger", "place", "value"))
