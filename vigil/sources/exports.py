"""Line-delimited sources: signed entries and bundles.

All are read with Spark's text and JSON readers under declared schemas; nothing is inferred.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from vigil.functions.canon import digest
from vigil.operators.scans import Dealt
from vigil.sources.collectors import SOURCE_DIGEST, ordered_lines

OBSERVATION = (
    "kind string, subject string, delta string, unit string, usage_id string, policy_hash string, scope_hash string, reported_violation boolean, "
    "processes string, threads string, declared_processes string, complete boolean, artifact string"
)
ENTRY = f"body struct<v:int, fleet:string, source:string, seq:string, prev:string, observed_ms:string, observation:struct<{OBSERVATION.replace(' ', ':').replace(',:', ', ')}>>, hash string, sig string"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, raw, valid, canonical) of a line-delimited JSON file, strictly parsed; lines count from 0 in each file."""
    told = Dealt(ordered_lines(spark, path), ["file"], ["block", "at"]).prefixes({"line": ("sum", F.lit(1).cast("bigint"))})
    return told.select("file", F.coalesce("line", F.lit(0)).alias("line"), "raw", "valid", "canonical")


def requests(entries: DataFrame, size: int = 64) -> DataFrame:
    """Add batch and position: the requests of at most ``size`` entries in which a file's entries are sent; one
    that isn't valid is in none (null)."""
    told = Dealt(entries, ["file"], ["line"]).prefixes({"_n": ("sum", F.col("valid").cast("bigint"))})
    n = F.when(F.col("valid"), F.coalesce("_n", F.lit(0)))
    return told.select(*entries.columns, F.floor(n / size).alias("batch"), (n % size).alias("position"))


def entries(spark: SparkSession, path: str, schema: str = ENTRY) -> DataFrame:
    """One signed entry to a line: (file, line, valid, error, entry).  error: the first rule that a line breaks
    (PARSE_INVALID, INVALID_INPUT for another shape, HASH_MISMATCH); valid: none."""
    body = F.get_json_object("canonical", "$.body")
    rows = lines(spark, path).withColumn("entry", F.when(F.col("valid"), F.from_json("canonical", schema))).withColumn("own", digest(SOURCE_DIGEST, body))
    error = F.when(~F.col("valid"), "PARSE_INVALID").when(F.col("entry.body.seq").isNull() | F.col("entry.hash").isNull() | F.col("entry.body.source").isNull(), "INVALID_INPUT").when(F.col("entry.hash") != F.col("own"), "HASH_MISMATCH")
    return rows.select("file", "line", error.isNull().alias("valid"), error.alias("error"), F.when(F.col("valid"), F.col("entry")).alias("entry"))


STEP = StructType([
    StructField("policy", StringType()),
    StructField("offers", ArrayType(StringType())),
    StructField("accepted", StringType()),
    StructField("subject", StringType()),
])
BUNDLE = StructType([StructField("digest", StringType()), StructField("inventory", LongType()), StructField("steps", ArrayType(STEP))])


def steps_observed(steps: DataFrame) -> DataFrame:
    """(step, position, kind, subject, policy_hash, scope_hash): for each step (step, subject, policy, offers, accepted)
    a scope record of its policy, of each offer and of what was accepted; a pulse where the subject isn't mapped or there is
    none of these."""
    part = lambda policy, scope: F.struct(F.lit("scope").alias("kind"), policy.alias("policy_hash"), scope.alias("scope_hash"))
    none = F.lit(None).cast("string")
    offers = F.transform(F.filter(F.coalesce("offers", F.array().cast("array<string>")), lambda o: o.isNotNull()), lambda o: part(none, o))
    parts = F.concat(F.array(F.when(F.col("policy").isNotNull(), part(F.col("policy"), none))), offers, F.array(F.when(F.col("accepted").isNotNull(), part(none, F.col("accepted")))))
    known = F.filter(parts, lambda p: p.isNotNull())
    pulse = F.array(F.struct(F.lit("pulse").alias("kind"), none.alias("policy_hash"), none.alias("scope_hash")))
    rows = steps.select("step", "subject", F.posexplode(F.when(F.col("subject").isNull() | (F.size(known) == 0), pulse).otherwise(known)).alias("position", "p"))
    return rows.select("step", "position", "p.kind", "subject", "p.policy_hash", "p.scope_hash")


def bundle(spark: SparkSession, path: str) -> DataFrame:
    """The observations of a bundle's steps (``steps_observed``); a bundle whose inventory is wrong, or whose
    digest isn't that of its steps' canonical JSON (where it states one), gives one coverage record."""
    steps = F.to_json(F.try_variant_get(F.try_parse_json("value"), "$.steps", "variant"))
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", BUNDLE).alias("b"), digest("BUNDLE/1", steps).alias("own")).select("b.*", "own")
    text = text.withColumn("inventory", F.when(F.col("digest").isNull() | (F.col("digest") == F.col("own")), F.col("inventory")))
    good = text.where("inventory = size(steps)").select(F.posexplode("steps").alias("step", "s")).select("step", "s.*")
    bad = text.where("inventory is null or inventory <> size(steps)").select(F.lit(0).alias("step"), F.lit(0).alias("position"), F.lit("coverage").alias("kind"))
    return steps_observed(good).unionByName(bad, allowMissingColumns=True)
