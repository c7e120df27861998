"""Projection of the shared tables to the engine's records, in Spark and as SQL text.

Fixed values: moduli and limits that both sides state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.functions.kernels import late
from vigil.functions.params import Params

HOUR = Params(window_ms=3_600_000)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(ts: str):
    """Epoch milliseconds of a timestamp without zone, whatever the session's zone."""
    days = F.datediff(F.col(ts), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 86_400_000 + F.hour(ts).cast("bigint") * 3_600_000 + F.minute(ts).cast("bigint") * 60_000 + (F.expr(f"extract(SECOND FROM {ts})") * 1000).cast("bigint")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations, before usage ids are counted."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint")).withColumn("received_ms", millis("ts"))
    kind = (
        F.when(F.col("event_type") == "purchase", "spend").when(F.col("event_type") == "signup", "scope").when(F.col("event_type") == "error", "replication")
        .when(F.col("event_type") == "click", "pulse").otherwise("signal")
    )
    k, user = F.col("k"), F.col("user_id")
    e = e.select(
        (F.col("event_id") + 1).alias("idx"), "received_ms", (F.col("received_ms") - k * 3000).alias("observed_ms"),
        (user % 8).alias("source"), (user % 16).alias("subject"), kind.alias("kind"),
        F.round(F.col("value") * 10000).cast("bigint").alias("delta"), (F.col("event_id") % 37).alias("usage_id"),
        F.when(k % 11 != 0, k % 7).alias("policy"), F.when(k % 11 != 0, k % 5).alias("scope"), (k % 17 == 0).alias("reported"),
        F.when(k % 13 != 0, user % 9).alias("processes"), F.when(k % 13 != 0, k).alias("threads"), F.when(k % 4 != 0, k % 9).alias("declared"), "k",
    )
    return e.withColumn("late", late(F.col("observed_ms"), F.col("received_ms"), HOUR))


OBS = """base AS (
  SELECT event_id + 1 AS idx, epoch_us(ts) // 1000 AS received_ms, epoch_us(ts) // 1000 - k * 3000 AS observed_ms, user_id % 8 AS source, user_id % 16 AS subject,
    CASE event_type WHEN 'purchase' THEN 'spend' WHEN 'signup' THEN 'scope' WHEN 'error' THEN 'replication' WHEN 'click' THEN 'pulse' ELSE 'signal' END AS kind,
    CAST(round(value * 10000) AS BIGINT) AS delta, event_id % 37 AS usage_id,
    CASE WHEN k % 11 <> 0 THEN k % 7 END AS policy, CASE WHEN k % 11 <> 0 THEN k % 5 END AS scope, k % 17 = 0 AS reported,
    CASE WHEN k % 13 <> 0 THEN user_id % 9 END AS processes, CASE WHEN k % 13 <> 0 THEN k END AS threads, CASE WHEN k % 4 <> 0 THEN k % 9 END AS declared, k,
    k * 3000 > 120000 AS late
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
)"""


def subjects(spark: SparkSession) -> DataFrame:
    """Configured subjects 0 to 13: allowed policies and scopes, and limits."""
    s = F.col("subject")
    return spark.range(14).select(F.col("id").alias("subject")).select(
        "subject", F.filter(F.sequence(F.lit(0).cast("bigint"), F.lit(6).cast("bigint")), lambda p: (p + s) % 4 != 0).alias("policies"),
        F.filter(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint")), lambda p: (p + s) % 5 != 1).alias("scopes"),
        (s % 3 + 5).alias("most_processes"), (s * 4 + 30).alias("most_threads"),
    )


def sources(spark: SparkSession) -> DataFrame:
    """Configured sources 0 to 7."""
    s = F.col("source")
    return spark.range(8).select(F.col("id").alias("source")).select(
        "source", (s % 4 == 0).alias("meter"), (s != 7).alias("enabled"), (s == 6).alias("revoked"),
        F.when(s == 5, "FORKED").when(s == 4, "TERMINAL").otherwise("ACTIVE").alias("state"), F.lit(1704067200000).alias("activated_ms"),
    )
