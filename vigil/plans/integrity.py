"""Envelope checks, manifests, witnesses, coverage and successor configurations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vigil.functions import canon
from vigil.functions import kernels as K

from . import lifecycle as L
from . import tables as T
from .registry import query


@query("A02_spend_sum", f"WITH {T.OBS} SELECT kind, CASE WHEN sum(CAST(idx AS HUGEINT) * 92233720368547) > {K.U_MAX} THEN NULL ELSE CAST(sum(CAST(idx AS HUGEINT) * 92233720368547) AS BIGINT) END AS total FROM base GROUP BY kind")
def sum_overflow(spark, d):
    return T.base(spark, d).groupBy("kind").agg(K.checked_sum((K.wide(F.col("idx")) * K.wide(92233720368547)).cast(K.WIDE)).alias("total"))


@query("A09_pending_counts", f"WITH {L.ARR}, x AS (SELECT source, seq, row_number() OVER (PARTITION BY source ORDER BY seq) AS n FROM (SELECT DISTINCT source, seq FROM arrivals)) SELECT CASE WHEN p > 0 THEN 'GAPPED' ELSE 'ACTIVE' END AS state, count(*) AS sources, CAST(sum(p) AS BIGINT) AS pending FROM (SELECT source, count(*) FILTER (seq <> n) AS p FROM x GROUP BY source) GROUP BY ALL")
def pending_counts(spark, d):
    from vigil.operators.sequence import gaps

    g = gaps(L.arrivals(spark, d)).withColumn("state", F.when(F.col("pending") > 0, "GAPPED").otherwise("ACTIVE"))
    return g.groupBy("state").agg(F.count("*").alias("sources"), F.sum("pending").alias("pending"))


@query("X03_base64url", "SELECT item_id, rtrim(translate(base64(encode(text)), '+/', '-_'), '=') AS coded FROM benchmark")
def base64url(spark, d):
    return T.table(spark, d, "benchmark").select("item_id", canon.to_base64url(F.encode("text", "UTF-8")).alias("coded"))


@query("X13_usage_payload", f"""WITH {T.OBS} SELECT idx, sha256(encode('USAGE/1') || '\\x00'::BLOB || encode('{{"delta":"' || CAST(delta AS VARCHAR) || '","subject":"' || CAST(subject AS VARCHAR) || '","unit":"usd_micro"}}')) AS hash FROM base WHERE kind = 'spend'""")
def usage_payload(spark, d):
    body = F.struct(F.col("delta").cast("string").alias("delta"), F.col("subject").cast("string").alias("subject"), F.lit("usd_micro").alias("unit"))
    return T.base(spark, d).where("kind = 'spend'").select("idx", canon.digest("USAGE/1", canon.canonical(body)).alias("hash"))

