"""Evaluation: confusion counts, exact rates and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions import kernels as K


def confusion(units: DataFrame) -> DataFrame:
    """Counts by detector of units (detector, positive, status)."""
    n = lambda cond, name: F.count_if(F.expr(cond)).alias(name)
    return units.groupBy("detector").agg(
        n("status = 'HIT' and positive", "tp"), n("status = 'HIT' and not positive", "fp"),
        n("status = 'CLEAR' and positive", "fn"), n("status = 'CLEAR' and not positive", "tn"),
        n("status = 'UNKNOWN' and positive", "unknown_positive"), n("status = 'UNKNOWN' and not positive", "unknown_negative"),
        n("status = 'SIGNAL'", "signals"),
    )


def labelled(units: DataFrame, labels: DataFrame, strict: bool = False) -> DataFrame:
    """Units (id, detector, ...) with the label (positive) that their detector has for them, null where there
    is none.  strict: a unit without a label ends the job with an error, as an evaluation has to."""
    found = units.join(labels.select("id", "detector", "positive").dropDuplicates(["id", "detector"]), ["id", "detector"], "left")
    if strict:
        found = found.withColumn("positive", F.when(F.col("positive").isNull(), F.raise_error(F.concat(F.lit("no label of "), "detector", F.lit(" for "), F.col("id").cast("string")))).otherwise(F.col("positive")))
    return found


def report(counts: DataFrame) -> DataFrame:
    """(detector, rate, n, d, low, high, signals): each rate of each detector's counts as a fraction with its interval;
    nulls where a denominator is 0."""
    rates = K.rates(*[F.col(c) for c in ("tp", "fp", "fn", "tn", "unknown_positive", "unknown_negative")])
    names = ("precision", "recall", "false_positive_rate", "coverage")
    each = counts.withColumn("_r", rates).select("detector", "signals", F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), F.col(f"_r.{r}").alias("f")) for r in names])).alias("x"))
    each = each.select("detector", "x.rate", F.col("x.f.n").alias("n"), F.col("x.f.d").alias("d"), "signals").withColumn("_w", K.wilson(F.col("n"), F.col("d")))
    return each.select("detector", "rate", "n", "d", F.col("_w.low").alias("low"), F.col("_w.high").alias("high"), "signals")
