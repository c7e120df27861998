"""Offline verification of a journal as set queries, and replay of its results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import journal as J
from . import sequence as S


def reasons(journal: DataFrame, legal: DataFrame, objects: DataFrame | None = None, references: DataFrame | None = None) -> DataFrame:
    """(fleet, reason, n): what is wrong with each fleet's journal (fleet, seq, prev, hash, at_ms, state)."""
    from pyspark.sql import Window

    count = lambda df, why: df.groupBy("fleet").agg(F.count("*").alias("n")).withColumn("reason", F.lit(why))
    w = Window.partitionBy("fleet").orderBy("seq")
    found = [
        count(S.chain_errors(journal, ["fleet"]).where("not linked"), "CHAIN_INVALID"),
        count(journal.withColumn("before", F.lag("at_ms").over(w)).where("at_ms < before"), "TIME_INVALID"),
        count(J.illegal(journal, ["fleet"], legal), "TRANSITION_INVALID"),
    ]
    if objects is not None:
        by = ["fleet", "kind", "hash"]
        found.append(count(objects.groupBy(*by).agg((F.min("value") != F.max("value")).alias("bad")).where("bad"), "OBJECT_CONFLICT"))
        if references is not None:
            found.append(count(objects.select(*by).distinct().join(references.select(*by), by, "left_anti"), "OBJECT_UNREFERENCED"))
    return reduce(DataFrame.unionByName, found).select("fleet", "reason", "n")
