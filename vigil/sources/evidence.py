"""Evidence: a journal up to a pinned checkpoint, exported in pages, and read back.

An export is a folder with one sub-folder a fleet, which holds lines in order: a header with the checkpoint, the pages,
a trailer with counts and head.  It is written beside its place and renamed when all tasks have committed and the
bounds are checked, so a lost task or job leaves nothing there.

Defined cases: a pin that the journal doesn't have exports nothing of its fleet; a fleet beyond the size bound, and a place that is
taken, raise an error before anything is written there; reading counts what is missing and never fails on it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators import ledger, paging
from vigil.sources.store import written

FORMAT, CAP = "evidence/1", 12 << 30
_ENTRY = "seq bigint, at_ms bigint, kind string, key string, n1 bigint, n2 bigint, n3 bigint, s1 string, s2 string, s3 string, s4 string, prev string, hash string"
_LINE = f"record string, format string, checkpoint struct<seq: bigint, hash: string>, page struct<after_seq: bigint, next_seq: bigint, more: boolean, entries: array<struct<{', '.join(c.replace(' ', ': ') for c in _ENTRY.split(', ')) }>>>, pages bigint, entries bigint, head struct<seq: bigint, hash: string>"


def lines(journal: DataFrame, pins: DataFrame, limit: int = 128, budget: int = 1 << 20) -> DataFrame:
    """(fleet, place, value): the lines of each pinned fleet, in the order of place."""
    rows = written(ledger.exported(journal, pins), "pinned")
    entry = F.struct("seq", *ledger.MEMBERS, "prev", "hash")
    paged = paging.pages(rows.select("fleet", "seq", (F.octet_length(F.to_json(entry)) + 128).alias("bytes")), limit, budget).select("fleet", "seq", "page")
    heads = rows.groupBy("fleet").agg(F.max(F.struct("seq", "hash")).alias("head"), F.count("*").alias("entries"))
    each = rows.join(paged, ["fleet", "seq"]).groupBy("fleet", "page").agg(F.max("seq").alias("next_seq"), F.array_sort(F.collect_list(entry)).alias("entries"))  # a page's
    page = F.struct((F.col("page") - 1).alias("after_seq"), "next_seq", (F.col("next_seq") < F.col("head.seq")).alias("more"), "entries")
    told = each.join(heads.select("fleet", "head"), "fleet").select("fleet", F.col("page").alias("place"), F.to_json(F.struct(F.lit("page").alias("record"), page.alias("page"))).alias("value"))
    count = each.groupBy("fleet").agg(F.count("*").alias("pages")).join(heads, "fleet")
    first = heads.select("fleet", F.lit(-1).cast("bigint").alias("place"), F.to_json(F.struct(F.lit("header").alias("record"), F.lit(FORMAT).alias("format"), F.col("head").alias("checkpoint"))).alias("value"))
    last = count.select("fleet", F.lit(2**62).alias("place"), F.to_json(F.struct(F.lit("trailer").alias("record"), "pages", "entries", "head")).alias("value"))
    return told.unionByName(first).unionByName(last)


def export(journal: DataFrame, pins: DataFrame, path: str, limit: int = 128, budget: int = 1 << 20, cap: int = CAP) -> None:
    """Write the evidence of the pinned checkpoints (fleet, seq, hash) to ``path``."""
    spark = journal.sparkSession
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = to.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(to):
        raise FileExistsError(path)
    every = written(lines(journal, pins, limit, budget), "lines")
    large = every.groupBy("fleet").agg(F.sum(F.octet_length("value") + 1).alias("bytes")).where(F.col("bytes") > cap).limit(5).collect()
    if large:
        raise ValueError(f"evidence of more than {cap} bytes: fleets {sorted(r.fleet for r in large)}")
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    try:
        every.repartitionByRange("fleet", "place").sortWithinPartitions("fleet", "place").select("fleet", "value").write.partitionBy("fleet").text(beside)
        if not store.rename(spark._jvm.org.apache.hadoop.fs.Path(beside), to):
            raise OSError(f"{path} could not be put in place")
    finally:
        store.delete(spark._jvm.org.apache.hadoop.fs.Path(beside), True)


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entries, summary) of an export.  summary, by fleet: headers, trailers, pages, entries, contiguous (pages follow one another
    from 0, and entries within and across them), complete (all of it is as header and trailer say)."""
    line = spark.read.text(path).select(F.col("fleet").cast("bigint").alias("fleet"), F.from_json("value", _LINE).alias("r")).select("fleet", "r.*")
    pages = line.where("record = 'page'").select("fleet", "page.*")
    entries = pages.select("fleet", "after_seq", "next_seq", F.posexplode("entries").alias("i", "e"))
    whole = entries.groupBy("fleet").agg(F.bool_and((F.col("e.seq") == F.col("after_seq") + 1 + F.col("i")) & (F.col("e.seq") <= F.col("next_seq"))).alias("inside"), F.count("*").alias("n"), F.count_distinct("e.seq").alias("distinct"), F.max("e.seq").alias("last"), F.max(F.struct("e.seq", "e.hash")).alias("top"))
    follow = pages.groupBy("fleet").agg(F.count("*").alias("seen"), F.min("after_seq").alias("first"), F.sum(F.col("next_seq") - F.col("after_seq")).alias("span"), F.max("next_seq").alias("end"))
    ends = line.groupBy("fleet").agg(
        F.count_if((F.col("record") == "header") & (F.col("format") == FORMAT)).alias("headers"), F.count_if(F.col("record") == "trailer").alias("trailers"), F.count_if(~F.coalesce(F.col("record").isin("header", "page", "trailer"), F.lit(False))).alias("others"),
        F.max("checkpoint").alias("pin"), F.max("head").alias("head"), F.max(F.when(F.col("record") == "trailer", F.struct("pages", "entries"))).alias("told"),
    )
    joined = ends.join(whole, "fleet", "left").join(follow, "fleet", "left")
    contiguous = F.coalesce(F.col("inside") & (F.col("first") == 0) & (F.col("span") == F.col("end")) & (F.col("n") == F.col("last")) & (F.col("distinct") == F.col("n")), F.lit(False))
    right = (F.col("headers") == 1) & (F.col("trailers") == 1) & (F.col("others") == 0) & (F.col("told.pages") == F.col("seen")) & (F.col("told.entries") == F.col("n"))
    right = right & (F.col("pin") == F.col("head")) & (F.col("top.seq") == F.col("head.seq")) & (F.col("top.hash") == F.col("head.hash"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    summary = joined.select("fleet", "headers", "trailers", zero(F.col("seen")).alias("pages"), zero(F.col("n")).alias("entries"), contiguous.alias("contiguous"), (contiguous & F.coalesce(right, F.lit(False))).alias("complete"))
    return entries.select("fleet", "e.*"), summary
