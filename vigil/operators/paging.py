"""All pages of a journal: greedy runs of entries under a limit of rows and of bytes.

Where a page ends depends on where it began, and so on all pages before.  Within a range of rows, the
end of a page that would begin at any row is found by search on running sums of bytes, and the start of the last
page of the range by following these ends backwards.  Only the first ``limit`` rows of a range can
end the page that was open before it, so these rows, with the last start that each would lead to, are all
that is folded range by range; then each range is told where its first page begins.

An entry's bytes hold those of the objects that it is the first to refer to (a page carries them), so an
entry belongs whole to one page; a page has one entry at least, whatever its size.

Defined cases: no entries give no pages; an entry larger than the budget is a page of its own; entries without
objects count for themselves only; null bytes count as none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators.scans import Dealt


def introduced(references: DataFrame, objects: DataFrame, extra: int = 96) -> DataFrame:
    """(fleet, seq, object_bytes): the objects that each entry is the first to refer to.
    references: fleet, seq, kind, hash; objects: fleet, kind, hash, bytes.  What has no object counts nothing."""
    first = references.groupBy("fleet", "kind", "hash").agg(F.min("seq").alias("seq"))
    return first.join(objects, ["fleet", "kind", "hash"]).groupBy("fleet", "seq").agg(F.sum(F.col("bytes") + extra).cast("bigint").alias("object_bytes"))


def _ends(before: np.ndarray, upto: np.ndarray, limit: int, budget: int) -> np.ndarray:
    """Where a page that begins at each row ends: the position of the next page's first row."""
    n = len(before)
    fit = np.searchsorted(upto, before + budget, "right")
    at = np.arange(n)
    return np.maximum(np.minimum(fit, at + limit), at + 1)


def pages(entries: DataFrame, limit: int = 128, budget: int = 1 << 20) -> DataFrame:
    """(fleet, seq, bytes, page): each entry with the first seq of its page.
    entries: fleet, seq, bytes (with those of its objects)."""
    size = F.coalesce(F.col("bytes").cast("bigint"), F.lit(0))
    dealt = Dealt(entries.select("fleet", "seq", size.alias("bytes")), ["fleet"], ["seq"])
    rows = dealt.prefixes({"before": ("sum", F.col("bytes")), "place": ("sum", F.lit(1).cast("bigint"))})
    rows = rows.withColumn("before", F.coalesce("before", F.lit(0))).withColumn("place", F.coalesce("place", F.lit(0)))

    def summed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("seq")
        before, upto = group["before"].to_numpy(), (group["before"] + group["bytes"]).to_numpy()
        ends, last = _ends(before, upto, limit, budget), np.arange(len(group))
        for i in range(len(group) - 2, -1, -1):
            if ends[i] < len(group):
                last[i] = last[ends[i]]
        some = group.head(limit)[["fleet", "part", "seq", "place"]].copy()
        some["upto"], last = upto[: len(some)], last[: len(some)]
        some["last_place"], some["last_before"], some["rows"] = group["place"].to_numpy()[last], before[last], len(group)
        return some

    heads = rows.groupBy("fleet", "part").applyInPandas(summed, "fleet long, part int, seq long, place long, upto long, last_place long, last_before long, rows long")

    def followed(group: pd.DataFrame) -> pd.DataFrame:
        out, open_place, open_before = [], None, 0
        for part, head in group.sort_values(["part", "seq"]).groupby("part"):
            place, upto = head["place"].to_numpy(), head["upto"].to_numpy()
            breaks = np.flatnonzero((upto - open_before > budget) | (place - open_place >= limit)) if open_place is not None else np.zeros(1, np.int64)
            if len(breaks):
                i = breaks[0]
                out.append((head["fleet"].iloc[0], part, head["seq"].iloc[i]))
                open_place, open_before = head["last_place"].iloc[i], head["last_before"].iloc[i]
            # else the part is shorter than a page and belongs to the open one
        return pd.DataFrame(out, columns=["fleet", "part", "first"])

    # a fleet's ranges, limit rows of each
    first = heads.groupBy("fleet").applyInPandas(followed, "fleet long, part int, first long")

    def marked(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("seq")
        before, upto = group["before"].to_numpy(), (group["before"] + group["bytes"]).to_numpy()
        ends, starts, first = _ends(before, upto, limit, budget), np.zeros(len(group), bool), group["first"].iloc[0]
        if not pd.isna(first):
            i = int(np.searchsorted(group["seq"].to_numpy(), first))
            while i < len(group):
                starts[i] = True
                i = ends[i]
        group["starts"] = starts
        return group[["fleet", "seq", "bytes", "part", "starts"]]

    told = rows.join(F.broadcast(first), ["fleet", "part"], "left")  # a row to a range
    told = told.groupBy("fleet", "part").applyInPandas(marked, "fleet long, seq long, bytes long, part int, starts boolean")
    told = dealt.prefixes({"page": ("max", F.when(F.col("starts"), F.col("seq")))}, inclusive=True, rows=told)
    return told.select("fleet", "seq", "bytes", "page")


def listed(paged: DataFrame) -> DataFrame:
    """(fleet, after_seq, next_seq, entries, bytes, more) of each page."""
    last = paged.groupBy("fleet").agg(F.max("seq").alias("head"))
    per = paged.groupBy("fleet", "page").agg(F.max("seq").alias("next_seq"), F.count("*").alias("entries"), F.sum("bytes").alias("bytes"))
    return per.join(last, "fleet").select("fleet", (F.col("page") - 1).alias("after_seq"), "next_seq", "entries", "bytes", (F.col("next_seq") < F.col("head")).alias("more"))
