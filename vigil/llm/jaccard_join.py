"""N-gram Jaccard join in the metric space of shingle sets, exact.

Documents with equal sets are one point from the start.  Jaccard distance is a
metric, and the join divides the space by pivots and joins the regions:

1. The first pivots are sets of a single shingle.  A set of n shingles lies at
   distance 1 - 1/n from those that it holds and at 1 from all others; ties go by
   one order of all shingles, the corpus's frequent ones last.  A set that is
   within the threshold of another can lack only so many of its shingles, so the
   window that replicates a boundary document takes its first n - ceil(t n) + 1
   regions, and no pair is missed.  With a window longer by e, two sets within the
   threshold meet in at least e + 1 regions: documents that don't meet others in so
   many (for the smallest possible partner) have no partner and go first.
2. In each region a document becomes pivot: the set that most documents share.
   Distances to it are exact; points within the threshold of a pivot are linked to
   it and so to one another, and need no pairs among themselves.
3. The points left open (not linked to their pivot) are joined to the region's
   points inside the windows: sizes, the overlap that is still possible after the
   shingle that they met at, and the triangle inequality over distances to the
   pivots.  Regions with many open points take further pivots, recursively, first.
4. Points of one region that different pivots closed are joined inside the same
   windows, in blocks, where these pivots aren't connected by then.

Links are found up to connection: every pair within the threshold is in one
component, and no pair beyond it is linked.

Defined cases: a null or empty text, or one of white space only, has no shingle
and is linked with nothing; fewer words than a shingle takes are one shingle
together; rows that share a doc_id are one document when it comes to links; a
null doc_id is linked with nothing and has no component.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, components, mix, saved, slices, tidy

HOT_IN_TASK = 4  # documents of one task that a frequent shingle occurs in
HOTTEST = 1 << 18  # frequent shingles that the order puts last
OPEN = 32  # open points of a region that are joined without a further pivot
BLOCK = 1000  # points of a region that meet its other points at a time
ROUNDS = 4  # pivots of a region, each of which has to close a quarter of its open points, before these are joined directly
SENT = 1 << 21  # ids that are sent to all tasks; more are joined by shuffling


def extra(n, least: Fraction):
    """By how many regions windows are longer than one meeting needs; it grows with n."""
    return n * (least.denominator - least.numerator) // (2 * least.denominator) + 1


def shingles(data: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each text, sorted by both, and where each row begins."""
    w = Words(data, starts, lower=True)
    at, h = w.grams(k)
    row = w.doc[at]
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        whole = np.array([_whole(w.hash[w.first[i] : w.first[i + 1]]) for i in short], np.uint64)
        row, h = np.concatenate([row, short]), np.concatenate([h, whole])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    row, h = row[new], h[new]
    return row, h, np.searchsorted(row, np.arange(len(starts)))


def _whole(words: np.ndarray) -> np.uint64:
    h = np.array([len(words)], np.uint64)
    for x in words:
        h = mix(h + x)
    return h[0]


def frequent(docs: DataFrame, k: int, limit: int = HOTTEST) -> np.ndarray:
    """The shingles that most documents hold, counted over all texts; a shingle
    that few documents of every task hold isn't frequent.  At most ``limit``."""

    @tidy
    def run(batches):
        held: dict = {"h": [], "n": []}

        def merge():
            h, at = np.unique(np.concatenate(held["h"]), return_inverse=True)
            return h, np.bincount(at, np.concatenate(held["n"])).astype(np.int64)

        size = 0
        for batch in batches:
            for _, _, data, starts in slices(batch.column(0)):
                _, h, _ = shingles(data, starts, k)
                held["h"].append(h), held["n"].append(np.ones(len(h), np.int64))
                size += len(h)
                if size > 600_000:
                    h, n = merge()
                    over = n > 1  # what has come once in so many is let go
                    held["h"], held["n"], size = [h[over]], [n[over]], int(over.sum())
        if held["h"]:
            h, n = merge()
            over = n >= HOT_IN_TASK
            yield pa.RecordBatch.from_arrays([pa.array(h[over].view(np.int64)), pa.array(n[over])], names=["s", "n"])

    counts = docs.select("text").mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "s").limit(limit).select("s")
    return np.sort(np.array([r[0] for r in top.collect()], np.int64).view(np.uint64))


def points(docs: DataFrame, k: int, least: Fraction, hot: np.ndarray) -> DataFrame:
    """(doc_id, n, h1, h2, first): each document's set size, a 128-bit hash of the
    set, and the shingles of its window in the order."""
    held = docs.sparkSession.sparkContext.broadcast(hot)
    a, b = least.numerator, least.denominator

    @tidy
    def run(batches):
        hot = held.value
        for batch in batches:
            for lo, rows, data, starts in slices(batch.column(1)):
                row, h, cut = shingles(data, starts, k)
                n = np.diff(cut)
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(x)), dtype=np.uint64)]) for x in (0x5BD1E995, 0xC2B2AE35)]
                h1, h2 = ((s[cut[1:]] - s[cut[:-1]]).view(np.int64) for s in sums)
                last = np.zeros(len(h), bool)
                if len(hot) and len(h):
                    last = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h
                order = np.lexsort((h, last, row))
                place = np.arange(len(h)) - cut[row]
                window = place < (n - (-(-n * a // b)) + 1 + extra(n, least))[row]
                # of longs that sort in the order of shingles: the frequent ones last
                place_of = (h >> np.uint64(1)).view(np.int64) + np.where(last, np.int64(0), np.int64(-(2**63)))
                kept = place_of[order][window]
                width = np.bincount(row[window], minlength=rows)
                offsets = np.concatenate([[0], np.cumsum(width)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, rows), pa.array(n.astype(np.int64)), pa.array(h1), pa.array(h2), pa.ListArray.from_arrays(pa.array(offsets), pa.array(kept))],
                    names=["doc_id", "n", "h1", "h2", "first"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, h1 long, h2 long, first array<long>")


def sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(node, set): the sorted shingles of the documents in ``ids`` (doc_id)."""
    small = ids.limit(SENT + 1).count() <= SENT
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")

    @tidy
    def run(batches):
        for batch in batches:
            for lo, rows, data, starts in slices(batch.column(1)):
                _, h, cut = shingles(data, starts, k)
                out = pa.LargeListArray.from_arrays(pa.array(cut.astype(np.int64)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, rows), out.cast(pa.list_(pa.int64()))], names=["node", "set"])

    return some.mapInArrow(run, "node long, set array<long>")


def overlaps(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """(a, b, common, total) of distinct pairs: sizes of intersection and union."""
    pairs = saved(pairs, "pairs")
    small = pairs.limit(SENT + 1).count() <= SENT
    sent = F.broadcast if small else (lambda df: df)  # so that only sets of pairs are shuffled
    one = held.join(sent(pairs), held["node"] == pairs["b"]).select("a", "b", F.col("set").alias("y"))
    other = held.join(sent(pairs.select(F.col("a").alias("node")).distinct()), "node", "left_semi").select(F.col("node").alias("a"), F.col("set").alias("x"))
    both = one.join(other, "a")

    @tidy
    def run(batches):
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            common = np.zeros(batch.num_rows, np.int64)
            total = np.zeros(batch.num_rows, np.int64)
            xs, ys = (np.asarray(c.values).view(np.uint64) for c in (x, y))
            xo, yo = np.asarray(x.offsets), np.asarray(y.offsets)
            for i in range(batch.num_rows):
                p, q = xs[xo[i] : xo[i + 1]], ys[yo[i] : yo[i + 1]]
                at = np.searchsorted(p, q)
                at[at == len(p)] = 0
                common[i] = int((p[at] == q).sum()) if len(p) else 0
                total[i] = len(p) + len(q) - common[i]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common), pa.array(total)], names=["a", "b", "common", "total"])

    # sets are long: small batches keep a worker's memory bounded
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, common long, total long")


def links(spark: SparkSession, docs: DataFrame, classes: DataFrame, k: int, least: Fraction) -> DataFrame:
    """(a, b): links between class representatives that connect all pairs of at
    least the similarity ``least``.  classes: (rep, n, copies, first)."""
    a, b = least.numerator, least.denominator
    close = f"common * {b} >= total * {a}"
    posts = classes.select("rep", "n", "copies", F.posexplode("first").alias("i", "s"))
    smallest = f"((n * {a} + {b - 1}) div {b})"  # partner of a set of n
    meetings = f"({smallest} * {b - a}) div {2 * b} + 2"
    for _ in range(2):  # who goes takes its meetings away from others
        shared = posts.groupBy("s").agg(F.count("*").alias("m")).where("m > 1").select("s")
        posts = saved(posts.join(shared, "s"), "met")
        staying = posts.groupBy("rep", "n").agg(F.count("*").alias("m")).where(f"m >= {meetings}").select("rep", "n")
        posts = posts.join(staying, ["rep", "n"])
    posts = saved(posts.where(f"i <= n - {smallest}"), "windows")
    region = (
        posts.groupBy("s").agg(F.count("*").alias("m"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("sig"))
        .where("m > 1").groupBy("m", "sig").agg(F.min("s").alias("s")).select("s")  # of regions of the same members the first in the order, where a pair among them meets first
    )
    posts = saved(posts.join(region, "s").withColumn("by", F.lit(None).cast("long")), "regions")
    held = saved(sets(docs, posts.select(F.col("rep").alias("doc_id")).distinct(), k), "sets")
    #: both sizes, and what can still be common from the shingle on where two points met, allow the similarity
    window = (
        f"p.n * {b} >= q.n * {a} and q.n * {b} >= p.n * {a} and "
        f"(1 + least(p.n - 1 - p.i, q.n - 1 - q.i)) * {a + b} >= (p.n + q.n) * {a}"
    )
    distances = [f"d{i}" for i in range(ROUNDS)]  # to the region's pivots, where the window let them be measured
    posts = posts.withColumns({d: F.lit(None).cast("double") for d in distances}).withColumn("more", F.lit(True))
    found = None
    for turn in range(ROUNDS):
        active = posts.where("more")
        pivot = active.where("by is null").groupBy("s").agg(F.count("*").alias("m"), F.max(F.struct("copies", (-F.col("rep")).alias("r"), "n", "i")).alias("v"))
        pivot = saved(pivot.select("s", "m", (-F.col("v.r")).alias("rep"), F.col("v.n").alias("n"), F.col("v.i").alias("i")), "pivots")
        met = active.alias("q").join(pivot.alias("p"), "s").select("s", F.col("q.rep").alias("b"), F.col("p.rep").alias("a"), F.expr(window).alias("near"))
        met = saved(met, "met")
        exact = saved(overlaps(met.where("near and a <> b").select("a", "b").distinct(), held), "exact")
        hits = exact.where(close).select("a", "b")
        found = hits if found is None else found.unionByName(hits)
        state = met.select("s", F.col("b").alias("rep"), F.col("a").alias("pivot")).join(
            exact.select(F.col("a").alias("pivot"), F.col("b").alias("rep"), (1 - F.col("common") / F.col("total")).alias("new"), F.expr(close).alias("hit")),
            ["pivot", "rep"], "left",
        )
        judged = active.drop("more").join(state, ["s", "rep"], "left").select(
            "s", "rep", "n", "copies", "i",
            # closed by the first pivot that it is or is linked to
            F.coalesce("by", F.when(F.col("hit") | (F.col("pivot") == F.col("rep")), F.col("pivot"))).alias("by"),
            *(F.when(F.col("pivot") == F.col("rep"), 0.0).otherwise(F.col("new")).alias(d) if i == turn else d for i, d in enumerate(distances)),
        )
        # another pivot where this one has closed a quarter of many; regions whose points one pivot has closed are done
        left = judged.groupBy("s").agg(F.count_if(F.col("by").isNull()).alias("k"), (F.min("by") < F.max("by")).alias("several"))
        left = left.where("k > 0 or several").join(pivot.select("s", "m"), "s")
        left = left.select("s", ((F.col("k") > OPEN) & ((F.col("m") - F.col("k")) * 4 >= F.col("m"))).alias("more"))
        posts = saved(judged.join(left, "s").unionByName(posts.where("not more")), "open")
        if posts.where("more").isEmpty():
            break
    triangle = " and ".join(f"(p.{d} is null or q.{d} is null or abs(p.{d} - q.{d}) <= {float(1 - least) + 1e-9!r})" for d in distances)
    p, q = posts.where("by is null").alias("p"), posts.alias("q")
    rest = p.join(q, F.expr(f"p.s = q.s and p.rep <> q.rep and (q.by is not null or p.rep < q.rep) and {triangle} and {window}"))
    rest = rest.select(F.least("p.rep", "q.rep").alias("a"), F.greatest("p.rep", "q.rep").alias("b"))
    # what different pivots of a region closed, unless the links between the points of such regions connect these pivots
    closed = posts.where("by is not null")
    several = closed.groupBy("s").agg((F.min("by") < F.max("by")).alias("some")).where("some").select("s")
    closed = saved(closed.join(several, "s").drop("copies", "more"), "closed")
    if not closed.isEmpty():
        nodes = closed.select("rep").distinct()
        near = found.join(nodes.withColumnRenamed("rep", "a"), "a", "left_semi").join(nodes.withColumnRenamed("rep", "b"), "b", "left_semi")
        closed = closed.join(components(near).withColumnRenamed("node", "by"), "by", "left").withColumn("side", F.coalesce("component", "by"))
        apart = closed.groupBy("s").agg(F.count("*").alias("m"), (F.min("side") < F.max("side")).alias("some")).where("some")
        closed = saved(closed.join(apart.select("s", F.expr(f"(m - 1) div {BLOCK} + 1").alias("blocks")), "s"), "sides")
        p = closed.withColumn("block", F.expr("pmod(xxhash64(rep), blocks)")).alias("p")
        q = closed.withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)"))).alias("q")
        sides = p.join(q, F.expr(f"p.s = q.s and p.block = q.block and p.side < q.side and {triangle} and {window}"))
        rest = rest.unionByName(sides.select(F.least("p.rep", "q.rep").alias("a"), F.greatest("p.rep", "q.rep").alias("b")))
    found = found.unionByName(overlaps(rest.distinct(), held).where(close).select("a", "b"))
    return found.distinct()


def groups(docs: DataFrame, k: int = 3, least: Fraction = Fraction(9, 10)) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, and n_copies (documents with an equal set)."""
    spark = docs.sparkSession
    every = saved(points(docs, k, least, frequent(docs, k)), "points")
    classes = saved(
        every.where("n > 0 and doc_id is not null").groupBy("h1", "h2").agg(
            F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.count("*").alias("copies"), F.first("first").alias("first")
        ),
        "classes",
    )
    found = saved(links(spark, docs, classes, k, least), "links")
    label = classes.join(components(found).withColumnRenamed("node", "rep"), "rep", "left").select(
        "h1", "h2", F.coalesce("component", "rep").alias("component_id"), F.col("copies").alias("n_copies")
    )
    linked = every.where("n > 0 and doc_id is not null").join(label, ["h1", "h2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_copies")
    alone = every.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("n_copies"))
    return linked.unionByName(alone)




def one_of_each(docs: DataFrame, k: int, least: Fraction) -> DataFrame:
    """The documents, with all their columns, that have the smallest doc_id of their
    group.  Documents without shingles or doc_id stay."""
    gone = groups(docs, k, least).where("doc_id <> component_id").select("doc_id").distinct()
    gone = saved(gone, "gone")
    small = gone.limit(SENT + 1).count() <= SENT
    kept = docs.join(F.broadcast(gone) if small else gone, "doc_id", "left_anti").select(*docs.columns)
    return kept
