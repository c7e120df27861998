"""Importance resampling towards a target distribution, over hashed word runs.

A text's features are its runs of 1 to n consecutive words, hashed into buckets.  A
bucket's gain is the log of how much likelier the target makes it than the corpus (both
smoothed by one), a document's weight is the sum of its features' gains, and adding
Gumbel noise to the weights and keeping the highest draws without replacement.

Long texts are skewed work, so a text of more than ``CHUNK`` bytes is cut at word
boundaries into chunks, which are written to the shared folder and dealt out evenly; each
but the first begins with the n - 1 words before it (the carry).  A chunk owns the runs that
end behind its carry, so every run of the text belongs to one chunk; chunks' counts and
weights are then summed by document.  Short texts are a chunk each and aren't shuffled.

A document is known by its id and the hash of its text; equal rows are counted and
weighed once each, and told apart only in the last step.

Defined cases: a null text, an empty one and one without words have no features, weight 0
and aren't drawn; a very long text is handled in chunks, none of it is left out; rows of
equal score and doc_id (repeated rows) get different ranks; a null doc_id is noise of its
own ("null") and comes last among ties; empty tables give empty results (an empty target
gives gains from the corpus alone); other columns, whatever their names, play no part.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_column, saved, small_batches, texts, tidy

BUCKETS = 10_000
WORDS = 1  # longest run
SEED = 2024
LEAST = 20  # words of a document that can be drawn
SHARE = 10  # of 100 documents with enough words are drawn
CHUNK = 1 << 16  # bytes of a text that is not cut; a cut goes to the next word boundary
CACHED = 1 << 18  # runs whose bucket a task remembers

#: Words in UTF-8: every byte beyond ASCII belongs to a word.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


class Hashed(dict):
    """Bucket of each run of words."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, run: bytes) -> int:
        if len(self) > CACHED:
            self.clear()
        to = self[run] = zlib.crc32(run) % self.buckets
        return to


def features(text: bytes, n: int, carry: int, hashed: Hashed) -> tuple[np.ndarray, int]:
    """(bucket of each run that ends behind the first ``carry`` words, words behind them)."""
    words = _WORD.findall(text.translate(_LOWER))
    own = len(words) - carry
    found = [np.fromiter(map(hashed.__getitem__, words[carry:]), np.int64, own)]
    for k in range(2, n + 1):
        runs = [b" ".join(words[i - k + 1 : i + 1]) for i in range(max(carry, k - 1), len(words))]
        found.append(np.fromiter(map(hashed.__getitem__, runs), np.int64, len(runs)))
    return np.concatenate(found), own


def cut(text: bytes, n: int, size: int):
    """(chunk, words of its carry) of a text; chunks own about ``size`` bytes each."""
    lower = text.translate(_LOWER)
    at, back = 0, []  # the chunk's begin, and where the last n - 1 words before it begin
    while True:
        end = min(len(text), at + size)
        if end < len(text) and _WORD.match(lower, end - 1) and (inside := _WORD.match(lower, end)):
            end = inside.end()
        yield text[back[0] if back else at : end], len(back)
        if end == len(text):
            return
        if n > 1:
            back = (back + [m.start() for m in _WORD.finditer(lower, at, end)])[1 - n :]
        at = end


def chunks(docs: DataFrame, n: int, size: int) -> DataFrame:
    """(doc_id, same, chunk, carry, text): the texts as chunks; same is the text's hash."""
    plain = docs.select(id_column(docs, "doc_id").cast("long").alias("doc_id"), F.coalesce(id_column(docs, "text").cast("string"), F.lit("")).alias("text"))
    plain = plain.withColumn("same", F.sha2("text", 256))
    short = plain.where(F.octet_length("text") <= size).select("doc_id", "same", F.lit(0).alias("chunk"), F.lit(0).alias("carry"), F.encode("text", "UTF-8").alias("text"))

    @tidy
    def run(batches):
        for batch in batches:
            for i, same, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2))):
                for k, (part, carry) in enumerate(cut(text.as_py().encode(), n, size)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i], pa.int64()), pa.array([same]), pa.array([k], pa.int32()), pa.array([carry], pa.int32()), pa.array([part], pa.binary())],
                        names=["doc_id", "same", "chunk", "carry", "text"],
                    )

    long = plain.where(F.octet_length("text") > size).select("doc_id", "same", "text").mapInArrow(run, "doc_id long, same string, chunk int, carry int, text binary")
    return short.unionByName(saved(long.repartition("doc_id", "same", "chunk"), "chunks"))


def counted(parts: DataFrame, n: int, buckets: int) -> DataFrame:
    """(bucket, n): features in each bucket, counted in every task first."""

    @tidy
    def run(batches):
        hashed, total = Hashed(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for text, carry in zip(batch.column(0), batch.column(1).to_pylist()):
                total += np.bincount(features(text.as_py(), n, carry, hashed)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return parts.select("text", "carry").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Gain of each bucket, in thousandths; the counts are at most one row a bucket."""
    s, t = np.zeros(buckets, object), np.zeros(buckets, object)
    for counts, to in ((corpus, s), (target, t)):
        for r in counts.toLocalIterator():
            to[r["bucket"]] = int(r["n"])
    all_s, all_t = int(s.sum()), int(t.sum())
    return np.array([math.floor(1000 * math.log((int(b) + 1) * (all_s + buckets) / ((int(a) + 1) * (all_t + buckets)))) for a, b in zip(s, t)], np.int64)


def weighed(parts: DataFrame, gain: np.ndarray, n: int) -> DataFrame:
    """(doc_id, same, copies, n_features, n_words, weight): sums over the chunks of each
    document; copies is how many rows are equal, and the others are of one row."""
    buckets = len(gain)

    @tidy
    def run(batches):
        hashed = Hashed(buckets)
        for batch in batches:
            found = [features(text.as_py(), n, carry, hashed) for text, carry in zip(batch.column(4), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(3)),
                    pa.array([len(x) for x, _ in found], pa.int64()),
                    pa.array([w for _, w in found], pa.int64()),
                    pa.array([int(gain[x].sum()) for x, _ in found], pa.int64()),
                ],
                names=["doc_id", "same", "chunk", "n_features", "n_words", "weight"],
            )

    each = parts.select("doc_id", "same", "chunk", "carry", "text").mapInArrow(run, "doc_id long, same string, chunk int, n_features long, n_words long, weight long")
    sums = each.groupBy("doc_id", "same").agg(F.count_if(F.col("chunk") == 0).alias("copies"), *(F.sum(c).alias(c) for c in ("n_features", "n_words", "weight")))
    return sums.select("doc_id", "same", "copies", *(F.expr(f"{c} div copies").alias(c) for c in ("n_features", "n_words", "weight")))


def scored(weights: DataFrame, seed: int) -> DataFrame:
    """Add the score: the weight and Gumbel noise from the document's id, in thousandths."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return weights.withColumn("score", F.col("weight") + noise)


def ranked(rows: DataFrame, order: list, copies: str = "copies") -> DataFrame:
    """Add ``before``: the copies in all rows ahead of a row in the given order.  The rows are
    dealt out by ranges of the order and written; the sums of the ranges are as few as
    the partitions, and within a range a window runs."""
    parts = saved(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranked")
    sums = parts.groupBy("part").agg(F.sum(copies).alias("in_part"))
    ahead = sums.select("part", (F.sum("in_part").over(Window.orderBy("part")) - F.col("in_part")).alias("ahead"))
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        parts.withColumn("inside", F.coalesce(F.sum(copies).over(within), F.lit(0)))
        .join(F.broadcast(ahead), "part")  # a row for each partition
        .withColumn("before", F.col("inside") + F.col("ahead"))
        .drop("part", "inside", "ahead")
    )


def resample(
    docs: DataFrame, target: DataFrame, n: int = WORDS, buckets: int = BUCKETS, seed: int = SEED, least: int = LEAST, share: int = SHARE, size: int = CHUNK
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row of ``docs``: rank counts from 1
    in the order of the draw, and is null for rows that aren't drawn."""
    small_batches(docs.sparkSession)
    parts = chunks(docs, n, size)
    gain = gains(counted(parts, n, buckets), counted(chunks(target.withColumn("doc_id", F.lit(0)), n, size), n, buckets), buckets)
    rows = saved(scored(weighed(parts, gain, n), seed), "weights")
    fit = rows.where(F.col("n_words") >= least)
    draw = (fit.agg(F.sum("copies")).first()[0] or 0) * share // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("same")]
    drawn = ranked(fit, order).withColumn("first", F.col("before") + 1)
    rest = rows.where(F.col("n_words") < least).withColumn("first", F.lit(None).cast("long"))
    every = drawn.select(*rest.columns).unionByName(rest)
    every = every.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    at = F.col("first") + F.col("copy")
    return every.select("doc_id", "n_features", "weight", "score", F.when(at <= draw, at).alias("rank"))


def drawn(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns.  A repeated row stays
    as often as it is drawn; ids are taken to tell documents with different texts apart."""
    name = next(x for i in range(len(docs.columns) + 1) if (x := f"drawn{i}") not in {c.lower() for c in docs.columns})
    ids = resample(docs, target, **how).where("rank is not null").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(ids, id_column(docs, "doc_id").cast("long").eqNullSafe(F.col(name)), "left_semi")
