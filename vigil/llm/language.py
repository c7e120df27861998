"""Language identification by fusing evidence.

The text's likelihood in each language comes from byte trigrams (tempered, as
neighbouring trigrams are not independent).  It is combined by Bayes' rule with
the declared markup language and with the prior of the host, which is smoothed
towards that of its address suffix and that towards all documents'.  The priors
are counts, over all documents, of the language that the text alone points to.

A document is rejected if its text has no trigram, if a uniform model explains
its trigrams better than any language, or if the best language is not likely
enough.

Defined cases: null or empty texts have no text evidence and are rejected;
null or unknown declared languages and null hosts give no evidence of their own;
repeated rows are treated alike; with no labelled row at all no language is
known and every document is rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, id_column, saved, slices, tidy

BITS = 16
SAMPLE = 4000  # labelled rows to learn trigrams from at most
TEMPER, MOST = 0.25, 60.0  # weight of a trigram; trigrams' total weight at most
TRUST = 0.9  # share of declared languages that are right
PULL = 20.0  # documents that a prior of the level above counts as
LEAST = 0.5  # posterior to be accepted
HOSTS = 200_000  # hosts whose priors are sent to all tasks; more are joined by shuffling


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def trigrams(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hashed trigram) of all trigrams inside a text whose middle is a
    letter, lower-cased: numbers and signs tell nothing of a language."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    b = _LOWER[data].astype(np.uint32)
    h = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)
    last = np.zeros(len(data) + 1, bool)
    last[starts] = True
    inside = ~(last[1:-2] | last[2:-1])
    at = np.flatnonzero(inside & _LETTER[data[1:-1]])
    return at, (h[at] >> np.uint32(32 - BITS)).astype(np.int64)


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages, their log shares of each trigram) from at most ``sample`` rows with a declared language."""
    rows = docs.where("lang is not null and text is not null").select(F.xxhash64(*docs.columns).alias("row"))
    chosen = rows.orderBy("row").limit(sample).distinct()
    marked = docs.select("lang", "text", F.xxhash64(*docs.columns).alias("row")).join(F.broadcast(chosen), "row").select("lang", "text")

    @tidy
    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            lang = batch.column(0).to_pylist()
            for lo, n, data, starts in slices(batch.column(1)):
                at, gram = trigrams(data, starts)
                doc = np.searchsorted(starts, at, "right") - 1
                for x in set(lang[lo : lo + n]):
                    mine = np.array([y == x for y in lang[lo : lo + n]])
                    total[x] = total.get(x, 0) + np.bincount(gram[mine[doc]], minlength=1 << BITS)
        for x, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at), pa.array(n[at])], names=["lang", "gram", "n"])

    counts = marked.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by: dict[str, np.ndarray] = {}
    for lang, gram, n in counts.toLocalIterator():
        by.setdefault(lang, np.full(1 << BITS, 0.05))[gram] += n
    langs = sorted(by)
    return langs, np.array([np.log(by[x] / by[x].sum()) for x in langs]).reshape(len(langs), 1 << BITS)


def likelihoods(docs: DataFrame, model, declared, host, suffix, keep: list | None = None) -> DataFrame:
    """Narrow rows: the kept columns, declared, host, suffix, grams (count), ll (per language, mean per trigram)."""
    langs, table = model
    held = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(table, np.float32))
    plain = docs.select(*(keep or []), declared.alias("declared"), host.alias("host"), suffix.alias("suffix"), F.col("text").alias("text"))
    schema = plain.drop("text").schema.add("grams", "long")
    ddl = schema.fieldNames()

    @tidy
    def run(batches):
        table = held.value
        for batch in batches:
            for lo, n, data, starts in slices(batch.column(batch.num_columns - 1)):
                at, gram = trigrams(data, starts)
                cuts = np.searchsorted(at, starts)
                sizes = np.diff(cuts)
                ll = np.zeros((n, len(table)))
                for k, t in enumerate(table):
                    ll[:, k] = np.diff(np.concatenate([[0.0], np.cumsum(t[gram], dtype=np.float64)])[cuts])
                ll /= np.maximum(1, sizes)[:, None]
                rest = [c.slice(lo, n) for c in batch.columns[:-1]]
                rows = pa.array(list(ll), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*rest, pa.array(sizes.astype(np.int64)), rows], names=[*ddl, "ll"])

    from pyspark.sql.types import ArrayType, DoubleType

    return plain.mapInArrow(run, schema.add("ll", ArrayType(DoubleType())))


def priors(scored: DataFrame, langs: list[str]) -> DataFrame:
    """(host, suffix, prior): smoothed log shares of the languages on each host."""
    best = F.expr("array_position(ll, array_max(ll))")
    counts = [F.sum(F.when((best == i + 1) & (F.col("grams") > 0), 1.0).otherwise(0.0)).alias(f"c{i}") for i in range(len(langs))]
    hosts = saved(scored.groupBy("host", "suffix").agg(*counts), "hosts")
    sums = [F.sum(f"c{i}").alias(f"s{i}") for i in range(len(langs))]
    suffixes = hosts.groupBy("suffix").agg(*sums)
    top = hosts.agg(*[F.sum(f"c{i}") for i in range(len(langs))]).first()
    top = [x or 0.0 for x in top]
    share = [(x + 1.0) / (sum(top) + len(langs)) for x in top]

    def pulled(name: str, above: list) -> list:
        total = sum((F.col(f"{name}{i}") for i in range(len(langs))), F.lit(0.0))
        return [(F.col(f"{name}{i}") + PULL * above[i]) / (total + PULL) for i in range(len(langs))]

    suffixes = suffixes.select("suffix", *[p.alias(f"p{i}") for i, p in enumerate(pulled("s", [F.lit(x) for x in share]))])
    joined = hosts.alias("h").join(suffixes.alias("u"), F.col("h.suffix").eqNullSafe(F.col("u.suffix")))
    prior = F.array(*[F.log(p) for p in pulled("c", [F.col(f"p{i}") for i in range(len(langs))])])
    joined = saved(joined.select(F.col("h.host").alias("host"), F.col("h.suffix").alias("suffix"), prior.alias("prior")), "priors")
    return F.broadcast(joined) if joined.limit(HOSTS + 1).count() <= HOSTS else joined


def fused(scored: DataFrame, host: DataFrame, langs: list[str]) -> DataFrame:
    """Add lang, posterior and accepted to scored rows; host: the priors of hosts."""
    joined = scored.alias("d").join(host.alias("h"), F.expr("d.host <=> h.host and d.suffix <=> h.suffix")).select("d.*", "h.prior")
    names = F.array(*[F.lit(x) for x in langs])
    other = float(np.log((1 - TRUST) / max(1, len(langs) - 1)))
    said = F.transform(names, lambda x: F.when(~F.array_contains(names, F.coalesce("declared", F.lit(""))), 0.0).when(x == F.col("declared"), float(np.log(TRUST))).otherwise(other))
    weight = F.least(F.col("grams") * TEMPER, F.lit(MOST))
    total = F.zip_with(F.zip_with(F.transform("ll", lambda x: x * weight), "prior", lambda a, b: a + b), said, lambda a, b: a + b)
    out = joined.withColumn("total", total).withColumn("most", F.array_max("total"))
    out = out.withColumn("posterior", 1.0 / F.aggregate("total", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("most"))))
    out = out.withColumn("lang", F.element_at(names, F.expr("array_position(total, most)").cast("int")))
    known = (F.col("grams") > 0) & (F.array_max("ll") > -BITS * float(np.log(2)))
    return out.withColumn("accepted", known & (F.col("posterior") >= LEAST)).drop("ll", "prior", "total", "most")


def report(docs: DataFrame) -> DataFrame:
    """Per document of ``documents`` (declared language lang, host source): its language and whether it is accepted."""
    model = train(docs)
    none = F.lit(None).cast("string")
    if not model[0]:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), none.alias("lang"), F.lit(0.0).alias("posterior"), F.lit(False).alias("accepted"))
    scored = saved(likelihoods(docs, model, F.lower("lang"), F.col("source"), none, [F.col("doc_id").cast("long").alias("doc_id")]), "language")
    return fused(scored, priors(scored, model[0]), model[0]).select("doc_id", "lang", "posterior", "accepted")


def keep_accepted(docs: DataFrame) -> DataFrame:
    """The accepted documents with all their columns, whatever these are named.  The texts
    are read once for the priors and once more to judge each document where it lies."""
    model = train(docs)
    if not model[0]:
        return docs.where("false")
    none = F.lit(None).cast("string")
    host = priors(likelihoods(docs, model, F.lower("lang"), F.col("source"), none), model[0])
    whole = F.struct(*[id_column(docs, c) for c in docs.columns]).alias("row")
    judged = fused(likelihoods(docs, model, F.lower("lang"), F.col("source"), none, [whole]), host, model[0])
    return judged.where("accepted").select("row.*")


def pages_report(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """Per page: its language from the visible text, the html element's lang, the host and
    the address suffix.  A null page has no text and no declared language, a null address no
    host; without a declared document no language is known and every page is rejected."""
    model = train(docs)
    if not model[0]:
        return pages.select("page_id", "url", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("posterior"), F.lit(False).alias("accepted"))
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    declared = F.lower(F.regexp_extract("html", r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1))
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    plain = pages.select("page_id", "url", text.alias("text"), declared.alias("_declared"), host.alias("_host"))
    scored = saved(
        likelihoods(plain, model, F.col("_declared"), F.col("_host"), F.element_at(F.split("_host", r"\."), -1), [F.col("page_id"), F.col("url")]), "language"
    )
    return fused(scored, priors(scored, model[0]), model[0]).select("page_id", "url", "lang", "posterior", "accepted")
