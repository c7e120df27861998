"""The corpus pipeline: language, near duplicates, benchmark leaks, secrets, token ids.

Each stage takes (spark, docs, sf_dir), returns a DataFrame, and is written as
Parquet and read again before the next one.  All but the last return the columns
of ``documents``.  The stages' methods can't be expressed in SQL, so ORACLE_SQL is
None and the tests compare each stage with brute force.
"""

from __future__ import annotations

from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import byte_bpe, decontaminate, jaccard_join, language, secrets
from vigil.llm.common import saved, small_batches, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is likely enough stay."""
    small_batches(spark)
    return language.keep_accepted(docs)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five words to a shingle, similarity 0.8 or more."""
    small_batches(spark)
    return jaccard_join.one_of_each(docs, 5, Fraction(8, 10))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret in the texts; no document goes."""
    small_batches(spark)
    to = next(x for i in range(len(docs.columns) + 1) if (x := f"secrets{i}") not in {c.lower() for c in docs.columns})
    clean = secrets.redact(secrets.scan(docs, to=to), secrets=to)
    found = F.size(to) > 0
    return clean.withColumn("n_chars", F.when(found, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def encode_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it."""
    small_batches(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = byte_bpe.round_trip(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        "ids",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        (F.encode(F.coalesce("text", F.lit("")), "UTF-8") == F.col("decoded")).alias("round_trip"),
    )


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", join_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("secret scans", scan_secrets),
    ("byte-level BPE", encode_ids),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs, f"stage{i}")
    return docs
