"""Helpers that the operators of this subpackage share.

Texts reach Python in Arrow batches.  ``Words`` hashes all words of a slice of
texts with a few numpy passes, so no Python code runs for each word.
Intermediate tables go to the folder that the session names in
``spark.checkpoint.dir``, which every executor and the driver can read.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE = 1 << 18  # bytes of text that are hashed at a time
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 1 << 20}


def small_batches(spark: SparkSession) -> None:
    """Let the session send texts to Python in Arrow batches of bounded size: a batch is
    held several times, by the JVM and by each worker of an executor."""
    for key, most in BATCH.items():
        now = spark.conf.get(key, None)
        if now is None or not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder that ``spark.checkpoint.dir`` names.  Where it is
    unset, a local session gets a folder of its own; a cluster has to name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="vigil-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/vigil/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and
    keeps what was computed when an executor is lost."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(df: DataFrame) -> None:
    """Remove the files of a table that ``saved`` wrote."""
    spark = df.sparkSession
    paths = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for p in paths:
        if "/vigil/" in p:
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def id_column(df: DataFrame, name: str):
    """A column by its exact name, also where names hold dots."""
    return F.col(f"`{name}`")


def tidy(run):
    """A task's function that gives freed memory back to the system when it ends, as
    Python workers live on between tasks."""

    @wraps(run)
    def with_end(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # another C library
            pass

    return with_end


def texts(column: pa.Array) -> pa.Array:
    """Strings (or binary values) without nulls, with 64-bit offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return column.cast(pa.large_binary()).fill_null(b"")
    return column.cast(pa.large_string()).fill_null("")


def slices(column: pa.Array, size: int = SLICE):
    """(first row, rows, bytes, starts) of runs of texts of about ``size`` bytes;
    starts has one more entry than there are rows."""
    column = texts(column)
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        a, b = int(offsets[lo]), int(offsets[hi])
        yield lo, hi - lo, data[a:b], offsets[lo : hi + 1] - a
        lo = hi


_M = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) | _M(1)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}
KEPT = 1 << 19  # powers of a base that a worker keeps; a longer text gets its own


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, one table per base."""
    if len(_powers.get(base, ())) < n:
        x = np.full(max(1 << 10, 1 << int(n - 1).bit_length()) if n <= KEPT else n, base, np.uint64)
        x[0] = 1
        np.multiply.accumulate(x, out=x)
        if n > KEPT:
            return x
        _powers[base] = x
    return _powers[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.copy()
    x ^= x >> _M(30)
    x *= _M(0xBF58476D1CE4E5B9)
    x ^= x >> _M(27)
    x *= _M(0x94D049BB133111EB)
    x ^= x >> _M(31)
    return x


class Words:
    """All words ``[^\\x20\\x09-\\x0D]+`` of a slice of texts.

    start, end: byte offsets of each word; doc: the row (within the slice) of
    each word; first: index of each row's first word, one entry more than rows;
    hash: 64-bit hash of each word."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, lower: bool = False):
        n = len(data)
        rows = len(starts) - 1
        bytes_ = _LOWER[data] if lower else data
        word = ~_SEPARATOR[data]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        ends = word.copy()
        ends[:-1] &= ~word[1:]
        inner = starts[(starts > 0) & (starts < n)]  # a text's end also ends its last word
        begins[inner] = word[inner]
        ends[inner - 1] = word[inner - 1]
        self.data, self.starts = data, starts
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, starts)
        self.first[-1] = len(self.start)
        self.doc = np.repeat(np.arange(rows), np.diff(self.first))
        if n:
            p = powers(_BASE, n)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(_VALUES[bytes_] * p, out=total[1:])
            inverse = powers(pow(_BASE, -1, 2**64), n)
            self.hash = mix((total[self.end] - total[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64))
        else:
            self.hash = np.zeros(0, np.uint64)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of each run of k words inside one text."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.arange(n - k + 1)
        at = at[self.doc[: n - k + 1] == self.doc[k - 1 :]]
        base = 0xD1342543DE82EF95
        if k <= 8:
            h = np.zeros(len(at), np.uint64)
            for j in range(k):
                h = h * _M(base) + self.hash[at + j]
            return at, mix(h + _M(k))
        p = powers(base, n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hash * p, out=total[1:])
        return at, mix((total[at + k] - total[at]) * powers(pow(base, -1, 2**64), n)[at] + _M(k))


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the smallest node that each linked node reaches.

    ``links``: two long columns a and b; a link with a null joins nothing.  Alternates large-star and small-star
    rounds (each keeps the components and contracts them towards their smallest
    node) until the set of links stays the same.  Each node's smallest
    neighbour is a partial aggregate, so a node with very many links is
    pre-aggregated; each round is written to the shared folder."""
    edges = saved(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name
    )
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u <> v").distinct()
        )
        new = saved(small, name)
        state = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        delete(edges)
        edges = new
        if state == seen:
            break
        seen = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
