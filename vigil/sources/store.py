"""Tables of the engine kept as Parquet: append, scan, and intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; a cluster has to name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="vigil-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/vigil/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` by way of a written table: computed once, and kept when an executor is lost."""
    path = shared(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append(rows: DataFrame, path: str, by: list[str]) -> None:
    """Add rows to the table at ``path``, in folders by the values of ``by``."""
    rows.write.mode("append").partitionBy(*by).parquet(path)


def scan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
