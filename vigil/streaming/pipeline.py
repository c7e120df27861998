"""Structured Streaming: admission of sequenced arrivals and window results.

Windows lie on receive time, which never goes back, so nothing is dropped for being
late; windows without records exist too and come from the grid when a batch is folded.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vigil.functions.kernels import window_start
from vigil.functions.params import DEFAULT, Params
from vigil.operators.sequence import SCHEMA, STEPS, Fold, _outcomes, _step


def admit_stream(arrivals: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The fold of ``operators.sequence.admit`` with each source's state kept by Spark
    between micro-batches.  arrivals: source, seq, hash, prev, arrival_ms, arrival, terminal."""
    gap = p.gap

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fold = Fold(gap, json.loads(state.get[0]) if state.exists else None)
        rows = pd.concat(list(batches), ignore_index=True)
        out = _outcomes(key[0], rows, fold)
        state.update((json.dumps(fold.s),))
        yield out

    return arrivals.groupBy("source").applyInPandasWithState(run, SCHEMA, "state string", "append", GroupStateTimeout.NoTimeout)


def steps_stream(arrivals: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The same fold with a state that doesn't grow: a source's head and at most ``p.gap``
    buffered entries.  Its rows, appended to a store, are the steps that
    ``operators.sequence.judged`` turns into outcomes, as it does in a batch."""
    gap = p.gap

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fold = Fold(gap, json.loads(state.get[0]) if state.exists else None, history=False)
        rows = pd.concat(list(batches), ignore_index=True).sort_values("arrival")
        out = pd.DataFrame([_step(fold, r) for r in rows.to_dict("records")])
        state.update((json.dumps(fold.s),))
        yield out

    return arrivals.groupBy("source").applyInPandasWithState(run, STEPS, "state string", "append", GroupStateTimeout.NoTimeout)


def running_totals(obs: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Spend of each receive-time window so far, by source (column received_ts: timestamp)."""
    w = F.window("received_ts", f"{p.window_ms} milliseconds")
    return obs.withWatermark("received_ts", "0 seconds").groupBy(w, "source").agg(F.sum("delta").alias("total"), F.count("*").alias("n"))


def finalised(evaluate: Callable[[DataFrame], DataFrame], store: str, results: str, p: Params = DEFAULT, before: int = 11) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: keep a batch of admitted records in ``store`` and write the
    results of the windows that have closed with it (all before the one in which the
    latest record lies; receive time never goes back).

    ``evaluate`` gets the records of those windows and of the ``before`` windows ahead of
    them, which is as far as history reaches.  Each batch notes which earlier batches
    still hold such records, so it reads no more of the store than that, however long the
    stream runs.  A repeated batch replaces its own files.  Results carry ``start_ms``;
    each closed window is written once."""

    def run(batch: DataFrame, number: int) -> None:
        spark, reach = batch.sparkSession, before * p.window_ms
        own = f"{store}/records/batch={number}"
        batch.write.mode("overwrite").parquet(own)
        top = spark.read.schema(batch.schema).parquet(own).agg(F.max(window_start(F.col("received_ms"), p)).alias("open_ms")).first()["open_ms"]
        noted = [tuple(r) for r in spark.read.parquet(f"{store}/open/batch={number - 1}").select("batch", "open_ms").collect()] if number else []  # batches within reach
        closed = max((o for _, o in noted), default=None)
        now = max((x for x in (top, closed) if x is not None), default=None)
        still = [(b, o) for b, o in noted if o >= now - reach] + ([(number, now)] if now is not None else [])
        spark.createDataFrame(still, "batch long, open_ms long").coalesce(1).write.mode("overwrite").parquet(f"{store}/open/batch={number}")
        if now is None or now == closed:
            return
        first = closed if closed is not None else -(2**62)
        paths = [f"{store}/records/batch={b}" for b, o in noted if o >= first - reach] + [own]
        start = window_start(F.col("received_ms"), p)
        kept = spark.read.schema(batch.schema).parquet(*paths).where((start < now) & (start >= first - reach))
        evaluate(kept).where((F.col("start_ms") >= first) & (F.col("start_ms") < now)).write.mode("overwrite").parquet(f"{results}/batch={number}")

    return run


def send_pages(send: Callable[[str, str], int], log: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: send each page (result, page) with its result as idempotency
    key and record the status.  Pages of a batch are sent by the executors."""

    def run(batch: DataFrame, number: int) -> None:
        def post(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield pd.DataFrame({"result": f["result"], "status": [send(r, p) for r, p in zip(f["result"], f["page"])]})

        batch.select("result", "page").mapInPandas(post, "result string, status int").write.mode("overwrite").parquet(f"{log}/batch={number}")

    return run
