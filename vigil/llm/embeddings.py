"""Embedding near-duplicates by sorted projection passes.

Each pass gives a vector a string of random-hyperplane bits, orders all vectors of
a label lexicographically by it, and compares each with the next ``WINDOW`` in
that order; pairs of a high enough cosine are united over all passes.  Exact
copies are one vector with a count from the start, so a vector that very many
rows share takes one place in each order.

The pass, label and bits form one sort key, so the order is dealt out by ranges
whatever share of the rows a label has.  Positions are counted within ranges and
offset by the sizes of the ranges before, then cut into blocks that overlap by
the window: results don't depend on how the order was dealt.

Inside each group that the passes connect, links are counted whole however many
vectors crowd a place of the orders: in a large group, vectors within half the
threshold's angle of the group's centre link with one another for certain and are
only counted; all others are compared with the whole group, in blocks of rows against
rows.  Where a vector of a group still has a hit in the last quarter of its
window, the other vectors of that window are compared with the whole group too.

Recall: two vectors of cosine c agree in a bit with chance 1 - acos(c)/pi; the
tests measure recall against brute force.  Pairs below the threshold are never linked.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components, and vectors without a label or vec_id, link with nothing; vectors of
different lengths are never compared; repeated rows count as other vectors; labels
are compared as they are, whatever their type; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, saved

PASSES, WINDOW, BITS, LEAST = 12, 32, 62, 0.98
BLOCK = 480
ROWS = 1000  # vectors of a group that are compared with others at a time
SENT = 10_000  # centres of large groups that are sent to all tasks; more are joined by shuffling


def prepared(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, vec): the vector as little-endian doubles, null where it can't link."""

    def run(batches):
        for batch in batches:
            out = []
            for x in batch.column(2):
                v = None
                if x.is_valid and len(x.values) and not x.values.null_count:
                    v = x.values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0
                    v = v.tobytes() if np.isfinite(v).all() and v.any() else None
                out.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["vec_id", "label", "vec"])

    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return plain.mapInArrow(run, "vec_id long, label string, vec binary")


def units(buffers: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(buffers), "<f8").reshape(len(buffers), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def keyed(classes: DataFrame, passes: int) -> DataFrame:
    """A row of each class for each pass, with the pass's bits as a long."""

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            rep, label, vec = (batch.column(i) for i in range(3))
            sizes = np.array([len(x.as_py()) for x in vec])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                dim = int(size) // 8
                if dim not in planes:
                    planes[dim] = np.random.default_rng(dim).standard_normal((dim, passes * BITS))
                mine = [vec[int(i)].as_py() for i in at]
                bits = (units(mine) @ planes[dim] > 0).reshape(len(at), passes, BITS)
                key = bits.astype(np.int64) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                some = [c.take(pa.array(at)) for c in (rep, label, vec)]
                for p in range(passes):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), p)), some[1], pa.array(np.full(len(at), dim)), pa.array(key[:, p]), some[0], some[2]], names=["pass", "label", "dim", "key", "rep", "vec"])

    return classes.select("rep", "label", "vec").mapInArrow(run, "pass long, label string, dim long, key long, rep long, vec binary")


def pairs(classes: DataFrame, passes: int = PASSES, window: int = WINDOW, least: float = LEAST) -> DataFrame:
    """Distinct (a, b, hit) of class representatives that some pass has compared: those
    found (a < b), and without a hit those where a's hits reach the end of its window, which holds b."""
    order = ["pass", "label", "dim", "key", "rep"]
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed(classes, passes).repartitionByRange(n, *order).sortWithinPartitions(*order)

    def number(batches):
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(m, part)), pa.array(np.arange(at, at + m))], names=[*batch.schema.names, "part", "at"])
            at += m

    dealt = saved(dealt.mapInArrow(number, "pass long, label string, dim long, key long, rep long, vec binary, part long, at long"), "passes")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    placed = dealt.join(F.broadcast(sizes.select("part", "before")), "part").withColumn("pos", F.col("at") + F.col("before"))
    block = F.expr(f"pos div {BLOCK}")
    both = F.when((F.col("pos") % BLOCK < window) & (F.col("pos") >= BLOCK), F.array(block, block - 1)).otherwise(F.array(block))
    blocks = placed.select("pass", "label", "dim", "rep", "vec", "pos", F.explode(both).alias("block"))

    def compare(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        first = key[0] * BLOCK + BLOCK
        found = []
        for _, same in rows.groupby(["pass", "label", "dim"], sort=False):
            x = units(list(same["vec"]))
            head = int((same["pos"] < first).sum())
            i, j = np.nonzero(x[:head] @ x.T >= least)
            near = (j > i) & (j - i <= window)
            i, j = i[near], j[near]
            rep = same["rep"].to_numpy()
            out = np.sort(np.column_stack([rep[i], rep[j]]), 1)
            found.append(pd.DataFrame({"a": out[:, 0], "b": out[:, 1], "hit": True}))
            # one vector for all that its hits connect here, as any of the group will do
            root = np.arange(len(rep))
            while (root[i] != root[j]).any():
                low = np.minimum(root[i], root[j])
                np.minimum.at(root, i, low), np.minimum.at(root, j, low)
            edge = np.unique(i[j - i > window - max(1, window // 4)])
            x, y = (z.ravel() for z in np.broadcast_arrays(edge[:, None], edge[:, None] + np.arange(1, window + 1)))
            x, y = x[y < len(rep)], y[y < len(rep)]
            apart = root[x] != root[y]
            found.append(pd.DataFrame({"a": rep[root[x[apart]]], "b": rep[y[apart]], "hit": False}))
        return pd.concat(found).drop_duplicates()

    return blocks.groupBy("block").applyInPandas(compare, "a long, b long, hit boolean").distinct()


def crowded(classes: DataFrame, seen: DataFrame, groups: DataFrame, least: float) -> DataFrame:
    """(a, b): links between groups and the vectors that only met the end of a window
    there, one for each block of the group at least."""
    told = groups.select(F.col("node").alias("rep"), "component")
    asked = (
        seen.where("not hit").join(told.select(F.col("rep").alias("a"), "component"), "a")
        .join(told.select(F.col("rep").alias("b"), F.col("component").alias("own")), "b", "left")
        .where("own is null or own <> component").select("component", "b").distinct()
    )
    asked = saved(asked, "asked")
    sizes = told.join(asked.select("component").distinct(), "component", "left_semi").groupBy("component").agg(F.expr(f"(count(*) - 1) div {ROWS} + 1").alias("blocks"))
    askers = asked.groupBy("component").agg(F.expr(f"(count(*) - 1) div {ROWS} + 1").alias("turns"))
    cuts = saved(sizes.join(askers, "component"), "cuts")
    vecs = classes.select("rep", "vec")
    inside = told.join(cuts, "component").join(vecs, "rep").select(
        "component", F.expr("pmod(xxhash64(rep), blocks)").alias("block"), F.explode(F.expr("sequence(0L, turns - 1)")).alias("turn"), "rep", "vec", F.lit(False).alias("asks"))
    outside = asked.join(cuts, "component").join(vecs, asked["b"] == vecs["rep"]).select(
        "component", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"), F.expr("pmod(xxhash64(b), turns)").alias("turn"), "rep", "vec", F.lit(True).alias("asks"))

    def compare(key, rows: pd.DataFrame) -> pd.DataFrame:
        asks = rows["asks"].to_numpy()
        rep = rows["rep"].to_numpy()
        if asks.all() or not asks.any():
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        hit = units(list(rows["vec"][asks])) @ units(list(rows["vec"][~asks])).T >= least
        some = hit.any(1)
        return pd.DataFrame({"a": rep[~asks][hit.argmax(1)[some]], "b": rep[asks][some]})

    return inside.unionByName(outside).groupBy("component", "block", "turn").applyInPandas(compare, "a long, b long")


def cored(told: DataFrame, least: float) -> DataFrame:
    """Add core: whether a vector of a large group lies within half the threshold's angle
    of the group's centre, so that it links with all others that do."""
    large = told.groupBy("component").agg(F.count("*").alias("m")).where(f"m > {ROWS}").select("component")
    members = told.join(large, "component", "left_semi").select("component", "vec")

    def summed(batches):
        for rows in batches:
            for component, same in rows.groupby("component", sort=False):
                yield pd.DataFrame({"component": [component], "total": [units(list(same["vec"])).sum(0).tolist()]})

    parts = members.mapInPandas(summed, "component long, total array<double>").select("component", F.posexplode("total").alias("i", "x"))
    centre = parts.groupBy("component", "i").agg(F.sum("x").alias("x")).groupBy("component").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("c"))
    centre = saved(centre.select("component", F.transform("c", lambda e: e["x"]).alias("centre")), "centres")
    sent = F.broadcast(centre) if centre.limit(SENT + 1).count() <= SENT else centre
    near = float(np.cos(np.arccos(least) / 2 - 1e-9))

    def judge(batches):
        for rows in batches:
            core = np.zeros(len(rows), bool)
            known = np.flatnonzero(rows["centre"].notna().to_numpy())
            for _, at in rows.iloc[known].groupby("component", sort=False).indices.items():
                at = known[at]
                c = np.array(rows["centre"].iloc[at[0]])
                core[at] = units(list(rows["vec"].iloc[at])) @ (c / max(1e-300, float(np.sqrt(c @ c)))) >= near
            yield rows.drop(columns="centre").assign(core=core)

    joined = told.join(sent, "component", "left").select("component", "rep", "n", "vec", "centre")
    return joined.mapInPandas(judge, "component long, rep long, n long, vec binary, core boolean")


def counted(classes: DataFrame, groups: DataFrame, least: float) -> DataFrame:
    """(rep, others): the rows of other classes of the same group that each class links with."""
    told = saved(groups.select(F.col("node").alias("rep"), "component").join(classes.select("rep", "n", "vec"), "rep"), "groups")
    told = saved(cored(told, least), "cores")
    stats = told.groupBy("component").agg(
        F.expr(f"(count_if(core) + {ROWS - 1}) div {ROWS}").alias("inner"), F.expr(f"(count_if(not core) + {ROWS - 1}) div {ROWS}").alias("outer"),
        F.coalesce(F.sum(F.when(F.col("core"), F.col("n"))), F.lit(0)).alias("core_n"),
    )
    small = max(1, told.count() // ROWS)  # small groups share a task's call
    told = told.join(stats, "component")
    core = told.where("core").select("rep", (F.col("core_n") - F.col("n")).alias("others"))
    placed = told.withColumn("block", F.expr("if(core, pmod(xxhash64(rep), inner), inner + pmod(xxhash64(rep), outer))"))
    placed = placed.where("outer > 0").withColumn("other", F.explode(F.expr("sequence(if(core, inner, 0L), inner + outer - 1)"))).select(
        "component", "rep", "n", "vec", "block",
        F.when(F.expr("inner + outer = 1"), F.expr(f"-1 - pmod(xxhash64(component), {small})")).otherwise(F.col("component")).alias("place"),
        F.expr("inner + outer > 1").alias("large"), F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
    )

    def compare(key, rows: pd.DataFrame) -> pd.DataFrame:
        _, _, lo, hi = key
        found = []
        for _, same in rows.groupby("component", sort=False):
            n, rep, x = same["n"].to_numpy(), same["rep"].to_numpy(), units(list(same["vec"]))
            if lo == hi:
                hit = x @ x.T >= least
                np.fill_diagonal(hit, False)
                found.append((rep, hit @ n))
            else:
                first = (same["block"] == lo).to_numpy()
                hit = x[first] @ x[~first].T >= least
                found += [(rep[first], hit @ n[~first]), (rep[~first], n[first] @ hit)]
        rep, others = (np.concatenate(z).astype(np.int64) for z in zip(*found))
        return pd.DataFrame({"rep": rep, "others": others})

    outer = placed.groupBy("large", "place", "lo", "hi").applyInPandas(compare, "rep long, others long")
    return outer.unionByName(core).groupBy("rep").agg(F.sum("others").alias("others"))


def near_duplicates(vectors: DataFrame, passes: int = PASSES, window: int = WINDOW, least: float = LEAST) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept."""
    ready = saved(prepared(vectors), "vectors")
    usable = "vec is not null and label is not null and vec_id is not null"
    classes = saved(ready.where(usable).groupBy("label", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "classes")
    seen = saved(pairs(classes, passes, window, least), "pairs")
    found = seen.where("hit").select("a", "b")
    groups = components(found)
    more = saved(crowded(classes, seen, groups, least), "crowded")
    if not more.isEmpty():
        groups = components(found.unionByName(more))
    links = saved(counted(classes, groups, least), "counted")
    known = (
        classes.join(links, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
        .select("label", "vec", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    linked = ready.where(usable).join(known, ["label", "vec"]).select("vec_id", "n_links", "component_id")
    alone = ready.where(f"not ({usable})").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
