"""Running values and automata over ordered rows, without a task that holds a key.

Rows are dealt out by ranges of (key, order) and written with the number of their range, so a
key that holds a third of all rows lies in many ranges.  What a row needs from the rows
before it is what its own range gives, combined with what the key's earlier ranges give; of the
latter only keys that reach over a range's end need any, so there are at most two rows to a
range, which are broadcast.

``prefixes`` does this for sums, counts, least and greatest values (a ``greatest`` of a struct that
begins with the order is the last value).  ``automata`` does it for state machines: the
transitions of a range are composed into one function from states to states, and these
functions are applied range by range.  A row that the machine refuses changes nothing.

Defined cases: no rows give no rows; null keys are one key; rows of equal key and order are taken in any
order, so ``order`` has to tell rows apart; a null letter is refused in every state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from vigil.sources.store import written


class Dealt:
    """Rows in ranges of (by, order), written; ``rows`` has the column ``part``."""

    def __init__(self, rows: DataFrame, by: list[str], order: list[str]):
        self.by, self.order = by, order
        self.rows = written(rows.repartitionByRange(*by, *order).withColumn("part", F.spark_partition_id()), "dealt")
        #: no key lies in more than one range, so no row needs what other ranges give
        self.apart = self.spanning().isEmpty()

    def _key(self) -> Column:
        return F.struct(*self.by)

    def spanning(self) -> DataFrame:
        """The keys that lie in more than one range: each is the last key of a range and the first of a later one."""
        ends = self.rows.groupBy("part").agg(F.min(self._key()).alias("first"), F.max(self._key()).alias("last"))
        w = Window.orderBy("part")  # a row to a range
        return ends.withColumn("next", F.lead("first").over(w)).where("last <=> next").select("last.*").distinct()

    def _earlier(self, per_part: DataFrame) -> DataFrame:
        """Rows of ``per_part`` (by, part, ...) for keys in several ranges."""
        on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in self.by]
        return per_part.alias("a").join(F.broadcast(self.spanning()).alias("b"), on, "left_semi")

    def _with(self, rows: DataFrame, few: DataFrame, names: list[str], within: tuple[str, ...] = ()) -> DataFrame:
        keys = (*self.by, *within, "part")
        few = few.select(*[F.col(c).alias(f"_{c}") for c in keys], *names)
        on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
        return rows.join(F.broadcast(few), on, "left").drop(*[f"_{c}" for c in keys])

    def prefixes(self, values: dict[str, tuple[str, Column]], inclusive: bool = False, rows: DataFrame | None = None, within: tuple[str, ...] = ()) -> DataFrame:
        """Add to each row, by name, the ``sum``, ``min`` or ``max`` of a column over the rows of its key before it
        (and of itself, if inclusive); null where no row has a value.  rows: these rows with more columns
        (among them ``part``), which the values may name; the result has ``part`` too.  within: columns in which the rows
        before have to agree as well.  They have few values to a key, as what is broadcast has a row to each of a range's; in
        return the rows lie where prefixes of the whole key have left them and aren't dealt out again."""
        rows, by = self.rows if rows is None else rows, [*self.by, *within]
        inside = Window.partitionBy(*by, "part").orderBy(*self.order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        if self.apart:
            return rows.select("*", *(getattr(F, how)(c).over(inside).alias(n) for n, (how, c) in values.items()))
        agg = {n: getattr(F, how) for n, (how, _) in values.items()}
        sums = self._earlier(rows.groupBy(*by, "part").agg(*(agg[n](c).alias(n) for n, (_, c) in values.items())))
        before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        few = sums.select(*by, "part", *(agg[n](n).over(before).alias(f"_{n}") for n in values))
        join = {"sum": lambda a, b: F.when(a.isNull(), b).otherwise(a + F.coalesce(b, F.lit(0))), "max": F.greatest, "min": F.least}
        names, rows = rows.columns, self._with(rows, few, [f"_{n}" for n in values], within)
        both = [join[how](agg[n](c).over(inside), F.col(f"_{n}")).alias(n) for n, (how, c) in values.items()]
        return rows.select(*names, *both)

    def automata(self, letter: str, machines: dict[str, Machine], which: str, rows: DataFrame | None = None) -> DataFrame:
        """Add ``before`` (the state that a row finds) and ``taken`` (whether it was a move).  ``which`` names
        the column that tells the row's machine, which is one for all rows of a key.  rows: as for ``prefixes``."""
        by, rows = self.by, self.rows if rows is None else rows
        spans = self._earlier(rows.select(*dict.fromkeys([*by, "part", *self.order, which, letter]))).repartition("part").sortWithinPartitions("part", *by, *self.order)
        named = list(dict.fromkeys([*by, "part", which]))
        schema = rows.select(*named).schema.add("pre", "string").add("post", "string")
        arrow, kind = to_arrow_schema(schema), named.index(which)

        def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """What a range makes of each state that it changes, in a row of its own; at least one row to a key."""
            at, moves = None, None
            for batch in batches:
                for *now, word in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                    if now != at:
                        if at is not None:
                            yield from _links(at, moves, arrow)
                        at, moves = now, machines[now[kind]].function()
                    moves.then(word)
            if at is not None:
                yield from _links(at, moves, arrow)

        functions = spans.select(*named, letter).mapInArrow(composed, schema)
        first = functions.select(*named).schema.add("_start", "string")
        starts = to_arrow_schema(first)

        def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The state in which each range of a key begins: that of the range before, led on by its links."""
            key, part, state, to = None, None, None, None
            for batch in batches:
                out = []
                for *now, pre, post in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                    here = now[: len(by)]
                    if here != key:
                        key, part, to = here, None, machines[now[kind]].start
                    if now[len(by)] != part:
                        part, state = now[len(by)], to
                        out.append(dict(zip(starts.names, (*now, state))))
                    if pre == state and pre is not None:
                        to = post
                yield pa.RecordBatch.from_pylist(out, schema=starts)

        begun = functions.repartition(*by).sortWithinPartitions(*by, "part").mapInArrow(followed, first)
        names = rows.columns
        started = rows.withColumn("_start", F.lit(None).cast("string")) if self.apart else self._with(rows, begun.select(*by, "part", "_start"), ["_start"])
        told = started.repartition("part").sortWithinPartitions("part", *by, *self.order)
        out = told.select(*names).schema.add("before", "string").add("taken", "boolean")

        def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, state = None, None
            for batch in batches:
                before, taken = [], []
                for *now, start, kind, word in zip(*(batch.column(c).to_pylist() for c in (*by, "part", "_start", which, letter))):
                    machine = machines[kind]
                    if now != at:
                        at, state = now, machine.start if start is None else start
                    to = machine.move(state, word)
                    before.append(state), taken.append(to is not None)
                    state = state if to is None else to
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(before, pa.string()), pa.array(taken, pa.bool_())], names=out.fieldNames())

        return told.mapInArrow(judged, out)


def ascending(rows: DataFrame, by: list[str], order: list[str], item: str) -> DataFrame:
    """(by, ascending): whether the items of each key, in order, are sorted and unique."""
    told = Dealt(rows, by, order).prefixes({"_last": ("max", F.struct(*order, F.col(item).alias("_item")))})
    fine = F.col("_last").isNull() | (F.col("_last._item") < F.col(item))
    return told.groupBy(*by).agg(F.bool_and(F.coalesce(fine, F.lit(False))).alias("ascending"))


def _links(at: list, moves: Function, schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    links = list(moves.links()) or [(None, None)]
    for i in range(0, len(links), size):
        some = links[i : i + size]
        columns = [[v] * len(some) for v in at] + [list(x) for x in zip(*some)]
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, schema)], schema=schema)


class Machine:
    """A state machine: ``move(state, letter)`` is the next state, or None where the letter is refused."""

    def __init__(self, start: str, states: list[str], move: Callable[[str, str], str | None]):
        self.start, self.states = start, states
        self.known: dict[tuple[str, str | None], str | None] = {}
        self._move = move

    def move(self, state: str, letter: str | None) -> str | None:
        if letter is None:
            return None
        key = state, letter
        if key not in self.known:
            self.known[key] = self._move(state, letter)
        return self.known[key]

    def function(self) -> Function:
        return Function(self)


class Function:
    """What letters make of every state of a machine, one letter after another."""

    def __init__(self, machine: Machine):
        self.machine, self.now = machine, {s: s for s in machine.states}

    def then(self, letter: str | None) -> None:
        for s, now in self.now.items():
            to = self.machine.move(now, letter)
            if to is not None:
                self.now[s] = to

    def links(self) -> Iterator[tuple[str, str]]:
        """The states that change, each with what it becomes."""
        return ((s, to) for s, to in self.now.items() if s != to)


class Chain(Machine):
    """Each letter ``pre>post`` leads from exactly one state to another, of any number: links of a chain."""

    def __init__(self, start: str):
        super().__init__(start, [], lambda state, letter: None)

    def move(self, state: str, letter: str | None) -> str | None:
        if letter is None:
            return None
        pre, _, post = letter.partition(">")
        return post if state == pre else None

    def function(self) -> Links:
        return Links(self)


class Links(Function):
    """A function of a chain: the states at which chains were entered, by where they have led so far.

    Where nothing is wrong a range has one chain.  Where links come in another order than they were made in,
    it has about as many as rows; a link finds the ones it leads on by its own state, and the fewer of two that meet move."""

    def __init__(self, machine: Machine):
        self.machine, self.entered, self.at = machine, set(), {}

    def then(self, letter: str | None) -> None:
        if letter is None:
            return
        pre, _, post = letter.partition(">")
        moved = self.at.pop(pre, [])
        if pre not in self.entered:
            self.entered.add(pre)
            moved.append(pre)
        if moved:
            there = self.at.get(post, [])
            few, many = sorted((moved, there), key=len)
            many.extend(few)
            self.at[post] = many

    def links(self) -> Iterator[tuple[str, str]]:
        return ((s, to) for to, states in self.at.items() for s in states if s != to)
