"""Benchmark decontamination by pigeonhole edit matching.

A test item may lie in a document with up to k edits, k being a share of its
length.  Cut into k + 1 pieces, at least one piece then lies there unchanged.
All items' pieces are looked for at once (one Aho-Corasick automaton for each
block of items), and around each hit Myers' bit-parallel algorithm finds the
least edit distance of the whole item.  Lower case and single spaces are
compared; positions are in code points of the text so folded.

Defined cases: null or empty texts have no hits, null or blank items match
nothing; items too short for pieces must occur unchanged as whole words;
repeated rows of either table give repeated or equal results.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_column, texts

RATE = 0.05  # edits allowed for each code point of an item
PIECE = 6  # least code points of a piece
BLOCK = 4 << 20  # code points of items that one automaton takes
_SPACES = re.compile(r"\s+")


def folded(text: str | None) -> str:
    return _SPACES.sub(" ", text or "").strip().lower()


def pieces(item: str, rate: float = RATE) -> tuple[int, list[tuple[int, str]]]:
    """(edit budget, [(offset, piece)]) of a folded item."""
    k = min(int(len(item) * rate), max(0, len(item) // PIECE - 1))
    cuts = [i * len(item) // (k + 1) for i in range(k + 2)]
    return k, [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def nearest(item: str, text: str, k: int) -> tuple[int, int] | None:
    """(distance, end) of the closest match of the item anywhere in the text, the
    leftmost of several, if it has at most k edits: Myers' bit vectors."""
    m = len(item)
    at: dict[str, int] = {}
    for i, c in enumerate(item):
        at[c] = at.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, k + 1, -1
    for j, c in enumerate(text):
        eq = at.get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(horizontal | plus) & full
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1, down << 1  # a match can begin at each character
        plus = (down | ~(vertical | up)) & full
        minus = up & vertical & full
        if score < best:
            best, end = score, j + 1
    return (best, end) if best <= k else None


class Items:
    """A block of test items, with the automaton of their pieces."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = [(i, t, *pieces(t, rate)) for i, t in items]
        owners: dict[str, list[tuple[int, int]]] = {}
        for n, (_, _, _, cut) in enumerate(self.items):
            for offset, piece in cut:
                owners.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in owners.items():
            self.automaton.add_word(piece, (len(piece), where))
        if owners:
            self.automaton.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, least distance, its end, its window's start) of each item in the folded text."""
        windows: dict[int, list[list[int]]] = {}
        if len(self.automaton):
            for end, (size, where) in self.automaton.iter(text):
                for n, offset in where:
                    _, item, k, _ = self.items[n]
                    lo = end + 1 - size - offset - k
                    hi = lo + len(item) + 2 * k
                    found = windows.setdefault(n, [])
                    if found and lo <= found[-1][1]:  # windows that overlap are searched as one
                        found[-1] = [min(lo, found[-1][0]), max(hi, found[-1][1])]
                    else:
                        found.append([lo, hi])
        out = []
        for n, found in windows.items():
            which, item, k, cut = self.items[n]
            best = None
            for lo, hi in found:
                lo = max(0, lo)
                if len(cut) == 1:
                    m = re.search(r"(?<!\S)" + re.escape(item) + r"(?!\S)", text[max(0, lo - 1) : hi + 1])
                    got = (0, max(0, lo - 1) + m.end()) if m else None
                else:
                    got = nearest(item, text[lo:hi], k)
                    got = got and (got[0], lo + got[1])
                if got and (best is None or got < best):
                    best = got
            if best:
                out.append((which, best[0], best[1]))
        return sorted(out)


def blocks(benchmark: DataFrame, item: str, text: str) -> list[list[tuple[int, str]]]:
    """The stated set of test items in blocks of bounded size.  The items are a
    curated set that doesn't grow with the corpus."""
    out, size = [[]], 0
    for i, t in sorted((r[0], folded(r[1])) for r in benchmark.select(item, text).toLocalIterator() if r[0] is not None):
        if t:
            if size + len(t) > BLOCK and out[-1]:
                out.append([])
                size = 0
            out[-1].append((i, t))
            size += len(t)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, distance, end): each test item that a document holds, with
    its least edit distance and where that match ends."""
    spark = docs.sparkSession
    plain = docs.select(id_column(docs, doc).alias("doc_id"), "text")
    schema = plain.select("doc_id").schema
    out = None
    for some in blocks(benchmark, "item_id", "text"):
        held = spark.sparkContext.broadcast(some)

        def run(batches, held=held):
            items = Items(held.value, rate)
            for batch in batches:
                rows = []
                for i, t in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                    rows += [(i, *x) for x in items.hits(folded(t.as_py()))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], batch.schema.field(0).type), *(pa.array([r[j] for r in rows], pa.int64()) for j in (1, 2, 3))],
                    names=["doc_id", "item_id", "distance", "end"],
                )

        found = plain.mapInArrow(run, schema.add("item_id", "long").add("distance", "long").add("end", "long"))
        schema = plain.select("doc_id").schema
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The documents that hold no test item, with all their columns, in one pass over the texts."""
    spark = docs.sparkSession
    at = docs.columns.index("text")
    for some in blocks(benchmark, "item_id", "text"):
        held = spark.sparkContext.broadcast(some)

        def run(batches, held=held):
            items = Items(held.value, rate)
            for batch in batches:
                keep = [not items.hits(folded(t.as_py())) for t in texts(batch.column(at))]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


