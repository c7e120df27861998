"""Substring deduplication by repeated-phrase automata.

A window is 20 consecutive words.  Each window is represented by one phrase of
eight words in it, the one of the least hash, so equal windows are represented by
equal phrases and only phrases that occur twice can lie in a recurring passage.

1. Representing phrases are counted over all texts; those that occur once go.
2. What is left is sent to the tasks as a bit filter of bounded size (a phrase
   that passes by chance only costs windows that are found to be single later).
   Each run of texts is a shard: its recurring phrases are compiled into an
   Aho-Corasick automaton over words, and the run's texts stream through it, which
   confirms the phrases word by word and locates every occurrence.
3. The windows that those phrases represent are grouped by a 64-bit hash of
   their words; the first of each group is found by a partial aggregate, and every
   window that starts after it marks its words.

Defined cases: a null or empty text has no words; rows with a null doc_id neither
lose words nor take them from others; rows that are repeated whole share their
doc_id, so none of them is earlier, and all lose the same words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, id_column, saved, slices, tidy

WINDOW, PHRASE = 20, 8
MOST_BITS = 1 << 28  # of the filter: 32 MB
BITS_EACH = 16
MERGED = 2_000_000  # phrases that a task counts before it sends them on


def least_of(h: np.ndarray, n: int) -> np.ndarray:
    """Index of the least of n neighbours from each place on (the first of equal ones)."""
    best = np.arange(len(h) - n + 1)
    for j in range(1, n):
        at = np.arange(j, j + len(best))
        best = np.where(h[at] < h[best], at, best)
    return best


def represented(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, hash) of each window, and (first word, hash) of the phrase that represents it."""
    at, window = w.grams(WINDOW)
    place, phrase = w.grams(PHRASE)
    if not len(at):
        return at, window, at, window
    # phrases of a text follow each other, so the phrases of a window are neighbours
    best = least_of(phrase, WINDOW - PHRASE + 1)[np.searchsorted(place, at)]
    return at, window, place[best], phrase[best]


def recurring(docs: DataFrame) -> DataFrame:
    """(h): representing phrases that occur more than once in all texts."""

    @tidy
    def run(batches):
        def out(hs, ns):
            h, at = np.unique(np.concatenate(hs), return_inverse=True)
            n = np.bincount(at, np.concatenate(ns)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

        hs, ns, size = [], [], 0
        for batch in batches:
            for _, _, data, starts in slices(batch.column(0)):
                _, _, place, phrase = represented(Words(data, starts))
                new = np.ones(len(place), bool)
                new[1:] = place[1:] != place[:-1]  # neighbouring windows share their phrase
                h, n = np.unique(phrase[new], return_counts=True)
                hs.append(h), ns.append(n)
                size += len(h)
                if size > MERGED:
                    yield out(hs, ns)
                    hs, ns, size = [], [], 0
        if size:
            yield out(hs, ns)

    counts = docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return counts.where("n > 1").select("h")


def bit_filter(phrases: DataFrame) -> np.ndarray:
    """Bits of the phrases, two each, in at most ``MOST_BITS``; the words of bits are
    put together by the executors."""
    bits = 1 << 16
    n = phrases.count()
    while bits < min(MOST_BITS, BITS_EACH * n):
        bits *= 2
    place = F.explode(F.array(F.col("h").bitwiseAND(bits - 1), F.shiftrightunsigned("h", 32).bitwiseAND(bits - 1))).alias("b")
    one = F.expr("shiftleft(1L, cast(b & 63 as int))")
    words = phrases.select(place).groupBy((F.shiftright("b", 6)).alias("w")).agg(F.bit_or(one).alias("v"))
    got = words.toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[got.column("w").to_numpy()] = got.column("v").to_numpy().view(np.uint64)
    return out


def passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    found = np.ones(len(h), bool)
    top = np.uint64(len(bits) * 64 - 1)
    for b in (h & top, (h >> np.uint64(32)) & top):
        found &= (bits[b >> np.uint64(6)] >> (b & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


def spaced(w: Words, keep: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(bytes, start, end): the words to keep with one space after each, or a line feed
    after a text's last one, and where each lies."""
    at = np.flatnonzero(keep)
    size = w.end[at] - w.start[at]
    end = np.cumsum(size + 1) - 1
    start = end - size
    if not len(at):
        return b"", start, end
    source = np.arange(end[-1] + 1) + np.repeat(w.start[at] - start, size + 1)
    out = w.data[np.minimum(source, len(w.data) - 1)]
    doc = w.doc[at]
    out[end] = np.where(np.append(doc[1:] != doc[:-1], True), 10, 32)
    return out.tobytes(), start, end


def located(w: Words, phrases: np.ndarray) -> np.ndarray:
    """Whether each word begins one of the phrases (given by the first word of an
    occurrence), found by an automaton over words.

    Words are told apart by their 64-bit hash.  Each is two letters of alphabets of
    their own, so that matches begin and end with words and no node has many children;
    words of no phrase share the letters of 0."""
    import ahocorasick

    out = np.zeros(len(w.hash), bool)
    if not len(phrases):
        return out
    vocabulary = np.unique(w.hash[(phrases[:, None] + np.arange(PHRASE)).ravel()])
    at = np.minimum(np.searchsorted(vocabulary, w.hash), len(vocabulary) - 1)
    number = np.where(vocabulary[at] == w.hash, at + 1, 0)
    base = int(np.ceil(np.sqrt(len(vocabulary) + 1)))
    text = np.column_stack([number // base, base + number % base]).astype("<u4").tobytes().decode("utf-32-le")
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for i in (2 * phrases).tolist():
        automaton.add_word(text[i : i + 2 * PHRASE])
    automaton.make_automaton()
    ends = np.array([e for e, _ in automaton.iter(text)], np.int64)
    first = (ends + 1) // 2 - PHRASE
    out[first[w.doc[first] == w.doc[first + PHRASE - 1]]] = True  # not across two texts
    return out


def windows(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """(doc_id, start, h): the windows that a recurring phrase represents."""
    held = docs.sparkSession.sparkContext.broadcast(bits)

    @tidy
    def run(batches):
        for batch in batches:
            doc = batch.column(0)
            for lo, n, data, starts in slices(batch.column(1)):
                w = Words(data, starts)
                at, window, place, phrase = represented(w)
                ask = passes(held.value, phrase)
                _, one = np.unique(phrase[ask], return_index=True)
                found = ask & located(w, place[ask][one])[place]
                rows = w.doc[at[found]]
                yield pa.RecordBatch.from_arrays(
                    [doc.take(pa.array(rows + lo)), pa.array((at[found] - w.first[rows]).astype(np.int32)), pa.array(window[found].view(np.int64))],
                    names=["doc_id", "start", "h"],
                )

    plain = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return plain.mapInArrow(run, "doc_id long, start int, h long")


def later(found: DataFrame) -> DataFrame:
    """(doc_id, starts): the windows of each document that an equal one precedes."""
    here = F.struct("doc_id", "start")
    # written, so that both sides of the join are dealt anew and a window with very many occurrences is split
    first = saved(found.groupBy("h").agg(F.min(here).alias("v"), F.count("*").alias("n")).where("n > 1").select("h", "v"), "first")
    rest = found.join(first, "h").where(here != F.col("v"))
    return rest.groupBy("doc_id").agg(F.collect_list("start").alias("starts"))  # of one document only


def removed(docs: DataFrame, text: str = "kept", shown: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the words that are left of each text."""
    bits = bit_filter(saved(recurring(docs), "phrases"))
    # the windows are found twice: that costs less than keeping all of them on disk
    marked = saved(later(windows(docs, bits)), "later")
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), id_column(docs, "text")).join(marked, "doc_id", "left")
    kind = "string" if shown else "binary"

    @tidy
    def run(batches):
        for batch in batches:
            marks = batch.column(2).to_pylist()
            for lo, n, data, starts in slices(batch.column(1)):
                w = Words(data, starts)
                count = np.diff(w.first)
                step = np.zeros(len(w.start) + 1, np.int64)
                for i in range(n):
                    if marks[lo + i]:
                        at = np.array(marks[lo + i]) + w.first[i]
                        np.add.at(step, at, 1)
                        np.add.at(step, at + WINDOW, -1)
                keep = np.cumsum(step[:-1]) == 0
                left = np.bincount(w.doc[keep], minlength=n)
                flat, start, end = spaced(w, keep)
                cut = np.concatenate([[0], np.cumsum(left)])
                out = [flat[start[a] : end[b - 1]] if b > a else b"" for a, b in zip(cut.tolist(), cut[1:].tolist())]
                out = pa.array([x.decode() for x in out], pa.string()) if shown else pa.array([hashlib.sha256(x).digest() for x in out], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array(count), pa.array(count - left), out], names=["doc_id", "n_words", "n_removed", text])

    return joined.mapInArrow(run, f"doc_id long, n_words long, n_removed long, `{text}` {kind}")


def digests(docs: DataFrame) -> DataFrame:
    return removed(docs, "digest", False).select("doc_id", "n_words", "n_removed", F.lower(F.hex("digest")).alias("kept_sha256"))
