"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Both tokenizers cut a text's bytes into tokens.  Where both end a token at the same byte, a
group ends; inside a group, tokens of the two whose bytes overlap are linked.  Two pointers
that walk over both lists of token ends give groups and links in one pass.

No token of either crosses a place where a space follows something that isn't white space, so
both cut there and a group ends there.  Each distinct segment between such places is therefore
tokenized and merged once, and a document is the sum of its segments.

Documents are gathered into blocks of ``BLOCK`` bytes of text (a longer document is a block of
its own), which are written to the shared folder: a row per document with its links as positions
in the block's list of distinct id pairs, and a row per block with that list and how many of
its documents hold each pair.  Spark sums these rows up by pair, finds the highest count of each A id,
and joins both back to the blocks' pairs; the answers of a block go to its documents.  So a
pair is shuffled once a block, not once a document, and the most common pair is one row of each block.

Defined cases: texts that are null, empty, or that don't come back as a space and themselves from
both tokenizers' bytes (such as those that hold U+2581) have no tokens: zeros and an empty
groups_sha256; very long texts are aligned whole; repeated rows each count as a document; null ids
stay; ties for the highest count all count; an empty table gives an empty result; other
columns, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_column, saved, small_batches

BLOCK = 8 << 20  # bytes of text in a block
CACHED = 300_000  # distinct segments that a task keeps for its next block
STEP = 1 << 17  # new segments that are tokenized at a time
PAIR = 1 << 16  # an id pair is a * PAIR + b, so ids of B lie below it

STORED = (
    "block long, doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, gaps binary, times binary, pairs array<long>, holders array<long>"
)

#: Where a cut before a space could part white space that belongs together.
_UNCUT = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")


def segments(text: str) -> list[str]:
    """A text that begins with a space, cut before each space that follows something that isn't white space."""
    if _UNCUT.search(text) is None:
        return [" " + x for x in text.split(" ")[1:]]
    return _CUT.split(text)


@lru_cache(2)
def tokenizers(a: str, b: str):
    """(A, B, bytes of each id of A, bytes of each id of B)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
    import sentencepiece
    from tokenizers import Tokenizer, pre_tokenizers

    left = Tokenizer.from_file(a)
    left.encode_special_tokens = True
    # the printable characters stand for themselves and the others, in order, for the characters from 256 on
    letters = sorted(pre_tokenizers.ByteLevel.alphabet())
    own = [ord(x) for x in letters if ord(x) < 256]
    byte = dict(zip(map(chr, own), own)) | dict(zip((x for x in letters if ord(x) >= 256), (x for x in range(256) if x not in own)))
    of_a = {i: bytes(map(byte.__getitem__, t)) if all(c in byte for c in t) else t.encode() for t, i in left.get_vocab(with_added_tokens=True).items()}
    right = sentencepiece.SentencePieceProcessor(model_file=b)
    n = right.get_piece_size()
    if n > PAIR:
        raise ValueError(f"the second tokenizer has more than {PAIR} ids")
    of_b = [bytes([int(right.id_to_piece(i)[3:5], 16)]) if right.is_byte(i) else right.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
    return left, right, of_a, of_b


class Segments:
    """What is known of distinct segments: their groups as text, their numbers of tokens of A, of B and of
    groups, and their linked pairs.  A task keeps one over its blocks, until it holds ``CACHED`` segments."""

    def __init__(self, a: str, b: str):
        self.left, self.right, self.of_a, self.of_b = tokenizers(a, b)
        self.size_a, self.size_b = {i: len(x) for i, x in self.of_a.items()}, list(map(len, self.of_b))
        self.names_a, self.names_b = {i: str(i) for i in self.of_a}, list(map(str, range(len(self.of_b))))
        self.at: dict[str, int] = {}
        self.groups: list[str] = []
        self.bad: set[int] = set()  # those whose bytes don't come back
        self.numbers: list[tuple[int, int, int, int]] = []
        self.pairs: list[np.ndarray] = []  # of all segments, one after the other

    def learn(self, new: list[str]) -> None:
        of_a, of_b = self.of_a.__getitem__, self.of_b.__getitem__
        for lo in range(0, len(new), STEP):
            some = new[lo : lo + STEP]
            left = [e.ids for e in self.left.encode_batch_fast(some, add_special_tokens=False)]
            right = self.right.encode([s[1:] for s in some], num_threads=1)  # B adds the space itself, but not to nothing
            right = [b if s != " " else [self.right.piece_to_id("▁")] for s, b in zip(some, right)]
            for i, (s, a, b) in enumerate(zip(some, left, right)):
                self.at[s] = len(self.at)
                if not (a and b and "▁" not in s and b"".join(map(of_a, a)) == s.encode() == b"".join(map(of_b, b))):
                    self.bad.add(self.at[s])
                    left[i], right[i] = [], []
            self._merge(left, right)

    def _merge(self, left: list[list[int]], right: list[list[int]]) -> None:
        """Two pointers go over the ends of all these segments' tokens, first those of the first segment; a
        segment's end is one that both tokenizers have."""
        size_a, size_b, name_a, name_b = self.size_a, self.size_b, self.names_a.__getitem__, self.names_b.__getitem__
        pairs: list[int] = []
        for a, b in zip(left, right):
            first, out, i, j, from_a, from_b = len(pairs), [], 0, 0, 0, 0
            if a:
                names_a, names_b = list(map(name_a, a)), list(map(name_b, b))
                x, y = a[0], b[0]
                end_a, end_b = size_a[x], size_b[y]
                pairs.append(x * PAIR + y)
                while True:
                    if end_a == end_b:
                        i, j = i + 1, j + 1
                        out.append(f"{','.join(names_a[from_a:i])}|{','.join(names_b[from_b:j])}")
                        if i == len(a):
                            break
                        from_a, from_b, x, y = i, j, a[i], b[j]
                        end_a, end_b = end_a + size_a[x], end_b + size_b[y]
                    elif end_a < end_b:
                        i += 1
                        x = a[i]
                        end_a += size_a[x]
                    else:
                        j += 1
                        y = b[j]
                        end_b += size_b[y]
                    pairs.append(x * PAIR + y)
            self.groups.append(";".join(out))
            self.numbers.append((len(a), len(b), len(out), len(pairs) - first))
        self.pairs.append(np.array(pairs, np.int64))


class Block:
    """Documents that are aligned together."""

    def __init__(self, known: Segments):
        self.known = known
        self.docs: list[tuple[str | None, np.ndarray | None]] = []
        self.size = 0

    def add(self, ids: list, texts: list[str | None]) -> None:
        known = self.known
        cuts = [segments(" " + t) if t else [] for t in texts]
        known.learn([x for x in dict.fromkeys(x for c in cuts for x in c) if x not in known.at])
        for i, t, c in zip(ids, texts, cuts):
            at = list(map(known.at.__getitem__, c))
            self.docs.append((i, np.array(at, np.int64) if c and known.bad.isdisjoint(at) else None))
            self.size += len(t or "")

    def rows(self, block: int) -> pd.DataFrame:
        """The block's rows in the form of ``STORED``."""
        known = self.known
        numbers = np.array(known.numbers, np.int64).reshape(-1, 4)
        begin = np.concatenate(([0], np.cumsum(numbers[:, 3])))
        used = np.unique(np.concatenate([np.zeros(0, np.int64), *(at for _, at in self.docs if at is not None)]))
        each = numbers[used, 3]
        ends = np.cumsum(each)
        every = np.concatenate([np.zeros(0, np.int64), *known.pairs])[_runs(begin[used], each, ends)]
        pairs, where = np.unique(every, return_inverse=True)
        begin[used] = ends - each  # from here on into ``where``
        holders, out = np.zeros(len(pairs), np.int64), []
        for i, at in self.docs:
            if at is None:
                out.append((block, i, 0, 0, 0, 0, "", b"", b"", None, None))
                continue
            n_a, n_b, n_groups, n_links = numbers[at].sum(0).tolist()
            each = numbers[at, 3]
            held, times = np.unique(where[_runs(begin[at], each, np.cumsum(each))], return_counts=True)
            holders[held] += 1
            digest = hashlib.sha256(";".join(map(known.groups.__getitem__, at.tolist())).encode()).hexdigest()
            out.append((block, i, n_a, n_b, n_groups, n_links, digest, *packed(held, times), None, None))
        out.append((block, None, None, None, None, None, None, None, None, pairs, holders))
        return pd.DataFrame(out, columns=[c.split()[0] for c in STORED.split(", ")])


def _runs(begin: np.ndarray, each: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions of runs one after the other: ``each`` positions from ``begin`` on."""
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + each, each)


def packed(held: np.ndarray, times: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending positions as gaps of 16 bits and how often each is held in 8 bits; a wider gap goes
    in steps that are held 0 times, and more than 255 times in entries of gap 0."""
    gaps = np.diff(held, prepend=0)
    if gaps.max(initial=0) < 1 << 16 and times.max(initial=0) < 1 << 8:
        return gaps.astype("<u2").tobytes(), times.astype(np.uint8).tobytes()
    to, n = [], []
    for g, t in zip(gaps.tolist(), times.tolist()):
        to += [65535] * (g // 65535) + [g % 65535]
        n += [0] * (g // 65535) + [min(t, 255)]
        while t > 255:
            t -= 255
            to.append(0)
            n.append(min(t, 255))
    return np.array(to, "<u2").tobytes(), np.array(n, np.uint8).tobytes()


def unpacked(gaps: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(np.frombuffer(gaps, "<u2").astype(np.int64)), np.frombuffer(times, np.uint8).astype(np.int64)


def blocks(docs: DataFrame, a: str, b: str) -> DataFrame:
    """The rows of ``STORED``, written: groups and links of all documents."""
    small_batches(docs.sparkSession)
    # pandas would turn whole numbers with nulls among them into doubles
    plain = docs.select(id_column(docs, "doc_id").cast("string").alias("doc_id"), id_column(docs, "text").cast("string").alias("text"))

    def run(batches):
        from pyspark import TaskContext

        number, held, known = TaskContext.get().partitionId() << 32, None, Segments(a, b)
        for batch in batches:
            held = held or Block(known)
            held.add(batch["doc_id"].tolist(), batch["text"].tolist())
            if held.size >= BLOCK:
                yield held.rows(number)
                number, held = number + 1, None
                known = known if len(known.at) < CACHED else Segments(a, b)
        if held:
            yield held.rows(number)

    return saved(plain.mapInPandas(run, STORED), "alignment")


def pair_counts(stored: DataFrame) -> DataFrame:
    """(pair, n, best): in how many documents the ids of a pair are linked, and whether no other
    pair of the same A id is in more."""
    each = stored.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "holders")).alias("p")).select("p.*")
    counts = saved(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("holders").alias("n")).where("n > 0"), "pair-counts")
    counts = counts.withColumn("a", F.expr(f"pair div {PAIR}"))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def told(docs: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    """The results of a block's documents, from its pairs' counts."""
    size = int(pairs["place"].max()) + 1 if len(pairs) else 0
    n, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    n[pairs["place"]], best[pairs["place"]] = pairs["n"], pairs["best"]
    n_best, count_sum = [], []
    for gaps, times in zip(docs["gaps"], docs["times"]):
        held, often = unpacked(gaps, times)
        n_best.append(int((best[held] * often).sum()))
        count_sum.append(int((n[held] * often).sum()))
    out = docs[["doc_id", "n_a", "n_b", "n_groups", "n_links"]].copy()
    out["n_best"], out["count_sum"], out["groups_sha256"] = n_best, count_sum, docs["groups_sha256"]
    return out


def align(docs: DataFrame, a: str, b: str) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.
    a: a byte-level tokenizer's JSON file, b: a sentencepiece model, which every executor can open."""
    stored = blocks(docs, a, b)
    each = stored.where("pairs is not null").select("block", F.posexplode("pairs").alias("place", "pair"))
    answers = each.join(pair_counts(stored), "pair").select(F.col("block").alias("of"), "place", "n", "best")
    rows = stored.where("pairs is null").drop("pairs", "holders")
    schema = "doc_id string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rows.groupBy("block").cogroup(answers.groupBy("of")).applyInPandas(told, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def links(docs: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n, best): the id pairs that are linked anywhere, in how many documents, and whether
    that is the most of their A id."""
    return pair_counts(blocks(docs, a, b)).select(F.expr(f"pair div {PAIR}").alias("a"), F.expr(f"pair % {PAIR}").alias("b"), "n", "best")
