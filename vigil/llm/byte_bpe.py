"""Byte-level BPE encoding and decoding in length-bucketed numpy matrices.

A text is cut into the pieces that the pre-tokenizer's pattern matches.  The
distinct pieces of an Arrow batch are put into padded matrices of token ids by
length; in each round every row merges its leftmost pair of lowest rank, which a
hashed table gives for all pairs at once, and the merged column is compacted
away.  Ranks are ids, as in rank files.

Defined cases: a null or empty text has no ids and decodes to no bytes; repeated
rows give repeated results, and there are no ties to break; ids that are null decode
to no bytes; a very long text is coded whole; an empty table gives an empty one; all
other columns are kept as they are, and a result column of the same name replaces one.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_column, slices, texts, tidy

NONE = np.int32(2**31 - 1)
WIDE = 64  # longer pieces are merged one by one, all pairs of the lowest rank at once
CACHED = 100_000  # pieces that a task remembers
BYTES = 2 << 20  # of text that is coded at a time


class Ranks:
    """Merge ranks of a rank file, with a hashed table of all pairs of tokens
    that are a token together."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.token = [b""] * (max(self.rank.values()) + 1)
        for t, r in self.rank.items():
            self.token[r] = t
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        left, right, to = [], [], []
        for t, r in self.rank.items():
            for i in range(1, len(t)):
                a, b = self.rank.get(t[:i]), self.rank.get(t[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), to.append(r)
        left, right, to = (np.array(x, np.int64) for x in (left, right, to))
        single = np.array([len(t) < 2 for t in self.token])
        #: a merge never gives a pair of a lower rank, so equal pairs can merge together
        self.ordered = bool(np.all((single[left] | (left < to)) & (single[right] | (right < to))))
        bits = max(10, int(len(to)).bit_length() + 2)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.to = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        key = left << 32 | right
        rest, step = np.arange(len(key)), 0
        while len(rest):
            slot = (self._slot(key[rest]) + step) & self.mask
            free = self.keys[slot] < 0
            self.keys[slot[free]] = key[rest[free]]  # of several the last one stays
            done = self.keys[slot] == key[rest]
            self.to[slot[done]] = to[rest[done]]
            rest, step = rest[~done], step + 1
        self.probes = step

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE where there is no such token or padding (-1)."""
        key = a.astype(np.int64) << 32 | (b.astype(np.int64) & 0xFFFFFFFF)
        out = np.full(key.shape, NONE, np.int32)
        slot = self._slot(key)
        todo = (a >= 0) & (b >= 0)
        for step in range(self.probes):
            at = (slot + step) & self.mask
            found = self.keys[at]
            hit = todo & (found == key)
            out[hit] = self.to[at[hit]]
            todo &= ~hit & (found >= 0)
            if not todo.any():
                break
        return out

    def rounds(self, rows: np.ndarray) -> tuple[np.ndarray, bytes, np.ndarray]:
        """Encode rows of byte tokens, padded by -1 at their ends: the rows as they
        get done, their ids one after the other, and each one's offset in bytes."""
        done, ids, sizes = [], [], []
        at, ranks = np.arange(len(rows)), self.pairs(rows[:, :-1], rows[:, 1:])
        while len(rows):
            if ranks.shape[1]:
                j = ranks.argmin(1)
                low = ranks[np.arange(len(rows)), j]
            else:
                j, low = np.zeros(len(rows), np.int64), np.full(len(rows), NONE)
            live = low < NONE
            if not live.all():
                over = rows[~live]
                done.append(at[~live])
                ids.append(over[over >= 0])
                sizes.append((over >= 0).sum(1))
                at, rows, ranks, j, low = at[live], rows[live], ranks[live], j[live], low[live]
            if not len(rows):
                break
            n, width = rows.shape
            every = np.arange(n)
            rows[every, j] = low
            keep = np.ones((n, width), bool)
            keep[every, j + 1] = False
            rows = rows[keep].reshape(n, width - 1)
            keep = np.ones((n, width - 1), bool)
            keep[every, j] = False
            ranks = ranks[keep].reshape(n, width - 2)
            if width > 2:
                left = np.maximum(j - 1, 0)
                ranks[every, left] = self.pairs(rows[every, left], rows[every, left + 1])
                right = np.minimum(j, width - 3)
                ranks[every, right] = self.pairs(rows[every, right], rows[every, right + 1])
        end = np.cumsum(np.concatenate([[0], *sizes])) * 4
        return np.concatenate(done), np.concatenate(ids).astype("<u4").tobytes(), end

    def wide(self, ids: np.ndarray) -> np.ndarray:
        """Encode one long row; where ranks are ordered, all equal pairs of a round merge from the left."""
        while len(ids) > 1:
            ranks = self.pairs(ids[:-1], ids[1:])
            low = ranks.min()
            if low == NONE:
                break
            j = np.flatnonzero(ranks == low)
            if not self.ordered:
                j = j[:1]
            run = np.concatenate(([True], np.diff(j) > 1))
            begin = np.maximum.accumulate(np.where(run, j, -1))
            j = j[(j - begin) % 2 == 0]
            ids[j] = low
            keep = np.ones(len(ids), bool)
            keep[j + 1] = False
            ids = ids[keep]
        return ids

    def encode(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of distinct pieces as little-endian unsigned 32-bit integers."""
        out: dict[str, bytes] = {}
        buckets: dict[int, tuple[list[str], list[bytes]]] = {}
        for piece in pieces:
            p = piece.encode()
            r = self.rank.get(p)
            if r is not None:
                out[piece] = r.to_bytes(4, "little")
            elif len(p) > WIDE:
                out[piece] = self.wide(self.byte[np.frombuffer(p, np.uint8)]).astype("<u4").tobytes()
            else:
                names, values = buckets.setdefault((len(p) + 3) // 4 * 4, ([], []))
                names.append(piece)
                values.append(p)
        for width, (names, values) in buckets.items():
            for lo in range(0, len(names), 8192):
                some = values[lo : lo + 8192]
                size = np.fromiter(map(len, some), np.int64, len(some))
                flat = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in some]), np.uint8)
                rows = self.byte[flat].reshape(-1, width)
                rows[np.arange(width) >= size[:, None]] = -1
                done, ids, end = self.rounds(rows)
                end = end.tolist()
                for i, a, b in zip(done.tolist(), end, end[1:]):
                    out[names[lo + i]] = ids[a:b]
        return out


@lru_cache(2)
def ranks(path: str, pattern: str) -> Ranks:
    return Ranks(path, pattern)


#: Where a cut before a space, comma or full stop could split a match of the pattern.
_UNCUT = re.compile(r"\s (?=\s|\Z)|[\W_][.,]|\0")


def cut(text: str) -> list[str]:
    """Cut a text before spaces, commas and full stops where no match of the pattern
    crosses the cut, so that the matches on both sides don't depend on what lies
    beyond it: before a space that begins or ends its run of white space, and
    before a comma or full stop after a letter or digit."""
    if _UNCUT.search(text) is None:
        return text.replace(" ", "\0 ").replace(",", "\0,").replace(".", "\0.").split("\0")
    bad = {m.start() + 1 for m in re.finditer(r"\s (?=\s|\Z)", text)}
    at = [i for m in re.finditer(r" |(?<=[^\W_])[.,]", text) if (i := m.start()) not in bad]
    return [text[a:b] for a, b in zip([0, *at], [*at, len(text)])]


def encode_texts(values: list[str], path: str, pattern: str, seen: dict[str, bytes] | None = None) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers.  seen: pieces
    that are known already; it gets the new ones and never holds many more than ``CACHED``."""
    r, seen = ranks(path, pattern), {} if seen is None else seen
    out: list[bytes] = []
    for lo in range(0, len(values), 512):
        if len(seen) > CACHED:
            seen.clear()
        cuts = [cut(t) for t in values[lo : lo + 512]]
        new = [c for c in set().union(*cuts) if c not in seen]
        whole = [c for c in new if "\n" not in c]  # split all of them at once, at line feeds
        found = iter(r.pattern.findall("\n".join(whole)))
        pieces: list[list[str]] = [[]]
        for p in found:
            if p == "\n":
                pieces.append([])
            else:
                pieces[-1].append(p)
        if len(pieces) != len(whole) or any("".join(x) != c for x, c in zip(pieces, whole)):
            pieces = list(map(r.pattern.findall, whole))
        rest = [c for c in new if "\n" in c]
        whole, pieces = whole + rest, pieces + list(map(r.pattern.findall, rest))
        ids = r.encode(list({p for x in pieces for p in x if p not in seen}))
        seen.update(ids)
        get = seen.__getitem__
        seen.update({c: b"".join(map(get, x)) for c, x in zip(whole, pieces) if len(x) != 1})
        out += [b"".join(map(get, x)) for x in cuts]
    return out


def recoded(df: DataFrame, path: str, pattern: str, text: str | None, ids: str | None, decoded: str | None) -> DataFrame:
    """Add what is asked for: ids of the texts, bytes of the ids.  Both together take one Python task."""
    added = [c for c, asked in ((ids, text is not None), (decoded, decoded is not None)) if asked]
    kept = [c for c in df.columns if c not in added]
    schema = df.select(*[id_column(df, c) for c in kept]).schema
    for c in added:
        schema = schema.add(c, "binary")
    source = kept.index(ids if text is None else text)

    @tidy
    def run(batches):
        seen: dict[str, bytes] = {}
        for batch in batches:
            for lo, n, _, _ in slices(batch.column(source), BYTES):
                part, new = batch.slice(lo, n), []
                if text is None:
                    coded = [x.as_py() or b"" for x in part.column(source)]
                else:
                    coded = encode_texts(texts(part.column(source)).to_pylist(), path, pattern, seen)
                    new.append(pa.array(coded, pa.binary()))
                if decoded is not None:
                    token = ranks(path, pattern).token
                    new.append(pa.array([b"".join(map(token.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in coded], pa.binary()))
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=schema.fieldNames())

    return df.select(*[id_column(df, c) for c in kept]).mapInArrow(run, schema)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", to: str = "ids") -> DataFrame:
    """Add the ids of each text as a binary column of little-endian unsigned
    32-bit integers.  path: a rank file that every executor can open."""
    return recoded(df, path, pattern, text, to, None)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Add the bytes that the ids stand for."""
    return recoded(df, path, pattern, None, ids, to)


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Add the ids of each text and the bytes that these ids stand for."""
    return recoded(df, path, pattern, text, ids, to)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: the count and SHA-256 of its ids, and the SHA-256 of what they decode to."""
    coded = round_trip(docs.select("doc_id", "text"), path, pattern)
    return coded.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
