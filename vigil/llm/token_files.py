"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

Ids are replaced by their rank (the most frequent id of the corpus is 0) and
coded in one to four bytes each; the byte counts stand apart, four to a control
byte, so a decoder finds with table lookups in numpy how many bytes each value
takes, without a branch per value.

A written folder holds three Parquet tables with binary columns:
``blocks`` (part, block, ahead, n_ids, doc_ids, sizes, control, data): runs of
documents in ascending doc_id order; parts are ranges of doc_id, in order, and
ahead counts the ids of the part's blocks before this one;
``parts`` (part, n_ids, before): ids of each part and of all parts before it;
``ranks`` (rank, id): the dictionary, at most one row per id of the vocabulary.

Parts are cut by quantiles of doc_id, which are found from that column alone, and
every row carries its part's number.

Defined cases: a null or empty text has only the end id; a very long text has a block
of its own; repeated doc_ids stay separate, ordered by their coded bytes (equal ones
can't be told apart); documents with a null doc_id come first; without documents the
tables are empty; other columns of the documents, whatever their names, play no part.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import delete, saved, scratch, slices, texts, tidy

CACHED = 500_000  # runs of characters that a task remembers
BYTES = 4 << 20  # of text that is tokenised at a time
NO_ID = -(2**63)  # in the files, of a document whose doc_id is null
BLOCKS = "part long, block long, ahead long, n_ids long, doc_ids binary, sizes binary, control binary, data binary"
BLOCK = 1 << 18  # ids in a block of documents; a longer document has a block of its own
ENDS = "</w>"  # of the tokens that end a word
#: Words of letters that stay single letters when the tokenizer composes and lower-cases them.
LETTERS = "^[a-zA-ZÀ-ÖØ-öø-įı-ɏ]+$"
TOGETHER = 256  # words of letters that the tokenizer gets in one text


@lru_cache(2)
def tokenizer(path: str):
    """(tokenizer, the same for lower-cased words between spaces, whether each id ends a
    word, the strings of added tokens)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    t, words = Tokenizer.from_file(path), Tokenizer.from_file(path)
    words.normalizer = normalizers.Sequence([])
    words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    vocabulary = t.get_vocab(with_added_tokens=True)
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for x, i in vocabulary.items() if x.endswith(ENDS)]] = True
    return t, words, ends, [x.content for x in t.get_added_tokens_decoder().values()]


def encode_words(new: list[str], path: str) -> list[bytes]:
    """Ids of words of letters.  Each is one piece for the tokenizer, so many of them make
    one text, whose ids are parted after those that end a word."""
    t, plain, ends, _ = tokenizer(path)
    groups, out = [new[i : i + TOGETHER] for i in range(0, len(new), TOGETHER)], []
    for some, e in zip(groups, plain.encode_batch_fast([" ".join(g).lower() for g in groups], add_special_tokens=False)):
        ids = np.array(e.ids, "<u4")
        cuts = ((np.flatnonzero(ends[ids]) + 1) * 4).tolist()
        if len(cuts) == len(some):
            ids = ids.tobytes()
            out += [ids[a:b] for a, b in zip([0, *cuts], cuts)]
        else:
            out += encode_others(some, path)
    return out


def encode_others(new: list[str], path: str) -> list[bytes]:
    return [np.array(e.ids, "<u4").tobytes() for e in tokenizer(path)[0].encode_batch_fast(new, add_special_tokens=False)]


class Seen:
    """Ids of the runs that a task has met, at most ``CACHED`` of them and those of one
    batch: of two halves the older one goes when the newer one is full."""

    def __init__(self):
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids(self, runs: list[str], encode) -> list[bytes]:
        if 2 * len(self.new) > CACHED:
            self.new, self.old = {}, self.new
        new, old = self.new, self.old
        missing = [x for x in runs if x not in new]
        if old:
            new.update((x, old[x]) for x in missing if x in old)
            missing = [x for x in missing if x not in old]
        new.update(zip(missing, encode(missing)))
        return [new[x] for x in runs]


def encode_texts(column: pa.Array, path: str, end: int, seen: Seen | None = None) -> pa.Array:
    """Ids of each text and the end id, in binary: little-endian unsigned 32-bit integers.

    The tokenizer drops white space and no piece of a text goes across spaces, nor from a
    plain letter or digit on to a comma or full stop, so each distinct run between such
    places is tokenised once.  A text that may hold an added token's string is tokenised
    whole.  seen: runs that are known already; it gets the new ones."""
    added, seen = tokenizer(path)[3], seen or Seen()
    column = texts(column)
    whole = np.zeros(len(column), bool)
    for x in added:
        whole |= np.asarray(pc.match_substring(column, x, ignore_case=True))
    cut = pc.if_else(pa.array(whole), pa.scalar("", pa.large_string()), column) if whole.any() else column
    cut = pc.replace_substring(pc.replace_substring_regex(cut, "([A-Za-z0-9])([.,])", r"\1 \2"), "\n", " ")
    parts = pc.split_pattern(cut, " ")
    coded = parts.flatten().dictionary_encode()
    words, plain = coded.dictionary.to_numpy(zero_copy_only=False), np.asarray(pc.match_substring_regex(coded.dictionary, LETTERS))
    ids = np.empty(len(words), object)
    ids[plain] = seen.ids(words[plain].tolist(), lambda new: encode_words(new, path))
    ids[~plain] = seen.ids(words[~plain].tolist(), lambda new: encode_others(new, path))
    ids = ids.tolist()
    size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    flat = np.frombuffer(b"".join(ids), "<u4")
    index = np.asarray(coded.indices)
    count = size[index]
    before = np.concatenate([[0], np.cumsum(count)])
    start = (np.cumsum(size) - size)[index]
    every = flat[np.arange(before[-1]) + np.repeat(start - before[:-1], count)]
    last = before[np.asarray(parts.offsets).astype(np.int64)]  # where each text's ids end, and the first one's begin
    every = np.insert(every, last[1:], np.uint32(end))
    cuts = (last - last[0] + np.arange(len(last))) * 4
    out = pa.Array.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(every.astype("<u4"))])
    if whole.any():
        tail = end.to_bytes(4, "little")
        full = encode_others([column[int(i)].as_py() for i in np.flatnonzero(whole)], path)
        out = pc.replace_with_mask(out, pa.array(whole), pa.array([x + tail for x in full], pa.large_binary()))
    return out.cast(pa.binary())


def tokenize(docs: DataFrame, path: str, end: int) -> DataFrame:
    """(doc_id, ids): the ids of each text, with the end id, in binary."""

    @tidy
    def run(batches):
        seen = Seen()
        for batch in batches:
            for lo, n, _, _ in slices(batch.column(1), BYTES):
                ids = encode_texts(batch.column(1).slice(lo, n), path, end, seen)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), ids], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def counted(tokens: DataFrame) -> DataFrame:
    """(id, n): how often each id occurs in all documents, summed within batches first."""

    @tidy
    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for _, ids, _ in runs(batch.column(0)):
                n = np.bincount(ids)
                if len(n) > len(total):
                    total, n = n, total
                total[: len(n)] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def runs(column: pa.Array, most: int = 1 << 20):
    """(first row, ids, offsets of the rows' ids) of runs of rows with about ``most`` ids."""
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int32, n + 1, column.offset * 4).astype(np.int64) // 4
    lo = 0
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1))
        ids = np.frombuffer(column.buffers()[2] or b"", "<u4", int(offsets[hi] - offsets[lo]), int(offsets[lo]) * 4)
        yield lo, ids, offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def pack(values: np.ndarray, offsets: np.ndarray) -> list[tuple[bytes, bytes]]:
    """(control bytes, data bytes) of each row of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, "<u4")
    size = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]].tobytes()
    count = np.diff(offsets)
    controls = np.concatenate([[0], np.cumsum(-(-count // 4))])
    code = np.zeros(int(controls[-1]) * 4, np.uint8)
    code[np.arange(len(values)) + np.repeat(controls[:-1] * 4 - offsets[:-1], count)] = size - 1
    code = code.reshape(-1, 4)
    code = (code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6).astype(np.uint8).tobytes()
    at = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[offsets].tolist()
    controls = controls.tolist()
    return [(code[c:d], data[x:y]) for c, d, x, y in zip(controls, controls[1:], at, at[1:])]


#: Byte counts of the four values of each control byte.
SIZES = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.int64)
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def unpack(control: bytes, data: bytes, count: np.ndarray) -> np.ndarray:
    """The values of rows of ``count`` values that ``pack`` has coded, one row after
    the other: sizes by table lookup, then one gather of four bytes each."""
    size = SIZES[np.frombuffer(control, np.uint8)].ravel()
    controls = np.cumsum(-(-count // 4)) * 4  # the last control byte of a row is filled up
    size = size[np.arange(int(count.sum())) + np.repeat(controls - (-(-count // 4)) * 4 - np.cumsum(count) + count, count)]
    at = np.cumsum(size) - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    four = raw[at[:, None] + np.arange(4)].view("<u4").ravel() if len(at) else np.zeros(0, np.uint32)
    return four & MASKS[size]


def write(docs: DataFrame, path: str, to: str, end: int = 2) -> None:
    """Tokenise ``docs`` and write the folder ``to``."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = docs.select(F.col("doc_id").cast("double").alias("doc_id"))
    bounds = np.unique(known.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (8 * n)) if n > 1 else [])
    tokens = saved(tokenize(docs, path, end), "tokens")
    # one row per id of the vocabulary at most, whatever the corpus holds
    ranks = counted(tokens).select((F.row_number().over(Window.orderBy(F.desc("n"), "id")) - 1).alias("rank"), "id")
    ranks.write.parquet(f"{to}/ranks")
    ids = np.array([r[0] for r in spark.read.parquet(f"{to}/ranks").orderBy("rank").select("id").collect()], np.int64)
    rank = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.uint32)
    rank[ids] = np.arange(len(ids))
    rank_of = spark.sparkContext.broadcast(rank)

    @tidy
    def code(batches):
        for batch in batches:
            for lo, ids, offsets in runs(batch.column(1)):
                coded = pack(rank_of.value[ids], offsets)
                sizes = np.diff(offsets)
                docs = batch.column(0).slice(lo, len(sizes))
                part = np.where(np.asarray(docs.is_null()), 0, np.searchsorted(bounds, np.asarray(docs.fill_null(0)).astype(float), "right"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part.astype(np.int32)), docs, pa.array(sizes), pa.array([c for c, _ in coded], pa.binary()), pa.array([d for _, d in coded], pa.binary())],
                    names=["part", "doc_id", "size", "control", "data"],
                )

    @tidy
    def block(batches):
        part, number, ahead, held, n = None, 0, 0, [], 0
        names = BLOCKS.replace(" long", "").replace(" binary", "").split(", ")

        def flush():
            sizes = np.array([x[1] for x in held], "<i8").tobytes()
            docs, control, data = (b"".join([x[i] for x in held]) for i in (0, 2, 3))
            row = [part, number, ahead, n, docs, sizes, control, data]
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=names)

        for batch in batches:
            for mine, doc, size, control, data in zip(*(c.to_pylist() for c in batch.columns)):
                if mine != part:
                    if held:
                        yield flush()
                    part, number, ahead, held, n = mine, 0, 0, [], 0
                held.append(((NO_ID if doc is None else doc).to_bytes(8, "little", signed=True), size, control, data))
                n += size
                if n >= BLOCK:
                    yield flush()
                    number, ahead, held, n = number + 1, ahead + n, [], 0
        if held:
            yield flush()

    coded = tokens.mapInArrow(code, "part int, doc_id long, size long, control binary, data binary")
    ordered = coded.repartitionById(n, "part").sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "data", "control")
    # each document's values start at a control byte of their own, so blocks are documents' bytes one after the other
    ordered.mapInArrow(block, BLOCKS).write.option("compression", "none").parquet(f"{to}/blocks")
    delete(tokens)

    sums = spark.read.parquet(f"{to}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part of the files
    sums.withColumn("before", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).write.parquet(f"{to}/parts")


def read(spark, path: str) -> DataFrame:
    """(doc_id, start, ids) from a written folder: the offset of each document in
    the sequence of all ids, and its ids in binary."""
    ids = np.array([r[0] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").select("id").collect()], "<u4")
    id_of = spark.sparkContext.broadcast(ids)

    parts = spark.read.parquet(f"{path}/parts")  # a row per part of the files, so it can be sent to all
    blocks = spark.read.parquet(f"{path}/blocks").join(F.broadcast(parts.select("part", "before")), "part")

    @tidy
    def run(batches):
        for batch in batches:
            for first, docs, sizes, control, data in zip(*(c.to_pylist() for c in batch.columns)):
                docs, sizes = np.frombuffer(docs, "<i8"), np.frombuffer(sizes, "<i8")
                ids = id_of.value[unpack(control, data, sizes)].tobytes()
                end = (np.cumsum(sizes) * 4).tolist()
                out = [ids[x:y] for x, y in zip([0, *end], end)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, mask=docs == NO_ID), pa.array(first + np.cumsum(sizes) - sizes), pa.array(sizes), pa.array(out, pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return blocks.select(F.col("before") + F.col("ahead"), "doc_ids", "sizes", "control", "data").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids binary"
    )


def digests(docs: DataFrame, path: str, end: int = 2) -> DataFrame:
    """Write ``docs`` as token files and return what the files hold, per document."""
    to = scratch(docs.sparkSession, "token_files")
    write(docs, path, to, end)
    return read(docs.sparkSession, to).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


