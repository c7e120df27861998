"""WARC archives without repeated payloads.

``write`` makes a record of each row.  Only headers (id, hash of the payload, its size) are
shuffled by payload to find, for each payload that occurs more than once, the record that
keeps it (the one of the smallest id); the others become revisit records, which hold the
HTTP header, the payload's digest and what they refer to.  Every record gets fresh headers.
Spark's text writer writes the archives (a record, then the two line ends that close it), so
tasks commit files as a whole and a lost executor leaves no half archive.  A file is
a plain or compressed sequence of WARC 1.1 records (gzip: one member for the file).

``headers`` and ``records`` read archives, these or others: records are parted by their content
lengths, files may be plain or gzip of one member or of one for each record.  ``resolved`` joins
revisits back to the original responses, by digest and record id (by digest alone where a
revisit names no record), and ``rewrite`` turns read records into deduplicated archives.

Defined cases: a null payload is empty; a null id takes part, but comes after all others, and is
read back as null; rows of equal id and payload are equal records, of which those of the smallest
id are all responses; the date is a parameter, so that a repeated task writes the same bytes;
a null URL gives no target URI, spaces in one become %20 and control characters go; a very
long payload is one record, which a task holds as a whole; an empty table gives no archive, which reads as no
rows; other columns, whatever their names, play no part.  A file that isn't a sequence of WARC
records raises ValueError; a revisit whose original isn't there has nulls for what it would give.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, id_column, saved, scratch, small_batches, tidy

LEAST = 0  # bytes of a payload that can be revisited
DATE = "1970-01-01T00:00:00Z"
PER_FILE = 50_000  # records of a file, at most
READ = 1 << 20  # bytes that are decompressed at a time
#: Fixed values of the format.
END = "\r\n"
VERSION = b"WARC/1."
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

HEADERS = "file string, place long, record_id string, type string, key string, uri string, date string, refers_to string, declared string, digest string, size long"


def base32_sha1(column):
    """Upper-case base32 SHA-1 of a binary column; every five hex digits are four of base 32."""
    hexed = F.sha1(column)
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), DIGITS, BASE32)


def record_urn(key, payload_hash):
    """A record's id from its row's id and its payload, alike each time."""
    hexed = F.sha2(F.concat_ws(" ", F.coalesce(key.cast("string"), F.lit("null")), payload_hash), 256)
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.substring(hexed, 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def prepared(rows: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    """(key, uri, payload, size, same): same tells payloads apart."""
    plain = rows.select(
        id_column(rows, key).cast("long").alias("key"),
        F.regexp_replace(F.replace(id_column(rows, url).cast("string"), F.lit(" "), F.lit("%20")), r"[\x00-\x1F\x7F]", "").alias("uri"),
        F.coalesce(id_column(rows, payload).cast("string"), F.lit("")).alias("payload"),
    )
    return plain.withColumn("size", F.octet_length("payload").cast("long")).withColumn("same", F.sha2("payload", 256))


def revisits(headers: DataFrame, least: int = LEAST) -> DataFrame:
    """(key, same, first, first_uri): the records whose payload lies in one of a smaller id, and
    that id.  A payload's records are summed up before they are shuffled; only those of
    payloads that occur under several ids are joined back."""
    first = F.struct(F.coalesce(F.col("key"), F.lit(2**63 - 1)).alias("order"), "key", "uri")
    shared = (
        headers.where(F.col("size") >= least)
        .groupBy("same")
        .agg(F.min(first).alias("first"), F.max(first.getField("order")).alias("last"))
        .where("first.order < last")
        .select("same", F.col("first.key").alias("first"), F.col("first.uri").alias("first_uri"))
    )
    return headers.select("key", "same").distinct().join(shared, "same").where("key is null or key <> first")


def header(name: str, value):
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(END)), F.lit(""))


def archived(rows: DataFrame, date: str):
    """The records as text, up to the two line ends that close each: from (key, uri, payload,
    size, same, first, first_uri, again)."""
    again, when = F.col("again"), F.lit(date)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("size").cast("string"), F.lit(END + END))
    only = lambda column: F.when(again, column)
    return F.concat(
        F.lit(f"WARC/1.1{END}"),
        header("WARC-Type", F.when(again, "revisit").otherwise("response")),
        header("WARC-Record-ID", record_urn(F.col("key"), F.col("same"))),
        header("WARC-Date", when),
        header("WARC-Target-URI", F.col("uri")),
        header("WARC-Source-Key", F.col("key")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.encode("payload", "UTF-8")))),
        header("WARC-Profile", only(F.lit(REVISIT))),
        header("WARC-Refers-To", only(record_urn(F.col("first"), F.col("same")))),
        header("WARC-Refers-To-Target-URI", only(F.col("first_uri"))),
        header("WARC-Refers-To-Date", only(when)),
        header("Content-Type", F.lit("application/http; msgtype=response")),
        header("Content-Length", F.octet_length(http) + F.when(again, 0).otherwise(F.col("size"))),
        F.lit(END),
        http,
        F.when(again, "").otherwise(F.col("payload")),
    )


def write(
    rows: DataFrame, path: str, key: str = "doc_id", url: str = "url", payload: str = "text", least: int = LEAST, date: str = DATE, codec: str = "gzip"
) -> None:
    """Write a record of each row to archives under ``path``, which must not exist.  The decisions
    are written first, so that the planner knows their size: it sends them to all tasks where they are
    few, and else shuffles the payloads once."""
    small_batches(rows.sparkSession)
    every = prepared(rows, key, url, payload)
    found = saved(revisits(every.drop("payload"), least), "revisits")
    decided = found.select(F.col("key").alias("k"), F.col("same").alias("s"), "first", "first_uri", F.lit(True).alias("again"))
    joined = every.join(decided, F.col("key").eqNullSafe(F.col("k")) & (F.col("same") == F.col("s")), "left").withColumn("again", F.coalesce("again", F.lit(False)))
    joined.select(archived(joined, date).alias("value")).write.option("lineSep", END + END).option("compression", codec).option("maxRecordsPerFile", PER_FILE).text(path)
    delete(found)


def inflated(content: bytes):
    """The bytes of a plain file, or of one of gzip members, in pieces."""
    if content[:2] != b"\x1f\x8b":
        for at in range(0, len(content), READ):
            yield content[at : at + READ]
        return
    d, rest, at = zlib.decompressobj(31), b"", 0
    while rest or at < len(content):
        if not rest:
            rest, at = content[at : at + READ], at + READ
        yield d.decompress(rest, READ)
        rest = d.unconsumed_tail
        if d.eof:
            rest, d = d.unused_data, zlib.decompressobj(31)


class Stream:
    """Reads the pieces of a file."""

    def __init__(self, pieces):
        self.pieces, self.held, self.at = pieces, bytearray(), 0

    def more(self) -> bool:
        if self.at:
            del self.held[: self.at]
            self.at = 0
        piece = next(self.pieces, None)
        if piece is None:
            return False
        self.held += piece
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What comes before the mark, which is passed over; None if there is none."""
        seen = 0
        while True:
            found = self.held.find(mark, self.at + seen)
            if found >= 0:
                out = bytes(self.held[self.at : found])
                self.at = found + len(mark)
                return out
            seen = max(0, len(self.held) - self.at - len(mark) + 1)
            if not self.more():
                return None

    def take(self, n: int) -> bytes | None:
        if n < 0:
            return None
        while len(self.held) - self.at < n:
            if not self.more():
                return None
        out = bytes(self.held[self.at : self.at + n])
        self.at += n
        return out

    def ended(self) -> bool:
        """Nothing but line ends is left."""
        while True:
            while self.at < len(self.held) and self.held[self.at] in b"\r\n":
                self.at += 1
            if self.at < len(self.held):
                return False
            if not self.more():
                return True


def parsed(content: bytes, name: str):
    """(headers by lower-case name, block) of each record of a file."""
    stream = Stream(inflated(content))
    while not stream.ended():
        head = stream.until(b"\r\n\r\n")
        lines = (head or b"").decode("utf-8", "replace").split(END)
        if not lines[0].startswith(VERSION.decode()):
            raise ValueError(f"{name} is no sequence of WARC records")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = fields.get("content-length", "")
        block = stream.take(int(size) if size.isascii() and size.isdigit() else -1)
        if block is None:
            raise ValueError(f"{name} ends within a record or has a wrong length")
        yield fields, block


def payload_of(fields: dict[str, str], block: bytes) -> bytes:
    """The block, without the HTTP header that an HTTP record begins with."""
    if fields.get("content-type", "").startswith("application/http"):
        _, found, rest = block.partition(b"\r\n\r\n")
        return rest if found else b""
    return block


def read(spark: SparkSession, path: str, with_payload: bool) -> DataFrame:
    small_batches(spark)
    schema = HEADERS + (", payload binary" if with_payload else "")

    @tidy
    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, held = [], 0
                for place, (fields, block) in enumerate(parsed(content.as_py(), name)):
                    payload = payload_of(fields, block)
                    declared = fields.get("warc-payload-digest", "")
                    rows.append((
                        name, place, fields.get("warc-record-id"), fields.get("warc-type"), fields.get("warc-source-key"), fields.get("warc-target-uri"), fields.get("warc-date"),
                        fields.get("warc-refers-to"), declared[5:].upper() if declared.lower().startswith("sha1:") else None,
                        base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload), payload,
                    ))
                    held += len(payload) if with_payload else 64
                    if held > READ:
                        yield batched(rows, with_payload)
                        rows, held = [], 0
                yield batched(rows, with_payload)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, schema)


def batched(rows: list[tuple], with_payload: bool) -> pa.RecordBatch:
    columns = [*zip(*rows)] or [()] * 12
    kinds = [pa.int64() if i in (1, 10) else pa.binary() if i == 11 else pa.string() for i in range(12)][: 11 + with_payload]
    names = ["file", "place", "record_id", "type", "key", "uri", "date", "refers_to", "declared", "digest", "size", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names[: len(kinds)])


def headers(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under ``path``, without their payloads: digest and size are
    those of the payload as it lies there, declared is the digest that the header states."""
    return read(spark, path, False)


def records(spark: SparkSession, path: str) -> DataFrame:
    """As ``headers``, with the payloads."""
    return read(spark, path, True)


def resolved(found: DataFrame) -> DataFrame:
    """The records, with what revisits refer to: full_digest, full_size, intact (the payload is as
    declared, and a revisit's original is there), original (the original's record id) and
    original_key.  Originals are few to a digest once they are summed up; revisits of one
    original lie in as many tasks as the planner splits the join into."""
    answers = found.where(F.lower("type") == "response")
    one = lambda by: answers.groupBy(*by).agg(F.min(F.struct("date", "file", "place", "record_id", "key", "size")).alias("o"))
    again = found.where(F.lower("type") == "revisit")
    by_id = one([F.col("digest").alias("declared"), F.col("record_id").alias("refers_to")])
    by_digest = one([F.col("digest").alias("declared")])
    named = again.where("refers_to is not null").join(by_id, ["declared", "refers_to"], "left")
    unnamed = again.where("refers_to is null").join(by_digest, "declared", "left")
    full = lambda df: df.select(
        *found.columns, F.when(F.col("o").isNotNull(), F.col("declared")).alias("full_digest"), F.col("o.size").alias("full_size"), F.col("o").isNotNull().alias("intact"),
        F.col("o.record_id").alias("original"), F.col("o.key").alias("original_key"),
    )
    rest = found.where("type is null or lower(type) <> 'revisit'").select(
        *found.columns, F.col("digest").alias("full_digest"), F.col("size").alias("full_size"), (F.col("declared").isNull() | (F.col("declared") == F.col("digest"))).alias("intact"),
        F.lit(None).cast("string").alias("original"), F.lit(None).cast("string").alias("original_key"),
    )
    return rest.unionByName(full(named)).unionByName(full(unnamed))


def rewrite(spark: SparkSession, source: str, path: str, least: int = LEAST, codec: str = "gzip") -> None:
    """Write the responses of the archives under ``source``, and the revisits whose original is
    there, as deduplicated archives with fresh headers.  Payloads have to be UTF-8."""
    every = saved(records(spark, source), "records")
    told = resolved(every.drop("payload")).where("lower(type) in ('response', 'revisit') and full_size is not null")
    texts = every.where(F.lower("type") == "response").groupBy("digest").agg(F.min("payload").alias("payload"))
    rows = told.join(texts.withColumnRenamed("digest", "full_digest"), "full_digest").select(F.coalesce(F.expr("try_cast(key as long)"), F.xxhash64("record_id")).alias("key"), "uri", F.decode("payload", "UTF-8").alias("payload"))
    write(rows, path, "key", "uri", "payload", least, codec=codec)
    delete(every)


def round_trip(rows: DataFrame, key: str = "doc_id", url: str = "url", payload: str = "text", least: int = LEAST) -> DataFrame:
    """Per row, from the archives that are written of them: its key, the size and digest of its
    whole payload, whether it is a response or a revisit, and of which key."""
    spark = rows.sparkSession
    path = scratch(spark, "warc")
    write(rows, path, key, url, payload, least)
    told = resolved(saved(headers(spark, path), "warc-headers"))
    return told.select(
        F.col("key").cast("long").alias("key"), F.col("full_size").alias("payload_bytes"), F.col("full_digest").alias("payload_digest"), F.col("type").alias("record_type"),
        F.col("original_key").cast("long").alias("refers_to"),
    )
