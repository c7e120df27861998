"""Canonical JSON, digests and base64url as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(value: Column) -> Column:
    """JSON of a struct whose fields are declared in name order; nulls are kept."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def digest(tag: str, text: Column) -> Column:
    """SHA-256 of the tag, a zero byte and the text, as 64 hex digits."""
    return F.sha2(F.concat(F.encode(F.lit(tag), "UTF-8"), F.unhex(F.lit("00")), F.encode(text, "UTF-8")), 256)


def to_base64url(data: Column) -> Column:
    return F.rtrim(F.translate(F.base64(data), "+/\r\n", "-_"), F.lit("="))


def from_base64url(text: Column) -> Column:
    """The bytes of canonical unpadded base64url; null for other strings."""
    padded = F.concat(F.translate(text, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.char_length(text), F.lit(4))))
    data = F.when(text.rlike(r"\A[A-Za-z0-9_-]*\z") & (F.char_length(text) % 4 != 1), F.unbase64(padded))
    return F.when(to_base64url(data) == text, data)
