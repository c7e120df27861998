"""Strict JSON: no duplicate members, trailing data, fractions, exponents, signs,
byte order mark or lone surrogates; bounded depth and sizes.

Spark's own parsers keep the last duplicate or accept trailing data, so the check
runs as a Pandas UDF over Arrow batches.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

DEPTH, MEMBERS, ELEMENTS, MOST = 24, 256, 4096, 2**53 - 1


def _members(pairs):
    if len(pairs) > MEMBERS or len({k for k, _ in pairs}) < len(pairs):
        raise ValueError("members")
    return dict(pairs)


def _number(text):
    if text.startswith("-") or int(text) > MOST:
        raise ValueError("number")
    return int(text)


def _refuse(text):
    raise ValueError(text)


def _bounded(value, depth=1):
    if isinstance(value, str):
        value.encode()  # fails on lone surrogates
    elif isinstance(value, (dict, list)):
        if depth > DEPTH or (isinstance(value, list) and len(value) > ELEMENTS):
            raise ValueError("size")
        for x in [*value, *value.values()] if isinstance(value, dict) else value:
            _bounded(x, depth + 1)


_DECODER = json.JSONDecoder(object_pairs_hook=_members, parse_int=_number, parse_float=_refuse, parse_constant=_refuse, strict=True)


def parsed(text: str | None):
    """(whether the text is strict JSON, its canonical form)."""
    try:
        if text is None or text.startswith("﻿"):
            return False, None
        value = _DECODER.decode(text)
        _bounded(value)
        return True, json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except (ValueError, RecursionError):
        return False, None


def strict_json(column):
    """Column: (valid, canonical) of a column of texts."""

    def run(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parsed(x) for x in text], columns=["valid", "canonical"])

    return F.pandas_udf(run, StructType([StructField("valid", BooleanType()), StructField("canonical", StringType())]))(column)
