"""Named queries over the shared tables, each with SQL that gives the same rows."""

from __future__ import annotations

from . import configurations, detect, files, integrity, ledger, lifecycle, runs, scalars
from .registry import ORACLE, QUERIES

ENTRY = runs.spend_spike

__all__ = ["ENTRY", "ORACLE", "QUERIES", "configurations", "detect", "files", "integrity", "ledger", "lifecycle", "runs", "scalars"]
