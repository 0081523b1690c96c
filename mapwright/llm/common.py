"""Shared pieces of the training-data operators: hashing and word counts; scratch tables are the library's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mapwright.scratch import Scratch, shared_dir

__all__ = ["LOWER", "UPPER", "WORD", "Scratch", "ascii_lower", "shared_dir", "uniform", "word_count"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: A word: a run of anything but space and the ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def uniform(*parts: Column | int) -> Column:
    """A reproducible number in [0, 1) from the given columns."""
    cols = [F.lit(p) if isinstance(p, int) else p for p in parts]
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))
