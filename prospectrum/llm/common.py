"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prospectrum.sources.tables import table, written

__all__ = ["crc_mod", "table", "written"]


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the value as text, modulo; null where the value is null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)
