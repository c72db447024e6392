"""Big-endian fields of binary columns, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def be_uint(data: Column, offset: int, size: int) -> Column:
    """Unsigned big-endian number in data[offset : offset + size]; null where no byte is left."""
    digits = F.hex(F.substring(data, offset + 1, size))
    return F.when(F.length(digits) > 0, F.conv(digits, 16, 10).cast("long"))


def byte_or(data: Column, offset: int, default: int = 0) -> Column:
    return F.coalesce(be_uint(data, offset, 1), F.lit(default).cast("long"))


def ticks_to_ms(ticks: Column, zero_is_null: bool = False) -> Column:
    """90 kHz ticks to whole milliseconds."""
    ms = F.floor(ticks / 90).cast("long")
    return F.when(ticks != 0, ms) if zero_is_null else ms
