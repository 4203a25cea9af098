"""One number for a (master, rel) pair."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASTER_BITS, REL_BITS = 40, 24


def _mask(bits: int) -> int:
    return -1 if bits >= 64 else (1 << bits) - 1


def check_split(master_bits: int, rel_bits: int) -> None:
    if master_bits + rel_bits != 64 or min(master_bits, rel_bits) < 1:
        raise ValueError("master and rel bits must be positive and add up to 64")


def pack(master: Column, rel: Column, master_bits: int = MASTER_BITS, rel_bits: int = REL_BITS) -> Column:
    """master above rel, each cut to its bits. The bits of an unsigned number: large masters give negative longs."""
    check_split(master_bits, rel_bits)
    high = master.cast("bigint").bitwiseAND(F.lit(_mask(master_bits)))
    return F.shiftleft(high, rel_bits).bitwiseOR(rel.cast("bigint").bitwiseAND(F.lit(_mask(rel_bits))))


def master_of(packed: Column, rel_bits: int = REL_BITS) -> Column:
    return F.shiftrightunsigned(packed, rel_bits)


def rel_of(packed: Column, rel_bits: int = REL_BITS) -> Column:
    return packed.bitwiseAND(F.lit(_mask(rel_bits)))


def checked_unsigned(value: Column, bits: int = 64) -> Column:
    """A decimal that fits ``bits`` unsigned bits; raises otherwise."""
    value = value.cast("decimal(38,0)")
    fits = (value >= 0) & (value < F.lit(str(1 << bits)).cast("decimal(38,0)"))
    return F.when(fits, value).otherwise(F.raise_error(F.concat(F.lit("out of range: "), value.cast("string"))).cast("decimal(38,0)"))
