"""FNV-1a and trajectory ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FNV-1a, 64 bits.
_OFFSET_HI, _OFFSET_LO = 0xCBF29CE4, 0x84222325
_PRIME_LOW = 0x1B3  # the prime is 2**40 + 0x1b3


def fnv1a64(text: Column) -> Column:
    """FNV-1a of the UTF-8 bytes as a signed long. Two 32-bit halves keep products within a long under ANSI."""
    code = F.hex(text.cast("binary"))
    at = F.sequence(F.lit(0), F.octet_length(text) - 1)
    octets = F.when(F.octet_length(text) == 0, F.array().cast("array<long>")).otherwise(F.transform(at, lambda i: F.conv(code.substr(i * 2 + 1, F.lit(2)), 16, 10).cast("long")))
    start = F.struct(F.lit(_OFFSET_HI).cast("long").alias("hi"), F.lit(_OFFSET_LO).cast("long").alias("lo"))
    mask = F.lit(0xFFFFFFFF).cast("long")

    def step(acc: Column, b: Column) -> Column:
        lo = acc["lo"].bitwiseXOR(b)
        low = lo * _PRIME_LOW
        hi = acc["hi"] * _PRIME_LOW + F.shiftright(low, 32) + F.shiftleft(lo.bitwiseAND(F.lit(0xFFFFFF).cast("long")), 8)
        return F.struct(hi.bitwiseAND(mask).alias("hi"), low.bitwiseAND(mask).alias("lo"))

    return F.aggregate(octets, start, step, lambda acc: F.shiftleft(acc["hi"], 32).bitwiseOR(acc["lo"]))


def unsigned_text(v: Column) -> Column:
    """A long read as unsigned, in decimal digits."""
    return F.conv(F.hex(v), 16, 10)


def trajectory_id(user: Column, traj: Column, datetime: Column) -> Column:
    """Hash of the trajectory's name, or of user and datetime where it is empty."""
    named = F.coalesce(traj, F.lit(""))
    return fnv1a64(F.when(named == "", F.concat_ws("_", F.coalesce(user, F.lit("")), datetime)).otherwise(named))
