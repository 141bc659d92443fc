"""Hashes of text by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Offset basis and prime of FNV-1a with 64 bits.
BASIS, PRIME = 0xCBF29CE484222325, 0x100000001B3
_LOW = 0xFFFFFFFF


def fnv1a64(text: Column) -> Column:
    """The FNV-1a hash of the UTF-8 bytes as a double, rounded once; null for null.

    The state is two halves of 32 bits, so no product leaves the range of a long: the prime is 2**40 and a small rest, and
    multiplying by 2**40 moves the low half eight bits up into the high one.
    """
    rest = PRIME - (1 << 40)
    high, low = (F.lit(x).cast("long").alias(n) for x, n in ((BASIS >> 32, "high"), (BASIS & _LOW, "low")))

    def step(state: Column, byte: Column) -> Column:
        x = state["low"].bitwiseXOR(F.conv(byte, 16, 10).cast("long"))
        product = x * rest
        carried = state["high"] * rest + F.shiftright(product, 32) + F.shiftleft(x, 8)
        return F.struct(carried.bitwiseAND(F.lit(_LOW)).alias("high"), product.bitwiseAND(F.lit(_LOW)).alias("low"))

    of_bytes = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), 1)
    return F.aggregate(of_bytes, F.struct(high, low), step, lambda s: s["high"].cast("double") * float(1 << 32) + s["low"].cast("double"))
