"""Digests of text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The offset basis of 64-bit FNV-1a; its prime is 2**40 + 435.
BASIS = 0xCBF29CE484222325


def fnv1a(text: Column) -> Column:
    """64-bit FNV-1a of the UTF-8 bytes, 16 hexadecimal digits; null of null.

    The state is held as two halves of 32 bits, so that no product leaves a long.
    """
    digits, low32 = F.hex(text.cast("binary")), (1 << 32) - 1
    byte = lambda i: F.conv(F.substring(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("long")
    start = F.struct(F.lit(BASIS >> 32).cast("long").alias("hi"), F.lit(BASIS & low32).cast("long").alias("lo"))

    def step(state: Column, i: Column) -> Column:
        lo = state["lo"].bitwiseXOR(byte(i))
        grown = lo * 435
        hi = (state["hi"] * 435 + F.shiftright(grown, 32) + F.shiftleft(lo, 8)).bitwiseAND(low32)
        return F.struct(hi.alias("hi"), grown.bitwiseAND(low32).alias("lo"))

    places = F.when(F.octet_length(text) > 0, F.sequence(F.lit(1), F.octet_length(text))).when(text.isNotNull(), F.array().cast("array<int>"))
    half = lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")
    return F.aggregate(places, start, step, lambda s: F.concat(half(s["hi"]), half(s["lo"])))
