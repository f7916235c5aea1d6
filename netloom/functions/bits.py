"""Bit strings, packing, and codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_bits(text: Column) -> Column:
    """'0101' as array<boolean>; only '1' is true. The empty string has no bits."""
    return F.when(F.length(text) == 0, F.array().cast("array<boolean>")).otherwise(F.transform(F.split(text, ""), lambda c: c == "1"))


def bits_at(places: Column, length: int = 121) -> Column:
    """'0/1' string of ``length`` with ones at the array ``places``."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.when(F.array_contains(places, i), "1").otherwise("0")), "")


def stimulus(text: Column) -> Column:
    """struct(name, bits) of 'NAME=0,1,1'; any other form raises."""
    ok = text.rlike(r"^[^=]+=[01](,[01])*$")
    parts = F.split(text, "=", 2)
    good = F.when(ok, parts).otherwise(F.raise_error(F.concat(F.lit("not NAME=0,1,...: "), text)).cast("array<string>"))
    return F.struct(good[0].alias("name"), F.transform(F.split(good[1], ","), lambda x: x == "1").alias("bits"))


def packed(bit: Column, place: Column) -> Column:
    """Aggregate: sum of bits shifted to their places, first bit lowest."""
    return F.sum(F.when(bit, F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))).otherwise(F.lit(0).cast("long")))


def text_until_nul(codes: Column) -> Column:
    """Characters of an array of codes up to the first 0."""
    end = F.array_position(codes, F.lit(0).cast("long"))
    shown = F.when(end > 0, F.slice(codes, 1, (end - 1).cast("int"))).otherwise(codes)
    return F.array_join(F.transform(shown, lambda c: F.chr(c)), "")
