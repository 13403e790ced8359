"""Scalar functions on integers and strings, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log2_int(c: Column) -> Column:
    """floor(log2(c)), exact for all positive integers; 0 for 0 and below."""
    return F.when(c <= 0, F.lit(0)).otherwise(F.length(F.bin(c)) - 1).cast("bigint")


def average_of_two(a: Column, b: Column) -> Column:
    """(a + b) / 2, rounded down, without overflow."""
    return a.bitwiseAND(b) + F.shiftright(a.bitwiseXOR(b), 1)


def bit(c: Column, place: int) -> Column:
    return F.getbit(c, F.lit(place)).cast("int")


def without_padding(c: Column) -> Column:
    """A fixed-size string without its trailing NUL bytes."""
    return F.rtrim(c, F.lit("\0"))


def search_sorted(sorted_values: Column, value: Column) -> Column:
    """How many elements of an ascending array are less than the value: where it belongs."""
    return F.size(F.filter(sorted_values, lambda x: x < value))
