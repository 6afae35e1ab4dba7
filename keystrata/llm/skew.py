"""Joins in which one key may hold any share of the rows.

Rows are salted by a hash of another of their columns. The side with one row a key is repeated for the salts
that occur with the key, known from an aggregate that combines before its shuffle, so rare keys are repeated no
more often than they have rows, and a key with a third of all rows is met in as many tasks as there are salts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 32


def salt_of(*columns: Column | str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def salt_bits(*columns: Column | str) -> Column:
    """An aggregate: the salts that occur, as the bits of one number."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), salt_of(*columns)))


def each_salt(bits: Column | str) -> Column:
    """One row for each salt of the bits."""
    return F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit(F.col(bits) if isinstance(bits, str) else bits, i) == 1))


def meet(many: DataFrame, few: DataFrame, key: str, by: str) -> DataFrame:
    """``many`` with the other columns of ``few`` (one row a key); rows of a key are spread by the column ``by``. Rows without a match go."""
    present = many.groupBy(key).agg(salt_bits(by).alias("__salts"))
    dealt = few.join(present, key).withColumn("__salt", each_salt("__salts")).drop("__salts")
    return many.withColumn("__salt", salt_of(by)).join(dealt, [key, "__salt"]).drop("__salt")
