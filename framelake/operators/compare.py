"""Comparison of two tables within a tolerance.

Rows are dealt to ranges by a hash of their keys, and both tables are digested by range first: a count, an exclusive or and a sum of two hashes of keys and value. Partial
digests leave some hundred rows of each task to shuffle. Only rows of ranges whose digests differ are joined: tables that are equal shuffle digests alone, and one row
that differs brings its range along. What is within the tolerance makes digests differ too, so a digest never hides a mismatch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _digests(rows: DataFrame, n: int) -> DataFrame:
    """A row for each range: (range, digest)."""
    hashes = [F.xxhash64(F.lit(k), "row") for k in (1, 2)]
    # sums of the hashes' halves, which no number of rows makes too large
    sums = [F.sum(part).alias(f"s{k}") for k, part in enumerate((F.shiftrightunsigned(hashes[1], 32), hashes[1].bitwiseAND(0xFFFFFFFF)))]
    totals = rows.groupBy("range").agg(F.count("*").alias("n"), F.bit_xor(hashes[0]).alias("x"), *sums)
    return totals.select("range", F.struct("n", "x", "s0", "s1").alias("digest"))


def differing_ranges(a: DataFrame, b: DataFrame, n: int) -> DataFrame:
    """(range) of the ranges, n at most, whose digests differ. a, b: (range, row)."""
    both = _digests(a, n).join(_digests(b, n).withColumnRenamed("digest", "other"), "range", "full")
    return both.where(~F.col("digest").eqNullSafe(F.col("other"))).select("range")


def compare_tables(a: DataFrame, b: DataFrame, *, keys: Sequence[str], value: str, tol: float = 1, digests: int = 1_024) -> DataFrame:
    """The keys at which the values differ by more than tol, or which only one side has: keys, a, b.

    keys name a row once. digests: the number of ranges; 0 joins all rows at once. Null values are mismatches, and null keys have no partner.
    """
    a, b = a.select(*keys, F.col(value).alias("a")), b.select(*keys, F.col(value).alias("b"))
    if digests:
        a, b = _only_different(a, b, list(keys), digests)
    both = a.join(b, list(keys), "full")
    return both.where((F.abs(F.col("a") - F.col("b")) > tol) | F.col("a").isNull() | F.col("b").isNull())


def _only_different(a: DataFrame, b: DataFrame, keys: list[str], n: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ranges that differ, and those with nulls, which a join would report in any case."""
    # columns of two types are hashed as text, in which equal whole numbers are equal
    same = [a.schema[k].dataType == b.schema[k].dataType for k in keys]
    alike = a.schema["a"].dataType == b.schema["b"].dataType
    name = [F.col(f"`{k}`") if s else F.col(f"`{k}`").cast("string") for k, s in zip(keys, same, strict=True)]
    range_ = F.pmod(F.xxhash64(*name), F.lit(n)).alias("range")
    row = lambda c: F.struct(*(x.alias(f"c{i}") for i, x in enumerate([*name, F.col(c) if alike else F.col(c).cast("string")]))).alias("row")
    different = F.broadcast(differing_ranges(a.select(range_, row("a")), b.select(range_, row("b")), n))  # n rows at most
    empty = lambda c: F.greatest(*(F.col(x).isNull().cast("int") for x in (*(f"`{k}`" for k in keys), c))) == 1
    kept = lambda df, c: df.withColumn("range", range_).join(different, "range", "left_semi").drop("range").where(~empty(c)).unionByName(df.where(empty(c)))
    return kept(a, "a"), kept(b, "b")


def compare_summary(a: DataFrame, b: DataFrame, *, keys: Sequence[str], value: str, tol: float = 1, digests: int = 1_024) -> DataFrame:
    """n_errors and the largest difference."""
    return compare_tables(a, b, keys=keys, value=value, tol=tol, digests=digests).agg(F.count("*").alias("n_errors"), F.max(F.abs(F.col("a") - F.col("b"))).alias("max_difference"))


def first_mismatch(a: DataFrame, b: DataFrame, *, keys: Sequence[str], value: str, tol: float = 1, n: int = 1, digests: int = 1_024) -> DataFrame:
    """The first n mismatches in the order of the keys."""
    return compare_tables(a, b, keys=keys, value=value, tol=tol, digests=digests).orderBy(*keys).limit(n)
