"""Joins whose keys may hold a third of all rows.

A key with more rows than a task should hold is *hot*. There are at most MOST hot keys, whatever the
table's size, so they are broadcast. Rows of a hot key are dealt out to several tasks by a hash of
their own columns, and the other side's rows of that key are copied to each of these tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.runtime import materialize

#: Rows of a key that one task may hold at least, and the most keys that may have more.
LEAST, MOST = 250, 10_000


def hot_keys(counts: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """(key, parts) of the keys whose count exceeds LEAST and the MOST-th part of ``total`` rows."""
    room = max(LEAST, -(-total // MOST))
    hot = counts.filter(F.col(count) > room).select(key, F.ceil(F.col(count) / room).cast("int").alias("__parts"))
    return materialize(hot, "hot_keys")


def hot_keys_of(rows: DataFrame, key: str) -> DataFrame:
    """Hot keys of a table that is cheap to read again; partial sums leave one row a key and task."""
    return hot_keys(rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")), key, "__n", rows.count())


def salted_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, by: list[Column | str], how: str = "inner") -> DataFrame:
    """``left`` joined to ``right`` on ``key``, hot keys dealt out by a hash of left's columns ``by``."""
    hot = F.broadcast(hot)  # at most MOST rows
    salt = F.coalesce(F.pmod(F.xxhash64(*by), F.col("__parts")).cast("int"), F.lit(0))
    a = left.join(hot, key, "left").withColumn("__salt", salt).drop("__parts")
    b = right.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return a.join(b, [key, "__salt"], how).drop("__salt")
