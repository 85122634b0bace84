"""Joins on keys of which a few may hold a third of all rows.

The rows of a hot key are spread over several salts by another column, and the other side is repeated once a salt, so that no
task gets all of them whatever the engine's own skew handling does."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftloom.session import shuffle_partitions


def hot_keys(counts: DataFrame, key: str, n: str) -> DataFrame:
    """(hot, salts) of the keys above a quarter of a task's share; counts: one row a key. 4 x partitions rows at most, as each
    stands for a quarter of a share of the rows."""
    parts = shuffle_partitions(counts.sparkSession)
    total = counts.agg(F.sum(n)).first()[0] or 0
    share = max(1, total // (4 * parts))
    return counts.where(F.col(n) > share).select(F.col(key).alias("hot"), F.ceil(F.col(n) / share).cast("int").alias("salts"))


def joined(left: DataFrame, right: DataFrame, key: str, spread: list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """Join (inner or left) on key, which right has once at most; hot: from hot_keys(), and so small enough to be sent to all."""
    table = F.broadcast(hot)
    salt = F.coalesce(F.pmod(F.xxhash64(*spread), F.col("salts")).cast("int"), F.lit(0))
    salted = left.join(table, F.col(key) == F.col("hot"), "left").withColumn("__salt", salt).drop("hot", "salts")
    repeated = right.join(table, F.col(key) == F.col("hot"), "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts") - 1, F.lit(0))))).drop("hot", "salts")
    return salted.join(repeated, [key, "__salt"], how).drop("__salt")
