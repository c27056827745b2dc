"""A fixed number of children for each parent, chosen by hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SEED = "slicer-sampling"


def sample_order(key: Sequence[str], seed: str) -> list[Column]:
    """MD5 of the first key column and the seed, then the whole key, so that the choice is total."""
    return [F.md5(F.concat(F.col(f"`{key[0]}`").cast("string"), F.lit(seed))), *(F.col(f"`{k}`") for k in key)]


def children_per_parent(df: DataFrame, parent: Sequence[str], key: Sequence[str], n: int, seed: str = DEFAULT_SEED) -> DataFrame:
    """At most ``n`` rows of each parent.

    The plain ``rank <= n`` is the same as keeping the first row of every parent and up to n
    of parents with more, and lets the planner limit each group before the shuffle.
    """
    if n < 1:
        return df
    w = Window.partitionBy(*(F.col(f"`{c}`") for c in parent)).orderBy(*sample_order(key, seed))
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n).drop("__rank")


def ranked_children(df: DataFrame, parent: Sequence[str], key: Sequence[str], seed: str = DEFAULT_SEED) -> DataFrame:
    """``df`` with rn and total_children, the unreduced form of the sampling query."""
    by = Window.partitionBy(*(F.col(f"`{c}`") for c in parent))
    return df.withColumn("rn", F.row_number().over(by.orderBy(*sample_order(key, seed))).cast("bigint")).withColumn("total_children", F.count("*").over(by))
