"""Membership of rows in sets of keys: the one join that traversal is made of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pairs(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], null_safe: bool) -> Column:
    cond = None
    for a, b in on:
        x, y = left[f"`{a}`"], right[f"`{b}`"]
        if left.schema[a].dataType != right.schema[b].dataType and {left.schema[a].dataType.typeName(), right.schema[b].dataType.typeName()} & {"string"}:
            # a key and its text: an unparsable text matches nothing instead of failing
            x, y = (x.try_cast(right.schema[b].dataType), y) if left.schema[a].dataType.typeName() == "string" else (x, y.try_cast(left.schema[a].dataType))
        one = x.eqNullSafe(y) if null_safe else x == y
        cond = one if cond is None else cond & one
    return cond


def members(df: DataFrame, keys: DataFrame, on: Sequence[tuple[str, str]], *, null_safe: bool = False) -> DataFrame:
    """Rows of ``df`` whose columns equal those of some row of ``keys``; nulls match only if ``null_safe``."""
    keys = keys.select(*[F.col(f"`{b}`").alias(f"__k{i}") for i, (_, b) in enumerate(on)])
    return df.join(keys, _pairs(df, keys, [(a, f"__k{i}") for i, (a, _) in enumerate(on)], null_safe), "left_semi")


def others(df: DataFrame, keys: DataFrame, on: Sequence[tuple[str, str]], *, null_safe: bool = False) -> DataFrame:
    """Rows of ``df`` that ``members`` leaves out."""
    keys = keys.select(*[F.col(f"`{b}`").alias(f"__k{i}") for i, (_, b) in enumerate(on)])
    return df.join(keys, _pairs(df, keys, [(a, f"__k{i}") for i, (a, _) in enumerate(on)], null_safe), "left_anti")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
