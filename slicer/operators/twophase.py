"""Cyclic keys in two phases: rows with the keys nulled, then the keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicer.functions.identifiers import MYSQL, quote, quote_table
from slicer.functions.literals import literal, values_clause
from slicer.plans.model import SchemaModel


def phase_one(df: DataFrame, cyclic: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in cyclic}) if cyclic else df


def phase_two(df: DataFrame, key: Sequence[str], column: str) -> DataFrame:
    """The key and the value to restore, for rows that have one."""
    return df.where(F.col(f"`{column}`").isNotNull()).select(*[F.col(f"`{c}`") for c in dict.fromkeys([*key, column])])


def insert_statements(df: DataFrame, engine: str, schema: str, table: str, model: SchemaModel) -> DataFrame:
    """One INSERT a row, as ``statement``."""
    columns = ", ".join(quote(engine, c) for c in df.columns)
    declared = {c: model.column(table, c).data_type for c in df.columns}
    tail = ");" if engine == MYSQL else ") ON CONFLICT DO NOTHING;"
    head = f"INSERT INTO {quote_table(engine, schema, table)} ({columns}) VALUES ("
    return df.select(F.concat(F.lit(head), values_clause(engine, df, declared), F.lit(tail)).alias("statement"))


def update_statements(df: DataFrame, engine: str, schema: str, table: str, model: SchemaModel, column: str) -> DataFrame:
    """One UPDATE for each row with a value in ``column``, as ``statement``."""
    key = model.key(table)
    of = lambda c: literal(engine, F.col(f"`{c}`"), df.schema[c].dataType, model.column(table, c).data_type)

    def joined(parts: list[Column], between: str) -> Column:
        return F.concat_ws(between, *parts)

    where = joined([F.concat(F.lit(f"{quote(engine, c)} = "), of(c)) for c in key], " AND ")
    text = F.concat(F.lit(f"UPDATE {quote_table(engine, schema, table)} SET {quote(engine, column)} = "), of(column), F.lit(" WHERE "), where, F.lit(";"))
    return phase_two(df, key, column).select(text.alias("statement"))
