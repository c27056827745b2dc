"""The schema model from catalog tables: columns, keys and partitions as DataFrames.

The inputs are DataFrames of ``information_schema`` rows (over JDBC, or any copy), so the same
code serves both engines. All results are sized by the schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicer.plans.model import Column, Distribution, Partition, Partitioned, SchemaModel, engine_warnings, group_keys


def ordered_columns(rows: DataFrame, by: list[str], column: str = "column_name", position: str = "ordinal_position") -> DataFrame:
    """``columns``: the column names of each group in their order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(column).alias("c"))))
    return rows.groupBy(*by).agg(F.transform(pairs, lambda s: s["c"]).alias("columns"))


def exploded_keys(keys: DataFrame) -> DataFrame:
    """One row for each column pair of keys that come as arrays (name, table, columns, to_table, to_columns)."""
    pairs = keys.select("name", "table", "to_table", F.posexplode(F.arrays_zip("columns", "to_columns")).alias("pos", "pair"))
    return pairs.select("name", "table", F.col("pair.columns").alias("column"), "to_table", F.col("pair.to_columns").alias("to_column"), (F.col("pos") + 1).alias("ordinal"))


def load(columns: DataFrame, primary: DataFrame, foreign: DataFrame, *, engines: DataFrame | None = None, partitions: DataFrame | None = None, distribution: DataFrame | None = None, shards: DataFrame | None = None) -> SchemaModel:
    """A model from catalog rows.

    columns: table_name, column_name, data_type, is_nullable (YES/NO), ordinal_position;
    primary: table_name, column_name, ordinal_position; foreign: constraint_name, table_name, column_name,
    referenced_table_name, referenced_column_name, ordinal_position; engines: table_name, engine;
    partitions: root, strategy, key, partition, bound; distribution: table_name, kind, column, colocation and perhaps method; shards: table_name.
    """
    m = SchemaModel()
    for r in columns.orderBy("table_name", "ordinal_position").collect():
        m.columns.setdefault(r.table_name, []).append(Column(r.column_name, r.data_type, str(r.is_nullable).upper() in ("YES", "TRUE"), r.ordinal_position))
    m.primary_keys = {r.table_name: tuple(r.columns) for r in ordered_columns(primary, ["table_name"]).collect()}
    m.foreign_keys = group_keys((r.constraint_name, r.table_name, r.column_name, r.referenced_table_name, r.referenced_column_name, r.ordinal_position) for r in foreign.orderBy("table_name", "constraint_name", "ordinal_position").collect())
    if engines is not None:
        m.engines = {r.table_name: r.engine for r in engines.collect()}
        m.warnings += engine_warnings(m.engines)
    if partitions is not None:
        groups: dict[str, list] = {}
        for r in partitions.orderBy("root", "partition").collect():
            groups.setdefault(r.root, []).append(r)
        for root, rows in groups.items():
            m.partitioned[root] = Partitioned(rows[0].strategy, rows[0].key, tuple(Partition(r.partition, r.bound) for r in rows))
            if not m.columns.get(root):  # a root without columns of its own has its children's
                m.columns[root] = list(m.columns.get(rows[0].partition, ()))
    if distribution is not None:
        m.distribution = {r.table_name: Distribution(r.kind, r.column or "", r.colocation or 0, r.asDict().get("method") or "") for r in distribution.collect()}
        for t in m.columns:
            m.distribution.setdefault(t, Distribution("local"))
    if shards is not None:
        m.shards = {r.table_name for r in shards.collect()}
    m.warnings += m.topology_warnings()
    return m
