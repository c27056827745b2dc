"""A database's own catalog as a schema model (over JDBC: needs a driver; not run here).

``read`` runs a query and returns a DataFrame. Keys that leave the schema are not followed. All results are
sized by the schema.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicer.functions.identifiers import MYSQL
from slicer.plans.model import DISTRIBUTED, REFERENCE, SchemaModel
from slicer.sources import catalog

Read = Callable[[str], DataFrame]

COLUMNS = """SELECT c.table_name::text AS table_name, c.column_name::text AS column_name, c.data_type::text AS data_type, c.is_nullable::text AS is_nullable, c.ordinal_position::int AS ordinal_position
FROM information_schema.columns c JOIN information_schema.tables t USING (table_schema, table_name)
WHERE t.table_type = 'BASE TABLE' AND table_schema = {schema}"""
#: Primary and foreign keys with their columns as arrays in the keys' order. Keys that partitions inherit are left to their roots.
KEYS = """SELECT k.conname::text AS name, k.contype::text AS kind, child.relname::text AS "table", parent.relname::text AS to_table,
ARRAY(SELECT a.attname::text FROM generate_subscripts(k.conkey, 1) i JOIN pg_attribute a ON a.attrelid = k.conrelid AND a.attnum = k.conkey[i] ORDER BY i) AS columns,
ARRAY(SELECT a.attname::text FROM generate_subscripts(k.confkey, 1) i JOIN pg_attribute a ON a.attrelid = k.confrelid AND a.attnum = k.confkey[i] ORDER BY i) AS to_columns
FROM pg_constraint k JOIN pg_class child ON child.oid = k.conrelid LEFT JOIN pg_class parent ON parent.oid = k.confrelid
WHERE k.contype IN ('p', 'f') AND k.conparentid = 0 AND child.relnamespace = {schema}::regnamespace AND (parent.oid IS NULL OR parent.relnamespace = child.relnamespace)"""
PARTITIONS = """SELECT r.relname::text AS root, p.partstrat::text AS strategy, pg_get_partkeydef(r.oid) AS key, part.relname::text AS partition, pg_get_expr(part.relpartbound, part.oid) AS bound
FROM pg_partitioned_table p JOIN pg_class r ON r.oid = p.partrelid JOIN pg_inherits i ON i.inhparent = r.oid JOIN pg_class part ON part.oid = i.inhrelid
WHERE r.relnamespace = {schema}::regnamespace"""
#: Whether the tables are dealt over a cluster, by its extension or its view.
CLUSTER = """SELECT EXISTS (SELECT 1 FROM pg_extension WHERE extname = 'citus') OR EXISTS (SELECT 1 FROM pg_views WHERE viewname = 'citus_tables') AS present"""
DEALT = """SELECT t.relname::text AS table_name, v.citus_table_type::text AS kind, v.distribution_column::text AS "column", v.colocation_id::int AS colocation, d.partmethod::text AS method
FROM citus_tables v JOIN pg_class t ON t.oid = v.table_name LEFT JOIN pg_dist_partition d ON d.logicalrelid = t.oid WHERE t.relnamespace = {schema}::regnamespace"""
#: The same where the view is missing.
DEALT_BEFORE = """SELECT t.relname::text AS table_name, NULL::text AS kind, column_to_column_name(d.logicalrelid, d.partkey)::text AS "column", d.colocationid::int AS colocation, d.partmethod::text AS method
FROM pg_dist_partition d JOIN pg_class t ON t.oid = d.logicalrelid WHERE t.relnamespace = {schema}::regnamespace"""
SHARDS = """SELECT DISTINCT t.relname || '_' || s.shardid AS table_name FROM pg_dist_shard s JOIN pg_class t ON t.oid = s.logicalrelid"""
#: Codes of partition strategies and of how tables are dealt.
STRATEGIES = {"r": "RANGE", "l": "LIST", "h": "HASH"}
METHODS = {"h": "hash", "n": "reference", "r": "range", "a": "append"}

MYSQL_COLUMNS = """SELECT c.table_name AS table_name, c.column_name AS column_name, c.data_type AS data_type, c.is_nullable AS is_nullable, c.ordinal_position AS ordinal_position
FROM information_schema.columns c JOIN information_schema.tables t ON t.table_schema = c.table_schema AND t.table_name = c.table_name
WHERE t.table_type = 'BASE TABLE' AND c.table_schema = database()"""
MYSQL_KEYS = """SELECT constraint_name AS constraint_name, table_name AS table_name, column_name AS column_name, referenced_table_schema AS to_schema, referenced_table_name AS referenced_table_name,
referenced_column_name AS referenced_column_name, ordinal_position AS ordinal_position, database() AS own_schema FROM information_schema.key_column_usage WHERE table_schema = database()"""
MYSQL_ENGINES = "SELECT table_name AS table_name, engine AS engine FROM information_schema.tables WHERE table_schema = database() AND table_type = 'BASE TABLE'"


def coded(column: str, codes: dict[str, str], other: Column | None = None) -> Column:
    out = F.lit(None).cast("string")
    for code, text in codes.items():
        out = F.when(F.col(column) == code, text).otherwise(out)
    return F.coalesce(out, F.col(column) if other is None else other)


def cluster(read: Read, schema: str) -> dict[str, DataFrame]:
    """The distribution and shards of a cluster's tables; nothing where there is no cluster."""
    if not read(CLUSTER).first()["present"]:
        return {}
    try:
        dealt = read(DEALT.format(schema=schema))
        dealt.limit(0).collect()
    except Exception:  # no such view, or other columns
        dealt = read(DEALT_BEFORE.format(schema=schema))
    everywhere = F.coalesce(F.lower("kind").contains(REFERENCE), F.col("method") == "n", F.lit(False))
    dealt = dealt.select("table_name", F.when(everywhere, REFERENCE).otherwise(DISTRIBUTED).alias("kind"), F.when(~everywhere, F.col("column")).alias("column"), "colocation", coded("method", METHODS, F.lit("hash")).alias("method"))
    return {"distribution": dealt, "shards": read(SHARDS)}


def postgres(read: Read, schema: str) -> SchemaModel:
    at = "'" + schema.replace("'", "''") + "'"
    keys = read(KEYS.format(schema=at)).cache()
    try:
        primary = keys.where("kind = 'p'").select(F.col("table").alias("table_name"), F.posexplode("columns").alias("ordinal_position", "column_name"))
        foreign = catalog.exploded_keys(keys.where("kind = 'f'")).toDF("constraint_name", "table_name", "column_name", "referenced_table_name", "referenced_column_name", "ordinal_position")
        partitions = read(PARTITIONS.format(schema=at)).withColumn("strategy", coded("strategy", STRATEGIES))
        return catalog.load(read(COLUMNS.format(schema=at)), primary, foreign, partitions=partitions, **cluster(read, at))
    finally:
        keys.unpersist()


def mysql(read: Read) -> SchemaModel:
    keys = read(MYSQL_KEYS)
    foreign = keys.where("referenced_table_name IS NOT NULL AND to_schema = own_schema")
    return catalog.load(read(MYSQL_COLUMNS), keys.where("constraint_name = 'PRIMARY'"), foreign, engines=read(MYSQL_ENGINES))


def read_model(read: Read, engine: str, schema: str) -> SchemaModel:
    """The model of a database; physical shards are no tables of it."""
    model = mysql(read) if engine == MYSQL else postgres(read, schema)
    for t in [t for t in model.columns if model.is_shard(t)]:
        del model.columns[t]
    model.primary_keys = {t: k for t, k in model.primary_keys.items() if t in model.columns}
    model.foreign_keys = [k for k in model.foreign_keys if k.from_table in model.columns and k.to_table in model.columns]
    return model


def logical_tables(model: SchemaModel) -> list[str]:
    """The tables to read: a root stands for its partitions."""
    return [t for t in model.tables() if not model.is_partition(t)]
