"""CREATE TABLE statements from the schema model."""

from __future__ import annotations

from collections.abc import Iterable

from slicer.functions.identifiers import POSTGRES, SQLITE, quote
from slicer.functions.sqltypes import INT_NAMES, affinity, base_type
from slicer.plans.model import DISTRIBUTED, REFERENCE, Column, SchemaModel

STRATEGIES = ("RANGE", "LIST", "HASH")


def distribution_ddl(model: SchemaModel, table: str) -> str:
    d = model.distribution.get(table)
    if d and d.kind == REFERENCE:
        return f"SELECT create_reference_table('{table}');"
    if d and d.kind == DISTRIBUTED and d.column:
        return f"SELECT create_distributed_table('{table}', '{d.column}');"
    return ""


def postgres_table(model: SchemaModel, table: str) -> str:
    """The table, its partitions and its distribution; empty if unknown."""
    cols = model.columns.get(table)
    if not cols:
        return ""
    q = lambda name: quote(POSTGRES, name)
    lines = [f"  {q(c.name)} {c.data_type}{'' if c.nullable else ' NOT NULL'}" for c in cols]
    if key := model.primary_keys.get(table):
        lines.append(f"  PRIMARY KEY ({', '.join(map(q, key))})")
    body, part = ",\n".join(lines), model.partitioned.get(table)
    out = [f"CREATE TABLE IF NOT EXISTS {q(table)} (\n{body}\n)"]
    if part:
        by = part.key if part.key.strip().upper().startswith(STRATEGIES) else f"{part.strategy} {part.key}"
        out[0] += f" PARTITION BY {by}"
        out += [f"CREATE TABLE IF NOT EXISTS {q(p.name)} PARTITION OF {q(table)} {p.bound}" for p in part.partitions]
    text = "\n".join(f"{s};" for s in out)
    extra = distribution_ddl(model, table)
    return f"{text}\n{extra}" if extra else text


def sqlite_column(c: Column, only_key: bool) -> str:
    """A column's definition; an integer column that is the whole key counts by itself."""
    name = quote(SQLITE, c.name)
    if only_key:
        base = base_type(c.data_type)
        return f"{name} INTEGER PRIMARY KEY AUTOINCREMENT" if base in INT_NAMES or base == "auto_increment" else f"{name} {affinity(c.data_type)} PRIMARY KEY"
    return f"{name} {affinity(c.data_type)}{'' if c.nullable else ' NOT NULL'}"


def sqlite_table(model: SchemaModel, table: str) -> str:
    key = model.primary_keys.get(table, ())
    names = lambda cols: ", ".join(quote(SQLITE, c) for c in cols)
    lines = [sqlite_column(c, key == (c.name,)) for c in model.columns[table]]
    if len(key) > 1:
        lines.append(f"PRIMARY KEY ({names(key)})")
    lines += [f"FOREIGN KEY ({names(fk.from_columns)}) REFERENCES {quote(SQLITE, fk.to_table)} ({names(fk.to_columns)})" for fk in model.foreign_keys if fk.from_table == table]
    return f"CREATE TABLE IF NOT EXISTS {quote(SQLITE, table)} (\n" + ",\n".join(f"  {x}" for x in lines) + "\n);"


def sqlite_schema(model: SchemaModel, tables: Iterable[str] = ()) -> str:
    """All given tables (else all), without partitions and shards."""
    return "\n\n".join(sqlite_table(model, t) for t in (list(tables) or model.tables()) if t in model.columns and not model.is_partition(t) and not model.is_shard(t))
