"""Slices as Parquet and as SQL text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from typing import TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicer.control import Limiter
from slicer.functions.identifiers import MYSQL, POSTGRES, SQLITE
from slicer.operators.members import union_all
from slicer.operators.twophase import insert_statements, phase_one, update_statements
from slicer.plans import graph as graphs
from slicer.plans.graph import Graph
from slicer.plans.model import SchemaModel
from slicer.sinks import ddl


def batches(rows: Iterator, n: int) -> Iterator[list]:
    out: list = []
    for r in rows:
        out.append(r)
        if len(out) == n:
            yield out
            out = []
    if out:
        yield out


def write_parquet(tables: Mapping[str, DataFrame], path: str, mode: str = "errorifexists", limiter: Limiter | None = None) -> None:
    """A folder a table; as many tables at a time as the limiter has workers, one without it. Files have no rate."""
    limiter = limiter or Limiter(workers=1)

    def write(table: str) -> None:
        with limiter:
            tables[table].write.mode(mode).parquet(f"{path}/{table}")

    with ThreadPoolExecutor(limiter.workers) as pool:
        list(pool.map(write, tables))


def preamble(model: SchemaModel, graph: Graph, engine: str, tables: Iterable[str], with_ddl: bool = True) -> list[str]:
    out = ["-- slice of a database; rows are in dependency order", "BEGIN;"]
    if engine == POSTGRES and graphs.has_cycles(graph):
        out.append("SET CONSTRAINTS ALL DEFERRED;")
    if engine == SQLITE:
        out.append("PRAGMA defer_foreign_keys = ON;")
    if with_ddl:
        make = ddl.sqlite_table if engine == SQLITE else ddl.postgres_table if engine == POSTGRES else None
        out += [make(model, t) for t in tables] if make else []
    return out


def statements(tables: Mapping[str, DataFrame], model: SchemaModel, graph: Graph, engine: str = POSTGRES, schema: str = "public") -> DataFrame:
    """(phase, position, table_name, statement): INSERTs in dependency order, then UPDATEs of nulled cyclic keys.

    Only MySQL loads in two phases; the others defer their constraints.
    """
    cyclic = graphs.cyclic_nullable(model, graph) if engine == MYSQL else {}
    parts = []
    for i, (t, df) in enumerate(tables.items()):
        first = insert_statements(phase_one(df, cyclic.get(t, ())), engine, schema, t, model)
        parts.append(first.select(F.lit(1).alias("phase"), F.lit(i).alias("position"), F.lit(t).alias("table_name"), "statement"))
        for c in cyclic.get(t, ()):
            parts.append(update_statements(df, engine, schema, t, model, c).select(F.lit(2).alias("phase"), F.lit(i).alias("position"), F.lit(t).alias("table_name"), "statement"))
    return union_all(parts)


def write_sql(out: TextIO, tables: Mapping[str, DataFrame], model: SchemaModel, graph: Graph, engine: str = POSTGRES, schema: str = "public", with_ddl: bool = True, limiter: Limiter | None = None) -> None:
    """A dump to an open text file; rows stream through the driver one partition at a time, in no order within a table, at the limiter's rate."""
    for line in preamble(model, graph, engine, tables, with_ddl):
        out.write(line + "\n")
    # table after table in the order of the mapping, without a sort of the whole dump
    cyclic = graphs.cyclic_nullable(model, graph) if engine == MYSQL else {}
    parts = [insert_statements(phase_one(df, cyclic.get(t, ())), engine, schema, t, model) for t, df in tables.items()]
    parts += [update_statements(df, engine, schema, t, model, c) for t, df in tables.items() for c in cyclic.get(t, ())]
    for part in parts:
        for rows in batches(part.toLocalIterator(prefetchPartitions=True), 1000):
            if limiter:
                limiter.acquire(len(rows))
            out.writelines(r.statement + "\n" for r in rows)
    out.write("COMMIT;\n")


def write_sql_folder(tables: Mapping[str, DataFrame], model: SchemaModel, graph: Graph, path: str, engine: str = POSTGRES, schema: str = "public") -> None:
    """A dump as text files written by the executors, for slices too large for one: a folder a phase and table."""
    cyclic = graphs.cyclic_nullable(model, graph) if engine == MYSQL else {}
    for i, (t, df) in enumerate(tables.items()):
        insert_statements(phase_one(df, cyclic.get(t, ())), engine, schema, t, model).write.text(f"{path}/1-{i:04d}-{t}")
        for c in cyclic.get(t, ()):
            update_statements(df, engine, schema, t, model, c).write.text(f"{path}/2-{i:04d}-{t}-{c}")
