"""Table sources: Parquet folders, catalog tables, JDBC."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicer.control import GUARDS
from slicer.errors import SourceError
from slicer.functions.identifiers import POSTGRES
from slicer.plans.anchor import Anchor
from slicer.sources.connections import SharedSnapshot, connect, fetch
from slicer.sources.dsn import detect_engine, jdbc_options


class TableSource(Protocol):
    def table(self, name: str) -> DataFrame: ...

    def names(self) -> list[str]: ...


class ParquetSource:
    """``path/name.parquet`` or ``path/name``, by any path that Spark reads. Files are immutable, so reads are one snapshot."""

    def __init__(self, spark: SparkSession, path: str, names: Iterable[str], suffix: str = ".parquet"):
        self.spark, self.path, self._names, self.suffix = spark, path.rstrip("/"), list(names), suffix

    def names(self) -> list[str]:
        return self._names

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}{self.suffix}")


class CatalogSource:
    """Tables of a database in the session's catalog; ``versions`` pins versioned tables to one snapshot."""

    def __init__(self, spark: SparkSession, database: str, versions: Mapping[str, int] | None = None):
        self.spark, self.database, self.versions = spark, database, dict(versions or {})

    def names(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(self.database) if not t.isTemporary)

    def table(self, name: str) -> DataFrame:
        version = f" VERSION AS OF {self.versions[name]}" if name in self.versions else ""
        return self.spark.sql(f"SELECT * FROM `{self.database}`.`{name}`{version}")


#: A transaction of its own for each read; several statements in one would need a driver setting.
MYSQL_SNAPSHOT = "START TRANSACTION WITH CONSISTENT SNAPSHOT, READ ONLY"
#: Rows a PostgreSQL driver holds at a time; without a number it fetches whole results, and outside a transaction.
FETCH_ROWS = "1000"
SPLITTING = {"numpartitions", "partitioncolumn"}


class JdbcSource:
    """Tables over JDBC (needs a driver; not run here).

    PostgreSQL: all reads import the snapshot that ``share_snapshot`` exports, so they see one state. MySQL: each read is
    a consistent snapshot of its own. Reads split into partitions are several transactions, so they are refused unless
    they share a snapshot.
    """

    def __init__(self, spark: SparkSession, connection: str, schema: str, names: Iterable[str] = (), bypass_policies: bool = False, **options: str):
        self.spark, self.schema, self._names, self.options = spark, schema, list(names), options
        self.engine = detect_engine(connection)
        self.connection = jdbc_options(connection)
        self.guards = list(GUARDS) if self.engine == POSTGRES else [MYSQL_SNAPSHOT]
        if self.engine == POSTGRES:
            self.options = {"fetchsize": FETCH_ROWS, **options}
        if bypass_policies and self.engine == POSTGRES:
            self.guards.append("SET row_security = off")
        self.snapshot: SharedSnapshot | None = None

    def names(self) -> list[str]:
        return self._names

    def share_snapshot(self, open_connection: Callable[[], object] | None = None) -> None:
        """From now on, all reads see the state of this moment (PostgreSQL only; elsewhere nothing happens)."""
        if self.engine == POSTGRES and self.snapshot is None:
            self.snapshot = SharedSnapshot((open_connection or (lambda: connect(self.spark, self.connection)))())

    def close(self) -> None:
        if self.snapshot:
            self.snapshot.close()
            self.snapshot = None

    def rows(self, statement: str) -> list[dict[str, object]]:
        """A small result over a short connection, for statements that cannot be a subquery."""
        c = connect(self.spark, self.connection)
        try:
            return fetch(c, statement)
        finally:
            c.close()

    def settings(self) -> dict[str, str]:
        """Options of a read."""
        if self.snapshot is None and SPLITTING & {k.lower() for k in self.options}:
            raise SourceError("a read in several partitions is no snapshot; share one (PostgreSQL) or read in one partition")
        first = self.snapshot.statements() if self.snapshot else []
        return {**self.connection, **self.options, "sessionInitStatement": "; ".join([*first, *self.guards])}

    def read(self, query: str) -> DataFrame:
        return self.spark.read.format("jdbc").options(**{k: v for k, v in self.settings().items() if k.lower() not in SPLITTING}, query=query).load()

    def table(self, name: str) -> DataFrame:
        where = f"{self.schema}.{name}" if self.schema and self.engine == POSTGRES else name
        return self.spark.read.format("jdbc").options(**self.settings(), dbtable=where).load()


def frames(source: TableSource) -> dict[str, DataFrame]:
    return {n: source.table(n) for n in source.names()}


def scan(df: DataFrame, columns: Iterable[str], anchor: Anchor | None = None, key: Iterable[str] = ()) -> DataFrame:
    """Chosen columns of the rows of an anchor, in the order of ``key`` where it has a limit."""
    if anchor and anchor.where:
        df = df.where(F.expr(anchor.where))
    if anchor and anchor.limit:
        df = df.orderBy(*[F.col(f"`{k}`") for k in key]).limit(anchor.limit)
    return df.select(*[F.col(f"`{c}`") for c in columns])
