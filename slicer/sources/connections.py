"""Short connections of the driver to a database, beside Spark's own reads (need a driver on the class path; not run here)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession

from slicer.errors import SourceError


def connect(spark: SparkSession, options: Mapping[str, str]):
    """A JDBC connection with the url, user and password options of Spark's source."""
    jvm = spark._jvm
    given = jvm.java.util.Properties()
    for k, v in options.items():
        if k != "url":
            given.setProperty(k, v)
    return jvm.java.sql.DriverManager.getConnection(options["url"], given)


def fetch(connection, statement: str) -> list[dict[str, object]]:
    """All rows of a small result, by lower-case column name."""
    s = connection.createStatement()
    try:
        rows, out = s.executeQuery(statement), []
        about = rows.getMetaData()
        names = [about.getColumnLabel(k + 1).lower() for k in range(about.getColumnCount())]
        while rows.next():
            out.append({n: rows.getString(k + 1) for k, n in enumerate(names)})
        return out
    finally:
        s.close()


class SharedSnapshot:
    """An exported PostgreSQL snapshot: reads that import it see one state of the database, whatever their number.

    The exporting transaction stays open until ``close``; its session has no idle limit of its own.
    """

    def __init__(self, connection):
        self.connection = connection
        connection.setAutoCommit(False)
        s = connection.createStatement()
        s.execute("SET TRANSACTION ISOLATION LEVEL REPEATABLE READ, READ ONLY")
        s.close()
        rows = fetch(connection, "SELECT pg_export_snapshot() AS id")
        if not rows or not rows[0]["id"]:
            raise SourceError("the source exports no snapshot")
        self.id = str(rows[0]["id"])

    def statements(self) -> list[str]:
        """What a reading transaction begins with."""
        return ["SET TRANSACTION ISOLATION LEVEL REPEATABLE READ, READ ONLY", f"SET TRANSACTION SNAPSHOT '{self.id}'"]

    def close(self) -> None:
        self.connection.rollback()
        self.connection.close()
