"""The manifest: one row for each row of a slice, in order, in pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicer.operators.members import union_all
from slicer.operators.traverse import Slice

PAGE = 1000


def key_text(columns: list[str]):
    """The key's columns as text, joined by commas; only for display and order."""
    return F.concat_ws(",", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("<nil>")) for c in columns])


def manifest(cut: Slice) -> DataFrame:
    """table_name, pk, role, depth."""
    return union_all([df.select(F.lit(t).alias("table_name"), key_text(cut.model.key(t)).alias("pk"), "role", "depth") for t, df in cut.roles.items()])


def row_counts(cut: Slice) -> DataFrame:
    """table_name, rows."""
    return union_all([df.groupBy().agg(F.count("*").alias("rows")).select(F.lit(t).alias("table_name"), "rows") for t, df in cut.roles.items()])


def seek_page(rows: DataFrame, after: tuple[str, str] | None = None, n: int = PAGE) -> tuple[DataFrame, tuple[str, str] | None, bool]:
    """The ``n`` rows strictly after (table_name, pk), the cursor of the last and whether more follow."""
    n = n if n > 0 else PAGE
    if after is not None:
        rows = rows.where((F.col("table_name") > after[0]) | ((F.col("table_name") == after[0]) & (F.col("pk") > after[1])))
    found = rows.dropDuplicates(["table_name", "pk"]).orderBy("table_name", "pk").limit(n + 1).collect()  # a page
    page = found[:n]
    frame = rows.sparkSession.createDataFrame(page, rows.schema)
    return frame, ((page[-1].table_name, page[-1].pk) if page else after), len(found) > n


def pages(rows: DataFrame, n: int = PAGE) -> Iterator[list]:
    """All pages in order."""
    page: list = []
    for row in rows.dropDuplicates(["table_name", "pk"]).orderBy("table_name", "pk").toLocalIterator(prefetchPartitions=True):
        page.append(row)
        if len(page) == n:
            yield page
            page = []
    if page:
        yield page


def paginate(rows: DataFrame, n: int, each: Callable[[list], None]) -> None:
    """Call ``each`` with every page; an exception stops it."""
    for page in pages(rows, n):
        each(page)


def keyset_sql(table: str, key: list[str], n: int, cursor: list[str] | None = None) -> str:
    """A seek query over the key's columns as a row comparison."""
    cols = ", ".join(f"`{c}`" for c in key)
    where = f" WHERE ({cols}) > ({', '.join(cursor)})" if cursor else ""
    return f"SELECT {cols} FROM `{table}`{where} ORDER BY {cols} LIMIT {n}"
