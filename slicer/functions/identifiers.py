"""Quoted identifiers of each engine."""

from __future__ import annotations

POSTGRES, MYSQL, SQLITE = "postgres", "mysql", "sqlite"


def quote(engine: str, name: str) -> str:
    mark = "`" if engine == MYSQL else '"'
    return mark + name.replace(mark, mark * 2) + mark


def quote_table(engine: str, schema: str, table: str) -> str:
    return quote(engine, table) if engine == SQLITE or not schema else f"{quote(engine, schema)}.{quote(engine, table)}"


def quote_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def quoted_list(values) -> str:
    return ", ".join(map(quote_text, values))


def plain_identifier(name: str) -> str:
    """Letters, digits and underscores; anything else becomes an underscore."""
    return "".join(c if c.isascii() and (c.isalnum() or c == "_") else "_" for c in name)
