"""Declared SQL types as SQLite affinities, and key types."""

from __future__ import annotations

#: Names of types by what they map to. Tests go from top to bottom.
TEXT_NAMES = {"uuid", "enum", "inet", "cidr", "macaddr", "date", "time"}
TEXT_PARTS = ("json", "array", "timestamp", "datetime")
INTEGER_NAMES = {"boolean", "bool"}
NUMERIC_PARTS = ("numeric", "decimal")
INT_NAMES = set("serial bigserial smallserial int integer bigint smallint tinyint mediumint int4 int8 int2".split())
REAL_NAMES = {"float", "double", "real", "double precision", "float4", "float8"}
BLOB_NAMES = {"bytea", "blob"}


def base_type(declared: str) -> str:
    return declared.strip().lower().partition("(")[0].strip()


def affinity(declared: str) -> str:
    """The SQLite storage class of a declared type; TEXT if nothing fits."""
    base = base_type(declared)
    within = lambda parts: any(p in base for p in parts)
    if base in TEXT_NAMES or within(TEXT_PARTS) or base.endswith("[]"):
        return "TEXT"
    if base in INTEGER_NAMES:
        return "INTEGER"
    if within(NUMERIC_PARTS):
        return "NUMERIC"
    if base in INT_NAMES:
        return "INTEGER"
    if base in REAL_NAMES:
        return "REAL"
    if base in BLOB_NAMES or "binary" in base:
        return "BLOB"
    return "TEXT"


def key_type(declared: str) -> str:
    """What keys of a declared type are compared as: bigint, uuid or text."""
    base = base_type(declared)
    if base in {"smallint", "int", "integer", "bigint", "int2", "int4", "int8", "serial", "bigserial", "smallserial"}:
        return "bigint"
    return "uuid" if base == "uuid" else "text"
