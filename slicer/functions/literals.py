"""SQL literals of column values as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DateType, MapType, NumericType, StringType, StructType, TimestampNTZType, TimestampType

from slicer.functions.identifiers import MYSQL, POSTGRES, SQLITE

#: What MySQL literals write for each special character.
MYSQL_ESCAPES = [("\\", "\\\\"), ("\0", "\\0"), ("\n", "\\n"), ("\r", "\\r"), ("'", "\\'"), ('"', '\\"'), ("\x1a", "\\Z")]
TEXT_WORDS = ("json", "char", "text", "enum", "set")


def quoted(engine: str, text: Column) -> Column:
    if engine == MYSQL:
        for plain, written in MYSQL_ESCAPES:
            text = F.replace(text, F.lit(plain), F.lit(written))
    else:
        text = F.replace(text, F.lit("'"), F.lit("''"))
    return F.concat(F.lit("'"), text, F.lit("'"))


def uuid_text(value: Column) -> Column:
    return F.regexp_replace(F.lower(F.hex(value)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def literal(engine: str, value: Column, kind, declared: str = "") -> Column:
    """The literal of ``value`` of Spark type ``kind``, declared as SQL type ``declared``; NULL if null."""
    if isinstance(kind, BooleanType):
        yes, no = ("1", "0") if engine in (MYSQL, SQLITE) else ("TRUE", "FALSE")
        text = F.when(value, yes).otherwise(no)
    elif isinstance(kind, NumericType):
        text = value.cast("string")
    elif isinstance(kind, BinaryType):
        low = declared.lower()
        if low == "uuid":
            text = quoted(engine, uuid_text(value))
        elif any(w in low for w in TEXT_WORDS):
            text = quoted(engine, F.decode(value, "UTF-8"))
        elif engine in (MYSQL, SQLITE):
            text = F.concat(F.lit("X'"), F.hex(value), F.lit("'"))
        else:
            text = F.concat(F.lit("'\\x"), F.lower(F.hex(value)), F.lit("'"))
    elif isinstance(kind, TimestampType | TimestampNTZType):
        utc = F.to_utc_timestamp(value, F.current_timezone()) if isinstance(kind, TimestampType) else value
        whole = F.date_format(utc, "yyyy-MM-dd HH:mm:ss")
        micros = F.date_format(utc, "SSSSSS")
        if engine in (MYSQL, SQLITE):
            text = F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))
        else:
            fraction = F.regexp_replace(F.concat(F.lit("."), micros), r"\.?0*$", "")
            text = F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("Z"))
        text = F.concat(F.lit("'"), text, F.lit("'"))
    elif isinstance(kind, DateType):
        text = F.concat(F.lit("'"), value.cast("string"), F.lit("'"))
    elif isinstance(kind, ArrayType | MapType | StructType):
        text = quoted(engine, F.to_json(value))
    elif isinstance(kind, StringType):
        text = quoted(engine, value)
    else:
        text = quoted(engine, value.cast("string"))
    return F.when(value.isNull(), F.lit("NULL")).otherwise(text)


def literals(engine: str, df: DataFrame, declared: dict[str, str] | None = None) -> list[Column]:
    """A literal for each column of ``df``."""
    return [literal(engine, F.col(f"`{f.name}`"), f.dataType, (declared or {}).get(f.name, "")) for f in df.schema]


def values_clause(engine: str, df: DataFrame, declared: dict[str, str] | None = None) -> Column:
    return F.concat_ws(", ", *literals(engine, df, declared))


__all__ = ["MYSQL", "POSTGRES", "SQLITE", "literal", "literals", "quoted", "uuid_text", "values_clause"]
