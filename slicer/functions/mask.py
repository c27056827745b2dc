"""Deterministic masking as native column expressions.

HMAC-SHA256 is written with ``sha2`` and two key blocks computed on the driver, so masking
stays in generated code. Which expression a column gets is decided at plan time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

from slicer.plans.config import Config

DEFAULT_SALT = "slicer-salt"

#: The shapes of masked values.
EMAIL_PREFIX, EMAIL_SUFFIX = "anon_", "@drain.local"
PHONE_PREFIX, NAME_PREFIX, LAST_NAME_PREFIX, TOKEN_PREFIX = "+1555", "User_", "Anon_", "tok_"
REDACTED = "[REDACTED]"
PASSWORD = "$2a$12$e8rG.e9y1dYv9fD1v1.X7fakehash"

Transform = Callable[["Masker", Column], Column]


@dataclass(frozen=True)
class Masker:
    salt: str = DEFAULT_SALT

    def pads(self) -> tuple[bytes, bytes]:
        key = self.salt.encode()
        key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
        return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)

    def hmac_hex(self, value: Column) -> Column:
        inner, outer = self.pads()
        digest = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(value, "UTF-8")), 256))
        return F.sha2(F.concat(F.lit(outer), digest), 256)

    def prefixed(self, value: Column, prefix: str, digits: int, suffix: str = "") -> Column:
        return F.concat(F.lit(prefix), F.substring(self.hmac_hex(value), 1, digits), F.lit(suffix))

    def uuid(self, value: Column) -> Column:
        h = self.hmac_hex(value)
        part = lambda a, n: F.substring(h, a, n)
        variant = F.translate(part(17, 1), "0123456789abcdef", "89ab" * 4)
        return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-4"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def constant(text: str) -> Transform:
    return lambda m, v: F.when(v.isNotNull(), F.lit(text))


#: Named transforms; users may register more (native expressions, or pandas UDFs).
TRANSFORMS: dict[str, Transform] = {
    "fake_email": lambda m, v: m.prefixed(v, EMAIL_PREFIX, 10, EMAIL_SUFFIX),
    "hmac_phone": lambda m, v: m.prefixed(v, PHONE_PREFIX, 7),
    "hmac_name": lambda m, v: m.prefixed(v, NAME_PREFIX, 6),
    "hmac_last_name": lambda m, v: m.prefixed(v, LAST_NAME_PREFIX, 6),
    "hmac_token": lambda m, v: m.prefixed(v, TOKEN_PREFIX, 16),
    "uuid_remap": lambda m, v: m.uuid(v),
    "redact": constant(REDACTED),
    "redact_password": constant(PASSWORD),
}


def register(name: str, transform: Transform) -> None:
    TRANSFORMS[name] = transform


def heuristic(column: str) -> str | None:
    """The transform that a column's name suggests; the first that fits."""
    c = column.lower()
    has = lambda *parts: any(p in c for p in parts)
    if c == "email" or c.endswith("_email"):
        return "fake_email"
    if has("phone", "mobile"):
        return "hmac_phone"
    if c == "last_name":
        return "hmac_last_name"
    if c == "name" or c.endswith("_name"):
        return "hmac_name"
    if has("password", "passwd"):
        return "redact_password"
    if has("token", "secret"):
        return "hmac_token"
    return None


def looks_private(column: str) -> bool:
    """A broader test than ``heuristic``: any private word anywhere in the name."""
    return any(w in column.lower() for w in ("email", "phone", "mobile", "name", "password", "passwd", "token", "secret"))


def transform_of(table: str, column: str, config: Config) -> str | None:
    """The transform of a column: its rule's, else (also for unknown names) the heuristic's."""
    rule = config.find_rule(table, column)
    if rule and rule.transform in TRANSFORMS:
        return rule.transform
    return heuristic(column)


def as_text(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    c = F.col(f"`{column}`")
    return F.to_json(c) if isinstance(kind, ArrayType | MapType | StructType | VariantType) else c.cast("string")


def mask_table(df: DataFrame, table: str, config: Config | None = None, masker: Masker | None = None) -> DataFrame:
    """One projection; masked columns become strings, nulls stay null."""
    config, masker = config or Config(), masker or Masker()
    out = []
    for c in df.columns:
        name = transform_of(table, c, config)
        out.append(TRANSFORMS[name](masker, as_text(df, c)).alias(c) if name else F.col(f"`{c}`"))
    return df.select(*out)


def key_warnings(model, config: Config) -> list[str]:
    """Foreign keys whose two sides would be masked differently."""
    out = []
    for fk in model.foreign_keys:
        for a, b in zip(fk.from_columns, fk.to_columns, strict=True):
            x, y = transform_of(fk.from_table, a, config), transform_of(fk.to_table, b, config)
            if x != y:
                out.append(f"{fk.from_table}.{a} is masked by {x}, {fk.to_table}.{b} by {y}; the masked keys will not join")
    return out
