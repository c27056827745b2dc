"""Anchor expressions: ``table [WHERE predicate] [LIMIT n]``."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from slicer.errors import ConfigError


@dataclass(frozen=True)
class Anchor:
    table: str
    where: str = ""
    limit: int = 0


def parse_anchor(text: str) -> Anchor:
    """Keywords in any case; a trailing LIMIT is taken first; what follows the table without WHERE is ignored."""
    rest, limit = text.strip(), 0
    if m := re.search(r"\sLIMIT\s+([0-9]+)\s*$", rest, re.I):
        limit, rest = int(m[1]), rest[: m.start()].strip()
    if m := re.match(r"(\S+)\s+WHERE\s+(.+)$", rest, re.I):
        return Anchor(m[1], m[2], limit)
    parts = rest.split()
    if not parts:
        raise ConfigError("the anchor expression is empty")
    return Anchor(parts[0], "", limit)


def parse_anchors(texts: Iterable[str]) -> list[Anchor]:
    out = [parse_anchor(t) for t in texts]
    if not out:
        raise ConfigError("at least one anchor is required")
    return out
