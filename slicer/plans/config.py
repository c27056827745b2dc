"""Configuration: masking rules, polymorphic keys, associations."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

import yaml

from slicer.errors import ConfigError

DEFAULT_FILE = "slicer.yaml"


@dataclass(frozen=True)
class Rule:
    table: str
    column: str
    transform: str


@dataclass(frozen=True)
class VirtualKey:
    """A polymorphic key: ``mappings`` gives the parent table and column of each discriminator value."""

    child_table: str
    child_column: str
    discriminator: str
    mappings: tuple[tuple[str, str, str], ...]


@dataclass(frozen=True)
class Association:
    source: str
    target: str
    skip: bool = False
    condition: str = ""


@dataclass
class Config:
    rules: list[Rule] = field(default_factory=list)
    virtual_keys: list[VirtualKey] = field(default_factory=list)
    associations: list[Association] = field(default_factory=list)

    def find_rule(self, table: str, column: str) -> Rule | None:
        """The most specific rule; of equal ones the first listed."""
        best, most = None, -1
        for r in self.rules:
            s = match_score(r, table, column)
            if s > most:
                best, most = r, s
        return best

    def find_association(self, source: str, target: str) -> Association | None:
        return next((a for a in self.associations if glob_match(a.source, source) and glob_match(a.target, target)), None)

    def edge(self, current: str, destination: str) -> tuple[bool, str]:
        """(skip, predicate on the destination) of a step; a skip in either orientation drops the edge."""
        there, back = self.find_association(current, destination), self.find_association(destination, current)
        return bool(there and there.skip or back and back.skip), there.condition if there else ""


def glob_match(pattern: str, value: str) -> bool:
    """``*`` stands for any text, everything else for itself."""
    return re.fullmatch(".*".join(map(re.escape, pattern.split("*"))), value, re.S) is not None


def match_score(rule: Rule, table: str, column: str) -> int:
    """-1 without a match; exact table 4, glob 2, ``*`` 0; exact column 2, glob 1, ``*`` 0."""
    if not (glob_match(rule.table, table) and glob_match(rule.column, column)):
        return -1
    of_table = 4 if rule.table == table else 0 if rule.table == "*" else 2
    return of_table + (2 if rule.column == column else 0 if rule.column == "*" else 1)


def table_column(text: str) -> tuple[str, str]:
    table, dot, column = text.partition(".")
    if not (table and dot and column):
        raise ConfigError(f"expected table.column, got {text!r}")
    return table, column


def restriction(value: object) -> tuple[bool, str]:
    """(skip, condition) of an association's restriction: false, true or a predicate."""
    if value is None or value is True:
        return False, ""
    if value is False:
        return True, ""
    if isinstance(value, str):
        return False, value
    raise ConfigError(f"restriction must be a boolean or a predicate, got {value!r}")


def parse(spec: Mapping) -> Config:
    out = Config()
    try:
        for r in spec.get("rules") or ():
            out.rules.append(Rule(r["table"], r["column"], r["transform"]))
        for v in spec.get("virtual_foreign_keys") or ():
            maps = tuple((str(k), *table_column(t)) for k, t in sorted(v["mappings"].items()))
            out.virtual_keys.append(VirtualKey(v["child_table"], v["child_column"], v["parent_table_column"], maps))
        for a in spec.get("associations") or ():
            out.associations.append(Association(a["source"], a["target"], *restriction(a.get("restriction"))))
    except (KeyError, TypeError, AttributeError) as e:
        raise ConfigError(f"configuration: {e!r}") from e
    return out


def load(path: str | None = None) -> Config:
    """The configuration file; without a path the default file if there is one."""
    file = Path(path or DEFAULT_FILE)
    if not path and not file.exists():
        return Config()
    try:
        spec = yaml.safe_load(file.read_text()) or {}
    except (OSError, yaml.YAMLError) as e:
        raise ConfigError(f"configuration: {e}") from e
    if not isinstance(spec, Mapping):
        raise ConfigError("configuration must be a mapping")
    return parse(spec)


def combine(first: str, second: str) -> str:
    return f"({first}) AND ({second})" if first and second else first or second
