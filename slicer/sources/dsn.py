"""Connection strings: which engine, and what JDBC needs."""

from __future__ import annotations

from urllib.parse import parse_qsl, urlencode, urlsplit

from slicer.errors import SourceError
from slicer.functions.identifiers import MYSQL, POSTGRES, SQLITE

SCHEMES = {"postgres": POSTGRES, "postgresql": POSTGRES, "mysql": MYSQL, "mariadb": MYSQL, "sqlite": SQLITE, "sqlite3": SQLITE, "file": SQLITE}
FILES = (".db", ".sqlite", ".sqlite3")
SETTINGS = {"parseTime": "true", "multiStatements": "true"}


def detect_engine(text: str) -> str:
    s = text.strip()
    scheme = s.partition(":")[0].lower()
    if "://" in s and scheme in SCHEMES or s.startswith("file:"):
        return SCHEMES[scheme]
    if s.lower().endswith(FILES):
        return SQLITE
    if "@tcp(" in s or "@unix(" in s:
        return MYSQL
    raise SourceError(f"unsupported database engine or scheme: {text!r}")


def mysql_dsn(text: str) -> tuple[str, str]:
    """(driver connection string, database) of a URL or of a native string."""
    s = text.strip()
    if not s.startswith(("mysql://", "mariadb://")):
        return s, s.rpartition("/")[2].partition("?")[0] if "/" in s else ""
    u = urlsplit(s)
    at = u.netloc.rpartition("@")[2] or "127.0.0.1"
    host = at if ":" in at else f"{at}:3306"
    user = "" if u.username is None else f"{u.username}@" if not u.password else f"{u.username}:{u.password}@"
    options = dict(sorted((SETTINGS | dict(parse_qsl(u.query, keep_blank_values=True))).items()))
    name = u.path.removeprefix("/")
    return f"{user}tcp({host})/{name}?{urlencode(options)}", name


def sqlite_path(text: str) -> str:
    s = text.strip()
    for prefix in ("sqlite://", "file:"):
        if s.startswith(prefix):
            s = s[len(prefix) :]
            if prefix == "sqlite://" and s[:1] == "/" and s[2:3] == ":":
                s = s[1:]
    return s.partition("?")[0]


def jdbc_options(text: str) -> dict[str, str]:
    """The url, user and password options of Spark's JDBC source."""
    engine = detect_engine(text)
    if engine == SQLITE:
        raise SourceError("SQLite is a target only")
    if engine == MYSQL and "://" not in text:
        user, _, rest = text.partition("@tcp(")
        host, _, tail = rest.partition(")/")
        name, _, secret = user.partition(":")
        return {"url": f"jdbc:mysql://{host}/{tail.partition('?')[0]}", "user": name, "password": secret}
    u = urlsplit(text)
    port = f":{u.port}" if u.port else ":3306" if engine == MYSQL else ""
    out = {"url": f"jdbc:{'mysql' if engine == MYSQL else 'postgresql'}://{u.hostname or '127.0.0.1'}{port}{u.path}"}
    return out | ({"user": u.username} if u.username else {}) | ({"password": u.password} if u.password else {})
