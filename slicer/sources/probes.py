"""Health probes of a source over short JDBC connections (need a driver; not run here)."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from slicer.control import Sample
from slicer.functions.identifiers import MYSQL, POSTGRES

Rows = Callable[[str], list[dict[str, object]]]

ACTIVITY = """SELECT count(*) FILTER (WHERE wait_event_type = 'Lock') AS lock_waiters, count(*) FILTER (WHERE wait_event_type = 'IO') AS io_waiters,
coalesce(max(extract(epoch FROM now() - xact_start)), 0) AS oldest_transaction FROM pg_stat_activity WHERE state <> 'idle' AND pid <> pg_backend_pid()"""
HISTORY = "SELECT count AS history_list FROM information_schema.innodb_metrics WHERE name = 'trx_rseg_history_len'"
#: Where the metrics cannot be read, the history list is a line of this report.
STATUS = "SHOW ENGINE INNODB STATUS"
#: The first that the server knows; the lag's column is named after its source or master.
REPLICA = ("SHOW REPLICA STATUS", "SHOW SLAVE STATUS")


def first_of(rows: Rows, statements: Sequence[str]) -> list[dict[str, object]]:
    """Rows of the first statement that runs; none where none does."""
    for s in statements:
        try:
            return rows(s)
        except Exception:  # unknown statement, or no right to run it
            continue
    return []


def history_list(rows: Rows) -> int:
    if found := first_of(rows, [HISTORY]):
        return int(found[0]["history_list"])
    report = " ".join(str(v) for r in first_of(rows, [STATUS]) for v in r.values())
    m = re.search(r"History list length\s+(\d+)", report)
    return int(m[1]) if m else 0


def replica_lag(rows: Rows) -> int | None:
    """Seconds that the server lies behind; None where it is no replica or does not say."""
    for r in first_of(rows, REPLICA):
        for name in ("seconds_behind_source", "seconds_behind_master"):
            if r.get(name) is not None:
                return int(r[name])
    return None


def probe(engine: str, rows: Rows) -> Callable[[], Sample]:
    """A function that samples the source; what MySQL does not tell counts as idle, a failure as a failed sample."""

    def postgres() -> Sample:
        r = rows(ACTIVITY)[0]
        return Sample(POSTGRES, lock_waiters=int(r["lock_waiters"]), io_waiters=int(r["io_waiters"]), oldest_transaction=float(r["oldest_transaction"]))

    def mysql() -> Sample:
        rows("SELECT 1 AS alive")  # an unreachable server is a failed sample, not an idle one
        return Sample(MYSQL, history_list=history_list(rows), replica_lag=replica_lag(rows))

    return mysql if engine == MYSQL else postgres
