"""What is sent to a database, replayed without one."""

import time

import pytest

from slicer.control import Health, Limiter, Poller, Sample, Thresholds
from slicer.errors import SourceError
from slicer.sinks.files import write_parquet
from slicer.sources import introspect, probes
from slicer.sources.tables import MYSQL_SNAPSHOT, JdbcSource

COLUMNS = "table_name string, column_name string, data_type string, is_nullable string, ordinal_position int"


def reader(spark, answers):
    """A ``read`` that answers by what a query mentions first in ``answers``; an exception is raised."""

    def read(query):
        found = next(v for k, v in answers.items() if k in query)
        if isinstance(found, Exception):
            raise found
        return spark.createDataFrame(*found)

    return read


def postgres_answers(**more):
    rows = [("users", "id", "bigint", "NO", 1), ("users", "name", "text", "YES", 2), ("orders", "b", "bigint", "NO", 2), ("orders", "a", "bigint", "NO", 1), ("orders", "user_id", "bigint", "YES", 3), ("orders_2026", "a", "bigint", "NO", 1), ("orders_102008", "a", "bigint", "NO", 1), ("lines", "x", "bigint", "YES", 1), ("lines", "y", "bigint", "YES", 2)]
    keys = [("pu", "p", "users", None, ["id"], None), ("po", "p", "orders", None, ["b", "a"], None), ("fu", "f", "orders", "users", ["user_id"], ["id"]), ("fl", "f", "lines", "orders", ["y", "x"], ["b", "a"])]
    return {
        "pg_constraint": (keys, 'name string, kind string, table string, to_table string, columns array<string>, to_columns array<string>'),
        "pg_partitioned_table": ([("orders", "r", "RANGE (a)", "orders_2026", "FOR VALUES FROM (1) TO (2)")], "root string, strategy string, key string, partition string, bound string"),
        "pg_extension": ([(False,)], "present boolean"),
        **more,
        "information_schema.columns": (rows, COLUMNS),
    }


def test_postgres_catalog(spark):
    seen = []
    read = reader(spark, postgres_answers())
    m = introspect.read_model(lambda q: seen.append(q) or read(q), "postgres", "it's")
    assert all("'it''s'" in q for q in seen if "pg_extension" not in q)
    assert m.primary_keys == {"users": ("id",), "orders": ("b", "a")} and m.names("orders") == ["a", "b", "user_id"]
    assert {(k.name, k.from_columns, k.to_columns) for k in m.foreign_keys} == {("fu", ("user_id",), ("id",)), ("fl", ("y", "x"), ("b", "a"))}
    assert m.partitioned["orders"].strategy == "RANGE" and m.root_of("orders_2026") == "orders"
    assert introspect.logical_tables(m) == ["lines", "orders", "orders_102008", "users"] and not m.distribution


@pytest.mark.parametrize("view", [True, False])
def test_cluster_catalog(spark, view):
    schema = "table_name string, kind string, column string, colocation int, method string"
    dealt = ([("orders", "distributed", "a", 1, "h"), ("users", "reference", "<none>", 2, "n")], schema) if view else RuntimeError("no such view")
    before = ([("orders", None, "a", 1, "r"), ("users", None, None, 2, "n")], schema)
    more = {"FROM citus_tables": dealt, "pg_dist_shard": ([("orders_102008",)], "table_name string"), "pg_dist_partition": before}
    answers = postgres_answers(**more) | {"pg_extension": ([(True,)], "present boolean")}
    m = introspect.read_model(reader(spark, answers), "postgres", "public")
    assert (m.distribution["orders"].kind, m.distribution["orders"].column, m.distribution["orders"].method) == ("distributed", "a", "hash" if view else "range")
    assert m.is_reference("users") and m.distribution["users"].column == "" and m.distribution["lines"].kind == "local"
    assert "orders_102008" not in m.columns and "orders_102008" in m.shards


def test_mysql_catalog(spark):
    keys = [("PRIMARY", "users", "id", None, None, None, 1, "shop"), ("f", "orders", "user_id", "shop", "users", "id", 1, "shop"), ("g", "orders", "far_id", "other", "far", "id", 1, "shop")]
    answers = {
        "key_column_usage": (keys, "constraint_name string, table_name string, column_name string, to_schema string, referenced_table_name string, referenced_column_name string, ordinal_position int, own_schema string"),
        "engine AS engine": ([("users", "MyISAM"), ("orders", "InnoDB")], "table_name string, engine string"),
        "information_schema.columns": ([("users", "id", "int", "NO", 1), ("orders", "user_id", "int", "YES", 1), ("orders", "far_id", "int", "YES", 2)], COLUMNS),
    }
    m = introspect.read_model(reader(spark, answers), "mysql", "")
    assert m.primary_keys == {"users": ("id",)} and [k.name for k in m.foreign_keys] == ["f"] and len(m.warnings) == 1 and introspect.logical_tables(m) == ["orders", "users"]


class FakeConnection:
    """A JDBC connection that exports one snapshot."""

    def __init__(self, log):
        self.log, self.left = log, 1

    def __getattr__(self, name):
        if name in ("createStatement", "executeQuery", "getMetaData"):
            return lambda *a: self.log.extend(a) or self
        return {"getColumnCount": lambda: 1, "getColumnLabel": lambda k: "ID", "getString": lambda k: "0003-1"}.get(name, lambda *a: self.log.append((name, *a)))

    def next(self):
        self.left -= 1
        return self.left >= 0


def test_snapshots(spark):
    log = []
    s = JdbcSource(spark, "postgres://u:p@h/db", "public", ["t"], bypass_policies=True, numPartitions="8", partitionColumn="id")
    with pytest.raises(SourceError):
        s.settings()
    s.share_snapshot(lambda: FakeConnection(log))
    first = s.settings()["sessionInitStatement"].split("; ")
    assert first[:2] == ["SET TRANSACTION ISOLATION LEVEL REPEATABLE READ, READ ONLY", "SET TRANSACTION SNAPSHOT '0003-1'"] and first[-1] == "SET row_security = off"
    assert ("setAutoCommit", False) in log and "SELECT pg_export_snapshot() AS id" in log and ("rollback",) not in log
    assert s.settings()["fetchsize"] == "1000"  # a driver that fetches in portions reads within a transaction
    s.close()
    assert log[-2:] == [("rollback",), ("close",)] and s.snapshot is None
    m = JdbcSource(spark, "mysql://u:p@h/db", "", ["t"], bypass_policies=True)
    m.share_snapshot(lambda: 1 / 0)
    assert m.settings()["sessionInitStatement"] == MYSQL_SNAPSHOT
    with pytest.raises(SourceError):
        JdbcSource(spark, "mysql://u:p@h/db", "", ["t"], numPartitions="2").settings()


def test_probes_and_what_they_fall_back_on():
    def server(**answers):
        def rows(statement):
            for k, v in answers.items():
                if k.replace("_", " ") in statement:
                    return v
            raise RuntimeError(statement)

        return rows

    alive = {"SELECT_1": [{"alive": "1"}]}
    assert probes.probe("mysql", server(**alive, innodb_metrics=[]))() == Sample("mysql")
    old = server(**alive, SHOW_ENGINE=[{"status": "x\nHistory list length 1500000\ny"}], SHOW_SLAVE=[{"seconds_behind_master": "31"}])
    assert probes.probe("mysql", old)() == Sample("mysql", history_list=1_500_000, replica_lag=31)
    new = server(**alive, SHOW_ENGINE=[], SHOW_REPLICA=[{"seconds_behind_source": None}])
    assert probes.probe("mysql", new)() == Sample("mysql")
    sample = probes.probe("postgres", lambda s: [{"lock_waiters": "5", "io_waiters": "0", "oldest_transaction": "1.5"}])()
    assert sample == Sample("postgres", lock_waiters=5, oldest_transaction=1.5)
    assert Poller(probes.probe("mysql", server())).sample().error == "SELECT 1 AS alive"


def test_a_probe_that_hangs_is_a_failed_sample():
    p = Poller(lambda: time.sleep(0.3) or Sample("postgres", lock_waiters=9), Thresholds(probe_timeout=0.05))
    assert p.sample().error == "no answer in 0.05 s" and p.sample().error == "the last probe has not ended"
    assert p.poll() == Health.NORMAL
    p._probing.join()
    p.thresholds = Thresholds()
    assert p.poll() == Health.PAUSED


def test_workers_bound_the_tables_written_at_once(spark, tmp_path):
    most, now = [0], [0]

    class Counting(Limiter):
        def __enter__(self):
            super().__enter__()
            now[0] += 1
            most[0] = max(most[0], now[0])
            return self

        def __exit__(self, *error):
            now[0] -= 1
            super().__exit__(*error)

    write_parquet({f"t{i}": spark.range(i) for i in range(5)}, str(tmp_path / "w"), limiter=Counting(workers=2))
    assert 1 <= most[0] <= 2 and [spark.read.parquet(f"{tmp_path}/w/t{i}").count() for i in range(5)] == list(range(5))
