import io
import sqlite3

import pytest
import yaml

from slicer import cli, report
from slicer.errors import ConfigError, IntegrityError, SourceError
from slicer.functions.mask import Masker
from slicer.operators.traverse import extract
from slicer.operators.twophase import insert_statements, phase_one, phase_two, update_statements
from slicer.plans import graph as graphs
from slicer.plans.model import Distribution, Partition, Partitioned, from_constraints
from slicer.sinks import ddl, files
from slicer.sinks.databases import count_rows, phase_two_rows, write_sqlite
from slicer.sources import catalog
from slicer.sources.dsn import detect_engine, jdbc_options, mysql_dsn, sqlite_path
from slicer.sources.tables import CatalogSource, ParquetSource, frames
from tests.engine.test_traverse import fk, world


@pytest.fixture(scope="module")
def users(spark):
    return world(spark, {"users": ("id int, name string, manager_id int", [(1, "Alice", 2), (2, "Bob", None)])}, [fk("users", "manager_id", "users")])


def lines(df):
    return sorted(r.statement for r in df.collect())


def test_two_phase_text(users):
    frames_, model = users
    first = phase_one(frames_["users"], ["manager_id"])
    assert lines(insert_statements(first, "mysql", "", "users", model))[0] == "INSERT INTO `users` (`id`, `name`, `manager_id`) VALUES (1, 'Alice', NULL);"
    assert lines(update_statements(frames_["users"], "mysql", "", "users", model, "manager_id")) == ["UPDATE `users` SET `manager_id` = 2 WHERE `id` = 1;"]
    assert lines(insert_statements(frames_["users"], "postgres", "public", "users", model))[0] == "INSERT INTO \"public\".\"users\" (\"id\", \"name\", \"manager_id\") VALUES (1, 'Alice', 2) ON CONFLICT DO NOTHING;"
    assert [tuple(r) for r in phase_two(frames_["users"], ["id"], "manager_id").collect()] == [(1, 2)]


def test_composite_key_update(spark):
    f = {"nodes": spark.createDataFrame([(7, 1, 3)], "tenant_id int, node_id int, parent_node_id int")}
    model = from_constraints({"tables": {"nodes": {"primary_key": ["tenant_id", "node_id"]}}}, f)
    assert lines(update_statements(f["nodes"], "mysql", "", "nodes", model, "parent_node_id")) == ["UPDATE `nodes` SET `parent_node_id` = 3 WHERE `tenant_id` = 7 AND `node_id` = 1;"]


def test_dump_replays_into_sqlite(users):
    f, model = users
    cut = extract(f, model, ["users"])
    out = io.StringIO()
    files.write_sql(out, cut.masked(Masker()), model, cut.graph, "sqlite", "")
    db = sqlite3.connect(":memory:", isolation_level=None)
    db.execute("PRAGMA foreign_keys = ON")
    db.executescript(out.getvalue())
    rows = db.execute("SELECT id, name, manager_id FROM users ORDER BY id").fetchall()
    assert [(r[0], r[2]) for r in rows] == [(1, 2), (2, None)] and all(r[1].startswith("User_") for r in rows)
    pg = io.StringIO()
    files.write_sql(pg, cut.tables, model, cut.graph)
    assert "SET CONSTRAINTS ALL DEFERRED;" in pg.getvalue() and pg.getvalue().rstrip().endswith("COMMIT;")
    my = [r.statement for r in files.statements(cut.tables, model, cut.graph, "mysql", "").orderBy("phase", "position").collect()]
    assert my[-1].startswith("UPDATE") and sum(s.startswith("INSERT") for s in my) == 2
    assert [tuple(r) for r in phase_two_rows(cut.tables, model, cut.graph)[("users", "manager_id")].collect()] == [(1, 2)]


def test_sqlite_sink(spark, tmp_path):
    f, model = world(spark, {"teams": ("id int, title string, lead_id int", [(1, "Core's", 10)]), "users": ("id int, name string, team_id int, at timestamp", [(10, "Alice", 1, None), (11, "x", None, None)])}, [fk("users", "team_id", "teams"), fk("teams", "lead_id", "users")])
    cut = extract(f, model, ["users"])
    path = str(tmp_path / "x.db")
    assert write_sqlite(path, cut.tables, model) == {"teams": 1, "users": 2} == count_rows(cut.tables)
    db = sqlite3.connect(path)
    assert db.execute("SELECT title, lead_id FROM teams").fetchall() == [("Core's", 10)] and db.execute("PRAGMA foreign_key_check").fetchall() == []
    with pytest.raises(IntegrityError):
        write_sqlite(str(tmp_path / "y.db"), {"teams": f["teams"], "users": f["users"].where("id = 11")}, model)


def test_ddl():
    spec = {"tables": {"orders": {"primary_key": ["id", "day"], "columns": [{"name": "id", "type": "integer"}, {"name": "day", "type": "timestamp"}, {"name": "total", "type": "numeric(10,2)"}, {"name": "user_id", "type": "int"}]}, "users": {"primary_key": ["id"], "columns": [{"name": "id", "type": "serial"}, {"name": "email", "type": "varchar(20)", "nullable": False}]}, "tags": {"primary_key": ["code"], "columns": [{"name": "code", "type": "uuid"}]}}, "foreign_keys": [fk("orders", "user_id", "users")]}
    m = from_constraints(spec)
    m.partitioned["orders"] = Partitioned("RANGE", "(day)", (Partition("orders_2025", "FOR VALUES FROM ('2025-01-01') TO ('2026-01-01')"),))
    m.distribution = {"orders": Distribution("distributed", "id", 1), "users": Distribution("reference")}
    assert ddl.postgres_table(m, "orders") == 'CREATE TABLE IF NOT EXISTS "orders" (\n  "id" integer NOT NULL,\n  "day" timestamp NOT NULL,\n  "total" numeric(10,2),\n  "user_id" int,\n  PRIMARY KEY ("id", "day")\n) PARTITION BY RANGE (day);\nCREATE TABLE IF NOT EXISTS "orders_2025" PARTITION OF "orders" FOR VALUES FROM (\'2025-01-01\') TO (\'2026-01-01\');\nSELECT create_distributed_table(\'orders\', \'id\');'
    assert ddl.postgres_table(m, "users").endswith("SELECT create_reference_table('users');") and ddl.postgres_table(m, "zzz") == ""
    assert ddl.sqlite_table(m, "users") == 'CREATE TABLE IF NOT EXISTS "users" (\n  "id" INTEGER PRIMARY KEY AUTOINCREMENT,\n  "email" TEXT NOT NULL\n);'
    assert ddl.sqlite_table(m, "orders") == 'CREATE TABLE IF NOT EXISTS "orders" (\n  "id" INTEGER NOT NULL,\n  "day" TEXT NOT NULL,\n  "total" NUMERIC,\n  "user_id" INTEGER,\n  PRIMARY KEY ("id", "day"),\n  FOREIGN KEY ("user_id") REFERENCES "users" ("id")\n);'
    assert '"code" TEXT PRIMARY KEY' in ddl.sqlite_schema(m) and ddl.sqlite_schema(m).count("CREATE TABLE") == 3


def test_connection_strings():
    for text, want in [("postgres://h/d", "postgres"), ("postgresql://h/d", "postgres"), ("mysql://h/d", "mysql"), ("mariadb://h/d", "mysql"), ("sqlite:///tmp/x", "sqlite"), ("file:x.db?mode=ro", "sqlite"), ("a/B.SQLITE3", "sqlite"), ("u:p@tcp(h:3306)/d", "mysql")]:
        assert detect_engine(text) == want
    with pytest.raises(SourceError):
        detect_engine("oracle://h")
    assert mysql_dsn("mysql://u:p@h/d") == ("u:p@tcp(h:3306)/d?multiStatements=true&parseTime=true", "d")
    assert mysql_dsn("mariadb://u@h:99/d?parseTime=false")[0] == "u@tcp(h:99)/d?multiStatements=true&parseTime=false"
    assert mysql_dsn("u:p@tcp(h:1)/shop?x=1") == ("u:p@tcp(h:1)/shop?x=1", "shop")
    assert [sqlite_path(t) for t in ("sqlite:///tmp/a.db?x", "file:b.db?m=1", "c.db?z", "sqlite:///C:/d.db")] == ["/tmp/a.db", "b.db", "c.db", "C:/d.db"]
    assert jdbc_options("postgres://u:p@h:5/d") == {"url": "jdbc:postgresql://h:5/d", "user": "u", "password": "p"}
    assert jdbc_options("u:p@tcp(h:1)/d?x=1") == {"url": "jdbc:mysql://h:1/d", "user": "u", "password": "p"}


def test_catalog(spark):
    cols = spark.createDataFrame([("users", "id", "int", "NO", 1), ("users", "name", "text", "YES", 2), ("orders", "user_id", "int", "YES", 2), ("orders", "id", "int", "NO", 1), ("parts_1", "id", "int", "NO", 1)], "table_name string, column_name string, data_type string, is_nullable string, ordinal_position int")
    pks = spark.createDataFrame([("m", "b", 2), ("m", "a", 1), ("users", "id", 1)], "table_name string, column_name string, ordinal_position int")
    keys = spark.createDataFrame([("k", "orders", "user_id", "users", "id", 1)], "constraint_name string, table_name string, column_name string, referenced_table_name string, referenced_column_name string, ordinal_position int")
    m = catalog.load(cols, pks, keys, engines=spark.createDataFrame([("users", "MyISAM")], "table_name string, engine string"), partitions=spark.createDataFrame([("parts", "LIST", "(x)", "parts_1", "DEFAULT")], "root string, strategy string, key string, partition string, bound string"), distribution=spark.createDataFrame([("users", "distributed", "id", 1)], "table_name string, kind string, column string, colocation int"), shards=spark.createDataFrame([("users_1",)], "table_name string"))
    assert m.primary_keys["m"] == ("a", "b") and m.names("orders") == ["id", "user_id"] and not m.column("users", "id").nullable and m.names("parts") == ["id"] and len(m.warnings) == 1 and m.distribution["orders"].kind == "local"
    arrays = spark.createDataFrame([("k", "t", ["a", "b"], "p", ["x", "y"])], "name string, table string, columns array<string>, to_table string, to_columns array<string>")
    assert [tuple(r) for r in catalog.exploded_keys(arrays).orderBy("ordinal").collect()] == [("k", "t", "a", "p", "x", 1), ("k", "t", "b", "p", "y", 2)]


def test_command_line(spark, tmp_path, users, capsys):
    f, _ = users
    f["users"].write.parquet(f"{tmp_path}/src/users.parquet")
    keys = tmp_path / "keys.yaml"
    keys.write_text(yaml.safe_dump({"tables": {"users": {"primary_key": ["id"]}}, "foreign_keys": [fk("users", "manager_id", "users")]}))
    base = ["--source", f"{tmp_path}/src", "--constraints", str(keys), "--from", "users WHERE id = 1"]
    out = io.StringIO()
    counts = cli.run(spark, cli.parser().parse_args([*base, "--anonymize-pii", "--safe-mode"]), out=out)
    assert counts == {"users": 2} and "User_" in out.getvalue()
    for target in (f"{tmp_path}/t.db", f"{tmp_path}/out"):
        assert cli.run(spark, cli.parser().parse_args([*base, "--target", target, "--verify"])) == {"users": 2}
    assert "have their parents" in capsys.readouterr().err
    with pytest.raises(ConfigError):
        cli.run(spark, cli.parser().parse_args([*base, "--verify"]))
    assert cli.duration("1m30s") == 90 and cli.duration("100ms") == 0.1
    assert frames(ParquetSource(spark, f"{tmp_path}/src", ["users"]))["users"].count() == 2
    assert {e.exit_code for e in (ConfigError, SourceError, IntegrityError)} == {2, 3, 5}
    assert "2 children per parent" in report.summary({"a": 1}, 0.5, anchors=1, children_per_parent=2, cycles=True)
    spark.sql("CREATE DATABASE IF NOT EXISTS shop")
    f["users"].write.mode("overwrite").saveAsTable("shop.users")
    assert CatalogSource(spark, "shop").names() == ["users"] and CatalogSource(spark, "shop").table("users").count() == 2


def test_sql_folder(users, tmp_path, spark):
    f, model = users
    files.write_sql_folder(f, model, graphs.build(model), str(tmp_path / "d"), "mysql", "")
    assert spark.read.text(str(tmp_path / "d/1-0000-users")).count() == 2 and spark.read.text(str(tmp_path / "d/2-0000-users-manager_id")).count() == 1
    files.write_parquet(f, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p/users")).count() == 2


def test_jdbc_restores_cyclic_keys(spark):
    """Inserts come first with the cyclic keys null, then updates bring them back; nothing stays null."""
    from slicer.operators.traverse import Traversal
    from slicer.plans.model import from_constraints
    from slicer.sinks.databases import write_jdbc

    frames = {"emp": spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 5), (5, 4)], "id bigint, boss bigint")}
    model = from_constraints({"tables": {"emp": {"primary_key": ["id"]}}, "foreign_keys": [{"from": "emp", "from_columns": "boss", "to": "emp", "to_columns": "id"}]}, frames)
    graph = Traversal(frames, model).graph
    for engine in ("postgres", "mysql"):
        there, steps = {}, []

        def append(df, name):
            steps.append("insert")
            there.update({r.id: r.boss for r in df.collect()})
            assert set(there.values()) == {None}

        def execute(statements):
            steps.append("update")
            for text in statements:
                boss, key = (int("".join(c for c in x if c.isdigit())) for x in (text.split(" = ")[1], text.split(" = ")[2]))
                there[key] = boss

        write_jdbc("jdbc:none", frames, model, graph, engine, append=append, execute=execute)
        assert steps == ["insert", "update"] and there == {1: None, 2: 1, 3: 2, 4: 5, 5: 4}


def test_equal_rows_of_a_table_without_a_key_stay(spark):
    from slicer.operators.traverse import extract
    from slicer.plans.model import from_constraints

    frames = {"a": spark.createDataFrame([(1,), (2,)], "id bigint"), "b": spark.createDataFrame([(1, "x"), (1, "x"), (1, None), (1, None), (2, "y")], "a_id bigint, note string")}
    model = from_constraints({"tables": {"a": {"primary_key": ["id"]}, "b": {}}, "foreign_keys": [{"from": "b", "from_columns": "a_id", "to": "a", "to_columns": "id"}]}, frames)
    got = extract(frames, model, ["a WHERE id = 1"]).tables["b"].collect()
    assert sorted((r.a_id, r.note or "") for r in got) == [(1, ""), (1, ""), (1, "x"), (1, "x")]
