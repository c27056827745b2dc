import pytest

from slicer.operators.manifest import key_text, keyset_sql, manifest, pages, paginate, row_counts, seek_page
from slicer.operators.traverse import SINGLE_PASS, Options, extract, reduced_edge
from slicer.operators.verify import format_report, verify, violations
from slicer.plans.config import Association, Config, VirtualKey
from slicer.plans.graph import Edge
from slicer.plans.model import Distribution, Partition, Partitioned, from_constraints


def fk(child, cols, parent, to="id", **more):
    return {"from": child, "from_columns": cols, "to": parent, "to_columns": to} | more


def world(spark, tables, keys, no_key=(), not_null=None):
    frames = {t: spark.createDataFrame(rows, s) for t, (s, rows) in tables.items()}
    spec = {"tables": {t: ({} if t in no_key else {"primary_key": ["id"]}) | {"not_null": (not_null or {}).get(t, [])} for t in tables}, "foreign_keys": keys}
    return frames, from_constraints(spec, frames)


def ids(cut, t, col="id"):
    return sorted(r[0] for r in cut.tables[t].select(col).collect()) if t in cut.tables else []


@pytest.fixture(scope="module")
def shop(spark):
    users = [(i, f"u{i}", f"u{i}@x.com") for i in range(1, 51)]
    orders = [(i, (i - 1) % 50 + 1, i * 15.5) for i in range(1, 201)]
    items = [(2 * i + k, i, p) for i in range(1, 201) for k, p in ((0, 24.99), (1, 49.99))]
    return world(spark, {"users": ("id int, name string, email string", users), "orders": ("id int, user_id int, total double", orders), "order_items": ("id int, order_id int, price double", items)}, [fk("orders", "user_id", "users"), fk("order_items", "order_id", "orders")])


@pytest.mark.parametrize("closure", ["strict", SINGLE_PASS])
def test_slice_sizes(shop, closure):
    frames, model = shop
    cut = extract(frames, model, ["users LIMIT 5"], options=Options(closure=closure))
    assert {r.table_name: r.rows for r in row_counts(cut).collect()} == {"users": 5, "orders": 20, "order_items": 40}
    cut = extract(frames, model, ["users WHERE id = 1", "users WHERE id = 2"], options=Options(closure=closure, children_per_parent=1))
    assert {r.table_name: r.rows for r in row_counts(cut).collect()} == {"users": 2, "orders": 2, "order_items": 2}
    assert violations(verify(cut.tables, model)).isEmpty()


def test_sampling_is_monotone_and_slices_are_idempotent(shop):
    frames, model = shop
    seen = set()
    for n in (1, 2, 3):
        now = set(ids(extract(frames, model, ["users LIMIT 4"], options=Options(children_per_parent=n)), "orders"))
        assert seen <= now
        seen = now
    cut = extract(frames, model, ["users LIMIT 4"])
    again = extract(cut.tables, model, ["users LIMIT 4"])
    assert all(sorted(map(tuple, cut.tables[t].collect())) == sorted(map(tuple, again.tables[t].collect())) for t in cut.tables)
    assert all(cut.tables[t].columns == frames[t].columns for t in cut.tables)


def test_depth_and_cap(spark):
    t = {x: (f"id int, {p}_id int", [(1, 1), (2, 1), (3, 2)]) for x, p in (("b", "a"), ("c", "b"), ("d", "c"))} | {"a": ("id int", [(1,), (2,)])}
    frames, model = world(spark, t, [fk(x, f"{p}_id", p) for x, p in (("b", "a"), ("c", "b"), ("d", "c"))])
    assert set(extract(frames, model, ["a WHERE id = 1"], options=Options(depth=1)).tables) == {"a", "b"}
    assert set(extract(frames, model, ["a WHERE id = 1"]).tables) == {"a", "b", "c", "d"}
    cut = extract(frames, model, ["a WHERE id = 1"], options=Options(rows_per_table=1))
    assert ids(cut, "a") == [1] and ids(cut, "b") == [1] and ids(cut, "c") == [1]


@pytest.fixture(scope="module")
def staff(spark):
    return world(spark, {"emp": ("id int, manager_id int", [(1, None), (2, 1), (3, 1), (4, 2), (5, None), (6, 5)]), "badge": ("id int, emp_id int", [(10, 4), (11, 6)])}, [fk("emp", "manager_id", "emp"), fk("badge", "emp_id", "emp")])


def test_self_reference(staff):
    frames, model = staff
    assert ids(extract(frames, model, ["emp WHERE id = 2"]), "emp") == [1, 2, 3, 4]
    assert ids(extract(frames, model, ["badge WHERE id = 10"]), "emp") == [1, 2, 4]  # ancestors only
    assert ids(extract(frames, model, ["emp WHERE id = 4"], options=Options(upstream=True)), "emp") == [1, 2, 4]
    assert ids(extract(frames, model, ["emp WHERE id = 4"], options=Options(closure=SINGLE_PASS, upstream=True)), "emp") == [1, 2, 3, 4]


def test_long_chains_copy_rows_few_times(spark, monkeypatch):
    """A chain both ways from its middle, a loop, a row that manages itself and null managers."""
    from slicer.operators import traverse

    n, stored = 20, []
    rows = [(i, i - 1 if i > 1 else None) for i in range(1, n + 1)] + [(31, 33), (32, 31), (33, 32), (40, 40), (41, 40), (50, None)]
    frames, model = world(spark, {"emp": ("id int, manager_id int", rows)}, [fk("emp", "manager_id", "emp")])
    real = traverse.checkpointed
    monkeypatch.setattr(traverse, "checkpointed", lambda df: (lambda out: (stored.append(out.count()), out)[1])(real(df)))
    assert ids(extract(frames, model, ["emp WHERE id = 10"]), "emp") == [*range(1, n + 1)]
    assert ids(extract(frames, model, ["emp WHERE id IN (32, 41)"]), "emp") == [31, 32, 33, 40, 41]
    assert ids(extract(frames, model, ["emp WHERE id IN (10, 20, 50)"]), "emp") == [*range(1, n + 1), 50]
    assert sum(stored) < 250  # 165; 353 where each round rewrites the whole set


def test_layers(spark):
    from slicer.operators.traverse import Layers

    some = Layers(spark.range(0, 1))
    for i in range(1, 13):
        some.add(spark.range(i, i + 1))
    assert [rank for rank, _ in some.pieces] == [3, 2, 0] and sorted(r.id for r in some.rows().collect()) == list(range(13))


def test_cycle_of_tables(spark):
    frames, model = world(spark, {"users": ("id int, team_id int", [(10, 1), (11, 1), (12, 2), (13, None)]), "teams": ("id int, lead_id int", [(1, 10), (2, 11), (3, 13)])}, [fk("users", "team_id", "teams"), fk("teams", "lead_id", "users")])
    cut = extract(frames, model, ["users WHERE id = 10"], options=Options(upstream=True))
    assert ids(cut, "users") == [10] and ids(cut, "teams") == [1]
    cut = extract(frames, model, ["users WHERE id = 11"])  # leads team 2, whose member is 12
    assert ids(cut, "users") == [10, 11, 12] and ids(cut, "teams") == [1, 2]
    assert violations(verify(cut.tables, model)).isEmpty()


def test_polymorphic(spark):
    rows = [(1, 1, "post"), (2, 1, "video"), (3, 2, "audio"), (4, 2, None), (5, None, "post")]
    frames, model = world(spark, {"comments": ("id int, ref int, kind string", rows), "posts": ("id int", [(1,), (2,)]), "videos": ("id int", [(1,), (2,)])}, [])
    config = Config(virtual_keys=[VirtualKey("comments", "ref", "kind", (("post", "posts", "id"), ("video", "videos", "id")))])
    for closure in ("strict", SINGLE_PASS):
        cut = extract(frames, model, ["comments"], config, Options(closure=closure))
        assert ids(cut, "posts") == [1] and ids(cut, "videos") == [1]
    assert ids(extract(frames, model, ["comments WHERE id = 2"], config), "posts") == []


def test_late_diamond_is_complete(spark):
    tables = {"charges": ("id int, invoice_id int, payment_id int", [(1, 1, 1)]), "invoices": ("id int, customer_id int", [(1, 1)]), "payments": ("id int, customer_id int", [(1, 2)]), "customers": ("id int, region_id int", [(1, 1), (2, 2), (3, 3)]), "regions": ("id int", [(1,), (2,), (3,)])}
    frames, model = world(spark, tables, [fk("charges", "invoice_id", "invoices"), fk("charges", "payment_id", "payments"), fk("invoices", "customer_id", "customers"), fk("payments", "customer_id", "customers"), fk("customers", "region_id", "regions")])
    cut = extract(frames, model, ["charges"])
    assert ids(cut, "customers") == [1, 2] and ids(cut, "regions") == [1, 2]


def test_restrictions_and_nulls(spark):
    tables = {"charges": ("id string, amount double, audit_id int, strict_id int, event_id int", [("a", 1.0, 1, 1, 1), ("b", 2.0, 2, 2, 2)]), "audit": ("id int", [(1,), (2,)]), "events": ("id int, kind string", [(1, "billing"), (2, "other")])}
    frames, model = world(spark, tables, [fk("charges", "audit_id", "audit"), fk("charges", "strict_id", "audit"), fk("charges", "event_id", "events")], not_null={"charges": ["strict_id"]})
    config = Config(associations=[Association("charges", "audit", skip=True), Association("charges", "events", condition="kind = 'billing'")])
    cut = extract(frames, model, ["charges"], config)
    assert "audit" not in cut.tables and ids(cut, "events") == [1]
    assert sorted(map(tuple, cut.tables["charges"].collect())) == [("a", 1.0, None, 1, 1), ("b", 2.0, None, 2, None)]


def test_null_keys_never_fall_back_and_tables_without_key(spark):
    tables = {"child": ("id int, parent_id int", [(1, None), (2, None)]), "parent": ("id int", [(1,), (2,)]), "log": ("a int, b string", [(1, "x"), (1, "x"), (1, None), (2, "y")])}
    frames, model = world(spark, tables, [fk("child", "parent_id", "parent"), fk("log", "a", "parent")], no_key=["log"])
    assert ids(extract(frames, model, ["child"]), "parent") == []
    cut = extract(frames, model, ["parent WHERE id = 1"])
    assert sorted(map(tuple, cut.tables["log"].collect()), key=str) == [(1, "x"), (1, "x"), (1, None)]  # equal rows stay


def test_two_keys_to_one_parent_sample_by_edge(spark):
    rows = [(i, 1, 2) for i in range(1, 6)] + [(i, 2, 1) for i in range(6, 11)]
    frames, model = world(spark, {"addr": ("id int", [(1,), (2,)]), "orders": ("id int, billing_id int, shipping_id int", rows)}, [fk("orders", "billing_id", "addr"), fk("orders", "shipping_id", "addr")])
    cut = extract(frames, model, ["addr WHERE id = 1"], options=Options(children_per_parent=2))
    got = ids(cut, "orders")
    assert len([i for i in got if i <= 5]) == 2 and len([i for i in got if i > 5]) == 2


def test_composite_keys_and_part_null(spark):
    frames = {"customers": spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "tenant int, id int"), "orders": spark.createDataFrame([(1, 1, 1), (2, 2, 1), (3, 1, None), (4, 2, 9)], "id int, tenant int, customer int")}
    model = from_constraints({"tables": {"customers": {"primary_key": ["tenant", "id"]}, "orders": {"primary_key": ["id"]}}, "foreign_keys": [fk("orders", ["tenant", "customer"], "customers", ["tenant", "id"])]}, frames)
    assert ids(extract(frames, model, ["customers WHERE tenant = 2 AND id = 1"]), "orders") == [2]
    got = verify(frames, model).collect()[0]
    assert (got.orphan_count, got.status, got.child_columns) == (1, "Corrupted/Orphan", "tenant,customer")


def test_tenants_do_not_leak(spark):
    frames = {"users": spark.createDataFrame([(42, 1), (43, 1)], "tenant int, id int"), "orders": spark.createDataFrame([(42, 10, 1), (43, 11, 1), (43, 12, 1)], "tenant int, id int, user_id int")}
    model = from_constraints({"tables": {"users": {"primary_key": ["tenant", "id"]}, "orders": {"primary_key": ["tenant", "id"]}}, "foreign_keys": [fk("orders", "user_id", "users")]}, frames)
    model.distribution = {t: Distribution("distributed", "tenant", 1) for t in frames}
    assert ids(extract(frames, model, ["users WHERE tenant = 42"]), "orders") == [10]
    e = Edge("orders", ("tenant", "user_id"), "users", ("tenant", "id"))
    assert reduced_edge(model, e).child_columns == ("user_id",)


def test_partitions_are_one_table(spark):
    frames = {"p_2025": spark.createDataFrame([(101, 1)], "id int, customer_id int"), "p_2026": spark.createDataFrame([(102, 1), (103, 2)], "id int, customer_id int"), "customers": spark.createDataFrame([(1, "Alice"), (2, "Bob")], "id int, name string"), "notes": spark.createDataFrame([(1, 1)], "id int, customer_id int")}
    keys = [fk(t, "customer_id", "customers") for t in ("p", "p_2025", "p_2026", "notes")]
    spec = {"tables": {"p": {"primary_key": ["id"], "columns": [{"name": "id", "type": "int"}, {"name": "customer_id", "type": "int"}]}} | {t: {"primary_key": ["id"]} for t in frames}, "foreign_keys": keys}
    model = from_constraints(spec, frames)
    model.partitioned["p"] = Partitioned("RANGE", "(day)", (Partition("p_2025", "x"), Partition("p_2026", "y")))
    cut = extract(frames, model, ["p WHERE id = 101"], options=Options(upstream=True))
    assert ids(cut, "p") == [101] and ids(cut, "customers") == [1] and "notes" not in cut.tables
    assert ids(extract(frames, model, ["customers WHERE id = 1"]), "p") == [101, 102]


def test_gate_is_called_between_steps(shop):
    frames, model = shop
    calls = []
    extract(frames, model, ["users LIMIT 1"], options=Options(gate=lambda: calls.append(1)))
    assert len(calls) >= 4


def test_policy_split(spark):
    frames = {"customers": spark.createDataFrame([(1,), (2,)], "id int"), "orders": spark.createDataFrame([(101, 1), (102, 1), (103, 2), (104, 9)], "id int, customer_id int")}
    model = from_constraints({"tables": {t: {"primary_key": ["id"]} for t in frames}, "foreign_keys": [fk("orders", "customer_id", "customers")]}, frames)
    r = verify(frames, model, policies={"customers": "id = 2"}).collect()[0]
    assert (r.status, r.orphan_count, r.policy_excluded_count, r.rls_active) == ("Corrupted/Orphan", 1, 2, True)
    r = verify(frames | {"orders": frames["orders"].where("id < 104")}, model, policies={"customers": "id = 2"}).collect()
    assert (r[0].status, r[0].policy_excluded_count) == ("Policy-Excluded", 2)
    assert "2 row(s) hidden by a row policy" in format_report(r) and "have their parents" in format_report([])
    assert verify(frames, model, drained=["customers"]).isEmpty()


def test_manifest_pages(spark):
    rows = spark.createDataFrame([(t, f"pk={i:03d}") for t in ("users", "orders") for i in range(10)] + [("audit_logs", f"pk={i:03d}") for i in range(5)] + [("users", "pk=003")], "table_name string, pk string")
    for n in (7, 5):
        seen, cursor, more = [], None, True
        while more:
            page, cursor, more = seek_page(rows, cursor, n)
            seen += [tuple(r) for r in page.collect()]
        assert seen == sorted({tuple(r) for r in rows.collect()}) and len(seen) == 25
    assert [len(p) for p in pages(rows, 7)] == [7, 7, 7, 4]
    got = []
    with pytest.raises(ValueError):
        paginate(rows, 10, lambda p: got.append(p) or (_ for _ in ()).throw(ValueError()))
    assert len(got) == 1
    rows.createOrReplaceTempView("m")
    assert spark.sql(keyset_sql("m", ["table_name", "pk"], 3, ["'orders'", "'pk=008'"])).collect()[0].pk == "pk=009"


def test_manifest_of_slice(staff):
    frames, model = staff
    got = {tuple(r) for r in manifest(extract(frames, model, ["badge WHERE id = 10"])).collect()}
    assert got == {("badge", "10", "owned", 0), ("emp", "4", "required", None), ("emp", "2", "required", None), ("emp", "1", "required", None)}
    assert frames["emp"].where("id = 1").select(key_text(["id", "manager_id"])).first()[0] == "1,<nil>"
