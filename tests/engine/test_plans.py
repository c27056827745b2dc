import pytest
import yaml

from slicer.errors import ConfigError
from slicer.plans import config as C
from slicer.plans import graph as G
from slicer.plans.anchor import Anchor, parse_anchor, parse_anchors
from slicer.plans.model import Column, Distribution, ForeignKey, Partition, Partitioned, SchemaModel, engine_warnings, from_constraints, group_keys


def schema(keys: dict, tables=(), **extra) -> SchemaModel:
    m = SchemaModel(**extra)
    names = {t for k in keys for t in (k[0], k[2])} | set(tables)
    for t in names:
        m.columns.setdefault(t, [Column("id", "integer", False, 1)])
        m.primary_keys.setdefault(t, ("id",))
    for (child, column, parent), nullable in keys.items():
        if column not in m.names(child):
            m.columns[child].append(Column(column, "integer", nullable, len(m.columns[child]) + 1))
        m.foreign_keys.append(ForeignKey(f"{child}_{column}", child, (column,), parent, ("id",)))
    return m


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("users LIMIT 20", Anchor("users", "", 20)),
        ("tenants WHERE tier = 'enterprise'", Anchor("tenants", "tier = 'enterprise'")),
        ("orders where status IN ('active', 'pending') limit 50", Anchor("orders", "status IN ('active', 'pending')", 50)),
        ("audit_logs", Anchor("audit_logs")),
        ("  users   ignored text ", Anchor("users")),
        ("t WHERE x = 'a LIMIT 3 b'", Anchor("t", "x = 'a LIMIT 3 b'")),
    ],
)
def test_anchors(text, want):
    assert parse_anchor(text) == want


def test_bad_anchors():
    for bad in ([], [" "]):
        with pytest.raises(ConfigError):
            parse_anchors(bad)


def test_globs():
    for pattern, value, want in [("*", "x", True), ("a", "a", True), ("a", "A", False), ("*_token", "api_token", True), ("pre_*", "pre_x", True), ("*mid*", "amidst", True), ("a*b*c", "aXbYc", True), ("a*b*c", "acb", False), ("ab*ba", "aba", False), ("?", "x", False), ("a*", "a\nb", True)]:
        assert C.glob_match(pattern, value) is want


def test_rule_priority_and_ties():
    c = C.Config(rules=[C.Rule("*", "email", "a"), C.Rule("users", "*", "b"), C.Rule("users", "email", "c"), C.Rule("us*", "email", "d")])
    assert c.find_rule("users", "email").transform == "c"
    assert c.find_rule("users", "phone").transform == "b"
    assert c.find_rule("others", "email").transform == "a"
    assert C.Config(rules=[C.Rule("us*", "email", "glob"), C.Rule("users", "*", "star")]).find_rule("users", "email").transform == "glob"


def test_yaml(tmp_path):
    f = tmp_path / "c.yaml"
    f.write_text(yaml.safe_dump({"rules": [{"table": "*", "column": "*_key", "transform": "redact"}], "virtual_foreign_keys": [{"child_table": "comments", "child_column": "commentable_id", "parent_table_column": "commentable_type", "mappings": {"post": "posts.id", "video": "videos.id"}}], "associations": [{"source": "a", "target": "b", "restriction": False}, {"source": "a", "target": "c", "restriction": "x = 1"}, {"source": "a", "target": "d", "restriction": True}]}))
    c = C.load(str(f))
    assert c.virtual_keys[0].mappings == (("post", "posts", "id"), ("video", "videos", "id"))
    assert c.edge("a", "b") == (True, "") and c.edge("b", "a") == (True, "") and c.edge("a", "c") == (False, "x = 1") and c.edge("c", "a") == (False, "") and c.edge("a", "d") == (False, "")
    with pytest.raises(ConfigError):
        C.load(str(tmp_path / "missing.yaml"))
    for bad in ("x", "x.", ".y"):
        with pytest.raises(ConfigError):
            C.table_column(bad)
    with pytest.raises(ConfigError):
        C.restriction(3)
    assert C.combine("a", "") == "a" and C.combine("a", "b") == "(a) AND (b)" and C.combine("", "") == ""


def test_default_file_may_be_missing(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert C.load() == C.Config()


def components_of(keys):
    return [(c.tables, c.cyclic) for c in G.components(G.build(schema(keys)))]


def test_components():
    assert components_of({("a", "b_id", "b"): True, ("b", "c_id", "c"): True}) == [(("c",), False), (("b",), False), (("a",), False)]
    assert components_of({("a", "b_id", "b"): True, ("b", "a_id", "a"): True}) == [(("a", "b"), True)]
    assert components_of({("a", "a_id", "a"): True}) == [(("a",), True)]
    got = components_of({("a", "b_id", "b"): True, ("b", "c_id", "c"): True, ("c", "a_id", "a"): True, ("d", "e_id", "e"): True})
    assert (("a", "b", "c"), True) in got and (("d",), False) in got and got.index((("e",), False)) < got.index((("d",), False))
    g = G.build(schema({("a", "b_id", "b"): True, ("b", "c_id", "c"): True}))
    assert G.topological(g) == ["c", "b", "a"] and not G.has_cycles(g)


def test_upstream_closure():
    g = G.build(schema({("charges", "invoice_id", "invoices"): True, ("invoices", "customer_id", "customers"): True, ("invoice_lines", "invoice_id", "invoices"): True, ("subscriptions", "customer_id", "customers"): True}))
    assert G.upstream_closure(g, ["charges"]) == {"charges", "invoices", "customers"}
    assert G.upstream_closure(g, ["charges"], lambda e: e.parent != "customers") == {"charges", "invoices"}
    g = G.build(schema({("charges", "invoice_id", "invoices"): True, ("invoices", "account_id", "accounts"): True, ("accounts", "invoice_id", "invoices"): True}))
    assert G.upstream_closure(g, ["charges"]) == {"charges", "invoices", "accounts"}
    v = [C.VirtualKey("comments", "ref", "kind", (("post", "posts", "id"),))]
    assert G.upstream_closure(G.build(schema({}, ["comments", "posts"]), v), ["comments"]) == {"comments", "posts"}


def test_partitions_fold_and_shards_go():
    m = schema({("orders", "user_id", "users"): True, ("orders_1", "user_id", "users"): True, ("orders_2", "user_id", "users"): True}, ["users_102008", "users_102009", "users_archive", "logs", "logs_2024"])
    m.partitioned["orders"] = Partitioned("RANGE", "(day)", (Partition("orders_1", "FOR VALUES IN (1)"), Partition("orders_2", "DEFAULT")))
    m.shards = {"users_102008"}
    m.distribution = {"users": Distribution("distributed", "id", 1), "logs": Distribution("local")}
    g = G.build(m)
    assert g.nodes == ["logs", "logs_2024", "orders", "users", "users_archive"] and len(g.out_edges["orders"]) == 1
    assert m.is_distributed("users") and not m.is_reference("users")


def test_topology_warnings():
    m = schema({("orders", "user_id", "users"): True, ("events", "user_id", "users"): True})
    m.distribution = {"users": Distribution("distributed", "tenant_id", 1), "orders": Distribution("distributed", "tenant_id", 1), "events": Distribution("distributed", "user_id", 2)}
    w = m.topology_warnings()
    assert sum("do not lie together" in x for x in w) == 1 and sum("is dealt" in x or "are dealt" in x for x in w) == 3


def test_depths_and_cycles():
    g = G.build(schema({("b", "a_id", "a"): True, ("c", "b_id", "b"): True, ("d", "c_id", "c"): True}))
    assert G.depths(g, ["a"]) == {"a": 0, "b": 1, "c": 2, "d": 3}
    m = schema({("users", "team_id", "teams"): True, ("teams", "lead_id", "users"): True, ("teams", "org_id", "orgs"): True, ("users", "boss_id", "users"): False})
    assert G.cyclic_nullable(m, G.build(m)) == {"users": ["team_id"], "teams": ["lead_id"]}


def test_compound_keys_in_any_order_and_engines():
    rows = [("k", "memberships", "c3", "roles", "p3", 3), ("k", "memberships", "c1", "roles", "p1", 1), ("k", "memberships", "c2", "roles", "p2", 2)]
    assert group_keys(rows) == [ForeignKey("k", "memberships", ("c1", "c2", "c3"), "roles", ("p1", "p2", "p3"))]
    assert len(engine_warnings({"a": "InnoDB", "b": "MyISAM", "c": "memory"})) == 2


def test_constraint_errors():
    base = {"tables": {"a": {"columns": [{"name": "id"}], "primary_key": ["id"]}}}
    for more in ({"foreign_keys": [{"from": "a", "from_columns": "id", "to": "zzz", "to_columns": "id"}]}, {"foreign_keys": [{"from": "a", "from_columns": ["id"], "to": "a", "to_columns": ["id", "x"]}]}, {"foreign_keys": [{"from": "a", "from_columns": "nope", "to": "a", "to_columns": "id"}]}, {"tables": {"b": {}}}):
        with pytest.raises(ConfigError):
            from_constraints(base | more)
