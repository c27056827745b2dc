"""The engine's registered queries and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicer import tpch
from slicer.functions import mask
from slicer.functions.literals import literal
from slicer.operators import manifest as manifests
from slicer.operators import sample
from slicer.operators.members import members
from slicer.operators.traverse import SINGLE_PASS, Options, Traversal, checkpointed, extract
from slicer.operators.twophase import phase_one, phase_two
from slicer.operators.verify import verify, violations
from slicer.plans.anchor import Anchor, parse_anchor
from slicer.plans.config import Association, Config, Rule, VirtualKey
from slicer.plans.graph import cyclic_nullable
from slicer.plans.model import Distribution, from_constraints
from slicer.sinks import ddl, files
from slicer.sources.catalog import ordered_columns
from slicer.sources.tables import scan
from slicer.streaming import health

ANCHOR = "customer WHERE c_mktsegment = 'BUILDING' LIMIT 5"
SEED, SALT = "sampling-seed", "demo-salt"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# The five anchors, and what hangs on them, as SQL.
B5 = "(SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 5)"
ORDERS5 = f"(SELECT * FROM orders WHERE o_custkey IN {B5})"
LINES5 = f"(SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM {ORDERS5}))"


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def cut(spark: SparkSession, sf_dir: str, anchors=(ANCHOR,), config: Config | None = None, **options):
    frames = tpch.tables(spark, sf_dir)
    return extract(frames, tpch.model(frames), list(anchors), config, Options(**options))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- scans and anchors -------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def scan_projection(spark, sf_dir):
    return scan(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus"])


@query("SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 5")
def anchor_where_limit(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    return scan(df, df.columns, parse_anchor(ANCHOR), ["c_custkey"])


@query(f"SELECT c_custkey, c_name FROM customer WHERE c_custkey IN {B5} UNION SELECT c_custkey, c_name FROM customer WHERE c_custkey <= 10")
def multi_anchor_union_dedup(spark, sf_dir):
    t = cut(spark, sf_dir, (ANCHOR, "customer where c_custkey <= 10"), upstream=True)
    return t.tables["customer"].select("c_custkey", "c_name")


@query(f"SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN {B5} AND o_orderstatus <> 'F'")
def key_membership(spark, sf_dir):
    keys = scan(table(spark, sf_dir, "customer"), ["c_custkey"], parse_anchor(ANCHOR), ["c_custkey"])
    return members(table(spark, sf_dir, "orders"), keys, [("o_custkey", "c_custkey")]).where("o_orderstatus <> 'F'").select("o_orderkey", "o_custkey")


@query(f"SELECT o_orderkey FROM orders WHERE o_custkey IN {B5}")
def key_membership_text(spark, sf_dir):
    """Keys that come as text, one of them unparsable."""
    keys = scan(table(spark, sf_dir, "customer"), ["c_custkey"], parse_anchor(ANCHOR), ["c_custkey"]).select(F.col("c_custkey").cast("string").alias("k"))
    keys = keys.union(spark.createDataFrame([("not a number",)], "k string"))
    return members(table(spark, sf_dir, "orders"), keys, [("o_custkey", "k")]).select("o_orderkey")


# --- traversal ---------------------------------------------------------------------


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'))")
def parents_of_slice(spark, sf_dir):
    return cut(spark, sf_dir, ("orders WHERE o_orderstatus = 'P'",), upstream=True).tables["nation"].select("n_nationkey", "n_name", "n_regionkey")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM {LINES5}")
def children_of_slice(spark, sf_dir):
    return cut(spark, sf_dir).tables["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _counted(c) -> DataFrame:
    return manifests.row_counts(c).where("rows > 0")


COUNT = "SELECT '{0}' AS table_name, count(*)::BIGINT AS rows FROM {1}"
_UP = {
    "customer": f"customer WHERE c_custkey IN {B5}",
    "orders": f"{ORDERS5}",
    "events": f"events WHERE user_id IN {B5}",
    "lineitem": f"{LINES5}",
    "part": f"part WHERE p_partkey IN (SELECT l_partkey FROM {LINES5})",
    "supplier": f"supplier WHERE s_suppkey IN (SELECT l_suppkey FROM {LINES5})",
}
_NATION1 = f"SELECT c_nationkey FROM customer WHERE c_custkey IN {B5}"
_NATIONS = f"{_NATION1} UNION SELECT s_nationkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM {LINES5})"


def _counts_sql(tables, nations: str) -> str:
    parts = [COUNT.format(t, _UP[t]) for t in tables]
    parts += [COUNT.format("nation", f"nation WHERE n_nationkey IN ({nations})"), COUNT.format("region", f"region WHERE r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey IN ({nations}))")]
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE rows > 0"


@query(_counts_sql(["customer", "orders", "events"], _NATION1))
def children_depth1(spark, sf_dir):
    return _counted(cut(spark, sf_dir, depth=1))


@query(_counts_sql(list(_UP), _NATIONS))
def children_depth2(spark, sf_dir):
    return _counted(cut(spark, sf_dir, depth=2))


@query(f"SELECT o_orderkey, o_custkey FROM {ORDERS5} ORDER BY o_orderkey LIMIT 7")
def rows_cap_per_table(spark, sf_dir):
    return cut(spark, sf_dir, rows_per_table=7).tables["orders"].select("o_orderkey", "o_custkey")


_KEYS = {"customer": ("c_custkey", "owned"), "orders": ("o_orderkey", "owned"), "events": ("event_id", "owned"), "part": ("p_partkey", "required"), "supplier": ("s_suppkey", "required")}
_MANIFEST = " UNION ALL ".join(
    [f"SELECT '{t}' AS table_name, {k}::VARCHAR AS pk, '{r}' AS role FROM {_UP[t]}" for t, (k, r) in _KEYS.items()]
    + [f"SELECT 'nation' AS table_name, n_nationkey::VARCHAR AS pk, 'required' AS role FROM nation WHERE n_nationkey IN ({_NATIONS})", f"SELECT 'region', r_regionkey::VARCHAR, 'required' FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey IN ({_NATIONS}))"]
)


@query(_MANIFEST)
def strict_closure_manifest(spark, sf_dir):
    return manifests.manifest(cut(spark, sf_dir)).where("table_name <> 'lineitem'").select("table_name", "pk", "role")


@query(_counts_sql(["customer", "orders", "events", "lineitem"], _NATION1))
def single_pass_counts(spark, sf_dir):
    return _counted(cut(spark, sf_dir, closure=SINGLE_PASS))


_LINE = "(SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice LIMIT 1)"
_CUST1 = f"(SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM {_LINE})))"
_NAT1 = f"(SELECT c_nationkey FROM customer WHERE c_custkey IN {_CUST1} UNION SELECT s_nationkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM {_LINE}))"


@query(
    f"SELECT 'orders' AS table_name, o_orderkey::VARCHAR AS pk FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM {_LINE}) UNION ALL SELECT 'part', p_partkey::VARCHAR FROM part WHERE p_partkey IN (SELECT l_partkey FROM {_LINE}) UNION ALL SELECT 'supplier', s_suppkey::VARCHAR FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM {_LINE}) "
    f"UNION ALL SELECT 'customer', c_custkey::VARCHAR FROM customer WHERE c_custkey IN {_CUST1} UNION ALL SELECT 'nation', n_nationkey::VARCHAR FROM nation WHERE n_nationkey IN {_NAT1} UNION ALL SELECT 'region', r_regionkey::VARCHAR FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey IN {_NAT1})"
)
def upstream_slice_manifest(spark, sf_dir):
    frames = tpch.tables(spark, sf_dir)
    first = frames["lineitem"].orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").limit(1)
    t = Traversal(frames | {"lineitem": first}, tpch.model(frames), options=Options(upstream=True)).run([Anchor("lineitem")])
    return manifests.manifest(t).where("table_name <> 'lineitem'").select("table_name", "pk")


@query(f"SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_custkey IN {B5} AND o_orderstatus = 'O'")
def restricted_edge(spark, sf_dir):
    config = Config(associations=[Association("customer", "orders", condition="o_orderstatus = 'O'")])
    return cut(spark, sf_dir, config=config).tables["orders"].select("o_orderkey", "o_custkey", "o_orderdate")


@query(f"SELECT l_orderkey, l_linenumber, NULL::BIGINT AS l_partkey, l_suppkey FROM {LINES5}")
def skipped_edge_null(spark, sf_dir):
    config = Config(associations=[Association("lineitem", "part", skip=True)])
    return cut(spark, sf_dir, config=config).tables["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT event_id, CASE WHEN user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN user_id END AS user_id FROM events")
def predicate_nulls_dangling(spark, sf_dir):
    """A predicate on parents nulls the keys that it leaves dangling."""
    config = Config(associations=[Association("events", "customer", condition="c_acctbal > 0")])
    t = cut(spark, sf_dir, ("events",), config, upstream=True)
    return t.tables["events"].select("event_id", "user_id")


_DISC = "SELECT event_id, user_id AS subject_id, CASE WHEN event_id % 3 = 0 THEN 'customer' WHEN event_id % 3 = 1 THEN 'supplier' WHEN event_id % 6 = 2 THEN 'other' END AS subject_type FROM events"


@query(f"SELECT 'customer' AS table_name, c_custkey AS pk FROM customer WHERE c_custkey IN (SELECT subject_id FROM ({_DISC}) WHERE subject_type = 'customer') UNION ALL SELECT 'supplier', s_suppkey FROM supplier WHERE s_suppkey IN (SELECT subject_id FROM ({_DISC}) WHERE subject_type = 'supplier')")
def polymorphic_parents(spark, sf_dir):
    frames = tpch.tables(spark, sf_dir, ("customer", "supplier"))
    frames["notes"] = table(spark, sf_dir, "events").selectExpr("event_id", "user_id AS subject_id", "CASE WHEN event_id % 3 = 0 THEN 'customer' WHEN event_id % 3 = 1 THEN 'supplier' WHEN event_id % 6 = 2 THEN 'other' END AS subject_type")
    model = from_constraints({"tables": {"customer": {"primary_key": ["c_custkey"]}, "supplier": {"primary_key": ["s_suppkey"]}, "notes": {"primary_key": ["event_id"]}}}, frames)
    config = Config(virtual_keys=[VirtualKey("notes", "subject_id", "subject_type", (("customer", "customer", "c_custkey"), ("supplier", "supplier", "s_suppkey")))])
    t = extract(frames, model, ["notes"], config, Options(upstream=True)).tables
    return t["customer"].select(F.lit("customer").alias("table_name"), F.col("c_custkey").alias("pk")).union(t["supplier"].select(F.lit("supplier"), "s_suppkey"))


@query("SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey IN (3, 7)")
def tenant_boundary(spark, sf_dir):
    """The nation as tenant of customers and suppliers: a supplier of another tenant is not pulled in."""
    frames = {n: table(spark, sf_dir, n) for n in ("customer", "supplier")}
    frames["trade"] = frames["customer"].select(F.col("c_custkey").alias("t_custkey"), F.col("c_nationkey").alias("t_nationkey"), F.explode(F.sequence(F.lit(0), F.lit(24))).alias("t_partner"))
    spec = {
        "tables": {"customer": {"primary_key": ["c_custkey"]}, "supplier": {"primary_key": ["s_suppkey"]}, "trade": {}},
        "foreign_keys": [{"from": "trade", "from_columns": "t_custkey", "to": "customer", "to_columns": "c_custkey"}, {"from": "trade", "from_columns": "t_partner", "to": "supplier", "to_columns": "s_nationkey"}],
    }
    model = from_constraints(spec, frames)
    model.distribution = {"customer": Distribution("distributed", "c_nationkey", 1), "supplier": Distribution("distributed", "s_nationkey", 1), "trade": Distribution("distributed", "t_nationkey", 1)}
    return extract(frames, model, ["customer WHERE c_nationkey IN (3, 7)"]).tables["supplier"].select("s_suppkey", "s_nationkey")


_TREE = "SELECT p_partkey AS id, CASE WHEN p_partkey % 100 = 0 THEN NULL ELSE (p_partkey // 100) * 100 + (p_partkey % 100) // 10 END AS parent FROM part"


def _tree(spark, sf_dir):
    return checkpointed(table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "CASE WHEN p_partkey % 100 = 0 THEN NULL ELSE (p_partkey div 100) * 100 + (p_partkey % 100) div 10 END AS parent"))


@query(f"WITH RECURSIVE t AS ({_TREE}), h AS (SELECT id, parent FROM t WHERE id = 159 UNION SELECT t.id, t.parent FROM t JOIN h ON t.parent = h.id OR t.id = h.parent) SELECT id, parent FROM h")
def self_ref_component(spark, sf_dir):
    frames = {"tree": _tree(spark, sf_dir)}
    model = from_constraints({"tables": {"tree": {"primary_key": ["id"]}}, "foreign_keys": [{"from": "tree", "from_columns": "parent", "to": "tree", "to_columns": "id"}]}, frames)
    return extract(frames, model, ["tree WHERE id = 159"]).tables["tree"]


@query(f"WITH RECURSIVE t AS ({_TREE}), h AS (SELECT id, parent FROM t WHERE id = 159 UNION SELECT t.id, t.parent FROM t JOIN h ON t.id = h.parent) SELECT id, parent FROM h")
def self_ref_ancestors(spark, sf_dir):
    """A table that is not an anchor closes over its ancestors only."""
    frames = {"tree": _tree(spark, sf_dir)}
    frames["leaf"] = frames["tree"].where("id = 159").selectExpr("id AS leaf_id")
    model = from_constraints({"tables": {"tree": {"primary_key": ["id"]}, "leaf": {"primary_key": ["leaf_id"]}}, "foreign_keys": [{"from": "tree", "from_columns": "parent", "to": "tree", "to_columns": "id"}, {"from": "leaf", "from_columns": "leaf_id", "to": "tree", "to_columns": "id"}]}, frames)
    return extract(frames, model, ["leaf"]).tables["tree"]


_PAIR = "SELECT c_custkey AS id, c_nationkey AS team, c_custkey % 7 AS kind FROM customer"


@query(f"SELECT id, team, kind FROM ({_PAIR}) WHERE (team, kind) IN (SELECT s_nationkey, s_suppkey % 7 FROM supplier)")
def composite_key_children(spark, sf_dir):
    """Children along a key of two columns."""
    frames = {"child": table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_nationkey AS team", "c_custkey % 7 AS kind"), "parent": table(spark, sf_dir, "supplier").selectExpr("s_nationkey AS team", "s_suppkey % 7 AS kind").distinct()}
    model = from_constraints({"tables": {"child": {"primary_key": ["id"]}, "parent": {"primary_key": ["team", "kind"]}}, "foreign_keys": [{"from": "child", "from_columns": ["team", "kind"], "to": "parent", "to_columns": ["team", "kind"]}]}, frames)
    return extract(frames, model, ["parent"]).tables["child"]


# --- sampling ----------------------------------------------------------------------

_RANKED = f"SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY md5(o_orderkey::VARCHAR || '{SEED}'), o_orderkey)::BIGINT AS rn, count(*) OVER (PARTITION BY o_custkey)::BIGINT AS total_children FROM orders"


@query(f"SELECT * FROM ({_RANKED}) WHERE rn = 1 OR (rn <= 3 AND total_children > 1)")
def sample_children_n3(spark, sf_dir):
    ranked = sample.ranked_children(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], ["o_orderkey"], SEED)
    return ranked.where("rn = 1 OR (rn <= 3 AND total_children > 1)")


@query(f"SELECT o_orderkey, o_custkey FROM ({_RANKED}) WHERE rn <= 1")
def sample_children_n1(spark, sf_dir):
    return sample.children_per_parent(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], ["o_orderkey"], 1, SEED)


@query(f"SELECT o_orderkey, o_custkey FROM ({_RANKED}) WHERE rn <= 3")
def sample_children_all(spark, sf_dir):
    return sample.children_per_parent(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], ["o_orderkey"], 3, SEED)


_ORD3 = f"SELECT o_orderkey FROM ({_RANKED}) WHERE rn <= 3 AND o_custkey IN {B5}"
_LCOLS = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


@query(f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY md5(l_orderkey::VARCHAR || '{SEED}'), {_LCOLS}) AS rn FROM lineitem WHERE l_orderkey IN ({_ORD3})) WHERE rn <= 3")
def sample_two_level(spark, sf_dir):
    return cut(spark, sf_dir, children_per_parent=3, seed=SEED).tables["lineitem"].select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query(f"SELECT o_custkey, count(*)::BIGINT AS kept, least(3, max(total_children))::BIGINT AS most FROM ({_RANKED}) WHERE rn <= 3 GROUP BY o_custkey")
def stratified_min_one(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    kept = sample.children_per_parent(orders, ["o_custkey"], ["o_orderkey"], 3, SEED).groupBy("o_custkey").agg(F.count("*").alias("kept"))
    return kept.join(orders.groupBy("o_custkey").agg(F.least(F.lit(3), F.count("*")).cast("bigint").alias("most")), "o_custkey")


# --- integrity ---------------------------------------------------------------------


def _broken(spark, sf_dir):
    frames = tpch.tables(spark, sf_dir)
    return frames | {"part": frames["part"].where("p_partkey % 3 <> 0")}


def _check_sql(where: str = "") -> str:
    parts = []
    for fk in tpch.CONSTRAINTS["foreign_keys"]:
        parent = fk["to"] if fk["to"] != "part" or not where else "(SELECT * FROM part WHERE p_partkey % 3 <> 0)"
        parts.append(f"SELECT '{fk['from']}' AS child_table, '{fk['from_columns']}' AS child_columns, '{fk['to']}' AS parent_table, count(*)::BIGINT AS orphan_count FROM {fk['from']} c LEFT JOIN {parent} p ON c.{fk['from_columns']} = p.{fk['to_columns']} WHERE c.{fk['from_columns']} IS NOT NULL AND p.{fk['to_columns']} IS NULL")
    return f"SELECT *, CASE WHEN orphan_count = 0 THEN 'Valid' ELSE 'Corrupted/Orphan' END AS status FROM ({' UNION ALL '.join(parts)}) {where}"


@query(_check_sql())
def orphans_none(spark, sf_dir):
    frames = tpch.tables(spark, sf_dir)
    return verify(frames, tpch.model(frames)).select("child_table", "child_columns", "parent_table", "orphan_count", "status")


@query(_check_sql("WHERE orphan_count >= 0"))
def orphans_injected(spark, sf_dir):
    frames = _broken(spark, sf_dir)
    return verify(frames, tpch.model(frames)).select("child_table", "child_columns", "parent_table", "orphan_count", "status")


@query(_check_sql("WHERE orphan_count > 0"))
def violations_report(spark, sf_dir):
    frames = _broken(spark, sf_dir)
    return violations(verify(frames, tpch.model(frames))).select("child_table", "child_columns", "parent_table", "orphan_count", "status")


@query("SELECT n - g AS policy_excluded_count, g AS orphan_count, CASE WHEN n = 0 THEN 'Valid' WHEN g = 0 THEN 'Policy-Excluded' ELSE 'Corrupted/Orphan' END AS status FROM (SELECT count(*)::BIGINT AS n, (count(*) FILTER (WHERE l_partkey % 3 = 0))::BIGINT AS g FROM lineitem WHERE l_partkey % 3 = 0 OR l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10))")
def policy_split(spark, sf_dir):
    frames = _broken(spark, sf_dir)
    frames = {k: frames[k] for k in ("part", "lineitem")}
    return verify(frames, tpch.model(frames), policies={"part": "p_size > 10"}).select("policy_excluded_count", "orphan_count", "status")


# --- masking -----------------------------------------------------------------------


def _hmac(value: str) -> str:
    inner, outer = mask.Masker(SALT).pads()
    return f"sha256(from_hex('{outer.hex()}') || from_hex(sha256(from_hex('{inner.hex()}') || encode({value}))))"


_PEOPLE = "SELECT c_custkey, c_name AS email, c_name || '1' AS phone, c_name || '2' AS first_name, c_name || '3' AS last_name, CASE WHEN c_custkey % 4 <> 0 THEN 'é ' || c_name END AS full_name, c_mktsegment FROM customer"


def _people(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_name AS email", "c_name || '1' AS phone", "c_name || '2' AS first_name", "c_name || '3' AS last_name", "CASE WHEN c_custkey % 4 <> 0 THEN 'é ' || c_name END AS full_name", "c_mktsegment")


@query(f"SELECT c_custkey, 'anon_' || substr({_hmac('email')}, 1, 10) || '@drain.local' AS email, '+1555' || substr({_hmac('phone')}, 1, 7) AS phone, 'User_' || substr({_hmac('first_name')}, 1, 6) AS first_name, 'Anon_' || substr({_hmac('last_name')}, 1, 6) AS last_name, 'User_' || substr({_hmac('full_name')}, 1, 6) AS full_name, c_mktsegment FROM ({_PEOPLE})")
def mask_email_name_phone(spark, sf_dir):
    return mask.mask_table(_people(spark, sf_dir), "people", masker=mask.Masker(SALT))


_U = _hmac("c_custkey::VARCHAR")


@query(
    f"SELECT 'tok_' || substr({_hmac('c_name')}, 1, 16) AS api_token, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS c_custkey, '[REDACTED]' AS c_mktsegment, '$2a$12$e8rG.e9y1dYv9fD1v1.X7fakehash' AS password_hash FROM (SELECT *, {_U} AS h FROM customer)"
)
def mask_token_uuid_redact(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select(F.col("c_name").alias("api_token"), "c_custkey", "c_mktsegment", F.col("c_name").alias("password_hash"))
    config = Config(rules=[Rule("people", "c_custkey", "uuid_remap"), Rule("people", "c_mkt*", "redact")])
    return mask.mask_table(df, "people", config, mask.Masker(SALT))


@query(f"SELECT s_suppkey, 'tok_' || substr({_hmac('s_name')}, 1, 16) AS s_name, '[REDACTED]' AS s_nationkey, s_acctbal FROM supplier")
def mask_rule_priority(spark, sf_dir):
    rules = [Rule("*", "*_name", "hmac_phone"), Rule("supp*", "s_name", "hmac_name"), Rule("supplier", "*_name", "hmac_token"), Rule("supplier", "*", "unknown"), Rule("s*er", "s_nationkey", "redact")]
    return mask.mask_table(table(spark, sf_dir, "supplier"), "supplier", Config(rules=[r for r in rules if r.transform != "unknown"]), mask.Masker(SALT))


@query(f"SELECT c_custkey, 'User_' || substr({_hmac('c_name')}, 1, 6) AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def mask_all_customers(spark, sf_dir):
    return mask.mask_table(table(spark, sf_dir, "customer"), "customer", masker=mask.Masker(SALT))


@query(f"SELECT o_orderkey, o_custkey, c_name FROM (SELECT o_orderkey, o_custkey FROM {ORDERS5}) JOIN (SELECT c_custkey, 'User_' || substr({_hmac('c_name')}, 1, 6) AS c_name FROM customer) ON o_custkey = c_custkey")
def masked_slice(spark, sf_dir):
    t = cut(spark, sf_dir).masked(mask.Masker(SALT))
    return t["orders"].join(t["customer"], t["orders"].o_custkey == t["customer"].c_custkey).select("o_orderkey", "o_custkey", "c_name")


# --- manifest ----------------------------------------------------------------------

_ALL = f"({_MANIFEST})"


@query(f"SELECT table_name, pk FROM {_ALL} WHERE (table_name, pk) > ('events', '5') ORDER BY table_name, pk LIMIT 40")
def manifest_keyset_page(spark, sf_dir):
    rows = manifests.manifest(cut(spark, sf_dir)).where("table_name <> 'lineitem'").select("table_name", "pk")
    return manifests.seek_page(rows, ("events", "5"), 40)[0]


# --- two phases, literals, DDL -----------------------------------------------------

_EMP = "SELECT p_partkey AS id, p_name AS title, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_partkey // 5 END AS manager_id FROM part"


def _staff(spark, sf_dir):
    frames = {"emp": table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_name AS title", "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_partkey div 5 END AS manager_id")}
    model = from_constraints({"tables": {"emp": {"primary_key": ["id"]}}, "foreign_keys": [{"from": "emp", "from_columns": "manager_id", "to": "emp", "to_columns": "id"}]}, frames)
    t = Traversal(frames, model)
    return frames, model, t.graph


@query(f"SELECT id, title, NULL::BIGINT AS manager_id FROM ({_EMP})")
def two_phase_insert(spark, sf_dir):
    frames, model, graph = _staff(spark, sf_dir)
    return phase_one(frames["emp"], cyclic_nullable(model, graph)["emp"])


@query(f"SELECT id, manager_id FROM ({_EMP}) WHERE manager_id IS NOT NULL")
def two_phase_update(spark, sf_dir):
    frames, model, graph = _staff(spark, sf_dir)
    return phase_two(frames["emp"], model.key("emp"), "manager_id")


@query(f"SELECT 'UPDATE `emp` SET `manager_id` = ' || manager_id || ' WHERE `id` = ' || id || ';' AS statement FROM ({_EMP}) WHERE manager_id IS NOT NULL UNION ALL SELECT 'INSERT INTO `emp` (`id`, `title`, `manager_id`) VALUES (' || id || ', ''' || title || ''', NULL);' FROM ({_EMP})")
def two_phase_statements(spark, sf_dir):
    frames, model, graph = _staff(spark, sf_dir)
    return files.statements(frames, model, graph, "mysql", "").select("statement")


@query(
    "SELECT k, i, CASE WHEN s IS NULL THEN 'NULL' ELSE '''' || replace(s, '''', '''''') || '''' END AS pg, CASE WHEN s IS NULL THEN 'NULL' ELSE '''' || replace(replace(replace(replace(s, '\\', '\\\\'), chr(10), '\\n'), '''', '\\'''), '\"', '\\\"') || '''' END AS my, CASE WHEN b THEN 'TRUE' ELSE 'FALSE' END AS b, '''' || strftime(t, '%Y-%m-%d %H:%M:%S') || '''' AS t "
    "FROM (SELECT o_orderkey AS k, o_custkey::VARCHAR AS i, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'it''s \"' || o_orderpriority || '\"\\' || chr(10) || 'é' END AS s, o_orderkey % 2 = 0 AS b, date_trunc('day', o_orderdate) AS t FROM orders)"
)
def sql_literals(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    text = F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit("it's \""), "o_orderpriority", F.lit('"\\\né')))
    df = df.select("o_orderkey", "o_custkey", text.alias("s"), (F.col("o_orderkey") % 2 == 0).alias("b"), F.date_trunc("day", "o_orderdate").alias("t"))
    of = lambda engine, c: literal(engine, F.col(c), df.schema[c].dataType)
    return df.select(F.col("o_orderkey").alias("k"), of("postgres", "o_custkey").alias("i"), of("postgres", "s").alias("pg"), of("mysql", "s").alias("my"), of("postgres", "b").alias("b"), of("mysql", "t").alias("t"))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey")
def fk_columns_agg(spark, sf_dir):
    got = ordered_columns(table(spark, sf_dir, "nation"), ["n_regionkey"], "n_name", "n_nationkey")
    return got.select("n_regionkey", F.array_join("columns", ",").alias("names"))


# --- health and rates --------------------------------------------------------------

_SAMPLES = "SELECT event_id, user_id % 5 AS cluster, event_id AS sampled, CASE WHEN user_id % 2 = 0 THEN 'mysql' ELSE 'postgres' END AS engine, CASE WHEN event_id % 11 = 0 THEN 'down' END AS error, (event_id * 7919) % 2000000 AS history_list, CASE WHEN event_id % 3 = 0 THEN event_id % 40 END AS replica_lag, event_id % 7 AS lock_waiters, event_id % 13 AS io_waiters, (event_id % 35)::DOUBLE AS oldest_transaction FROM events"


def _samples(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id", "user_id % 5 AS cluster", "event_id AS sampled", "CASE WHEN user_id % 2 = 0 THEN 'mysql' ELSE 'postgres' END AS engine", "CASE WHEN event_id % 11 = 0 THEN 'down' END AS error", "(event_id * 7919) % 2000000 AS history_list", "CASE WHEN event_id % 3 = 0 THEN event_id % 40 END AS replica_lag", "event_id % 7 AS lock_waiters", "event_id % 13 AS io_waiters", "double(event_id % 35) AS oldest_transaction")


_RAW = "CASE WHEN error IS NOT NULL THEN NULL WHEN engine = 'mysql' AND (history_list > 1000000 OR coalesce(replica_lag > 30, FALSE)) THEN 'Paused' WHEN engine = 'postgres' AND (lock_waiters >= 5 OR oldest_transaction > 30) THEN 'Paused' WHEN engine = 'mysql' AND history_list > 100000 THEN 'Backoff' WHEN engine = 'postgres' AND (io_waiters >= 10 OR oldest_transaction > 15) THEN 'Backoff' ELSE 'Normal' END"


@query(f"WITH r AS (SELECT *, {_RAW} AS raw FROM ({_SAMPLES})), b AS (SELECT *, last_value(raw IGNORE NULLS) OVER (PARTITION BY cluster ORDER BY sampled ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r), o AS (SELECT *, CASE WHEN raw = 'Normal' AND before = 'Paused' THEN 'Resumed' ELSE raw END AS own FROM b) SELECT event_id, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY cluster ORDER BY sampled ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'Normal') AS state FROM o")
def health_state_fold(spark, sf_dir):
    return health.states(_samples(spark, sf_dir), order="sampled").select("event_id", "state")


@query(f"SELECT cluster, (count(*) FILTER (WHERE lock_waiters > 0))::BIGINT AS with_lock_waiters, (count(*) FILTER (WHERE io_waiters > 0))::BIGINT AS with_io_waiters, coalesce(max(oldest_transaction), 0) AS oldest FROM ({_SAMPLES}) GROUP BY cluster")
def health_counts(spark, sf_dir):
    return health.sample_counts(_samples(spark, sf_dir))


@query("SELECT time_bucket(INTERVAL '1 second', ts) AS start, count(*)::BIGINT AS rows FROM events GROUP BY 1")
def rows_per_second(spark, sf_dir):
    return health.rows_per_second(table(spark, sf_dir, "events"))


# --- sinks, rows only --------------------------------------------------------------


@query()
def sql_dump_statements(spark, sf_dir):
    c = cut(spark, sf_dir, children_per_parent=2, seed=SEED)
    return files.statements(c.masked(mask.Masker(SALT)), c.model, c.graph)


@query()
def schema_ddl(spark, sf_dir):
    frames = tpch.tables(spark, sf_dir)
    model = tpch.model(frames)
    return spark.createDataFrame([(e, t, f(model, t)) for e, f in (("postgres", ddl.postgres_table), ("sqlite", ddl.sqlite_table)) for t in model.tables()], "engine string, table_name string, ddl string")

