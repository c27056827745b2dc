"""The keys of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slicer.plans.model import SchemaModel, from_constraints

CONSTRAINTS = {
    "tables": {
        "region": {"primary_key": ["r_regionkey"]},
        "nation": {"primary_key": ["n_nationkey"]},
        "customer": {"primary_key": ["c_custkey"]},
        "supplier": {"primary_key": ["s_suppkey"]},
        "part": {"primary_key": ["p_partkey"]},
        "orders": {"primary_key": ["o_orderkey"]},
        "lineitem": {},  # full rows only are unique
        "events": {"primary_key": ["event_id"]},
    },
    "foreign_keys": [
        {"name": "nation_region", "from": "nation", "from_columns": "n_regionkey", "to": "region", "to_columns": "r_regionkey"},
        {"name": "customer_nation", "from": "customer", "from_columns": "c_nationkey", "to": "nation", "to_columns": "n_nationkey"},
        {"name": "supplier_nation", "from": "supplier", "from_columns": "s_nationkey", "to": "nation", "to_columns": "n_nationkey"},
        {"name": "orders_customer", "from": "orders", "from_columns": "o_custkey", "to": "customer", "to_columns": "c_custkey"},
        {"name": "lineitem_orders", "from": "lineitem", "from_columns": "l_orderkey", "to": "orders", "to_columns": "o_orderkey"},
        {"name": "lineitem_part", "from": "lineitem", "from_columns": "l_partkey", "to": "part", "to_columns": "p_partkey"},
        {"name": "lineitem_supplier", "from": "lineitem", "from_columns": "l_suppkey", "to": "supplier", "to_columns": "s_suppkey"},
        {"name": "events_customer", "from": "events", "from_columns": "user_id", "to": "customer", "to_columns": "c_custkey"},
    ],
}


def tables(spark: SparkSession, sf_dir: str, names=tuple(CONSTRAINTS["tables"])) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def model(frames: dict[str, DataFrame], **extra) -> SchemaModel:
    spec = {"tables": {n: dict(CONSTRAINTS["tables"][n]) for n in frames}, "foreign_keys": [k for k in CONSTRAINTS["foreign_keys"] if k["from"] in frames and k["to"] in frames]}
    for t, more in extra.items():
        spec["tables"][t] |= more
    return from_constraints(spec, frames)
