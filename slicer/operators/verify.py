"""Orphan checks of every foreign key, with rows that a policy hides told apart."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicer.operators.members import others, union_all
from slicer.plans.model import ForeignKey, SchemaModel

VALID, POLICY, CORRUPTED = "Valid", "Policy-Excluded", "Corrupted/Orphan"
SCHEMA = "child_table string, child_columns string, parent_table string, parent_columns string, status string, orphan_count bigint, policy_excluded_count bigint, rls_active boolean"


def orphans(child: DataFrame, parent: DataFrame, fk: ForeignKey) -> DataFrame:
    """Rows whose key has no null and no parent."""
    return others(child.dropna(subset=list(fk.from_columns)), parent, list(zip(fk.from_columns, fk.to_columns, strict=True)))


def verify(tables: Mapping[str, DataFrame], model: SchemaModel, *, policies: Mapping[str, str] | None = None, drained: Iterable[str] | None = None) -> DataFrame:
    """One row for each foreign key of the drained tables, composite ones included.

    ``policies`` gives the predicate of rows that a policy leaves visible in a table. Orphans
    against the visible parents that the unfiltered table resolves are policy-excluded.
    Errors are raised, never skipped. All keys are counted in one plan.
    """
    policies, drained = policies or {}, set(tables if drained is None else drained)
    parts = []
    for fk in sorted(model.foreign_keys, key=lambda f: (f.from_table, f.from_columns, f.to_table)):
        if fk.from_table not in drained or model.is_partition(fk.from_table):
            continue
        child, whole = tables[fk.from_table], tables.get(fk.to_table)
        active = fk.to_table in policies
        if whole is None:
            whole = child.sparkSession.createDataFrame([], child.select(*[F.col(f"`{a}`").alias(b) for a, b in zip(fk.from_columns, fk.to_columns, strict=True)]).schema)
        visible = whole.where(F.expr(policies[fk.to_table])) if active else whole
        lost = orphans(child, visible, fk)
        counts = lost.agg(F.count("*").alias("n")).withColumn("i", F.lit(0))
        if active:
            truly = orphans(lost, whole, fk).agg(F.count("*").alias("g")).withColumn("i", F.lit(0))
            counts = counts.join(truly, "i")
        else:
            counts = counts.withColumn("g", F.col("n"))
        status = F.when(F.col("n") == 0, VALID).when(F.col("g") == 0, POLICY).otherwise(CORRUPTED)
        parts.append(counts.select(F.lit(fk.from_table).alias("child_table"), F.lit(",".join(fk.from_columns)).alias("child_columns"), F.lit(fk.to_table).alias("parent_table"), F.lit(",".join(fk.to_columns)).alias("parent_columns"), status.alias("status"), F.col("g").alias("orphan_count"), (F.col("n") - F.col("g")).alias("policy_excluded_count"), F.lit(active).alias("rls_active")))
    if not parts:
        return SparkSession.active().createDataFrame([], SCHEMA)
    return union_all(parts)


def violations(report: DataFrame) -> DataFrame:
    return report.where(F.col("status") != VALID)


def format_report(rows) -> str:
    """The violations as lines of text, or one line if there are none."""
    bad = [r for r in rows if r["status"] != VALID]
    if not bad:
        return "All foreign keys of the slice have their parents."
    lines = [f"{len(bad)} foreign key(s) with missing parents"]
    for r in bad:
        n, why = (r["policy_excluded_count"], "hidden by a row policy") if r["status"] == POLICY else (r["orphan_count"], "without a parent")
        lines.append(f"  {r['child_table']}({r['child_columns']}) -> {r['parent_table']}({r['parent_columns']}): {n} row(s) {why}")
    return "\n".join(lines) + "\n"
