"""Command line: ``python -m slicer.cli --source DIR --constraints FILE --from "users WHERE ... LIMIT 5"``."""

from __future__ import annotations

import argparse
import re
import sys
import time
from collections.abc import Sequence

import yaml
from pyspark.sql import SparkSession

from slicer import report
from slicer.control import Limiter, Poller, Sample, Thresholds, gate
from slicer.errors import ConfigError, HealthError, IntegrityError, SlicerError, SourceError, TargetError
from slicer.functions.identifiers import POSTGRES, SQLITE
from slicer.functions.mask import DEFAULT_SALT, Masker, key_warnings
from slicer.operators.manifest import row_counts
from slicer.operators.sample import DEFAULT_SEED
from slicer.operators.traverse import SINGLE_PASS, STRICT, Options, extract
from slicer.operators.verify import verify
from slicer.plans import config as configs
from slicer.plans import graph as graphs
from slicer.plans.anchor import parse_anchors
from slicer.plans.model import SchemaModel, from_constraints
from slicer.sinks.databases import write_jdbc, write_sqlite
from slicer.sinks.files import write_parquet, write_sql, write_sql_folder
from slicer.sources import introspect
from slicer.sources.dsn import detect_engine, jdbc_options, sqlite_path
from slicer.sources.probes import probe as source_probe
from slicer.sources.tables import JdbcSource, ParquetSource, TableSource, frames

UNITS = {"ms": 0.001, "s": 1.0, "m": 60.0, "h": 3600.0}


def duration(text: str) -> float:
    parts = re.findall(r"([0-9.]+)(ms|s|m|h)", text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise argparse.ArgumentTypeError(f"not a duration: {text}")
    return sum(float(a) * UNITS[b] for a, b in parts)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="slicer", description="Cut a referentially intact, masked slice out of relational data.")
    p.add_argument("--source", required=True, help="folder of Parquet tables, or a database connection")
    p.add_argument("--from", dest="anchors", action="append", required=True, metavar="ANCHOR", help='e.g. "users WHERE id IN (1,2) LIMIT 50"; repeatable')
    p.add_argument("--constraints", help="YAML file of keys; needed for Parquet sources, else the database's catalog is read")
    p.add_argument("--output", default="-", help="SQL file (default: standard output)")
    p.add_argument("--output-folder", default="", help="folder that the executors fill with SQL text instead of one file, for large slices")
    p.add_argument("--schema", default="public", help="schema of the tables")
    p.add_argument("--engine", default=POSTGRES, choices=[POSTGRES, "mysql", SQLITE], help="dialect of the SQL file")
    p.add_argument("--anonymize-pii", action="store_true", help="mask private columns")
    p.add_argument("--salt", default=DEFAULT_SALT)
    p.add_argument("--max-rows-per-table", type=int, default=0, help="most child rows of a table (0: all)")
    p.add_argument("--depth", type=int, default=0, help="most steps down (0: all); parents are always complete")
    p.add_argument("--target", default="", help="database, SQLite file or Parquet folder to fill instead of a SQL file")
    p.add_argument("--config", default=None, help=f"masking rules and associations (default: {configs.DEFAULT_FILE} if present)")
    p.add_argument("--verify", action="store_true", help="check the slice for orphans (needs --target)")
    p.add_argument("--rate-limit", type=int, default=0, help="rows a second (0: unlimited)")
    p.add_argument("--concurrency", type=int, default=4, help="most parallel workers")
    p.add_argument("--safe-mode", action="store_true", help="pause while the source is unhealthy")
    p.add_argument("--max-lag", type=duration, default=30.0, help="most replica lag, e.g. 30s")
    p.add_argument("--children-per-parent", type=int, default=0, help="most children of each parent (0: all)")
    p.add_argument("--seed", default=DEFAULT_SEED, help="seed of the sampling")
    p.add_argument("--upstream", action="store_true", help="parents of the anchors only")
    p.add_argument("--bypass-rls", action="store_true", help="read past row policies")
    p.add_argument("--single-pass", action="store_true", help="visit each table once, parents of the anchors first")
    return p


def run(spark: SparkSession, args: argparse.Namespace, probe=None, out=None) -> dict[str, int]:
    began = time.time()
    if args.verify and not args.target:
        raise ConfigError("--verify needs --target")
    anchors, config = parse_anchors(args.anchors), configs.load(args.config)
    spec = {}
    if args.constraints:
        try:
            with open(args.constraints) as f:
                spec = yaml.safe_load(f) or {}
        except OSError as e:
            raise ConfigError(f"constraint file: {e}") from e
    names = sorted(spec.get("tables") or {})
    database = "://" in args.source and args.source.partition("://")[0] in ("postgres", "postgresql", "mysql", "mariadb")
    if not names and not database:
        raise ConfigError("the constraint file lists no tables")
    try:
        source = JdbcSource(spark, args.source, args.schema, names, args.bypass_rls) if database else ParquetSource(spark, args.source, names)
        if database:
            source.share_snapshot()
    except SlicerError:
        raise
    except Exception as e:
        raise SourceError(f"{args.source}: {e}") from e
    try:
        return cut_slice(spark, args, source, spec, anchors, config, probe, out, began)
    finally:
        if database:
            source.close()


def read_source(source: TableSource, spec: dict) -> tuple[dict, SchemaModel]:
    """The tables and their model: from the constraint file where it lists tables, else from the database's own catalog."""
    try:
        if source.names():
            tables = frames(source)
            return tables, from_constraints(spec, tables)
        model = introspect.read_model(source.read, source.engine, source.schema)
        return {t: source.table(t) for t in introspect.logical_tables(model)}, model
    except SlicerError:
        raise
    except Exception as e:
        raise SourceError(str(e)) from e


def cut_slice(spark: SparkSession, args: argparse.Namespace, source: TableSource, spec: dict, anchors: list, config: configs.Config, probe=None, out=None, began: float = 0.0) -> dict[str, int]:
    tables, model = read_source(source, spec)
    for w in [*model.warnings, *model.topology_warnings(), *(key_warnings(model, config) if args.anonymize_pii else [])]:
        print(f"warning: {w}", file=sys.stderr)
    if probe is None:
        probe = source_probe(source.engine, source.rows) if isinstance(source, JdbcSource) else lambda: Sample("")  # files are always healthy
    poller = Poller(probe, Thresholds.of(args.max_lag)) if args.safe_mode else None
    if poller:
        poller.start()
        if not poller.wait(args.max_lag * 10):
            raise HealthError(f"the source stayed unhealthy: {poller.reason}")
    try:
        options = Options(SINGLE_PASS if args.single_pass else STRICT, args.depth, args.max_rows_per_table, args.children_per_parent, args.seed, args.upstream, gate(poller))
        cut = extract(tables, model, anchors, config, options)
        rows = cut.masked(Masker(args.salt) if args.anonymize_pii else None)
        checks = write(spark, args, cut, rows, out)
        counts = {r.table_name: r.rows for r in row_counts(cut).collect()}
        print(report.summary(counts, time.time() - began, target=args.target, anchors=len(anchors), children_per_parent=args.children_per_parent, cycles=graphs.has_cycles(cut.graph), checks=checks), file=sys.stderr)
        cut.release()
        if checks is not None and any(c["status"] != "Valid" for c in checks):
            raise IntegrityError("the slice has orphans")
        return counts
    finally:
        if poller:
            poller.stop()


def write(spark: SparkSession, args: argparse.Namespace, cut, rows, out=None) -> list | None:
    limiter = Limiter(args.rate_limit, args.concurrency)
    if not args.target:
        if args.output_folder:
            write_sql_folder(rows, cut.model, cut.graph, args.output_folder, args.engine, args.schema)
        elif out is not None or args.output == "-":
            write_sql(out or sys.stdout, rows, cut.model, cut.graph, args.engine, args.schema, limiter=limiter)
        else:
            with open(args.output, "w") as f:
                write_sql(f, rows, cut.model, cut.graph, args.engine, args.schema, limiter=limiter)
        return None
    try:
        engine = detect_engine(args.target)
    except SourceError:
        engine = "parquet"
    if engine == SQLITE:
        write_sqlite(sqlite_path(args.target), rows, cut.model, limiter)
    elif engine == "parquet":
        write_parquet(rows, args.target, limiter=limiter)
    else:
        o = jdbc_options(args.target)
        try:
            write_jdbc(o.pop("url"), rows, cut.model, cut.graph, engine, args.schema, o, limiter)
        except Exception as e:
            raise TargetError(str(e)) from e
    if not args.verify:
        return None
    if engine == "parquet":  # what was written, not what was meant to be; masked keys are equal where raw ones are
        return verify({t: spark.read.parquet(f"{args.target}/{t}") for t in rows}, cut.model).collect()
    if engine != SQLITE:
        target = JdbcSource(spark, args.target, args.schema, list(rows))
        return verify(frames(target), cut.model).collect()
    return verify(cut.tables, cut.model).collect()  # write_sqlite has run the file's own check of its keys


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("slicer").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, args)
        return 0
    except SlicerError as e:
        print(f"error: {e}", file=sys.stderr)
        return e.exit_code


if __name__ == "__main__":
    sys.exit(main())
