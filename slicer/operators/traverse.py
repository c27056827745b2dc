"""Row traversal over foreign keys as semi-joins on raw keys.

Each table has two disjoint sets of slim rows (key and edge columns only): ``owned``
(anchors and what was reached downward) and ``required`` (parents pulled for
integrity; never expanded downward). A schema without cycles is one pass down in
topological order and one pass up, composed lazily: no job runs before a sink asks.
Only tables inside a cycle loop to a fixpoint, with a checkpoint a round. Full rows
are joined once at the end, so traversal reads key columns alone.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicer.errors import ConfigError
from slicer.functions.mask import Masker, mask_table
from slicer.operators.members import members, others, union_all
from slicer.operators.sample import DEFAULT_SEED, children_per_parent
from slicer.plans import graph as graphs
from slicer.plans.anchor import Anchor, parse_anchors
from slicer.plans.config import Config
from slicer.plans.graph import Edge, Graph
from slicer.plans.model import SchemaModel

STRICT, SINGLE_PASS = "strict", "single_pass"


@dataclass(frozen=True)
class Options:
    closure: str = STRICT
    depth: int = 0  # steps down; 0 is unlimited
    rows_per_table: int = 0  # of children; 0 is unlimited
    children_per_parent: int = 0
    seed: str = DEFAULT_SEED
    upstream: bool = False
    gate: Callable[[], None] | None = None  # called before each step, may block


@dataclass
class Slice:
    model: SchemaModel
    graph: Graph
    config: Config
    tables: dict[str, DataFrame]  # raw rows, parents first
    roles: dict[str, DataFrame]  # slim rows with role and depth
    dangling: dict[str, list[str]] = field(default_factory=dict)  # not-null keys that a predicate may leave dangling
    kept: list[DataFrame] = field(default_factory=list)

    def masked(self, masker: Masker | None) -> dict[str, DataFrame]:
        """The rows with masking as the last projection; None leaves them raw."""
        return dict(self.tables) if masker is None else {t: mask_table(df, t, self.config, masker) for t, df in self.tables.items()}

    def release(self) -> None:
        for df in self.kept:
            df.unpersist()


def checkpointed(df: DataFrame) -> DataFrame:
    """A durable copy in the folder that the cluster names; a temporary one serves only where driver and executors are one process."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not where and not sc.master.startswith("local"):
            raise ConfigError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="slicer-checkpoint-"))
    return df.checkpoint()


class Layers:
    """Rows that come round by round, in checkpoints of doubling rounds: a row is copied a logarithmic number of times, however many rounds there are, and a read sees as few pieces."""

    def __init__(self, first: DataFrame):
        self.pieces = [(0, first)]

    def add(self, df: DataFrame) -> None:
        rank = 0
        while self.pieces and self.pieces[-1][0] == rank:
            df = checkpointed(self.pieces.pop()[1].unionByName(df))
            rank += 1
        self.pieces.append((rank, df))

    def rows(self) -> DataFrame:
        return union_all([df for _, df in self.pieces])


def grown(known: dict[str, Layers], table: str, new: DataFrame) -> DataFrame:
    """All rows of a table after ``new`` ones, in ``known``."""
    if table in known:
        known[table].add(new)
    else:
        known[table] = Layers(new)
    return known[table].rows()


class Traversal:
    def __init__(self, frames: Mapping[str, DataFrame], model: SchemaModel, config: Config | None = None, options: Options | None = None):
        self.model, self.config, self.options = model, config or Config(), options or Options()
        self.graph = graphs.build(model, self.config.virtual_keys)
        self.frames = self._folded(frames)
        self.tenants: dict[int, DataFrame] = {}
        self.kept: list[DataFrame] = []

    # --- tables ---------------------------------------------------------------

    def _folded(self, frames: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        """Partitions become rows of their logical table; shards are left out."""
        parts: dict[str, list[DataFrame]] = {}
        for name in sorted(frames):
            if not self.model.is_shard(name):
                parts.setdefault(self.model.root_of(name), []).append(frames[name])
        return {t: union_all(p) for t, p in parts.items()}

    def slim(self, table: str, where: str = "") -> DataFrame:
        """The columns that traversal needs; all columns of a table without a key, whose rows are their own identity."""
        df = self.frames[table]
        if where:
            df = df.where(F.expr(where))
        if not self.model.has_key(table):
            return df
        need = [*self.model.key(table)]
        need += [c for e in self.graph.out_edges.get(table, ()) for c in e.child_columns]
        need += [c for e in self.graph.in_edges.get(table, ()) for c in e.parent_columns]
        for v in self.graph.virtual:
            if v.child_table == table:
                need += [v.child_column, v.discriminator]
            need += [c for _, t, c in v.mappings if t == table]
        if self.model.is_distributed(table):
            need.append(self.model.distribution[table].column)
        return df.select(*[F.col(f"`{c}`") for c in dict.fromkeys(need)])

    def identity(self, table: str) -> list[tuple[str, str]]:
        return [(c, c) for c in self.model.key(table)]

    def minus(self, table: str, df: DataFrame, known: DataFrame | None) -> DataFrame:
        return df if known is None else others(df, known, self.identity(table), null_safe=not self.model.has_key(table))

    def distinct(self, table: str, df: DataFrame) -> DataFrame:
        return df.dropDuplicates(self.model.key(table))

    def keep(self, df: DataFrame) -> DataFrame:
        """Used by several later steps: stored once, recomputed if an executor is lost."""
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        self.kept.append(df)
        return df

    # --- steps ----------------------------------------------------------------

    def bounded(self, table: str, df: DataFrame) -> DataFrame:
        """Rows within the tenants of the anchors' colocation group."""
        if not self.model.is_distributed(table):
            return df
        d = self.model.distribution[table]
        tenants = self.tenants.get(d.colocation)
        return df if tenants is None else members(df, tenants, [(d.column, "tenant")])

    def record_tenants(self, anchors: Mapping[str, DataFrame]) -> None:
        seen: dict[int, list[DataFrame]] = {}
        for t, df in anchors.items():
            if self.model.is_distributed(t) and self.model.distribution[t].colocation:
                d = self.model.distribution[t]
                seen.setdefault(d.colocation, []).append(df.select(F.col(f"`{d.column}`").alias("tenant")))
        for group, dfs in seen.items():
            self.tenants[group] = union_all(dfs).distinct()

    def children(self, e: Edge, parents: DataFrame) -> DataFrame | None:
        """Children along an edge of some parents, sampled for each parent."""
        skip, where = self.config.edge(e.parent, e.child)
        if skip or e.child not in self.frames:
            return None
        if self.options.closure == SINGLE_PASS:
            where = ""
        found = members(self.slim(e.child), parents, list(zip(e.child_columns, e.parent_columns, strict=True)))
        found = self.bounded(e.child, found)
        if self.options.children_per_parent:
            found = children_per_parent(found, e.child_columns, self.model.key(e.child), self.options.children_per_parent, self.options.seed)
        if where:  # after ranking, as a filter of the sampled rows
            found = self.matching(e.child, found, where)
        return found

    def matching(self, table: str, df: DataFrame, where: str) -> DataFrame:
        """Rows of ``df`` whose full row meets a predicate."""
        if not self.model.has_key(table):
            return df.where(F.expr(where))
        keys = self.frames[table].where(F.expr(where)).select(*[F.col(f"`{c}`") for c in self.model.key(table)])
        return members(df, keys, self.identity(table))

    def parents(self, e: Edge, children: DataFrame) -> DataFrame | None:
        """Parents along an edge of some children; null keys match nothing."""
        skip, where = self.config.edge(e.child, e.parent)
        if skip or e.parent not in self.frames:
            return None
        keys = children.select(*[F.col(f"`{c}`") for c in e.child_columns]).dropna()
        return self.bounded(e.parent, members(self.slim(e.parent, where), keys, list(zip(e.parent_columns, e.child_columns, strict=True))))

    def virtual_parents(self, table: str, children: DataFrame) -> list[tuple[str, DataFrame]]:
        """Parents along polymorphic keys: one filtered semi-join for each discriminator value."""
        out = []
        for v in self.graph.virtual:
            if v.child_table != table:
                continue
            for value, parent, column in v.mappings:
                skip, where = self.config.edge(table, parent) if self.options.closure == STRICT or self.options.upstream else (False, "")
                if skip or parent not in self.frames:
                    continue
                keys = children.where(F.col(f"`{v.discriminator}`") == value).select(F.col(f"`{v.child_column}`").alias("key")).dropna()
                out.append((parent, members(self.slim(parent, where), keys, [(column, "key")])))
        return out

    def cap(self, table: str, df: DataFrame) -> DataFrame:
        n = self.options.rows_per_table
        return df.orderBy(*[F.col(f"`{c}`") for c in self.model.key(table)]).limit(n) if n else df

    def anchor_rows(self, anchors: Sequence[Anchor]) -> dict[str, DataFrame]:
        parts: dict[str, list[DataFrame]] = {}
        for a in anchors:
            t = self.model.root_of(a.table)
            if t not in self.frames:
                raise ConfigError(f"anchor table {a.table} does not exist")
            df = self.slim(t, a.where)
            if a.limit:
                df = df.orderBy(*[F.col(f"`{c}`") for c in self.model.key(t)]).limit(a.limit)
            parts.setdefault(t, []).append(df)
        out = {}
        for t, dfs in parts.items():
            df = self.distinct(t, union_all(dfs))
            e = self.graph.self_edge(t)
            if e is not None and not (self.options.upstream and self.options.closure == STRICT):
                df = self.connected(t, e, df)
            out[t] = df
        return out

    def connected(self, table: str, e: Edge, seed: DataFrame) -> DataFrame:
        """The whole component of ``seed`` under a self-reference, up and down."""
        down = list(zip(e.child_columns, e.parent_columns, strict=True))
        up = [(b, a) for a, b in down]
        before, frontier = None, checkpointed(seed)
        known = Layers(frontier)
        while not frontier.isEmpty():
            self.step()
            found = members(self.slim(table), frontier, down).unionByName(members(self.slim(table), frontier.dropna(subset=list(e.child_columns)), up))
            # steps go both ways, so rows next to a round belong to it, the one before or the one after
            fresh = self.minus(table, self.minus(table, self.distinct(table, found), frontier), before)
            before, frontier = frontier, checkpointed(fresh)
            known.add(frontier)
        return known.rows()

    def step(self) -> None:
        if self.options.gate:
            self.options.gate()

    # --- closures -------------------------------------------------------------

    def run(self, anchors: Sequence[Anchor | str]) -> Slice:
        given = [*anchors]
        given = [a if isinstance(a, Anchor) else parse_anchors([a])[0] for a in given]
        if not given:
            parse_anchors([])
        start = {t: self.keep(df) for t, df in self.anchor_rows(given).items()}
        self.record_tenants(start)
        levels = graphs.depths(self.graph, start, lambda e: self.config.edge(e.parent, e.child)[0])
        owned, required = (self._single_pass if self.options.closure == SINGLE_PASS else self._strict)(start, levels)
        roles, tables = {}, {}
        for t in graphs.topological(self.graph):
            parts = [d.withColumns({"role": F.lit(r), "depth": F.lit(levels.get(t, 0) if r == "owned" else None).cast("int")}) for r, d in (("owned", owned.get(t)), ("required", required.get(t))) if d is not None]
            if parts and t in self.frames:
                roles[t] = union_all(parts)
        out = Slice(self.model, self.graph, self.config, tables, roles, {}, self.kept)
        bounded = self.options.children_per_parent or self.options.rows_per_table or any(a.limit and not self.model.has_key(self.model.root_of(a.table)) for a in given)
        for t in roles:
            rows = roles[t].drop("role", "depth")
            if self.model.has_key(t):
                full = members(self.frames[t], rows, self.identity(t))
            elif bounded:
                full = rows
            else:  # equal rows of a table without a key are one identity but stay as many rows
                full = members(self.frames[t], rows, self.identity(t), null_safe=True)
            tables[t] = self._nulled(t, full.select(*[F.col(f"`{c}`") for c in self.frames[t].columns]), roles, out)
        return out

    def _down(self, start: Mapping[str, DataFrame], levels: Mapping[str, int]) -> dict[str, DataFrame]:
        owned: dict[str, DataFrame] = dict(start)
        if self.options.upstream:
            return owned
        expand = lambda t: not self.options.depth or levels.get(t, 0) < self.options.depth

        def reached(t: str, sources: Mapping[str, DataFrame]) -> DataFrame | None:
            parts = []
            for e in self.graph.out_edges.get(t, ()):
                if e.parent in sources and e.parent != t and expand(e.parent):
                    self.step()
                    found = self.children(e, sources[e.parent])
                    if found is not None:
                        parts.append(found)
            if not parts:
                return None
            return parts[0] if len(parts) == 1 and self.model.has_key(t) else self.distinct(t, union_all(parts))

        for c in graphs.components(self.graph):
            if len(c.tables) == 1:
                t = c.tables[0]
                found = reached(t, owned)
                if found is not None:
                    if t in start:
                        found = self.minus(t, found, start[t])
                    found = self.cap(t, found)
                    owned[t] = self.keep(start[t].unionByName(found) if t in start else found)
                continue
            # a cycle of tables: rounds of newly owned rows until none are new
            outer = {k: v for k, v in owned.items() if k not in c.tables}
            fresh: dict[str, DataFrame] = {}
            for t in c.tables:
                found = reached(t, outer)
                parts = [x for x in (start.get(t), found) if x is not None]
                if parts:
                    fresh[t] = checkpointed(self.distinct(t, union_all(parts)))
                    owned[t] = fresh[t]
            known = {t: Layers(df) for t, df in fresh.items()}
            while fresh:
                after: dict[str, DataFrame] = {}
                for t in c.tables:
                    found = reached(t, {k: v for k, v in fresh.items() if k in c.tables})
                    if found is None:
                        continue
                    new = checkpointed(self.minus(t, found, owned.get(t)))
                    if not new.isEmpty():
                        after[t] = new
                        owned[t] = grown(known, t, new)
                fresh = after
            for t in c.tables:
                if self.options.rows_per_table and t in owned:
                    rest = self.cap(t, self.minus(t, owned[t], start.get(t)))
                    owned[t] = start[t].unionByName(rest) if t in start else rest
        return owned

    def _up(self, owned: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        required: dict[str, DataFrame] = {}
        pending: dict[str, list[DataFrame]] = {}

        def rows(t: str) -> DataFrame | None:
            parts = [x for x in (owned.get(t), required.get(t)) if x is not None]
            return union_all(parts) if parts else None

        def pull(t: str, source: DataFrame, inside: Sequence[str] | None = None) -> dict[str, list[DataFrame]]:
            out: dict[str, list[DataFrame]] = {}
            for e in self.graph.out_edges.get(t, ()):
                if inside is None or e.parent in inside:
                    self.step()
                    found = self.parents(e, source)
                    if found is not None:
                        out.setdefault(e.parent, []).append(found)
            for p, found in self.virtual_parents(t, source):
                if inside is None or p in inside:
                    out.setdefault(p, []).append(found)
            return out

        def admit(t: str, parts: list[DataFrame]) -> DataFrame:
            found = parts[0] if len(parts) == 1 and self.model.has_key(t) else self.distinct(t, union_all(parts))
            return self.minus(t, self.minus(t, found, owned.get(t)), required.get(t))

        for group in self._up_order():
            loops = len(group) > 1 or self.graph.self_edge(group[0]) is not None  # a self-reference closes over ancestors
            for t in group:
                if parts := pending.pop(t, None):
                    new = admit(t, parts)
                    required[t] = checkpointed(new) if loops else self.keep(new)
            if loops:
                fresh = {t: r for t in group if (r := rows(t)) is not None}
                known = {t: Layers(required[t]) for t in group if t in required}
                while fresh:
                    found: dict[str, list[DataFrame]] = {}
                    for t, source in fresh.items():
                        for p, parts in pull(t, source, group).items():
                            found.setdefault(p, []).extend(parts)
                    fresh = {}
                    for t, parts in found.items():
                        new = checkpointed(admit(t, parts))
                        if not new.isEmpty():
                            fresh[t] = new
                            required[t] = grown(known, t, new)
            for t in group:
                if (source := rows(t)) is not None:
                    for p, parts in pull(t, source).items():
                        if p not in group:
                            pending.setdefault(p, []).extend(parts)
        return required

    def _up_order(self) -> list[tuple[str, ...]]:
        """Components, children first, with polymorphic edges among the edges."""
        extra = {}
        for v in self.graph.virtual:
            for _, p, c in v.mappings:
                extra.setdefault(v.child_table, []).append(Edge(v.child_table, (v.child_column,), p, (c,)))
        both = Graph(self.graph.nodes, {t: [*self.graph.out_edges[t], *extra.get(t, ())] for t in self.graph.nodes}, self.graph.in_edges, [])
        return [c.tables for c in reversed(graphs.components(both))]

    def _strict(self, start: Mapping[str, DataFrame], levels: Mapping[str, int]):
        owned = self._down(start, levels)
        return owned, self._up(owned)

    def _single_pass(self, start: Mapping[str, DataFrame], levels: Mapping[str, int]):
        """Each table is expanded once: parents of the anchors first, then children of all visited rows."""
        visited = dict(start)

        def add(t: str, found: DataFrame) -> bool:
            known = visited.get(t)
            new = self.minus(t, self.distinct(t, found), known)
            visited[t] = self.keep(new if known is None else known.unionByName(new))
            return True

        if self.options.upstream:
            self._upstream_paths(visited, add, list(start))
            return visited, {}
        queue, seen = sorted(start), set(start)
        for t in queue:
            for e in self.graph.out_edges.get(t, ()):
                found = None if e.parent == t else self.parents(e, visited[t])
                if found is not None:
                    add(e.parent, found)
                    if e.parent not in seen:
                        seen.add(e.parent)
                        queue.append(e.parent)
            for p, found in self.virtual_parents(t, visited[t]):
                add(p, found)
                if p not in seen:
                    seen.add(p)
                    queue.append(p)
        queue, seen, depth = sorted(start), set(start), {t: 0 for t in start}
        for t in queue:
            if self.options.depth and depth[t] >= self.options.depth:
                continue
            for e in self.graph.in_edges.get(t, ()):
                found = None if e.child == t else self.children(e, visited[t])
                if found is not None:
                    add(e.child, self.cap(e.child, found))
                    if e.child not in seen:
                        seen.add(e.child)
                        depth[e.child] = depth[t] + 1
                        queue.append(e.child)
        return visited, {}

    def _upstream_paths(self, visited: dict[str, DataFrame], add, tables: list[str]) -> None:
        def climb(t: str, path: tuple[str, ...]) -> None:
            for e in self.graph.out_edges.get(t, ()):
                if e.parent not in path:
                    found = self.parents(e, visited[t])
                    if found is not None:
                        add(e.parent, found)
                        climb(e.parent, (*path, e.parent))
            for p, found in self.virtual_parents(t, visited[t]):
                if p not in path:
                    add(p, found)
                    climb(p, (*path, p))

        for t in tables:
            climb(t, (t,))

    # --- keys that would dangle -------------------------------------------------

    def _nulled(self, table: str, df: DataFrame, roles: Mapping[str, DataFrame], out: Slice) -> DataFrame:
        """Null the nullable keys of skipped edges, and those that a predicate leaves dangling."""
        for e in self.graph.out_edges.get(table, ()):
            skip, where = self.config.edge(e.child, e.parent)
            free = [c for c in e.child_columns if self.model.column(table, c).nullable]
            if skip:
                df = df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in free})
            elif where and self.options.closure == STRICT:
                if not free:
                    out.dangling.setdefault(table, []).extend(e.child_columns)
                    continue
                there = roles.get(e.parent)
                if there is None:
                    df = df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in free})
                    continue
                keys = there.select(*[F.col(f"`{c}`").alias(f"__p{i}") for i, c in enumerate(e.parent_columns)]).distinct().withColumn("__found", F.lit(True))
                cond = [df[f"`{c}`"] == keys[f"__p{i}"] for i, c in enumerate(e.child_columns)]
                names = df.columns
                joined = df.join(keys, cond, "left")
                df = joined.select(*[(F.when(F.col("__found"), F.col(f"`{c}`")) if c in free else F.col(f"`{c}`")).alias(c) for c in names])
        return df


def extract(frames: Mapping[str, DataFrame], model: SchemaModel, anchors: Sequence[Anchor | str], config: Config | None = None, options: Options | None = None) -> Slice:
    return Traversal(frames, model, config, options).run(anchors)


def reduced_edge(model: SchemaModel, e: Edge) -> Edge:
    """A two-column edge between distributed tables without the distribution columns, for display."""
    if len(e.child_columns) == 2 and model.is_distributed(e.child) and model.is_distributed(e.parent):
        a, b = model.distribution[e.child].column, model.distribution[e.parent].column
        rest = [(x, y) for x, y in zip(e.child_columns, e.parent_columns, strict=True) if not (x == a and y == b)]
        if len(rest) == 1:
            return Edge(e.child, (rest[0][0],), e.parent, (rest[0][1],), e.name)
    return e
