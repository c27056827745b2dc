"""The graph of tables: foreign keys from child to parent, cycles, orders, closures."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from slicer.plans.config import VirtualKey
from slicer.plans.model import SchemaModel


@dataclass(frozen=True)
class Edge:
    child: str
    child_columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    name: str = field(default="", compare=False)


@dataclass
class Graph:
    nodes: list[str]
    out_edges: dict[str, list[Edge]]
    in_edges: dict[str, list[Edge]]
    virtual: list[VirtualKey]

    @property
    def edges(self) -> list[Edge]:
        return [e for t in self.nodes for e in self.out_edges[t]]

    def self_edge(self, table: str) -> Edge | None:
        return next((e for e in self.out_edges.get(table, ()) if e.parent == table), None)


def build(model: SchemaModel, virtual: Iterable[VirtualKey] = ()) -> Graph:
    """Partitions fold into their logical table, shards are left out, equal edges count once."""
    virtual = list(virtual)
    nodes = {t for t in model.columns if not model.is_shard(t) and not model.is_partition(t)}
    for v in virtual:
        nodes |= {v.child_table, *(t for _, t, _ in v.mappings)}
    edges: dict[Edge, None] = {}
    for fk in model.foreign_keys:
        if model.is_shard(fk.from_table) or model.is_shard(fk.to_table):
            continue
        e = Edge(model.root_of(fk.from_table), fk.from_columns, model.root_of(fk.to_table), fk.to_columns, fk.name)
        nodes |= {e.child, e.parent}
        edges.setdefault(e)
    ordered = sorted(nodes)
    key = lambda e: (e.child, e.parent, e.child_columns, e.parent_columns)
    found = sorted(edges, key=key)
    return Graph(ordered, {t: [e for e in found if e.child == t] for t in ordered}, {t: [e for e in found if e.parent == t] for t in ordered}, virtual)


@dataclass(frozen=True)
class Component:
    tables: tuple[str, ...]
    cyclic: bool


def components(graph: Graph) -> list[Component]:
    """Strongly connected components, parents before children, found by an explicit depth-first stack."""
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    path: list[str] = []
    on_path: set[str] = set()
    out: list[Component] = []
    for start in graph.nodes:
        if start in index:
            continue
        work = [(start, iter(graph.out_edges[start]))]
        index[start] = low[start] = len(index)
        path.append(start)
        on_path.add(start)
        while work:
            node, edges = work[-1]
            step = next(edges, None)
            if step is not None:
                to = step.parent
                if to not in index:
                    index[to] = low[to] = len(index)
                    path.append(to)
                    on_path.add(to)
                    work.append((to, iter(graph.out_edges[to])))
                elif to in on_path:
                    low[node] = min(low[node], index[to])
                continue
            work.pop()
            if work:
                low[work[-1][0]] = min(low[work[-1][0]], low[node])
            if low[node] == index[node]:
                at = path.index(node)
                group = path[at:]
                del path[at:]
                on_path -= set(group)
                out.append(Component(tuple(sorted(group)), len(group) > 1 or any(e.parent == node for e in graph.out_edges[node])))
    return out


def has_cycles(graph: Graph) -> bool:
    return any(c.cyclic for c in components(graph))


def topological(graph: Graph) -> list[str]:
    """Tables, parents first; the order in which rows can be written."""
    return [t for c in components(graph) for t in c.tables]


def upstream_closure(graph: Graph, starts: Iterable[str], allowed: Callable[[Edge], bool] = lambda e: True) -> set[str]:
    """Tables reachable from ``starts`` through allowed edges to parents, polymorphic ones included."""
    seen, todo = set(), [t for t in starts]
    while todo:
        t = todo.pop()
        if t in seen:
            continue
        seen.add(t)
        todo += [e.parent for e in graph.out_edges.get(t, ()) if allowed(e)]
        for v in graph.virtual:
            if v.child_table == t:
                todo += [p for _, p, c in v.mappings if allowed(Edge(t, (v.child_column,), p, (c,)))]
    return seen


def depths(graph: Graph, starts: Iterable[str], skipped: Callable[[Edge], bool] = lambda e: False) -> dict[str, int]:
    """How many steps down each table is from the anchors' tables."""
    out = {t: 0 for t in starts}
    queue = list(out)
    for t in queue:
        for e in graph.in_edges.get(t, ()):
            if e.child not in out and not skipped(e):
                out[e.child] = out[t] + 1
                queue.append(e.child)
    return out


def cyclic_nullable(model: SchemaModel, graph: Graph) -> dict[str, list[str]]:
    """Nullable foreign key columns inside cycles, by table: what a two-phase load nulls first."""
    out: dict[str, list[str]] = {}
    for c in components(graph):
        if c.cyclic:
            for t in c.tables:
                found = [col for e in graph.out_edges[t] if e.parent in c.tables for col in e.child_columns if model.column(t, col).nullable]
                if found:
                    out[t] = list(dict.fromkeys(found))
    return out
