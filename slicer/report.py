"""The summary of a run, as text."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from slicer.operators.verify import format_report


def sampling_line(children_per_parent: int, anchors: int) -> str:
    many = f"{anchors} anchor{'' if anchors == 1 else 's'}"
    return f"{many}, {children_per_parent} children per parent" if children_per_parent else f"{many}, all children"


def summary(rows: Mapping[str, int], seconds: float, *, target: str = "", anchors: int = 0, children_per_parent: int = 0, cycles: bool = False, checks: Iterable | None = None) -> str:
    out = [f"slice complete ({'streamed to target' if target else 'SQL emitted'})"]
    if anchors or children_per_parent:
        out.append(sampling_line(children_per_parent, anchors))
    out += ["", *(f"  {t:<32}  {n} rows" for t, n in sorted(rows.items())), "", f"  {'Duration':<32}  {seconds:.3f}s"]
    if cycles:
        out.append("  circular foreign keys: constraints are deferred")
    if checks is not None:
        out += ["", format_report(list(checks))]
    return "\n".join(out)
