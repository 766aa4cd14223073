"""Stage ordering: named stages with dependencies and conditions, sorted so that each comes after what it needs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Stage:
    name: str
    run: Callable[[dict[str, Any]], Any]
    needs: tuple[str, ...] = ()
    enabled: Callable[[dict], bool] = field(default=lambda options: True)


def ordered(stages: list[Stage]) -> list[Stage]:
    """Kahn's order, by position among equals; an unknown need or a cycle is an error that names it."""
    by = {s.name: s for s in stages}
    if len(by) < len(stages):
        raise ValueError("two stages have one name")
    for s in stages:
        for n in s.needs:
            if n not in by:
                raise ValueError(f"stage {s.name} needs {n}, which there is not")
    done: list[Stage] = []
    left = list(stages)
    while left:
        ready = next((s for s in left if all(n in {d.name for d in done} for n in s.needs)), None)
        if ready is None:
            path = [left[0].name]
            while path.count(path[-1]) < 2:
                path.append(next(n for n in by[path[-1]].needs if n in {s.name for s in left}))
            raise ValueError("stages in a cycle: " + " -> ".join(path[path.index(path[-1]) :]))
        done.append(ready)
        left.remove(ready)
    return done


def run(stages: list[Stage], options: dict | None = None) -> dict[str, Any]:
    """Results by name; a disabled stage gives None, and so do those that need it."""
    options = options or {}
    out: dict[str, Any] = {}
    for s in ordered([s for s in stages]):
        on = s.enabled(options) and all(out.get(n) is not None for n in s.needs)
        out[s.name] = s.run({n: out[n] for n in s.needs}) if on else None
    return out
