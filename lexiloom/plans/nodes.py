"""Plan nodes: immutable trees that are rewritten from the leaves up."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from typing import Any


class Node:
    """A frozen dataclass whose fields may hold further nodes, or tuples of them."""

    def _parts(self) -> list[dataclasses.Field]:
        return [f for f in dataclasses.fields(self) if f.init]

    def children(self) -> list[Node]:
        out = []
        for f in self._parts():
            value = getattr(self, f.name)
            out += [v for v in (value if isinstance(value, tuple) else (value,)) if isinstance(v, Node)]
        return out


def replace(f: Callable[[Any], Any], plan: Any) -> Any:
    """``f`` applied to all parts of a plan, leaves first; anything that isn't a node is a leaf."""
    if isinstance(plan, Node):
        new = {p.name: replace(f, getattr(plan, p.name)) for p in plan._parts()}
        if any(new[k] is not getattr(plan, k) for k in new):
            plan = dataclasses.replace(plan, **new)
        return f(plan)
    if isinstance(plan, tuple) and any(isinstance(v, Node) for v in plan):
        return tuple(replace(f, v) for v in plan)
    return f(plan)
