"""Functions by name with checked arguments; what goes wrong becomes a value, not an exception."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Rule:
    """What an argument may be: its type, its least and greatest size or value."""

    kind: type
    least: float | None = None
    most: float | None = None
    each_most: int | None = None

    def fault(self, value: Any) -> str | None:
        if not isinstance(value, self.kind) or isinstance(value, bool) and self.kind is not bool:
            return f"must be {self.kind.__name__}"
        size = len(value) if isinstance(value, (str, list)) else value
        if self.least is not None and size < self.least or self.most is not None and size > self.most:
            return f"must be between {self.least} and {self.most}"
        if self.each_most is not None and any(not isinstance(x, str) or len(x) > self.each_most for x in value):
            return f"entries must be strings of at most {self.each_most} characters"
        return None


_tools: dict[str, tuple[Callable, dict[str, Rule]]] = {}


def tool(name: str, **rules: Rule):
    def add(f: Callable) -> Callable:
        _tools[name] = (f, rules)
        return f

    return add


def names() -> list[str]:
    return sorted(_tools)


def call(name: str, allowed: set[str] | None = None, **arguments: Any) -> dict[str, Any]:
    """{"result": ...} or {"error": ...}."""
    if name not in _tools or allowed is not None and name not in allowed:
        return {"error": f"no tool {name}"}
    f, rules = _tools[name]
    unknown = set(arguments) - set(inspect.signature(f).parameters)
    faults = [f"{k}: {x}" for k, r in rules.items() if k in arguments and (x := r.fault(arguments[k]))] + [f"{k}: unknown" for k in sorted(unknown)]
    if faults:
        return {"error": "; ".join(faults)}
    try:
        return {"result": f(**arguments)}
    except Exception as e:  # a tool's failure is an answer to its caller
        return {"error": f"{type(e).__name__}: {e}"}


def keywords_rule() -> Rule:
    return Rule(list, 1, 20, 200)
