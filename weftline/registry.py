"""The table of operators: names, kinds and functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Operator:
    name: str
    kind: str  # source, pipe, keyed, reducer or sink
    function: Callable
    doc: str


OPERATORS: dict[str, Operator] = {}


def operator(name: str, kind: str = "pipe") -> Callable[[Callable], Callable]:
    """Registers a function under an operator's name; user code extends the engine with it too."""

    def register(fn: Callable) -> Callable:
        OPERATORS[name] = Operator(name, kind, fn, (fn.__doc__ or "").strip())
        return fn

    return register


def manual(topic: str | None = None) -> str:
    """The manual page of an operator, or a list of all."""
    if topic is None:
        return "\n".join(f"{o.kind:8} {o.name:14} {o.doc.splitlines()[0] if o.doc else ''}" for o in sorted(OPERATORS.values(), key=lambda o: (o.kind, o.name)))
    o = OPERATORS[topic]
    return f"{o.name} ({o.kind})\n{o.doc}"
