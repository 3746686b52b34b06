"""Pipelines: chains of registered operators over a DataFrame, reusable as macros.

    Pipeline().acceptIf("l_quantity > 30").add(revenue="l_extendedprice * (1 - l_discount)").run(df)

Every step adds to one logical plan, which Spark optimises as a whole. Text arguments may hold properties, which
`bind` fills: ${name}; ${name : default}; ${name ? value:text value:text DEFAULT:text}. A default or text that
begins with @ is the property of that name; references may stand in each other.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

import weftline.operators  # noqa: F401  registers
import weftline.sources.formats  # noqa: F401
import weftline.sources.inline  # noqa: F401
from weftline.registry import OPERATORS, operator

_PROPERTY = re.compile(r"\$\{\s*([\w.-]+)\s*(?:([:?])\s*([^{}$]*?)\s*)?\}")
_DEPTH = 16


def resolve(text: str, properties: dict[str, object]) -> str:
    """`text` with its property references replaced, the innermost first."""

    def given(v: str) -> str:
        return str(properties[v[1:]]) if v.startswith("@") else v

    def put(m: re.Match) -> str:
        name, form, rest = m.groups()
        if form == "?":
            cases = dict(c.partition(":")[::2] for c in rest.split())
            key = str(properties.get(name, "DEFAULT"))
            return given(cases[key] if key in cases else cases["DEFAULT"])
        return str(properties[name]) if name in properties or form is None else given(rest)

    for _ in range(_DEPTH):
        if not _PROPERTY.search(text):
            return text
        text = _PROPERTY.sub(put, text)
    raise ValueError(f"properties that refer to themselves: {text}")


class Pipeline:
    """An immutable list of (operator, arguments); a pipeline is callable and so an argument of if and macro."""

    def __init__(self, steps: tuple = ()) -> None:
        self.steps = steps

    def __getattr__(self, name: str) -> Callable[..., Pipeline]:
        key = name.rstrip("_")
        if key not in OPERATORS:
            raise AttributeError(f"no operator {key}")
        return lambda *args, **kwargs: Pipeline((*self.steps, (key, args, kwargs)))

    def then(self, other: Pipeline | Callable[[DataFrame], DataFrame]) -> Pipeline:
        """This pipeline, then another (macro)."""
        return Pipeline((*self.steps, *other.steps)) if isinstance(other, Pipeline) else Pipeline((*self.steps, (other, (), {})))

    def bind(self, **properties: object) -> Pipeline:
        """The pipeline with its ${names} replaced."""

        def fill(v):
            if isinstance(v, str):
                return resolve(v, properties)
            if isinstance(v, (list, tuple)):
                return type(v)(map(fill, v))
            return {k: fill(x) for k, x in v.items()} if isinstance(v, dict) else v.bind(**properties) if isinstance(v, Pipeline) else v

        return Pipeline(tuple((op, fill(args), fill(kwargs)) for op, args, kwargs in self.steps))

    def run(self, df: DataFrame) -> DataFrame:
        for op, args, kwargs in self.steps:
            df = (OPERATORS[op].function if isinstance(op, str) else op)(df, *args, **kwargs)
        return df

    __call__ = run

    def collect(self, df: DataFrame) -> list:
        """The rows, for small results."""
        return self.run(df).collect()


@operator("macro")
def macro(df: DataFrame, pipeline: Pipeline | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """macro. Runs a saved pipeline."""
    return pipeline(df)
