"""Extension points: named steps over tables, and table functions with checked arguments."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

Step = Callable[[DataFrame], DataFrame]


class Steps:
    """Named steps from table to table, applied in the order in which they were added; a step that is added again replaces its former self in place."""

    def __init__(self) -> None:
        self._steps: dict[str, Step] = {}

    def add(self, name: str, step: Step) -> Steps:
        self._steps[name] = step
        return self

    def remove(self, name: str) -> Steps:
        self._steps.pop(name, None)
        return self

    def __call__(self, rows: DataFrame) -> DataFrame:
        return reduce(lambda df, step: df.transform(step), self._steps.values(), rows)


def table_function(name: str, schema: str, arguments: dict[str, Callable[[object], bool]], rows: Callable[..., list[tuple]]):
    """A table function (for SQL ``LATERAL``) whose arguments, in the order of ``arguments``, must pass their checks."""
    checks = list(arguments.items())

    class Tool:
        def eval(self, *values):
            if len(values) != len(checks):
                raise ValueError(f"{name} takes {len(checks)} arguments")
            for (argument, check), value in zip(checks, values, strict=True):
                if not check(value):
                    raise ValueError(f"{name}: {argument} is {value!r}")
            yield from rows(*values)

    return udtf(Tool, returnType=schema)


def register(spark: SparkSession, name: str, *definition) -> None:
    """Makes :func:`table_function` known to SQL under its name."""
    spark.udtf.register(name, table_function(name, *definition))
