"""Computing an expression once per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row.

    Catalyst copies an expression to every place that mentions it, into filters it pushes down and,
    per element, into lambda bodies. A lambda variable holds the value instead. Worth it for costly
    values only (a regular expression, a vector's length): the lambda runs outside generated code.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
