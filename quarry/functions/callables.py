"""Callables of a query: functions of Columns, or Python functions run over Arrow batches.

A function of Columns stays in the plan and is the one for large data.  A plain
Python function is wrapped: as a predicate it is taken as it is, as a function
it needs the type that it returns, ``function(f, "bigint")``.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.plans.query import QueryError


def _value(v):
    """A value of an Arrow batch as Python's own."""
    return v.item() if hasattr(v, "item") else v


def function(f: Callable, returns: str) -> Callable[..., Column]:
    """A Python function of values as a function of Columns, evaluated batch by batch; None drops the row.

    A type of several fields ("a bigint, b string") takes tuples or maps.
    """
    shape = T._parse_datatype_string(returns)
    if isinstance(shape, T.StructType):
        return _of_fields(f, shape)

    def over_batches(*series: pd.Series) -> pd.Series:
        return pd.Series([f(*(_value(x) for x in row)) for row in zip(*series, strict=True)], dtype=object)

    over_batches.__annotations__ = {}
    run = F.pandas_udf(over_batches, returns, functionType=F.PandasUDFType.SCALAR)
    return lambda *cols: run(*cols)


def _of_fields(f: Callable, shape: T.StructType) -> Callable[..., Column]:
    names = shape.fieldNames()

    def over_batches(*series: pd.Series) -> pd.DataFrame:
        rows = [f(*(_value(x) for x in row)) for row in zip(*series, strict=True)]
        rows = [tuple(r[n] for n in names) if isinstance(r, dict) else r for r in rows]
        cols = {n: pd.Series([None if r is None else r[k] for r in rows], dtype=object) for k, n in enumerate(names)}
        return pd.DataFrame(cols | {"_some": [r is not None for r in rows]})

    over_batches.__annotations__ = {}
    run = F.pandas_udf(over_batches, T.StructType([*shape.fields, T.StructField("_some", T.BooleanType())]), functionType=F.PandasUDFType.SCALAR)

    def column(*cols: Column) -> Column:
        out = run(*cols)
        return F.when(out["_some"], F.struct(*[out[n].alias(n) for n in names]))

    return column


def predicate(f: Callable) -> Callable[..., Column]:
    """A Python function of values as a filter; anything but None and False keeps the row."""
    return function(lambda *row: (out := f(*row)) is not None and out is not False, "boolean")


def as_column(name: str, f: Callable, cols: list[Column], filters: bool) -> Column:
    """What a callable gives for columns; a plain Python predicate is wrapped."""
    try:
        out = f(*cols)
    except (PySparkException, TypeError, AttributeError):
        out = None  # the function wants values, not columns
    if isinstance(out, Column):
        return out
    if filters:
        return predicate(f)(*cols)
    raise QueryError(f"{name} must be a function of Columns, or be wrapped with its return type: function(f, 'string')")
