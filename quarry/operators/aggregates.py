"""Find aggregates as Spark aggregates; partial aggregation and spilling are Spark's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from quarry.functions.registry import Arg, order_key
from quarry.plans.query import QueryError
from quarry.sources.database import untag

PLAIN = ("count", "count-distinct", "distinct", "sum", "avg", "median", "variance", "stddev", "min", "max", "rand")
AMOUNT = ("min", "max", "rand", "sample")


def over_list(f, returns: str):
    """A callable for ``(aggregate ?f args... ?x)`` from a Python function of the arguments and the list of a group's values.

    The values come in no defined order, repeats included.  One list is held by one worker, so an aggregate that
    can be written as Columns (pass a function of Columns instead) is the one for large groups.
    """

    def column(*args):
        *extra, values = args
        run = F.udf(lambda xs: f(*extra, [untag(x) if isinstance(x, Row) and "rank" in x.__fields__ else x for x in xs]), returns)
        return run(F.collect_list(values))

    return column


def _number(a: Arg) -> Column:
    if a.kind in ("long", "entity", "double"):
        return a.col
    if a.kind == "any":
        return F.when(a.col["rank"] == 9, a.col["num"]).otherwise(F.raise_error(F.lit("aggregate over a value that is no number")).cast("double"))
    raise QueryError(f"a numeric aggregate cannot take {a.kind} values")


def amount_of(name: str, extra: list) -> int | None:
    """The amount of ``(min n ?x)``, ``(max n ?x)``, ``(rand n ?x)`` and ``(sample n ?x)``; 0 for a plain ``(rand ?x)``, None for all others."""
    if name == "rand" and not extra:
        return 0
    if name not in AMOUNT or not extra:
        return None
    n = int(extra[-1])
    if n <= 0:
        raise QueryError(f"{name} needs a positive amount")
    return n


def draws(df: DataFrame, n: int, prefix: str) -> tuple[DataFrame, list[str]]:
    """Add a column of random numbers for each draw."""
    names = [f"{prefix}{k}" for k in range(max(n, 1))]
    return df.withColumns({x: F.rand() for x in names}), names


def drawn(a: Arg, n: int, names: list[str]) -> Column:
    """Values drawn with replacement, a draw a column of random numbers: the value beside its greatest; no group is gathered."""
    one = [F.max_by(a.col, F.col(x)) for x in names]
    return F.array(*one) if n else one[0]


def amounts(df: DataFrame, keys: list[str], name: str, n: int, a: Arg) -> DataFrame:
    """keys and ``values``: the n smallest or largest (ascending, repeats kept), or n sampled without replacement, of each group.

    A rank within the group that is cut at n: Spark limits each group before and after the shuffle, so
    a task holds n values a group and never a whole one.
    """
    order = F.rand() if name == "sample" else order_key(a) if a.kind == "any" else a.col
    over = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    value = F.struct(order_key(a).alias("k"), a.col.alias("v"))
    top = df.select(*keys, order.alias("_o"), value.alias("_x"))
    top = top.withColumn("_r", F.row_number().over(over.orderBy(F.col("_o").desc() if name == "max" else F.col("_o")))).filter(F.col("_r") <= n)
    return top.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("_x")), lambda x: x["v"]).alias("values"))  # at most n a group


def aggregate(name: str, extra: list, a: Arg) -> tuple[Column, str]:
    """The aggregate of a column and the result's kind; extra: the arguments before the column."""
    c = a.col
    if extra and name in AMOUNT:
        raise QueryError(f"{name} with an amount is made by amounts()")
    if name == "count":
        return F.count(F.lit(1)), "long"
    if name == "count-distinct":
        return F.countDistinct(c), "long"
    if name == "distinct":
        return F.array_sort(F.collect_set(c)), "set"
    if name == "sum":
        return F.sum(_number(a)), "long" if a.kind in ("long", "entity") else "double"
    if name == "avg":
        return F.avg(_number(a)), "double"
    if name == "median":
        return F.median(_number(a)), "double"
    if name == "variance":
        return F.var_pop(_number(a)), "double"
    if name == "stddev":
        return F.stddev_pop(_number(a)), "double"
    if name in ("min", "max"):
        if a.kind == "any":
            return (F.min_by if name == "min" else F.max_by)(c, order_key(a)), "any"
        return (F.min if name == "min" else F.max)(c), a.kind
    raise QueryError(f"Unknown aggregate {name}")
