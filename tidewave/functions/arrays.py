"""Column functions over array<double> columns, all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F



def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(a: str | Column) -> Column:
    """Sum of an array, 0 for an empty one."""
    return F.aggregate(c(a), F.lit(0.0), lambda s, v: s + v)


def total_of(a: str | Column, f: Callable[[Column], Column]) -> Column:
    return F.aggregate(c(a), F.lit(0.0), lambda s, v: s + f(v))


def folded(a: str | Column, given: Column, f: Callable[[Column, Column], Column]) -> Column:
    """Sum of f(value, given); unlike a column that a lambda holds, `given` is evaluated once, not once per value."""
    start = F.struct(given.alias("g"), F.lit(0.0).alias("s"))
    return F.aggregate(c(a), start, lambda acc, v: F.struct(acc["g"].alias("g"), (acc["s"] + f(v, acc["g"])).alias("s")), lambda acc: acc["s"])


def let(value: str | Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value evaluated once; lambdas within f that hold a column evaluate it anew for every element."""
    return F.get(F.transform(F.array(c(value)), f), F.lit(0))


def numbered(a: str | Column) -> Column:
    """The values as structs (v, k) with their 0-based place as a double."""
    return F.transform(c(a), lambda v, i: F.struct(v.alias("v"), i.cast("double").alias("k")))


def ratio(a: Column, b: Column, otherwise: float | None = 0.0) -> Column:
    """a / b, or `otherwise` where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(otherwise).cast("double"))


def mean(a: str | Column) -> Column:
    return ratio(total(a), F.size(c(a)).cast("double"), None)


def indexed(a: str | Column, f: Callable[[Column, Column], Column]) -> Column:
    """transform with a 0-based double index."""
    return F.transform(c(a), lambda v, i: f(v, i.cast("double")))


def dot(a: str | Column, b: str | Column) -> Column:
    return total(F.zip_with(c(a), c(b), lambda x, y: x * y))


def head(a: str | Column, drop: int = 1) -> Column:
    """All but the last `drop` values."""
    return F.slice(c(a), F.lit(1), F.greatest(F.size(c(a)) - drop, F.lit(0)))


def tail(a: str | Column, drop: int = 1) -> Column:
    """All but the first `drop` values."""
    return F.slice(c(a), F.lit(drop + 1), F.greatest(F.size(c(a)) - drop, F.lit(0)))


def diff(a: str | Column, f: Callable[[Column, Column], Column] = lambda now, before: now - before) -> Column:
    """f(x[i + 1], x[i]) for all neighbours."""
    return F.zip_with(tail(a), head(a), f)


def argmax(a: str | Column) -> Column:
    """0-based place of the first maximum."""
    return F.array_position(c(a), F.array_max(c(a))) - 1


def first_where(a: str | Column, f: Callable[[Column, Column], Column]) -> Column:
    """0-based place of the first value with f(value, place), or null."""
    return F.array_position(F.transform(c(a), f), F.lit(True)).cast("long") - 1


def first_from(a: str | Column, start: Column, f: Callable[[Column], Column]) -> Column:
    """0-based place, at `start` or later, of the first value with f(value), or null; in one pass. `f` may hold lambda variables (see `let`)."""
    begin = F.struct(start.cast("long").alias("s"), F.lit(0).cast("long").alias("i"), F.lit(None).cast("long").alias("at"))
    step = lambda acc, v: F.struct(acc["s"].alias("s"), (acc["i"] + 1).alias("i"), F.when(acc["at"].isNull() & (acc["i"] >= acc["s"]) & f(v), acc["i"]).otherwise(acc["at"]).alias("at"))
    return F.aggregate(c(a), begin, step, lambda acc: acc["at"])


def rounded(x: str | Column, digits: int = 6) -> Column:
    """Rounded, with -0.0 as 0.0."""
    return F.round(c(x), digits) + F.lit(0.0)
