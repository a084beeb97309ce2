"""The primitives and combining forms of functional programs, as builders of column expressions.

A sequence is an array column, a fixed tuple a struct, T and F are booleans. Errors are Spark's (ANSI mode): selecting
past the end, dividing by zero and 64-bit overflow raise, they never give a value.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Fn = Callable[[Column], Column]


def select(n: int) -> Fn:
    return lambda x: F.element_at(x, n)


def identity(x: Column) -> Column:
    return x


def _not_empty(x: Column) -> Column:
    return F.when(F.size(x) == 0, F.raise_error(F.lit("an empty sequence has no tail"))).otherwise(x)


def tl(x: Column) -> Column:
    return F.slice(_not_empty(x), F.lit(2), F.size(x) - 1)


def tlr(x: Column) -> Column:
    return F.slice(_not_empty(x), F.lit(1), F.size(x) - 1)


def last(x: Column) -> Column:
    return F.element_at(x, -1)


def null(x: Column) -> Column:
    return F.size(x) == 0


def length(x: Column) -> Column:
    return F.size(x)


def reverse(x: Column) -> Column:
    return F.reverse(x)


def apndl(e: Column, xs: Column) -> Column:
    return F.array_prepend(xs, e)


def apndr(xs: Column, e: Column) -> Column:
    return F.array_append(xs, e)


def cat(*xs: Column) -> Column:
    return F.concat(*xs)


def distl(y: Column, xs: Column) -> Column:
    return F.transform(xs, lambda e: F.struct(y.alias("a"), e.alias("b")))


def distr(xs: Column, y: Column) -> Column:
    return F.transform(xs, lambda e: F.struct(e.alias("a"), y.alias("b")))


def trans(rows: Column) -> Column:
    """Transpose; rows are as long as the first."""
    return F.transform(F.sequence(F.lit(1), F.size(F.element_at(rows, 1))), lambda c: F.transform(rows, lambda r: F.element_at(r, c)))


def eq(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def lt(a: Column, b: Column) -> Column:
    """Both sides are of one kind: Spark refuses, or here compares, what its types allow."""
    return a < b


def le(a: Column, b: Column) -> Column:
    return a <= b


def gt(a: Column, b: Column) -> Column:
    return a > b


def ge(a: Column, b: Column) -> Column:
    return a >= b


def conjunction(a: Column, b: Column) -> Column:
    """T if both are T, else F; null is not T."""
    return F.coalesce(a, F.lit(False)) & F.coalesce(b, F.lit(False))


def atom(data_type: T.DataType) -> Fn:
    """Whether values of a type are atoms: all that aren't sequences or tuples, which a column's type says."""
    return lambda x: F.lit(not isinstance(data_type, (T.ArrayType, T.StructType, T.MapType)))


def negate(x: Column) -> Column:
    """Anything but T is T's opposite."""
    return ~F.coalesce(x, F.lit(False))


def add(a: Column, b: Column) -> Column:
    return a.cast("bigint") + b.cast("bigint")


def sub(a: Column, b: Column) -> Column:
    return a.cast("bigint") - b.cast("bigint")


def mul(a: Column, b: Column) -> Column:
    return a.cast("bigint") * b.cast("bigint")


def div(a: Column, b: Column) -> Column:
    """Integer quotient, cut toward zero."""
    return (a.cast("decimal(20,0)") / b.cast("decimal(20,0)")).cast("decimal(38,6)").cast("bigint")


def implode(sep: str, words: Column) -> Column:
    return F.array_join(words, sep)


def chars(x: Column) -> Column:
    """The characters of a text; empty for the empty text."""
    return F.when(F.length(x) == 0, F.array().cast("array<string>")).otherwise(F.split(x, ""))


# combining forms


def comp(*fs: Fn) -> Fn:
    """f after g after ...: the last is applied first."""
    return lambda x: reduce(lambda acc, f: f(acc), reversed(fs), x)


def cons(*fs: Fn) -> Fn:
    return lambda x: F.array(*[f(x) for f in fs])


def const(v) -> Fn:
    return lambda x: F.lit(v)


def cond(p: Fn, f: Fn, g: Fn) -> Fn:
    return lambda x: F.when(p(x), f(x)).otherwise(g(x))


def alpha(f: Fn) -> Fn:
    """f applied to all elements."""
    return lambda xs: F.transform(xs, f)


def insert(f: Callable[[Column, Column], Column]) -> Fn:
    """Right fold without a start: f(x1, f(x2, ...)); of an empty sequence an error."""
    return lambda xs: F.aggregate(F.slice(F.reverse(xs), F.lit(2), F.size(_not_empty(xs)) - 1), F.element_at(xs, -1), lambda acc, x: f(x, acc))


def bounded_while(p: Fn, f: Fn, rounds: int) -> Fn:
    """f while p, at most `rounds` times; f keeps the type. The loop is a fold, so the expression doesn't grow with it."""
    return lambda x: F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x, lambda acc, _: F.when(p(acc), f(acc)).otherwise(acc))
