"""The recipe algebra: nested lists become DataFrame plans.

A recipe is the name of a source or a list whose head names a form; columns are numbered from 1. Relations are sets of
rows with columns c1 ... cn. Every form keeps track of keys (column sets that no two rows share), so that rows are only
made distinct where a projection or union could repeat some: a projection that keeps a key needs no shuffle.

    ["sel", src, c, v]              rows whose column c is v
    ["starts", src, c, p]           rows whose column c starts with p
    ["cmp", src, i, j]              rows whose column i is less than column j
    ["proj", src, [cols]]           columns, in any order, repeated or not
    ["join", G, H, [cols]]          G's second column meets H's first, which the result leaves out
    ["joinon", L, R, [[i, j]...], [cols]]   all pairs equal; no pairs: every row of L with every row of R
    ["minus", L, R]                 rows of L that R hasn't
    ["count", src, c]               each value of c with its number of rows
    ["sum", src, c, over]           each value of c with the sum of column over
    ["calc", src, op, i, j]         column i op column j appended: + - * / ^, exact; rows that divide by zero go
    ["pairwith", src, v]            the constant v appended
    ["flat", src]                   the tuple in column 1 spliced into columns
    ["union", src, src...]          rows of any arm (several recipes of one head)

c in count and sum may be ["CONS", i, j...]: the key is then a tuple in column 1. "Head#base" is a head's rows so far.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import kind, same_kind

Recipe = str | list


@dataclass(frozen=True)
class Relation:
    """Rows with columns c1 ... cn and the column sets (numbers from 1) known to be unique. No keys: rows may repeat."""

    df: DataFrame
    keys: frozenset[frozenset[int]] = frozenset()

    @property
    def width(self) -> int:
        return len(self.df.columns)

    def type(self, c: int) -> T.DataType:
        if not 1 <= c <= self.width:
            raise IndexError(f"column {c} of {self.width}")
        return self.df.schema[c - 1].dataType

    def as_set(self) -> Relation:
        """The same rows, each once."""
        return self if self.keys else Relation(self.df.distinct(), frozenset([frozenset(range(1, self.width + 1))]))


def relation(df: DataFrame, *keys) -> Relation:
    """df's columns in order, renamed c1 ... cn; keys are tuples of column numbers."""
    return Relation(df.toDF(*[f"c{k}" for k in range(1, len(df.columns) + 1)]), frozenset(frozenset(k) for k in keys))


def _c(i: int) -> Column:
    return F.col(f"c{i}")


def literal(value, data_type: T.DataType) -> Column | None:
    """value as a literal of a column's kind; None if they are of different kinds and so never equal."""
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if number != (kind(data_type) == "number") or (isinstance(value, str) and kind(data_type) in ("sequence", "boolean")):
        return None
    return F.lit(value) if number or kind(data_type) == "text" else F.lit(value).cast(data_type)


#: What exact arithmetic is done in: 19 digits before the point, as 64-bit integers have, and 18 after it.
EXACT, WHOLE, FRACTION = "decimal(37,18)", "decimal(19,0)", "decimal(18,18)"
#: What quotients are worked out in, and how many decimals they have.
UNITS, DECIMALS = "decimal(38,0)", 13


def exact(col: Column, data_type: T.DataType) -> Column:
    """A number, or the text of one, as an exact decimal; a double is the shortest decimal that reads back as it."""
    return col.cast(WHOLE if isinstance(data_type, T.IntegralType) else EXACT)


def _split(x: Column) -> tuple[Column, Column]:
    whole = F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast(WHOLE)
    return whole, (x - whole).cast(FRACTION)


def _product(x: Column, y: Column) -> Column:
    """x * y of EXACT numbers, by parts, since the product of two wide decimals would lose its last digits."""
    (a, b), (c, d) = _split(x), _split(y)
    # a sum has a digit more than its parts
    return reduce(lambda s, p: (s + p.cast("decimal(37,17)")).cast("decimal(37,17)"), [a * d, b * c, b * d], (a * c).cast("decimal(37,17)"))


def _units(x: Column) -> Column:
    """An EXACT number as a whole number of units of its last decimal."""
    whole, rest = _split(x)
    return (whole * F.lit(Decimal(10**18)) + (rest * F.lit(Decimal(10**18))).cast("decimal(18,0)")).cast(UNITS)


def _quotient(x: Column, y: Column) -> Column:
    """x / y of UNITS with 13 decimals, half away from zero, by long division in whole numbers: a double has too few digits to
    tell on which side of a half a quotient by more than some hundreds lies. 13 digits are taken at once if that many fit
    behind a remainder, else one by one."""
    a, b = F.abs(x), F.abs(y)
    steps = F.when(b <= F.lit(Decimal(10 ** (38 - DECIMALS))), F.array(F.lit(10**DECIMALS))).otherwise(F.array_repeat(F.lit(10), DECIMALS))

    def longer(acc: Column, power: Column) -> Column:
        rest = (acc["rest"] * power.cast("decimal(14,0)")).cast(UNITS)
        return F.struct((acc["digits"] * power + F.call_function("div", rest, b)).alias("digits"), (rest % b).cast(UNITS).alias("rest"))

    def ended(acc: Column) -> Column:
        return acc["digits"] + (acc["rest"] >= b - acc["rest"]).cast("bigint")

    rest = (a % b).cast(UNITS)
    digits = F.aggregate(steps, F.struct(F.lit(0).cast("bigint").alias("digits"), rest.alias("rest")), longer, ended)
    value = ((a - rest) / b).cast(WHOLE).cast("decimal(32,13)") + digits.cast("decimal(14,0)") * F.lit(Decimal(1).scaleb(-DECIMALS))
    return F.when((x < 0) != (y < 0), -value).otherwise(value).cast("decimal(38,13)")


def arithmetic(op: str, a: Column, b: Column, ta: T.DataType, tb: T.DataType) -> Column:
    """a op b, exact: integers stay 64-bit integers but for /, whose quotient has 13 decimals; other numbers have 19 digits
    before the point, and 18 decimals (a product 17). What doesn't fit is an error."""
    integers = isinstance(ta, T.IntegralType) and isinstance(tb, T.IntegralType)
    if op == "^":
        if not isinstance(tb, T.IntegralType):
            raise TypeError("the exponent is an integer")
        one, step = (F.lit(1).cast("decimal(38,0)"), lambda x, y: (x * y).cast("decimal(38,0)")) if integers else (F.lit(1).cast(EXACT), lambda x, y: _product(x, y).cast(EXACT))
        power = F.aggregate(F.array_repeat(exact(a, ta), b.cast("int")), one, step)
        return power.cast("bigint") if integers else power
    if op not in ("+", "-", "*", "/"):
        raise ValueError(f"unknown operator {op!r}")
    if integers and op != "/":
        a, b = a.cast("bigint"), b.cast("bigint")
        return {"+": a + b, "-": a - b, "*": a * b}[op]
    a, b = exact(a, ta), exact(b, tb)
    if integers:
        return _quotient(a.cast(UNITS), b.cast(UNITS))
    a, b = a.cast(EXACT), b.cast(EXACT)
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: _product(a, b), "/": lambda: _quotient(_units(a), _units(b))}[op]()


def printed(col: Column) -> Column:
    """A decimal's text without trailing zeros."""
    text = col.cast("string")
    return F.when(F.contains(text, F.lit(".")), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)


class Compiler:
    """Compiles recipes over sources; a source name gives a Relation."""

    def __init__(self, source: Callable[[str], Relation]):
        self.source = source

    def __call__(self, recipe: Recipe) -> Relation:
        if isinstance(recipe, str):
            return self.source(recipe)
        form, *args = recipe
        method = getattr(self, f"_{form}", None)
        if method is None:
            raise ValueError(f"unknown form {form!r}")
        return method(*args)

    def rows(self, recipe: Recipe) -> DataFrame:
        """The recipe's rows, each once."""
        return self(recipe).as_set().df

    def _sel(self, src, c, v):
        r = self(src)
        value = literal(v, r.type(c))
        return Relation(r.df.where(F.lit(False) if value is None else _c(c) == value), r.keys)

    def _starts(self, src, c, p):
        r = self(src)
        same_kind(r.type(c), T.StringType(), "starts")
        return Relation(r.df.where(_c(c).startswith(p)), r.keys)

    def _cmp(self, src, i, j):
        r = self(src)
        same_kind(r.type(i), r.type(j), "cmp")
        return Relation(r.df.where(_c(i) < _c(j)), r.keys)

    def _proj(self, src, cols):
        r = self(src)
        for c in cols:
            r.type(c)
        out = r.df.select(*[_c(c).alias(f"c{k}") for k, c in enumerate(cols, 1)])
        first = {c: k for k, c in reversed(list(enumerate(cols, 1)))}
        keys = frozenset(frozenset(first[c] for c in key) for key in r.keys if key <= set(cols))
        return Relation(out, keys).as_set()

    def _join(self, g, h, cols):
        left, right = self(g), self(h)
        kept = [*range(1, left.width + 1), *range(left.width + 2, left.width + right.width + 1)]
        return self._pick(self._paired(left, right, [[2, 1]]), [kept[c - 1] for c in cols])

    def _joinon(self, l, r, pairs, cols):
        return self._pick(self._paired(self(l), self(r), pairs), cols)

    def _paired(self, left: Relation, right: Relation, pairs) -> Relation:
        n = left.width
        moved = right.df.toDF(*[f"c{n + k}" for k in range(1, right.width + 1)])
        for i, j in pairs:
            if kind(left.type(i)) != kind(right.type(j)):  # values of different kinds are never equal
                return Relation(left.df.crossJoin(moved).where(F.lit(False)), frozenset([frozenset(range(1, n + right.width + 1))]))
        if pairs:
            df = left.df.join(moved, reduce(lambda a, b: a & b, [_c(i) == _c(n + j) for i, j in pairs]))
        else:
            df = left.df.crossJoin(moved)
        on_left, on_right = {i for i, _ in pairs}, {j for _, j in pairs}
        keys = {a | {n + k for k in b} for a in left.keys for b in right.keys}
        if any(b <= on_right for b in right.keys):  # each row of left meets one at most
            keys |= left.keys
        if any(a <= on_left for a in left.keys):
            keys |= {frozenset(n + k for k in b) for b in right.keys}
        return Relation(df, frozenset(frozenset(k) for k in keys))

    def _pick(self, r: Relation, cols) -> Relation:
        return Compiler(lambda _: r)(["proj", "", cols])

    def _minus(self, l, r):
        left, right = self(l), self(r)
        if [kind(f.dataType) for f in left.df.schema] != [kind(f.dataType) for f in right.df.schema]:
            return left.as_set()
        if left.keys:  # an anti-join keeps left's keys and its partitioning
            other = right.df.toDF(*[f"r{k}" for k in range(1, right.width + 1)])
            on = reduce(lambda a, b: a & b, [_c(k).eqNullSafe(F.col(f"r{k}")) for k in range(1, left.width + 1)])
            return Relation(left.df.join(other, on, "left_anti"), left.keys)
        return Relation(left.df.subtract(right.df), frozenset([frozenset(range(1, left.width + 1))]))

    def _grouped(self, src, c) -> tuple[Relation, Column]:
        r = self(src).as_set()
        if isinstance(c, list):
            if c[0] != "CONS":
                raise ValueError(f"unknown key {c!r}")
            for i in c[1:]:
                r.type(i)
            return r, F.struct(*[_c(i).alias(f"k{k}") for k, i in enumerate(c[1:], 1)])
        r.type(c)
        return r, _c(c)

    def _count(self, src, c):
        r, key = self._grouped(src, c)
        return Relation(r.df.groupBy(key.alias("c1")).agg(F.count("*").alias("c2")), frozenset([frozenset([1])]))

    def _sum(self, src, c, over):
        r, key = self._grouped(src, c)
        value = _c(over)
        if isinstance(r.type(over), (T.FloatType, T.DoubleType)):
            value = value.cast("decimal(28,12)")
        same_kind(r.type(over), T.LongType(), "sum")
        return Relation(r.df.groupBy(key.alias("c1")).agg(F.sum(value).alias("c2")), frozenset([frozenset([1])]))

    def _calc(self, src, op, i, j):
        r = self(src)
        df = r.df.where(exact(_c(j), r.type(j)) != 0) if op == "/" else r.df
        return Relation(df.withColumn(f"c{r.width + 1}", arithmetic(op, _c(i), _c(j), r.type(i), r.type(j))), r.keys)

    def _pairwith(self, src, v):
        r = self(src)
        return Relation(r.df.withColumn(f"c{r.width + 1}", F.lit(v)), r.keys)

    def _flat(self, src):
        r = self(src)
        if not isinstance(r.type(1), T.StructType):
            raise TypeError("flat takes a tuple in column 1")
        parts = [F.col(f"c1.{f.name}") for f in r.type(1)]
        n = len(parts)
        out = r.df.select(*[x.alias(f"c{k}") for k, x in enumerate([*parts, *[_c(i) for i in range(2, r.width + 1)]], 1)])
        return Relation(out, frozenset(frozenset(x for k in key for x in (range(1, n + 1) if k == 1 else [k + n - 1])) for key in r.keys))

    def _union(self, *arms):
        parts = [self(a) for a in arms]
        if len(parts) == 1:
            return parts[0].as_set()
        return Relation(reduce(DataFrame.union, [p.df for p in parts])).as_set()


def sources(recipe: Recipe) -> list[str]:
    """The source names of a recipe, in order, repeats included."""
    if isinstance(recipe, str):
        return [recipe]
    n = {"join": 2, "joinon": 2, "minus": 2, "union": len(recipe) - 1}.get(recipe[0], 1)
    return [s for part in recipe[1 : n + 1] for s in sources(part)]


def negated(recipe: Recipe) -> set[str]:
    """Sources whose growth may take rows away or change them: under minus's right side, count or sum."""
    if isinstance(recipe, str):
        return set()
    form = recipe[0]
    if form in ("count", "sum"):
        return set(sources(recipe[1]))
    if form == "minus":
        return negated(recipe[1]) | set(sources(recipe[2]))
    n = {"join": 2, "joinon": 2, "union": len(recipe) - 1}.get(form, 1)
    return set().union(*[negated(part) for part in recipe[1 : n + 1]])


def introduces(recipe: Recipe) -> bool:
    """Whether the recipe can make values that its sources don't hold."""
    if isinstance(recipe, str):
        return False
    if recipe[0] in ("calc", "count", "sum", "pairwith"):
        return True
    n = {"join": 2, "joinon": 2, "minus": 2, "union": len(recipe) - 1}.get(recipe[0], 1)
    return any(introduces(part) for part in recipe[1 : n + 1])


def replaced(recipe: Recipe, nth: int, name: str) -> Recipe:
    """The recipe with its nth source (from 0) renamed."""

    def walk(part, n):
        if isinstance(part, str):
            return (name if n == 0 else part), n - 1
        count = {"join": 2, "joinon": 2, "minus": 2, "union": len(part) - 1}.get(part[0], 1)
        out = [part[0]]
        for sub in part[1 : count + 1]:
            new, n = walk(sub, n)
            out.append(new)
        return [*out, *part[count + 1 :]], n

    return walk(recipe, nth)[0]
