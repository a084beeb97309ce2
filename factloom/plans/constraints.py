"""Every constraint family as a query whose rows are the violations.

The builders take relations (DataFrames) and give the offending rows; `violations` turns a schema's constraints into rows
(constraint, modality, binding). Only alethic violations refuse a write.

Each builder first aggregates keys (with map-side partial sums) and then semi-joins the offending keys back, so a key that
holds a large share of the rows is never sorted or windowed in one task. Passing `keys` restricts a check to the keys a
write touched: the answer is that of the whole check at those keys.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import Constraint, Rule
from ..types import Domain, kind, same_kind
from .recipe import Compiler, sources
from .rules import strong_edges


def _on(left: Iterable[str], right: Iterable[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right, strict=True)])


def _renamed(df: DataFrame, prefix: str = "r_") -> DataFrame:
    return df.toDF(*[f"{prefix}{k}" for k in range(len(df.columns))])


def _semi(df: DataFrame, cols: list[str], other: DataFrame, how: str = "left_semi") -> DataFrame:
    moved = _renamed(other)
    return df.join(moved, _on(cols, moved.columns), how)


def at_keys(df: DataFrame, cols: list[str], keys: DataFrame | None) -> DataFrame:
    """df's rows at the keys a write touched; all rows if no keys are given."""
    return df if keys is None else _semi(df, cols, keys)


# uniqueness and frequency


def uniqueness(df: DataFrame, cols: list[str], keys: DataFrame | None = None) -> DataFrame:
    """All rows that share cols with another row. A uniqueness over all columns can't be broken: rows are a set."""
    df = at_keys(df, cols, keys)
    if set(cols) == set(df.columns):
        return df.limit(0)
    return _semi(df, cols, df.groupBy(*cols).agg(F.count("*").alias("_n")).where("_n > 1").select(*cols))


def external_uniqueness(parts: list[DataFrame], common: str, far: list[str], keys: DataFrame | None = None) -> DataFrame:
    """Parts joined on their common column; rows whose far columns are shared by several."""
    joined = reduce(lambda a, b: a.join(b, common), parts)
    return uniqueness(joined.distinct(), far, keys)


def frequency(df: DataFrame, cols: list[str], low: int | None, high: int | None, keys: DataFrame | None = None) -> DataFrame:
    """Rows of keys that occur fewer than low or more than high times; no bound is no limit."""
    df, count = at_keys(df, cols, keys), "_n"
    bad = F.lit(False)
    if low is not None:
        bad = bad | (F.col(count) < low)
    if high is not None:
        bad = bad | (F.col(count) > high)
    return _semi(df, cols, df.groupBy(*cols).agg(F.count("*").alias(count)).where(bad).select(*cols))


def cardinality(df: DataFrame, low: int | None, high: int | None) -> DataFrame:
    """n, the size of a population, if it is out of bounds."""
    bad, count = F.lit(False), "n"
    if low is not None:
        bad = bad | (F.col(count) < low)
    if high is not None:
        bad = bad | (F.col(count) > high)
    return df.agg(F.count("*").alias(count)).where(bad)


# mandatory and set comparison


def mandatory(instances: DataFrame, roles: list[DataFrame]) -> DataFrame:
    """Instances that play none of the roles (one role: simple mandatory; several: disjunctive)."""
    return reduce(lambda a, r: _semi(a, a.columns, r, "left_anti"), roles, instances)


def subset(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.subtract(right)


def provided(constraints: Iterable[Constraint], heads: Iterable[str]) -> list[Rule]:
    """Rules for heads that a subset or equality constraint provides: what has to hold of them is derived instead of asked
    for. A side that a head isn't alone, as a whole, can't be materialised."""
    rules, wanted = [], set(heads)
    for c in constraints:
        if c.kind in ("subset", "equality"):
            left, right = c.args[:2]
            if right in wanted if isinstance(right, str) else False:
                rules.append(Rule(right, (left,), "+"))
            if c.kind == "equality" and isinstance(left, str) and left in wanted:
                rules.append(Rule(left, (right,), "+"))
    return rules


def equality(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side only."""
    return left.subtract(right).union(right.subtract(left))


def exclusion(args: list[DataFrame]) -> DataFrame:
    """Rows in two arguments or more."""
    cols = args[0].columns
    tagged = reduce(DataFrame.union, [a.toDF(*cols).distinct() for a in args])
    return tagged.groupBy(*cols).agg(F.count("*").alias("_n")).where("_n > 1").select(*cols)


def exactly_one(instances: DataFrame, args: list[DataFrame]) -> DataFrame:
    """Instances in none or in several of the arguments."""
    return mandatory(instances, args).union(exclusion(args)).distinct()


# rings: binary relations over one object type


def _pair(df: DataFrame) -> tuple[str, str]:
    a, b = df.columns
    same_kind(df.schema[0].dataType, df.schema[1].dataType, "ring")
    return a, b


def irreflexive(df: DataFrame) -> DataFrame:
    a, b = _pair(df)
    return df.where(F.col(a) == F.col(b))


def _reverse(df: DataFrame) -> DataFrame:
    a, b = _pair(df)
    return df.select(F.col(b).alias(a), F.col(a).alias(b))


def asymmetric(df: DataFrame) -> DataFrame:
    return _semi(df, df.columns, _reverse(df))


def antisymmetric(df: DataFrame) -> DataFrame:
    a, b = _pair(df)
    return asymmetric(df).where(F.col(a) != F.col(b))


def symmetric(df: DataFrame) -> DataFrame:
    return _semi(df, df.columns, _reverse(df), "left_anti")


def _two_hops(df: DataFrame) -> DataFrame:
    a, b = _pair(df)
    one, two = df.toDF("h1", "h2"), df.toDF("h3", "h4")
    return one.join(two, F.col("h2") == F.col("h3")).select(F.col("h1").alias(a), F.col("h4").alias(b)).distinct()


def intransitive(df: DataFrame) -> DataFrame:
    """Pairs that are also two steps apart."""
    return _semi(df, df.columns, _two_hops(df))


def transitive(df: DataFrame) -> DataFrame:
    """The pairs that are missing: two steps apart without a direct one."""
    hops = _two_hops(df)
    return _semi(hops, hops.columns, df, "left_anti")


def reflexive(df: DataFrame) -> DataFrame:
    """(x, x) for each first x that lacks it."""
    a, b = _pair(df)
    firsts = df.select(F.col(a), F.col(a).alias(b)).distinct()
    return _semi(firsts, firsts.columns, df, "left_anti")


def acyclic(df: DataFrame) -> DataFrame:
    """The edges that lie on a cycle of any length: those inside a strongly connected component."""
    a, b = _pair(df)
    return strong_edges(df).toDF(a, b)


# values


_BROKEN = {"<": lambda x, y: x >= y, "<=": lambda x, y: x > y, ">": lambda x, y: x <= y, ">=": lambda x, y: x < y, "=": lambda x, y: x != y, "<>": lambda x, y: x == y}


def value_comparison(df: DataFrame, left: str, op: str, right: str) -> DataFrame:
    """Rows that break `left op right`."""
    same_kind(df.schema[left].dataType, df.schema[right].dataType, "value comparison")
    return df.where(_BROKEN[op](F.col(left), F.col(right)))


def value_domain(df: DataFrame, col: str, domain: Domain) -> DataFrame:
    return df.where(domain.outside(F.col(col)))


def forbidden(df: DataFrame) -> DataFrame:
    """A prohibition: every row is a violation."""
    return df


def co_occurrence(text: Column, keywords: list[str]) -> Column:
    """True where over half of the keywords occur in the text."""
    hits = reduce(lambda a, b: a + b, [F.contains(F.lower(text), F.lit(k.lower())).cast("int") for k in keywords])
    return hits * 2 > len(keywords)


RINGS = {"irreflexive": irreflexive, "asymmetric": asymmetric, "antisymmetric": antisymmetric, "symmetric": symmetric, "intransitive": intransitive, "transitive": transitive, "reflexive": reflexive, "acyclic": acyclic}
#: What a ring adjective implies; an implied one needs no check of its own.
IMPLIES = {"asymmetric": {"irreflexive", "antisymmetric"}, "intransitive": {"irreflexive"}, "acyclic": {"irreflexive", "asymmetric", "antisymmetric"}}


def needed_rings(adjectives: Iterable[str]) -> list[str]:
    """The adjectives that no other one implies."""
    all_of = list(dict.fromkeys(adjectives))
    return [a for a in all_of if not any(a in IMPLIES.get(b, ()) for b in all_of if b != a)]


# a schema's constraints

KINDS = ("uniqueness", "external", "frequency", "cardinality", "mandatory", "subset", "equality", "exclusion", "exactly_one", "ring", "comparison", "domain", "prohibition", "obligation")


def offending(store, c: Constraint, keys: dict[str, DataFrame] | None = None) -> DataFrame:
    """The offending rows of one constraint; keys: by fact type, the changed rows of a write, where a check can use them."""
    compiler = Compiler(store.relation)
    rows = compiler.rows
    kind_, args = c.kind, c.args
    if kind_ == "uniqueness":  # fact type, positions
        name, positions = args
        cols = [f"c{p}" for p in positions]
        touched = keys.get(name).select(*cols).distinct() if keys and name in keys else None
        return uniqueness(rows(name), cols, touched)
    if kind_ == "external":  # [recipes], far positions by recipe: each is (common, far)
        parts = [rows(r).toDF("x", f"f{k}") for k, r in enumerate(args[0])]
        return external_uniqueness(parts, "x", [f"f{k}" for k in range(len(parts))])
    if kind_ == "frequency":  # fact type, positions, low, high
        name, positions, low, high = args
        cols = [f"c{p}" for p in positions]
        touched = keys.get(name).select(*cols).distinct() if keys and name in keys else None
        return frequency(rows(name), cols, low, high, touched)
    if kind_ == "cardinality":
        return cardinality(rows(args[0]), args[1], args[2])
    if kind_ == "mandatory":  # noun or recipe of instances, [recipes of roles]
        return mandatory(_instances(store, args[0]), [rows(r).select(F.col("c1").cast("string")) for r in args[1]])
    if kind_ == "subset":
        return subset(rows(args[0]), rows(args[1]))
    if kind_ == "equality":
        return equality(rows(args[0]), rows(args[1]))
    if kind_ == "exclusion":
        return exclusion([rows(r) for r in args[0]])
    if kind_ == "exactly_one":
        return exactly_one(_instances(store, args[0]), [rows(r).select(F.col("c1").cast("string")) for r in args[1]])
    if kind_ == "ring":
        return RINGS[args[1]](rows(args[0]))
    if kind_ == "comparison":  # recipe, left position, operator, right position
        return value_comparison(rows(args[0]), f"c{args[1]}", args[2], f"c{args[3]}")
    if kind_ == "domain":  # fact type, position, Domain
        name, position, domain = args
        df = keys[name] if keys and name in keys else rows(name)  # what is held already isn't asked again
        return value_domain(df, f"c{position}", domain)
    if kind_ in ("prohibition", "obligation"):  # a recipe whose rows are what is wrong
        return forbidden(rows(args[0]))
    raise ValueError(f"unknown constraint kind {kind_!r}")


def _instances(store, what) -> DataFrame:
    if isinstance(what, str) and what not in store:
        return store.instances(what)
    return Compiler(store.relation).rows(what).select(F.col("c1").cast("string").alias("c1")).distinct()


def reads(c: Constraint) -> set[str] | None:
    """Fact types a constraint reads; None if it reads instances of a noun, which any fact type may hold."""
    a = c.args
    if c.kind in ("uniqueness", "frequency", "domain", "cardinality", "ring", "comparison", "prohibition", "obligation"):
        return set(sources(a[0]))
    if c.kind in ("external", "exclusion"):
        return {s for r in a[0] for s in sources(r)}
    if c.kind in ("subset", "equality"):
        return {*sources(a[0]), *sources(a[1])}
    return None


def violations(store, constraints: Iterable[Constraint], keys: dict[str, DataFrame] | None = None) -> DataFrame:
    """(constraint, modality, binding) of all violations; binding is the offending row's values as text."""
    parts = []
    for c in constraints:
        df = offending(store, c, keys)
        parts.append(df.select(F.lit(c.id).alias("constraint"), F.lit(c.modality).alias("modality"), F.array(*[F.col(x).cast("string") for x in df.columns]).alias("binding")))
    if not parts:
        return store.spark.createDataFrame([], "constraint string, modality string, binding array<string>")
    return reduce(DataFrame.union, parts)


def message(template: str, binding: Column) -> Column:
    """A violation's text: {value}, {x}, {y}, {z} stand for the binding's values, {0}, {1}, ... for those by place."""
    out = F.lit(template)
    for name, place in (("value", 0), ("x", 0), ("y", 1), ("z", 2), *((str(k), k) for k in range(6))):
        if f"{{{name}}}" in template:
            out = F.replace(out, F.lit(f"{{{name}}}"), F.coalesce(F.get(binding, place), F.lit("")))
    return out


def consistent_with_negation(facts: DataFrame, negations: DataFrame) -> DataFrame:
    """Rows held together with their explicit negation."""
    return facts.intersect(negations)


def truth(candidates: DataFrame, facts: DataFrame, negations: DataFrame | None, open_world: bool) -> DataFrame:
    """Candidates with truth T, F or (open world, neither held) null; a closed world takes what isn't held as F."""
    cols = candidates.columns
    held = facts.toDF(*[f"h_{c}" for c in cols]).withColumn("_held", F.lit(True))
    out = candidates.join(held, _on(cols, [f"h_{c}" for c in cols]), "left")
    denied = F.lit(None).cast("boolean")
    if negations is not None:
        out = out.join(negations.toDF(*[f"n_{c}" for c in cols]).withColumn("_denied", F.lit(True)), _on(cols, [f"n_{c}" for c in cols]), "left")
        denied = F.col("_denied")
    value = F.when(F.col("_held"), F.lit("T")).when(denied, F.lit("F"))
    return out.select(*cols, (value if open_world else F.coalesce(value, F.lit("F"))).alias("truth"))


def join_path(fact_types: list[tuple[str, tuple[str, ...]]]) -> list[int] | None:
    """An order of (name, variables) in which each shares a variable with one before it; None if there is none."""
    order, seen = [0], set(fact_types[0][1])
    while len(order) < len(fact_types):
        nxt = next((k for k, (_, v) in enumerate(fact_types) if k not in order and seen & set(v)), None)
        if nxt is None:
            return None
        order.append(nxt)
        seen |= set(fact_types[nxt][1])
    return order


def joined_path(store, fact_types: list[tuple[str, tuple[str, ...]]], want: tuple[str, ...], within: DataFrame | None = None) -> DataFrame | None:
    """Fact types joined on shared variables, projected to the wanted ones; None (unbuilt) if they don't connect.

    within: rows of the wanted variables to keep to, such as the other side of a subset. They are joined first, so that
    ends that many middles connect don't make all their pairs.
    """
    order = join_path(fact_types)
    if order is None:
        return None
    out = None if within is None else within.select(*want).distinct()
    if out is not None:
        order = join_path([("", want), *fact_types])
        if order is None:
            return None
        order = [k - 1 for k in order[1:]]
    for k in order:
        name, variables = fact_types[k]
        df = store.facts(name).toDF(*variables)
        out = df if out is None else out.join(df, [v for v in variables if v in out.columns])
    return out.select(*want).distinct()


def mixed_kinds(df: DataFrame) -> list[str]:
    """Kinds of a relation's columns, for admission checks."""
    return [kind(f.dataType) for f in df.schema]
