"""Mapping fact types to tables and back, schema induction from populations, and the reading verbs."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import FactType, Schema
from ..types import CONCEPTUAL


def functional(schema: Schema, noun: str) -> list[FactType]:
    """Fact types that are columns of noun's table: binaries unique on noun's role 1."""
    return [f for f in schema.fact_types.values() if f.arity == 2 and f.players[0] == noun and (1,) in f.unique]


SUBTYPES = ("separate", "absorb", "partition")


def home(schema: Schema, noun: str) -> str:
    """The top supertype of a noun; of several, the first declared."""
    tops = [n for n in schema.supertypes(noun) if not (schema.object_types[n].supertypes if n in schema.object_types else ())]
    return next((n for n in schema.object_types if n in tops), noun)


def one_to_one(schema: Schema) -> dict[str, str]:
    """Binaries unique in both roles between two entity types: the noun whose table holds each. A mandatory role leaves no
    nulls; without one, or with both, the first player has it."""
    out = {}
    for f in schema.fact_types.values():
        if f.arity == 2 and (1,) in f.unique and (2,) in f.unique:
            out[f.name] = f.players[1] if 2 in f.mandatory and 1 not in f.mandatory else f.players[0]
    return out


def layout(schema: Schema, subtypes: str = "separate") -> dict[str, tuple[str, ...]]:
    """Tables by name: an entity's table with its functional facts, own tables for facts whose uniqueness is compound.

    subtypes: "separate" gives each subtype with facts of its own a table; "absorb" puts them into the top supertype's, with
    the subtype itself as a flag; "partition" gives each lowest subtype a table with the columns of all above it.
    """
    if subtypes not in SUBTYPES:
        raise ValueError(f"subtypes is one of {', '.join(SUBTYPES)}")
    out: dict[str, tuple[str, ...]] = {}
    single = one_to_one(schema)
    own: dict[str, list[str]] = {}
    nouns = dict.fromkeys([*(p for f in schema.fact_types.values() for p in f.players), *schema.object_types])
    for noun in nouns:
        columns = [f.name for f in functional(schema, noun) if single.get(f.name, noun) == noun]
        columns += [name for name, holder in single.items() if holder == noun and name not in columns]
        own[noun] = columns + [f.name for f in schema.fact_types.values() if f.players == (noun,)]
    for noun, columns in own.items():
        below = [n for n in schema.object_types if n != noun and noun in schema.supertypes(n)]
        if subtypes == "absorb":
            top = home(schema, noun)
            if columns or top != noun and any(own[n] for n in own if home(schema, n) == top):
                held = out.get(top, (top,))
                out[top] = (*held, *([noun] if top != noun else []), *columns)
        elif subtypes == "partition":
            above = [c for n in own if n != noun and n in schema.supertypes(noun) for c in own[n]]
            if not below and (columns or above):
                out[noun] = (noun, *above, *columns)
        elif columns:
            out[noun] = (noun, *columns)
    for f in schema.fact_types.values():
        if f.arity > 1 and (1,) not in f.unique and f.name not in single:
            out[f.name] = f.players
    return out


def wide_table(store, noun: str) -> DataFrame:
    """noun's table: its instances with a column per functional fact type and a flag per unary one; null is no fact."""
    columns = functional(store.schema, noun)
    flags = [f for f in store.schema.fact_types.values() if f.players == (noun,)]
    held = [f for f in (*columns, *flags) if f.name in store]
    # one pass by key instead of a join per column: facts are tagged, and meet in one aggregation
    fixed = {f.name: store.facts(f.name).schema[1].dataType if f.arity == 2 else None for f in held}
    parts = []
    for f in held:
        df = store.facts(f.name)
        values = [(F.col("c2") if f.arity == 2 else F.lit(True)) if g is f else F.lit(None).cast(fixed[g.name] if g.arity == 2 else "boolean") for g in held]
        parts.append(df.select(F.col("c1").alias(noun), *[v.alias(g.name) for v, g in zip(values, held, strict=True)]))
    return reduce(DataFrame.union, parts).groupBy(noun).agg(*[F.max(g.name).alias(g.name) for g in held])


def facts_of(wide: DataFrame, key: str, column: str) -> DataFrame:
    """The fact type back from a table's column: rows where it isn't null."""
    return wide.where(F.col(column).isNotNull()).select(F.col(key).alias("c1"), F.col(column).alias("c2"))


def ddl(schema: Schema, dialect: str = "spark") -> list[str]:
    """CREATE TABLE statements; dialects differ in the text type and in quoting. Outside Spark, which has none that it
    enforces, uniquenesses, references to other tables and lists of values become constraints."""
    text = {"spark": "STRING", "sqlite": "TEXT", "postgres": "TEXT", "mysql": "VARCHAR(255)", "sqlserver": "NVARCHAR(MAX)", "oracle": "VARCHAR2(4000)", "duckdb": "VARCHAR"}[dialect]
    quote = {"mysql": "``", "spark": "``", "sqlserver": "[]"}.get(dialect, '""')

    def q(name: str) -> str:
        return f"{quote[0]}{name}{quote[1]}"

    def sql_type(noun: str) -> str:
        o = schema.object_types.get(noun)
        if o is None or o.domain is None or CONCEPTUAL[o.domain.conceptual][0].startswith("CHARACTER"):
            return text
        return CONCEPTUAL[o.domain.conceptual][0]

    tables = layout(schema)

    def references(column: str, noun: str) -> list[str]:
        return [f"FOREIGN KEY ({q(column)}) REFERENCES {q(noun)} ({q(noun)})"] if noun in tables else []

    def checks(column: str, noun: str) -> list[str]:
        o = schema.object_types.get(noun)
        if o is None or o.domain is None or not o.domain.values:
            return []
        return [f"CHECK ({q(column)} IN ({', '.join(repr(v) if not isinstance(v, str) else chr(39) + v.replace(chr(39), chr(39) * 2) + chr(39) for v in o.domain.values)}))"]

    out = []
    for name, columns in tables.items():
        more: list[str] = []
        if name in schema.fact_types:
            f = schema.fact_types[name]
            own = [f"{p}_{k}" if f.players.count(p) > 1 else p for k, p in enumerate(f.players, 1)]
            more += [f"UNIQUE ({', '.join(q(own[k - 1]) for k in u)})" for u in f.unique]
            for column, p in zip(own, f.players, strict=True):
                more += references(column, p) + checks(column, p)
            body = [f"{q(f'{p}_{k}' if f.players.count(p) > 1 else p)} {sql_type(p)} NOT NULL" for k, p in enumerate(f.players, 1)]
        else:
            body = [f"{q(name)} {sql_type(name)} NOT NULL"]
            for c in columns[1:]:
                f = schema.fact_types[c]
                # a one-to-one fact may stand in the table of its second player
                k = 1 if f.players[0] == name else 2
                other = f.players[2 - k] if f.arity == 2 else name
                body.append(f"{q(c)} {sql_type(other) if f.arity == 2 else 'BOOLEAN'}{' NOT NULL' if k in f.mandatory and f.arity == 2 else ''}")
                if f.arity == 2:
                    more += ([f"UNIQUE ({q(c)})"] if (3 - k,) in f.unique else []) + (references(c, other) if other != name else []) + checks(c, other)
            if dialect != "spark":
                body.append(f"PRIMARY KEY ({q(name)})")
        if dialect != "spark":
            body += more
        out.append(f"CREATE TABLE {q(name)} ({', '.join(body)})")
    return out


def json_schema(df: DataFrame) -> dict:
    """The JSON schema of a relation's rows."""
    kinds = {"string": "string", "boolean": "boolean", "double": "number", "float": "number"}

    def kind(t) -> dict:
        name = t.simpleString()
        return {"type": kinds.get(name, "integer" if name in ("int", "bigint", "smallint", "tinyint") else "number" if name.startswith("decimal") else "string")}

    return {"type": "object", "properties": {f.name: kind(f.dataType) for f in df.schema}, "required": [f.name for f in df.schema if not f.nullable]}


# induction from populations


def induced_uniqueness(df: DataFrame, most: int = 2) -> DataFrame:
    """For each set of up to `most` columns: whether no two rows share it. Each set is its own aggregation, with partial
    counts before the shuffle; one for all would write every row once for every set."""
    cols = sorted(df.columns)
    groups = [c for n in range(1, most + 1) for c in combinations(cols, n)]
    parts = [df.groupBy(*c).agg(F.count("*").alias("_n")).agg((F.coalesce(F.max("_n"), F.lit(0)) < 2).alias("holds")).select(F.lit(",".join(c)).alias("columns"), "holds") for c in groups]
    return reduce(DataFrame.union, parts)


def induced_mandatory(store, instances: DataFrame, fact_types: list[str]) -> DataFrame:
    """For each fact type: whether every instance plays its first role."""
    parts = []
    for name in fact_types:
        missing = instances.join(store.facts(name).select(F.col("c1").alias("_k")), F.col(instances.columns[0]) == F.col("_k"), "left_anti")
        parts.append(missing.agg((F.count("*") == 0).alias("mandatory")).select(F.lit(name).alias("fact_type"), "mandatory"))
    return reduce(DataFrame.union, parts)


def inclusions(populations: dict[str, DataFrame]) -> DataFrame:
    """For each ordered pair of populations: whether one includes the other (subtype candidates)."""
    parts = []
    for a, left in populations.items():
        for b, right in populations.items():
            if a != b:
                missing = left.join(right.toDF("_k"), F.col(left.columns[0]) == F.col("_k"), "left_anti")
                parts.append(missing.agg((F.count("*") == 0).alias("included")).select(F.lit(a).alias("sub"), F.lit(b).alias("super"), "included"))
    return reduce(DataFrame.union, parts)


# verbs


def navigation(f: FactType, position: int) -> str:
    """From a player at a position: peer if a uniqueness spans the roles, child if one holds its role, else collection."""
    if any(len(u) == f.arity and f.arity > 1 for u in f.unique) and (position,) not in f.unique:
        return "peer"
    return "child" if (position,) in f.unique else "collection"


def search(df: DataFrame, key: str, columns: list[str], text: str, limit: int = 50) -> DataFrame:
    """Rows one of whose columns contains text, whatever its case; the first `limit` by key."""
    hit = reduce(lambda a, b: a | b, [F.contains(F.lower(c), F.lit(text.lower())) for c in columns])
    return df.where(hit).orderBy(key).limit(limit)


def entity(store, noun: str, value, fact_types: list[str]) -> DataFrame:
    """(fact_type, a, b): all binary facts in which an entity plays a role."""
    parts = []
    for name in fact_types:
        f = store.schema.fact_types[name]
        position = f.players.index(noun) + 1
        parts.append(store.facts(name).where(F.col(f"c{position}") == value).select(F.lit(name).alias("fact_type"), F.col("c1").cast("string").alias("a"), F.col("c2").cast("string").alias("b")))
    return reduce(DataFrame.union, parts)


def first_rows(df: DataFrame, by: str, order: list[str], n: int = 25) -> DataFrame:
    """The first n rows of each group with the group's size: what a link shows."""
    counts = df.groupBy(by).agg(F.count("*").alias("total"))
    from pyspark.sql import Window

    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")
    return ranked.join(counts, by)
