"""The population: fact types by name, each a lazily built set of rows, with snapshots and instance scans."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.recipe import Compiler, Recipe, Relation, relation
from .schema import FactType, Schema


class FactStore:
    """An immutable mapping of fact type names to relations; changed copies share what they don't change.

    populations: name -> Relation, or a function that builds it when it is first asked for.
    """

    def __init__(self, spark: SparkSession, populations: dict[str, Relation | Callable[[], Relation]], schema: Schema | None = None):
        self.spark, self.schema = spark, schema or Schema()
        self._populations = dict(populations)

    def __contains__(self, name: str) -> bool:
        return name in self._populations

    def names(self) -> list[str]:
        return list(self._populations)

    def relation(self, name: str) -> Relation:
        """All rows of a fact type; a name the store has no population for is a KeyError."""
        found = self._populations[name]
        if callable(found):
            found = self._populations[name] = found()
        return found

    def facts(self, name: str) -> DataFrame:
        return self.relation(name).as_set().df

    def query(self, recipe: Recipe) -> DataFrame:
        """A recipe's rows as one plan."""
        return Compiler(self.relation).rows(recipe)

    def ordered(self, recipe: Recipe) -> DataFrame:
        """A recipe's rows in the order of their JSON, for presentation."""
        df = self.query(recipe)
        return df.orderBy(F.to_json(F.struct(*df.columns)))

    def with_facts(self, **changes: Relation | DataFrame) -> FactStore:
        new = {k: v if isinstance(v, Relation) else relation(v) for k, v in changes.items()}
        return FactStore(self.spark, self._populations | new, self.schema)

    def ask(self, tests: Iterable[tuple[int, object]]) -> list[tuple[str, DataFrame]]:
        """Populations that pass all tests: (1, name) a name, (2, rows) a set of rows that the population equals."""
        found = []
        for name in self.names():
            if all((name == v) if i == 1 else same_rows(self.facts(name), v) for i, v in tests):
                found.append((name, self.facts(name)))
        return found

    def instances(self, noun: str) -> DataFrame:
        """c1: every filler of a role played by noun or a subtype, over all populations whose fact types are declared."""
        nouns = self.schema.subtypes(noun)
        parts = [self.facts(f.name).select(F.col(f"c{k}").cast("string").alias("c1")) for f in self.schema.fact_types.values() if f.name in self for k, p in enumerate(f.players, 1) if p in nouns]
        if not parts:
            return self.spark.createDataFrame([], "c1 string")
        return reduce(DataFrame.union, parts).where("c1 is not null").distinct()

    def has(self, name: str, *row) -> bool:
        df = self.facts(name)
        return not reduce(lambda d, kv: d.where(F.col(f"c{kv[0]}") == kv[1]), enumerate(row, 1), df).isEmpty()

    def objectified(self, fact_type: FactType) -> DataFrame:
        """An objectified fact type: its identifier (fillers joined by dots) and the fillers."""
        df = self.facts(fact_type.name)
        return df.select(F.concat_ws(".", *[F.col(c).cast("string") for c in df.columns]).alias("id"), *df.columns)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return a.subtract(b).isEmpty() and b.subtract(a).isEmpty()


def from_table(df: DataFrame, key: str | tuple[str, ...], column: str | None = None) -> Relation:
    """The fact type that a table's column holds: key and column, where neither is null; with no column, the key alone.

    A key of several columns is joined by dots, in order; a row that lacks a part is no fact.
    """
    parts = (key,) if isinstance(key, str) else key
    present = reduce(lambda a, b: a & b, [F.col(p).isNotNull() for p in parts])
    own = F.col(parts[0]) if len(parts) == 1 else F.concat_ws(".", *[F.col(p).cast("string") for p in parts])
    rows = df.where(present if column is None else present & F.col(column).isNotNull())
    return relation(rows.select(own.alias("k"), *([F.col(column).alias("v")] if column else [])), (1,))


def flag(df: DataFrame, key: str, column: str) -> Relation:
    """A unary fact type absorbed as a flag: the keys whose flag is true."""
    return relation(df.where(F.col(column)).select(key), (1,))


def reference_facts(df: DataFrame, key: str) -> Relation:
    """A reference mode without a table: every instance refers to itself."""
    return relation(df.where(F.col(key).isNotNull()).select(F.col(key).alias("a"), F.col(key).alias("b")), (1,), (2,))
