"""One object for a model and its population: the verbs.

    e = Engine.compile(spark, readings)
    e.create(PersonHasName=[("p1", "Ann")])
    e.query(["proj", "PersonHasName", [2]]).show()
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.readings import Parser, verbalize
from .functions.registry import Registry
from .plans import constraints as con
from .plans import induce, rmap
from .plans import machine as mach
from .plans.recipe import Recipe, Relation, relation
from .plans.rules import derive, explain, refused
from .plans.tx import REFUSED, Answer, Snapshots, Writer
from .schema import Machine
from .session import kept
from .store import FactStore


class Engine:
    def __init__(self, store: FactStore, machines: Iterable[Machine] = ()):
        self.store, self.schema, self.machines = store, store.schema, {m.noun: m for m in machines}
        self.registry, self._snapshots = Registry(), Snapshots()
        self._writer = Writer(self.schema.constraints, self.schema.rules)
        self._view: FactStore | None = None
        #: (entity, trigger, write) tables of the events that moved or could have moved a machine, by write
        self._events: list[DataFrame] = []

    @classmethod
    def compile(cls, spark: SparkSession, text: str, machines: Iterable[Machine] = ()) -> Engine:
        """A model from sentences; its stated facts are its population. Sentences that aren't understood are an error."""
        p = Parser().read(text)
        if p.unknown:
            raise ValueError("not understood: " + " | ".join(p.unknown))
        heads = {r.head for r in p.rules}
        populations = {n: _rows(spark, p.facts.get(n, []), f.arity) for n, f in p.fact_types.items() if n not in heads}
        return cls(FactStore(spark, populations, p.schema()), machines)

    # reading

    @property
    def view(self) -> FactStore:
        """The population with all derived facts, planned once per state."""
        if self._view is None:
            self._view = derive(self.store, self.schema.rules) if self.schema.rules else self.store
        return self._view

    def query(self, recipe: Recipe) -> DataFrame:
        return self.view.ordered(recipe)

    def ask(self, tests: Iterable[tuple[int, object]]) -> list[tuple[str, DataFrame]]:
        return self.view.ask(tests)

    def get(self, noun: str, value) -> DataFrame:
        """(fact_type, a, b): the binary facts of an entity."""
        names = [f.name for f in self.schema.fact_types.values() if f.arity == 2 and noun in f.players and f.name in self.view]
        return rmap.entity(self.view, noun, value, names)

    def links(self, noun: str, value, n: int = 25) -> DataFrame:
        """(fact_type, a, b, total): an entity's links, of each fact type the first n with how many there are."""
        return rmap.first_rows(self.get(noun, value), "fact_type", ["a", "b"], n).select("fact_type", "a", "b", "total")

    def cells(self) -> list[tuple]:
        """The schema as descriptors: name, players, uniqueness, mandatory roles, rows held."""
        return [(f.name, f.players, f.unique, f.mandatory, self.view.facts(f.name).count() if f.name in self.view else None) for f in self.schema.fact_types.values()]

    def derive(self, *heads: str) -> FactStore:
        return derive(self.store, self.schema.rules, only=heads or None)

    def refused_rules(self) -> dict[str, str]:
        return refused(self.schema.rules)

    def validate(self) -> DataFrame:
        """All violations at rest."""
        return con.violations(self.view, self.schema.constraints)

    def verify(self) -> bool:
        """Whether every alethic constraint holds."""
        return self.validate().where("modality = 'alethic'").isEmpty()

    def explain(self, head: str, row: tuple) -> DataFrame:
        return explain(self.store, self.schema.rules, head, row)

    def search(self, text: str, limit: int = 50) -> DataFrame:
        """(fact_type, a, b) of binary facts a value of which contains text; the first `limit`."""
        parts = [self.view.facts(f.name).select(F.lit(f.name).alias("fact_type"), F.col("c1").cast("string").alias("a"), F.col("c2").cast("string").alias("b")) for f in self.schema.fact_types.values() if f.arity == 2 and f.name in self.view]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.union(p)
        return rows.where(F.contains(F.lower("a"), F.lit(text.lower())) | F.contains(F.lower("b"), F.lit(text.lower()))).orderBy("fact_type", "a", "b").limit(limit)

    def fetch(self, address: str) -> DataFrame:
        """The entity at noun:value."""
        noun, _, value = address.partition(":")
        return self.get(noun, value)

    def verbalize(self) -> list[str]:
        return [verbalize(c, self.schema.fact_types) for c in self.schema.constraints]

    def synthesize(self, noun: str, value) -> list[str]:
        """An entity as sentences."""
        out = []
        for r in self.get(noun, value).collect():
            f = self.schema.fact_types[r.fact_type]
            a, b = f.players
            middle = f.reading[len(a) : len(f.reading) - len(b)].strip() if f.reading.startswith(a) else r.fact_type
            out.append(f"{a} '{r.a}' {middle} {b} '{r.b}'.")
        return sorted(out)

    # schema

    def rmap(self) -> dict[str, tuple[str, ...]]:
        return rmap.layout(self.schema)

    def table(self, noun: str) -> DataFrame:
        return rmap.wide_table(self.view, noun)

    def nav(self, noun: str) -> list[tuple[str, str]]:
        """(fact type, kind) of the links from a noun: child, collection or peer."""
        return [(f.name, rmap.navigation(f, k)) for f in self.schema.fact_types.values() if f.arity > 1 for k, p in enumerate(f.players, 1) if p == noun]

    def csdp(self) -> dict[str, list]:
        """What the design procedure can compute from the population: uniquenesses and mandatory roles that hold but
        aren't declared, fact types that should be split, subtype candidates."""
        unique, split = [], []
        for f in self.schema.fact_types.values():
            if f.name not in self.view or f.arity < 2:
                continue
            df = self.view.facts(f.name)
            if df.isEmpty():
                continue
            for r in rmap.induced_uniqueness(df, f.arity - 1).collect():
                positions = tuple(int(c[1:]) for c in r.columns.split(","))
                if r.holds and not any(set(u) <= set(positions) for u in f.unique):
                    unique.append((f.name, positions))
            if any(len(u) < f.arity - 1 for u in f.unique):
                split.append(f.name)
        nouns = [n for n, o in self.schema.object_types.items() if o.entity]
        populations = {n: kept(self.view.instances(n)) for n in nouns}
        filled = {n: d for n, d in populations.items() if not d.isEmpty()}
        included = [(r.sub, r.super) for r in rmap.inclusions(filled).where("included").collect()] if len(filled) > 1 else []
        mandatory = []
        for n, d in filled.items():
            own = [f.name for f in rmap.functional(self.schema, n) if f.name in self.view and 1 not in f.mandatory]
            for name in own:
                missing = d.join(self.view.facts(name).select(F.col("c1").cast("string").alias("_k")), F.col("c1") == F.col("_k"), "left_anti")
                if missing.isEmpty():
                    mandatory.append((name, 1))
        return {"uniqueness": unique, "mandatory": mandatory, "split": split, "subtypes": included}

    def ddl(self, dialect: str = "spark") -> list[str]:
        return rmap.ddl(self.schema, dialect)

    # writing

    def _done(self, answer: Answer) -> Answer:
        if answer.status != REFUSED:
            self.store, self._view = answer.store, None
        return answer

    def create(self, **facts: list[tuple]) -> Answer:
        before = self.view if self.machines else None
        answer = self._done(self._writer.create(self.store, **facts))
        if answer.status != REFUSED and before is not None:
            self._record(before, facts)
        return answer

    assert_ = create

    def bulk(self, writes: Iterable[dict[str, list[tuple]]]) -> Answer:
        return self._done(self._writer.bulk(self.store, writes))

    def replace(self, name: str, key: tuple, row: tuple) -> Answer:
        return self._done(self._writer.replace(self.store, name, key, row))

    def retract(self, name: str, row: tuple) -> Answer:
        return self._done(self._writer.retract(self.store, name, row))

    def update(self, name: str, row: tuple) -> Answer:
        """The fact of a functional fact type with the same first player gives way to row."""
        return self.replace(name, row[:1], row)

    def delete(self, noun: str, value) -> Answer:
        """An entity goes with all its facts."""
        return self._done(self._writer.delete(self.store, noun, value))

    def transition(self, noun: str, value, trigger: str, *others) -> Answer:
        """The event that moves an entity: a fact of the trigger, refused if the entity's status has no such link."""
        if self.actions(noun).where((F.col("entity") == str(value)) & (F.col("trigger") == trigger)).isEmpty():
            m = self.machines[noun]
            start, known = mach.leaf(m, m.start()), not self.status(noun).where(F.col("entity") == str(value)).isEmpty()
            if known or all(t.source != start or t.trigger != trigger for t in mach.effective(m)):
                return Answer(REFUSED, self.store, reason=f"{value} has no transition for {trigger}")
        return self.create(**{trigger: [(value, *others)]})

    def snapshot(self, name: str) -> None:
        self._snapshots.snapshot(name, self.store)

    def rollback(self, name: str) -> None:
        self.store, self._view = self._snapshots.rollback(name), None

    def snapshots(self) -> list[str]:
        return self._snapshots.names()

    def migrate(self, recipes: dict[str, Recipe]) -> Answer:
        """Target fact types receive the rows of their recipes, as one transition."""
        return self._done(self._writer.apply(self.store, add={n: self.view.query(q) for n, q in recipes.items()}))

    # machines

    def _record(self, before: FactStore, facts: dict[str, list[tuple]]) -> None:
        """New rows of trigger fact types, stated or newly derived, as events of the entities that play their roles."""
        triggers = {t.trigger for m in self.machines.values() for t in mach.effective(m)}
        found = []
        for name in sorted(triggers):
            if name not in self.view:
                continue
            new = self.view.facts(name)
            if name in before:
                new = new.subtract(before.facts(name))
            elif name in facts:
                new = new.limit(0).union(_rows(self.store.spark, facts[name], len(new.columns)).df)
            # a write's events of an entity are in the order of their triggers, then of the other players
            found.append(new.select(F.col("c1").cast("string").alias("entity"), F.lit(name).alias("trigger"), F.lit(len(self._events)).alias("write"), F.concat_ws("\x1f", *[F.col(c).cast("string") for c in new.columns]).alias("row")))
        if found:
            rows = found[0]
            for df in found[1:]:
                rows = rows.union(df)
            self._events.append(kept(rows))

    @property
    def events(self) -> DataFrame:
        """entity, trigger, write and row of all events that moved or could have moved a machine."""
        rows = self.store.spark.createDataFrame([], "entity string, trigger string, write int, row string")
        for df in self._events:
            rows = rows.union(df)
        return rows

    def status(self, noun: str) -> DataFrame:
        """entity and status of noun's machine, by all events so far (a replay: nothing is written)."""
        return mach.fold(self.events, self.machines[noun], entity="entity", event="trigger", order=["write", "trigger", "row"])

    def actions(self, noun: str) -> DataFrame:
        return mach.available(self.status(noun), self.machines[noun])

    def orient(self, noun: str) -> DataFrame:
        """Instances of noun with their status, without those in a terminal one."""
        m = self.machines[noun]
        start = mach.leaf(m, m.start())
        status = self.status(noun)
        rows = self.view.instances(noun).join(status, F.col("c1") == F.col("entity"), "left").select(F.col("c1").alias("entity"), F.coalesce("status", F.lit(start)).alias("status"))
        done = mach.terminal(m)
        return rows.where(~F.col("status").isin(*done)) if done else rows

    # induction

    def induce(self, domains: dict[str, DataFrame], refuse: list[DataFrame], score) -> DataFrame:
        return induce.candidates(domains, refuse=refuse, score=score)


def _rows(spark: SparkSession, rows: list[tuple], width: int) -> Relation:
    return relation(spark.createDataFrame(rows, ", ".join(f"c{k} string" for k in range(1, width + 1))).distinct(), tuple(range(1, width + 1)))
