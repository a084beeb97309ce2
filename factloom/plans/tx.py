"""Writes: resolve, derive, validate, commit or refuse, move machines. The store is immutable; a commit is a new one.

A write is validated only by the constraints that it can reach, and uniqueness, frequency and domain checks only at the
keys it touches. If any alethic constraint is broken, nothing changes and the answer names every violation; deontic ones
are reported and commit.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import ALETHIC, Constraint, Rule
from ..session import kept
from ..store import FactStore, same_rows
from ..types import kind
from .constraints import reads, violations
from .recipe import Relation, relation
from .rules import derive, reach

COMMITTED, WITH_VIOLATIONS, REFUSED = "committed", "committed_with_violations", "refused"


#: Violations that an answer lists; all of them are in its table.
LISTED = 1000


@dataclass(frozen=True)
class Answer:
    status: str
    store: FactStore
    #: the first (constraint, modality, binding) rows, alethic ones first
    violations: list[tuple] = field(default_factory=list)
    reason: str = ""
    #: all violations, if there are any
    table: DataFrame | None = None

    @property
    def alethic(self) -> list[tuple]:
        return [v for v in self.violations if v[1] == ALETHIC]

    @property
    def deontic(self) -> list[tuple]:
        return [v for v in self.violations if v[1] != ALETHIC]


def _some(rows: list[tuple] | DataFrame | None) -> bool:
    return rows is not None and (isinstance(rows, DataFrame) or bool(rows))


class Writer:
    """Applies writes to stores under rules and constraints."""

    def __init__(self, constraints: Iterable[Constraint] = (), rules: Iterable[Rule] = ()):
        self.constraints, self.rules = list(constraints), list(rules)

    def _shape(self, store: FactStore, name: str, rows: list[tuple] | DataFrame) -> str:
        """Why rows can't be facts of a type at all, or nothing."""
        full = {r.head for r in self.rules if not r.semi}
        if name in full:
            return f"{name} is derived and can't be asserted"
        declared = store.schema.fact_types.get(name)
        width = declared.arity if declared else store.relation(name).width if name in store else None
        if width is None:
            return f"{name} is no fact type"
        if isinstance(rows, DataFrame):
            return "" if len(rows.columns) == width else f"{name} takes {width} values, not {len(rows.columns)}"
        bad = next((r for r in rows if len(r) != width), None)
        return f"{name} takes {width} values, not {len(bad)}: {bad}" if bad else ""

    def _frame(self, store: FactStore, name: str, rows: list[tuple] | DataFrame) -> DataFrame:
        if isinstance(rows, DataFrame):
            return relation(rows).df
        if name in store:
            return store.spark.createDataFrame(rows, store.facts(name).schema)
        return relation(store.spark.createDataFrame(rows)).df

    def apply(self, store: FactStore, add: dict[str, list[tuple] | DataFrame] | None = None, remove: dict[str, list[tuple] | DataFrame] | None = None) -> Answer:
        """One transition: rows removed and added by fact type, validated once, atomically."""
        add, remove = add or {}, remove or {}
        for name, rows in [*remove.items(), *add.items()]:
            if why := self._shape(store, name, rows):
                return Answer(REFUSED, store, reason=why)
        changes: dict[str, Relation] = {}
        deltas: dict[str, DataFrame] = {}
        for name in {*add, *remove}:
            df = store.facts(name) if name in store else None
            if _some(remove.get(name)) and df is not None:
                df = df.subtract(self._frame(store, name, remove[name]))
            if _some(add.get(name)):
                rows = self._frame(store, name, add[name])
                if df is not None and [kind(a.dataType) for a in rows.schema] != [kind(b.dataType) for b in df.schema]:
                    return Answer(REFUSED, store, reason=f"{name}: values of another kind")
                deltas[name] = rows if df is None else rows.subtract(df)
                df = rows if df is None else df.union(rows)
            if df is not None:
                changes[name] = relation(df.distinct(), tuple(range(1, len(df.columns) + 1)))
        after = store.with_facts(**changes)
        changed = set(changes) | reach(self.rules, changes)
        view = derive(after, self.rules) if self.rules else after
        affected = [c for c in self.constraints if (r := reads(c)) is None or r & changed]
        if not affected:
            return Answer(COMMITTED, after)
        # a removal can break a constraint anywhere its keys don't show, so only pure additions are checked at their keys
        keys = deltas if not remove and not (changed - set(changes)) else None
        found = kept(violations(view, affected, keys))
        broken = found.where(F.col("modality") == ALETHIC)
        if not broken.isEmpty():
            # what was broken before the write and isn't made worse by it doesn't refuse it
            before = violations(derive(store, self.rules) if self.rules else store, affected)
            new = kept(broken.subtract(before))
            if not new.isEmpty():
                shown = found.where(F.col("modality") != ALETHIC).union(found.where(F.col("modality") == ALETHIC).join(new.select("constraint").distinct(), "constraint", "left_semi").select(*found.columns))
                return self._answer(REFUSED, store, shown, "alethic constraints are broken")
            found = found.where(F.col("modality") != ALETHIC)
        return self._answer(WITH_VIOLATIONS, after, found) if not found.isEmpty() else Answer(COMMITTED, after)

    @staticmethod
    def _answer(status: str, store: FactStore, table: DataFrame, reason: str = "") -> Answer:
        first = table.orderBy(F.col("modality") != ALETHIC, "constraint", "binding").limit(LISTED)
        return Answer(status, store, [tuple(r) for r in first.collect()], reason, table)

    def create(self, store: FactStore, **facts: list[tuple]) -> Answer:
        return self.apply(store, add=facts)

    def replace(self, store: FactStore, name: str, key: tuple, row: tuple) -> Answer:
        """The facts that begin with key give way to row."""
        held = reduce(lambda d, kv: d.where(F.col(f"c{kv[0]}") == kv[1]), enumerate(key, 1), store.facts(name))
        return self.apply(store, add={name: [row]}, remove={name: held})

    def retract(self, store: FactStore, name: str, row: tuple) -> Answer:
        """A fact goes, and with it what can't stand without it: facts whose mandatory role its filler played alone."""
        return self.retract_all(store, {name: self._frame(store, name, [row])})

    def retract_all(self, store: FactStore, rows: dict[str, DataFrame]) -> Answer:
        """Facts go with all that can't stand without them, level by level, as tables."""
        remove = {n: kept(df) for n, df in rows.items()}
        new = dict(remove)
        while new:
            more: dict[str, list[DataFrame]] = {}
            for n, df in new.items():
                f = store.schema.fact_types.get(n)
                if f is None or 1 not in f.mandatory:
                    continue
                rest = store.facts(n).subtract(remove[n]).select(F.col("c1").alias("_o"))
                owners = df.select(F.col("c1").alias("_o")).distinct().join(rest, "_o", "left_anti")
                for g in store.schema.fact_types.values():
                    if g.name in store:
                        more.setdefault(g.name, []).extend(store.facts(g.name).join(owners, F.col(f"c{k}") == F.col("_o"), "left_semi") for k, p in enumerate(g.players, 1) if p == f.players[0])
            new = {}
            for n, parts in more.items():
                if parts:
                    found = reduce(DataFrame.union, parts)
                    found = kept(found.subtract(remove[n]) if n in remove else found.distinct())
                    if not found.isEmpty():
                        new[n] = found
                        remove[n] = kept(remove[n].union(found)) if n in remove else found
        return self.apply(store, remove=remove)

    def delete(self, store: FactStore, noun: str, value) -> Answer:
        """All facts in which an entity plays a role go, and what can't stand without them."""
        rows: dict[str, DataFrame] = {}
        for g in store.schema.fact_types.values():
            at = [k for k, p in enumerate(g.players, 1) if p in store.schema.subtypes(noun)]
            if at and g.name in store:
                rows[g.name] = store.facts(g.name).where(reduce(lambda a, b: a | b, [F.col(f"c{k}") == value for k in at]))
        return self.retract_all(store, rows)

    def bulk(self, store: FactStore, writes: Iterable[dict[str, list[tuple]]]) -> Answer:
        """Several writes as one transition: one closure, one validation, all or nothing."""
        add: dict[str, list[tuple]] = {}
        for w in writes:
            for name, rows in w.items():
                add.setdefault(name, []).extend(rows)
        return self.apply(store, add=add)


class Snapshots:
    """Named captures of a store; stores are immutable, so a capture is a reference."""

    def __init__(self):
        self._held: dict[str, FactStore] = {}

    def snapshot(self, name: str, store: FactStore) -> None:
        self._held[name] = store

    def rollback(self, name: str) -> FactStore:
        return self._held[name]

    def names(self) -> list[str]:
        return sorted(self._held)

    def diff(self, a: str, b: str) -> dict[str, tuple[int, int]]:
        """Fact types that differ: (rows only in a, rows only in b)."""
        out = {}
        x, y = self._held[a], self._held[b]
        for n in sorted({*x.names(), *y.names()}):
            if n in x and n in y:
                if x._populations[n] is not y._populations[n] and not same_rows(x.facts(n), y.facts(n)):
                    out[n] = (x.facts(n).subtract(y.facts(n)).count(), y.facts(n).subtract(x.facts(n)).count())
            else:
                out[n] = (x.facts(n).count(), 0) if n in x else (0, y.facts(n).count())
        return out
