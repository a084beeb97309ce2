"""What a model declares: object types, fact types, constraints, rules and machines."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from .types import Domain

ALETHIC, DEONTIC = "alethic", "deontic"


@dataclass(frozen=True)
class ObjectType:
    """An entity type (with a reference mode) or a value type (with a domain)."""

    name: str
    entity: bool = True
    reference: str | None = None
    domain: Domain | None = None
    supertypes: tuple[str, ...] = ()
    open_world: bool = False


@dataclass(frozen=True)
class FactType:
    """A predicate over roles; players are object type names. unique: role position sets (from 1) with one fact each."""

    name: str
    players: tuple[str, ...]
    reading: str = ""
    unique: tuple[tuple[int, ...], ...] = ()
    mandatory: tuple[int, ...] = ()
    objectified_as: str | None = None

    @property
    def arity(self) -> int:
        return len(self.players)


@dataclass(frozen=True)
class Constraint:
    """kind: one of plans.constraints.KINDS; args: what that kind takes."""

    id: str
    kind: str
    args: tuple[Any, ...]
    modality: str = ALETHIC
    message: str | None = None


#: Derivation markings: completeness (full, semi) and storage (lazy, stored) are independent.
MARKINGS = {"*": ("full", "lazy"), "**": ("full", "stored"), "+": ("semi", "lazy"), "++": ("semi", "stored")}


@dataclass(frozen=True)
class Rule:
    """head is derived by the union of the arms; a semi-derived head also holds what is asserted."""

    head: str
    arms: tuple[Any, ...]
    marking: str = "*"

    @property
    def semi(self) -> bool:
        return MARKINGS[self.marking][0] == "semi"

    @property
    def stored(self) -> bool:
        return MARKINGS[self.marking][1] == "stored"


@dataclass(frozen=True)
class Transition:
    name: str
    source: str
    target: str
    trigger: str
    #: A fact type that must hold of the event's entity.
    guard: str | None = None


@dataclass(frozen=True)
class Machine:
    """States of one object type; subs maps a composite status to its machine."""

    name: str
    noun: str
    transitions: tuple[Transition, ...]
    initial: str | None = None
    statuses: tuple[str, ...] = ()
    subs: dict[str, Machine] = field(default_factory=dict)

    def own_statuses(self) -> list[str]:
        """Declared statuses and those of transitions, in order of mention."""
        return list(dict.fromkeys([*self.statuses, *(s for t in self.transitions for s in (t.source, t.target))]))

    def start(self) -> str | None:
        """The declared initial status, else the one that is a source and never a target."""
        if self.initial:
            return self.initial
        targets = {t.target for t in self.transitions}
        return next((t.source for t in self.transitions if t.source not in targets), None)

    def final(self) -> set[str]:
        sources = {t.source for t in self.transitions}
        return {s for s in self.own_statuses() if s not in sources}


@dataclass(frozen=True)
class Schema:
    object_types: dict[str, ObjectType] = field(default_factory=dict)
    fact_types: dict[str, FactType] = field(default_factory=dict)
    constraints: tuple[Constraint, ...] = ()
    rules: tuple[Rule, ...] = ()
    machines: tuple[Machine, ...] = ()

    def supertypes(self, name: str) -> set[str]:
        """name and all object types above it."""
        seen, todo = set(), [name]
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += self.object_types[n].supertypes if n in self.object_types else ()
        return seen

    def subtypes(self, name: str) -> set[str]:
        return {n for n in {*self.object_types, name} if name in self.supertypes(n)}
