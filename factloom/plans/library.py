"""Rules about models themselves, as recipes over a model's own facts.

Sources are binary fact types named after what they say; a model that lacks one leaves out the rules that read it.
"""

from __future__ import annotations

from collections.abc import Iterable

from ..schema import Rule
from ..store import FactStore
from .recipe import sources
from .rules import derive

_THEN = [[2, 1]]


def _path(a, b):
    """x to z where a relates x to y and b relates y to z."""
    return ["joinon", a, b, _THEN, [1, 4]]


def _swap(a):
    return ["proj", a, [2, 1]]


def _with(a, b):
    """Rows of binary a whose first is in unary b."""
    return ["joinon", a, b, [[1, 1]], [1, 2]]


RULES = (
    # containment and use of domains
    Rule("DomainReachesDomain", (_swap("DomainIsContainedInDomain"), _path("DomainReachesDomain", "DomainReachesDomain"))),
    Rule("DomainDrawsOnDomain", ("DomainUsesDomain", _path("DomainDrawsOnDomain", "DomainDrawsOnDomain"))),
    # rules among rules; a rule may depend on itself
    Rule("RuleDependsOnRule", (_path("RuleHasAntecedentFactType", _swap("RuleProducesFactType")),)),
    Rule("RuleReachesRule", ("RuleDependsOnRule", _path("RuleDependsOnRule", "RuleReachesRule"))),
    # constraints
    Rule("PredicateIsBound", (["proj", ["joinon", "PredicateHasModulePath", "PredicateHasSymbolName", [[1, 1]], [1]], [1]],)),
    Rule("ConstraintIsMachineDecidable", (["proj", ["joinon", "ConstraintIsDecidedByPredicate", "PredicateIsBound", _THEN, [1]], [1]],)),
    Rule("ConstraintIsSemantic", (["minus", ["joinon", ["proj", ["sel", "ConstraintHasModality", 2, "Deontic"], [1]], ["proj", "ConstraintHasText", [1]], [[1, 1]], [1]], "ConstraintIsMachineDecidable"],), "**"),
    Rule(
        "ConstraintMakesConstraintRedundant",
        (["joinon", _path(_path("ConstraintIsOfType", "ConstraintTypeImpliesConstraintType"), _swap("ConstraintIsOfType")), _path("ConstraintSpansRole", _swap("ConstraintSpansRole")), [[1, 1], [2, 2]], [1, 2]],),
    ),
    Rule("ConstraintIsRedundant", (["proj", "ConstraintMakesConstraintRedundant", [2]],)),
    # instances and subtypes
    Rule("TypeIsBelowType", ("TypeIsSubtypeOfType", _path("TypeIsBelowType", "TypeIsSubtypeOfType"))),
    Rule("InstanceIsInheritedInstanceOfType", (_path("InstanceIsInstanceOfType", "TypeIsBelowType"),)),
    Rule("InstanceIsProperlyOfType", (["joinon", _path("InstanceIsInstanceOfType", "TypeIsSubtypeOfType"), "InstanceIsInstanceOfType", [[1, 1], [2, 2]], [1, 2]],), "**"),
    Rule("InstanceIsMostSpecificallyOfType", (["minus", "InstanceIsInstanceOfType", "InstanceIsProperlyOfType"],), "**"),
    Rule("FactBelongsToDomain", (_path("FactIsOfFunction", "FunctionBelongsToDomain"),), "**"),
    Rule("ViolationBelongsToDomain", (_path("ViolationIsAgainstFunction", "FunctionBelongsToDomain"),), "**"),
    Rule("FailureBelongsToDomain", (_path("FailureIsAgainstFunction", "FunctionBelongsToDomain"),), "**"),
    Rule("OperationAwaitsDriver", (["minus", "OperationIsRegistrable", "OperationIsRegistered"],)),
    Rule("DesignIsValid", (["minus", "DesignIsEvaluated", "DesignHasBlockingOutcome"],)),
    # machines
    Rule("StatusIsEnteredInMachine", (_path(_swap("TransitionIsToStatus"), "TransitionIsDefinedInMachine"),)),
    Rule("StatusIsRootedInMachine", (["minus", _path(_swap("TransitionIsFromStatus"), "TransitionIsDefinedInMachine"), "StatusIsEnteredInMachine"],)),
    Rule("StatusLeadsToStatus", (_path(_swap("TransitionIsFromStatus"), "TransitionIsToStatus"),)),
    Rule("StatusReachesStatus", ("StatusLeadsToStatus", _path("StatusReachesStatus", "StatusLeadsToStatus"))),
    Rule("TransitionPerformsAction", ("TransitionHasAction", _path("TransitionIsToStatus", "StatusHasAction"))),
    Rule("MachineStandsForMachineDefinition", (_path(_path("MachineIsForInstance", "InstanceIsInstanceOfType"), _swap("MachineDefinitionIsForType")),), "**"),
    Rule("TransitionOccurredAt", (_path(_swap("EventCausedTransition"), "EventOccurredAt"),)),
)


def applicable(names: Iterable[str], rules: Iterable[Rule] = RULES) -> list[Rule]:
    """The rules whose sources are all held or derived by applicable rules."""
    known, left, out = set(names), list(rules), []
    while True:
        more = [r for r in left if all(s.removesuffix("#base") in known or s == r.head for a in r.arms for s in sources(a))]
        if not more:
            return out
        out += more
        known |= {r.head for r in more}
        left = [r for r in left if r not in more]


def about(store: FactStore) -> FactStore:
    """store with what the library derives from it."""
    return derive(store, applicable(store.names()))
