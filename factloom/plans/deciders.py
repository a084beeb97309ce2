"""Constraints on schemas that a function decides: each a query over the schema's own facts.

Inputs are relations with the named columns; each answers the offenders.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Machine
from ..security import blocked
from . import machine as mach


def _anti(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return a.join(b.select(*on).distinct(), on, "left_anti")


def declared_once(declares: DataFrame) -> DataFrame:
    """function: declared (domain, function) in more than one domain."""
    return declares.groupBy("function").agg(F.count_distinct("domain").alias("_n")).where("_n > 1").select("function")


def in_domain(functions: DataFrame, instances: DataFrame, declares: DataFrame) -> DataFrame:
    """function: no instance of anything and in no domain."""
    return _anti(_anti(functions.select("function"), instances, ["function"]), declares, ["function"])


def role_typing(fillers: DataFrame, plays: DataFrame, instance_of: DataFrame) -> DataFrame:
    """(role, instance): a filler that is an instance of no type that plays the role (role, type); (instance, type)."""
    typed = fillers.join(plays, "role").join(instance_of, ["instance", "type"]).select("role", "instance")
    return _anti(fillers.select("role", "instance").distinct(), typed, ["role", "instance"])


def yield_coverage(yields: DataFrame, roles: DataFrame, covers: DataFrame, performed: DataFrame) -> DataFrame:
    """function: yields a fact type (function, fact_type) without covering each of its roles, and no machine performs it."""
    missing = _anti(yields.join(roles, "fact_type").select("function", "role"), covers, ["function", "role"])
    return _anti(missing.select("function").distinct(), performed, ["function"])


def ring_same_type(spans: DataFrame) -> DataFrame:
    """constraint: a ring constraint whose roles (constraint, role, player) have different players."""
    return spans.groupBy("constraint").agg(F.count_distinct("player").alias("_n")).where("_n > 1").select("constraint")


def unfilled_roles(spans: DataFrame, least_sequences: int = 1) -> DataFrame:
    """constraint: sequences and positions (constraint, sequence, position) with gaps, of unequal length, or too few."""
    per = spans.groupBy("constraint", "sequence").agg(F.count_distinct("position").alias("n"), F.max("position").alias("top"))
    whole = per.groupBy("constraint").agg(F.count("*").alias("k"), F.max("sequence").alias("last"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") != F.col("top")).alias("gap"))
    return whole.where((F.col("k") != F.col("last")) | (F.col("lo") != F.col("hi")) | F.col("gap") | (F.col("k") < least_sequences)).select("constraint")


def ssrf(federations: DataFrame, blocks: list[str]) -> DataFrame:
    """federation: its url's host lies in a blocked range."""
    return blocked(federations, "url", blocks).select("federation")


def moore_mealy(edge_actions: DataFrame, state_actions: DataFrame, transitions: DataFrame) -> DataFrame:
    """(machine, transition, action): an edge's action that its target doesn't perform, where the machine has state actions."""
    mixed = edge_actions.join(transitions, ["machine", "transition"]).join(state_actions.select("machine").distinct(), "machine", "left_semi")
    performed = state_actions.select("machine", F.col("status").alias("target"), "action")
    return _anti(mixed, performed, ["machine", "target", "action"]).select("machine", "transition", "action")


def cycle_exit(machines: list[Machine]) -> list[str]:
    """Machines with a cycle that no transition leaves."""
    return [m.name for m in machines if mach.cycles_without_exit(m)]


def n_minus_one(fact_types: DataFrame, spans: DataFrame) -> DataFrame:
    """fact_type: (fact_type, arity) with a uniqueness (fact_type, constraint, role) over fewer than arity - 1 roles."""
    sizes = spans.groupBy("fact_type", "constraint").agg(F.count_distinct("role").alias("_n"))
    return sizes.join(fact_types, "fact_type").where(F.col("_n") < F.col("arity") - 1).select("fact_type").distinct()


def objectified_spanning(objectified: DataFrame, fact_types: DataFrame, spans: DataFrame) -> DataFrame:
    """fact_type: objectified without a uniqueness over all its roles."""
    sizes = spans.groupBy("fact_type", "constraint").agg(F.count_distinct("role").alias("_n"))
    spanning = sizes.join(fact_types, "fact_type").where("_n = arity").select("fact_type")
    return _anti(objectified.select("fact_type"), spanning, ["fact_type"])


def ring_complete(fact_types: DataFrame, rings: DataFrame, derived: DataFrame, exempt: list[str] | None = None) -> DataFrame:
    """fact_type: an asserted binary (fact_type, player1, player2) over one type without a ring constraint."""
    same = fact_types.where("player1 = player2").select("fact_type")
    out = _anti(_anti(same, rings, ["fact_type"]), derived, ["fact_type"])
    return reduce(lambda d, text: d.where(~F.contains("fact_type", F.lit(text))), exempt or [], out)


def vc_types(comparisons: DataFrame, data_types: DataFrame) -> DataFrame:
    """constraint: a value comparison (constraint, player) whose players (player, data_type) differ in data type."""
    return comparisons.join(data_types, "player").groupBy("constraint").agg(F.count_distinct("data_type").alias("_n")).where("_n > 1").select("constraint")


def refmode_restated(fact_types: DataFrame, reference: DataFrame, uniques: DataFrame) -> DataFrame:
    """fact_type: a binary over the players of a reference mode (entity, value) whose value role is unique."""
    restated = fact_types.join(reference, (F.col("player1") == F.col("entity")) & (F.col("player2") == F.col("value")))
    return restated.join(uniques.where("role = 2").select("fact_type").distinct(), "fact_type", "left_semi").select("fact_type").distinct()
