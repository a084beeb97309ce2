"""Induction: candidate facts from finite role domains, without those a constraint refuses, ranked."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def candidates(domains: dict[str, DataFrame], *, refuse: list[DataFrame], score: Column, most: int = 1_000_000) -> DataFrame:
    """Every combination of the domains' values that agrees with no refused relation on the columns they share.

    Domains are declared finite value lists; more than `most` combinations are an error, never a sample. id is
    content-addressed, so that a candidate has the same one in every run.
    """
    size = reduce(lambda n, d: n * d.count(), domains.values(), 1)
    if size > most:
        raise ValueError(f"{size} candidates; role domains are to be finite and small (at most {most})")
    out = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), domains.values())
    for r in refuse:
        on = [c for c in r.columns if c in out.columns]
        out = out.join(r.select(*on).distinct(), on, "left_anti")
    return out.withColumn("score", score).withColumn("id", F.sha2(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in domains]), 256))


def ranked(found: DataFrame, explains: DataFrame, on: list[str], limit: int) -> DataFrame:
    """Candidates that explain a wanted fact, best score first, ties by id."""
    return found.join(explains.select(*on).distinct(), on, "left_semi").orderBy(F.desc("score"), "id").limit(limit)


def redundant(store, target: str, recipes: list) -> list[tuple[object, bool, bool]]:
    """For recipes of the same width as a stored fact type: whether each covers it, and whether it gives exactly it."""
    held = store.facts(target)
    out = []
    for r in recipes:
        rows = store.query(r)
        if len(rows.columns) != len(held.columns):
            continue
        covers = held.subtract(rows).isEmpty()
        out.append((r, covers, covers and rows.subtract(held).isEmpty()))
    return out
