"""Derivation: strata of rules, their least fixed point, and what is refused before anything runs.

A rule's head depends on its sources, positively or (under a difference's right side or an aggregate) negatively. Strata
are the strongly connected components of that graph, lowest first. A head that isn't recursive is one plan, never run by
itself; a recursive component is evaluated semi-naively: each round joins the last round's new rows with all rows so far,
once for every recursive source of every arm, and keeps what is new. Rounds are written to the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Rule
from ..session import kept
from ..store import FactStore
from .recipe import Compiler, Relation, introduces, negated, replaced, sources


class RefusedRule(ValueError):
    """A rule that can't be admitted: negation or a made-up value on a cycle."""


def _base(name: str) -> str:
    return name.removesuffix("#base")


def dependencies(rules: Iterable[Rule]) -> dict[str, dict[str, bool]]:
    """head -> source -> whether the dependence is negative (or through an aggregate)."""
    out: dict[str, dict[str, bool]] = {}
    for r in rules:
        own = out.setdefault(r.head, {})
        for arm in r.arms:
            minus = {_base(s) for s in negated(arm)}
            for s in sources(arm):
                own[_base(s)] = own.get(_base(s), False) or _base(s) in minus
    return out


def strata(rules: Iterable[Rule]) -> list[list[str]]:
    """Heads by component, each after the components it depends on (Tarjan, without recursion)."""
    graph = dependencies(rules)
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    on: set[str] = set()
    out: list[list[str]] = []
    for root in graph:
        if root in index:
            continue
        work = [(root, iter([s for s in graph[root] if s in graph]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            nxt = next(rest, None)
            if nxt is None:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    part = []
                    while True:
                        x = stack.pop()
                        on.discard(x)
                        part.append(x)
                        if x == node:
                            break
                    out.append(sorted(part))
            elif nxt not in index:
                index[nxt] = low[nxt] = len(index)
                stack.append(nxt)
                on.add(nxt)
                work.append((nxt, iter([s for s in graph[nxt] if s in graph])))
            elif nxt in on:
                low[node] = min(low[node], index[nxt])
    return out


def recursive(part: list[str], graph: dict[str, dict[str, bool]]) -> bool:
    return len(part) > 1 or part[0] in graph[part[0]]


def refused(rules: Iterable[Rule]) -> dict[str, str]:
    """Heads that can't be admitted, with the reason."""
    rules = list(rules)
    graph, out = dependencies(rules), {}
    for part in strata(rules):
        if not recursive(part, graph):
            continue
        for r in (r for r in rules if r.head in part):
            if any(graph[r.head].get(s) for s in part):
                out[r.head] = "negation or aggregation on a cycle"
            for arm in r.arms:
                if introduces(arm) and any(_base(s) in part for s in sources(arm)):
                    out[r.head] = "a value is introduced on a cycle"
    return out


def reach(rules: Iterable[Rule], changed: Iterable[str]) -> set[str]:
    """Heads that a change of some fact types can reach."""
    graph, found = dependencies(rules), set(changed)
    while True:
        more = {h for h, s in graph.items() if h not in found and found & set(s)}
        if not more:
            return found & set(graph)
        found |= more


def derive(store: FactStore, rules: Iterable[Rule], *, only: Iterable[str] | None = None) -> FactStore:
    """store with its derived heads. Refused rules raise; heads outside `only` and what it depends on are left out."""
    rules = list(rules)
    if bad := refused(rules):
        raise RefusedRule("; ".join(f"{h}: {why}" for h, why in sorted(bad.items())))
    graph = dependencies(rules)
    if only is not None:
        need, todo = set(), list(only)
        while todo:
            h = todo.pop()
            if h in graph and h not in need:
                need.add(h)
                todo += graph[h]
        rules = [r for r in rules if r.head in need]
        graph = dependencies(rules)
    arms: dict[str, list] = {}
    semi, stored = set(), set()
    for r in rules:
        arms.setdefault(r.head, []).extend(r.arms)
        semi |= {r.head} if r.semi else set()
        stored |= {r.head} if r.stored else set()
    for part in strata(rules):
        if recursive(part, graph):
            store = _fixpoint(store, part, arms, semi)
        else:
            head = part[0]
            compiler = Compiler(store.relation)
            found = compiler(["union", *arms[head]]) if len(arms[head]) > 1 else compiler(arms[head][0]).as_set()
            if head in semi and head in store:
                found = Relation(found.df.union(store.facts(head))).as_set()
            if head in stored:
                found = Relation(kept(found.df), found.keys)
            store = store.with_facts(**{head: found})
    return store


def _fixpoint(store: FactStore, part: list[str], arms: dict[str, list], semi: set[str]) -> FactStore:
    def evaluate(recipe, source) -> DataFrame:
        return Compiler(source).rows(recipe)

    def in_part(name: str) -> bool:
        return _base(name) in part

    total: dict[str, DataFrame] = {}
    for head in part:
        seeds = [evaluate(a, store.relation) for a in arms[head] if not any(map(in_part, sources(a)))]
        if head in semi and head in store:
            seeds.append(store.facts(head))
        if seeds:
            total[head] = kept(reduce(DataFrame.union, seeds).distinct())
    if not total:
        raise RefusedRule(f"{', '.join(part)}: no arm to start from")
    delta = dict(total)
    rounds = 0

    def source(name: str) -> Relation:
        if name.startswith("#delta "):
            return Relation(delta[name.removeprefix("#delta ")])
        if in_part(name):
            return Relation(total[_base(name)])
        return store.relation(name)

    while delta:
        new: dict[str, DataFrame] = {}
        for head in part:
            found = []
            for arm in arms[head]:
                names = sources(arm)
                if not all(_base(n) in total or not in_part(n) for n in names):
                    continue
                for k, name in enumerate(names):
                    if in_part(name) and _base(name) in delta:
                        found.append(evaluate(replaced(arm, k, f"#delta {_base(name)}"), source))
            if found:
                rows = reduce(DataFrame.union, found)
                rows = kept(rows.subtract(total[head]) if head in total else rows.distinct())
                if not rows.isEmpty():
                    new[head] = rows
        rounds += 1
        for head, rows in new.items():
            rows = total[head].union(rows) if head in total else rows
            # many rounds leave many files, which every later round would read
            total[head] = kept(rows) if rounds % 8 == 0 else rows
        delta = new
    return store.with_facts(**{h: Relation(df, frozenset([frozenset(range(1, len(df.columns) + 1))])) for h, df in total.items()})


def closure(edges: DataFrame) -> DataFrame:
    """Transitive closure of c1 -> c2 by doubling: path lengths double each round, so rounds are few. A round joins what the
    last one found with all, from either side."""
    total = kept(edges.select(F.col(edges.columns[0]).alias("c1"), F.col(edges.columns[1]).alias("c2")).distinct())
    new = total
    while True:
        after = new.alias("a").join(total.alias("b"), F.col("a.c2") == F.col("b.c1")).select(F.col("a.c1").alias("c1"), F.col("b.c2").alias("c2"))
        before = total.alias("a").join(new.alias("b"), F.col("a.c2") == F.col("b.c1")).select(F.col("a.c1").alias("c1"), F.col("b.c2").alias("c2"))
        new = kept((after if new is total else after.union(before)).subtract(total))
        if new.isEmpty():
            return total
        total = kept(total.union(new))


def most_specifically(pairs: DataFrame) -> DataFrame:
    """Of a transitive relation (container, contained), the pairs with nothing between them."""
    rows = pairs.toDF("c1", "c2")
    between = rows.alias("a").join(rows.alias("b"), F.col("a.c2") == F.col("b.c1")).select(F.col("a.c1").alias("c1"), F.col("b.c2").alias("c2"))
    return rows.join(between, ["c1", "c2"], "left_anti")


def _spread(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (node, label) after the least label of each node has gone along all edges, until nothing changes."""
    while True:
        came = edges.join(labels, F.col("c1") == F.col("node")).select(F.col("c2").alias("node"), "label")
        least = kept(labels.union(came).groupBy("node").agg(F.min("label").alias("label")))
        if least.subtract(labels).isEmpty():
            return least
        labels = least


def strong_edges(edges: DataFrame) -> DataFrame:
    """The edges inside strongly connected components, by colours: each node takes the least node that reaches it; those of
    a colour that reach the colour's own node are its component. Components go, and the rest is coloured anew. Nothing is
    as large as a closure."""
    inside = []
    rest = cycle_core(edges)
    while not rest.isEmpty():
        nodes = rest.select(F.col("c1").alias("node")).union(rest.select("c2")).distinct()
        colour = _spread(nodes.withColumn("label", F.col("node")), rest)
        named = rest.join(colour.toDF("c1", "l1"), "c1").join(colour.toDF("c2", "l2"), "c2")
        same = kept(named.where("l1 = l2").select("c1", "c2", F.col("l1").alias("label")))
        # backwards from each colour's own node
        found = kept(colour.where("node = label").select("node"))
        new = found
        while not new.isEmpty():
            back = same.join(new, F.col("c2") == F.col("node"), "left_semi").select(F.col("c1").alias("node")).distinct()
            new = kept(back.join(found, "node", "left_anti"))
            found = kept(found.union(new))
        own = same.join(found.toDF("c1"), "c1", "left_semi").join(found.toDF("c2"), "c2", "left_semi").select("c1", "c2")
        inside.append(kept(own))
        rest = cycle_core(rest.join(found.toDF("c1"), "c1", "left_anti").join(found.toDF("c2"), "c2", "left_anti").select("c1", "c2"))
    return reduce(DataFrame.union, inside) if inside else edges.limit(0).toDF("c1", "c2")


def cycle_core(edges: DataFrame) -> DataFrame:
    """The edges that can lie on a cycle: ends that nothing enters or leaves are taken off until none is left."""
    core = kept(edges.select(F.col(edges.columns[0]).alias("c1"), F.col(edges.columns[1]).alias("c2")).distinct())
    n = core.count()
    while n:
        starts, ends = core.select(F.col("c1").alias("s")).distinct(), core.select(F.col("c2").alias("e")).distinct()
        smaller = kept(core.join(starts, F.col("c2") == F.col("s"), "left_semi").join(ends, F.col("c1") == F.col("e"), "left_semi"))
        m = smaller.count()
        if m == n:
            break
        core, n = smaller, m
    return core


def explain(store: FactStore, rules: Iterable[Rule], head: str, row: tuple) -> DataFrame:
    """How a derived row comes about: arm (from 0) and, for arms that give the row, the arm's recipe and its sources."""
    derived = derive(store, rules, only=[head])
    out = []
    for k, arm in enumerate(a for r in rules if r.head == head for a in r.arms):
        rows = Compiler(derived.relation).rows(arm)
        if not reduce(lambda d, kv: d.where(F.col(f"c{kv[0]}") == kv[1]), enumerate(row, 1), rows).isEmpty():
            out.append((head, k, str(arm), ",".join(_base(s) for s in sources(arm))))
    return store.spark.createDataFrame(out, "head string, arm int, recipe string, antecedents string")
