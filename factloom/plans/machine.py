"""State machines as facts: effective transitions of nested machines, and the fold of events into statuses.

Nested machines are flattened first: a transition of a composite status is inherited by every status inside it unless the
inside has one of its own for the event; a target that is composite is entered at its initial leaf; arriving in a final
status of an inner machine carries on by the outer status's transition for the same event, if there is one. The fold then
knows plain statuses only.

The fold is parallel within an entity: over a fixed list of statuses an event is a function from status to status, and
composing functions is associative. Where an entity has very many events, events are dealt by ranges of (entity, order), so
that its events lie in several tasks; each chunk is folded from every status at once, and chunks are composed in order. A
task so holds one chunk of an entity's events, not all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import Machine, Transition
from ..session import kept

#: Events of one entity folded together at most, and events of a task where they are dealt by ranges.
CHUNK, PART = 10_000, 200_000


def machines(m: Machine) -> list[Machine]:
    return [m, *(x for s in m.subs.values() for x in machines(s))]


def leaf(m: Machine, status: str) -> str:
    """The initial leaf of a status, which may be composite."""
    sub = m.subs.get(status)
    if sub is None:
        return next((leaf(s, status) for s in m.subs.values() if status in statuses(s)), status)
    return leaf(sub, sub.start())


def statuses(m: Machine) -> list[str]:
    return list(dict.fromkeys([*m.own_statuses(), *(s for x in m.subs.values() for s in statuses(x))]))


def effective(m: Machine) -> list[Transition]:
    """Transitions from leaf statuses: own ones, and those inherited from the statuses around; the innermost wins."""
    out: list[Transition] = []

    def visit(part: Machine, around: list[tuple[Machine, str]]) -> None:
        finals = part.final()
        for s in part.own_statuses():
            if s in part.subs:
                visit(part.subs[s], [*around, (part, s)])
                continue
            seen: set[tuple[str, str | None]] = set()
            for home, at in [(part, s), *reversed(around)]:
                for t in (t for t in home.transitions if t.source == at):
                    if (t.trigger, t.guard) in seen or (t.trigger, None) in seen:
                        continue
                    seen.add((t.trigger, t.guard))
                    target = t.target
                    # a final status of an inner machine carries on outside
                    if home is part and target in finals and around:
                        outer, outer_at = around[-1]
                        onward = next((x for x in outer.transitions if x.source == outer_at and x.trigger == t.trigger), None)
                        if onward:
                            target = leaf(m, onward.target)
                    out.append(Transition(t.name, s, leaf(m, target), t.trigger, t.guard))

    visit(m, [])
    return out


def effective_frame(spark, m: Machine) -> DataFrame:
    return spark.createDataFrame([(t.source, t.trigger, t.target, t.guard) for t in effective(m)], "source string, trigger string, target string, guard string")


def terminal(m: Machine) -> set[str]:
    """Leaf statuses that no effective transition leaves."""
    return {s for s in statuses(m) if s not in m.subs and not any(x for x in machines(m) if s in x.subs)} - {t.source for t in effective(m)}


def reaches(m: Machine) -> set[tuple[str, str]]:
    """(status, status) by one or more effective transitions."""
    edges = {(t.source, t.target) for t in effective(m)}
    out = set(edges)
    while True:
        more = {(a, d) for a, b in out for c, d in edges if b == c} - out
        if not more:
            return out
        out |= more


def cycles_without_exit(m: Machine) -> set[str]:
    """Statuses on a cycle that no transition leaves."""
    r = reaches(m)
    on = {a for a, b in r if a == b}
    groups = {a: {b for b in on if (a, b) in r and (b, a) in r} for a in on}
    return {a for a, g in groups.items() if not any(t.source in g and t.target not in g for t in effective(m))}


def _step(m: Machine, event: Column, guards: dict[str, Column], names: list[str], stays: bool = True) -> Column:
    """An event as an array: for each status (by place) the place it leads to; its own, or null, without a transition. A
    guarded transition needs its guard to hold; a guard that isn't known doesn't."""
    places = []
    for k, s in enumerate(names):
        to = None
        for t in (t for t in effective(m) if t.source == s and (t.guard is None or t.guard in guards)):
            hit = event == t.trigger
            if t.guard is not None:
                hit = hit & F.coalesce(guards[t.guard], F.lit(False))
            value = F.lit(names.index(t.target))
            to = F.when(hit, value) if to is None else to.when(hit, value)
        rest = F.lit(k) if stays else F.lit(None).cast("int")
        places.append(rest if to is None else to.otherwise(rest))
    return F.array(*places)


def _composed(parts: Column, size: int) -> Column:
    """The functions of an array, one after another."""
    same = F.array(*[F.lit(k) for k in range(size)])
    return F.aggregate(parts, same, lambda acc, f: F.transform(acc, lambda s: F.element_at(f, s + 1)))


def _chunks(events: DataFrame, m: Machine, names: list[str], entity: str, event: str, order: list[str], guards: dict[str, str] | None, chunk: int) -> DataFrame:
    """_e, _c (chunks of an entity in order), _x: a chunk's events in order with their functions."""
    step = _step(m, F.col(event), {g: F.col(c) for g, c in (guards or {}).items()}, names)
    rows = events.select(F.col(entity).alias("_e"), F.struct(*order, event).alias("_o"), step.alias("_f"))
    most = rows.groupBy("_e").agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    if (most[0] or 0) > chunk:
        parts = max(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-most[1] // PART))
        rows = rows.repartitionByRange(parts, "_e", "_o").sortWithinPartitions("_e", "_o")
        # ids rise with the partition, then with the row; those of different partitions lie far apart
        rows = rows.withColumn("_c", F.call_function("div", F.monotonically_increasing_id(), F.lit(chunk)))
    else:
        rows = rows.withColumn("_c", F.lit(0).cast("bigint"))
    return rows.groupBy("_e", "_c").agg(F.array_sort(F.collect_list(F.struct("_o", "_f"))).alias("_x"))


def fold(events: DataFrame, m: Machine, *, entity: str, event: str, order: list[str], guards: dict[str, str] | None = None, start: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """entity and status after all its events in order; an event without a transition from the status changes nothing.

    guards: guard fact type -> boolean column of events that says whether it holds of the entity.
    """
    names = statuses(m)
    begin = names.index(leaf(m, start or m.start()))
    rows = _chunks(events, m, names, entity, event, order, guards, chunk)
    per_chunk = rows.select("_e", "_c", _composed(F.transform("_x", lambda x: x["_f"]), len(names)).alias("_f"))
    whole = per_chunk.groupBy("_e").agg(_composed(F.transform(F.array_sort(F.collect_list(F.struct("_c", "_f"))), lambda x: x["_f"]), len(names)).alias("_f"))
    labels = F.array(*[F.lit(s) for s in names])
    return whole.select(F.col("_e").alias(entity), F.element_at(labels, F.element_at("_f", begin + 1) + 1).alias("status"))


def moves(held: DataFrame, m: Machine, events: DataFrame, guards: dict[str, str] | None = None) -> DataFrame:
    """entity, from and to for events (entity, trigger) of entities at a held status (entity, status); others stand at the start.

    guards: guard fact type -> boolean column of events; a transition whose guard doesn't hold, or isn't given, doesn't move.
    """
    names = statuses(m)
    step = _step(m, F.col("trigger"), {g: F.col(c) for g, c in (guards or {}).items()}, names, stays=False)
    at = events.withColumn("_f", step).join(held.toDF("entity", "_s"), "entity", "left").withColumn("_s", F.coalesce("_s", F.lit(leaf(m, m.start()))))
    labels = F.array(*[F.lit(s) for s in names])
    place = F.array_position(labels, F.col("_s")).cast("int")
    moved = at.where(place > 0).withColumn("_to", F.element_at("_f", place)).where("_to is not null")
    return moved.select("entity", F.col("_s").alias("from"), F.element_at(labels, F.col("_to") + 1).alias("to"))


def available(held: DataFrame, m: Machine, guards: dict[str, DataFrame] | None = None) -> DataFrame:
    """entity, status, trigger and target of the transitions that leave its status; terminal statuses afford none.

    guards: guard fact type -> entities (one column) of which it holds; a guarded transition is afforded to those only.
    """
    t = effective_frame(held.sparkSession, m).select(F.col("source").alias("status"), "trigger", "target", "guard")
    links = held.join(F.broadcast(t), "status")
    out = links.where("guard is null")
    for name, entities in (guards or {}).items():
        holds = entities.select(F.col(entities.columns[0]).alias("_g")).distinct()
        out = out.union(links.where(F.col("guard") == name).join(holds, F.col("entity") == F.col("_g"), "left_semi"))
    return out.select("entity", "status", "trigger", "target").distinct()


#: Events of a chunk whose statuses are listed one by one; the list is copied for each.
LISTED = 200


def history(events: DataFrame, m: Machine, *, entity: str, event: str, order: list[str], guards: dict[str, str] | None = None, chunk: int = LISTED) -> DataFrame:
    """Each event with the status before and after it. Chunks are composed for their first statuses, then listed apart."""
    names = statuses(m)
    begin = names.index(leaf(m, m.start()))
    chunks = kept(_chunks(events, m, names, entity, event, order, guards, chunk))
    parts = chunks.select("_e", F.struct("_c", _composed(F.transform("_x", lambda x: x["_f"]), len(names)).alias("_f")).alias("p"))
    zero = F.struct(F.lit(begin).alias("at"), F.array().cast("array<struct<c:bigint,at:int>>").alias("path"))

    def enter(acc, p):
        return F.struct(F.element_at(p["_f"], acc["at"] + 1).alias("at"), F.array_append(acc["path"], F.struct(p["_c"].alias("c"), acc["at"].alias("at"))).alias("path"))

    starts = parts.groupBy("_e").agg(F.aggregate(F.array_sort(F.collect_list("p")), zero, enter, lambda acc: acc["path"]).alias("path"))
    starts = starts.select(F.col("_e").alias("_se"), F.explode("path").alias("s")).select("_se", "s.c", "s.at")
    listed = chunks.join(starts, F.col("_e").eqNullSafe(F.col("_se")) & (F.col("_c") == F.col("c")))
    first = F.struct(F.col("at"), F.array().cast("array<struct<before:int,after:int>>").alias("path"))

    def advance(acc, x):
        to = F.element_at(x["_f"], acc["at"] + 1)
        return F.struct(to.alias("at"), F.array_append(acc["path"], F.struct(acc["at"].alias("before"), to.alias("after"))).alias("path"))

    path = F.aggregate("_x", first, advance, lambda acc: acc["path"])
    labels = F.array(*[F.lit(s) for s in names])
    out = listed.select("_e", F.explode(F.arrays_zip(F.transform("_x", lambda x: x["_o"]).alias("o"), path.alias("p"))).alias("z"))
    return out.select(F.col("_e").alias(entity), *[F.col(f"z.o.{c}").alias(c) for c in (*order, event)], F.element_at(labels, F.col("z.p.before") + 1).alias("before"), F.element_at(labels, F.col("z.p.after") + 1).alias("after"))
