"""Streams of events: folded through a machine in order of arrival, demultiplexed by key, limited by rate.

The batch fold orders events by their own time; a stream can only take them as they arrive. `fold_stream` says which by
its name of the order column: within a micro-batch events are sorted by it, across batches arrival decides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.machine import effective, leaf
from ..schema import Machine


def transition_table(m: Machine) -> dict[tuple[str, str], str]:
    """The targets of transitions without guards."""
    return {(t.source, t.trigger): t.target for t in reversed(effective(m)) if t.guard is None}


def fold_stream(events: DataFrame, m: Machine, *, entity: str, event: str, order: str, guards: dict[str, str] | None = None) -> DataFrame:
    """entity and status after each micro-batch; the state of an entity is its status alone. guards: guard fact type ->
    boolean column of events, as for the batch fold; a guard without a column doesn't hold."""
    guards = guards or {}
    moves: dict[tuple[str, str], list[tuple[str | None, str]]] = {}
    for t in effective(m):
        if t.guard is None or t.guard in guards:
            moves.setdefault((t.source, t.trigger), []).append((guards.get(t.guard) if t.guard else None, t.target))
    start, asked = leaf(m, m.start()), list(guards.values())
    kind = events.schema[entity].dataType.simpleString()

    def advance(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status = state.get[0] if state.exists else start
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        for e, *held in rows[[event, *asked]].itertuples(index=False, name=None):
            holds = dict(zip(asked, held, strict=True))
            status = next((to for column, to in moves.get((status, e), ()) if column is None or holds[column] is True or holds[column] == 1), status)
        state.update((status,))
        yield pd.DataFrame({entity: [key[0]], "status": [status]})

    return events.groupBy(entity).applyInPandasWithState(advance, f"{entity} {kind}, status string", "status string", "update", GroupStateTimeout.NoTimeout)


def demultiplexed(events: DataFrame, key: Column, value) -> DataFrame:
    """The events of one cell."""
    return events.where(key == value)


def over_rate(events: DataFrame, *, entity: str, time: str, window: str, most: int, late: str = "10 minutes") -> DataFrame:
    """entity, start, end and n of windows that hold more than `most` events: a cardinality constraint over time.

    State is bounded by the watermark; events later than `late` aren't counted.
    """
    counted = events.withWatermark(time, late).groupBy(entity, F.window(time, window)).agg(F.count("*").alias("n"))
    return counted.where(F.col("n") > most).select(entity, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def subscribe(stream: DataFrame, view: Callable[[DataFrame], DataFrame], deliver: Callable[[DataFrame, int], None], checkpoint: str):
    """A registered expression, evaluated again for each batch of changes and delivered once per batch id."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: deliver(view(df), n)).start()


def event_log(events: DataFrame, of: str, time: str, caused: str) -> DataFrame:
    """Event records: id, what it is of, when, and what it caused."""
    return events.select(F.sha2(F.concat_ws("\x1f", F.col(of).cast("string"), F.col(time).cast("string"), F.col(caused).cast("string")), 256).alias("event"), F.col(of).alias("of"), F.col(time).alias("time"), F.col(caused).alias("caused"))
