"""Facts from services that answer JSON: pages of rows at a path, with row conditions, as a Python data source.

A connector declares where rows are, how to ask for the next page and which fields hold the facts. Every request is one
partition where pages are known beforehand (`pages`), else one task follows the cursor. Answers can be recorded without
their bodies, and all facts of one fetch share a citation id made of what was asked.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import urlencode

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


@dataclass(frozen=True)
class Connector:
    """path: where the rows are in an answer (names by dots); cursor: where the next page's mark is, and its parameter."""

    url: str
    path: str = ""
    parameters: dict[str, str] = field(default_factory=dict)
    headers: dict[str, str] = field(default_factory=dict)
    cursor: str | None = None
    cursor_parameter: str = "cursor"
    pages: tuple[str, ...] = ()
    body: str | None = None


def at(document, path: str):
    for name in [p for p in path.split(".") if p]:
        if isinstance(document, list):
            document = document[int(name)] if name.isdigit() and int(name) < len(document) else None
        else:
            document = document.get(name) if isinstance(document, dict) else None
        if document is None:
            return None
    return document


def _get(url: str, headers: dict[str, str], body: str | None) -> bytes:
    from urllib.request import Request, urlopen

    with urlopen(Request(url, data=body.encode() if body else None, headers=headers), timeout=60) as r:
        return r.read()


def rows_of(c: Connector, fetch: Callable[[str, dict, str | None], bytes] = _get, page: str | None = None) -> Iterator[str]:
    """The rows of one page, or of all pages by cursor, each as JSON text."""
    mark, seen = page, set()
    while True:
        parameters = dict(c.parameters) | ({c.cursor_parameter: mark} if mark is not None else {})
        answer = json.loads(fetch(c.url + ("?" + urlencode(parameters) if parameters else ""), c.headers, c.body))
        for row in at(answer, c.path) or []:
            yield json.dumps(row, sort_keys=True)
        mark = at(answer, c.cursor) if c.cursor and page is None else None
        if mark is None or mark in seen:
            return
        seen.add(mark)




class FederationReader(DataSourceReader):
    def __init__(self, connector: Connector):
        self.connector = connector

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.connector.pages] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple[str]]:
        for row in rows_of(self.connector, page=partition.value):
            yield (row,)


class FederationSource(DataSource):
    """spark.read.format("federation").option("connector", json).load(): one text column, a row's JSON."""

    @classmethod
    def name(cls) -> str:
        return "federation"

    def schema(self) -> str:
        return "row string"

    def reader(self, schema) -> FederationReader:
        return FederationReader(connector(json.loads(self.options["connector"])))


def connector(declared: dict) -> Connector:
    return Connector(**declared | {"pages": tuple(declared.get("pages", ()))})


def load(spark: SparkSession, c: Connector) -> DataFrame:
    spark.dataSource.register(FederationSource)
    return spark.read.format("federation").option("connector", json.dumps(c.__dict__)).load()


def conditions(where: dict[str, str]) -> Column:
    """All path = value conditions hold for a row of JSON, else it yields nothing."""
    ok = F.lit(True)
    for path, value in where.items():
        ok = ok & (F.get_json_object("row", f"$.{path}") == value)
    return ok


def facts(rows: DataFrame, key: str, fact_types: dict[str, str], where: dict[str, str] | None = None, flags: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """One relation per fact type from its JSON path; a flag holds where its field is true; a missing value is no fact."""
    kept = rows.where(conditions(where or {}))
    k = F.get_json_object("row", f"$.{key}").alias("c1")
    out = {}
    for name, path in fact_types.items():
        value = F.get_json_object("row", f"$.{path}")
        if name in flags:
            out[name] = kept.where(value == "true").select(k).where("c1 is not null").distinct()
        else:
            out[name] = kept.select(k, value.alias("c2")).where("c1 is not null and c2 is not null").distinct()
    return out


def documents(facts_by_path: dict[str, DataFrame]) -> DataFrame:
    """The way back: one JSON document per key from its facts."""
    parts = None
    for path, df in facts_by_path.items():
        one = df.select("c1", F.lit(path).alias("path"), F.col("c2").cast("string").alias("value"))
        parts = one if parts is None else parts.union(one)
    return parts.groupBy("c1").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "value"))))).alias("document"))


def citation(url: str, authority: str, date: str) -> str:
    return hashlib.sha256("\x1f".join((url, authority, date)).encode()).hexdigest()


def recorded(spark: SparkSession, answers: list[tuple[str, str, int, str]]) -> DataFrame:
    """(function, url, status, time) of answers, without their bodies."""
    return spark.createDataFrame(answers, "function string, url string, status int, time string")
