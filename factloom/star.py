"""The fact types of the star tables: orders, lines, customers, suppliers, parts, events, documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.recipe import Relation, relation
from .schema import FactType, ObjectType, Schema
from .store import FactStore, from_table

#: fact type: (table, key, column, players)
FUNCTIONAL = {
    "OrderPlacedByCustomer": ("orders", "o_orderkey", "o_custkey", ("Order", "Customer")),
    "OrderHasTotal": ("orders", "o_orderkey", "o_totalprice", ("Order", "Amount")),
    "OrderHasStatus": ("orders", "o_orderkey", "o_orderstatus", ("Order", "Status")),
    "OrderHasDate": ("orders", "o_orderkey", "o_orderdate", ("Order", "Date")),
    "OrderHasPriority": ("orders", "o_orderkey", "o_orderpriority", ("Order", "Priority")),
    "CustomerHasName": ("customer", "c_custkey", "c_name", ("Customer", "Name")),
    "CustomerInNation": ("customer", "c_custkey", "c_nationkey", ("Customer", "Nation")),
    "CustomerHasBalance": ("customer", "c_custkey", "c_acctbal", ("Customer", "Amount")),
    "CustomerInSegment": ("customer", "c_custkey", "c_mktsegment", ("Customer", "Segment")),
    "SupplierHasName": ("supplier", "s_suppkey", "s_name", ("Supplier", "Name")),
    "SupplierInNation": ("supplier", "s_suppkey", "s_nationkey", ("Supplier", "Nation")),
    "SupplierHasBalance": ("supplier", "s_suppkey", "s_acctbal", ("Supplier", "Amount")),
    "NationHasName": ("nation", "n_nationkey", "n_name", ("Nation", "Name")),
    "NationInRegion": ("nation", "n_nationkey", "n_regionkey", ("Nation", "Region")),
    "RegionHasName": ("region", "r_regionkey", "r_name", ("Region", "Name")),
    "PartHasName": ("part", "p_partkey", "p_name", ("Part", "Name")),
    "PartHasBrand": ("part", "p_partkey", "p_brand", ("Part", "Brand")),
    "PartHasType": ("part", "p_partkey", "p_type", ("Part", "Type")),
    "PartHasSize": ("part", "p_partkey", "p_size", ("Part", "Size")),
    "PartHasPrice": ("part", "p_partkey", "p_retailprice", ("Part", "Amount")),
    "EventOfUser": ("events", "event_id", "user_id", ("Event", "User")),
    "EventHasType": ("events", "event_id", "event_type", ("Event", "EventType")),
    "EventAt": ("events", "event_id", "ts", ("Event", "Time")),
    "EventHasValue": ("events", "event_id", "value", ("Event", "Number")),
    "DocumentHasLang": ("documents", "doc_id", "lang", ("Document", "Lang")),
    "DocumentFromSource": ("documents", "doc_id", "source", ("Document", "Source")),
    "DocumentHasLength": ("documents", "doc_id", "n_chars", ("Document", "Number")),
    "DocumentHasQuality": ("labels", "doc_id", "quality", ("Document", "Number")),
    "DocumentHasToxicity": ("labels", "doc_id", "toxic", ("Document", "Number")),
}
#: fact type: (table, columns, players); a line has no small key, so these project and merge.
MANY = {
    "OrderContainsPart": ("lineitem", ("l_orderkey", "l_partkey"), ("Order", "Part")),
    "OrderFromSupplier": ("lineitem", ("l_orderkey", "l_suppkey"), ("Order", "Supplier")),
    "SupplierSuppliesPart": ("lineitem", ("l_suppkey", "l_partkey"), ("Supplier", "Part")),
    "OrderShipsOn": ("lineitem", ("l_orderkey", "l_shipdate"), ("Order", "Date")),
}
LINE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")

SCHEMA = Schema(
    object_types={
        n: ObjectType(n, entity=n in ("Order", "Customer", "Supplier", "Nation", "Region", "Part", "Event", "Document", "User"), supertypes=("Party",) if n in ("Customer", "Supplier") else ())
        for n in ["Party", *dict.fromkeys(p for *_, players in [*FUNCTIONAL.values(), *MANY.values()] for p in players)]
    },
    fact_types={
        **{n: FactType(n, players, unique=((1,),), mandatory=(1,)) for n, (*_, players) in FUNCTIONAL.items()},
        **{n: FactType(n, players, unique=((1, 2),)) for n, (*_, players) in MANY.items()},
    },
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> Relation:
    """A line as one fact over all its columns; whole rows are distinct. Negative zeros become zeros."""
    df = table(spark, sf_dir, "lineitem")
    zeros = {"l_discount", "l_tax"}
    return relation(df.select(*[(F.col(c) + F.lit(0.0)).alias(c) if c in zeros else F.col(c) for c in LINE]), tuple(range(1, len(LINE) + 1)))


def star_store(spark: SparkSession, sf_dir: str) -> FactStore:
    """Lazily: a population is planned when it is asked for, and a plan reads only its own columns."""

    def functional(name: str):
        source, key, column, _ = FUNCTIONAL[name]
        return lambda: from_table(table(spark, sf_dir, source), key, column)

    def many(name: str):
        source, columns, _ = MANY[name]
        return lambda: relation(table(spark, sf_dir, source).select(*columns).where(" and ".join(f"{c} is not null" for c in columns))).as_set()

    populations = {n: functional(n) for n in FUNCTIONAL} | {n: many(n) for n in MANY} | {"Line": lambda: lines(spark, sf_dir)}
    return FactStore(spark, populations, SCHEMA)
