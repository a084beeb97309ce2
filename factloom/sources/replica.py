"""Read replicas: closed-world snapshots of tables elsewhere, with filters, columns, order and limits pushed to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def jdbc(spark: SparkSession, url: str, table: str, *, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A table by JDBC (its driver has to be on the class path); partition: column, lowest, highest, number of reads."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("pushDownAggregate", "true").option("pushDownLimit", "true")
    if partition:
        column, low, high, n = partition
        reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", n)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def listed(df: DataFrame, *, where: dict[str, object] | None = None, sort: str | None = None, descending: bool = False, limit: int | None = None) -> DataFrame:
    """A list request: equality filters, one sort column with ties by the first column, a limit."""
    for column, value in (where or {}).items():
        df = df.where(F.col(column) == value)
    if sort:
        df = df.orderBy(F.desc(sort) if descending else F.asc(sort), df.columns[0])
    return df.limit(limit) if limit is not None else df
