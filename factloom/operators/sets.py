"""Set and list operators: on relations by joins and aggregates, on array columns by higher-order functions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# relations


def union(*dfs: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, dfs).distinct()


def inter(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def setminus(a: DataFrame, b: DataFrame) -> DataFrame:
    """a's rows that b hasn't; a's repeated rows stay repeated."""
    moved = b.toDF(*[f"r_{k}" for k in range(len(b.columns))])
    on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"r_{k}")) for k, c in enumerate(a.columns)])
    return a.join(moved, on, "left_anti")


def seteq(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row, equal: whether both hold the same rows. One aggregation over the tagged union."""
    tagged = a.distinct().withColumn("_s", F.lit(1)).union(b.toDF(*a.columns).distinct().withColumn("_s", F.lit(2)))
    odd = tagged.groupBy(*a.columns).agg(F.count("*").alias("_n")).where("_n = 1")
    return odd.agg((F.count("*") == 0).alias("equal"))


def natjoin(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Rows of left with those of right whose first column equals left's column `on`; right's first column is left out."""
    first, *rest = right.columns
    return left.join(right.withColumnRenamed(first, "_k"), F.col(on) == F.col("_k")).select(*left.columns, *rest)


def tie(df: DataFrame) -> DataFrame:
    """Rows whose first and last columns are equal."""
    return df.where(F.col(df.columns[0]).eqNullSafe(F.col(df.columns[-1])))


def member(df: DataFrame, rows: DataFrame) -> DataFrame:
    """df with is_member, T or F: whether rows has the row."""
    marked = rows.toDF(*[f"r_{k}" for k in range(len(rows.columns))]).distinct().withColumn("_m", F.lit(True))
    on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"r_{k}")) for k, c in enumerate(df.columns)])
    return df.join(marked, on, "left").select(*df.columns, F.when(F.col("_m"), "T").otherwise("F").alias("is_member"))


def count_rows(df: DataFrame, *keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def with_counts(df: DataFrame, *keys: str) -> DataFrame:
    """Rows with n, how many share their keys."""
    return df.join(df.groupBy(*keys).agg(F.count("*").alias("n")), list(keys))


def rows_for(df: DataFrame, key, position: int = 1) -> DataFrame:
    """Rows whose column at position equals key."""
    return df.where(F.col(df.columns[position - 1]) == key)


def lookup(df: DataFrame, table: DataFrame, key: str, sentinel) -> DataFrame:
    """df with value: table's second column where its first equals key, least value first; sentinel if there is none."""
    k, v = table.columns
    found = table.groupBy(F.col(k).alias("_k")).agg(F.min(v).alias("value"))
    return df.join(found, F.col(key) == F.col("_k"), "left").drop("_k").withColumn("value", F.coalesce("value", F.lit(sentinel)))


def nest(df: DataFrame) -> DataFrame:
    """Rows grouped by the first column; rest: the other columns, sorted, as structs."""
    first, *rest = df.columns
    return df.groupBy(first).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("rest"))


def unnest(df: DataFrame) -> DataFrame:
    first, rest = df.columns
    return df.select(first, F.explode(rest).alias("_r")).select(first, "_r.*")


def merge_cells(df: DataFrame, name: str, contents: str) -> DataFrame:
    """Contents (arrays) of cells of one name, concatenated in sorted order."""
    return df.groupBy(name).agg(F.sort_array(F.flatten(F.collect_list(contents))).alias(contents))


def wide_row(spine: DataFrame, relations: dict[str, DataFrame]) -> DataFrame:
    """The spine's key with one column per functional relation (key, value); null where a relation has no fact."""
    key = spine.columns[0]
    out = spine
    for name, df in relations.items():
        out = out.join(df.toDF(f"_k_{name}", name), F.col(key) == F.col(f"_k_{name}"), "left").drop(f"_k_{name}")
    return out


def extreme(df: DataFrame, by: str, value: str, *, highest: bool) -> DataFrame:
    """For each value of `by`, the row with the highest or lowest value; ties go to the greatest or least row by its other
    columns. One aggregation with partial results."""
    rest = F.struct(value, *[c for c in df.columns if c not in (by, value)])
    best = (F.max if highest else F.min)(rest).alias("_r")
    return df.groupBy(by).agg(best).select(by, *[F.col(f"_r.{c}").alias(c) for c in df.columns if c != by])


def next_positions(new: DataFrame, by: list[str], order: list[str], held: DataFrame | None = None, position: str = "position") -> DataFrame:
    """new with positions: by order, next after the greatest that held facts with the same `by` have."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    if held is None:
        return new.withColumn(position, place)
    last = held.groupBy(*[F.col(c).alias(f"_h_{c}") for c in by]).agg(F.max(position).alias("_last"))
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_h_{c}")) for c in by])
    rows = new.withColumn("_place", place).join(last, on, "left")
    return rows.select(*new.columns, (F.col("_place") + F.coalesce("_last", F.lit(0))).alias(position))


# array columns


def flattened(xs: Column) -> Column:
    """The elements of a sequence of sequences, one level down."""
    return F.flatten(xs)


def sorted_by(xs: Column, key: Callable[[Column], Column]) -> Column:
    """Elements sorted by a key, those of one key in their order."""
    placed = F.transform(xs, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(placed), lambda p: p["x"])


def dedup_last(xs: Column) -> Column:
    """Each element once, at its last place."""
    return F.reverse(F.array_distinct(F.reverse(xs)))


def dedup_sorted(xs: Column) -> Column:
    return F.array_sort(F.array_distinct(xs))


def take(xs: Column, n: int) -> Column:
    return F.slice(xs, 1, max(n, 0))


def drop(xs: Column, n: int) -> Column:
    """Without the first n; a negative count takes all."""
    return F.slice(xs, 1, 0) if n < 0 else F.slice(xs, n + 1, F.greatest(F.size(xs) - n, F.lit(0)))


def nth(xs: Column, n: int) -> Column:
    """The element at n, from 0; out of range is an error."""
    return F.element_at(xs, n + 1)


def last(xs: Column) -> Column:
    """The last element; "?" of an empty sequence."""
    return F.coalesce(F.get(xs, F.size(xs) - 1), F.lit("?"))


def butlast(xs: Column) -> Column:
    return F.slice(xs, 1, F.greatest(F.size(xs) - 1, F.lit(0)))


def iota(n: Column) -> Column:
    """1 ... n; empty for 0 or less."""
    return F.when(n < 1, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), n.cast("int")))


def zipped(a: Column, b: Column) -> Column:
    """Pairs, as long as the shorter."""
    return F.slice(F.arrays_zip(a.alias("a"), b.alias("b")), F.lit(1), F.least(F.size(a), F.size(b)))


def filter_eq(pairs: Column) -> Column:
    """Pairs (structs of two) whose halves are equal."""
    return F.filter(pairs, lambda p: p["a"].eqNullSafe(p["b"]))


def find_first(xs: Column, name) -> Column:
    """The first struct whose field name equals name; null if there is none."""
    return F.get(F.filter(xs, lambda x: x["name"] == name), F.lit(0))


def array_union(a: Column, b: Column) -> Column:
    return dedup_sorted(F.array_union(a, b))


def array_minus(a: Column, b: Column) -> Column:
    return dedup_sorted(F.array_except(a, b))


def array_inter(a: Column, b: Column) -> Column:
    return dedup_sorted(F.array_intersect(a, b))


# atoms and sequences of mixed kinds, as Python values on the driver (numbers < texts < sequences)


def order_key(x):
    if isinstance(x, bool):
        return (1, "T" if x else "F")
    if isinstance(x, (int, float)):
        return (0, x)
    if isinstance(x, str):
        return (1, x.encode())
    return (2, tuple(order_key(e) for e in x))


def mixed_sort(xs: list) -> list:
    """Sorted with repeats merged; sequences by their elements, then by length."""
    out: list = []
    for x in sorted(xs, key=order_key):
        if not out or order_key(out[-1]) != order_key(x):
            out.append(x)
    return out


def atoms(x) -> list:
    """All atoms of a nested sequence, in order."""
    return [a for e in x for a in atoms(e)] if isinstance(x, (list, tuple)) else [x]
