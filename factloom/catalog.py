"""The registered queries: each a plan over the star facts, with the same query in DuckDB's SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import ffp, scalars
from .operators import sets
from .plans import constraints as con
from .plans import machine as mach
from .plans import rmap
from .plans.recipe import printed, relation
from .plans.rules import closure, cycle_core, derive, most_specifically
from .schema import Constraint, Machine, Rule, Transition
from .sources import replica
from .star import star_store, table
from .types import Domain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE[name or f.__name__] = sql
        return f

    return add


def recipe(name: str, form, columns: str, sql: str) -> None:
    """Register a recipe; columns names its result's columns."""
    names = columns.split()
    QUERIES[name] = lambda spark, d: star_store(spark, d).query(form).toDF(*names)
    ORACLE[name] = sql


# recipes

recipe("rec_sel", ["sel", "OrderHasStatus", 2, "F"], "o s", "SELECT o_orderkey AS o, o_orderstatus AS s FROM orders WHERE o_orderstatus = 'F'")
recipe("rec_sel_other_kind", ["sel", "OrderHasStatus", 2, 1], "o s", "SELECT o_orderkey AS o, o_orderstatus AS s FROM orders WHERE false")
recipe("rec_starts", ["starts", "PartHasType", 2, "P"], "p t", "SELECT p_partkey AS p, p_type AS t FROM part WHERE starts_with(p_type, 'P')")
recipe("rec_cmp", ["cmp", ["joinon", "CustomerInNation", "NationInRegion", [[2, 1]], [1, 2, 4]], 3, 2], "c n r", "SELECT c_custkey AS c, c_nationkey AS n, n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey < c_nationkey")
recipe("rec_proj", ["proj", "CustomerInNation", [2]], "n", "SELECT DISTINCT c_nationkey AS n FROM customer")
recipe("rec_proj_repeat", ["proj", "CustomerInNation", [2, 1, 2]], "n c n2", "SELECT DISTINCT c_nationkey AS n, c_custkey AS c, c_nationkey AS n2 FROM customer")
recipe("rec_join", ["join", "OrderPlacedByCustomer", "CustomerInNation", [1, 3]], "o n", "SELECT DISTINCT o_orderkey AS o, c_nationkey AS n FROM orders JOIN customer ON o_custkey = c_custkey")
recipe("rec_joinon", ["joinon", "SupplierInNation", "CustomerInNation", [[2, 2]], [1, 3]], "s c", "SELECT DISTINCT s_suppkey AS s, c_custkey AS c FROM supplier JOIN customer ON s_nationkey = c_nationkey")
recipe("rec_joinon_multi", ["joinon", "OrderShipsOn", "OrderHasDate", [[1, 1], [2, 2]], [1, 2]], "o d", "SELECT DISTINCT o_orderkey AS o, o_orderdate AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate = o_orderdate")
recipe("rec_cross", ["joinon", "NationInRegion", "RegionHasName", [], [1, 4]], "n r", "SELECT DISTINCT n_nationkey AS n, r_name AS r FROM nation, region")
recipe("rec_minus", ["minus", ["proj", "OrderHasTotal", [1]], ["proj", "OrderContainsPart", [1]]], "o", "SELECT o_orderkey AS o FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
recipe("rec_count", ["count", "OrderPlacedByCustomer", 2], "c n", "SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1")
QUERIES["rec_count_key2"] = lambda spark, d: star_store(spark, d).query(["flat", ["count", ["joinon", "CustomerInNation", "CustomerInSegment", [[1, 1]], [1, 2, 4]], ["CONS", 2, 3]]]).toDF("n", "s", "k")
ORACLE["rec_count_key2"] = "SELECT c_nationkey AS n, c_mktsegment AS s, count(*) AS k FROM customer GROUP BY 1, 2"
QUERIES["rec_sum"] = lambda spark, d: _money(star_store(spark, d).query(["sum", ["joinon", "OrderPlacedByCustomer", "OrderHasTotal", [[1, 1]], [1, 2, 4]], 2, 3]).toDF("c", "total"), "total")
ORACLE["rec_sum"] = "SELECT o_custkey AS c, round(sum(o_totalprice::DECIMAL(19,6)), 2)::DOUBLE AS total FROM orders GROUP BY 1"
QUERIES["rec_sum_key2"] = lambda spark, d: _money(star_store(spark, d).query(["flat", ["sum", ["joinon", "OrderHasStatus", ["joinon", "OrderHasPriority", "OrderHasTotal", [[1, 1]], [1, 2, 4]], [[1, 1]], [1, 2, 4, 5]], ["CONS", 2, 3], 4]]).toDF("s", "p", "total"), "total")
ORACLE["rec_sum_key2"] = "SELECT o_orderstatus AS s, o_orderpriority AS p, round(sum(o_totalprice::DECIMAL(19,6)), 2)::DOUBLE AS total FROM orders GROUP BY 1, 2"
_EVENT = ["joinon", "EventOfUser", "EventAt", [[1, 1]], [1, 2]]
for _op, _name, _sql in (("+", "add", "event_id + user_id"), ("-", "sub", "event_id - user_id"), ("*", "mul", "event_id * user_id")):
    recipe(f"rec_calc_{_name}", ["calc", "EventOfUser", _op, 1, 2], "e u r", f"SELECT event_id AS e, user_id AS u, ({_sql})::BIGINT AS r FROM events")
QUERIES["rec_calc_div"] = lambda spark, d: star_store(spark, d).query(["calc", "EventOfUser", "/", 1, 2]).toDF("e", "u", "r").withColumn("r", F.floor(F.col("r") * 1000).cast("bigint"))
ORACLE["rec_calc_div"] = "SELECT event_id AS e, user_id AS u, ((event_id * 1000) // user_id)::BIGINT AS r FROM events WHERE user_id <> 0"
QUERIES["rec_pow"] = lambda spark, d: star_store(spark, d).query(["calc", ["pairwith", "PartHasSize", 3], "^", 2, 3]).toDF("p", "s", "e", "r").select("p", "s", "r")
ORACLE["rec_pow"] = "SELECT p_partkey AS p, p_size AS s, (p_size::BIGINT * p_size * p_size) AS r FROM part"
def _digits(name: str, form, columns: str, sql: str, decimals: int) -> None:
    """Register a recipe whose last column is compared as a whole number of units of its last decimal."""
    *names, last = columns.split()
    QUERIES[name] = lambda spark, d: star_store(spark, d).query(form).toDF(*names, last).withColumn(last, F.regexp_replace(F.col(last).cast(f"decimal(38,{decimals})").cast("string"), "[.]", "").cast("decimal(38,0)").cast("string"))
    ORACLE[name] = sql


# quotients, rounded in the 13th decimal, of large dividends and of fine ones; products to the last digit
_digits("rec_calc_big", ["calc", ["proj", ["calc", ["pairwith", "EventOfUser", 10**13], "*", 1, 3], [1, 4, 2]], "/", 2, 3], "e a u r", "SELECT event_id AS e, event_id * 10000000000000 AS a, user_id AS u, ((event_id::HUGEINT * 10000000000000 * 10000000000000 * 2 + user_id) // (2 * user_id))::VARCHAR AS r FROM events WHERE user_id <> 0", 13)
_digits("rec_calc_fine", ["calc", ["pairwith", ["pairwith", "EventOfUser", 0.1234567891], 3], "/", 3, 4], "e u f t r", "SELECT event_id AS e, user_id AS u, 0.1234567891::DOUBLE AS f, 3 AS t, '411522630333' AS r FROM events", 13)
_digits("rec_calc_decimal", ["calc", ["pairwith", "OrderHasTotal", 0.0000123], "*", 2, 3], "o t f r", "SELECT o_orderkey AS o, o_totalprice AS t, 0.0000123::DOUBLE AS f, (round(o_totalprice::DECIMAL(18,2) * 100)::HUGEINT * 123)::VARCHAR AS r FROM orders", 9)
recipe("rec_pairwith", ["pairwith", ["proj", "NationInRegion", [1]], "nation"], "n k", "SELECT n_nationkey AS n, 'nation' AS k FROM nation")
recipe("rec_flat", ["flat", ["count", "SupplierSuppliesPart", ["CONS", 1]]], "s n", "SELECT l_suppkey AS s, count(*) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) GROUP BY 1")
recipe("rec_union", ["union", ["proj", "CustomerInNation", [2]], ["proj", ["sel", "NationInRegion", 2, 1], [1]]], "n", "SELECT c_nationkey AS n FROM customer UNION SELECT n_nationkey FROM nation WHERE n_regionkey = 1")


def _money(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 2).cast("double") for c in cols})


@query("SELECT c_nationkey AS nation, n_name AS name, round(sum(o_totalprice::DECIMAL(19,6)), 2)::DOUBLE AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def flagship(spark, d):
    """Order totals by nation: a sum over a join of facts, the customer's nation reached in two steps."""
    store = star_store(spark, d)
    by_nation = ["joinon", ["join", "OrderPlacedByCustomer", "CustomerInNation", [1, 3]], "OrderHasTotal", [[1, 1]], [1, 2, 4]]
    named = ["joinon", ["sum", by_nation, 2, 3], "NationHasName", [[1, 1]], [1, 4, 2]]
    return _money(store.query(named).toDF("nation", "name", "total"), "total")


# sets and lists


def _nations(spark, d, who):
    """Nations of suppliers with much money, or of customers with debts."""
    t, c, condition = {"s": ("supplier", "s_nationkey", "s_acctbal > 7000"), "c": ("customer", "c_nationkey", "c_acctbal < -900")}[who]
    return table(spark, d, t).where(condition).select(F.col(c).alias("n")).distinct()


_S, _C = "SELECT s_nationkey AS n FROM supplier WHERE s_acctbal > 7000", "SELECT c_nationkey AS n FROM customer WHERE c_acctbal < -900"
QUERIES["set_union"] = lambda spark, d: sets.union(_nations(spark, d, "s"), _nations(spark, d, "c"))
ORACLE["set_union"] = f"{_S} UNION {_C}"
QUERIES["set_inter"] = lambda spark, d: sets.inter(_nations(spark, d, "s"), _nations(spark, d, "c"))
ORACLE["set_inter"] = f"{_S} INTERSECT {_C}"
QUERIES["set_minus"] = lambda spark, d: sets.minus(_nations(spark, d, "s"), _nations(spark, d, "c"))
ORACLE["set_minus"] = f"{_S} EXCEPT {_C}"
QUERIES["set_seteq"] = lambda spark, d: sets.seteq(_nations(spark, d, "s"), _nations(spark, d, "c"))
ORACLE["set_seteq"] = f"SELECT NOT EXISTS (({_S}) EXCEPT ({_C})) AND NOT EXISTS (({_C}) EXCEPT ({_S})) AS equal"
QUERIES["theta_setminus"] = lambda spark, d: sets.setminus(table(spark, d, "customer").select("c_nationkey"), table(spark, d, "nation").where("n_regionkey = 2").select("n_nationkey"))
ORACLE["theta_setminus"] = "SELECT c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)"
QUERIES["theta_tie"] = lambda spark, d: sets.tie(table(spark, d, "lineitem").select("l_linenumber", "l_orderkey", F.col("l_quantity").cast("int").alias("q")))
ORACLE["theta_tie"] = "SELECT l_linenumber, l_orderkey, l_quantity::INT AS q FROM lineitem WHERE l_linenumber = l_quantity::INT"
QUERIES["theta_natjoin"] = lambda spark, d: sets.natjoin(table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "nation"), "c_nationkey")
ORACLE["theta_natjoin"] = "SELECT c_custkey, c_nationkey, n_name, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey"
QUERIES["theta_member"] = lambda spark, d: sets.member(table(spark, d, "nation").select("n_nationkey"), _nations(spark, d, "s"))
ORACLE["theta_member"] = f"SELECT n_nationkey, CASE WHEN n_nationkey IN ({_S}) THEN 'T' ELSE 'F' END AS is_member FROM nation"
QUERIES["theta_count_rows"] = lambda spark, d: sets.count_rows(table(spark, d, "orders"), F.year("o_orderdate").alias("y"))
ORACLE["theta_count_rows"] = "SELECT year(o_orderdate)::INT AS y, count(*) AS n FROM orders GROUP BY 1"
QUERIES["theta_rows_for"] = lambda spark, d: sets.rows_for(table(spark, d, "nation").select("n_nationkey", "n_regionkey"), 2, 2)
ORACLE["theta_rows_for"] = "SELECT n_nationkey, n_regionkey FROM nation WHERE n_regionkey = 2"
QUERIES["theta_lookup"] = lambda spark, d: sets.lookup(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id", "quality").toDF("k", "v"), "doc_id", 999999)
ORACLE["theta_lookup"] = "SELECT doc_id, coalesce(quality, 999999) AS value FROM documents LEFT JOIN labels USING (doc_id)"
QUERIES["theta_nest"] = lambda spark, d: sets.nest(table(spark, d, "nation").select("n_regionkey", "n_nationkey")).select("n_regionkey", F.array_join(F.transform("rest", lambda x: x["n_nationkey"].cast("string")), ",").alias("nations"))
ORACLE["theta_nest"] = "SELECT n_regionkey, string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey) AS nations FROM nation GROUP BY 1"
QUERIES["theta_unnest"] = lambda spark, d: sets.unnest(sets.nest(table(spark, d, "nation").select("n_regionkey", "n_nationkey", "n_name")))
ORACLE["theta_unnest"] = "SELECT n_regionkey, n_nationkey, n_name FROM nation"
QUERIES["theta_merge_cells"] = lambda spark, d: sets.merge_cells(table(spark, d, "customer").select("c_nationkey", F.array("c_custkey").alias("keys")), "c_nationkey", "keys").select("c_nationkey", F.array_join(F.col("keys").cast("array<string>"), ",").alias("keys"))
ORACLE["theta_merge_cells"] = "SELECT c_nationkey, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) AS keys FROM customer GROUP BY 1"
QUERIES["theta_wide_row"] = lambda spark, d: sets.wide_row(table(spark, d, "documents").select("doc_id"), {"quality": table(spark, d, "labels").select("doc_id", "quality"), "toxic": table(spark, d, "labels").where("toxic = 1").select("doc_id", "toxic")})
ORACLE["theta_wide_row"] = "SELECT doc_id, quality, CASE WHEN toxic = 1 THEN 1 END AS toxic FROM documents LEFT JOIN labels USING (doc_id)"


def _numbers(spark, d):
    """An array of numbers with repeats for each order: line numbers in a fixed order."""
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.col("l_linenumber"))).alias("xs"))


def _list_query(name: str, f, sql: str) -> None:
    QUERIES[name] = lambda spark, d: _numbers(spark, d).select("l_orderkey", f(F.col("xs")).alias("r"))
    ORACLE[name] = f"WITH l AS (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) AS xs FROM lineitem GROUP BY 1) SELECT l_orderkey, {sql} AS r FROM l"


def _text(xs):
    return F.array_join(xs.cast("array<string>"), ",")


_list_query("list_dedup", lambda x: _text(sets.dedup_sorted(x)), "array_to_string(list_sort(list_distinct(xs)), ',')")
_list_query("list_take", lambda x: _text(sets.take(x, 2)), "array_to_string(xs[1:2], ',')")
_list_query("list_drop", lambda x: _text(sets.drop(x, 2)), "array_to_string(xs[3:], ',')")
_list_query("list_butlast", lambda x: _text(sets.butlast(x)), "array_to_string(xs[1:len(xs) - 1], ',')")
_list_query("list_last", lambda x: sets.last(x.cast("array<string>")), "xs[-1]::VARCHAR")
_list_query("list_iota", lambda x: _text(sets.iota(F.size(x))), "array_to_string(range(1, len(xs) + 1), ',')")
_list_query("list_zip", lambda x: F.size(sets.zipped(x, sets.drop(x, 1))), "(len(xs) - 1)::INT")
_list_query("ffp_reverse", lambda x: _text(ffp.reverse(x)), "array_to_string(list_reverse(xs), ',')")
_list_query("ffp_tl", lambda x: _text(ffp.tl(x)), "array_to_string(xs[2:], ',')")
_list_query("ffp_apnd", lambda x: _text(ffp.apndl(F.lit(0), ffp.apndr(x, F.lit(99)))), "array_to_string(list_concat([0], xs, [99]), ',')")
_list_query("ffp_alpha", lambda x: _text(ffp.alpha(lambda e: ffp.mul(e, F.lit(3)))(x)), "array_to_string([e * 3 for e in xs], ',')")
_list_query("ffp_insert", lambda x: ffp.insert(ffp.sub)(x.cast("array<bigint>")), "list_reduce(list_reverse([e::BIGINT for e in xs]), lambda a, e: e - a)")
_list_query("ffp_cond", lambda x: ffp.cond(lambda y: F.size(y) > 3, ffp.comp(ffp.select(1), ffp.reverse), ffp.select(1))(x), "CASE WHEN len(xs) > 3 THEN xs[-1] ELSE xs[1] END")
_list_query("ffp_trans", lambda x: F.array_join(F.transform(ffp.trans(F.array(x, ffp.reverse(x))), lambda r: _text(r)), ";"), "array_to_string([xs[i]::VARCHAR || ',' || xs[len(xs) + 1 - i]::VARCHAR for i in range(1, len(xs) + 1)], ';')")
_list_query("ffp_distl", lambda x: F.array_join(F.transform(ffp.distl(F.lit(7), x), lambda p: F.concat_ws("-", p["a"], p["b"])), ","), "array_to_string(['7-' || e::VARCHAR for e in xs], ',')")
_list_query("ffp_div", lambda x: ffp.div(F.lit(-7), F.size(x)), "(-7 // len(xs))::BIGINT")

# aggregates


@query("SELECT c_nationkey AS nation, arg_max(c_custkey, (c_acctbal, c_custkey)) AS customer, max(c_acctbal) AS balance FROM customer GROUP BY 1")
def agg_superlative_max(spark, d):
    return sets.extreme(table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("customer"), F.col("c_acctbal").alias("balance")), "nation", "balance", highest=True)


@query("SELECT c_nationkey AS nation, arg_min(c_custkey, (c_acctbal, c_custkey)) AS customer, min(c_acctbal) AS balance FROM customer GROUP BY 1")
def agg_superlative_min(spark, d):
    return sets.extreme(table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("customer"), F.col("c_acctbal").alias("balance")), "nation", "balance", highest=False)


@query("SELECT o_custkey AS customer, round(count(*) FILTER (o_orderstatus = 'F')::DOUBLE / count(*), 6) AS ratio FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderstatus = 'F') > 0")
def agg_ratio_of_counts(spark, d):
    placed = "OrderPlacedByCustomer"
    done = ["count", ["joinon", placed, ["sel", "OrderHasStatus", 2, "F"], [[1, 1]], [1, 2]], 2]
    both = ["calc", ["joinon", done, ["count", placed, 2], [[1, 1]], [1, 2, 4]], "/", 2, 3]
    return star_store(spark, d).query(both).toDF("customer", "done", "n", "ratio").select("customer", F.round(F.col("ratio").cast("double"), 6).alias("ratio"))


@query("SELECT o_custkey AS customer, round(sum(o_totalprice::DECIMAL(19,6)), 2)::DOUBLE AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey, c_acctbal HAVING c_acctbal::DECIMAL(19,6) * 100 < sum(o_totalprice::DECIMAL(19,6))")
def agg_over_threshold(spark, d):
    total = ["sum", ["joinon", "OrderPlacedByCustomer", "OrderHasTotal", [[1, 1]], [1, 2, 4]], 2, 3]
    limit = ["calc", ["pairwith", "CustomerHasBalance", 100], "*", 2, 3]
    over = ["cmp", ["joinon", limit, total, [[1, 1]], [1, 4, 6]], 2, 3]
    return _money(star_store(spark, d).query(over).toDF("customer", "limit", "total").select("customer", "total"), "total")


@query("SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)")
def agg_count_kept_with_rows(spark, d):
    return sets.with_counts(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct(), "l_orderkey")


@query("SELECT user_id AS u, event_id AS e, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS position FROM events")
def win_auto_position(spark, d):
    return sets.next_positions(table(spark, d, "events").select(F.col("user_id").alias("u"), F.col("event_id").alias("e"), "ts"), ["u"], ["ts", "e"]).drop("ts")


@query("SELECT o_orderkey AS o, o_totalprice AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def top_list(spark, d):
    return replica.listed(table(spark, d, "orders").select(F.col("o_orderkey").alias("o"), F.col("o_totalprice").alias("total")), sort="total", descending=True, limit=50)


# constraints

@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)) WHERE n > 1")
def uc_internal(spark, d):
    return con.uniqueness(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct(), ["l_orderkey", "l_linenumber"])


@query("SELECT k, name, seg FROM (SELECT c_custkey AS k, c_nationkey AS name, c_mktsegment AS seg, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS n FROM customer) WHERE n > 1")
def uc_external(spark, d):
    c = table(spark, d, "customer")
    return con.external_uniqueness([c.select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("name")), c.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"))], "k", ["name", "seg"])


@query("SELECT o_orderkey AS o FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def mc_simple(spark, d):
    return con.mandatory(table(spark, d, "orders").select(F.col("o_orderkey").alias("o")), [table(spark, d, "lineitem").select("l_orderkey")])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND lang <> 'en'")
def mc_disjunctive(spark, d):
    docs = table(spark, d, "documents")
    return con.mandatory(docs.select("doc_id"), [table(spark, d, "labels").select("doc_id"), docs.where("lang = 'en'").select("doc_id")])


@query("WITH r AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem) SELECT o, p FROM (SELECT *, count(*) OVER (PARTITION BY o) AS n FROM r) WHERE n < 2 OR n > 7")
def fc_bounds(spark, d):
    return con.frequency(star_store(spark, d).facts("OrderContainsPart").toDF("o", "p"), ["o"], 2, 7)


@query("SELECT count(*) AS n FROM nation HAVING count(*) < 30")
def cc_bounds(spark, d):
    return con.cardinality(table(spark, d, "nation").select("n_nationkey"), 30, None)


@query("SELECT n_nationkey AS n FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def ss_subset(spark, d):
    return con.subset(table(spark, d, "nation").select(F.col("n_nationkey").alias("n")), table(spark, d, "supplier").where("s_acctbal > 5000").select("s_nationkey"))


@query("SELECT DISTINCT c_custkey AS c, s_suppkey AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey")
def ss_joinpath(spark, d):
    """Who buys from a supplier is of its nation: the argument joins three fact types, whatever order they are given in."""
    store = star_store(spark, d)
    left = con.joined_path(store, [("OrderFromSupplier", ("o", "s")), ("CustomerInNation", ("c", "n")), ("OrderPlacedByCustomer", ("o", "c"))], ("c", "s"))
    right = con.joined_path(store, [("CustomerInNation", ("c", "n")), ("SupplierInNation", ("s", "n"))], ("c", "s"), within=left)
    return con.subset(left, right)


@query(f"(({_S}) EXCEPT ({_C})) UNION (({_C}) EXCEPT ({_S}))")
def eq_equality(spark, d):
    return con.equality(_nations(spark, d, "s"), _nations(spark, d, "c"))


@query(f"({_S}) INTERSECT ({_C})")
def xc_exclusion(spark, d):
    return con.exclusion([_nations(spark, d, "s"), _nations(spark, d, "c")])


@query("SELECT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'N'")
def xc_pairs(spark, d):
    df = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"), "l_returnflag")
    return con.exclusion([df.where(f"l_returnflag = '{x}'").select("o", "p") for x in "RN"])


@query(f"SELECT n_nationkey AS n FROM nation WHERE (n_nationkey IN ({_S})) = (n_nationkey IN ({_C}))")
def xo_exactly_one(spark, d):
    return con.exactly_one(table(spark, d, "nation").select(F.col("n_nationkey").alias("n")), [_nations(spark, d, "s"), _nations(spark, d, "c")])


_EDGES = "SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem"
#: What contains what: region, nation, customer, order, line.
_TREE = (
    "SELECT 'r' || n_regionkey AS a, 'n' || n_nationkey AS b FROM nation UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer "
    "UNION SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders UNION SELECT 'o' || l_orderkey, 'l' || l_orderkey || '.' || l_linenumber FROM lineitem"
)


def _edges(spark, d):
    """Supplier numbers and the part numbers they supply, as one relation over numbers."""
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).distinct()


def _tree(spark, d):
    def pairs(name, x, a, y, *b):
        return table(spark, d, name).select(F.concat(F.lit(x), F.col(a).cast("string")).alias("a"), F.concat(F.lit(y), F.concat_ws(".", *b)).alias("b"))

    parts = [pairs("nation", "r", "n_regionkey", "n", "n_nationkey"), pairs("customer", "n", "c_nationkey", "c", "c_custkey"), pairs("orders", "c", "o_custkey", "o", "o_orderkey"), pairs("lineitem", "o", "l_orderkey", "l", "l_orderkey", "l_linenumber")]
    return sets.union(*parts)


for _adj, _sql in {
    "irreflexive": "SELECT a, b FROM e WHERE a = b",
    "asymmetric": "SELECT a, b FROM e WHERE EXISTS (SELECT 1 FROM e f WHERE f.a = e.b AND f.b = e.a)",
    "antisymmetric": "SELECT a, b FROM e WHERE a <> b AND EXISTS (SELECT 1 FROM e f WHERE f.a = e.b AND f.b = e.a)",
    "symmetric": "SELECT a, b FROM e WHERE NOT EXISTS (SELECT 1 FROM e f WHERE f.a = e.b AND f.b = e.a)",
    "intransitive": "SELECT a, b FROM e INTERSECT SELECT x.a, y.b FROM e x JOIN e y ON x.b = y.a",
    "transitive": "SELECT x.a, y.b FROM e x JOIN e y ON x.b = y.a EXCEPT SELECT a, b FROM e",
    "reflexive": "SELECT DISTINCT a, a AS b FROM e EXCEPT SELECT a, b FROM e",
}.items():
    query(f"WITH e AS ({_EDGES}) {_sql}", f"ring_{_adj}")(lambda spark, d, _adj=_adj: con.RINGS[_adj](_edges(spark, d)))


@query(f"WITH RECURSIVE e AS ({_EDGES}), c(a, b) AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT a, b FROM e WHERE EXISTS (SELECT 1 FROM c WHERE c.a = e.b AND c.b = e.a)")
def ring_acyclic(spark, d):
    return con.acyclic(_edges(spark, d))


for _name, _op, _sql in (("lt", "<", ">="), ("le", "<=", ">"), ("ge", ">=", "<"), ("ne", "<>", "=")):
    query(f"SELECT DISTINCT o_orderkey AS o, o_orderdate AS placed, l_shipdate AS shipped FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderdate {_sql} l_shipdate", f"vc_{_name}")(
        lambda spark, d, _op=_op: con.value_comparison(star_store(spark, d).query(["joinon", "OrderHasDate", "OrderShipsOn", [[1, 1]], [1, 2, 4]]).toDF("o", "placed", "shipped"), "placed", _op, "shipped")
    )


@query("SELECT o_orderkey AS o, o_orderstatus AS s FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def value_enum(spark, d):
    return con.value_domain(star_store(spark, d).facts("OrderHasStatus").toDF("o", "s"), "s", Domain("text", values=("F", "O")))


@query("SELECT c_custkey AS c, c_acctbal AS b FROM customer WHERE NOT (c_acctbal >= 0 AND c_acctbal < 9000)")
def value_range(spark, d):
    return con.value_domain(star_store(spark, d).facts("CustomerHasBalance").toDF("c", "b"), "b", Domain("unspecified", ranges=((0, True, 9000, False),)))


@query("SELECT p_partkey AS p, p_name AS n FROM part WHERE NOT regexp_full_match(p_name, '[a-m][a-z]* .*')")
def value_pattern(spark, d):
    return con.value_domain(star_store(spark, d).facts("PartHasName").toDF("p", "n"), "n", Domain("text", pattern="[a-m][a-z]* .*"))


@query("SELECT p_partkey AS p, p_brand AS b FROM part WHERE try_cast(p_brand AS BIGINT) IS NULL")
def value_type(spark, d):
    return con.value_domain(star_store(spark, d).facts("PartHasBrand").toDF("p", "b"), "b", Domain("integer"))


@query("SELECT doc_id, toxic FROM labels WHERE toxic = 1 AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def deontic_recipe(spark, d):
    return con.forbidden(star_store(spark, d).query(["joinon", ["sel", "DocumentHasToxicity", 2, 1], ["sel", "DocumentHasQuality", 2, 1], [[1, 1]], [1, 2]]).toDF("doc_id", "toxic"))


@query("SELECT doc_id FROM documents WHERE (contains(lower(text), 'license')::INT + contains(lower(text), 'public')::INT + contains(lower(text), 'version')::INT) * 2 > 3")
def deontic_keywords(spark, d):
    return table(spark, d, "documents").where(con.co_occurrence(F.col("text"), ["License", "public", "version"])).select("doc_id")


@query("SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'T' WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0) THEN 'F' END AS truth FROM documents")
def negation_open_world(spark, d):
    labels = table(spark, d, "labels")
    return con.truth(table(spark, d, "documents").select("doc_id"), labels.where("toxic = 1").select("doc_id"), labels.where("toxic = 0").select("doc_id"), open_world=True)


@query("SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'T' ELSE 'F' END AS truth FROM documents")
def negation_closed_world(spark, d):
    labels = table(spark, d, "labels")
    return con.truth(table(spark, d, "documents").select("doc_id"), labels.where("toxic = 1").select("doc_id"), None, open_world=False)


STAR_CONSTRAINTS = (
    Constraint("orders-have-lines", "mandatory", (["proj", "OrderHasTotal", [1]], [["proj", "OrderContainsPart", [1]]])),
    Constraint("status-is-known", "domain", ("OrderHasStatus", 2, Domain("text", values=("F", "O")))),
    Constraint("no-toxic-good-text", "prohibition", (["joinon", ["sel", "DocumentHasToxicity", 2, 1], ["sel", "DocumentHasQuality", 2, 1], [[1, 1]], [1]],), "deontic"),
)


@query(
    "SELECT 'orders-have-lines' AS \"constraint\", 'alethic' AS modality, o_orderkey::VARCHAR AS binding FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) "
    "UNION ALL SELECT 'status-is-known', 'alethic', o_orderkey::VARCHAR || ',' || o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('F', 'O') "
    "UNION ALL SELECT 'no-toxic-good-text', 'deontic', doc_id::VARCHAR FROM labels WHERE toxic = 1 AND quality = 1"
)
def validate_all(spark, d):
    return con.violations(star_store(spark, d), STAR_CONSTRAINTS).withColumn("binding", F.array_join("binding", ","))


# rules


def _derived(head: str, arms, columns: str, sql: str, marking: str = "*", more: tuple = ()):
    names = columns.split()

    def run(spark, d):
        return derive(star_store(spark, d), [Rule(head, tuple(arms), marking), *more], only=[head]).facts(head).toDF(*names)

    return run, sql


for _name, (_run, _sql) in {
    "rule_mp": _derived("CustomerIsOfNation", ["CustomerInNation"], "c n", "SELECT c_custkey AS c, c_nationkey AS n FROM customer"),
    "rule_join": _derived("OrderInRegion", [["join", ["join", "OrderPlacedByCustomer", "CustomerInNation", [1, 3]], "NationInRegion", [1, 3]]], "o r", "SELECT o_orderkey AS o, n_regionkey AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"),
    "rule_neg": _derived("OrderIsEmpty", [["minus", ["proj", "OrderHasTotal", [1]], ["proj", "OrderContainsPart", [1]]]], "o", "SELECT o_orderkey AS o FROM orders EXCEPT SELECT l_orderkey FROM lineitem"),
    "rule_union": _derived("NationTrades", [["proj", "CustomerInNation", [2]], ["proj", "SupplierInNation", [2]]], "n", "SELECT c_nationkey AS n FROM customer UNION SELECT s_nationkey FROM supplier"),
    "rule_const": _derived("OrderHasLabel", [["pairwith", ["proj", ["sel", "OrderHasStatus", 2, "F"], [1]], "finished"]], "o l", "SELECT o_orderkey AS o, 'finished' AS l FROM orders WHERE o_orderstatus = 'F'"),
    "rule_agg": _derived("CustomerHasOrderCount", [["count", "OrderPlacedByCustomer", 2]], "c n", "SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1"),
    "rule_calc": _derived("EventHasDouble", [["proj", ["calc", ["pairwith", "EventOfUser", 2], "*", 2, 3], [1, 4]]], "e x", "SELECT event_id AS e, user_id * 2 AS x FROM events"),
    "rule_semi": _derived("NationInRegion", [["pairwith", ["proj", ["sel", "SupplierInNation", 2, 3], [2]], 99]], "n r", "SELECT n_nationkey AS n, n_regionkey AS r FROM nation UNION SELECT s_nationkey, 99 FROM supplier WHERE s_nationkey = 3", "+"),
    "rule_chain": _derived(
        "BusyNation",
        [["cmp", ["pairwith", ["count", ["joinon", "CustomerInNation", "BusyCustomer", [[1, 1]], [1, 2]], 2], 10**6], 2, 3]],
        "n k limit",
        "SELECT c_nationkey AS n, count(*) AS k, 1000000 AS limit FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 9) GROUP BY 1",
        more=(Rule("BusyCustomer", (["proj", ["cmp", ["proj", ["pairwith", ["count", "OrderPlacedByCustomer", 2], 9], [1, 3, 2]], 2, 3], [1]],)),),
    ),
    "stratified_negation": _derived(
        "IdleNation",
        [["minus", ["proj", "NationInRegion", [1]], "ActiveNation"]],
        "n",
        "SELECT n_nationkey AS n FROM nation EXCEPT SELECT c_nationkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 499500 AND o_orderstatus = 'P'",
        more=(Rule("ActiveNation", (["proj", ["joinon", ["joinon", "OrderPlacedByCustomer", ["joinon", ["cmp", ["pairwith", "OrderHasTotal", 499500.0], 3, 2], ["sel", "OrderHasStatus", 2, "P"], [[1, 1]], [1]], [[1, 1]], [1, 2]], "CustomerInNation", [[2, 1]], [1, 2, 4]], [3]],)),),
    ),
}.items():
    query(_sql, _name)(_run)

_REACH = "WITH RECURSIVE e AS ({}), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a, b FROM r"


def _with_edges(spark, d):
    return star_store(spark, d).with_facts(Edge=relation(_tree(spark, d), (1, 2)))


@query(_REACH.format(_TREE))
def closure_linear(spark, d):
    return derive(_with_edges(spark, d), [Rule("Reaches", ("Edge", ["joinon", "Reaches#base", "Edge", [[2, 1]], [1, 4]]))]).facts("Reaches").toDF("a", "b")


@query(_REACH.format(_TREE))
def closure_nonlinear(spark, d):
    return derive(_with_edges(spark, d), [Rule("Reaches", ("Edge", ["joinon", "Reaches", "Reaches", [[2, 1]], [1, 4]]))]).facts("Reaches").toDF("a", "b")


@query(_REACH.format(_TREE))
def closure_doubling(spark, d):
    return closure(_tree(spark, d)).toDF("a", "b")


@query(f"WITH RECURSIVE e AS ({_TREE}), r(a, b, odd) AS (SELECT a, b, true FROM e UNION SELECT r.a, e.b, NOT r.odd FROM r JOIN e ON r.b = e.a) SELECT a, b FROM r WHERE NOT odd")
def closure_mutual(spark, d):
    """Pairs that an even number of steps connects: two heads that derive each other."""
    step = [[2, 1]]
    rules = [Rule("Odd", ("Edge", ["joinon", "Even", "Edge", step, [1, 4]])), Rule("Even", (["joinon", "Odd", "Edge", step, [1, 4]],))]
    return derive(_with_edges(spark, d), rules).facts("Even").toDF("a", "b")


@query(f"WITH RECURSIVE e AS ({_EDGES}), f(a, b) AS (SELECT a, b FROM e UNION SELECT f.a, e.b FROM f JOIN e ON f.b = e.a) SELECT a, b FROM e WHERE (a IN (SELECT a FROM f WHERE a = b) OR EXISTS (SELECT 1 FROM f WHERE f.b = e.a AND f.a IN (SELECT a FROM f WHERE a = b))) AND (b IN (SELECT a FROM f WHERE a = b) OR EXISTS (SELECT 1 FROM f WHERE f.a = e.b AND f.b IN (SELECT a FROM f WHERE a = b)))", "cycle_core")
def _cycle_core(spark, d):
    return cycle_core(_edges(spark, d)).toDF("a", "b")


@query("SELECT 'c' || c_custkey AS party FROM customer UNION ALL SELECT 's' || s_suppkey FROM supplier")
def subtype_inherit(spark, d):
    """Population of a supertype: the union of its subtypes' populations."""
    store = star_store(spark, d).with_facts(
        CustomerInNation=relation(table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey"), "c_nationkey"), (1,)),
        SupplierInNation=relation(table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey"), "s_nationkey"), (1,)),
    )
    few = type(store)(spark, {f: store.relation(f) for f in ("CustomerInNation", "SupplierInNation")}, store.schema)
    return few.instances("Party").toDF("party")


@query(f"WITH RECURSIVE e AS ({_TREE}), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a, b FROM r EXCEPT SELECT x.a, y.b FROM r x JOIN r y ON x.b = y.a")
def most_specific(spark, d):
    """What most specifically contains each thing: of all that contain it, directly or not, the ones that contain no other."""
    return most_specifically(closure(_tree(spark, d))).toDF("a", "b")


# machines over events

USER = Machine(
    "user-life",
    "User",
    (
        Transition("join", "New", "Active", "signup"),
        Transition("look", "Active", "Engaged", "view"),
        Transition("press", "Active", "Engaged", "click"),
        Transition("buy", "Engaged", "Customer", "purchase"),
        Transition("fail", "Engaged", "Troubled", "error"),
        Transition("again", "Troubled", "Active", "signup"),
        Transition("leave", "Customer", "Gone", "error"),
    ),
    initial="New",
)
_FOLD = """
WITH RECURSIVE t(s, e, n) AS (VALUES {moves}),
o AS (SELECT user_id AS u, event_type AS e, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events{where}),
f(u, k, s) AS (SELECT DISTINCT u, 0::BIGINT, '{start}' FROM o UNION ALL SELECT f.u, f.k + 1, coalesce(t.n, f.s) FROM f JOIN o ON o.u = f.u AND o.k = f.k + 1 LEFT JOIN t ON t.s = f.s AND t.e = o.e)
"""


def _fold_sql(m: Machine, select: str, where: str = "") -> str:
    """The fold of a plain machine, whose transitions are used as declared."""
    rows = ", ".join(f"('{t.source}', '{t.trigger}', '{t.target}')" for t in m.transitions if t.guard is None)
    return _FOLD.format(moves=rows, where=where, start=m.start()) + select


_LAST = "SELECT u AS user_id, arg_max(s, k) AS status FROM f GROUP BY u"


@query(_fold_sql(USER, _LAST))
def sm_status(spark, d):
    return mach.fold(table(spark, d, "events"), USER, entity="user_id", event="event_type", order=["ts", "event_id"])


@query(_fold_sql(USER, _LAST))
def sm_status_chunked(spark, d):
    return mach.fold(table(spark, d, "events"), USER, entity="user_id", event="event_type", order=["ts", "event_id"], chunk=20)


SHOP = Machine(
    "visit",
    "User",
    (Transition("enter", "Out", "In", "signup"), Transition("done", "In", "Done", "purchase"), Transition("broken", "In", "Out", "error")),
    initial="Out",
    subs={"In": Machine("inside", "User", (Transition("see", "Browsing", "Looking", "view"), Transition("choose", "Looking", "Chosen", "click"), Transition("back", "Looking", "Browsing", "error")), initial="Browsing")},
)


#: What SHOP's transitions come to, worked out by hand: inside In its own transitions go first, and In's hold everywhere.
SHOP_BY_HAND = (
    ("Out", "signup", "Browsing"),
    ("Browsing", "view", "Looking"),
    ("Browsing", "purchase", "Done"),
    ("Browsing", "error", "Out"),
    ("Looking", "click", "Chosen"),
    ("Looking", "error", "Browsing"),
    ("Looking", "purchase", "Done"),
    ("Chosen", "purchase", "Done"),
    ("Chosen", "error", "Out"),
)


@query(_FOLD.format(moves=", ".join(map(str, SHOP_BY_HAND)), where="", start="Out") + _LAST)
def sm_harel(spark, d):
    return mach.fold(table(spark, d, "events"), SHOP, entity="user_id", event="event_type", order=["ts", "event_id"])


GUARDED = Machine("careful", "User", (Transition("join", "New", "Active", "signup"), Transition("buy", "Active", "Customer", "purchase", guard="BigValue"), Transition("fail", "Customer", "New", "error")), initial="New")


_UNGUARDED = Machine("careful", "User", tuple(Transition(t.name, t.source, t.target, t.trigger) for t in GUARDED.transitions), initial="New")


@query(_fold_sql(_UNGUARDED, _LAST, " WHERE event_type <> 'purchase' OR value > 50"))
def sm_guarded(spark, d):
    """A guard that fails leaves the status, as if the event weren't there."""
    events = table(spark, d, "events").withColumn("big", F.col("value") > 50)
    return mach.fold(events, GUARDED, entity="user_id", event="event_type", order=["ts", "event_id"], guards={"BigValue": "big"})


@query(
    _fold_sql(_UNGUARDED, "SELECT f.u AS entity, e.event_id, f.s AS \"from\", t.n AS \"to\" FROM (SELECT u, arg_max(s, k) AS s FROM f GROUP BY u) f JOIN events e ON e.user_id = f.u JOIN t ON t.s = f.s AND t.e = e.event_type WHERE e.event_type <> 'purchase' OR e.value > 50", " WHERE event_type <> 'purchase' OR value > 50")
)
def sm_moves_guarded(spark, d):
    """What each event would do to its user as it stands now; a guarded transition needs its guard."""
    events = table(spark, d, "events").select(F.col("user_id").alias("entity"), F.col("event_type").alias("trigger"), "event_id", (F.col("value") > 50).alias("big"))
    held = sm_guarded(spark, d).toDF("entity", "status")
    each = [mach.moves(held, GUARDED, events.where(F.col("trigger") == t), {"BigValue": "big"}).withColumn("trigger", F.lit(t)) for t in ("signup", "purchase", "error")]
    moved = sets.union(*each)
    return events.where("trigger <> 'purchase' or big").select("entity", "event_id", "trigger").join(moved, ["entity", "trigger"]).select("entity", "event_id", "from", "to")


@query(_fold_sql(_UNGUARDED, "SELECT x.u AS entity, x.s AS status, t.e AS \"trigger\", t.n AS target FROM (SELECT u, arg_max(s, k) AS s FROM f GROUP BY u) x JOIN (SELECT DISTINCT * FROM t) t ON t.s = x.s WHERE t.e <> 'purchase' OR x.u IN (SELECT user_id FROM events WHERE value > 99)", " WHERE event_type <> 'purchase' OR value > 50"))
def sm_actions_guarded(spark, d):
    """Links of the statuses; a guarded one for entities of which the guard holds."""
    rich = table(spark, d, "events").where("value > 99").select("user_id")
    return mach.available(sm_guarded(spark, d).withColumnRenamed("user_id", "entity"), GUARDED, {"BigValue": rich})


@query(_fold_sql(USER, "SELECT u AS user_id, arg_max(s, k) AS status FROM f GROUP BY u HAVING arg_max(s, k) <> 'Gone'"))
def sm_terminal_hidden(spark, d):
    status = sm_status(spark, d)
    gone = spark.createDataFrame([(s,) for s in mach.terminal(USER)], "status string")
    return status.join(F.broadcast(gone), "status", "left_anti").select("user_id", "status")


@query(_fold_sql(USER, "SELECT DISTINCT x.u AS entity, x.s AS status, t.e AS \"trigger\", t.n AS target FROM (SELECT u, arg_max(s, k) AS s FROM f GROUP BY u) x JOIN t ON t.s = x.s"))
def sm_actions(spark, d):
    return mach.available(sm_status(spark, d).withColumnRenamed("user_id", "entity"), USER)


@query("SELECT * FROM (VALUES " + ", ".join(map(str, SHOP_BY_HAND)) + ') v(source, "trigger", target)')
def sm_effective(spark, d):
    return mach.effective_frame(spark, SHOP).select("source", "trigger", "target")


@query(_fold_sql(USER, "SELECT f.u AS user_id, e.event_id, f.s AS before, coalesce(t.n, f.s) AS after FROM f JOIN (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) e ON e.user_id = f.u AND e.k = f.k + 1 LEFT JOIN t ON t.s = f.s AND t.e = e.event_type"))
def sm_history(spark, d):
    return mach.history(table(spark, d, "events"), USER, entity="user_id", event="event_type", order=["ts", "event_id"]).select("user_id", "event_id", "before", "after")


@query("WITH RECURSIVE e(a, b) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in sorted({(t.source, t.target) for t in USER.transitions})) + "), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a, b FROM r")
def sm_reaches(spark, d):
    t = mach.effective_frame(spark, USER)
    return closure(t.select("source", "target").distinct()).toDF("a", "b")


# scalars


def _scalar(name: str, source: str, key: str, f, sql: str) -> None:
    QUERIES[name] = lambda spark, d: table(spark, d, source).select(key, f().alias("r"))
    ORACLE[name] = f"SELECT {key}, {sql} AS r FROM {source}"


_scalar("fn_slug", "part", "p_partkey", lambda: scalars.slug(F.col("p_name")), "trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-')")
_scalar("fn_strip_prefix", "customer", "c_custkey", lambda: scalars.strip_prefix(F.col("c_name"), "Customer"), "CASE WHEN starts_with(c_name, 'Customer') THEN c_name[9:] ELSE c_name END")
_scalar("fn_escape_html", "benchmark", "item_id", lambda: scalars.escape_html(F.col("text")), "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')")
_scalar("fn_round", "customer", "c_custkey", lambda: scalars.rounded(F.col("c_acctbal").cast("decimal(15,2)"), 1).cast("double"), "round(c_acctbal::DECIMAL(15,2), 1)::DOUBLE")
_scalar("fn_round_tens", "events", "event_id", lambda: scalars.rounded(F.col("user_id"), -1), "(((user_id + 5) // 10) * 10)::BIGINT")
_scalar("fn_digest", "documents", "doc_id", lambda: F.sha2("text", 256), "sha256(text)")
_scalar("fn_contains", "documents", "doc_id", lambda: F.contains("text", F.lit("the")), "contains(text, 'the')")
_scalar("fn_template", "nation", "n_nationkey", lambda: scalars.filled("{name|upper} is in {region}", {"name": F.col("n_name"), "region": F.col("n_regionkey")}), "upper(n_name) || ' is in ' || n_regionkey")
_scalar("fn_chars", "region", "r_regionkey", lambda: F.size(ffp.chars(F.col("r_name"))), "length(r_name)::INT")
_scalar("fn_implode", "nation", "n_nationkey", lambda: ffp.implode("-", F.array(F.col("n_name"), F.col("n_regionkey").cast("string"))), "n_name || '-' || n_regionkey")
_scalar("fn_plural", "region", "r_regionkey", lambda: scalars.plural(F.lower("r_name")), "CASE WHEN regexp_matches(lower(r_name), '(ss|sh|ch|x|s)$') THEN lower(r_name) || 'es' WHEN regexp_matches(lower(r_name), '[^aeiou]y$') THEN left(lower(r_name), length(r_name) - 1) || 'ies' ELSE lower(r_name) || 's' END")
_scalar("fn_within", "orders", "o_orderkey", lambda: scalars.within(F.col("o_totalprice"), 1000, 50000), "o_totalprice BETWEEN 1000 AND 50000")
_scalar("fn_before", "lineitem", "l_orderkey", lambda: scalars.before(F.col("l_shipdate"), F.lit("1996-01-01").cast("timestamp_ntz")), "l_shipdate < TIMESTAMP '1996-01-01'")
_scalar("fn_char_classes", "region", "r_regionkey", lambda: F.concat(scalars.is_upper(F.substring("r_name", 1, 1)).cast("string"), scalars.is_digit(F.substring("r_name", 1, 1)).cast("string")), "(regexp_matches(left(r_name, 1), '[A-Z]'))::VARCHAR || (regexp_matches(left(r_name, 1), '[0-9]'))::VARCHAR")
_scalar("fn_cidr", "events", "event_id", lambda: scalars.in_cidr(F.concat_ws(".", F.lit("10"), (F.col("user_id") % 256).cast("string"), F.lit("3.4")), "10.0.0.0/9"), "user_id % 256 < 128")


@query("SELECT event_id, regexp_replace(regexp_replace((user_id * 25 / 100)::DECIMAL(18,4)::VARCHAR, '0+$', ''), '\\.$', '') AS r FROM events")
def fn_printed_decimal(spark, d):
    return table(spark, d, "events").select("event_id", printed((F.col("user_id") * 25 / 100).cast("decimal(18,4)")).alias("r"))


@query("SELECT n_regionkey, n_nationkey, n_name FROM nation", "objectify_link")
def _objectify(spark, d):
    """An objectified fact's identifier splits into its players again."""
    store = star_store(spark, d)
    ids = store.objectified(store.schema.fact_types["NationInRegion"]).select("id")
    part = F.split("id", r"\.")
    back = ids.select(F.get(part, 0).cast("int").alias("n_nationkey"), F.get(part, 1).cast("int").alias("n_regionkey"))
    return back.join(table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name"), F.col("k") == F.col("n_nationkey")).select("n_regionkey", "n_nationkey", "n_name")


# schema, verbs, induction


@query("SELECT c_custkey AS customer, c_name AS \"CustomerHasName\", c_nationkey AS \"CustomerInNation\", c_acctbal AS \"CustomerHasBalance\", c_mktsegment AS \"CustomerInSegment\" FROM customer")
def rmap_wide(spark, d):
    return rmap.wide_table(star_store(spark, d), "Customer").withColumnRenamed("Customer", "customer")


@query("SELECT * FROM (VALUES ('l_linenumber,l_orderkey', (SELECT count(*) = count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem)), ('l_orderkey', (SELECT count(*) = count(DISTINCT l_orderkey) FROM lineitem)), ('l_linenumber', (SELECT count(*) = count(DISTINCT l_linenumber) FROM lineitem))) v(columns, holds)")
def uc_induction(spark, d):
    return rmap.induced_uniqueness(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"))


@query("SELECT * FROM (VALUES ('OrderContainsPart', (SELECT count(*) = 0 FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))), ('OrderHasTotal', true)) v(fact_type, mandatory)")
def mandatory_induction(spark, d):
    store = star_store(spark, d)
    return rmap.induced_mandatory(store, store.facts("OrderHasStatus").select("c1"), ["OrderContainsPart", "OrderHasTotal"])


@query("SELECT * FROM (VALUES ('labels', 'documents', (SELECT count(*) = 0 FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))), ('documents', 'labels', (SELECT count(*) = 0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)))) v(sub, super, included)")
def subtype_candidates(spark, d):
    return rmap.inclusions({"labels": table(spark, d, "labels").select("doc_id"), "documents": table(spark, d, "documents").select("doc_id")})


@query("SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'license') OR contains(lower(source), 'license') ORDER BY doc_id LIMIT 50")
def search_top50(spark, d):
    return rmap.search(table(spark, d, "documents"), "doc_id", ["text", "source"], "license").select("doc_id", "lang")


@query("SELECT 'CustomerHasName' AS fact_type, '1' AS a, c_name AS b FROM customer WHERE c_custkey = 1 UNION ALL SELECT 'CustomerInNation', '1', c_nationkey::VARCHAR FROM customer WHERE c_custkey = 1 UNION ALL SELECT 'CustomerInSegment', '1', c_mktsegment FROM customer WHERE c_custkey = 1 UNION ALL SELECT 'OrderPlacedByCustomer', o_orderkey::VARCHAR, '1' FROM orders WHERE o_custkey = 1")
def get_entity(spark, d):
    return rmap.entity(star_store(spark, d), "Customer", 1, ["CustomerHasName", "CustomerInNation", "CustomerInSegment", "OrderPlacedByCustomer"])


@query("SELECT 'OrderPlacedByCustomer' AS fact_type, 'collection' AS kind UNION ALL SELECT 'CustomerInNation', 'child' UNION ALL SELECT 'SupplierSuppliesPart', 'peer'")
def nav_kind(spark, d):
    schema = star_store(spark, d).schema
    rows = [(n, rmap.navigation(schema.fact_types[n], p)) for n, p in (("OrderPlacedByCustomer", 2), ("CustomerInNation", 1), ("SupplierSuppliesPart", 1))]
    return spark.createDataFrame(rows, "fact_type string, kind string")


@query("SELECT r.r_regionkey AS r, n.n_nationkey AS n, abs(r.r_regionkey * 5 - n.n_nationkey)::BIGINT AS score FROM region r, nation n WHERE (n.n_nationkey, r.r_regionkey) NOT IN (SELECT n_nationkey, n_regionkey FROM nation) AND n.n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
def induce_candidates(spark, d):
    from .plans import induce

    store = star_store(spark, d)
    return induce.candidates(
        {"r": table(spark, d, "region").select(F.col("r_regionkey").alias("r")), "n": table(spark, d, "nation").select(F.col("n_nationkey").alias("n"))},
        refuse=[store.facts("NationInRegion").toDF("n", "r"), table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("n"))],
        score=F.abs(F.col("r") * 5 - F.col("n")).cast("bigint"),
    ).select("r", "n", "score")


@query("SELECT o_custkey AS c, o_orderkey AS o FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1))")
def authorized_links(spark, d):
    """Links filtered by grants: a grant to a region reaches its customers' orders."""
    from .security import granted

    store = star_store(spark, d)
    by_customer = store.query(["joinon", ["joinon", "OrderPlacedByCustomer", "CustomerInNation", [[2, 1]], [1, 2, 4]], "NationInRegion", [[3, 1]], [2, 1, 5]]).toDF("c", "o", "r")
    grants = spark.createDataFrame([("ann", 1)], "user string, r int")
    return granted(by_customer, grants, "ann", "r").select("c", "o")


from . import catalog_operators  # noqa: E402, F401  (registers more)
