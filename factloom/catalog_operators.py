"""Registered queries of operators that the main catalogue doesn't reach: schema checks over relations of the star tables in
place of a schema's own facts, list and scalar functions, verbs, writes and machines, each with the same query in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import GUARDED, ORACLE, QUERIES, USER, _list_query, _scalar, _text, query
from .functions import ffp, scalars
from .functions.readings import Parser
from .operators import sets
from .plans import constraints as con
from .plans import deciders, induce, rmap
from .plans import machine as mach
from .plans.recipe import relation
from .plans.rules import derive, explain
from .plans.tx import Writer
from .schema import Constraint, Machine, Rule, Transition
from .star import star_store, table
from .store import reference_facts
from .streaming import events as streams
from .types import Domain


def _as(spark, d, name: str, **columns: str) -> DataFrame:
    """Columns of a table under other names."""
    return table(spark, d, name).select(*[F.col(c).alias(n) for n, c in columns.items()])


# schema checks


@query("SELECT o_custkey AS function FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def decide_declared_once(spark, d):
    return deciders.declared_once(_as(spark, d, "orders", domain="o_orderstatus", function="o_custkey"))


@query("SELECT c_custkey AS function FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) AND c_acctbal <= 0")
def decide_in_domain(spark, d):
    rich = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("function"))
    return deciders.in_domain(_as(spark, d, "customer", function="c_custkey"), _as(spark, d, "orders", function="o_custkey"), rich)


_PLAYS = (("F", 0), ("F", 1), ("O", 2), ("P", 3), ("P", 4))


@query(f"SELECT DISTINCT o_orderstatus AS role, o_custkey AS instance FROM orders WHERE (o_orderstatus, o_custkey) NOT IN (SELECT p.role, c_custkey FROM (VALUES {', '.join(map(str, _PLAYS))}) p(role, type) JOIN nation ON n_regionkey = p.type JOIN customer ON c_nationkey = n_nationkey)")
def decide_role_typing(spark, d):
    plays = spark.createDataFrame(_PLAYS, "role string, type int")
    of = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("instance"), F.col("n_regionkey").alias("type"))
    return deciders.role_typing(_as(spark, d, "orders", role="o_orderstatus", instance="o_custkey"), plays, of)


@query("WITH y AS (SELECT DISTINCT o_custkey AS f, o_orderstatus AS t FROM orders), r AS (SELECT DISTINCT o_orderstatus AS t, o_orderpriority AS r FROM orders) SELECT DISTINCT f AS function FROM y JOIN r USING (t) WHERE (f, r) NOT IN (SELECT o_custkey, o_orderpriority FROM orders) AND f NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def decide_yield_coverage(spark, d):
    performed = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("function"))
    return deciders.yield_coverage(
        _as(spark, d, "orders", function="o_custkey", fact_type="o_orderstatus").distinct(),
        _as(spark, d, "orders", fact_type="o_orderstatus", role="o_orderpriority").distinct(),
        _as(spark, d, "orders", function="o_custkey", role="o_orderpriority"),
        performed,
    )


@query('SELECT l_orderkey AS "constraint" FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1')
def decide_ring_same_type(spark, d):
    return deciders.ring_same_type(_as(spark, d, "lineitem", constraint="l_orderkey", role="l_linenumber", player="l_suppkey"))


@query('SELECT l_orderkey AS "constraint" FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) <> max(l_linenumber)')
def decide_unfilled_roles(spark, d):
    return deciders.unfilled_roles(_as(spark, d, "lineitem", constraint="l_orderkey", position="l_linenumber").withColumn("sequence", F.lit(1)))


@query("SELECT event_id AS federation FROM events WHERE user_id % 256 < 128")
def decide_ssrf(spark, d):
    url = F.concat(F.lit("http://ann@10."), (F.col("user_id") % 256).cast("string"), F.lit(".3.4:8080/x"))
    return deciders.ssrf(table(spark, d, "events").select(F.col("event_id").alias("federation"), url.alias("url")), ["10.0.0.0/9"])


@query("SELECT o_custkey AS machine, o_orderkey AS transition, o_orderpriority AS action FROM orders o WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000) AND (o_custkey, o_orderstatus, o_orderpriority) NOT IN (SELECT o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_totalprice > 250000)")
def decide_moore_mealy(spark, d):
    states = table(spark, d, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("machine"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("action"))
    return deciders.moore_mealy(_as(spark, d, "orders", machine="o_custkey", transition="o_orderkey", action="o_orderpriority"), states, _as(spark, d, "orders", machine="o_custkey", transition="o_orderkey", target="o_orderstatus"))


_LOOP = Machine("loop", "User", (Transition("a", "Start", "Round", "view"), Transition("b", "Round", "Again", "click"), Transition("c", "Again", "Round", "view")))


@query("SELECT * FROM (VALUES ('careful'), ('loop')) v(machine)")
def decide_cycle_exit(spark, d):
    """Of three machines, those with a cycle that nothing leaves."""
    return spark.createDataFrame([(m,) for m in deciders.cycle_exit([USER, GUARDED, _LOOP])], "machine string")


@query("WITH n AS (SELECT l_orderkey AS f, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1), s AS (SELECT l_orderkey AS f, l_suppkey, count(DISTINCT l_linenumber) AS k FROM lineitem GROUP BY 1, 2) SELECT DISTINCT f AS fact_type FROM n JOIN s USING (f) WHERE k < n - 1")
def decide_n_minus_one(spark, d):
    sizes = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("fact_type")).agg(F.count_distinct("l_linenumber").alias("arity"))
    return deciders.n_minus_one(sizes, _as(spark, d, "lineitem", fact_type="l_orderkey", constraint="l_suppkey", role="l_linenumber"))


@query("WITH n AS (SELECT l_orderkey AS f, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1), s AS (SELECT l_orderkey AS f, l_returnflag, count(DISTINCT l_linenumber) AS k FROM lineitem GROUP BY 1, 2) SELECT o_orderkey AS fact_type FROM orders WHERE o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT f FROM n JOIN s USING (f) WHERE k = n)")
def decide_objectified_spanning(spark, d):
    sizes = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("fact_type")).agg(F.count_distinct("l_linenumber").alias("arity"))
    closed = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("fact_type"))
    return deciders.objectified_spanning(closed, sizes, _as(spark, d, "lineitem", fact_type="l_orderkey", constraint="l_returnflag", role="l_linenumber"))


@query('SELECT o_custkey AS "constraint" FROM orders JOIN (VALUES (\'F\', 1), (\'O\', 2), (\'P\', 2)) t(player, data_type) ON o_orderstatus = player GROUP BY 1 HAVING count(DISTINCT data_type) > 1')
def decide_vc_types(spark, d):
    return deciders.vc_types(_as(spark, d, "orders", constraint="o_custkey", player="o_orderstatus"), spark.createDataFrame([("F", 1), ("O", 2), ("P", 2)], "player string, data_type int"))


@query("SELECT DISTINCT o_orderkey AS fact_type FROM orders JOIN (VALUES ('F', '1-URGENT'), ('O', '5-LOW'), ('P', '3-MEDIUM')) r(e, v) ON o_orderstatus = e AND o_orderpriority = v WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 2)")
def decide_refmode_restated(spark, d):
    return deciders.refmode_restated(
        _as(spark, d, "orders", fact_type="o_orderkey", player1="o_orderstatus", player2="o_orderpriority"),
        spark.createDataFrame([("F", "1-URGENT"), ("O", "5-LOW"), ("P", "3-MEDIUM")], "entity string, value string"),
        _as(spark, d, "lineitem", fact_type="l_orderkey", role="l_linenumber"),
    )


# scans


@query("SELECT c_custkey::VARCHAR AS c1 FROM customer UNION SELECT o_custkey::VARCHAR FROM orders UNION SELECT s_suppkey::VARCHAR FROM supplier UNION SELECT l_suppkey::VARCHAR FROM lineitem")
def instances_of_supertype(spark, d):
    """Every filler of a role that a party, customer or supplier plays."""
    return star_store(spark, d).instances("Party")


@query("SELECT p_partkey AS a, p_partkey AS b FROM part")
def reference_scan(spark, d):
    return reference_facts(table(spark, d, "part"), "p_partkey").df.toDF("a", "b")


@query("SELECT 'CustomerInNation' AS name, (SELECT count(*) FROM customer) AS n")
def ask_by_rows(spark, d):
    """Which population equals a set of rows."""
    store = star_store(spark, d)
    few = type(store)(spark, {n: store.relation(n) for n in ("CustomerInNation", "SupplierInNation", "NationInRegion")}, store.schema)
    rows = relation(table(spark, d, "customer").select("c_custkey", "c_nationkey")).df
    return spark.createDataFrame([(n, df.count()) for n, df in few.ask([(2, rows)])], "name string, n long")


# lists and functions

_list_query("list_nth", lambda x: sets.nth(x, 0), "xs[1]")
_list_query("list_dedup_last", lambda x: _text(sets.dedup_last(F.concat(x, x))), "array_to_string(list_sort(list_distinct(xs)), ',')")
_list_query("list_filter_eq", lambda x: F.size(sets.filter_eq(F.arrays_zip(x.alias("a"), ffp.reverse(x).alias("b")))), "len([i for i in range(1, len(xs) + 1) if xs[i] = xs[len(xs) + 1 - i]])::INT")
_list_query("list_find_first", lambda x: sets.find_first(F.transform(x, lambda e, i: F.struct(e.alias("name"), (i + 10).alias("place"))), 2)["place"], "list_position(xs, 2)::INT + 9 - CASE WHEN list_contains(xs, 2) THEN 0 ELSE NULL END")
_list_query("list_union", lambda x: _text(sets.array_union(x, F.array(F.lit(2), F.lit(99)))), "array_to_string(list_sort(list_distinct(list_concat(xs, [2, 99]))), ',')")
_list_query("list_minus", lambda x: _text(sets.array_minus(x, F.array(F.lit(2), F.lit(3)))), "array_to_string(list_sort(list_distinct([e for e in xs if e NOT IN (2, 3)])), ',')")
_list_query("list_inter", lambda x: _text(sets.array_inter(x, F.array(F.lit(2), F.lit(3)))), "array_to_string(list_sort(list_distinct([e for e in xs if e IN (2, 3)])), ',')")
_list_query("ffp_identity", lambda x: _text(ffp.identity(x)), "array_to_string(xs, ',')")
_list_query("ffp_tlr", lambda x: _text(ffp.tlr(x)), "array_to_string(xs[1:len(xs) - 1], ',')")
_list_query("ffp_last", lambda x: ffp.last(x), "xs[-1]")
_list_query("ffp_null", lambda x: ffp.null(sets.drop(x, 3)), "len(xs) <= 3")
_list_query("ffp_length", lambda x: ffp.length(x), "len(xs)::INT")
_list_query("ffp_cat", lambda x: _text(ffp.cat(x, ffp.reverse(x))), "array_to_string(list_concat(xs, list_reverse(xs)), ',')")
_list_query("ffp_distr", lambda x: F.array_join(F.transform(ffp.distr(x, F.lit(7)), lambda p: F.concat_ws("-", p["a"], p["b"])), ","), "array_to_string([e::VARCHAR || '-7' for e in xs], ',')")
_list_query("ffp_eq_not", lambda x: ffp.negate(ffp.eq(x, ffp.reverse(x))), "xs <> list_reverse(xs)")
_list_query("ffp_add_sub", lambda x: ffp.sub(ffp.add(ffp.select(1)(x), F.size(x)), F.lit(1)), "(xs[1] + len(xs) - 1)::BIGINT")
_list_query("ffp_cons", lambda x: _text(ffp.cons(ffp.select(1), ffp.last, ffp.const(5))(x)), "array_to_string([xs[1], xs[-1], 5], ',')")
_list_query("ffp_while", lambda x: _text(ffp.bounded_while(lambda y: F.size(y) > 2, ffp.tl, 100)(x)), "array_to_string(CASE WHEN len(xs) > 2 THEN xs[len(xs) - 1:] ELSE xs END, ',')")
_list_query("ffp_compare", lambda x: F.concat_ws(",", *[f(ffp.select(1)(x), F.size(x)).cast("string") for f in (ffp.lt, ffp.le, ffp.gt, ffp.ge)]), "concat_ws(',', (xs[1] < len(xs))::VARCHAR, (xs[1] <= len(xs))::VARCHAR, (xs[1] > len(xs))::VARCHAR, (xs[1] >= len(xs))::VARCHAR)")
_list_query("ffp_and", lambda x: ffp.conjunction(F.size(x) > 2, F.array_contains(x, 1)), "len(xs) > 2 AND list_contains(xs, 1)")
_list_query("list_flatten", lambda x: _text(sets.flattened(F.array(x, ffp.reverse(x)))), "array_to_string(list_concat(xs, list_reverse(xs)), ',')")
_list_query("list_sort_by", lambda x: _text(sets.sorted_by(x, lambda e: -(e % 3))), "array_to_string(list_concat([e for e in xs if e % 3 = 2], [e for e in xs if e % 3 = 1], [e for e in xs if e % 3 = 0]), ',')")
_scalar("fn_text_holds", "part", "p_partkey", lambda: F.concat_ws(",", *[scalars.text_holds(F.col("p_name"), op, "S").cast("string") for op in ("starts with", "ends with", "not contains")]), "concat_ws(',', starts_with(lower(p_name), 's')::VARCHAR, ends_with(lower(p_name), 's')::VARCHAR, (NOT contains(lower(p_name), 's'))::VARCHAR)")
_scalar("fn_or_more", "part", "p_partkey", lambda: scalars.bare_comparison(F.col("p_size"), "30 or more") | scalars.bare_comparison(F.col("p_size"), "5 or fewer"), "p_size >= 30 OR p_size <= 5")
_scalar("fn_quoted", "part", "p_partkey", lambda: scalars.quoted(F.concat(F.col("p_name"), F.lit(' "x"\\'))), "'\"' || p_name || ' \\\"x\\\"\\\\\"'")
_scalar("fn_number_text", "part", "p_partkey", lambda: scalars.number_text(F.col("p_size")), "p_size::VARCHAR")
_scalar("fn_is_lower", "part", "p_partkey", lambda: scalars.is_lower(F.substring("p_name", 1, 1)), "regexp_matches(left(p_name, 1), '[a-z]')")
_scalar("fn_after", "orders", "o_orderkey", lambda: scalars.after(F.col("o_orderdate"), F.lit("1996-01-01").cast("timestamp_ntz")), "o_orderdate > TIMESTAMP '1996-01-01'")
_scalar("fn_json_path", "nation", "n_nationkey", lambda: scalars.json_path(F.concat(F.lit('{"a": [{"x": 1}, {"b": "'), F.col("n_name"), F.lit('"}]}')), "a.*.b"), "n_name")
_scalar("fn_past_future", "orders", "o_orderkey", lambda: scalars.is_past(F.col("o_orderdate")) & ~scalars.is_future(F.col("o_orderdate")), "o_orderdate < TIMESTAMP '2020-01-01'")
_scalar("fn_current", "orders", "o_orderkey", lambda: scalars.is_current(F.col("o_orderdate"), F.when(F.col("o_orderstatus") == "O", F.lit(None)).otherwise(F.col("o_orderdate"))), "o_orderstatus = 'O'")
_scalar("fn_fresh", "orders", "o_orderkey", lambda: scalars.is_fresh(F.col("o_orderdate"), "1 DAY"), "false")
_scalar("fn_sealed", "customer", "c_custkey", lambda: scalars.decrypt(scalars.encrypt(F.col("c_name"), "key"), "key"), "c_name")


# constraints


@query("SELECT doc_id, text IS NOT NULL AS long FROM documents WHERE false")
def uc_spanning(spark, d):
    """A uniqueness over all columns is never broken."""
    return con.uniqueness(table(spark, d, "documents").select("doc_id", F.col("text").isNotNull().alias("long")), ["doc_id", "long"])


@query("SELECT doc_id FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM labels WHERE toxic = 1")
def negation_consistency(spark, d):
    labels = table(spark, d, "labels")
    return con.consistent_with_negation(labels.where("quality = 1").select("doc_id"), labels.where("toxic = 1").select("doc_id"))


@query("SELECT o_orderkey AS o, 'Order ' || o_orderkey || ' has status ' || o_orderstatus AS text FROM orders WHERE o_orderstatus = 'P'")
def violation_message(spark, d):
    rows = con.value_domain(star_store(spark, d).facts("OrderHasStatus").toDF("o", "s"), "s", Domain("text", values=("F", "O")))
    return rows.select("o", con.message("Order {x} has status {y}", F.array(F.col("o").cast("string"), "s")).alias("text"))


@query("SELECT * FROM (VALUES ('acyclic'), ('intransitive')) v(adjective)")
def ring_implied(spark, d):
    """Of five adjectives, the ones that no other implies."""
    return spark.createDataFrame([(a,) for a in con.needed_rings(["irreflexive", "acyclic", "asymmetric", "antisymmetric", "intransitive"])], "adjective string")


# rules and writes


@query("SELECT c_nationkey AS n FROM customer UNION SELECT s_nationkey FROM supplier")
def rule_provided(spark, d):
    """A subset constraint that provides its head: nations of customers are nations that trade, as those of suppliers are."""
    store = star_store(spark, d).with_facts(NationTrades=relation(table(spark, d, "supplier").select("s_nationkey").distinct()))
    rules = con.provided([Constraint("trade", "subset", (["proj", "CustomerInNation", [2]], "NationTrades"))], ["NationTrades"])
    return derive(store, rules, only=["NationTrades"]).facts("NationTrades").toDF("n")


@query("SELECT user_id AS u, event_id AS e, row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'click' DESC, ts, event_id)::INT AS position FROM events QUALIFY event_type <> 'click'")
def win_next_position(spark, d):
    """Positions next after the greatest that the user's clicks hold."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("u"), F.col("event_id").alias("e"), "event_type", "ts")
    held = sets.next_positions(rows.where("event_type = 'click'"), ["u"], ["ts", "e"])
    new = sets.next_positions(rows.where("event_type <> 'click'").select("u", "e", "ts"), ["u"], ["ts", "e"], held)
    return new.select("u", "e", F.col("position").cast("int"))


@query("SELECT 0 AS arm, 'CustomerInNation' AS antecedents UNION ALL SELECT 1, 'SupplierInNation'")
def rule_explain(spark, d):
    """The arms that give a derived row."""
    rule = Rule("NationTrades", (["proj", "CustomerInNation", [2]], ["proj", "SupplierInNation", [2]]))
    return explain(star_store(spark, d), [rule], "NationTrades", (3,)).select("arm", "antecedents")


_NEW = [(10**9 + k, k % 25) for k in range(40)]


def _after(spark, d, answer, name: str, *columns: str) -> DataFrame:
    return answer.store.facts(name).toDF(*columns).withColumn("status", F.lit(answer.status))


def _writer() -> Writer:
    return Writer([Constraint("one-nation", "uniqueness", ("CustomerInNation", (1,))), Constraint("nation-known", "subset", (["proj", "CustomerInNation", [2]], ["proj", "NationInRegion", [1]]))])


_CUSTOMERS = "SELECT c_custkey AS c, c_nationkey AS n, '{}' AS status FROM customer"


@query(f"{_CUSTOMERS.format('committed')} UNION ALL SELECT 1000000000 + k, (k % 25)::INT, 'committed' FROM range(40) t(k)")
def write_create(spark, d):
    return _after(spark, d, _writer().create(star_store(spark, d), CustomerInNation=_NEW), "CustomerInNation", "c", "n")


@query(_CUSTOMERS.format("refused"))
def write_refused(spark, d):
    """One fact of many breaks a constraint, so none is kept."""
    return _after(spark, d, _writer().create(star_store(spark, d), CustomerInNation=[*_NEW, (1, 99)]), "CustomerInNation", "c", "n")


@query(f"SELECT c, CASE WHEN c = 7 THEN 3 ELSE n END AS n, status FROM ({_CUSTOMERS.format('committed')})")
def write_replace(spark, d):
    return _after(spark, d, _writer().replace(star_store(spark, d), "CustomerInNation", (7,), (7, 3)), "CustomerInNation", "c", "n")


@query(f"{_CUSTOMERS.format('committed')} UNION ALL SELECT 1000000000 + k, (k % 25)::INT, 'committed' FROM range(40) t(k)")
def write_bulk(spark, d):
    writes = [{"CustomerInNation": _NEW[:20]}, {"CustomerInNation": _NEW[20:]}]
    return _after(spark, d, _writer().bulk(star_store(spark, d), writes), "CustomerInNation", "c", "n")


# verbs


@query("SELECT count(*) FILTER (o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) = 0 AS holds FROM orders")
def verify_holds(spark, d):
    store = star_store(spark, d)
    left = con.violations(store, [Constraint("orders-have-lines", "mandatory", (["proj", "OrderHasTotal", [1]], [["proj", "OrderContainsPart", [1]]]))])
    return left.agg((F.count("*") == 0).alias("holds"))


@query("SELECT o_custkey AS c, o_orderkey AS o, n::BIGINT AS total FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE k <= 25")
def link_rows(spark, d):
    """The first 25 orders of each customer, with how many there are."""
    return rmap.first_rows(star_store(spark, d).facts("OrderPlacedByCustomer").toDF("o", "c"), "c", ["o"]).select("c", "o", "total")


@query("SELECT 'CustomerInNation' AS recipe, true AS covers, true AS exact UNION ALL SELECT 'both', true, (SELECT count(*) = 0 FROM (SELECT s_suppkey, s_nationkey FROM supplier EXCEPT SELECT c_custkey, c_nationkey FROM customer))")
def induce_redundant(spark, d):
    """Recipes that cover a stored fact type, and whether they give exactly it."""
    found = induce.redundant(star_store(spark, d), "CustomerInNation", ["CustomerInNation", ["union", "CustomerInNation", "SupplierInNation"], ["proj", "CustomerInNation", [1]]])
    return spark.createDataFrame([(r if isinstance(r, str) else "both", a, b) for r, a, b in found], "recipe string, covers boolean, exact boolean")


@query("SELECT r_regionkey AS r, n_nationkey AS n, r_regionkey * 100 - n_nationkey AS score FROM region, nation WHERE (n_nationkey, r_regionkey) NOT IN (SELECT n_nationkey, n_regionkey FROM nation) ORDER BY score DESC LIMIT 10")
def induce_ranked(spark, d):
    store = star_store(spark, d)
    found = induce.candidates({"r": _as(spark, d, "region", r="r_regionkey"), "n": _as(spark, d, "nation", n="n_nationkey")}, refuse=[store.facts("NationInRegion").toDF("n", "r")], score=F.col("r") * 100 - F.col("n"))
    return induce.ranked(found, _as(spark, d, "nation", n="n_nationkey"), ["n"], 10).select("r", "n", "score")


# machines and events

@query("SELECT event_id::VARCHAR AS of, date_trunc('second', ts) AS time, event_type AS caused, sha256(concat_ws(chr(31), event_id, strftime(ts, '%Y-%m-%d %H:%M:%S'), event_type)) AS event FROM events")
def event_records(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.date_trunc("second", "ts").alias("ts"), "event_type")
    return streams.event_log(rows, "id", "ts", "event_type").select("of", "time", "caused", "event")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'click'")
def event_demultiplexed(spark, d):
    return streams.demultiplexed(table(spark, d, "events"), F.col("event_type"), "click").select("event_id", "user_id")


# sentences

_READINGS = """
Order(.nr) is an entity type. Customer(.nr) is an entity type. Nation(.nr) is an entity type.
Total is a value type. Balance is a value type. Status is a value type. Spending is a value type. Order Count is a value type. Due is a value type. Nation Count is a value type.
Order placed by Customer. Order has Total. Order has Status. Customer has Balance. Customer in Nation.
Customer has Order Count. Customer has Spending. Customer is busy. Order is large. Order has Due. Customer is thrifty. Nation has Order Count.
* Customer has Order Count iff Order Count is the count of Order where Order placed by Customer.
* Customer has Spending iff Spending is the sum of Total where Order placed by Customer and Order has Total.
* Customer is busy iff Customer has Order Count that is at least 12.
* Order is large iff Order has Total that exceeds 450000.5 and Order has Status 'F'.
* Order has Due iff Order placed by that Customer and Order has Total and Customer has Balance and Due is that Total minus that Balance.
* Customer is thrifty iff Customer has Spending and Customer has Balance1 and no Customer is busy and Spending exceeds Balance1.
* Nation has Order Count iff Order Count is the count of Order where Order placed by Customer and Customer in Nation and Order has Status 'P'.
"""


def _said(head: str, columns: str, sql: str, name: str) -> None:
    """Register a head that the sentences derive."""

    def run(spark, d):
        parsed = Parser().read(_READINGS)
        if parsed.unknown:
            raise ValueError(f"not understood: {parsed.unknown}")
        return derive(star_store(spark, d), parsed.rules, only=[head]).facts(head).toDF(*columns.split())

    query(sql, name)(run)


_said("CustomerHasOrderCount", "c n", "SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1", "said_count")
QUERIES["said_sum"] = lambda spark, d: derive(star_store(spark, d), Parser().read(_READINGS).rules, only=["CustomerHasSpending"]).facts("CustomerHasSpending").toDF("c", "total").withColumn("total", F.round("total", 2).cast("double"))
ORACLE["said_sum"] = "SELECT o_custkey AS c, round(sum(o_totalprice::DECIMAL(19,6)), 2)::DOUBLE AS total FROM orders GROUP BY 1"
_said("CustomerIsBusy", "c", "SELECT o_custkey AS c FROM orders GROUP BY 1 HAVING count(*) >= 12", "said_at_least")
_said("OrderIsLarge", "o", "SELECT o_orderkey AS o FROM orders WHERE o_totalprice > 450000.5 AND o_orderstatus = 'F'", "said_exceeds")
QUERIES["said_calculated"] = lambda spark, d: derive(star_store(spark, d), Parser().read(_READINGS).rules, only=["OrderHasDue"]).facts("OrderHasDue").toDF("o", "due").withColumn("due", F.round("due", 2).cast("double"))
ORACLE["said_calculated"] = "SELECT o_orderkey AS o, round(o_totalprice::DECIMAL(19,6) - c_acctbal::DECIMAL(19,6), 2)::DOUBLE AS due FROM orders JOIN customer ON o_custkey = c_custkey"
_said("CustomerIsThrifty", "c", "SELECT o_custkey AS c FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey, c_acctbal HAVING sum(o_totalprice::DECIMAL(19,6)) > c_acctbal::DECIMAL(19,6) AND count(*) < 12", "said_negated_compared")
_said("NationHasOrderCount", "n k", "SELECT c_nationkey AS n, count(*) AS k FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P' GROUP BY 1", "said_count_joined")


@query("SELECT o_orderkey AS o, o_custkey AS c FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def said_subset(spark, d):
    """A conditional sentence whose sides share one of their variables."""
    parsed = Parser().read(
        "Order(.nr) is an entity type. Customer(.nr) is an entity type. Balance is a value type. Order placed by Customer. Customer has Balance. Order is of rich Customer. If Order1 is of rich Customer1 then Customer1 has Balance1."
    )
    store = star_store(spark, d)
    store = store.with_facts(OrderIsOfRichCustomer=store.relation("OrderPlacedByCustomer"), CustomerHasBalance=relation(table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", "c_acctbal"), (1,)))
    (rule,) = parsed.constraints
    left = store.query(["joinon", "OrderPlacedByCustomer", ["minus", *[a if isinstance(a, list) else ["proj", a, [1]] for a in rule.args]], [[2, 1]], [1, 2]])
    return left.toDF("o", "c")
