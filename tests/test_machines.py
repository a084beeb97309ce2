import pytest
from pyspark.sql import functions as F

from factloom.catalog import SHOP, USER
from factloom.plans import deciders
from factloom.plans import machine as mach
from factloom.schema import Machine, Transition
from factloom.streaming import events as stream


def rows(df):
    return {tuple(r) for r in df.collect()}


PERSON = Machine(
    "m1",
    "Person",
    (Transition("t1", "s0", "c", "happy"), Transition("b", "c", "done", "name"), Transition("t9", "s0", "x", "likes", guard="happy")),
    initial="s0",
    subs={"c": Machine("m2", "Person", (Transition("a", "i0", "i1", "name"),), initial="i0")},
)


def test_nested_machine_moves(spark):
    held = spark.createDataFrame([("p2", "i0"), ("p3", "i1")], "entity string, status string")
    happened = spark.createDataFrame([("p1", "happy"), ("p2", "name"), ("p3", "name"), ("p9", "name"), ("p1", "age")], "entity string, trigger string")
    # p2's move ends the inner machine, so the outer transition for the same event carries on
    assert rows(mach.moves(held, PERSON, happened)) == {("p1", "s0", "i0"), ("p2", "i0", "done"), ("p3", "i1", "done")}


def test_guards(spark):
    ev = spark.createDataFrame([("p4", 1, "likes", True), ("p9", 1, "likes", False)], "e string, t int, k string, happy boolean")
    assert rows(mach.fold(ev, PERSON, entity="e", event="k", order=["t"], guards={"happy": "happy"})) == {("p4", "x"), ("p9", "s0")}


def test_starts_ends_and_cycles():
    assert Machine("m", "X", (Transition("a", "p", "q", "e"), Transition("b", "q", "r", "e"))).start() == "p"
    assert mach.terminal(USER) == {"Gone"} and mach.leaf(SHOP, "In") == "Browsing"
    loop = Machine("l", "X", (Transition("a", "p", "q", "e"), Transition("b", "q", "p", "e")), initial="p")
    assert mach.cycles_without_exit(loop) == {"p", "q"} and deciders.cycle_exit([loop, USER]) == ["l"]
    assert ("New", "Gone") in mach.reaches(USER)


def test_fold_in_chunks_equals_fold(spark):
    ev = spark.range(3000).selectExpr("id % 3 as u", "id as t", "element_at(array('signup','view','click','purchase','error'), int(pmod(hash(id), 5)) + 1) as k")
    whole = rows(mach.fold(ev, USER, entity="u", event="k", order=["t"]))
    assert rows(mach.fold(ev, USER, entity="u", event="k", order=["t"], chunk=7)) == whole
    status = {}
    for r in sorted(ev.collect(), key=lambda r: r.t):
        s = status.get(r.u, "New")
        status[r.u] = stream.transition_table(USER).get((s, r.k), s)
    assert whole == set(status.items())
    after = mach.history(ev, USER, entity="u", event="k", order=["t"])
    assert rows(after.groupBy("u").agg(F.max_by("after", "t"))) == whole


def test_stream_equals_batch(spark, tmp_path):
    ev = spark.range(300).selectExpr("id % 5 as u", "id as t", "element_at(array('signup','view','click','purchase','error'), int(pmod(hash(id), 5)) + 1) as k")
    for n in range(3):
        ev.where(f"t >= {n * 100} and t < {n * 100 + 100}").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    source = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    got = {}
    q = (
        stream.fold_stream(source, USER, entity="u", event="k", order="t")
        .writeStream.outputMode("update")
        .option("checkpointLocation", f"{tmp_path}/c")
        .foreachBatch(lambda d, n: got.update({r.u: r.status for r in d.collect()}))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination(120)
    assert set(got.items()) == rows(mach.fold(ev, USER, entity="u", event="k", order=["t"]))


def test_rate_limit_and_subscription(spark, tmp_path):
    ev = spark.range(40).selectExpr("id % 2 as u", "timestamp_seconds(id * 30) as ts", "'view' as k")
    ev.coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(ev.schema).parquet(f"{tmp_path}/in")
    over = stream.over_rate(source, entity="u", time="ts", window="5 minutes", most=4)
    q = over.writeStream.outputMode("complete").format("memory").queryName("over_rate").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.u, r.n) for r in spark.table("over_rate").collect()} == {(0, 5), (1, 5)}
    seen = []
    q = stream.subscribe(stream.demultiplexed(source, F.col("u"), 1), lambda d: d.groupBy("k").count(), lambda d, n: seen.extend(tuple(r) for r in d.collect()), f"{tmp_path}/c")
    q.processAllAvailable()
    q.stop()
    assert seen == [("view", 20)]


def test_deciders(spark):
    def f(data, ddl):
        return spark.createDataFrame(data, ddl)

    assert rows(deciders.declared_once(f([("a", "f"), ("b", "f"), ("a", "g")], "domain string, function string"))) == {("f",)}
    assert rows(deciders.in_domain(f([("f",), ("g",), ("h",)], "function string"), f([("g",)], "function string"), f([("f",)], "function string"))) == {("h",)}
    assert rows(deciders.role_typing(f([("r", "x"), ("r", "y")], "role string, instance string"), f([("r", "T")], "role string, type string"), f([("x", "T"), ("y", "U")], "instance string, type string"))) == {("r", "y")}
    assert rows(deciders.yield_coverage(f([("f", "F"), ("g", "F")], "function string, fact_type string"), f([("F", 1), ("F", 2)], "fact_type string, role int"), f([("f", 1), ("f", 2), ("g", 1)], "function string, role int"), f([], "function string"))) == {("g",)}
    assert rows(deciders.ring_same_type(f([("c", 1, "A"), ("c", 2, "B"), ("d", 1, "A"), ("d", 2, "A")], "constraint string, role int, player string"))) == {("c",)}
    assert rows(deciders.unfilled_roles(f([("c", 1, 1), ("c", 1, 3), ("d", 1, 1), ("d", 2, 1), ("e", 1, 1), ("e", 2, 1), ("e", 2, 2), ("g", 2, 1)], "constraint string, sequence int, position int"))) == {("c",), ("e",), ("g",)}
    assert rows(deciders.ssrf(f([("x", "http://10.1.2.3/a"), ("y", "https://8.8.8.8/"), ("z", "http://host/")], "federation string, url string"), ["10.0.0.0/8", "127.0.0.0/8"])) == {("x",)}
    assert rows(deciders.moore_mealy(f([("m", "t", "a"), ("m", "t", "b")], "machine string, transition string, action string"), f([("m", "s", "a")], "machine string, status string, action string"), f([("m", "t", "s")], "machine string, transition string, target string"))) == {("m", "t", "b")}
    types, spans = f([("F", 3), ("G", 2)], "fact_type string, arity int"), f([("F", "u", 1), ("G", "v", 1), ("G", "w", 1), ("G", "w", 2)], "fact_type string, constraint string, role int")
    assert rows(deciders.n_minus_one(types, spans)) == {("F",)}
    assert rows(deciders.objectified_spanning(f([("F",), ("G",)], "fact_type string"), types, spans)) == {("F",)}
    assert rows(deciders.ring_complete(f([("F", "A", "A"), ("G", "A", "A"), ("H", "A", "B")], "fact_type string, player1 string, player2 string"), f([("G",)], "fact_type string"), f([], "fact_type string"))) == {("F",)}
    assert rows(deciders.vc_types(f([("c", "A"), ("c", "B"), ("d", "A")], "constraint string, player string"), f([("A", "date"), ("B", "integer")], "player string, data_type string"))) == {("c",)}
    assert rows(deciders.refmode_restated(f([("F", "A", "B"), ("G", "A", "C")], "fact_type string, player1 string, player2 string"), f([("A", "B")], "entity string, value string"), f([("F", 2)], "fact_type string, role int"))) == {("F",)}


def test_guards_in_moves_links_and_streams(spark, tmp_path):
    held = spark.createDataFrame([("p1", "s0"), ("p2", "s0")], "entity string, status string")
    happened = spark.createDataFrame([("p1", "likes", True), ("p2", "likes", False)], "entity string, trigger string, glad boolean")
    assert rows(mach.moves(held, PERSON, happened, {"happy": "glad"})) == {("p1", "s0", "x")}
    assert rows(mach.moves(held, PERSON, happened)) == set()
    links = mach.available(held, PERSON, {"happy": spark.createDataFrame([("p2",)], "e string")})
    assert rows(links.select("entity", "trigger")) == {("p1", "happy"), ("p2", "happy"), ("p2", "likes")}
    ev = spark.createDataFrame([("p4", 1, "likes", True), ("p9", 1, "likes", False), ("p9", 2, "likes", None)], "e string, t int, k string, glad boolean")
    ev.coalesce(1).write.parquet(f"{tmp_path}/in")
    out = stream.fold_stream(spark.readStream.schema(ev.schema).parquet(f"{tmp_path}/in"), PERSON, entity="e", event="k", order="t", guards={"happy": "glad"})
    q = out.writeStream.format("memory").queryName("guarded").outputMode("update").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("guarded")) == rows(mach.fold(ev, PERSON, entity="e", event="k", order=["t"], guards={"happy": "glad"})) == {("p4", "x"), ("p9", "s0")}


def test_one_entity_with_most_events(spark):
    """A hot entity's events are dealt over chunks, and so is its history."""
    ev = spark.range(4000).selectExpr("if(id % 4 = 0, id, -1) as u", "id as t", "element_at(array('signup','view','click','purchase','error'), int(pmod(hash(id), 5)) + 1) as k")
    whole = rows(mach.fold(ev, USER, entity="u", event="k", order=["t"]))
    assert rows(mach.fold(ev, USER, entity="u", event="k", order=["t"], chunk=50)) == whole
    one = rows(mach.history(ev, USER, entity="u", event="k", order=["t"], chunk=10**6))
    assert rows(mach.history(ev, USER, entity="u", event="k", order=["t"], chunk=40)) == one and len(one) == 4000


def test_small_chunks_make_no_more_tasks(spark):
    """Chunks are cut inside of tasks: so many tasks as there are chunks would never end on a large table."""
    import re

    ev = spark.range(20000).selectExpr("if(id % 4 = 0, id % 97, -1) as u", "id as t", "element_at(array('signup','view','click','purchase','error'), int(pmod(hash(id), 5)) + 1) as k")
    out = mach.fold(ev, USER, entity="u", event="k", order=["t"], chunk=5)
    dealt = re.findall(r"rangepartitioning\(.*?, (\d+)\)", out._jdf.queryExecution().executedPlan().toString())
    assert dealt and max(map(int, dealt)) <= 4
    assert rows(out) == rows(mach.fold(ev, USER, entity="u", event="k", order=["t"]))
    chunks = mach._chunks(ev, USER, mach.statuses(USER), "u", "k", ["t"], None, 5).selectExpr("size(_x) as n")
    assert chunks.selectExpr("max(n)", "sum(n)").first() == (5, 20000)
