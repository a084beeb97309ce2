import pytest
from pyspark.sql import functions as F

from factloom.plans import constraints as con
from factloom.plans.recipe import relation
from factloom.plans.rules import derive
from factloom.plans.tx import COMMITTED, REFUSED, WITH_VIOLATIONS, Snapshots, Writer
from factloom.schema import DEONTIC, Constraint, FactType, ObjectType, Rule, Schema
from factloom.store import FactStore
from factloom.types import Domain, malformed


def rows(df):
    return {tuple(r) for r in df.collect()}


@pytest.fixture(scope="module")
def store(spark):
    def rel(data, ddl):
        return relation(spark.createDataFrame(data, ddl))

    schema = Schema(
        {n: ObjectType(n) for n in ("Person", "Name", "Number")},
        {
            "Name": FactType("Name", ("Person", "Name"), unique=((1,),)),
            "Age": FactType("Age", ("Person", "Number"), unique=((1,),), mandatory=(1,)),
            "Happy": FactType("Happy", ("Person",)),
            "Likes": FactType("Likes", ("Person", "Person")),
        },
    )
    return FactStore(
        spark,
        {
            "Name": rel([("p1", "Ann"), ("p1", "Bea"), ("p2", "Cy"), ("p3", "Cy")], "a string, b string"),
            "Age": rel([("p1", 30), ("p2", 30), ("p3", 30)], "a string, b long"),
            "Happy": rel([("p1",), ("p4",)], "a string"),
            "Likes": rel([("p1", "p2"), ("p2", "p1"), ("p3", "p3"), ("p2", "p3")], "a string, b string"),
        },
        schema,
    )


CONSTRAINTS = [
    Constraint("uc", "uniqueness", ("Name", (1,))),
    Constraint("euc", "external", (["Name", "Age"],)),
    Constraint("mc", "mandatory", ("Person", [["proj", "Age", [1]]])),
    Constraint("ir", "ring", ("Likes", "irreflexive")),
    Constraint("as", "ring", ("Likes", "asymmetric")),
    Constraint("ss", "subset", ("Happy", ["proj", "Age", [1]])),
    Constraint("do", "prohibition", (["minus", ["proj", "Likes", [1]], "Happy"],), DEONTIC),
    Constraint("or", "mandatory", (["proj", "Name", [1]], [["proj", "Happy", [1]], ["proj", "Likes", [1]]])),
]


def test_all_violations_of_the_people(store):
    got = {(r[0], r[1], tuple(r[2])) for r in con.violations(store, CONSTRAINTS).collect()}
    a = "alethic"
    assert got == {
        ("uc", a, ("p1", "Ann")),
        ("uc", a, ("p1", "Bea")),
        ("euc", a, ("p2", "Cy", "30")),
        ("euc", a, ("p3", "Cy", "30")),
        ("mc", a, ("p4",)),
        ("ir", a, ("p3", "p3")),
        ("as", a, ("p1", "p2")),
        ("as", a, ("p2", "p1")),
        ("as", a, ("p3", "p3")),
        ("ss", a, ("p4",)),
        ("do", DEONTIC, ("p2",)),
        ("do", DEONTIC, ("p3",)),
    }


def test_writes(store):
    w = Writer(CONSTRAINTS, [Rule("Sad", (["minus", ["proj", "Name", [1]], "Happy"],))])
    second = w.create(store, Name=[("p2", "Dee")])
    assert second.status == REFUSED and second.store is store
    assert {tuple(v[2]) for v in second.violations if v[0] == "uc"} >= {("p2", "Cy"), ("p2", "Dee")}
    aged = w.create(store, Age=[("p4", 30)])
    assert aged.status != REFUSED and aged.store.has("Age", "p4", 30)
    assert con.violations(aged.store, CONSTRAINTS).count() == 10
    new = w.create(store, Name=[("p5", "Eve")])
    assert new.status == REFUSED and {v[0] for v in new.alethic} >= {"mc", "or"}
    assert w.create(store, Name=[("p2", "Cy")]).status in (COMMITTED, WITH_VIOLATIONS)
    assert "derived" in w.create(store, Sad=[("p1",)]).reason
    assert "takes 2 values" in w.create(store, Name=[("p1",)]).reason
    assert "no fact type" in w.create(store, Nothing=[("p1",)]).reason


def test_deontic_commits_with_violations(store):
    w = Writer([c for c in CONSTRAINTS if c.id in ("do", "ir")])
    answer = w.create(store, Likes=[("p9", "p1")])
    assert answer.status == WITH_VIOLATIONS and ("p9",) in {tuple(v[2]) for v in answer.deontic}
    assert w.create(store, Likes=[("p9", "p9")]).status == REFUSED


def test_retract_cascades_and_snapshots(store):
    w, s = Writer(), Snapshots()
    s.snapshot("before", store)
    answer = w.retract(store, "Age", ("p1", 30))
    assert not answer.store.has("Age", "p1", 30) and not answer.store.has("Happy", "p1") and not answer.store.has("Likes", "p2", "p1")
    assert answer.store.has("Likes", "p2", "p3")
    s.snapshot("after", answer.store)
    assert s.diff("before", "after")["Age"] == (1, 0)
    assert s.rollback("before") is store


def test_aggregates_are_judged_over_the_whole_group(spark):
    rel = lambda d, ddl: relation(spark.createDataFrame(d, ddl))
    store = FactStore(spark, {"Amount": rel([("p1", 10)], "a string, b long"), "Of": rel([("r0", "p1")], "a string, b string"), "Refund": rel([("r0", 8)], "a string, b long")})
    rules = [
        Rule("Refunded", (["sum", ["joinon", "Of", "Refund", [[1, 1]], [1, 2, 4]], 2, 3],)),
        Rule("Over", (["proj", ["cmp", ["joinon", "Amount", "Refunded", [[1, 1]], [1, 2, 4]], 2, 3], [1]],)),
    ]
    w = Writer([Constraint("over", "prohibition", ("Over",), DEONTIC)], rules)
    assert w.create(store, Of=[("r1", "p1")], Refund=[("r1", 1)]).status == COMMITTED
    answer = w.create(store, Of=[("r1", "p1")], Refund=[("r1", 5)])
    assert answer.status == WITH_VIOLATIONS and [tuple(v[2]) for v in answer.violations] == [("p1",)]
    assert rows(derive(store, rules).facts("Refunded")) == {("p1", 8)}


def test_frequency(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "x"), ("a", "y"), ("a", "z")], "k string, v string")
    a = {("a", v) for v in "xyz"}
    assert rows(con.frequency(df, ["k"], 2, None)) == {("b", "x")}
    assert rows(con.frequency(df, ["k"], 1, 2)) == a
    assert rows(con.frequency(df, ["k"], 1, 3)) == set()
    assert rows(con.frequency(df, ["k"], None, None)) == set()


def test_keyed_check_equals_whole_check_at_its_keys(spark):
    df = spark.createDataFrame([(k % 7, k % 3, k) for k in range(60)], "a int, b int, c int")
    keys = spark.createDataFrame([(1,), (2,), (99,)], "a int")
    whole = rows(con.uniqueness(df, ["a", "b"]))
    assert rows(con.uniqueness(df, ["a", "b"], keys.crossJoin(spark.createDataFrame([(0,), (1,)], "b int")))) == {r for r in whole if r[0] in (1, 2) and r[1] in (0, 1)}


def test_rings(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string")
    assert rows(con.transitive(e)) == {("a", "c")}
    assert rows(con.transitive(e.union(spark.createDataFrame([("a", "c")], e.schema)))) == set()
    assert rows(con.reflexive(e.limit(0).union(spark.createDataFrame([("a", "b")], e.schema)))) == {("a", "a")}
    assert con.needed_rings(["irreflexive", "asymmetric"]) == ["asymmetric"]


def test_comparisons(spark):
    df = spark.createDataFrame([(1, 2), (2, 2), (3, 2)], "s int, e int")
    assert rows(con.value_comparison(df, "s", "<", "e")) == {(2, 2), (3, 2)}
    assert rows(con.value_comparison(df, "s", "<=", "e")) == {(3, 2)}
    assert rows(con.value_comparison(df, "s", ">=", "e")) == {(1, 2)}
    assert rows(con.value_comparison(df, "s", "<>", "e")) == {(2, 2)}


def test_data_types_and_domains(spark):
    df = spark.createDataFrame([("2026-02",), ("1.5",), ("-3",), ("7",), ("tall",), ("1e-7",), (None,)], "v string")
    bad = lambda t: {r.v for r in df.where(malformed(F.col("v"), t)).collect()}
    assert bad("integer") == {"2026-02", "1.5", "tall", "1e-7"}
    assert bad("unsigned") == {"2026-02", "1.5", "tall", "1e-7", "-3"}
    assert bad("decimal") == {"2026-02", "tall"}
    assert {r.v for r in con.value_domain(df, "v", Domain("text", max_length=3)).collect()} == {"2026-02", "tall", "1e-7"}


def test_join_paths():
    assert con.join_path([("A", ("x", "y")), ("B", ("z", "w")), ("C", ("y", "z"))]) == [0, 2, 1]
    assert con.join_path([("A", ("x", "y")), ("B", ("z", "w"))]) is None


def test_message(spark):
    df = spark.createDataFrame([(["p1", "Ann"],)], "b array<string>")
    assert df.select(con.message("{x} has {y}; {value}", F.col("b")).alias("m")).first().m == "p1 has Ann; p1"
