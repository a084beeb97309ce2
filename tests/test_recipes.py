import pytest
from pyspark.sql import functions as F

from factloom.plans.recipe import Compiler, introduces, negated, printed, relation, replaced, sources
from factloom.plans.rules import RefusedRule, cycle_core, closure, derive, reach, refused, strata
from factloom.schema import Rule
from factloom.store import FactStore


def rows(df):
    return {tuple(r) for r in df.collect()}


@pytest.fixture(scope="module")
def people(spark):
    def rel(data, ddl):
        return relation(spark.createDataFrame(data, ddl))

    return FactStore(
        spark,
        {
            "Name": rel([("p1", "Ann"), ("p1", "Bea"), ("p2", "Cy"), ("p3", "Cy")], "a string, b string"),
            "Age": rel([("p1", 30), ("p2", 30), ("p3", 30)], "a string, b long"),
            "Happy": rel([("p1",), ("p4",)], "a string"),
            "Likes": rel([("p1", "p2"), ("p2", "p1"), ("p3", "p3"), ("p2", "p3")], "a string, b string"),
        },
    )


REACHES = Rule("Reaches", (["proj", "Likes", [1, 2]], ["joinon", "Reaches#base", "Likes", [[2, 1]], [1, 4]]))


def test_derived_populations(people):
    rules = [REACHES, Rule("Band", (["pairwith", ["proj", ["sel", "Age", 2, 30], [1]], "thirty"],)), Rule("Sad", (["minus", ["proj", "Name", [1]], "Happy"],))]
    d = derive(people, rules)
    assert rows(d.facts("Reaches")) == {(a, b) for a in ("p1", "p2") for b in ("p1", "p2", "p3")} | {("p3", "p3")}
    assert rows(d.facts("Band")) == {(p, "thirty") for p in ("p1", "p2", "p3")}
    assert rows(d.facts("Sad")) == {("p2",), ("p3",)}


def test_refused_rules(people):
    counts = Rule("Counts", (["count", "Counts", 1],))
    assert "Counts" in refused([counts])
    loop = [Rule("A", (["minus", "Name", "B"],)), Rule("B", ("A",))]
    assert refused(loop)
    with pytest.raises(RefusedRule):
        derive(people, loop)
    made = Rule("N", ("Age", ["proj", ["calc", "N", "+", 2, 2], [1, 3]]))
    assert "introduced" in refused([made])["N"]
    assert not refused([REACHES])


def test_strata_and_reach():
    rules = [Rule("C", (["minus", "B", "A"],)), Rule("B", ("X",)), Rule("A", ("B", "D")), Rule("D", ("A",))]
    order = strata(rules)
    assert order.index(["B"]) < order.index(["A", "D"]) < order.index(["C"])
    assert reach(rules, ["X"]) == {"A", "B", "C", "D"}


def test_recipe_helpers():
    r = ["joinon", "A", ["minus", "B", "A"], [[1, 1]], [1]]
    assert sources(r) == ["A", "B", "A"] and negated(r) == {"A"} and not introduces(r)
    assert replaced(r, 2, "Z") == ["joinon", "A", ["minus", "B", "Z"], [[1, 1]], [1]]


def test_exact_arithmetic(spark):
    data = [("150", "250", "2.5", "0.4", "1000000.1", "1000000"), ("2988", "12", "1.25", "80", "0.75", "0.25"), ("5", "0", "1", "1", "1", "1"), ("26154", "9339", "0.1", "3", "2", "3")]
    c = Compiler(lambda _: relation(spark.createDataFrame(data, ", ".join(f"x{k} string" for k in range(6)))))
    r = ["calc", ["calc", ["calc", "t", "/", 1, 2], "*", 3, 4], "-", 5, 6]
    got = {tuple(x) for x in c(r).df.select(*[printed(F.col(f"c{k}")) for k in (7, 8, 9)]).collect()}
    assert got == {("0.6", "1", "0.1"), ("249", "100", "0.5"), ("2.8005139736588", "0.3", "-1")}


def test_kinds_never_mix(people):
    assert rows(people.query(["sel", "Age", 2, "30"])) == set()
    with pytest.raises(TypeError):
        people.query(["cmp", "Age", 1, 2])
    assert rows(people.query(["joinon", "Age", "Name", [[2, 2]], [1]])) == set()
    with pytest.raises(IndexError):
        people.query(["proj", "Age", [3]])
    with pytest.raises(ValueError):
        people.query(["nope", "Age"])


def test_projection_that_keeps_a_key_needs_no_shuffle(spark):
    df = spark.range(10).selectExpr("id", "id % 3 as v")
    c = Compiler(lambda _: relation(df, (1,)))
    plan = c.rows(["proj", "t", [2, 1]])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert "Exchange" in c.rows(["proj", "t", [2]])._jdf.queryExecution().executedPlan().toString()


def test_cycle_core_and_closure(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("e", "a")], "a string, b string")
    core = cycle_core(e)
    assert rows(core) == {("b", "c"), ("c", "b")}
    assert rows(closure(core)) == {(x, y) for x in "bc" for y in "bc"}


def test_ask_and_membership(people):
    assert people.has("Name", "p3", "Cy") and not people.has("Name", "p3", "Ann")
    assert "Nothing" not in people
    assert [n for n, _ in people.ask([(1, "Happy")])] == ["Happy"]


def test_arithmetic_is_exact(spark):
    from decimal import Decimal, localcontext

    big = 9_000_000_000_000_000_000
    df = spark.createDataFrame([(0.1234567891, 3.0, big, 7, 2.5, 0.4), (1e-9, 1e-10, 10**13, 3, 1000000.1, 1000000.0), (-7.25, 0.3, -(10**15) - 1, 10**6, 0.1, 0.2)], "a double, b double, c long, d long, e double, f double")
    store = {"t": relation(df)}

    def calc(op, i, j):
        return [r[-1] for r in Compiler(store.get)(["calc", "t", op, i, j]).df.collect()]

    def want(op, i, j):
        rows = [[Decimal(repr(x)) for x in r] for r in df.collect()]
        digits = {"/": 13, "*": 17}.get(op)
        with localcontext(prec=60):
            return [x if digits is None else x.quantize(Decimal(10) ** -digits, "ROUND_HALF_UP") for x in [{"/": lambda x, y: x / y, "*": lambda x, y: x * y, "+": lambda x, y: x + y, "-": lambda x, y: x - y}[op](r[i - 1], r[j - 1]) for r in rows]]

    for i, j in ((1, 2), (3, 4), (5, 6), (4, 2), (5, 4)):
        assert calc("/", i, j) == want("/", i, j), (i, j)
    for op in "+-*":
        for i, j in ((1, 2), (5, 6), (1, 6)):
            assert calc(op, i, j) == want(op, i, j), (op, i, j)
    assert calc("*", 4, 4) == [49, 9, 10**12] and calc("-", 3, 4) == [big - 7, 10**13 - 3, -(10**15) - 1 - 10**6]
    for row, op, text in ((0, "*", "1"), (1, "-", "0.1")):
        column = Compiler(store.get)(["calc", "t", op, 5, 6]).df.select(printed(F.col("c7")).alias("p")).collect()
        assert column[row].p == text


def test_quotients_are_rounded_by_all_their_digits(spark):
    """The 14th decimal and those after it decide by less than a double can tell; so do halves, of either sign."""
    from decimal import Decimal, localcontext

    big = 9_223_372_036_854_775_807
    pairs = [(292070000000000000, 1319), (914530000000000000, 987), (1270860000000000000, 2603), (1, 2**14), (-1, 2**14), (49151, 2**14), (-49151, 2**14), (5, -(2**14)), (big, big - 1), (-big, 3), (big - 1, big), (0, 7)]
    doubles = [(0.1, 12345678.9), (1e-9, 3e8), (9e18, 7.000000001), (-2.5, 98765432.1), (8e18, 8.5e18), (-0.3, -1e-18), (1.0, 16384.0)]
    frames = [spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(doubles, "a double, b double")]
    frames.append(frames[0].selectExpr("a", "double(b) as b").where("abs(b) < 1e15"))
    for df in frames:
        with localcontext(prec=80):
            rows = [[Decimal(repr(x)) for x in r] for r in df.collect()]
            want = [(x / y).quantize(Decimal(10) ** -13, "ROUND_HALF_UP") for x, y in rows]
        got = [r[-1] for r in Compiler({"t": relation(df)}.get)(["calc", "t", "/", 1, 2]).df.collect()]
        assert got == want
