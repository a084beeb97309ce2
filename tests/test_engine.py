import pytest
from pyspark.sql import functions as F

from factloom.engine import Engine
from factloom.plans import library
from factloom.plans.recipe import relation
from factloom.schema import Machine, Transition
from factloom.store import FactStore

MODEL = """
Order(.id) is an entity type.
Customer(.id) is an entity type.
Amount is a value type.
Order is placed by Customer.
Order has Amount.
Order is paid.
Order is shipped.
Each Order is placed by at most one Customer.
Order 'o1' is placed by Customer 'c1'.
Order 'o2' is placed by Customer 'c1'.
Order 'o1' has Amount '10'.
Order 'o2' has Amount '10'.
* Customer has Order if Order is placed by Customer.
"""
FLOW = Machine("order", "Order", (Transition("pay", "Open", "Paid", "OrderIsPaid"), Transition("ship", "Paid", "Shipped", "OrderIsShipped")), initial="Open")


def rows(df):
    return {tuple(r) for r in df.collect()}


@pytest.fixture()
def engine(spark):
    return Engine.compile(spark, MODEL, [FLOW])


def test_reading(engine):
    assert rows(engine.query("CustomerHasOrder")) == {("c1", "o1"), ("c1", "o2")}
    assert rows(engine.get("Order", "o1")) == {("OrderIsPlacedByCustomer", "o1", "c1"), ("OrderHasAmount", "o1", "10"), ("CustomerHasOrder", "c1", "o1")}
    assert engine.verify() and engine.refused_rules() == {}
    assert engine.fetch("Order:o2").count() == 3 and engine.search("O2").count() == 3
    assert "Order 'o1' has Amount '10'." in engine.synthesize("Order", "o1")
    assert engine.verbalize() == ["Each Order is placed by at most one Customer."]
    assert rows(engine.explain("CustomerHasOrder", ("c1", "o1")).select("arm", "antecedents")) == {(0, "OrderIsPlacedByCustomer")}
    assert [n for n, _ in engine.ask([(1, "OrderHasAmount")])] == ["OrderHasAmount"]
    assert ("OrderIsPlacedByCustomer", "child") in engine.nav("Order")
    with pytest.raises(ValueError):
        Engine.compile(engine.store.spark, "What is this thing.")


def test_design(engine):
    found = engine.csdp()
    assert ("OrderHasAmount", (1,)) in found["uniqueness"] and ("OrderIsPlacedByCustomer", 1) in found["mandatory"]
    assert rows(engine.table("Order").select("Order", "OrderIsPlacedByCustomer")) == {("o1", "c1"), ("o2", "c1")}


def test_writing_and_machines(engine):
    engine.snapshot("start")
    assert engine.create(OrderIsPlacedByCustomer=[("o1", "c2")]).status == "refused"
    assert engine.create(OrderIsShipped=[("o2",)]).status == "committed"  # not paid: no move
    assert engine.create(OrderIsPaid=[("o1",)]).status == "committed"
    assert rows(engine.status("Order")) == {("o1", "Paid"), ("o2", "Open")}
    assert rows(engine.actions("Order").select("entity", "trigger")) == {("o1", "OrderIsShipped"), ("o2", "OrderIsPaid")}
    engine.bulk([{"OrderHasAmount": [("o3", "5")]}, {"OrderIsPlacedByCustomer": [("o3", "c2")]}])
    engine.create(OrderIsShipped=[("o1",)])
    assert rows(engine.orient("Order")) == {("o2", "Open"), ("o3", "Open")}
    assert engine.replace("OrderHasAmount", ("o1",), ("o1", "11")).status == "committed"
    assert engine.store.has("OrderHasAmount", "o1", "11") and not engine.store.has("OrderHasAmount", "o1", "10")
    engine.rollback("start")
    assert not engine.store.has("OrderIsPaid", "o1") and engine.snapshots() == ["start"]
    assert engine.migrate({"OrderIsPaid": ["proj", ["sel", "OrderHasAmount", 2, "10"], [1]]}).status == "committed"
    assert rows(engine.query("OrderIsPaid")) == {("o1",), ("o2",)}


def test_induction(engine):
    s = engine.store.spark
    domains = {"o": s.createDataFrame([("o1",), ("o2",)], "o string"), "c": s.createDataFrame([("c1",), ("c2",)], "c string")}
    found = engine.induce(domains, [engine.view.facts("OrderIsPlacedByCustomer").toDF("o", "c")], F.lit(1))
    assert rows(found.select("o", "c")) == {("o1", "c2"), ("o2", "c2")} and found.select("id").distinct().count() == 2


def test_library(spark):
    def f(*data):
        return relation(spark.createDataFrame(list(data), ", ".join(f"x{k} string" for k in range(len(data[0])))))

    store = FactStore(
        spark,
        {
            "DomainIsContainedInDomain": f(("b", "a"), ("c", "b")),
            "RuleHasAntecedentFactType": f(("r1", "F"), ("r2", "G"), ("r3", "H")),
            "RuleProducesFactType": f(("r1", "G"), ("r2", "H"), ("r3", "H")),
            "InstanceIsInstanceOfType": f(("x", "Dog"), ("x", "Animal"), ("y", "Animal")),
            "TypeIsSubtypeOfType": f(("Dog", "Animal"), ("Animal", "Thing")),
            "TransitionIsFromStatus": f(("t", "p"), ("u", "q")),
            "TransitionIsToStatus": f(("t", "q"), ("u", "r")),
            "TransitionIsDefinedInMachine": f(("t", "m"), ("u", "m")),
            "ConstraintIsOfType": f(("c1", "AS"), ("c2", "IR")),
            "ConstraintTypeImpliesConstraintType": f(("AS", "IR")),
            "ConstraintSpansRole": f(("c1", "role"), ("c2", "role")),
        },
    )
    d = library.about(store)
    assert rows(d.facts("DomainReachesDomain")) == {("a", "b"), ("b", "c"), ("a", "c")}
    assert rows(d.facts("RuleReachesRule")) == {("r2", "r1"), ("r3", "r2"), ("r3", "r3"), ("r3", "r1")}
    assert rows(d.facts("InstanceIsMostSpecificallyOfType")) == {("x", "Dog"), ("y", "Animal")}
    assert ("x", "Thing") in rows(d.facts("InstanceIsInheritedInstanceOfType"))
    assert rows(d.facts("StatusIsRootedInMachine")) == {("p", "m")} and ("p", "r") in rows(d.facts("StatusReachesStatus"))
    assert rows(d.facts("ConstraintIsRedundant")) == {("c2",)}
    assert "PredicateIsBound" not in d


def test_update_delete_transition_and_links(spark):
    from factloom.engine import Engine
    from factloom.plans.tx import REFUSED
    from factloom.schema import Machine, Transition

    e = Engine.compile(
        spark,
        """
        Person(.nr) is an entity type. Name is a value type. Person has Name. Each Person has at most one Name. Person likes Person. Person joins. Person leaves.
        Person 'p1' has Name 'Ann'. Person 'p2' has Name 'Bob'. Person 'p1' likes Person 'p2'. Person 'p2' likes Person 'p1'.
        """,
        [Machine("m", "Person", (Transition("j", "out", "in", "PersonJoins"), Transition("l", "in", "gone", "PersonLeaves")), initial="out")],
    )
    rows = lambda df: {tuple(r) for r in df.collect()}
    assert e.update("PersonHasName", ("p1", "Eve")).status != REFUSED and rows(e.query("PersonHasName")) == {("p1", "Eve"), ("p2", "Bob")}
    assert rows(e.links("Person", "p1", 1).select("fact_type", "total")) == {("PersonHasName", 1), ("PersonLikesPerson", 1)}
    assert e.transition("Person", "p1", "PersonLeaves").status == REFUSED
    assert e.transition("Person", "p1", "PersonJoins").status != REFUSED and rows(e.status("Person")) == {("p1", "in")}
    assert e.transition("Person", "p1", "PersonLeaves").status != REFUSED and rows(e.status("Person")) == {("p1", "gone")}
    assert e.transition("Person", "p1", "PersonJoins").status == REFUSED
    assert e.delete("Person", "p2").status != REFUSED
    assert rows(e.query("PersonHasName")) == {("p1", "Eve")} and rows(e.query("PersonLikesPerson")) == set()


def test_a_write_of_many_violations_lists_the_first(spark):
    from factloom.plans import tx
    from factloom.plans.recipe import relation
    from factloom.schema import Constraint
    from factloom.store import FactStore

    store = FactStore(spark, {"N": relation(spark.range(3).selectExpr("id as a", "id as b"))})
    w = tx.Writer([Constraint("uc", "uniqueness", ("N", (2,)))])
    many = spark.range(3000).selectExpr("id + 10 as a", "id div 2 + 10 as b")
    answer = w.apply(store, add={"N": many})
    assert answer.status == tx.REFUSED and len(answer.violations) == tx.LISTED and answer.table.count() == 3000
    assert w.apply(store, add={"N": many.where("a % 2 = 0")}).status == tx.COMMITTED
