import json

import pytest
from pyspark.sql import functions as F

from factloom.functions import ffp, readings, scalars
from factloom.functions.registry import Registry
from factloom.operators import sets
from factloom.plans import rmap
from factloom.plans.recipe import relation
from factloom.plans.rules import derive
from factloom.schema import DEONTIC
from factloom.sources import federation, files, replica
from factloom.store import FactStore, flag, from_table, reference_facts


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_primitives(spark):
    xs = F.array(F.lit(3), F.lit(1), F.lit(2))
    assert one(spark, ffp.tl(xs)) == [1, 2] and one(spark, ffp.tlr(xs)) == [3, 1] and one(spark, ffp.last(xs)) == 2
    assert one(spark, ffp.trans(F.array(xs, xs))) == [[3, 3], [1, 1], [2, 2]]
    assert one(spark, ffp.div(F.lit(-7), F.lit(2))) == -3 and one(spark, ffp.div(F.lit(7), F.lit(-2))) == -3
    assert one(spark, ffp.insert(lambda a, b: a - b)(xs)) == 3 - (1 - 2)
    assert one(spark, ffp.comp(ffp.length, ffp.tl)(xs)) == 2 and one(spark, ffp.cons(ffp.select(1), ffp.select(3))(xs)) == [3, 2]
    assert one(spark, ffp.negate(F.lit(None).cast("boolean"))) is True
    assert one(spark, ffp.bounded_while(lambda x: x < 20, lambda x: x * 2, 10)(F.lit(3))) == 24
    for bad in (ffp.select(4)(xs), ffp.tl(F.array().cast("array<int>")), ffp.div(F.lit(1), F.lit(0)), ffp.add(F.lit(2**63 - 1), F.lit(1))):
        with pytest.raises(Exception):
            one(spark, bad)


def test_list_helpers(spark):
    xs = F.array(*[F.lit(x) for x in (3, 1, 2, 1)])
    assert one(spark, sets.dedup_last(xs)) == [3, 2, 1] and one(spark, sets.dedup_sorted(xs)) == [1, 2, 3]
    assert one(spark, sets.drop(xs, -1)) == [] and one(spark, sets.drop(xs, 9)) == [] and one(spark, sets.take(xs, 2)) == [3, 1]
    assert one(spark, sets.last(F.array().cast("array<string>"))) == "?"
    assert one(spark, sets.iota(F.lit(0))) == [] and one(spark, sets.iota(F.lit(3))) == [1, 2, 3]
    assert sets.mixed_sort([("b", 1), "x", ("a", 2), 7, ("a", 1), ("a", 2)]) == [7, "x", ("a", 1), ("a", 2), ("b", 1)]
    assert sets.atoms([1, ["a", [2]], "b"]) == [1, "a", 2, "b"]


def test_scalars(spark):
    assert one(spark, scalars.rounded(F.lit(-15), -1)) == -20
    assert one(spark, scalars.quoted(F.lit('a"b\n'))) == json.dumps('a"b\n')
    assert one(spark, scalars.json_path(F.lit('{"a":[{"b":null},{"b":"x"}]}'), "a.*.b")) == "x"
    assert one(spark, scalars.json_path(F.lit('{"a":[5,6]}'), "a.1")) == "6"
    assert one(spark, scalars.filled("{a|upper}-{b}{c|present}", {"a": F.lit("x"), "b": F.lit(None), "c": F.lit(1)})) == "X-true"
    assert [one(spark, scalars.plural(F.lit(n))) for n in ("child", "person", "day", "class", "box", "city", "quiz", "order")] == ["children", "people", "days", "classes", "boxes", "cities", "quizzes", "orders"]
    assert one(spark, scalars.decrypt(scalars.encrypt(F.lit("secret"), "key"), "key")) == "secret"
    assert one(spark, scalars.address(F.lit("1.2.3.256"))) is None and one(spark, scalars.in_cidr(F.lit("192.168.3.4"), "192.168.0.0/16"))
    assert one(spark, scalars.is_past(F.lit("2000-01-01").cast("timestamp"))) and one(spark, F.length(scalars.clock())) == 24


READINGS = """
# People
Person(.id) is an entity type.
Name is a value type.
Age is a value type.
Mood is a value type.
The possible values of Mood are 'glad', 'sad'.
Worker is a subtype of Person.
Person has Name.
Person has Age.
Person is happy.
Person likes Person.
Person reaches Person.
Person has Mood.
Each Person has at most one Name.
Each Person has exactly one Age.
For each Name, at most one Person has that Name.
Each Person, Person combination occurs at most once in the population of Person likes Person.
No Person likes itself.
If Person1 likes Person2 then it is impossible that Person2 likes Person1.
If Person is happy then Person has Name.
Person likes Person is acyclic.
It is forbidden that Person likes Person.
* Person1 reaches Person2 iff Person1 likes Person2 or Person1 reaches Person3 and Person3 likes Person2.
+ Person is glad if Person has Mood 'glad' and no Person is happy.
Person 'p1' likes Person 'p2'.
Person 'p2' likes Person 'p3'.
Person 'p1' has Mood 'glad'.
Person 'p2' has Mood 'glad'.
Person 'p2' is happy.
Gibberish that means nothing at all.
"""


def test_sentences(spark):
    p = readings.Parser().read(READINGS)
    assert p.unknown == ["Gibberish that means nothing at all."]
    assert p.object_types["Person"].reference == "id" and p.object_types["Worker"].supertypes == ("Person",)
    assert p.object_types["Mood"].domain.values == ("glad", "sad")
    kinds = [(c.kind, c.modality) for c in p.constraints]
    assert kinds.count(("uniqueness", "alethic")) == 3 and ("mandatory", "alethic") in kinds and ("subset", "alethic") in kinds and ("prohibition", DEONTIC) in kinds
    assert [c.args[1] for c in p.constraints if c.kind == "ring"] == ["irreflexive", "asymmetric", "acyclic"]
    assert p.facts["PersonLikesPerson"] == [("p1", "p2"), ("p2", "p3")]
    populations = {n: relation(spark.createDataFrame(p.facts.get(n, []), ", ".join(f"x{k} string" for k in range(f.arity)))) for n, f in p.fact_types.items() if n not in {r.head for r in p.rules}}
    d = derive(FactStore(spark, populations, p.schema()), p.rules)
    assert rows(d.facts("PersonReachesPerson")) == {("p1", "p2"), ("p2", "p3"), ("p1", "p3")}
    assert rows(d.facts("PersonIsGlad")) == {("p1",)}
    said = [readings.verbalize(c, p.fact_types) for c in p.constraints]
    assert "Each Person has at most one Name." in said and "Person likes Person is acyclic." in said
    again = readings.Parser().read("\n".join(line for line in READINGS.splitlines() if "type" in line) + "\nPerson has Name.\n" + said[0])
    assert [c.kind for c in again.constraints] == ["uniqueness"]
    assert readings.tokens("Order-Line has 'a b' 12.") == [("word", "Order-Line"), ("word", "has"), ("value", "a b"), ("number", "12"), ("mark", ".")]


def test_readings_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("A is an entity type.\nB is a value type.\n")
    (tmp_path / "b.md").write_text("A has B.\nEach A has at most one B.\n")
    p = readings.read_files(spark, str(tmp_path))
    assert list(p.fact_types) == ["AHasB"] and p.fact_types["AHasB"].unique == ((1,),)


def test_tables_and_facts(spark):
    df = spark.createDataFrame([(1, "a", "x", True), (2, None, "y", False), (3, "c", None, True)], "k int, p string, q string, f boolean")
    assert rows(from_table(df, "k", "p").df) == {(1, "a"), (3, "c")}
    assert rows(from_table(df, ("p", "q"), "k").df) == {("a.x", 1)}
    assert rows(flag(df, "k", "f").df) == {(1,), (3,)} and rows(reference_facts(df, "p").df) == {("a", "a"), ("c", "c")}
    p = readings.Parser().read(READINGS)
    assert rmap.layout(p.schema())["PersonLikesPerson"] == ("Person", "Person")
    for dialect in ("spark", "sqlite", "postgres", "mysql", "sqlserver", "oracle", "duckdb"):
        assert any("Person" in s for s in rmap.ddl(p.schema(), dialect))
    import duckdb

    db = duckdb.connect()
    for s in rmap.ddl(p.schema(), "duckdb"):
        db.execute(s)
    assert rmap.json_schema(df)["properties"]["k"] == {"type": "integer"}


def test_warehouse(spark, tmp_path):
    store = FactStore(spark, {"A": relation(spark.createDataFrame([(1, "x")], "a int, b string"), (1,))})
    w = files.Warehouse(spark, f"{tmp_path}/w")
    with pytest.raises(FileNotFoundError):
        w.open()
    w.install(store)
    w.install(store.with_facts(A=spark.createDataFrame([(2, "y")], "a int, b string")))
    assert w.version() == 2 and rows(w.open().facts("A")) == {(2, "y")} and rows(w.open(version=1).facts("A")) == {(1, "x")}


def test_federation(spark):
    answers = {None: {"d": {"rows": [{"id": "1", "v": "a", "ok": True, "t": "x"}], "next": "p2"}}, "p2": {"d": {"rows": [{"id": "2", "ok": False, "t": "x"}, {"id": "3", "v": "c", "t": "y"}]}}}
    c = federation.Connector("http://x", path="d.rows", cursor="d.next")
    got = list(federation.rows_of(c, fetch=lambda url, h, b: json.dumps(answers["p2" if "cursor=p2" in url else None]).encode()))
    df = spark.createDataFrame([(r,) for r in got], "row string")
    f = federation.facts(df, "id", {"HasV": "v", "IsOk": "ok"}, where={"t": "x"}, flags=("IsOk",))
    assert rows(f["HasV"]) == {("1", "a")} and rows(f["IsOk"]) == {("1",)}
    assert {r.document for r in federation.documents({"v": f["HasV"]}).collect()} == {'{"v":"a"}'}
    assert federation.citation("u", "a", "d") == federation.citation("u", "a", "d") != federation.citation("u", "b", "d")


def test_federation_source(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            page = self.path.partition("cursor=")[2] or "0"
            body = json.dumps({"rows": [{"id": page}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    c = federation.Connector(f"http://127.0.0.1:{server.server_port}/", path="rows", pages=("1", "2", "3"))
    assert sorted(json.loads(r.row)["id"] for r in federation.load(spark, c).collect()) == ["1", "2", "3"]
    server.shutdown()


def test_mailboxes(spark, tmp_path):
    (tmp_path / "a.mbox").write_text("From a@b Mon Jan  1 00:00:00 2024\nFrom: a@b\nSubject: Hi\nMessage-ID: <1>\n\nmine\n> theirs\nOn Monday X wrote:\nmore\n--\nsignature\n\n")
    r = files.mailboxes(spark, str(tmp_path / "a.mbox")).first()
    assert (r.subject, r.message_id, r.own_text) == ("Hi", "<1>", "mine\nmore")
    files.write_atomically(str(tmp_path / "x"), "t")
    assert (tmp_path / "x").read_text() == "t"


def test_registry(spark):
    r = Registry()
    twice = r.register(spark, "twice", lambda s: s * 2, ("long",), "long", total=True)
    assert spark.range(3).select(twice("id").alias("x")).agg(F.sum("x")).first()[0] == 6
    with pytest.raises(ValueError):
        r.register(spark, "twice", lambda s: s, ("long",), "long")
    r.register(spark, "partial", lambda s: s, ("long",), "long")
    with pytest.raises(ValueError):
        r.for_rules("partial")
    assert r.unregistered({"twice", "x"}) == {"x"} and r.pick(1, 2) == 1


def test_listed(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 7), (3, "b", 9), (4, "a", 7)], "k int, g string, v int")
    assert [r.k for r in replica.listed(df, where={"g": "a"}, sort="v", descending=True, limit=2).collect()] == [2, 4]


def test_sentences_of_constraints_and_conditions():
    text = """
    Order(.nr) is an entity type. Customer(.nr) is an entity type. Room(.nr) is an entity type. Slot(.nr) is an entity type.
    Order placed by Customer. Order has Amount. Amount is a value type. Customer books Room at Slot. Customer is active.
    Room has Slot. Room seats Customer. Customer pays Amount.
    For each Customer and Slot, that Customer books Room at that Slot at most one Amount.
    Each Customer occurs at most once in the population of Customer is active.
    Each Order occurs at least 1 and at most 3 times in the population of Order placed by Customer.
    For each Slot and Customer, at most one Room has that Slot and seats that Customer.
    It is impossible that more than one Room has the same Slot and seats the same Customer.
    If Order1 placed by Customer1 then Order1 has Amount1.
    If Order1 placed by Customer1 then Customer1 pays Amount1.
    """
    p = readings.Parser().read(text)
    found = [(c.kind, c.args) for c in p.constraints]
    # the first says nothing of a declared fact type
    assert p.unknown == ["For each Customer and Slot, that Customer books Room at that Slot at most one Amount."]
    assert ("frequency", ("OrderPlacedByCustomer", (1,), 1, 3)) in found
    assert found.count(("external", (["RoomHasSlot", "RoomSeatsCustomer"],))) == 2
    assert ("subset", (["proj", "OrderPlacedByCustomer", [1]], ["proj", "OrderHasAmount", [1]])) in found
    assert ("subset", (["proj", "OrderPlacedByCustomer", [2]], ["proj", "CustomerPaysAmount", [1]])) in found
    assert p.fact_types["CustomerIsActive"].unique == ((1,),)
    p = readings.Parser().read("A(.x) is an entity type. B(.x) is an entity type. C(.x) is an entity type. A sells B to C. For each A and B, that A sells B to at most one C. It is impossible that the same A sells the same B to more than one C.")
    assert not p.unknown and p.fact_types["ASellsBToC"].unique == ((1, 2),)
    # a clause that isn't about declared facts, and a condition without a shared variable, aren't guessed
    p = readings.Parser().read("A(.x) is an entity type. B(.x) is an entity type. A has B. A likes B. * A likes B iff A has B and B flies. If A1 has B1 then A2 likes B2.")
    assert len(p.unknown) == 2 and not p.constraints


def test_table_constraints():
    from factloom.schema import FactType, ObjectType, Schema
    from factloom.types import Domain

    schema = Schema(
        {"Person": ObjectType("Person"), "Team": ObjectType("Team"), "Grade": ObjectType("Grade", False, domain=Domain("text", values=("a", "o'b"))), "Badge": ObjectType("Badge", False)},
        {
            "PersonHasGrade": FactType("PersonHasGrade", ("Person", "Grade"), unique=((1,),), mandatory=(1,)),
            "PersonHasBadge": FactType("PersonHasBadge", ("Person", "Badge"), unique=((1,), (2,))),
            "TeamHasGrade": FactType("TeamHasGrade", ("Team", "Grade"), unique=((1,),)),
            "PersonInTeam": FactType("PersonInTeam", ("Person", "Team"), unique=((1, 2),)),
        },
    )
    said = rmap.ddl(schema, "duckdb")
    assert said[0] == 'CREATE TABLE "Person" ("Person" VARCHAR NOT NULL, "PersonHasGrade" VARCHAR NOT NULL, "PersonHasBadge" VARCHAR, PRIMARY KEY ("Person"), CHECK ("PersonHasGrade" IN (\'a\', \'o\'\'b\')), UNIQUE ("PersonHasBadge"))'
    assert said[2] == 'CREATE TABLE "PersonInTeam" ("Person" VARCHAR NOT NULL, "Team" VARCHAR NOT NULL, UNIQUE ("Person", "Team"), FOREIGN KEY ("Person") REFERENCES "Person" ("Person"), FOREIGN KEY ("Team") REFERENCES "Team" ("Team"))'
    import duckdb

    db = duckdb.connect()
    for s in said:
        db.execute(s)
    db.execute("INSERT INTO \"Person\" VALUES ('p', 'a', 'b1')")
    for bad in ("('q', 'z', 'b2')", "('q', 'a', 'b1')", "('p', 'a', 'b2')"):
        with pytest.raises(duckdb.ConstraintException):
            db.execute(f'INSERT INTO "Person" VALUES {bad}')
    assert not any("UNIQUE" in s or "CHECK" in s for s in rmap.ddl(schema))


def test_mailbox_filters(spark, tmp_path):
    def message(head, body):
        return f"From a@b Mon Jan  1 00:00:00 2024\n{head}\n\n{body}\n\n"

    text = message("From: Ann <a@b>\nTo: c@d\nCc: Eve <e@f>\nMessage-ID: <1>", "one") + message("From: a@b\nMessage-ID: <2>\nX-Mozilla-Status: 0009", "deleted") + message("From: a@b\nSubject: no id", "nameless")
    text += message("From: x@y\nTo: e@f\nMessage-ID: <4>\nContent-Type: text/html", "<style>p {}</style><p>four &amp; <b>more</b></p>")
    (tmp_path / "a.mbox").write_text(text)
    load = lambda **wanted: {r.message_id: (r.text, [tuple(x) for x in r.recipients]) for r in files.mailboxes(spark, str(tmp_path / "a.mbox"), **wanted).collect()}
    every = load()
    assert {k: (t.split(), to) for k, (t, to) in every.items()} == {"<1>": (["one"], [("to", "c@d"), ("cc", "e@f")]), "<4>": (["four", "&", "more"], [("to", "e@f")])}
    assert set(load(sender="a@b")) == {"<1>"} and set(load(recipient="e@f")) == {"<1>", "<4>"} and set(load(id="4")) == {"<4>"} and load(sender="a@b", id="4") == {}


def test_subtypes_and_one_to_one_facts_in_tables():
    from factloom.schema import FactType, ObjectType, Schema

    def f(name, a, b, unique, mandatory=()):
        return name, FactType(name, (a, b), unique=unique, mandatory=mandatory)

    schema = Schema(
        {"Party": ObjectType("Party"), "Person": ObjectType("Person", supertypes=("Party",)), "Firm": ObjectType("Firm", supertypes=("Party",)), "Desk": ObjectType("Desk"), "Name": ObjectType("Name", False)},
        dict(
            [
                f("PartyHasName", "Party", "Name", ((1,),)),
                f("PersonBornOn", "Person", "Date", ((1,),)),
                f("FirmHasTax", "Firm", "Tax", ((1,),)),
                f("PersonUsesDesk", "Person", "Desk", ((1,), (2,)), (2,)),
                f("PersonOwnsFirm", "Person", "Firm", ((1, 2),)),
            ]
        ),
    )
    owns = {"PersonOwnsFirm": ("Person", "Firm")}
    # each desk is used and not each person has one, so the desk's table has the fact
    desk = {"Desk": ("Desk", "PersonUsesDesk")}
    assert rmap.layout(schema) == {"Party": ("Party", "PartyHasName"), "Person": ("Person", "PersonBornOn"), "Firm": ("Firm", "FirmHasTax")} | desk | owns
    assert rmap.layout(schema, "absorb") == {"Party": ("Party", "PartyHasName", "Person", "PersonBornOn", "Firm", "FirmHasTax")} | desk | owns
    assert rmap.layout(schema, "partition") == {"Person": ("Person", "PartyHasName", "PersonBornOn"), "Firm": ("Firm", "PartyHasName", "FirmHasTax")} | desk | owns
    with pytest.raises(ValueError):
        rmap.layout(schema, "other")
