import pytest

from quarry.api import plan, q
from quarry.operators import index
from quarry.operators.aggregates import over_list
from quarry.operators.pull import pull, pull_frame
from quarry.plans.query import InsufficientBindings, QueryError, parse
from quarry.sources.database import Database, SchemaError, schema_of

SCHEMA = {":name": {":db/unique": ":db.unique/identity"}, ":friend": {":db/valueType": ":db.type/ref"}, ":aka": {":db/cardinality": ":db.cardinality/many"}}


@pytest.fixture(scope="module")
def db(spark):
    facts = [(1, ":name", "Petr"), (1, ":age", 44), (2, ":name", "Ivan"), (2, ":age", 25), (3, ":name", "Oleg"), (3, ":age", 11)]
    facts += [(1, ":friend", 2), (2, ":friend", 3), (3, ":friend", 1), (1, ":aka", "x"), (1, ":aka", "y")]
    return Database.of_datoms(spark, facts, schema_of(SCHEMA))


REACH = "[[(reach ?a ?b) [?a :friend ?b]] [(reach ?a ?b) [?a :friend ?c] (reach ?c ?b)]]"
CASES = [
    ("[:find ?n ?a :where [?e :name ?n] [?e :age ?a] [(> ?a 20)]]", (), [("Ivan", 25), ("Petr", 44)]),
    ("[:find ?n . :where [?e :name ?n] [?e :age 25]]", (), "Ivan"),
    ("[:find [?n ...] :in $ [?a ...] :where [?e :age ?a] [?e :name ?n]]", ([11, 25],), ["Ivan", "Oleg"]),
    ("[:find ?n ?x :in $ [[?n ?x]] :where [?e :name ?n]]", ([["Ivan", 1.5], ["Zed", 2.0]],), [("Ivan", 1.5)]),
    ("[:find (count ?e) (sum ?a) (min 2 ?a) (max 2 ?a) (median ?a) :where [?e :age ?a]]", (), [(3, 80, [11, 25], [25, 44], 25.0)]),
    ("[:find (count ?e) :where [?e :age 99]]", (), []),
    ("[:find ?n :where [?e :name ?n] (not [?e :aka _])]", (), [("Ivan",), ("Oleg",)]),
    ('[:find ?n :where [?e :name ?n] (or [?e :age 11] (and [?e :age 44] [?e :aka "x"]))]', (), [("Oleg",), ("Petr",)]),
    ('[:find ?n :where [?e :name ?n] (or-join [?e] [?e :aka "y"] (and [?e :age ?z] [(< ?z 12)]))]', (), [("Oleg",), ("Petr",)]),
    ("[:find (count ?b) . :in $ % :where (reach ?a ?b)]", (REACH,), 9),
    ('[:find [?m ...] :in $ % :where [?a :name "Ivan"] (reach ?a ?b) [?b :name ?m]]', (REACH,), ["Ivan", "Oleg", "Petr"]),
    ('[:find ?n ?v :where [?e :name ?n] [(get-else $ ?e :aka "none") ?v]]', (), [("Ivan", "none"), ("Oleg", "none"), ("Petr", "x")]),
    ("[:find ?n :where [?e :name ?n] [(missing? $ ?e :aka)]]", (), [("Ivan",), ("Oleg",)]),
    ("[:find ?n ?t ?v :where [?e :name ?n] [(get-some $ ?e :aka :age) [?t ?v]]]", (), [("Ivan", ":age", 25), ("Oleg", ":age", 11), ("Petr", ":aka", "x")]),
    ('[:find ?a ?v :where [?e ?a ?v] [?e :name "Ivan"]]', (), [(":age", 25), (":friend", 3), (":name", "Ivan")]),
    ("[:find ?x ?y :where [(ground [[1 2] [3 4]]) [[?x ?y]]]]", (), [(1, 2), (3, 4)]),
    ("[:find [?x ...] :where [(range 1 10 3) ?x]]", (), [1, 4, 7]),
    ("[:find ?x ?w :where [(vector 1 2 3) [?x _ ?y]] [(+ ?x ?y) ?w]]", (), [(1, 4)]),
    ("[:find ?a ?m ?r :where [?e :age ?a] [(- 0 ?a) ?n] [(mod ?n 10) ?m] [(rem ?n 10) ?r]]", (), [(11, 9, -1), (25, 5, -5), (44, 6, -4)]),
    ('[:find ?i ?n :where [?e :name ?n] [(clojure.string/index-of ?n "e") ?i]]', (), [(1, "Petr"), (2, "Oleg")]),
    ('[:find ?n :where [[:name "Ivan"] :friend ?f] [?f :name ?n]]', (), [("Oleg",)]),
    ("[:find ?n ?f :where [?e :name ?n] [?x :_friend ?e] [?x :name ?f]]", (), [("Ivan", "Oleg"), ("Oleg", "Petr"), ("Petr", "Ivan")]),
    ("{:find [?n] :keys [nm] :where [[?e :name ?n] [?e :age 11]]}", (), [{"nm": "Oleg"}]),
    ("[:find (pull ?e [:name {:friend [:name]}]) :where [?e :age 11]]", (), [({":name": "Oleg", ":friend": {":name": "Petr"}},)]),
    ("[:find [?n ...] :where [(> ?a 20)] [?e :age ?a] [?e :name ?n]]", (), ["Ivan", "Petr"]),
]


@pytest.mark.parametrize("text,inputs,want", CASES)
def test_query(db, text, inputs, want):
    assert q(text, db, *inputs) == want


def test_callables_and_two_sources(spark, db):
    assert q("[:find [?n ...] :in $ ?old :where [?e :age ?a] [(?old ?a)] [?e :name ?n]]", db, lambda a: a > 40) == ["Petr"]
    other = Database.of_datoms(spark, [(1, ":age", 25)])
    assert q("[:find [?n ...] :in $ $b :where [$b ?x :age ?a] [?e :age ?a] [?e :name ?n]]", db, other) == ["Ivan"]


def test_aggregate_over_a_list(spark, db):
    spread = over_list(lambda k, xs: k * (max(xs) - min(xs)), "long")
    assert q("[:find (aggregate ?f 10 ?a) (count ?e) :in $ ?f :where [?e :age ?a]]", db, spread) == [(330, 3)]
    join = over_list(lambda xs: "-".join(sorted(map(str, xs))), "string")
    assert q("[:find ?e (aggregate ?f ?n) :in $ ?f :where [?e :name _] [?e :aka ?n]]", db, join) == [(1, "x-y")]
    mixed = Database.of_datoms(spark, [(1, ":v", "a"), (2, ":v", 3)])
    assert q("[:find (aggregate ?f ?v) . :in $ ?f :where [?e :v ?v]]", mixed, join) == "3-a"


def test_relation_source(db):
    assert q("[:find ?n ?w :in $ $r :where [?e :name ?n] [$r ?n ?w]]", db, [("Ivan", 3), ("Q", 4)]) == [("Ivan", 3)]


@pytest.mark.parametrize("text,error", [("[:find ?x :where [?e :name ?n]]", "unknown vars"), ("[:where [?e :name ?n]]", ":find"), ("[:find ?e :with ?e :where [?e :name]]", ":with"), ("[:find ?n :keys a b :where [?e :name ?n]]", "Count of")])
def test_parse_errors(text, error):
    with pytest.raises(QueryError, match=error):
        parse(text)


def test_unbound_inputs_raise(db):
    with pytest.raises(InsufficientBindings):
        plan("[:find ?e :where [?e :age ?a] [(> ?b 3)]]", db)


def test_star_is_one_scan(spark):
    rows = spark.createDataFrame([(1, "a", 2.0), (2, "b", None)], "k long, n string, v double")
    t = Database(spark).with_table("t", rows, "k")
    df = plan("[:find ?n ?v :where [?e :t/n ?n] [?e :t/v ?v]]", t)
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in df.collect()] == [("a", 2.0)]


def test_pull(db):
    assert pull(db, "[:name {:friend ...}]", 1) == {":name": "Petr", ":friend": {":name": "Ivan", ":friend": {":name": "Oleg", ":friend": {":db/id": 1}}}}
    assert pull(db, '[[:aka :limit 1] [:zip :default "z"] [:age :as :years]]', 1) == {":aka": ["x"], ":zip": "z", ":years": 44}
    assert pull(db, "[*]", 2) == {":name": "Ivan", ":age": 25, ":friend": {":db/id": 3}, ":db/id": 2}
    assert pull(db, "[:name]", 77) is None
    rows = {r.e: r.pulled for r in pull_frame(db, "[:name {:_friend [:name]} :aka]").collect()}
    assert rows[1].name == "Petr" and rows[1]["_friend"][0].name == "Oleg" and rows[1].aka == ["x", "y"]


def test_pull_visitor(db):
    seen = []
    pull(db, "[* :name {:_friend [:db/id]}]", 2, lambda *event: seen.append(event))
    assert {("wildcard", 2), ("attr", 2, ":name"), ("attr", 2, ":age"), ("reverse", ":friend", 2)} <= set(seen)


def test_index(db):
    assert [r.v for r in index.datoms(db, ":aevt", ":name").collect()] == ["Petr", "Ivan", "Oleg"]
    with pytest.raises(SchemaError):
        index.index_range(db, ":age", 1, 2)
    assert [r.e for r in index.index_range(db, ":name", "Ivan", "Oleg").collect()] == [2, 3]
    assert [r.e for r in index.seek_datoms(db, ":aevt", ":name", 2).collect()] == [2, 3]
    assert [r.e for r in index.rseek_datoms(db, ":eavt", 1).collect() if r.a == ":name"] == [1]
    same = db.filter(lambda a, e, v: e > 1)
    left, right, both = index.diff(db, same)
    assert (left.count(), right.count(), both.count()) == (5, 0, 6)
    assert index.db_hash(db) != index.db_hash(same)
