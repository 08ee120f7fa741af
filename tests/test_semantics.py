"""Cases that went wrong once: rows without a key, writes to tables, collections as values, Python callables."""

import datetime as dt

import pytest

from quarry.api import plan, q
from quarry.functions.callables import function
from quarry.operators import bulk
from quarry.operators.pull import pull_frame
from quarry.operators.transact import TransactionError
from quarry.plans.query import QueryError
from quarry.sources.database import Attr, Database, schema_of
from quarry.streaming import ingest


@pytest.fixture(scope="module")
def keyless(spark):
    rows = [(1, None), (None, 5), (3, 7), (4, None), (5, 9)]
    return Database(spark).with_table("t", spark.createDataFrame(rows, "a long, b long").repartition(3))


def test_rows_without_a_key_are_one_entity_each(keyless):
    assert q("[:find ?a ?b :where [?e :t/a ?a] [(get-else $ ?e :t/b -1) ?b]]", keyless) == [(1, -1), (3, 7), (4, -1), (5, 9)]
    assert q("[:find [?a ...] :where [?e :t/a ?a] (not [?e :t/b _])]", keyless) == [1, 4]
    assert q("[:find ?a ?b :where [?e :t/a ?a] [?e :t/b ?b]]", keyless) == [(3, 7), (5, 9)]
    assert len(q("[:find ?e ?x ?v :where [?e ?x ?v]]", keyless)) == 7


def test_writes_to_columns_of_tables(spark):
    db = Database(spark).with_table("t", spark.createDataFrame([(1, 5), (2, 6), (3, None)], "k long, v long"), "k", schema={":t/k": Attr(unique="identity")})
    e = (1 << 48) + 1
    out = bulk.bulk_add(db, ":t/v", spark.createDataFrame([(e, 99), (e + 2, 1)], "e long, v long"))
    assert q("[:find ?k ?v :where [?e :t/k ?k] [?e :t/v ?v]]", out) == [(1, 99), (2, 6), (3, 1)]
    assert q("[:find ?k ?v :where [?e :t/k ?k] [?e :t/v ?v]]", db) == [(1, 5), (2, 6)]
    less = bulk.bulk_retract(out, spark.createDataFrame([(e,)], "e long"))
    assert q("[:find ?k ?v :where [?e :t/k ?k] [?e :t/v ?v]]", less) == [(2, 6), (3, 1)]
    none = bulk.bulk_retract_facts(out, ":t/v", spark.createDataFrame([(e + 1, 6), (e + 2, 77)], "e long, v long"))
    assert q("[:find ?k ?v :where [?e :t/k ?k] [?e :t/v ?v]]", none) == [(1, 99), (3, 1)]
    with pytest.raises(TransactionError):
        bulk.bulk_add(db, ":t/k", spark.createDataFrame([(e, 2)], "e long, v long"))
    typed = Database(spark, {":n": Attr(value_type=":db.type/long")})
    with pytest.raises(TransactionError):
        bulk.bulk_add(typed, ":n", spark.createDataFrame([(1, "x")], "e long, v string"))


def test_rows_of_a_keyless_table_keep_their_numbers_when_others_go(spark, keyless):
    gone = plan("[:find ?e :where [?e :t/a ?a] [(< ?a 4)]]", keyless)
    assert q("[:find ?a ?b :where [?e :t/a ?a] [(get-else $ ?e :t/b -1) ?b]]", bulk.bulk_retract(keyless, gone)) == [(4, -1), (5, 9)]


@pytest.fixture(scope="module")
def db(spark):
    return Database.of_datoms(spark, [(1, ":n", "a"), (2, ":n", "bb"), (1, ":l", [10, 1]), (2, ":l", [9]), (1, ":k", 4), (2, ":k", 7)])


def test_collections_as_values(db):
    assert q('[:find [?n ...] :where [_ :n ?n] [(contains? #{"a" "z"} ?n)]]', db) == ["a"]
    assert q("[:find [?e ...] :where [?e :l [10 1]]]", db) == [1]
    assert q("[:find [?k ...] :where [_ :k ?k] [(set ?k 4) ?s] [(count ?s) ?c] [(= ?c 1)]]", db) == [4]
    assert q("[:find [?k ...] :where [_ :k ?k] [(set ?k) ?s] [(number? ?s)]]", db) == []
    assert q("[:find [?k ...] :in $ [[?n ?k] ...] :where [_ :n ?n]]", db, {"a": 1, "c": 2}) == [1]
    assert q('[:find ?p . :where [(pr-str [1 2] {:a 1} #{3} "q") ?p]]', db) == '[1 2] {:a 1} #{3} "q"'
    assert q("[:find ?v ?w :in $ [[?v ?w]] :where [_ :k ?k] [(contains? ?v 1)] [(count ?v) ?w]]", db, [[[5, 6], 2], [[5], 1]]) == [([5, 6], 2)]


def test_python_callables(db):
    assert q("[:find [?n ...] :in $ ?p :where [_ :n ?n] [(?p ?n)]]", db, lambda s: len(s) > 1) == ["bb"]
    assert q("[:find [?m ...] :in $ ?f :where [_ :n ?n] [(?f ?n) ?m]]", db, function(lambda s: s * 2 if s != "a" else None, "string")) == ["bbbb"]
    with pytest.raises(QueryError, match="return type"):
        q("[:find [?m ...] :in $ ?f :where [_ :n ?n] [(?f ?n) ?m]]", db, lambda s: len(s) * 2)


def test_keywords_order_by_namespace_then_name(spark):
    from quarry.edn import Keyword

    db = Database.of_datoms(spark, [(k, ":w", Keyword(w)) for k, w in enumerate([":a/z", ":a-b/c", ":z", ":a/b"])])
    assert q("[:find ?x ?y :where [_ :w ?x] [_ :w ?y] [(< ?x ?y)]]", db) == sorted([(":a/z", ":a-b/c"), (":a/b", ":a-b/c"), (":a/b", ":a/z"), (":z", ":a/z"), (":z", ":a-b/c"), (":z", ":a/b")])


def test_recursion_from_a_constant_follows_only_what_it_asks_for(spark, monkeypatch):
    from quarry.plans import compiler

    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), *((k, k + 1) for k in range(100, 140))], "a long, b long")
    seen = []
    real = compiler._asked
    monkeypatch.setattr(compiler, "_asked", lambda *a: seen.append(real(*a)) or seen[-1])
    right = "[[(reach ?x ?y) [$e ?x ?y]] [(reach ?x ?y) [$e ?x ?z] (reach ?z ?y)]]"
    assert q("[:find [?b ...] :in $e % :where (reach 1 ?b)]", edges, right) == [1, 2, 3]
    assert sorted(r._w for r in seen[0][0].collect()) == [1, 2, 3]
    assert q("[:find [?a ...] :in $e % :where (reach ?a 3)]", edges, right) == [1, 2, 3]
    assert len(q("[:find ?a ?b :in $e % :where (reach ?a ?b)]", edges, right)) == 9 + 40 * 41 // 2
    twice = "[[(reach ?x ?y) [$e ?x ?y]] [(reach ?x ?y) (reach ?x ?z) (reach ?z ?y)]]"
    assert q("[:find [?b ...] :in $e % :where (reach 2 ?b)]", edges, twice) == [1, 2, 3]


def test_frames_take_xforms_and_defaults(spark):
    db = Database.of_datoms(spark, [(1, ":n", "a"), (2, ":m", "b")], schema_of({}))
    got = {r.e: r.pulled.asDict() for r in pull_frame(db, '[(:n :xform vector) (:m :default "none")]').collect()}
    assert got == {1: {"n": ["a"], "m": "none"}, 2: {"n": None, "m": "b"}}


def test_a_batch_is_ordered_by_seq(spark, tmp_path):
    shape = "e long, a string, v string, added boolean, seq long"
    rows = [(1, ":x", "1", True, 0), (1, ":x", "1", False, 1), (2, ":x", "5", False, 0), (2, ":x", "6", True, 1)]
    spark.createDataFrame(rows, shape).write.parquet(str(tmp_path / "in"))
    ingest.start(spark.readStream.schema(shape).parquet(str(tmp_path / "in")), str(tmp_path / "out")).awaitTermination()
    assert q("[:find ?e ?v :where [?e :x ?v]]", ingest.current(spark, str(tmp_path / "out"), {}, {":x": "long"})) == [(2, 6)]


def test_results_without_a_needless_distinct(spark):
    t = spark.createDataFrame([(1, "x", dt.datetime(2020, 1, 1)), (2, "x", None)], "k long, v string, d timestamp")
    db = Database(spark).with_table("t", t, "k", schema={":t/k": Attr(unique="identity")})
    plan_of = lambda text: plan(text, db)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan_of("[:find ?k ?v :where [?e :t/k ?k] [?e :t/v ?v]]")
    assert "Aggregate" in plan_of("[:find ?v :where [?e :t/k ?k] [?e :t/v ?v]]")
    assert q("[:find [?v ...] :where [?e :t/k ?k] [?e :t/v ?v]]", db) == ["x"]
