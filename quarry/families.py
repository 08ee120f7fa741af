"""More queries over the tables of a data directory, family by family, with equivalent SQL.

``TEXT`` holds Datalog queries, each with the tables that it reads; functions
below it cover index access, inputs, callables, writes, pull and storage.
Results of random operators are checked by what must hold of any draw.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import edn
from quarry.api import plan, plan_with, q, q_with
from quarry.edn import Keyword
from quarry.functions.callables import function
from quarry.operators import bulk, index
from quarry.operators.aggregates import over_list
from quarry.operators.pull import pull, pull_frame, pull_many
from quarry.operators.transact import Connection, Datom, Facts, TransactionError, entity, resolve_tempid, squuid, squuid_time_millis, tempid, transact
from quarry.plans.query import parse
from quarry.plans.scratch import scratch_path
from quarry.sources.database import KEY_BITS, TX0, Attr, Database, schema_of
from quarry.sources.literals import read_db, write_datom, write_db
from quarry.sources.storage import MemoryStorage, Storage, database_settings, restore_database, store_database
from quarry.sources.warehouse import warehouse
from quarry.streaming import ingest

S = "clojure.string"

#: name: (tables it reads, query, SQL, columns to round)
TEXT: dict[str, tuple[str, str, str, tuple]] = {
    "pattern_tx": ("nation", "[:find ?tx (count ?e) :keys tx n :where [?e :nation/name ?n ?tx]]", f"SELECT {TX0}::BIGINT AS tx, count(*) AS n FROM nation", ()),
    "pattern_op": ("orders", "[:find ?op (count ?e) :keys op n :where [?e :orders/orderstatus ?s _ ?op]]", "SELECT ':db/add' AS op, count(*) AS n FROM orders", ()),
    "cross_product": ("region nation", "[:find ?a ?b :keys a b :where [?x :region/name ?a] [?y :nation/name ?b]]", "SELECT DISTINCT r_name AS a, n_name AS b FROM region, nation", ()),
    "dynamic_attribute": ("region", "[:find ?a ?n :keys attr n :where [(ground [:region/name :region/regionkey]) [?a ...]] [?e ?a ?v] [(count \"abc\") ?n]]", "SELECT ':region/name' AS attr, 3::BIGINT AS n UNION SELECT ':region/regionkey', 3", ()),
    "zero_and_positive": ("part", "[:find ?k :keys partkey :where [?p :part/partkey ?k] [?p :part/size ?s] [(mod ?s 3) ?m] [(zero? ?m)] [(- ?s 5) ?d] [(pos? ?d)]]", "SELECT DISTINCT p_partkey AS partkey FROM part WHERE p_size % 3 = 0 AND p_size > 5", ()),
    "nil_and_false": ("part", "[:find ?k :keys partkey :where [?p :part/partkey ?k] [?p :part/size ?s] [(> ?s 25) ?big] [(false? ?big)] [(some? ?s)] [(meta ?s) ?m] [(nil? ?m)]]", "SELECT DISTINCT p_partkey AS partkey FROM part WHERE p_size <= 25", ()),
    "boolean_connectives": ("part", "[:find ?k :keys partkey :where [?p :part/partkey ?k] [?p :part/size ?s] [(> ?s 10) ?a] [(< ?s 30) ?b] [(even? ?k) ?c] [(and ?a ?b)] [(not ?c) ?d] [(or ?d ?c)] [(not ?c)]]", "SELECT DISTINCT p_partkey AS partkey FROM part WHERE p_size > 10 AND p_size < 30 AND p_partkey % 2 <> 0", ()),
    "boolean_values": ("part", "[:find ?k ?o ?n :keys partkey either none :where [?p :part/partkey ?k] [?p :part/size ?s] [(> ?s 40) ?a] [(< ?s 5) ?b] [(or ?a ?b) ?o] [(not ?o) ?n]]", "SELECT DISTINCT p_partkey AS partkey, p_size > 40 OR p_size < 5 AS either, NOT (p_size > 40 OR p_size < 5) AS none FROM part", ()),
    "empty_predicates": ("part", f"[:find ?k :keys partkey :where [?p :part/partkey ?k] [?p :part/name ?n] [(subs ?n 0 0) ?e] [(empty? ?e)] [(not-empty ?n)] [({S}/split ?n #\" \") ?w] [(not-empty? ?w)] [(set ?k 1) ?z] [(not-empty ?z)]]", "SELECT DISTINCT p_partkey AS partkey FROM part WHERE p_name <> ''", ()),
    "contains_member": ("nation", '[:find ?n :keys name :where [?e :nation/name ?n] [(contains? #{"FRANCE" "CHINA" "NATION_3" "NATION_7"} ?n)]]', "SELECT DISTINCT n_name AS name FROM nation WHERE n_name IN ('FRANCE', 'CHINA', 'NATION_3', 'NATION_7')", ()),
    "contains_key_and_index": ("nation", "[:find ?k ?r :keys nationkey regionkey :where [?e :nation/nationkey ?k] [?e :nation/regionkey ?r] [(contains? {1 :a 3 :b} ?r)] [(vector 5 6 7 8 9 10) ?v] [(contains? ?v ?k)]]", "SELECT DISTINCT n_nationkey::BIGINT AS nationkey, n_regionkey::BIGINT AS regionkey FROM nation WHERE n_regionkey IN (1, 3) AND n_nationkey < 6", ()),
    "differ_and_identical": ("part", "[:find ?k :keys partkey :where [?p :part/partkey ?k] [?p :part/size ?s] [(-differ? ?s 7 7 7)] [(mod ?k 5) ?a] [(mod ?s 5) ?b] [(identical? ?a ?b)]]", "SELECT DISTINCT p_partkey AS partkey FROM part WHERE p_size <> 7 AND p_partkey % 5 = p_size % 5", ()),
    "blank_strings": ("part", f'[:find ?k :keys partkey :where [?p :part/partkey ?k] [?p :part/name ?n] [({S}/replace ?n #"[a-r ]+" " ") ?x] [({S}/blank? ?x)]]', "SELECT DISTINCT p_partkey AS partkey FROM part WHERE trim(regexp_replace(p_name, '[a-r ]+', ' ', 'g')) = ''", ()),
    "regex_predicates": ("part", '[:find ?k :keys partkey :where [?p :part/partkey ?k] [?p :part/type ?t] [?p :part/brand ?b] [(re-find #"[AEIOU]{1}" ?t)] [(re-matches #"Brand#[1-3][0-9]*" ?b)]]', "SELECT DISTINCT p_partkey AS partkey FROM part WHERE regexp_matches(p_type, '[AEIOU]{1}') AND regexp_full_match(p_brand, 'Brand#[1-3][0-9]*')", ()),
    "complement_predicate": ("part", "[:find ?k :keys partkey :where [?p :part/partkey ?k] [((complement even?) ?k)]]", "SELECT DISTINCT p_partkey AS partkey FROM part WHERE p_partkey % 2 <> 0", ()),
    "numbers_scalar": ("part", "[:find ?k ?d ?c ?lo ?hi ?i ?neg :keys partkey dec cmp lo hi same negated :where [?p :part/partkey ?k] [?p :part/size ?s] [(dec ?s) ?d] [(compare ?k ?s) ?c] [(min ?k ?s 20) ?lo] [(max ?k ?s 20) ?hi] [(identity ?s) ?i] [(- ?s) ?neg]]", "SELECT DISTINCT p_partkey AS partkey, p_size::BIGINT - 1 AS dec, sign(p_partkey - p_size)::BIGINT AS cmp, least(p_partkey, p_size, 20)::BIGINT AS lo, greatest(p_partkey, p_size, 20)::BIGINT AS hi, p_size::BIGINT AS same, -p_size::BIGINT AS negated FROM part", ()),
    "random_values": ("part", "[:find ?k ?ok ?in :keys partkey unit below :where [?p :part/partkey ?k] [(rand) ?r] [(<= 0 ?r 1) ?ok] [(rand-int 7) ?i] [(<= 0 ?i 6) ?in]]", "SELECT DISTINCT p_partkey AS partkey, true AS unit, true AS below FROM part", ()),
    "ground_of_variable": ("nation", "[:find ?k ?x :keys nationkey x :where [?e :nation/nationkey ?k] [(inc ?k) ?i] [(vector ?k ?i) ?v] [(ground ?v) [?x ...]]]", "SELECT DISTINCT n_nationkey::BIGINT AS nationkey, n_nationkey::BIGINT + d AS x FROM nation, (VALUES (0), (1)) v(d)", ()),
    "ground_forms": ("region", '[:find ?k ?a ?b ?c :keys regionkey a b c :where [?e :region/regionkey ?k] [(ground "x") ?a] [(ground [7 8]) [?b _]] [(ground [1 2 3]) [?c ...]]]', "SELECT DISTINCT r_regionkey::BIGINT AS regionkey, 'x' AS a, 7::BIGINT AS b, c::BIGINT AS c FROM region, (VALUES (1), (2), (3)) v(c)", ()),
    "case_and_trim": ("part", f'[:find ?k ?l ?t ?a ?b ?z :keys partkey low both left_side right_side line :where [?p :part/partkey ?k] [?p :part/type ?y] [({S}/lower-case ?y) ?l] [(str "  " ?y "  ") ?w] [({S}/trim ?w) ?t] [({S}/triml ?w) ?a] [({S}/trimr ?w) ?b] [(str ?y "\\n\\r") ?v] [({S}/trim-newline ?v) ?z]]', "SELECT DISTINCT p_partkey AS partkey, lower(p_type) AS low, p_type AS both, p_type || '  ' AS left_side, '  ' || p_type AS right_side, p_type AS line FROM part", ()),
    "last_index_and_subs": ("part", f'[:find ?k ?i ?s :keys partkey at rest :where [?p :part/partkey ?k] [?p :part/type ?t] [({S}/last-index-of ?t "E") ?i] [(subs ?t ?i) ?s]]', "SELECT DISTINCT p_partkey AS partkey, (length(p_type) - strpos(reverse(p_type), 'E'))::BIGINT AS at, substr(p_type, length(p_type) - strpos(reverse(p_type), 'E') + 1) AS rest FROM part WHERE contains(p_type, 'E')", ()),
    "printing": ("nation", '[:find ?k ?a ?b ?c ?d :keys nationkey plain readable line readable_line :where [?e :nation/nationkey ?k] [?e :nation/name ?n] [(print-str ?n ?k) ?a] [(pr-str ?n ?k nil true) ?b] [(println-str ?n ?k) ?c] [(prn-str ?n) ?d]]', "SELECT DISTINCT n_nationkey::BIGINT AS nationkey, n_name || ' ' || n_nationkey AS plain, '\"' || n_name || '\" ' || n_nationkey || ' nil true' AS readable, n_name || ' ' || n_nationkey || chr(10) AS line, '\"' || n_name || '\"' || chr(10) AS readable_line FROM nation", ()),
    "printing_collections": ("nation", '[:find ?k ?a ?b ?c ?d :keys nationkey vec names fixed m :where [?e :nation/nationkey ?k] [?e :nation/name ?n] [(vector ?k 1) ?v] [(pr-str ?v) ?a] [(list ?n ?n) ?l] [(pr-str ?l) ?b] [(pr-str [1 "x" :k] {:a 1} #{2}) ?c] [(hash-map ?n ?k) ?h] [(print-str ?h) ?d]]', "SELECT DISTINCT n_nationkey::BIGINT AS nationkey, '[' || n_nationkey || ' 1]' AS vec, '(\"' || n_name || '\" \"' || n_name || '\")' AS names, '[1 \"x\" :k] {:a 1} #{2}' AS fixed, '{' || n_name || ' ' || n_nationkey || '}' AS m FROM nation", ()),
    "join_and_replace": ("part", f'[:find ?k ?j ?c ?f ?g ?x :keys partkey joined glued one one_regex escaped :where [?p :part/partkey ?k] [?p :part/type ?t] [({S}/split ?t #" ") ?w] [({S}/join "-" ?w) ?j] [({S}/join ?w) ?c] [({S}/replace-first ?t "E" "_") ?f] [({S}/replace-first ?t #"[AEIOU]" "*") ?g] [({S}/escape ?t {{"A" "<a>" "E" "<e>"}}) ?x]]', "SELECT DISTINCT p_partkey AS partkey, replace(p_type, ' ', '-') AS joined, replace(p_type, ' ', '') AS glued, regexp_replace(p_type, 'E', '_') AS one, regexp_replace(p_type, '[AEIOU]', '*') AS one_regex, replace(replace(p_type, 'A', '<a>'), 'E', '<e>') AS escaped FROM part", ()),
    "regex_values": ("part", '[:find ?k ?m ?n :keys partkey whole vowels :where [?p :part/partkey ?k] [?p :part/type ?t] [?p :part/brand ?b] [(re-matches #"Brand#[0-9]+" ?b) ?m] [(re-seq #"[AEIOU]" ?t) ?s] [(count ?s) ?n]]', "SELECT DISTINCT p_partkey AS partkey, p_brand AS whole, len(regexp_extract_all(p_type, '[AEIOU]')) AS vowels FROM part WHERE regexp_full_match(p_brand, 'Brand#[0-9]+') AND regexp_matches(p_type, '[AEIOU]')", ()),
    "regex_of_variable": ("part", '[:find ?k ?f :keys partkey found :where [?p :part/partkey ?k] [?p :part/type ?t] [(subs ?t 0 1) ?c] [(str ?c "[A-Z]+") ?r] [(re-pattern ?r) ?x] [(re-find ?x ?t) ?f]]', "SELECT DISTINCT p_partkey AS partkey, regexp_extract(p_type, p_type[1] || '[A-Z]+') AS found FROM part WHERE regexp_matches(p_type, p_type[1] || '[A-Z]+')", ()),
    "split_with_limit": ("part", f'[:find ?k ?n ?a :keys partkey n first_part :where [?p :part/partkey ?k] [?p :part/name ?t] [({S}/split ?t #"e" 2) ?w] [(count ?w) ?n] [(get ?w 0) ?a]]', "SELECT DISTINCT p_partkey AS partkey, CASE WHEN contains(p_name, 'e') THEN 2 ELSE 1 END::BIGINT AS n, split_part(p_name, 'e', 1) AS first_part FROM part", ()),
    "split_lines": ("documents", f"[:find ?k ?n :keys doc_id n :where [?d :documents/doc_id ?k] [?d :documents/text ?t] [({S}/split-lines ?t) ?l] [(count ?l) ?n]]", "SELECT DISTINCT doc_id, len(regexp_split_to_array(text, '\\r\\n|\\r|\\n')) AS n FROM documents WHERE text IS NOT NULL", ()),
    "keywords": ("nation", '[:find ?k ?n ?s ?a :keys kw nm ns alone :where [?e :nation/name ?x] [(keyword "nation" ?x) ?k] [(name ?k) ?n] [(namespace ?k) ?s] [(keyword ?x) ?a]]', "SELECT DISTINCT ':nation/' || n_name AS kw, n_name AS nm, 'nation' AS ns, ':' || n_name AS alone FROM nation", ()),
    "types_of_values": ("nation", "[:find ?a ?b ?c ?d ?e ?f ?g :keys i s vec set lst map none :where [?x :nation/nationkey ?k] [?x :nation/name ?n] [(type ?k) ?a] [(type ?n) ?b] [(vector ?k) ?v] [(type ?v) ?c] [(set ?k) ?z] [(type ?z) ?d] [(list ?k) ?l] [(type ?l) ?e] [(hash-map ?n ?k) ?m] [(type ?m) ?f] [(meta ?k) ?o] [(type ?o) ?g]]", "SELECT DISTINCT ':type/int' AS i, ':type/string' AS s, ':type/vector' AS vec, ':type/set' AS set, ':type/list' AS lst, ':type/map' AS map, ':type/nil' AS none FROM nation", ()),
    "sets_and_maps": ("nation", '[:find ?k ?c ?v ?d ?n :keys nationkey members found absent entries :where [?e :nation/nationkey ?k] [?e :nation/regionkey ?r] [?e :nation/name ?x] [(set ?k ?r ?k) ?s] [(count ?s) ?c] [(hash-map "k" ?k "r" ?r) ?m] [(get ?m "r") ?v] [(get ?m "zz" -5) ?d] [(array-map ?x ?k) ?h] [(count ?h) ?n]]', "SELECT DISTINCT n_nationkey::BIGINT AS nationkey, CASE WHEN n_nationkey = n_regionkey THEN 1 ELSE 2 END::BIGINT AS members, n_regionkey::BIGINT AS found, (-5)::BIGINT AS absent, 1::BIGINT AS entries FROM nation", ()),
    "ranges": ("region", "[:find ?k ?i ?j ?m :keys regionkey up stepped down :where [?e :region/regionkey ?k] [(range 2) ?i] [(range 1 8 3) ?j] [(range 3 1 -1) ?m]]", "SELECT DISTINCT r_regionkey::BIGINT AS regionkey, i AS up, j AS stepped, m AS down FROM region, range(2) a(i), range(1, 8, 3) b(j), range(3, 1, -1) c(m)", ()),
    "aggregate_distinct": ("orders", "[:find ?s (distinct ?p) :keys status priorities :where [?o :orders/orderstatus ?s] [?o :orders/orderpriority ?p]]", "SELECT o_orderstatus AS status, list_sort(list(DISTINCT o_orderpriority)) AS priorities FROM orders GROUP BY 1", ()),
    "aggregate_top_n": ("orders", "[:find ?s (min 3 ?t) (max 2 ?t) :keys status lowest highest :where [?o :orders/orderstatus ?s] [?o :orders/totalprice ?t]]", "SELECT o_orderstatus AS status, list_slice(list_sort(list(o_totalprice)), 1, 3) AS lowest, list_slice(list_sort(list(o_totalprice)), -2, -1) AS highest FROM orders GROUP BY 1", ()),
    "or_join_required": ("nation supplier", "[:find ?n :keys name :where [?x :nation/nationkey ?k] [?x :nation/name ?n] (or-join [[?k]] [?s :supplier/nationkey ?k] (and [?y :nation/nationkey ?k] [?y :nation/regionkey 2]))]", "SELECT DISTINCT n_name AS name FROM nation WHERE n_regionkey = 2 OR n_nationkey IN (SELECT s_nationkey FROM supplier)", ()),
    "rule_required_vars": ("nation", "[:find ?n :keys name :rules [(near [?a] ?b) [?x :nation/nationkey ?a] [?x :nation/regionkey ?r] [?y :nation/regionkey ?r] [?y :nation/nationkey ?b]] :where [?z :nation/nationkey 3] [?z :nation/nationkey ?a] (near ?a ?b) [?w :nation/nationkey ?b] [?w :nation/name ?n]]", "SELECT DISTINCT b.n_name AS name FROM nation a JOIN nation b USING (n_regionkey) WHERE a.n_nationkey = 3", ()),
    "keyless_get_else": ("lineitem", "[:find ?f (count ?l) (sum ?d) :keys flag n discounts :where [?l :lineitem/returnflag ?f] [(get-else $ ?l :lineitem/discount 0.0) ?d]]", "SELECT l_returnflag AS flag, count(*) AS n, round(sum(coalesce(l_discount, 0)), 4) AS discounts FROM lineitem GROUP BY 1", (("discounts", 4),)),
    "keyless_not": ("lineitem", '[:find ?f (count ?l) :keys flag n :where [?l :lineitem/returnflag ?f] (not [?l :lineitem/linestatus "O"])]', "SELECT l_returnflag AS flag, count(*) AS n FROM lineitem WHERE l_linestatus IS DISTINCT FROM 'O' GROUP BY 1", ()),
    "keyless_turns": ("conversations", '[:find ?r (count ?x) :keys role n :where [?x :conversations/role ?r] [?x :conversations/turn ?t] [(> ?t 0)] (not [?x :conversations/turn 3])]', "SELECT role, count(*) AS n FROM conversations WHERE turn > 0 AND turn <> 3 AND role IS NOT NULL GROUP BY 1", ()),
    "rule_over_orders": ("orders", "[:find ?a (count ?b) :keys first_order n_later :rules [(link ?x ?y) [?o :orders/orderkey ?x] [?o :orders/orderstatus \"P\"] [(+ ?x 1) ?y] [?q :orders/orderkey ?y] [?q :orders/orderstatus \"P\"]] [(later ?x ?y) (link ?x ?y)] [(later ?x ?y) (link ?x ?z) (later ?z ?y)] :where (later ?a ?b)]", "WITH RECURSIVE p AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'P'), l(x, y) AS (SELECT a.k, b.k FROM p a JOIN p b ON b.k = a.k + 1 UNION SELECT l.x, b.k FROM l JOIN p b ON b.k = l.y + 1) SELECT x AS first_order, count(*) AS n_later FROM l GROUP BY 1", ()),
}


def _rounded(df: DataFrame, cols) -> DataFrame:
    for c, n in cols:
        df = df.withColumn(c, F.round(c, n))
    return df


def _run(name: str):
    tables, text, _, rounded = TEXT[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(plan(text, warehouse(spark, sf_dir, tuple(tables.split()))), rounded)

    return run


MADE: dict[str, tuple] = {}


def made(sql: str):
    """Register a function of (spark, sf_dir) under its name, with its SQL."""

    def register(f):
        MADE[f.__name__] = (f, sql)
        return f

    return register


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ref(db: Database, table: str, column) -> object:
    return F.lit(db.tables[table].ordinal << KEY_BITS) + column


def _geography(spark: SparkSession, sf_dir: str, more: tuple = ()) -> Database:
    """Nations and regions as tables, with a reference from each nation to its region."""
    db = warehouse(spark, sf_dir, ("region", "nation", *more))
    db.schema[":nation/region"] = Attr(ref=True)
    n = _read(spark, sf_dir, "nation")
    return db.with_relation(":nation/region", n.select(_ref(db, "nation", F.col("n_nationkey")).alias("e"), _ref(db, "region", F.col("n_regionkey")).alias("v")), "entity")


# ---- index access --------------------------------------------------------------------------------------------------

_DATED = "SELECT o_orderkey AS k, o_totalprice AS p FROM orders"


@made("SELECT n_name AS nation, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def reverse_attribute(spark, sf_dir):
    db = warehouse(spark, sf_dir, ("nation", "supplier"))
    db.schema[":supplier/home"] = Attr(ref=True)
    s = _read(spark, sf_dir, "supplier")
    db = db.with_relation(":supplier/home", s.select(_ref(db, "supplier", F.col("s_suppkey")).alias("e"), _ref(db, "nation", F.col("s_nationkey")).alias("v")), "entity")
    return plan("[:find ?x (count ?s) :keys nation n :where [?n :supplier/_home ?s] [?n :nation/name ?x]]", db)


@made("SELECT c_name AS name, c_acctbal AS balance FROM customer WHERE c_custkey = 7")
def lookup_ref_entity(spark, sf_dir):
    return plan("[:find ?n ?b :keys name balance :where [[:customer/custkey 7] :customer/name ?n] [[:customer/custkey 7] :customer/acctbal ?b]]", warehouse(spark, sf_dir, ("customer",)))


@made("SELECT n_name AS name FROM nation WHERE n_regionkey = 2")
def ident_as_value(spark, sf_dir):
    db = _geography(spark, sf_dir)
    r = _read(spark, sf_dir, "region")
    db = db.with_relation(":db/ident", r.select(_ref(db, "region", F.col("r_regionkey")).alias("e"), F.concat(F.lit(":region/r"), F.col("r_regionkey").cast("string")).alias("v")), "keyword")
    return plan("[:find ?n :keys name :where [?e :nation/region :region/r2] [?e :nation/name ?n]]", db)


@made("SELECT p_partkey AS partkey FROM part WHERE p_size = 10 AND p_partkey % 2 = 1")
def collection_as_value(spark, sf_dir):
    p = _read(spark, sf_dir, "part")
    db = Database(spark).with_relation(":pair", p.select(F.col("p_partkey").alias("e"), F.array(F.col("p_size").cast("bigint"), F.pmod(F.col("p_partkey"), F.lit(2)).cast("bigint")).alias("v")))
    return plan("[:find ?e :keys partkey :where [?e :pair [10 1]]]", db)


@made("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders")
def fold_datoms(spark, sf_dir):
    db = warehouse(spark, sf_dir, ("orders",))
    return index.fold_datoms(db, ":aevt", ":orders/totalprice", agg=[F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 2).alias("total")])


@made("SELECT n_nationkey::BIGINT AS nationkey, n_name AS name FROM nation WHERE n_nationkey = 4")
def find_datom(spark, sf_dir):
    db = warehouse(spark, sf_dir, ("nation",))
    d = index.find_datom(db, ":aevt", ":nation/name", (1 << KEY_BITS) + 4)
    return spark.createDataFrame([(d.e - (1 << KEY_BITS), d.v)], "nationkey long, name string")


@made("SELECT o_orderkey AS orderkey, o_totalprice AS price FROM orders WHERE o_totalprice >= 250000")
def seek_datoms(spark, sf_dir):
    db = warehouse(spark, sf_dir, ("orders",)).filter(lambda a, e, v: F.lit(a == ":orders/totalprice"))
    return index.seek_datoms(db, ":avet", ":orders/totalprice", 250000.0).select((F.col("e") - F.lit(1 << KEY_BITS)).alias("orderkey"), F.col("v.num").alias("price"))


@made("SELECT o_orderkey AS orderkey, o_totalprice AS price FROM orders WHERE o_totalprice <= 30000")
def rseek_datoms(spark, sf_dir):
    db = warehouse(spark, sf_dir, ("orders",)).filter(lambda a, e, v: F.lit(a == ":orders/totalprice"))
    return index.rseek_datoms(db, ":avet", ":orders/totalprice", 30000.0).select((F.col("e") - F.lit(1 << KEY_BITS)).alias("orderkey"), F.col("v.num").alias("price"))


@made("SELECT 'name' AS attr, n_name AS v FROM nation WHERE n_nationkey = 6 UNION ALL SELECT 'first', n_name FROM nation WHERE n_nationkey = 6 UNION ALL SELECT 'from', (n_nationkey)::VARCHAR FROM nation WHERE n_nationkey >= 20")
def datoms_by_ref(spark, sf_dir):
    db = warehouse(spark, sf_dir, ("nation",))
    ref = [Keyword(":nation/nationkey"), 6]
    one = index.datoms(db, ":eavt", ref, ":nation/name").select(F.lit("name").alias("attr"), "v")
    first = index.find_datom(db, ":eavt", ref, ":nation/name")
    seek = index.seek_datoms(db.filter(lambda a, e, v: F.lit(a == ":nation/nationkey")), ":eavt", [Keyword(":nation/nationkey"), 20])
    return one.unionByName(spark.createDataFrame([("first", first.v)], "attr string, v string")).unionByName(seek.select(F.lit("from").alias("attr"), F.col("v.lng").cast("string").alias("v")))


@made("SELECT r_regionkey::BIGINT + 1 AS e, r_name AS name, 0::BIGINT AS in_empty, true AS hashes_agree, true AS equal, false AS equal_to_less FROM region")
def databases_from_datoms(spark, sf_dir):
    rows = _read(spark, sf_dir, "region").select("r_regionkey", "r_name").collect()  # a table of five rows
    facts = [(int(r.r_regionkey) + 1, ":name", r.r_name) for r in rows]
    a, b, less = Database.of_datoms(spark, facts), Database.of_datoms(spark, facts[::-1]), Database.of_datoms(spark, facts[1:])
    told = (Database(spark).datoms_frame().count(), index.db_hash(a) == index.db_hash(b), index.same_facts(a, b), index.same_facts(a, less))
    connected = Connection(Facts.of(facts)).db.database(spark)
    out = plan("[:find ?e ?n :keys e name :where [?e :name ?n]]", connected)
    return out.select("e", "name", F.lit(told[0]).cast("bigint").alias("in_empty"), F.lit(told[1]).alias("hashes_agree"), F.lit(told[2]).alias("equal"), F.lit(told[3]).alias("equal_to_less"))


# ---- storage -------------------------------------------------------------------------------------------------------


@made("SELECT c_mktsegment AS segment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1")
def storage_of_tables(spark, sf_dir):
    root = scratch_path(spark, "stored")
    store_database(warehouse(spark, sf_dir, ("customer",)), root)
    assert len(database_settings(root, spark)["attributes"]) > 3
    return _rounded(plan("[:find ?s (count ?c) (sum ?b) :keys segment n total :where [?c :customer/mktsegment ?s] [?c :customer/acctbal ?b]]", restore_database(spark, root)), (("total", 2),))


def _nations(spark, sf_dir) -> list:
    return [(int(r.n_nationkey), r.n_name, int(r.n_regionkey)) for r in _read(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]  # a table of 25 rows


GEO = {
    ":name": {":db/unique": ":db.unique/identity"}, ":region": {":db/valueType": ":db.type/ref"}, ":tag": {":db/cardinality": ":db.cardinality/many"}, ":code": {":db/index": True},
    ":part": {":db/valueType": ":db.type/ref", ":db/isComponent": True, ":db/cardinality": ":db.cardinality/many"}, ":a+b": {":db/tupleAttrs": [":a", ":b"], ":db/unique": ":db.unique/identity"},
}


def _geo(spark, sf_dir) -> Facts:
    """Regions as entities 1 to 5, nations as 101 on, each with its region."""
    rows = _nations(spark, sf_dir)
    regions = [{":db/id": k + 1, ":name": f"region {k}"} for k in sorted({r for _, _, r in rows})]
    return Facts.of([], GEO).db_with([{Keyword(k): v for k, v in m.items()} for m in [*regions, *({":db/id": 101 + k, ":name": n, ":region": r + 1, ":code": k} for k, n, r in rows)]])


def _facts(spark, db: Facts, only=(":name", ":region", ":code", ":tag")) -> DataFrame:
    return spark.createDataFrame([(d.e, d.a, str(d.v)) for d in db.datoms() if d.a in only], "e long, a string, v string")


_R = "SELECT r_regionkey + 1 AS e, ':name' AS a, 'region ' || r_regionkey AS v FROM region"
_N = "SELECT 101 + n_nationkey AS e, ':name' AS a, n_name AS v FROM nation"
_NR = "SELECT 101 + n_nationkey AS e, ':region' AS a, (n_regionkey + 1)::VARCHAR AS v FROM nation"
_NC = "SELECT 101 + n_nationkey AS e, ':code' AS a, n_nationkey::VARCHAR AS v FROM nation"


def _sql(*parts: str) -> str:
    return "SELECT e::BIGINT AS e, a, v FROM (" + " UNION ALL ".join(parts) + ")"


@made(_sql(_R, f"{_N} WHERE n_nationkey <> 1", _NR, "SELECT 101 + n_nationkey, ':code', CASE WHEN n_nationkey = 2 THEN '902' ELSE n_nationkey::VARCHAR END FROM nation", "SELECT 101, ':tag', 'x'"))
def storage_snapshot_and_tail(spark, sf_dir):
    """A snapshot, then writes to its tail; the second connection restores both, after a collection of garbage."""
    root = scratch_path(spark, "facts")
    c = Connection(_geo(spark, sf_dir), Storage(spark, root))
    c.storage.store(c.db)
    c.transact("[[:db/add 103 :code 902] [:db/add 101 :tag \"x\"]]")
    c.transact("[[:db/retract 102 :name]]")
    again = Storage(spark, root)
    c.storage.store(c.db)
    assert again.collect_garbage() and again.settings()["snapshots"] and again.addresses()
    return _facts(spark, Connection(again.restore(), again).db)


@made(_sql(_R, f"{_N} WHERE n_nationkey <> 1", _NR, "SELECT 101 + n_nationkey, ':code', CASE WHEN n_nationkey = 2 THEN '902' ELSE n_nationkey::VARCHAR END FROM nation"))
def storage_in_memory(spark, sf_dir):
    """The same in memory: a first write makes a snapshot, later ones a tail."""
    held = MemoryStorage()
    assert held.restore() is None
    c = Connection(_geo(spark, sf_dir), held)
    c.transact("[[:db/add 103 :code 902]]")
    c.transact("[[:db/retract 102 :name]]")
    assert held.addresses() == ["facts-00000001", "tail-00000001"] and held.settings()["snapshots"] == [1]
    held.store(c.db)
    assert held.collect_garbage() == ["facts-00000001", "tail-00000001"]
    return _facts(spark, Connection(held.restore(), held).db)


@made(_sql(_R, _N, _NR, _NC))
def literal_round_trip(spark, sf_dir):
    """A database and a fact as EDN text and back."""
    db = _geo(spark, sf_dir)
    back = read_db(write_db(db))
    assert back.datoms() == db.datoms() and back.schema == db.schema
    d = Datom(5, ":x", "q", TX0 + 7)
    assert Facts().db_with(f"[{write_datom(d)}]").datoms() == [d]
    return _facts(spark, back)


@made("""SELECT * FROM (VALUES (0, '[1 2.5 "a\\n" :k/w sym true nil]'), (1, '#{1 2}'), (2, '{:a [1], :b #inst "2020-01-02T03:04:05Z"}'), (3, '#uuid "00000000-0000-0000-0000-000000000007"'), (4, '#"a+"'), (5, '(f ?x)')) t(n, text)""")
def edn_forms(spark, sf_dir):
    texts = ['[1 2.5 "a\\n" :k/w sym true nil] ; end', "#{1 2 #_ 3}", '{:a [1] :b #inst "2020-01-02T03:04:05Z"}', f'#uuid "{uuid.UUID(int=7)}"', '#"a+"', "(f ?x)"]
    return spark.createDataFrame([(k, edn.write(edn.read(t))) for k, t in enumerate(texts)], "n int, text string")


# ---- find specs and inputs -------------------------------------------------------------------------------------------


@made("SELECT 'collection' AS shape, n_name AS v FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'tuple', n_name || '/' || n_nationkey FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'scalar', count(*)::VARCHAR FROM orders UNION ALL SELECT 'map form', count(*)::VARCHAR FROM nation UNION ALL SELECT 'strs', count(*)::VARCHAR FROM nation")
def find_shapes(spark, sf_dir):
    db = warehouse(spark, sf_dir, ("nation", "orders"))
    rows = [("collection", v) for v in q("[:find [?n ...] :where [?e :nation/regionkey 1] [?e :nation/name ?n]]", db)]
    rows.append(("tuple", "/".join(map(str, q("[:find [?n ?k] :where [?e :nation/nationkey 3] [?e :nation/nationkey ?k] [?e :nation/name ?n]]", db)))))
    rows.append(("scalar", str(q("[:find (count ?o) . :where [?o :orders/orderkey _]]", db))))
    rows.append(("map form", str(len(q("{:find [?n] :in [$] :where [[?e :nation/name ?n]]}", db)))))
    listed = edn.read("[:find ?n :strs n :where [?e :nation/name ?n]]")
    assert parse(listed).keys == ["n"] and parse("[:find ?n :where [?e :nation/name ?n]]") is parse("[:find ?n :where [?e :nation/name ?n]]")
    rows.append(("strs", str(len([r["n"] for r in q(listed, db)]))))
    return spark.createDataFrame(rows, "shape string, v string")


@made("SELECT o_orderstatus AS status, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def with_from_the_api(spark, sf_dir):
    text = "[:find ?s (sum ?t) :keys status total :where [?o :orders/orderstatus ?s] [?o :orders/totalprice ?t]]"
    db = warehouse(spark, sf_dir, ("orders",))
    out = _rounded(plan_with(text, ["?o"], db), (("total", 2),))
    assert len(q_with(text, ["o"], db)) == out.count()
    return out


@made("SELECT n_name AS name, 'x' AS tag, 1::BIGINT AS n FROM nation WHERE n_regionkey = 2 AND n_nationkey > 3")
def input_tuple_and_ignored(spark, sf_dir):
    return plan("[:find ?n ?t ?c :keys name tag n :in $ [?r ?floor _] [[?t [?c _]]] :where [?e :nation/regionkey ?r] [?e :nation/nationkey ?k] [(> ?k ?floor)] [?e :nation/name ?n]]", warehouse(spark, sf_dir, ("nation",)), [2, 3, "unused"], [["x", [1, 2]]])


@made("SELECT n_name AS name, CASE n_regionkey WHEN 1 THEN 10 ELSE 30 END::BIGINT AS v FROM nation WHERE n_regionkey IN (1, 3)")
def input_map(spark, sf_dir):
    return plan("[:find ?n ?v :keys name v :in $ [[?r ?v] ...] :where [?e :nation/regionkey ?r] [?e :nation/name ?n]]", warehouse(spark, sf_dir, ("nation",)), {1: 10, 3: 30})


@made("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b USING (n_regionkey) WHERE a.n_nationkey < b.n_nationkey")
def input_rules(spark, sf_dir):
    rules = "[[(same ?x ?y) [?x :nation/regionkey ?r] [?y :nation/regionkey ?r]] [(before ?x ?y) (same ?x ?y) [?x :nation/nationkey ?i] [?y :nation/nationkey ?j] [(< ?i ?j)]]]"
    return plan("[:find ?a ?b :keys a b :in $ % :where (before ?x ?y) [?x :nation/name ?a] [?y :nation/name ?b]]", warehouse(spark, sf_dir, ("nation",)), rules)


@made("SELECT n_name AS name, n_regionkey::BIGINT AS regionkey FROM nation WHERE n_nationkey = 9")
def input_entity_ref(spark, sf_dir):
    return plan("[:find ?n ?r :keys name regionkey :in $ ?e :where [?e :nation/name ?n] [?e :nation/regionkey ?r]]", warehouse(spark, sf_dir, ("nation",)), [Keyword(":nation/nationkey"), 9])


@made("SELECT p_partkey AS partkey, length(p_name) AS n, upper(p_name) AS up, w AS word FROM part, unnest(string_split(p_name, ' ')) t(w) WHERE length(p_name) > 8 AND p_size % 2 = 0")
def callables(spark, sf_dir):
    """A Python predicate and functions over Arrow batches, a function of Columns, and one that gives several rows."""
    text = "[:find ?k ?l ?u ?w :keys partkey n up word :in $ ?long ?even ?size ?up ?words :where [?p :part/partkey ?k] [?p :part/name ?n] [?p :part/size ?s] [(?long ?n)] [(?even ?s)] [(?size ?n) ?l] [(?up ?n) ?u] [(?words ?n) [?w ...]]]"
    return plan(text, warehouse(spark, sf_dir, ("part",)), lambda s: len(s) > 8, lambda c: c % 2 == 0, function(len, "bigint"), F.upper, lambda c: F.split(c, " "))


@made("SELECT n_nationkey::BIGINT AS k, a AS a, a * 10 AS b FROM nation, (VALUES (1::BIGINT), (2)) t(a)")
def callable_relation(spark, sf_dir):
    pairs = lambda c: F.transform(F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint")), lambda x: F.struct(x.alias("a"), (x * 10).alias("b")))
    return plan("[:find ?k ?a ?b :keys k a b :in $ ?f :where [?e :nation/nationkey ?k] [(?f ?k) [[?a ?b] ...]]]", warehouse(spark, sf_dir, ("nation",)), pairs)


@made("SELECT n_nationkey::BIGINT AS k, n_nationkey::BIGINT + 1 AS more, 'n' || n_nationkey AS label FROM nation WHERE n_nationkey % 2 = 0")
def callable_tuple(spark, sf_dir):
    """A Python function of one value that gives a tuple, or None, which drops the row; handed on to a rule by name."""
    f = function(lambda k: {"a": k + 1, "b": f"n{k}"} if k % 2 == 0 else None, "a bigint, b string")
    rules = "[[(made ?g ?k ?m) [?e :nation/nationkey ?k] [(?g ?k) [?m _]]]]"
    return plan("[:find ?k ?m ?l :keys k more label :in $ % ?f :where (made ?f ?k ?m) [(?f ?k) [_ ?l]]]", warehouse(spark, sf_dir, ("nation",)), rules, f)


# ---- negation, disjunction, rules over other sources ---------------------------------------------------------------------


@made("SELECT c_custkey AS custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def not_in_source(spark, sf_dir):
    return plan("[:find ?k :keys custkey :in $ $o :where [?c :customer/custkey ?k] ($o not [?x :orders/custkey ?k])]", warehouse(spark, sf_dir, ("customer",)), warehouse(spark, sf_dir, ("orders",)))


@made("SELECT DISTINCT n_name AS name FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > 0")
def rule_of_source(spark, sf_dir):
    return plan("[:find ?n :keys name :in $ $s % :where [?x :nation/nationkey ?k] [?x :nation/name ?n] ($s rich ?k)]", warehouse(spark, sf_dir, ("nation",)), warehouse(spark, sf_dir, ("supplier",)), "[[(rich ?k) [?s :supplier/nationkey ?k] [?s :supplier/acctbal ?b] [(> ?b 0)]]]")


@made("SELECT c_custkey AS custkey FROM customer WHERE c_custkey NOT IN (SELECT l.doc_id FROM labels l WHERE quality IS NOT NULL)")
def wrapped_in_source(spark, sf_dir):
    db = warehouse(spark, sf_dir, ("customer",))
    labels = _read(spark, sf_dir, "labels").filter("quality is not null")
    other = Database(spark).with_relation(":labels/quality", labels.select(_ref(db, "customer", F.col("doc_id")).alias("e"), F.col("quality").cast("bigint").alias("v")))
    return plan("[:find ?k :keys custkey :in $ $l :where [?c :customer/custkey ?k] [$l (missing? ?c :labels/quality)]]", db, other)


@made("WITH RECURSIVE p AS (SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 20000), l(y) AS (SELECT k FROM p WHERE k IN (2, 3) UNION SELECT p.k FROM l JOIN p ON p.k // 2 = l.y) SELECT y AS orderkey FROM l")
def rule_with_bound_argument(spark, sf_dir):
    """What hangs below order 1 where order k hangs below order k / 2: the start is bound and handed on, so only its own closure is made."""
    orders = _read(spark, sf_dir, "orders").filter("o_totalprice > 20000")
    edges = orders.select(F.expr("o_orderkey div 2").alias("k"), F.col("o_orderkey").alias("t")).filter("t > 1")
    return plan("[:find ?b :keys orderkey :in $e % ?a :where (reach ?a ?b)]", edges, "[[(reach ?x ?y) [$e ?x ?y]] [(reach ?x ?y) (reach ?x ?z) [$e ?z ?y]]]", 1)


@made(MADE["rule_with_bound_argument"][1])
def rule_with_bound_start(spark, sf_dir):
    """The same, asked of a rule that changes its first argument: the values that are asked for are followed first."""
    orders = _read(spark, sf_dir, "orders").filter("o_totalprice > 20000")
    edges = orders.select(F.expr("o_orderkey div 2").alias("k"), F.col("o_orderkey").alias("t")).filter("t > 1")
    return plan("[:find ?b :keys orderkey :in $e % :where (reach 1 ?b)]", edges, "[[(reach ?x ?y) [$e ?x ?y]] [(reach ?x ?y) [$e ?x ?z] (reach ?z ?y)]]")


# ---- aggregates ---------------------------------------------------------------------------------------------------------


@made("SELECT o_orderstatus AS status, 4::BIGINT AS sampled, true AS drawn, 6::BIGINT AS draws, count(*) AS n FROM orders GROUP BY 1")
def aggregate_random(spark, sf_dir):
    db = warehouse(spark, sf_dir, ("orders",))
    df = plan("[:find ?s (sample 4 ?k) (rand ?k) (rand 6 ?k) (count ?k) :keys status sampled drawn draws n :where [?o :orders/orderstatus ?s] [?o :orders/orderkey ?k]]", db)
    return df.select("status", F.size(F.array_distinct("sampled")).cast("bigint").alias("sampled"), (F.col("drawn") > 0).alias("drawn"), F.size("draws").cast("bigint").alias("draws"), "n")


@made("SELECT p_brand AS brand, list_slice(list_sort(list(p_retailprice)), 1, 2) AS cheapest, round(max(p_retailprice) - min(p_retailprice), 2) AS spread, count(*) FILTER (p_size > 25) AS large FROM part GROUP BY 1")
def aggregate_callables(spark, sf_dir):
    """An amount that is an input, a Python function of a group's list, and a function of Columns with a further argument."""
    spread = over_list(lambda xs: round(max(xs) - min(xs), 2), "double")
    above = lambda n, c: F.count_if(c > n)
    return plan("[:find ?b (min ?n ?p) (aggregate ?spread ?p) (aggregate ?above 25 ?s) :keys brand cheapest spread large :in $ ?n ?spread ?above :where [?x :part/brand ?b] [?x :part/retailprice ?p] [?x :part/size ?s]]", warehouse(spark, sf_dir, ("part",)), 2, spread, above)


@made("SELECT n_regionkey::BIGINT AS regionkey, r_name AS region, count(*) AS n, 25::BIGINT AS facts FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def aggregate_with_pull_and_source(spark, sf_dir):
    db = _geography(spark, sf_dir)
    known = lambda source, c: F.max(F.lit(source.relation(":nation/name").count()))
    df = plan("[:find ?k (pull ?r [:region/name]) (count ?e) (aggregate ?known $ ?e) :keys regionkey region n facts :in $ ?known :where [?e :nation/region ?r] [?r :region/regionkey ?k]]", db, known)
    return df.select("regionkey", F.col("region.`region/name`").alias("region"), "n", F.col("facts").cast("bigint").alias("facts"))


# ---- transactions over the small tables ---------------------------------------------------------------------------------


@made(_sql(_R, f"{_N} WHERE n_regionkey <> 1", "SELECT 101 + n_nationkey, ':region', CASE WHEN n_regionkey = 0 THEN '4' ELSE (n_regionkey + 1)::VARCHAR END FROM nation WHERE n_regionkey <> 2", _NC))
def tx_add_and_retract(spark, sf_dir):
    db = _geo(spark, sf_dir)
    ops = []
    for k, n, r in _nations(spark, sf_dir):
        ops += [["add", 101 + k, ":region", 4]] if r == 0 else [["retract", 101 + k, ":name", n]] if r == 1 else [["retract", 101 + k, ":region"]] if r == 2 else []
    ops.append(["retract", 9999, ":name", "nobody"])
    return _facts(spark, db.db_with([[Keyword(f":db/{o}"), e, Keyword(a), *v] for o, e, a, *v in ops]))


@made("SELECT added, count(*) AS n, count(DISTINCT e) AS entities FROM (SELECT n_nationkey AS e, true AS added FROM nation UNION ALL SELECT n_nationkey, false FROM nation) GROUP BY 1")
def tx_report(spark, sf_dir):
    """Every code is raised: each replacement reports what goes and what comes; an equal fact reports nothing."""
    db = _geo(spark, sf_dir)
    rows = _nations(spark, sf_dir)
    report = db.transact([[Keyword(":db/add"), 101 + k, Keyword(":code"), k + 1000] for k, _, _ in rows] + [[Keyword(":db/add"), 101 + k, Keyword(":name"), n] for k, n, _ in rows])
    assert report.db_before is db and report.db_after.max_tx == db.max_tx + 1
    return spark.createDataFrame([(d.e, d.added) for d in report.tx_data], "e long, added boolean").groupBy("added").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("e").alias("entities"))


@made(_sql(f"{_R} WHERE r_regionkey <> 0", f"{_N} WHERE n_nationkey <> 3", f"{_NR} WHERE n_regionkey <> 0 AND n_nationkey NOT IN (3, 5)", f"{_NC} WHERE n_nationkey <> 3"))
def tx_retract_entity_and_attribute(spark, sf_dir):
    """A region goes with all references to it, a nation with its component, and one nation's attribute alone."""
    db = _geo(spark, sf_dir).db_with('[{:db/id 104 :part [{:db/id 900 :name "port"}]}]')
    out = db.db_with('[[:db/retractEntity [:name "region 0"]] [:db/retractEntity 104] [:db/retractAttribute 106 :region]]')
    assert out.get(900, ":name") == []
    return _facts(spark, out)


@made("SELECT 103::BIGINT AS e, 77::BIGINT AS code, true AS refused, true AS absent_refused, 1::BIGINT AS tags")
def tx_compare_and_set(spark, sf_dir):
    db = _geo(spark, sf_dir).db_with("[[:db/cas 103 :code 2 77] [:db.fn/cas 103 :tag nil \"new\"]]")
    refused = []
    for bad in ("[[:db/cas 103 :code 2 78]]", "[[:db/cas 103 :code nil 78]]"):
        try:
            db.db_with(bad)
        except TransactionError:
            refused.append(True)
    return spark.createDataFrame([(103, db.get(103, ":code")[0], *refused, len(db.get(103, ":tag")))], "e long, code long, refused boolean, absent_refused boolean, tags long")


@made(_sql(_R, _N, _NR, "SELECT 101 + n_nationkey AS e, ':code' AS a, CASE WHEN n_regionkey = 3 THEN '3000' ELSE n_nationkey::VARCHAR END AS v FROM nation", "SELECT 101 + n_nationkey AS e, ':tag' AS a, t AS v FROM nation, (VALUES ('a'), ('b')) x(t) WHERE n_regionkey = 3"))
def tx_entity_maps(spark, sf_dir):
    """Maps that name entities by identity (upsert), with a collection of values."""
    rows = _nations(spark, sf_dir)
    maps = [{Keyword(":name"): n, Keyword(":code"): 3000, Keyword(":tag"): ["a", "b"]} for _, n, r in rows if r == 3]
    return _facts(spark, _geo(spark, sf_dir).db_with(maps))


@made("SELECT r_regionkey::BIGINT + 1 AS region, count(*) AS moved FROM region, nation WHERE r_regionkey = 4 GROUP BY 1")
def tx_nested_and_reverse_maps(spark, sf_dir):
    """Nested maps become components, and a reverse attribute moves every nation to one region."""
    db = _geo(spark, sf_dir)
    out = db.db_with([{Keyword(":db/id"): 5, Keyword(":_region"): [101 + k for k, _, _ in _nations(spark, sf_dir)], Keyword(":part"): [{Keyword(":name"): "coast"}]}])
    assert out.get(out.get(5, ":part")[0], ":name") == ["coast"]
    return plan("[:find ?r (count ?n) :keys region moved :where [?n :region ?r]]", out.database(spark))


@made("SELECT k, v FROM (VALUES ('raw', '7/8'), ('kept tx', '536870950'), ('called', '12'), ('ident', '24'), ('tx fact', 'import')) t(k, v)")
def tx_functions_and_raw(spark, sf_dir):
    """Raw facts with their own transaction, functions called in place and by ident, and a fact about the transaction itself."""
    up = lambda db, e, n: [[":db/add", e, ":code", db.get(e, ":code")[0] + n]]
    db = transact(Facts(), [Datom(5, ":x", "7/8", TX0 + 38), Datom(6, ":code", 2, TX0 + 38), Datom(7, ":code", 4, TX0 + 38)]).db_after
    raw, tx = db.get(5, ":x")[0], db.datoms()[0].tx
    db = db.db_with([[Keyword(":db.fn/call"), up, 6, 10]])
    db = db.db_with([{Keyword(":db/id"): 50, Keyword(":db/ident"): Keyword(":raise"), Keyword(":db/fn"): up}]).db_with([[Keyword(":raise"), 7, 20]])
    report = db.transact('[[:db/add :db/current-tx :note "import"]]')
    rows = [("raw", raw), ("kept tx", str(tx)), ("called", str(db.get(6, ":code")[0])), ("ident", str(db.get(7, ":code")[0])), ("tx fact", report.db_after.get(report.db_after.max_tx, ":note")[0])]
    return spark.createDataFrame(rows, "k string, v string")


@made("SELECT n_name AS child, 'of ' || n_name AS made, (n_nationkey % 2 = 0) AS merged FROM nation")
def tx_tempids(spark, sf_dir):
    """New entities by strings and negative numbers refer to each other; a name that exists turns a tempid into its entity."""
    db = _geo(spark, sf_dir)
    rows, data = _nations(spark, sf_dir), []
    for k, n, _ in rows:
        t = f"t{k}" if k % 2 == 0 else -1 - k
        data += [{Keyword(":db/id"): t, Keyword(":name"): f"of {n}", Keyword(":region"): f"c{k}"}, [Keyword(":db/add"), f"c{k}", Keyword(":tag"), "child"]]
        data.append([Keyword(":db/add"), f"c{k}", Keyword(":name"), n] if k % 2 == 0 else [Keyword(":db/add"), f"c{k}", Keyword(":code"), k])
    report = db.transact(data)
    out = []
    for k, n, _ in rows:
        parent = resolve_tempid(report, f"t{k}" if k % 2 == 0 else -1 - k)
        child = report.db_after.get(parent, ":region")[0]
        out.append((n, report.db_after.get(parent, ":name")[0], child == 101 + k))
    assert tempid(None, -5) == -5 and tempid() < 0 and squuid_time_millis(squuid(1_000_000)) == 1_000_000
    return spark.createDataFrame(out, "child string, made string, merged boolean")


@made("SELECT n_nationkey::BIGINT AS a, n_regionkey::BIGINT + 100 AS b, n_nationkey::BIGINT + 500 AS e, true AS found, true AS refused FROM nation")
def tx_tuples(spark, sf_dir):
    """A tuple follows its sources, finds its entity, and takes no write that differs from them."""
    rows = _nations(spark, sf_dir)
    db = Facts.of([], GEO).db_with([{Keyword(":db/id"): 500 + k, Keyword(":a"): k, Keyword(":b"): r} for k, _, r in rows])
    db = db.db_with([[Keyword(":db/add"), 500 + k, Keyword(":b"), r + 100] for k, _, r in rows])
    try:
        db.db_with("[[:db/add 500 :a+b [1 2]]]")
        refused = False
    except TransactionError:
        refused = True
    out = [(*db.get(500 + k, ":a+b")[0], 500 + k, db.entid([":a+b", [k, r + 100]]) == 500 + k, refused) for k, _, r in rows]
    return spark.createDataFrame(out, "a long, b long, e long, found boolean, refused boolean")


@made("SELECT 'declared' AS k, count(*) AS n FROM nation UNION ALL SELECT 'listened', 2 UNION ALL SELECT 'skipped', 0 UNION ALL SELECT 'after reset', 0 UNION ALL SELECT 'many', 2")
def connections(spark, sf_dir):
    """Schema written as data, listeners, a write that is not stored, a reset of facts and of the schema."""
    root, heard = scratch_path(spark, "conn"), []
    c = Connection(_geo(spark, sf_dir), Storage(spark, root))
    c.transact("[{:db/ident :alias :db/cardinality :db.cardinality/many}]")
    key = c.listen(heard.append)
    c.transact([[Keyword(":db/add"), 101 + k, Keyword(":alias"), f"{n} {j}"] for k, n, _ in _nations(spark, sf_dir) for j in (0, 1)])
    declared = sum(len(c.db.get(101 + k, ":alias")) == 2 for k, _, _ in _nations(spark, sf_dir))
    c.transact("[[:db/add 101 :note 1]]", {"skip-store?": True})
    c.unlisten(key)
    c.transact("[[:db/add 101 :note2 1]]")
    stored = Storage(spark, root).restore()
    c.reset_schema({":note": {":db/cardinality": ":db.cardinality/many"}})
    c.transact("[[:db/add 101 :note 2]]")
    many = len(c.db.get(101, ":note"))
    c.reset(Facts())
    rows = [("declared", declared), ("listened", len(heard)), ("skipped", len(stored.get(101, ":note"))), ("after reset", len(c.db.datoms())), ("many", many)]
    return spark.createDataFrame(rows, "k string, n long")


@made("SELECT n_name AS name, 'region ' || n_regionkey AS region, (SELECT count(*) FROM nation b WHERE b.n_regionkey = a.n_regionkey) AS neighbours, true AS equal, 'harbour' AS touched FROM nation a")
def entities(spark, sf_dir):
    """Lazy views: attributes forward and back, equality by database and id, components expanded by touch()."""
    rows = _nations(spark, sf_dir)
    db = _geo(spark, sf_dir).db_with([{Keyword(":db/id"): 101 + k, Keyword(":part"): [{Keyword(":tag"): ["harbour"]}]} for k, _, _ in rows])
    out = []
    for k, n, _ in rows:
        e = entity(db, [":name", n])
        touched = e.touch()[":part"][0][":tag"]
        out.append((e[":name"], e[":region"][":name"], len(e[":region"][":_region"]), e == entity(db, 101 + k) and hash(e) == hash(entity(db, 101 + k)) and db.entid([":name", n]) == 101 + k, next(iter(touched))))
    assert entity(db, 77777) is None
    return spark.createDataFrame(out, "name string, region string, neighbours long, equal boolean, touched string")


# ---- bulk writes ----------------------------------------------------------------------------------------------------------


@made("SELECT o_orderkey AS orderkey, CASE WHEN o_orderstatus = 'F' THEN 1.5 ELSE o_totalprice END AS price FROM orders")
def bulk_add_to_table(spark, sf_dir):
    db = warehouse(spark, sf_dir, ("orders",))
    new = _read(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(_ref(db, "orders", F.col("o_orderkey")).alias("e"), F.lit(1.5).alias("v"))
    return plan("[:find ?k ?p :keys orderkey price :where [?o :orders/orderkey ?k] [?o :orders/totalprice ?p]]", bulk.bulk_add(db, ":orders/totalprice", new))


@made("SELECT added, count(*) AS n, round(sum(v), 2) AS total FROM (SELECT true AS added, 1.5 AS v FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT false, o_totalprice FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def bulk_add_report(spark, sf_dir):
    db = warehouse(spark, sf_dir, ("orders",))
    new = _read(spark, sf_dir, "orders").select(_ref(db, "orders", F.col("o_orderkey")).alias("e"), F.when(F.col("o_orderstatus") == "F", 1.5).otherwise(F.col("o_totalprice")).alias("v"))
    return bulk.bulk_report(db, ":orders/totalprice", new).tx_data.groupBy("added").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v.num"), 2).alias("total"))


@made("SELECT 'customers' AS what, count(*) AS n FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'refs', count(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal >= 0")
def bulk_retract_entities(spark, sf_dir):
    """Customers in debt go with their rows, and the orders' references to them go too."""
    db = warehouse(spark, sf_dir, ("customer", "orders"))
    db.schema[":orders/customer"] = Attr(ref=True)
    o = _read(spark, sf_dir, "orders")
    db = db.with_relation(":orders/customer", o.select(_ref(db, "orders", F.col("o_orderkey")).alias("e"), _ref(db, "customer", F.col("o_custkey")).alias("v")), "entity")
    gone = _read(spark, sf_dir, "customer").filter("c_acctbal < 0").select(_ref(db, "customer", F.col("c_custkey")).alias("e"))
    out = bulk.bulk_retract(db, gone)
    count = lambda what, a: out.relation(a).agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    return count("customers", ":customer/custkey").unionByName(count("orders", ":orders/orderkey")).unionByName(count("refs", ":orders/customer"))


@made("SELECT c_custkey AS custkey, CASE WHEN c_nationkey = 3 OR c_mktsegment = 'BUILDING' THEN NULL ELSE c_acctbal END AS balance FROM customer")
def bulk_retract_attribute(spark, sf_dir):
    db = warehouse(spark, sf_dir, ("customer",))
    c = _read(spark, sf_dir, "customer")
    e = _ref(db, "customer", F.col("c_custkey")).alias("e")
    db = bulk.bulk_retract_attribute(db, ":customer/acctbal", c.filter("c_mktsegment = 'BUILDING'").select(e))
    db = bulk.bulk_retract_facts(db, ":customer/acctbal", c.filter("c_nationkey = 3").select(e, F.col("c_acctbal").alias("v")))
    out = plan("[:find ?k ?b :keys custkey balance :where [?c :customer/custkey ?k] [(get-else $ ?c :customer/acctbal -1e9) ?b]]", db)
    return out.withColumn("balance", F.when(F.col("balance") > -1e9, F.col("balance")))


@made("SELECT name, max(v) AS v, count(*) AS n FROM (SELECT n_name AS name, n_nationkey::BIGINT + 1000 AS v FROM nation UNION ALL SELECT 'new ' || r_name, r_regionkey::BIGINT FROM region) GROUP BY 1")
def bulk_upsert(spark, sf_dir):
    """Rows named by a unique attribute: known names change, others become entities."""
    db = warehouse(spark, sf_dir, ("nation",))
    db.schema[":nation/name"] = Attr(unique="identity")
    rows = _read(spark, sf_dir, "nation").select(F.col("n_name").alias("nm"), (F.col("n_nationkey").cast("bigint") + 1000).alias("val"))
    rows = rows.unionByName(_read(spark, sf_dir, "region").select(F.concat(F.lit("new "), F.col("r_name")).alias("nm"), F.col("r_regionkey").cast("bigint").alias("val")))
    db = bulk.bulk_upsert(db, ":nation/name", rows, {":nation/name": "nm", ":rank": "val"})
    return plan("[:find ?n (max ?v) (count ?e) :keys name v n :where [?e :nation/name ?n] [?e :rank ?v]]", db)


@made("SELECT count(*) AS n, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END)::BIGINT AS done, true AS refused, 'ok' AS looked_up FROM orders")
def bulk_cas(spark, sf_dir):
    db = warehouse(spark, sf_dir, ("orders",))
    o = _read(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    swap = o.select(_ref(db, "orders", F.col("o_orderkey")).alias("e"), F.lit("P").alias("old"), F.lit("DONE").alias("new"))
    out = bulk.bulk_cas(db, ":orders/orderstatus", swap)
    try:
        bulk.bulk_cas(out, ":orders/orderstatus", swap)
        refused = False
    except TransactionError:
        refused = True
    found = bulk.by_lookup(out, ":orders/orderkey", o.select("o_orderkey"), "o_orderkey")
    ok = found.count() == o.count()
    rel = out.relation(":orders/orderstatus")
    return rel.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") == "DONE").alias("done")).select("n", "done", F.lit(refused).alias("refused"), F.lit("ok" if ok else "wrong").alias("looked_up"))


@made("SELECT p_partkey AS partkey, p_size::BIGINT AS a, p_brand AS b FROM part")
def bulk_tuples(spark, sf_dir):
    db = Database(spark, {":a+b": Attr(tuple_attrs=(":a", ":b"))})
    p = _read(spark, sf_dir, "part")
    db = bulk.bulk_add(db, ":a", p.select(F.col("p_partkey").alias("e"), F.col("p_size").cast("bigint").alias("v")))
    db = bulk.bulk_add(db.with_relation(":b", p.select(F.col("p_partkey").alias("e"), F.lit("?").alias("v"))), ":b", p.select(F.col("p_partkey").alias("e"), F.col("p_brand").alias("v")))
    return db.relation(":a+b").select(F.col("e").alias("partkey"), F.col("v.t0").alias("a"), F.col("v.t1").alias("b"))


# ---- pull -----------------------------------------------------------------------------------------------------------------


@made("SELECT c_custkey AS id, c_name AS nm, 'none' AS missing, [c_mktsegment] AS vec, c_acctbal::VARCHAR IS NOT NULL AS printed FROM customer")
def pull_options(spark, sf_dir):
    """:db/id, :as, :default, :xform and the older (default a v), in one scan."""
    db = warehouse(spark, sf_dir, ("customer",))
    db = db.with_relation(":customer/absent", spark.createDataFrame([], "e long, v string"))
    df = pull_frame(db, '[:db/id (:customer/name :as :nm) (default :customer/absent "none") (:customer/mktsegment :xform vector) (:customer/acctbal :xform str)]')
    p = F.col("pulled")
    return df.select((p["db/id"] - F.lit(1 << KEY_BITS)).alias("id"), p["nm"].alias("nm"), p["customer/absent"].alias("missing"), p["customer/mktsegment"].alias("vec"), p["customer/acctbal"].isNotNull().alias("printed"))


@made("SELECT r_name AS region, list_slice(list_sort(list(n_nationkey::BIGINT)), 1, 2) AS two, count(*) AS every FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def pull_limits(spark, sf_dir):
    db = _geography(spark, sf_dir)
    df = pull_frame(db, "[:region/name {(:nation/_region :limit 2 :as :two) [:nation/nationkey]} {(:nation/_region :limit nil :as :every) [:nation/nationkey]}]", _read(spark, sf_dir, "region").select(_ref(db, "region", F.col("r_regionkey")).alias("e")))
    p = F.col("pulled")
    return df.select(p["region/name"].alias("region"), F.transform(p["two"], lambda x: x["nation/nationkey"]).alias("two"), F.size(p["every"]).cast("bigint").alias("every"))


@made("SELECT n_nationkey::BIGINT AS id, n_name AS name, n_regionkey::BIGINT AS regionkey FROM nation")
def pull_wildcard(spark, sf_dir):
    """``*`` over a table: every attribute with its own type."""
    p = F.col("pulled")
    df = pull_frame(warehouse(spark, sf_dir, ("nation",)), "[*]")
    return df.select((p["db/id"] - F.lit(1 << KEY_BITS)).alias("id"), p["nation/name"].alias("name"), p["nation/regionkey"].alias("regionkey"))


@made("SELECT r_name AS region, list_sort(list(n_name)) AS parts FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def pull_components(spark, sf_dir):
    """``*`` expands components: a region's nations as its parts."""
    db = warehouse(spark, sf_dir, ("region", "nation"))
    db.schema[":region/part"] = Attr(ref=True, component=True, many=True)
    n = _read(spark, sf_dir, "nation")
    db = db.with_relation(":region/part", n.select(_ref(db, "region", F.col("n_regionkey")).alias("e"), _ref(db, "nation", F.col("n_nationkey")).alias("v")), "entity")
    p = F.col("pulled")
    df = pull_frame(db, "[*]", _read(spark, sf_dir, "region").select(_ref(db, "region", F.col("r_regionkey")).alias("e")))
    return df.select(p["region/name"].alias("region"), F.array_sort(F.transform(p["region/part"], lambda x: x["nation/name"])).alias("parts"))


@made("SELECT a.o_orderkey AS orderkey, b.o_orderkey AS next_key, c.o_orderkey AS after_key FROM orders a LEFT JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 LEFT JOIN orders c ON c.o_orderkey = b.o_orderkey + 1")
def pull_recursion(spark, sf_dir):
    """Recursion two levels deep over the chain of orders with neighbouring keys."""
    db = warehouse(spark, sf_dir, ("orders",))
    db.schema[":orders/next"] = Attr(ref=True)
    o = _read(spark, sf_dir, "orders").select("o_orderkey")
    pairs = o.join(o.select((F.col("o_orderkey") - 1).alias("o_orderkey")), "o_orderkey")
    db = db.with_relation(":orders/next", pairs.select(_ref(db, "orders", F.col("o_orderkey")).alias("e"), _ref(db, "orders", F.col("o_orderkey") + 1).alias("v")), "entity")
    p = F.col("pulled")
    df = pull_frame(db, "[:orders/orderkey {:orders/next 2}]")
    return df.select(p["orders/orderkey"].alias("orderkey"), p["orders/next"]["orders/orderkey"].alias("next_key"), p["orders/next"]["orders/next"]["orders/orderkey"].alias("after_key"))


@made("SELECT n_name AS name, 'region ' || n_regionkey AS region, (SELECT count(*) FROM nation b WHERE b.n_regionkey = a.n_regionkey) AS neighbours, 'none' AS motto FROM nation a")
def pull_documents(spark, sf_dir):
    """pull_many() over all nations: nested, reverse, default, legacy limit; the visitor hears of every read."""
    db = _geo(spark, sf_dir).database(spark)
    heard = []
    refs = [101 + k for k, _, _ in _nations(spark, sf_dir)]
    docs = pull_many(db, '[:name (:motto :default "none") {:region [:name (limit :_region 100)]}]', [*refs, 77777], lambda *event: heard.append(event[0]))
    assert docs[-1] is None and {"attr", "reverse"} <= set(heard) and pull(db, "[*]", refs[0])[":name"]
    rows = [(d[":name"], d[":region"][":name"], len(d[":region"][":_region"]), d[":motto"]) for d in docs[:-1]]
    return spark.createDataFrame(rows, "name string, region string, neighbours long, motto string")


@made("SELECT n_nationkey::BIGINT AS nationkey, 24 - n_nationkey::BIGINT AS below, true AS stub FROM nation")
def pull_unbounded_recursion(spark, sf_dir):
    """A chain of all nations whose last one refers to the first: recursion goes to the end, and a seen entity is a stub."""
    rows = _nations(spark, sf_dir)
    facts = [(101 + k, ":key", k) for k, _, _ in rows] + [(101 + k, ":next", 101 + (k + 1) % len(rows)) for k, _, _ in rows]
    db = Database.of_datoms(spark, facts, {":next": Attr(ref=True)})
    out = []
    for doc in pull_many(db, "[:key {:next ...}]", [101 + k for k, _, _ in rows]):
        at, chain = doc, []
        while isinstance(at, dict) and Keyword(":key") in at and (not chain or at[":key"] != doc[":key"]):
            chain.append(at[":key"])
            at = at.get(":next")
        out.append((doc[":key"], len(rows) - 1 - chain.index(0) if doc[":key"] == 0 else len(rows) - 1 - doc[":key"], len(chain) == len(rows)))
    return spark.createDataFrame(out, "nationkey long, below long, stub boolean")


@made("SELECT n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, r_name FROM region")
def pull_in_find(spark, sf_dir):
    """(pull ?e pattern), (pull ?e ?pattern) and (pull $src ?e pattern)."""
    db = _geography(spark, sf_dir)
    a = plan("[:find (pull ?e [:nation/name {:nation/region [:region/name]}]) :keys p :where [?e :nation/name _]]", db)
    b = plan("[:find (pull $b ?e ?pattern) :keys p :in $b ?pattern :where [$b ?e :region/name _]]", db, edn.read("[:region/name]"))
    return a.select(F.col("p.`nation/name`").alias("name"), F.col("p.`nation/region`.`region/name`").alias("region")).unionByName(b.select(F.col("p.`region/name`").alias("name"), F.col("p.`region/name`").alias("region")))


# ---- streaming ------------------------------------------------------------------------------------------------------------


@made("SELECT o_orderkey AS orderkey, o_totalprice AS price FROM orders WHERE o_orderstatus <> 'P'")
def stream_of_facts(spark, sf_dir):
    """All prices as a stream; those of partly shipped orders are taken back by a later micro-batch."""
    root = scratch_path(spark, "stream")
    o = _read(spark, sf_dir, "orders")
    rows = lambda df, added: df.select(F.col("o_orderkey").alias("e"), F.lit(":price").alias("a"), F.col("o_totalprice").cast("string").alias("v"), F.lit(added).alias("added"), F.lit(0).cast("bigint").alias("seq"))
    for part in (rows(o, True), rows(o.filter("o_orderstatus = 'P'"), False)):
        part.write.mode("append").parquet(f"{root}/in")
        ingest.start(spark.readStream.schema(part.schema).parquet(f"{root}/in"), f"{root}/out").awaitTermination()
    db = ingest.current(spark, f"{root}/out", {}, {":price": "double"})
    return plan("[:find ?o ?p :keys orderkey price :where [?o :price ?p]]", db)


QUERIES = {n: _run(n) for n in TEXT} | {n: f for n, (f, _) in MADE.items()}
ORACLE_SQL = {n: sql for n, (_, _, sql, _) in TEXT.items()} | {n: sql for n, (_, sql) in MADE.items()}
