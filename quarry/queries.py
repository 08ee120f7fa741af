"""Queries over the tables of a data directory, one or more for each family of operators, with equivalent SQL.

Each is Datalog text; :keys name the columns.  Sums of doubles are rounded on
both sides, since addition in another order differs in the last digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import families
from quarry.api import plan
from quarry.operators import index
from quarry.operators.pull import pull_frame
from quarry.sources.database import KEY_BITS, Database
from quarry.sources.warehouse import warehouse

FLAGSHIP = """
[:find ?segment (sum ?total) (count ?o) :keys segment total n_orders
 :where [?o :orders/custkey ?ck] [?o :orders/totalprice ?total]
        [?c :customer/custkey ?ck] [?c :customer/mktsegment ?segment]
        [(> ?total 100000)]]"""

#: name: (tables it reads, query, SQL, columns to round)
DATALOG: dict[str, tuple[str, str, str, tuple]] = {
    "flagship_segment_revenue": ("orders customer", FLAGSHIP, "SELECT c_mktsegment AS segment, round(sum(o_totalprice), 2) AS total, count(*) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000 GROUP BY 1", ("total",)),
    "pattern_scan": ("nation", "[:find ?k ?n :keys nationkey name :where [?e :nation/nationkey ?k] [?e :nation/name ?n]]", "SELECT DISTINCT n_nationkey::BIGINT AS nationkey, n_name AS name FROM nation", ()),
    "pattern_constant": ("orders", '[:find ?k ?p :keys orderkey price :where [?o :orders/orderstatus "F"] [?o :orders/orderkey ?k] [?o :orders/totalprice ?p]]', "SELECT DISTINCT o_orderkey AS orderkey, o_totalprice AS price FROM orders WHERE o_orderstatus = 'F'", ()),
    "star_many_attributes": ("lineitem", '[:find ?flag ?status (sum ?q) (avg ?price) (count ?l) :keys flag status qty avg_price n :where [?l :lineitem/returnflag ?flag] [?l :lineitem/linestatus ?status] [?l :lineitem/quantity ?q] [?l :lineitem/extendedprice ?price]]', "SELECT l_returnflag AS flag, l_linestatus AS status, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS avg_price, count(*) AS n FROM lineitem GROUP BY 1, 2", ("qty", ("avg_price", 4))),
    "entity_id_returned": ("customer", "[:find ?c ?n :keys entity name :where [?c :customer/name ?n] [?c :customer/acctbal ?b] [(> ?b 9000)]]", f"SELECT (1::BIGINT << {KEY_BITS}) + c_custkey AS entity, c_name AS name FROM customer WHERE c_acctbal > 9000", ()),
    "join_three_tables": ("region nation supplier", "[:find ?r (count ?s) (max ?b) :keys region n_suppliers best :where [?s :supplier/nationkey ?nk] [?s :supplier/acctbal ?b] [?n :nation/nationkey ?nk] [?n :nation/regionkey ?rk] [?g :region/regionkey ?rk] [?g :region/name ?r]]", "SELECT r_name AS region, count(*) AS n_suppliers, max(s_acctbal) AS best FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1", ()),
    "join_big": ("lineitem orders customer nation", "[:find ?n (sum ?rev) :keys nation revenue :where [?l :lineitem/orderkey ?ok] [?l :lineitem/extendedprice ?p] [?l :lineitem/discount ?d] [?o :orders/orderkey ?ok] [?o :orders/custkey ?ck] [?c :customer/custkey ?ck] [?c :customer/nationkey ?nk] [?x :nation/nationkey ?nk] [?x :nation/name ?n] [(- 1 ?d) ?f] [(* ?p ?f) ?rev]]", "SELECT n_name AS nation, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1", ("revenue",)),
    "theta_join": ("nation region", "[:find ?a ?b :keys a b :where [?x :nation/nationkey ?i] [?x :nation/regionkey ?r] [?x :nation/name ?a] [?y :nation/nationkey ?j] [?y :nation/regionkey ?r] [?y :nation/name ?b] [(< ?i ?j)]]", "SELECT DISTINCT x.n_name AS a, y.n_name AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey", ()),
    "comparison_chain": ("part", "[:find ?k ?s :keys partkey size :where [?p :part/partkey ?k] [?p :part/size ?s] [(< 10 ?s 20)] [(>= ?s 12)]]", "SELECT DISTINCT p_partkey AS partkey, p_size::BIGINT AS size FROM part WHERE p_size > 10 AND p_size < 20 AND p_size >= 12", ()),
    "equality_predicates": ("orders", '[:find ?k :keys orderkey :where [?o :orders/orderkey ?k] [?o :orders/orderstatus ?s] [?o :orders/orderpriority ?p] [(not= ?s "O")] [(= ?p ?p "1-URGENT")]]', "SELECT DISTINCT o_orderkey AS orderkey FROM orders WHERE o_orderstatus <> 'O' AND o_orderpriority = '1-URGENT'", ()),
    "type_predicates": ("customer", "[:find ?k :keys custkey :where [?c :customer/custkey ?k] [?c :customer/name ?n] [?c :customer/acctbal ?b] [(string? ?n)] [(number? ?b)] [(integer? ?k)] [(even? ?k)] [(neg? ?b)]]", "SELECT DISTINCT c_custkey AS custkey FROM customer WHERE c_custkey % 2 = 0 AND c_acctbal < 0", ()),
    "boolean_predicates": ("part", "[:find ?k :keys partkey :where [?p :part/partkey ?k] [?p :part/size ?s] [(> ?s 25) ?big] [(odd? ?k) ?odd] [(and ?big ?odd) ?both] [(true? ?both)]]", "SELECT DISTINCT p_partkey AS partkey FROM part WHERE p_size > 25 AND p_partkey % 2 <> 0", ()),
    "string_predicates": ("part", '[:find ?n :keys name :where [?p :part/name ?n] [?p :part/type ?t] [(clojure.string/includes? ?t "E")] [(clojure.string/starts-with? ?n "s")] [(clojure.string/ends-with? ?n "g")]]', "SELECT DISTINCT p_name AS name FROM part WHERE contains(p_type, 'E') AND starts_with(p_name, 's') AND ends_with(p_name, 'g')", ()),
    "arithmetic": ("part", "[:find ?k ?q ?r ?m ?i ?d :keys partkey quot rem modulo inc half :where [?p :part/partkey ?k] [?p :part/size ?s] [(quot ?k 7) ?q] [(- ?s 25) ?x] [(rem ?x 7) ?r] [(mod ?x 7) ?m] [(inc ?s) ?i] [(/ ?s 2) ?d]]", "SELECT DISTINCT p_partkey AS partkey, p_partkey // 7 AS quot, (p_size - 25)::BIGINT % 7 AS rem, (((p_size - 25)::BIGINT % 7) + 7) % 7 AS modulo, p_size::BIGINT + 1 AS inc, p_size / 2.0::DOUBLE AS half FROM part", ()),
    "string_functions": ("nation", '[:find ?u ?c ?r ?i ?s ?j :keys up cap rev at sub joined :where [?n :nation/name ?x] [(upper-case ?x) ?u] [(clojure.string/capitalize ?x) ?c] [(clojure.string/reverse ?x) ?r] [(clojure.string/index-of ?x "A") ?i] [(subs ?x 0 3) ?s] [(str ?x "-" ?i) ?j]]', "SELECT DISTINCT upper(n_name) AS up, upper(n_name[1]) || lower(n_name[2:]) AS cap, reverse(n_name) AS rev, (strpos(n_name, 'A') - 1)::BIGINT AS at, substr(n_name, 1, 3) AS sub, n_name || '-' || (strpos(n_name, 'A') - 1) AS joined FROM nation WHERE strpos(n_name, 'A') > 0", ()),
    "regex_functions": ("pages", '[:find ?k ?h ?n :keys page_id host slashes :where [?p :pages/page_id ?k] [?p :pages/url ?u] [(re-find #"//[^/]+" ?u) ?x] [(subs ?x 2) ?h] [(clojure.string/replace ?u #"[^/]" "") ?s] [(count ?s) ?n]]', "SELECT DISTINCT page_id, substr(regexp_extract(url, '//[^/]+'), 3) AS host, length(regexp_replace(url, '[^/]', '', 'g')) AS slashes FROM pages WHERE regexp_matches(url, '//[^/]+')", ()),
    "split_and_count": ("part", '[:find ?w (count ?p) :keys word n :where [?p :part/type ?t] [(clojure.string/split ?t #" ") [?w ...]]]', "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS word FROM part) GROUP BY 1", ()),
    "collections_range": ("region", "[:find ?k ?i ?v :keys regionkey i v :where [?r :region/regionkey ?k] [(range 1 4) ?i] [(vector ?k ?i 7) ?t] [(get ?t 1) ?v]]", "SELECT DISTINCT r_regionkey::BIGINT AS regionkey, i AS i, i AS v FROM region, range(1, 4) t(i)", ()),
    "tuple_untuple": ("nation", "[:find ?a ?b :keys a b :where [?n :nation/nationkey ?k] [?n :nation/regionkey ?r] [(tuple ?k ?r) ?t] [(untuple ?t) [?a ?b]]]", "SELECT DISTINCT n_nationkey::BIGINT AS a, n_regionkey::BIGINT AS b FROM nation", ()),
    "ground_relation": ("region", '[:find ?n ?tag :keys name tag :where [?r :region/regionkey ?k] [?r :region/name ?n] [(ground [[0 "x"] [1 "y"] [9 "z"]]) [[?k ?tag]]]]', "SELECT DISTINCT r_name AS name, tag FROM region JOIN (VALUES (0, 'x'), (1, 'y'), (9, 'z')) v(k, tag) ON k = r_regionkey", ()),
    "not_clause": ("customer orders", "[:find ?k :keys custkey :where [?c :customer/custkey ?k] (not [?o :orders/custkey ?k] [?o :orders/orderstatus \"P\"])]", "SELECT c_custkey AS custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')", ()),
    "not_join": ("customer orders", "[:find ?k :keys custkey :where [?c :customer/custkey ?k] (not-join [?k] [?o :orders/custkey ?k] [?o :orders/totalprice ?t] [(> ?t 200000)])]", "SELECT c_custkey AS custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)", ()),
    "or_clause": ("orders", '[:find ?k :keys orderkey :where [?o :orders/orderkey ?k] (or [?o :orders/orderstatus "P"] (and [?o :orders/orderstatus "F"] [?o :orders/orderpriority "5-LOW"]))]', "SELECT DISTINCT o_orderkey AS orderkey FROM orders WHERE o_orderstatus = 'P' OR (o_orderstatus = 'F' AND o_orderpriority = '5-LOW')", ()),
    "or_join": ("customer supplier nation", "[:find ?n :keys name :where [?x :nation/nationkey ?k] [?x :nation/name ?n] (or-join [?k] (and [?c :customer/nationkey ?k] [?c :customer/acctbal ?b] [(> ?b 9900)]) (and [?s :supplier/nationkey ?k] [?s :supplier/acctbal ?b] [(> ?b 9500)]))]", "SELECT DISTINCT n_name AS name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 9500)", ()),
    "inputs_collection": ("nation", None, "SELECT DISTINCT n_name AS name, n_regionkey::BIGINT AS regionkey FROM nation WHERE n_regionkey IN (1, 3)", ()),
    "inputs_relation_and_scalar": ("part", None, "SELECT DISTINCT p_partkey AS partkey, f.v::BIGINT AS factor FROM part JOIN (VALUES (10, 2), (20, 3)) f(s, v) ON p_size = f.s WHERE p_retailprice > 905", ()),
    "rule_plain": ("nation region", "[:find ?n :keys name :rules [(in-region ?e ?r) [?e :nation/regionkey ?k] [?g :region/regionkey ?k] [?g :region/name ?r]] :where (in-region ?e \"ASIA\") [?e :nation/name ?n]]", "SELECT DISTINCT n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'", ()),
    "rule_recursive": ("region", "[:find ?a ?b :keys a b :rules [(next ?x ?y) [?n :region/regionkey ?x] [?m :region/regionkey ?y] [(inc ?x) ?y]] [(reach ?x ?y) (next ?x ?y)] [(reach ?x ?y) (next ?x ?z) (reach ?z ?y)] :where (reach ?a ?b)]", "SELECT a.r_regionkey::BIGINT AS a, b.r_regionkey::BIGINT AS b FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey", ()),
    "aggregates_counts": ("orders", "[:find ?s (count ?o) (count-distinct ?c) (min ?t) (max ?t) :keys status n customers lowest highest :where [?o :orders/orderstatus ?s] [?o :orders/custkey ?c] [?o :orders/totalprice ?t]]", "SELECT o_orderstatus AS status, count(*) AS n, count(DISTINCT o_custkey) AS customers, min(o_totalprice) AS lowest, max(o_totalprice) AS highest FROM orders GROUP BY 1", ()),
    "aggregates_moments": ("part", "[:find ?b (median ?p) (variance ?p) (stddev ?p) (avg ?p) :keys brand med var sd mean :where [?x :part/brand ?b] [?x :part/retailprice ?p]]", "SELECT p_brand AS brand, round(median(p_retailprice), 4) AS med, round(var_pop(p_retailprice), 2) AS var, round(stddev_pop(p_retailprice), 4) AS sd, round(avg(p_retailprice), 4) AS mean FROM part GROUP BY 1", (("med", 4), ("var", 2), ("sd", 4), ("mean", 4))),
    "with_keeps_multiplicity": ("customer", "[:find (sum ?b) :keys total :with ?c :where [?c :customer/acctbal ?b]]", "SELECT round(sum(c_acctbal), 2) AS total FROM customer", ("total",)),
    "set_sum_without_entity": ("part", "[:find ?s (count ?b) :keys size brands :with ?b :where [?p :part/size ?s] [?p :part/brand ?b]]", "SELECT p_size::BIGINT AS size, count(DISTINCT p_brand) AS brands FROM part GROUP BY 1", ()),
    "missing": ("documents labels", None, "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)", ()),
    "get_else": ("documents labels", None, "SELECT d.doc_id, coalesce(quality, -1)::BIGINT AS quality FROM documents d LEFT JOIN labels l USING (doc_id)", ()),
    "get_some": ("documents labels", None, "SELECT d.doc_id, CASE WHEN toxic IS NOT NULL THEN ':labels/toxic' ELSE ':documents/n_chars' END AS attr FROM documents d LEFT JOIN labels l USING (doc_id)", ()),
    "cross_source_join": ("customer orders", None, "SELECT c_mktsegment AS segment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1", ()),
    "relation_source": ("events", None, "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE value > 10 GROUP BY 1", ("total",)),
    "variable_attribute": ("region", "[:find ?a (count ?e) :keys attr n :where [?e ?a ?v]]", "SELECT unnest([':region/regionkey', ':region/name', ':region/comment'][1:2]) AS attr, count(*) AS n FROM region GROUP BY 1", ()),
    "instants": ("orders", '[:find ?k :keys orderkey :where [?o :orders/orderkey ?k] [?o :orders/orderdate ?d] [(< ?d #inst "1996-01-01")]]', "SELECT DISTINCT o_orderkey AS orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'", ()),
}


def _run(name: str):
    tables, text, _, rounded = DATALOG[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = plan(text, warehouse(spark, sf_dir, tuple(tables.split())))
        return _rounded(df, rounded)

    return run


def _rounded(df: DataFrame, cols) -> DataFrame:
    for c in cols:
        c, n = c if isinstance(c, tuple) else (c, 2)
        df = df.withColumn(c, F.round(c, n))
    return df


def _labelled(spark: SparkSession, sf_dir: str) -> Database:
    """Documents as a wide table, labels as stored relations of the documents' entities."""
    db = warehouse(spark, sf_dir, ("documents",))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    entity = F.lit(db.tables["documents"].ordinal << KEY_BITS) + F.col("doc_id")
    for c in ("quality", "toxic"):
        db = db.with_relation(f":labels/{c}", labels.select(entity.alias("e"), F.col(c).cast("bigint").alias("v")).filter("v is not null"))
    return db


def _inputs_collection(spark, sf_dir):
    return plan("[:find ?n ?r :keys name regionkey :in $ [?r ...] :where [?e :nation/regionkey ?r] [?e :nation/name ?n]]", warehouse(spark, sf_dir, ("nation",)), [1, 3])


def _inputs_relation(spark, sf_dir):
    return plan("[:find ?k ?f :keys partkey factor :in $ [[?s ?f]] ?floor :where [?p :part/size ?s] [?p :part/partkey ?k] [?p :part/retailprice ?r] [(> ?r ?floor)]]", warehouse(spark, sf_dir, ("part",)), [[10, 2], [20, 3]], 905)


def _missing(spark, sf_dir):
    return plan("[:find ?k :keys doc_id :where [?d :documents/doc_id ?k] [(missing? $ ?d :labels/quality)]]", _labelled(spark, sf_dir))


def _get_else(spark, sf_dir):
    return plan("[:find ?k ?q :keys doc_id quality :where [?d :documents/doc_id ?k] [(get-else $ ?d :labels/quality -1) ?q]]", _labelled(spark, sf_dir))


def _get_some(spark, sf_dir):
    return plan("[:find ?k ?a :keys doc_id attr :where [?d :documents/doc_id ?k] [(get-some $ ?d :labels/toxic :documents/n_chars) [?a ?v]]]", _labelled(spark, sf_dir))


def _cross_source(spark, sf_dir):
    return plan("[:find ?s (count ?o) :keys segment n :in $a $b :where [$a ?o :orders/custkey ?k] [$b ?c :customer/custkey ?k] [$b ?c :customer/mktsegment ?s]]", warehouse(spark, sf_dir, ("orders",)), warehouse(spark, sf_dir, ("customer",)))


def _relation_source(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "value")
    return _rounded(plan("[:find ?t (count ?e) (sum ?v) :keys event_type n total :in $rel :where [$rel ?e ?t ?v] [(> ?v 10)]]", rows), ("total",))


def _pull_nested(spark, sf_dir):
    db = warehouse(spark, sf_dir, ("customer", "nation"))
    ref = F.lit(db.tables["nation"].ordinal << KEY_BITS)
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    from quarry.sources.database import Attr

    db.schema[":customer/nation"] = Attr(ref=True)
    nation = customer.select((F.lit(db.tables["customer"].ordinal << KEY_BITS) + F.col("c_custkey")).alias("e"), (ref + F.col("c_nationkey")).alias("v"))
    db = db.with_relation(":customer/nation", nation, "entity")
    out = pull_frame(db, "[:customer/custkey (:customer/acctbal :as :balance) {:customer/nation [:nation/name]}]")
    return out.select(F.col("pulled.`customer/custkey`").alias("custkey"), F.col("pulled.balance").alias("balance"), F.col("pulled.`customer/nation`.`nation/name`").alias("nation"))


def _pull_reverse(spark, sf_dir):
    from quarry.sources.database import Attr

    db = warehouse(spark, sf_dir, ("nation", "supplier"))
    db.schema[":supplier/nation"] = Attr(ref=True)
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    e, v = F.lit(db.tables["supplier"].ordinal << KEY_BITS) + F.col("s_suppkey"), F.lit(db.tables["nation"].ordinal << KEY_BITS) + F.col("s_nationkey")
    db = db.with_relation(":supplier/nation", s.select(e.alias("e"), v.alias("v")), "entity")
    ids = spark.read.parquet(f"{sf_dir}/nation.parquet").select((F.lit(db.tables["nation"].ordinal << KEY_BITS) + F.col("n_nationkey")).alias("e"))
    out = pull_frame(db, "[:nation/name {(:supplier/_nation :limit nil) [:supplier/suppkey]}]", ids)
    n = F.coalesce(F.size(F.col("pulled.`supplier/_nation`")), F.lit(0)).cast("long")
    return out.select(F.col("pulled.`nation/name`").alias("name"), F.when(n > 0, n).otherwise(F.lit(0)).cast("long").alias("n_suppliers"))


def _index_range(spark, sf_dir):
    db = warehouse(spark, sf_dir, ("part",))
    return index.index_range(db, ":part/retailprice", 910.0, 915.0).select((F.col("e") - F.lit(1 << KEY_BITS)).alias("partkey"), F.col("v").alias("price"))


def _datoms_scan(spark, sf_dir):
    db = warehouse(spark, sf_dir, ("nation",))
    return index.datoms(db, ":aevt", ":nation/name").select((F.col("e") - F.lit(1 << KEY_BITS)).alias("nationkey"), F.col("v").alias("name"))


def _diff(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    a = Database(spark).with_relation(":status", o.select(F.col("o_orderkey").alias("e"), F.col("o_orderstatus").alias("v")))
    b = Database(spark).with_relation(":status", o.select(F.when(F.col("o_totalprice") > 150000, -F.col("o_orderkey")).otherwise(F.col("o_orderkey")).alias("e"), F.when(F.col("o_orderpriority") == "5-LOW", "X").otherwise(F.col("o_orderstatus")).alias("v")))
    left, right, both = index.diff(a, b)
    tag = lambda df, t: df.select("e", F.col("v.str").alias("v"), F.lit(t).alias("side"))
    return tag(left, "left").unionByName(tag(right, "right")).unionByName(tag(both, "both"))


def _filtered(spark, sf_dir):
    db = warehouse(spark, sf_dir, ("orders",)).filter(lambda a, e, v: (v > 150000) if a == ":orders/totalprice" else F.lit(True))
    return plan("[:find ?s (count ?o) :keys status n :where [?o :orders/orderstatus ?s] [?o :orders/totalprice _]]", db)


_SPECIAL = {
    "inputs_collection": _inputs_collection, "inputs_relation_and_scalar": _inputs_relation, "missing": _missing, "get_else": _get_else, "get_some": _get_some,
    "cross_source_join": _cross_source, "relation_source": _relation_source,
}
_FRAMES = {
    "pull_nested": (_pull_nested, "SELECT c_custkey AS custkey, c_acctbal AS balance, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "pull_reverse": (_pull_reverse, "SELECT n_name AS name, count(s_suppkey) AS n_suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1"),
    "index_range": (_index_range, "SELECT p_partkey AS partkey, p_retailprice AS price FROM part WHERE p_retailprice BETWEEN 910 AND 915"),
    "datoms_scan": (_datoms_scan, "SELECT n_nationkey::BIGINT AS nationkey, n_name AS name FROM nation"),
    "db_diff": (_diff, "SELECT coalesce(a.k, b.k) AS e, coalesce(a.s, b.s) AS v, CASE WHEN b.k IS NULL THEN 'left' WHEN a.k IS NULL THEN 'right' ELSE 'both' END AS side FROM (SELECT o_orderkey k, o_orderstatus s FROM orders) a FULL JOIN (SELECT CASE WHEN o_totalprice > 150000 THEN -o_orderkey ELSE o_orderkey END k, CASE WHEN o_orderpriority = '5-LOW' THEN 'X' ELSE o_orderstatus END s FROM orders) b ON a.k = b.k AND a.s = b.s"),
    "filtered_database": (_filtered, "SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_totalprice > 150000 GROUP BY 1"),
}

QUERIES = {n: _SPECIAL.get(n) or _run(n) for n in DATALOG} | {n: f for n, (f, _) in _FRAMES.items()} | families.QUERIES
ORACLE_SQL = {n: sql for n, (_, _, sql, _) in DATALOG.items()} | {n: sql for n, (_, sql) in _FRAMES.items()} | families.ORACLE_SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship_segment_revenue"](spark, sf_dir)
