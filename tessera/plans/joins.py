"""Joins, set operations and subqueries."""

from pyspark.sql import functions as F

from ..operators import joins as j
from ..operators import sets
from ..operators.dataset import Dataset
from .registry import query


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_totalprice > 1000 GROUP BY n_name""")
def flagship_revenue_by_nation(t):
    orders = t.orders.where("o_totalprice > 1000").select("o_orderkey", "o_custkey")
    rows = t.lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("""SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 1000 GROUP BY c_mktsegment""")
def join_by_pairs(t):
    return Dataset(t.orders).where(F.col("o_totalprice") > 1000).join(t.customer, {"c_custkey": "o_custkey"}).group("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).df


@query("SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)")
def join_using(t):
    return j.join(t.documents, t.labels, ["doc_id"]).select("doc_id", "lang", "quality")


@query("SELECT doc_id, lang, quality FROM documents NATURAL LEFT JOIN labels")
def natural_left_join(t):
    return j.natural_join(t.documents, t.labels, "left").select("doc_id", "lang", "quality")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def cross_join(t):
    return j.join(t.region, t.nation).select("r_name", "n_name")


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def theta_self_join(t):
    a, b = t.nation.alias("a"), t.nation.alias("b")
    on = (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))
    return a.join(b, on).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))


@query("""SELECT d.doc_id AS d, l.doc_id AS l FROM (SELECT doc_id FROM documents WHERE lang = 'en') d
FULL JOIN (SELECT doc_id FROM labels WHERE toxic = 1) l ON d.doc_id = l.doc_id""")
def full_outer_join(t):
    d = t.documents.where("lang = 'en'").select(F.col("doc_id").alias("d"))
    return j.join(d, t.labels.where("toxic = 1").select(F.col("doc_id").alias("l")), {"l": "d"}, "full")


@query("SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey")
def right_outer_join(t):
    return j.join(t.supplier, t.nation, {"n_nationkey": "s_nationkey"}, "right").select("s_suppkey", "n_name")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def semi_join_exists(t):
    return j.exists(t.customer, t.orders.where("o_totalprice > 100000"), {"o_custkey": "c_custkey"}).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join_not_exists(t):
    return j.not_exists(t.customer, t.orders, {"o_custkey": "c_custkey"}).select("c_custkey")


@query("SELECT n_name FROM nation WHERE (n_nationkey, n_regionkey) IN (SELECT s_nationkey, s_nationkey % 5 FROM supplier)")
def in_subquery_of_tuples(t):
    return j.in_query(t.nation, ["n_nationkey", "n_regionkey"], t.supplier.select("s_nationkey", F.col("s_nationkey") % 5)).select("n_name")


@query("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT nullif(c_nationkey, 3) FROM customer WHERE c_nationkey < 10)")
def not_in_subquery_with_null(t):
    keys = t.customer.where("c_nationkey < 10").select(F.nullif(F.col("c_nationkey"), F.lit(3)))
    return j.not_in_query(t.nation.select("n_nationkey"), "n_nationkey", keys)


@query("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_nationkey < 10)")
def not_in_subquery(t):
    return j.not_in_query(t.nation.select("n_nationkey"), "n_nationkey", t.customer.where("c_nationkey < 10").select("c_nationkey"))


@query("""SELECT n.n_nationkey, n.n_name, r.r_name, s.s_suppkey FROM nation n LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000""")
def graph_of_tables(t):
    on = {"r": F.col("r.r_regionkey") == F.col("n.n_regionkey"), "s": (F.col("s.s_nationkey") == F.col("n.n_nationkey")) & (F.col("s.s_acctbal") > 5000)}
    rows = j.graph({"n": t.nation, "r": t.region, "s": t.supplier}, on)
    return rows.select("n.n_nationkey", "n.n_name", "r.r_name", "s.s_suppkey")


@query("SELECT a.n_nationkey, a.n_name, a.n_regionkey, b.n_nationkey AS b_n_nationkey, b.n_name AS b_n_name, b.n_regionkey AS b_n_regionkey FROM nation a LEFT JOIN nation b ON b.n_nationkey = a.n_nationkey + 20")
def graph_column_aliases(t):
    return j.graph_columns({"a": t.nation, "b": t.nation}, {"b": F.col("b.n_nationkey") == F.col("a.n_nationkey") + 20})


@query("""SELECT r_name, n_name FROM region, LATERAL (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_name LIMIT 2) x""")
def lateral_top_rows(t):
    best = t.nation.where(F.col("n_regionkey") == F.col("r_regionkey").outer()).orderBy("n_name").limit(2).select("n_name")
    return j.apply(t.region, best).select("r_name", "n_name")


@query("""SELECT r_name, n_name FROM region LEFT JOIN LATERAL (SELECT max(n_name) AS n_name FROM nation WHERE n_regionkey = r_regionkey AND n_name < 'C') x ON true""")
def outer_apply(t):
    low = t.nation.where((F.col("n_regionkey") == F.col("r_regionkey").outer()) & (F.col("n_name") < "C"))
    return j.apply(t.region, low.select(F.max("n_name").alias("n_name")), outer=True).select("r_name", "n_name")


@query("SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS best FROM customer")
def correlated_scalar_subquery(t):
    best = t.orders.where(F.col("o_custkey") == F.col("c_custkey").outer()).select(F.max("o_totalprice")).scalar()
    return t.customer.select("c_custkey", best.alias("best"))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
def scalar_subquery(t):
    return t.orders.where(F.col("o_totalprice") > t.orders.agg(F.avg("o_totalprice") * 1.5).scalar()).select("o_orderkey")


@query("""WITH e AS (SELECT DISTINCT s_nationkey AS a, (s_nationkey * 7 + 3) % 25 AS b FROM supplier)
SELECT n_nationkey AS v0, x.b AS v1, y.b AS v2 FROM nation JOIN e x ON x.a = n_nationkey JOIN e y ON y.a = x.b""")
def property_graph_path(t):
    edges = t.supplier.select(F.col("s_nationkey").alias("a"), ((F.col("s_nationkey") * 7 + 3) % 25).alias("b")).distinct()
    return j.path(t.nation, edges, 2, "n_nationkey", "a", "b")


A, B = "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000", "SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 0"


def sides(t):
    return t.customer.where("c_acctbal > 5000").select(F.col("c_nationkey").alias("k")), t.supplier.where("s_acctbal > 0").select(F.col("s_nationkey").alias("k"))


@query(f"{A} UNION {B}")
def union_distinct(t):
    return sets.union(*sides(t))


@query(f"{A} UNION ALL {B}")
def union_all(t):
    return sets.union(*sides(t), all=True)


@query(f"{A} INTERSECT {B}")
def intersect_distinct(t):
    return sets.intersect(*sides(t))


@query(f"{A} INTERSECT ALL {B}")
def intersect_all(t):
    return sets.intersect(*sides(t), all=True)


@query(f"{A} EXCEPT {B}")
def except_distinct(t):
    return sets.except_(*sides(t))


@query(f"{A} EXCEPT ALL {B}")
def except_all(t):
    return sets.except_(*sides(t), all=True)


@query("""SELECT * FROM (SELECT n_nationkey AS k FROM nation ORDER BY n_nationkey LIMIT 5) a UNION ALL
SELECT * FROM (SELECT n_nationkey AS k FROM nation ORDER BY n_nationkey DESC LIMIT 3) b""")
def union_of_limited(t):
    nations = Dataset(t.nation.select(F.col("n_nationkey").alias("k")))
    return nations.order("k").limit(5).union(nations.order(("k", "desc")).limit(3), all=True).df


@query("""WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12)
SELECT c_name, n FROM customer JOIN big ON o_custkey = c_custkey""")
def common_table_expression(t):
    big = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n > 12")
    return t.customer.join(big, F.col("o_custkey") == F.col("c_custkey")).select("c_name", "n")


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, lang, quality FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")
def natural_full_join(t):
    return j.natural_join(t.documents.select("doc_id", "lang"), t.labels.select("doc_id", "quality"), "full")


@query("SELECT count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate > o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 30 DAY")
def range_condition_join(t):
    late = (F.col("l_shipdate") > F.col("o_orderdate")) & (F.col("l_shipdate") <= F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"))
    return t.lineitem.join(t.orders, (F.col("l_orderkey") == F.col("o_orderkey")) & late).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_partkey, s_suppkey FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'EUROPE' AND p_size = 15 GROUP BY p_partkey, s_suppkey""")
def five_table_join(t):
    rows = t.lineitem.join(t.part.where("p_size = 15"), F.col("l_partkey") == F.col("p_partkey")).join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    rows = rows.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).join(t.region.where("r_name = 'EUROPE'"), F.col("r_regionkey") == F.col("n_regionkey"))
    return rows.select("p_partkey", "s_suppkey").distinct()
