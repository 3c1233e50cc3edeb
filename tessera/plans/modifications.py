"""Changes as functions from snapshot to snapshot."""

from pyspark.sql import functions as F

from ..operators import modify as m
from .registry import query


@query("SELECT * FROM region UNION ALL SELECT 99, 'NOWHERE' UNION ALL SELECT 100, NULL")
def insert_rows(t):
    return m.insert(t.region, [{"r_regionkey": 99, "r_name": "NOWHERE"}, {"r_regionkey": 100}])


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN round(c_acctbal + 100, 2) ELSE c_acctbal END AS c_acctbal FROM customer")
def update_rows(t):
    return m.update(t.customer, {"c_mktsegment": "BUILDING"}, {"c_acctbal": F.round(F.col("c_acctbal") + 100, 2)}).select("c_custkey", "c_acctbal")


@query("SELECT c_custkey, 0.0 AS c_acctbal FROM customer WHERE c_acctbal < 0")
def update_returning(t):
    return m.updated_rows(t.customer, F.col("c_acctbal") < 0, {"c_acctbal": 0.0}).select("c_custkey", "c_acctbal")


@query("SELECT o_orderkey FROM orders WHERE NOT (o_totalprice > 30000)")
def delete_rows(t):
    return m.delete(t.orders, F.col("o_totalprice") > 30000).select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def delete_with_join(t):
    late = t.orders.where("o_orderstatus = 'P'")
    return m.delete_using(t.customer, late, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey")


SOURCE = "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey + 1000000, 5.0 FROM supplier WHERE s_suppkey % 10 = 0"


def changes(t):
    even = t.supplier.where("s_suppkey % 2 = 0").select("s_suppkey", "s_acctbal")
    return even.union(t.supplier.where("s_suppkey % 10 = 0").select(F.col("s_suppkey") + 1000000, F.lit(5.0)))


@query(f"""WITH s AS ({SOURCE}) SELECT coalesce(t.s_suppkey, s.s_suppkey) AS s_suppkey, CASE WHEN t.s_suppkey IS NULL THEN 'new' ELSE t.s_name END AS s_name,
CASE WHEN t.s_suppkey IS NOT NULL AND s.s_suppkey IS NOT NULL THEN -1.0 WHEN t.s_suppkey IS NULL THEN s.s_acctbal ELSE t.s_acctbal END AS s_acctbal
FROM supplier t FULL JOIN s ON t.s_suppkey = s.s_suppkey
WHERE NOT (t.s_suppkey IS NOT NULL AND s.s_suppkey IS NOT NULL AND s.s_acctbal < 0) AND NOT (s.s_suppkey IS NULL AND t.s_suppkey % 3 = 0)""")
def merge_branches(t):
    branches = [
        m.Branch("matched", None, F.col("s.s_acctbal") < 0),
        m.Branch("matched", {"s_acctbal": F.lit(-1.0)}),
        m.Branch("not_matched", {"s_suppkey": F.col("s.s_suppkey"), "s_acctbal": F.col("s.s_acctbal"), "s_name": F.lit("new")}),
        m.Branch("not_matched_by_source", None, F.col("t.s_suppkey") % 3 == 0),
    ]
    return m.merge(t.supplier, changes(t), {"s_suppkey": "s_suppkey"}, branches).select("s_suppkey", "s_name", "s_acctbal")


NEW = "SELECT CAST(r_regionkey + 3 AS INTEGER) AS r_regionkey, lower(r_name) AS r_name FROM region"


@query(f"SELECT r_regionkey, r_name FROM ({NEW}) n UNION ALL SELECT r_regionkey, r_name FROM region WHERE r_regionkey NOT IN (SELECT r_regionkey FROM ({NEW}) n)")
def upsert_rows(t):
    return m.upsert(t.region, t.region.select((F.col("r_regionkey") + 3).alias("r_regionkey"), F.lower("r_name").alias("r_name")), "r_regionkey")


@query(f"SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey, r_name FROM ({NEW}) n WHERE r_regionkey NOT IN (SELECT r_regionkey FROM region)")
def insert_ignore(t):
    return m.upsert(t.region, t.region.select((F.col("r_regionkey") + 3).alias("r_regionkey"), F.lower("r_name").alias("r_name")), "r_regionkey", ignore=True)


SPANS = "SELECT n_nationkey AS id, n_nationkey AS a, n_nationkey + 6 AS b, 'old' AS v FROM nation"


@query(f"""WITH s AS ({SPANS}) SELECT id, a, b, v FROM s WHERE NOT (a < 15 AND b > 10) UNION ALL SELECT id, a, 10, v FROM s WHERE a < 10 AND b > 10
UNION ALL SELECT id, greatest(a, 10), least(b, 15), 'new' FROM s WHERE a < 15 AND b > 10 UNION ALL SELECT id, 15, b, v FROM s WHERE b > 15 AND a < 15""")
def temporal_update(t):
    k = F.col("n_nationkey")
    return m.for_portion_of(t.nation.select(k.alias("id"), k.alias("a"), (k + 6).alias("b"), F.lit("old").alias("v")), "a", "b", 10, 15, F.lit(True), {"v": "new"})


@query("""SELECT l_orderkey, l_linenumber, min(CASE WHEN l_orderkey % 5 = 0 THEN l_quantity + 1 ELSE l_quantity END) AS l_quantity FROM lineitem GROUP BY ALL
UNION ALL SELECT o_orderkey, 99, 1.0 FROM orders WHERE o_orderkey % 50 = 0""")
def upsert_two_keys(t):
    own = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("l_quantity"))
    changed = own.where("l_orderkey % 5 = 0").withColumn("l_quantity", F.col("l_quantity") + 1)
    new = t.orders.where("o_orderkey % 50 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(99).alias("l_linenumber"), F.lit(1.0).alias("l_quantity"))
    return m.upsert(own, changed.unionByName(new), ["l_orderkey", "l_linenumber"])


@query("SELECT c_custkey, CASE WHEN n_name IS NULL THEN c_mktsegment ELSE n_name END AS c_mktsegment FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey = 1")
def update_with_join(t):
    other = t.nation.where("n_regionkey = 1")
    return m.update_using(t.customer, other, {"c_nationkey": "n_nationkey"}, {"c_mktsegment": F.col("s.n_name")}).select("c_custkey", "c_mktsegment")


@query("SELECT * FROM region WHERE r_regionkey > 1 UNION ALL SELECT 0, 'NEW' UNION ALL SELECT 1, NULL")
def replace_rows(t):
    return m.replace(t.region, m.insert_select(t.region, [{"r_regionkey": 0, "r_name": "NEW"}, {"r_regionkey": 1}]), "r_regionkey")
