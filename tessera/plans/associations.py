"""Associations: joins, nesting and filters by name."""

from pyspark.sql import functions as F

from ..operators import associations as a
from .registry import query


def orders_of_customer(t, **more):
    return a.Association("orders", t.orders, {"c_custkey": "o_custkey"}, **more)


def nation_of_customer(t):
    return a.Association("nation", t.nation, {"c_nationkey": "n_nationkey"}, one=True)


def parts_of_supplier(t, **more):
    return a.Association("parts", t.part, {"s_suppkey": "l_suppkey"}, through=t.lineitem.select("l_suppkey", "l_partkey").distinct(), far_keys={"l_partkey": "p_partkey"}, **more)


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def many_to_one(t):
    return a.eager(t.customer, nation_of_customer(t)).select("c_custkey", "nation.n_name")


@query("""SELECT c_custkey, count(o_orderkey) AS n, coalesce(sum(o_orderkey), 0) AS keys, any_value(n_name) AS nation FROM customer
LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey GROUP BY c_custkey""")
def eager_two_associations(t):
    out = a.eager(t.customer, orders_of_customer(t), nation_of_customer(t))
    keys = F.aggregate("orders", F.lit(0).cast("long"), lambda n, o: n + o.o_orderkey)
    return out.select("c_custkey", F.size("orders").cast("long").alias("n"), keys.alias("keys"), F.col("nation.n_name").alias("nation"))


@query("""SELECT c_custkey, o_orderkey FROM customer JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) o
ON o_custkey = c_custkey AND n <= 2""")
def eager_limited(t):
    best = orders_of_customer(t, order=(F.desc("o_totalprice"), F.col("o_orderkey")), limit=2)
    return a.eager(t.customer, best).select("c_custkey", F.explode("orders.o_orderkey").alias("o_orderkey"))


@query("""SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) o
ON o_custkey = c_custkey AND n = 1""")
def one_to_one_first(t):
    first = orders_of_customer(t, order=(F.col("o_orderdate"), F.col("o_orderkey")), one=True)
    return a.eager(t.customer, first).select("c_custkey", "orders.o_orderkey")


@query("SELECT s_suppkey, count(*) AS n, min(p_partkey) AS lo FROM supplier JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) x ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey GROUP BY s_suppkey")
def many_to_many(t):
    rows = a.association_join(t.supplier, parts_of_supplier(t))
    return rows.groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n"), F.min("parts.p_partkey").alias("lo"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)")
def filter_by_association(t):
    return a.with_any(t.customer, orders_of_customer(t), F.col("row.o_totalprice") > 150000).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def exclude_by_association(t):
    return a.without_any(t.customer, orders_of_customer(t)).select("c_custkey")


@query("SELECT DISTINCT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)")
def dataset_association(t):
    return a.associated(t.customer.where("c_acctbal > 9000"), nation_of_customer(t))


@query("SELECT n_nationkey, count(r_regionkey) AS n FROM nation LEFT JOIN region ON r_regionkey IN (n_regionkey, n_nationkey % 5) GROUP BY n_nationkey")
def array_to_many(t):
    own = t.nation.withColumn("keys", F.array("n_regionkey", F.col("n_nationkey") % 5))
    return a.to_many_by_array(own, "keys", t.region, "r_regionkey", "regions").select("n_nationkey", F.size("regions").cast("long").alias("n"))


@query("""SELECT r_name, count(*) AS n, min(o_orderkey) AS lo FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey
JOIN orders ON o_custkey = c_custkey GROUP BY r_name""")
def many_through_many(t):
    customers = t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey", "c_custkey")
    orders = a.Association("order", t.orders, {"r_regionkey": "n_regionkey"}, through=customers, far_keys={"c_custkey": "o_custkey"})
    return a.association_join(t.region, orders).groupBy("r_name").agg(F.count(F.lit(1)).alias("n"), F.min("order.o_orderkey").alias("lo"))


@query("""SELECT s_suppkey, p_partkey FROM supplier JOIN (SELECT l_suppkey, p_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY p_retailprice DESC, p_partkey) AS n
FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) x JOIN part ON p_partkey = l_partkey) y ON l_suppkey = s_suppkey AND n = 1""")
def one_through_one(t):
    best = parts_of_supplier(t, one=True, order=(F.desc("p_retailprice"), F.col("p_partkey")))
    return a.association_join(t.supplier, best).select("s_suppkey", "parts.p_partkey")


@query("""SELECT c_custkey, count(s_suppkey) AS n FROM customer LEFT JOIN supplier ON s_nationkey = c_nationkey AND s_suppkey % 7 = c_custkey % 7 GROUP BY c_custkey""")
def composite_keys(t):
    own = t.customer.select("c_custkey", "c_nationkey", (F.col("c_custkey") % 7).alias("c_seven"))
    other = t.supplier.select("s_suppkey", "s_nationkey", (F.col("s_suppkey") % 7).alias("s_seven"))
    same = a.Association("same", other, {"c_nationkey": "s_nationkey", "c_seven": "s_seven"})
    return a.eager(own, same).select("c_custkey", F.size("same").cast("long").alias("n"))


@query("""SELECT d.doc_id, coalesce(x.n, 0) AS n FROM documents d LEFT JOIN (SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source) x
ON x.lang = d.lang AND x.source = d.source""")
def composite_keys_whole(t):
    """All documents on both sides; each key's documents are counted before the join, so that nothing grows with the square of a group."""
    few = t.documents.select("doc_id", "lang", "source")
    same = a.Association("same", few.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")), {"lang": "lang", "source": "source"}, one=True)
    return a.eager(few, same).select("doc_id", F.coalesce("same.n", F.lit(0)).alias("n"))


@query("""SELECT n_nationkey, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey
LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_nationkey""")
def eager_nested(t):
    customers = a.eager(t.customer.select("c_custkey", "c_nationkey"), a.Association("orders", t.orders.select("o_orderkey", "o_custkey"), {"c_custkey": "o_custkey"}))
    out = a.eager(t.nation, a.Association("customers", customers, {"n_nationkey": "c_nationkey"}))
    orders = F.aggregate("customers", F.lit(0), lambda n, c: n + F.size(c.orders))
    return out.select("n_nationkey", F.size("customers").cast("long").alias("customers"), orders.cast("long").alias("orders"))


@query("""SELECT 'customer' AS kind, c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1, 2 UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY 1, 2""")
def single_table_inheritance(t):
    people = t.customer.select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nation")).unionByName(
        t.supplier.select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("nation")))
    return people.where(F.col("kind").isin("customer", "supplier")).groupBy("kind", "nation").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, lang, quality, CASE WHEN quality IS NULL THEN 'document' ELSE 'labelled' END AS kind FROM documents LEFT JOIN labels USING (doc_id)")
def class_table_inheritance(t):
    kind = F.when(F.col("quality").isNull(), "document").otherwise("labelled")
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", "lang", "quality", kind.alias("kind"))


@query("""SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS at
FROM customer JOIN orders ON o_custkey = c_custkey""")
def eager_ordered(t):
    """Nested rows come in the association's order, not by their first columns."""
    by_price = orders_of_customer(t, order=(F.desc("o_totalprice"), F.col("o_orderkey")))
    return a.eager(t.customer, by_price).select("c_custkey", F.posexplode("orders.o_orderkey").alias("at", "o_orderkey"))


@query("""SELECT c_custkey, count(DISTINCT o_custkey) AS n, count(DISTINCT o_custkey) = 0 OR bool_or(true) AS own FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def one_to_one_unordered(t):
    """Without an order any one row is taken, and its owner comes once."""
    out = a.eager(t.customer, orders_of_customer(t, one=True))
    return out.select("c_custkey", F.col("orders").isNotNull().cast("long").alias("n"), F.coalesce(F.col("orders.o_custkey") == F.col("c_custkey"), F.lit(True)).alias("own"))


@query("SELECT c_custkey, least(count(o_orderkey), 2) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def eager_limited_unordered(t):
    return a.eager(t.customer, orders_of_customer(t, limit=2)).select("c_custkey", F.size("orders").cast("long").alias("n"))
