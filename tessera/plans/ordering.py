"""Order, limits, top rows and pages."""

from pyspark.sql import functions as F

from ..operators import paging
from ..operators.dataset import Dataset
from .registry import query


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10")
def order_limit_offset(t):
    return Dataset(t.orders).order(("o_totalprice", "desc"), "o_orderkey").limit(25, 10).select("o_orderkey", "o_totalprice").df


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 7")
def reverse_order(t):
    return Dataset(t.orders).order("o_totalprice", "o_orderkey").reverse().limit(7).select("o_orderkey").df


@query("SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.toxic DESC NULLS LAST, d.doc_id LIMIT 20")
def nulls_last(t):
    rows = t.documents.join(t.labels, "doc_id", "left").select("doc_id", "toxic")
    return Dataset(rows).order(("toxic", "desc", "last"), "doc_id").limit(20).df


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on(t):
    return paging.first_per_key(t.orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) x WHERE n BETWEEN 2 AND 4""")
def top_per_group_with_offset(t):
    return paging.top_per_group(t.orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3, 1).select("o_custkey", "o_orderkey")


@query("SELECT p_brand, p_partkey FROM (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS n FROM part) x WHERE n <= 2")
def top_per_group_with_ties(t):
    return paging.top_per_group(t.part, ["p_brand"], [F.desc("p_size")], 2, ties=True).select("p_brand", "p_partkey")


@query("SELECT p_partkey, p_size FROM part WHERE p_size >= (SELECT min(p_size) FROM (SELECT p_size FROM part ORDER BY p_size DESC LIMIT 10) x)")
def limit_with_ties(t):
    return paging.with_ties(t.part, ["p_size"], 10, ascending=False).select("p_partkey", "p_size")


@query("SELECT event_id FROM events WHERE user_id > 10 OR (user_id = 10 AND event_id > 500) ORDER BY user_id, event_id LIMIT 50")
def keyset_page(t):
    events = Dataset(t.events).order("user_id", "event_id")
    return events.where(paging.after(events.order_keys, [10, 500])).limit(50).select("event_id").df


@query("SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 40")
def paginate(t):
    return paging.paginate(t.customer.orderBy("c_custkey").select("c_custkey"), 3, 20).df


@query("SELECT * FROM (SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10) x WHERE c_custkey % 2 = 0")
def filter_after_limit(t):
    return Dataset(t.customer).select("c_custkey", "c_acctbal").order(("c_acctbal", "desc"), "c_custkey").limit(10).from_self().where(F.col("c_custkey") % 2 == 0).df


def _quality(t):
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", F.when(F.col("quality") == 1, F.col("toxic")).alias("mark"))


@query("SELECT d.doc_id, CASE WHEN quality = 1 THEN toxic END AS mark FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def paged_nulls(t):
    """Pages after the last key reach every row, also those whose key is null."""
    found = list(Dataset(_quality(t)).order(("mark", "desc", "last"), "doc_id").paged_each(max(1, t.documents.count() // 4)))
    return t.spark.createDataFrame([tuple(r) for r in found], "doc_id long, mark int")


@query("""SELECT doc_id FROM (SELECT d.doc_id, CASE WHEN quality = 1 THEN toxic END AS mark FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
WHERE mark IS NULL AND doc_id > 20""")
def keyset_after_null(t):
    """The rows behind (null, 20) where nulls come last."""
    return _quality(t).where(paging.after([("mark", "desc", "last"), ("doc_id", "asc", None)], [None, 20])).select("doc_id")
