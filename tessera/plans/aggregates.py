"""Aggregates and grouping."""

from pyspark.sql import functions as F

from ..operators.dataset import Dataset
from ..operators.frames import string_agg
from .registry import query


def rows():
    return F.count(F.lit(1))


@query("SELECT c_mktsegment, count(*) AS count FROM customer GROUP BY c_mktsegment")
def group_and_count(t):
    return Dataset(t.customer).group_and_count("c_mktsegment").df


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def group_rollup(t):
    return Dataset(t.orders).group("o_orderstatus", "o_orderpriority").group_rollup().agg(rows().alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).df


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, grouping_id(l_returnflag, l_linestatus) AS g FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def group_cube(t):
    return Dataset(t.lineitem).group("l_returnflag", "l_linestatus").group_cube().agg(rows().alias("n"), F.grouping_id().alias("g")).df


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def grouping_sets(t):
    return Dataset(t.orders).group("o_orderstatus", "o_orderpriority").grouping_sets(("o_orderstatus",), ("o_orderpriority",), ()).agg(rows().alias("n")).df


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10 AND NOT (count(*) = 15)")
def having_and_exclude_having(t):
    return Dataset(t.orders).group("o_custkey").agg(rows().alias("n")).having(F.col("n") > 10).having(~(F.col("n") == 15)).df


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING NOT (count(*) > 10)")
def invert_having(t):
    return Dataset(t.orders).group("o_custkey").agg(rows().alias("n")).having(F.col("n") > 10).invert().df


@query("SELECT count(DISTINCT c_nationkey) AS nations, count(DISTINCT (c_nationkey, c_mktsegment)) AS pairs, count(*) AS n FROM customer")
def count_distinct(t):
    return t.customer.agg(F.countDistinct("c_nationkey").alias("nations"), F.countDistinct("c_nationkey", "c_mktsegment").alias("pairs"), rows().alias("n"))


@query("""SELECT event_type, count(*) FILTER (WHERE value > 50) AS high, round(sum(value) FILTER (WHERE value <= 50), 2) AS low
FROM events GROUP BY event_type""")
def filtered_aggregates(t):
    return t.events.groupBy("event_type").agg(
        F.count_if(F.col("value") > 50).alias("high"), F.round(F.sum(F.when(F.col("value") <= 50, F.col("value"))), 2).alias("low"))


@query("SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")
def string_agg_ordered(t):
    return string_agg(t.nation, ["n_regionkey"], "n_name", "names", [F.desc("n_name")], "; ")


@query("SELECT o_orderpriority, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS kinds FROM orders GROUP BY o_orderpriority")
def string_agg_distinct(t):
    return string_agg(t.orders, ["o_orderpriority"], "o_orderstatus", "kinds", distinct=True)


@query("""SELECT o_orderpriority, round(stddev_samp(o_totalprice), 2) AS sd, round(var_pop(o_totalprice) / 1000, 2) AS var,
round(corr(o_totalprice, o_custkey), 6) AS corr, bit_xor(o_orderkey) AS bits, bool_and(o_totalprice > 0) AS positive FROM orders GROUP BY o_orderpriority""")
def named_aggregates(t):
    return t.orders.groupBy("o_orderpriority").agg(
        F.round(F.stddev_samp("o_totalprice"), 2).alias("sd"), F.round(F.var_pop("o_totalprice") / 1000, 2).alias("var"),
        F.round(F.corr("o_totalprice", "o_custkey"), 6).alias("corr"), F.bit_xor("o_orderkey").alias("bits"), F.bool_and(F.col("o_totalprice") > 0).alias("positive"))


@query("""SELECT p_brand, percentile_cont(0.5) WITHIN GROUP (ORDER BY p_size) AS mid, percentile_disc(0.9) WITHIN GROUP (ORDER BY p_size) AS high,
mode() WITHIN GROUP (ORDER BY p_size % 2) AS parity FROM part GROUP BY p_brand HAVING count(*) FILTER (WHERE p_size % 2 = 0) <> count(*) FILTER (WHERE p_size % 2 = 1)""")
def ordered_set_aggregates(t):
    even, odd = F.count_if(F.col("p_size") % 2 == 0), F.count_if(F.col("p_size") % 2 == 1)
    out = t.part.groupBy("p_brand").agg(
        F.percentile("p_size", 0.5).alias("mid"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY p_size)").cast("int").alias("high"),
        F.mode(F.col("p_size") % 2).alias("parity"), even.alias("a"), odd.alias("b"))
    return out.where("a <> b").drop("a", "b")


@query("SELECT sum(n_nationkey) AS s, avg(n_nationkey) AS a, min(n_name) AS lo, max(n_name) AS hi, count(n_nationkey) AS n FROM nation WHERE n_nationkey > 1000")
def aggregates_of_nothing(t):
    return t.nation.where("n_nationkey > 1000").agg(
        F.sum("n_nationkey").alias("s"), F.avg("n_nationkey").alias("a"), F.min("n_name").alias("lo"), F.max("n_name").alias("hi"), F.count("n_nationkey").alias("n"))


@query("SELECT count(*) AS n, sum(o_orderkey) AS s FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 50) t1")
def aggregate_of_limited(t):
    return Dataset(t.orders).order("o_orderkey").limit(100, 50).from_self("t1").agg(rows().alias("n"), F.sum("o_orderkey").alias("s")).df


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def pricing_summary(t):
    return t.lineitem.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz")).groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), rows().alias("n"))


@query("SELECT EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 1e9) AS found")
def emptiness_probe(t):
    return t.spark.createDataFrame([(not Dataset(t.orders).where(F.col("o_totalprice") > 1e9).empty(),)], "found boolean")


@query("SELECT avg(o_totalprice) AS mean, min(o_totalprice) AS low, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 5)")
def avg_of_limited(t):
    """Aggregates of a limited query are taken over the rows that its order and limit choose."""
    top = Dataset(t.orders).order(("o_totalprice", "desc"), "o_orderkey").limit(50, 5)
    return t.spark.createDataFrame([(top.avg("o_totalprice"), top.min("o_totalprice"), top.sum("o_orderkey"))], "mean double, low double, keys long")


@query("SELECT l_returnflag, l_linestatus FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_keys_only(t):
    return Dataset(t.lineitem).group("l_returnflag", "l_linestatus").group_rollup().df


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment HAVING NOT coalesce(count(*) > (SELECT count(*) / 5 FROM customer), false)")
def exclude_or_null_having(t):
    fifth = Dataset(t.customer).count() // 5
    return Dataset(t.customer).group("c_mktsegment").agg(rows().alias("n")).exclude_or_null_having(F.col("n") > fifth).df
