"""Window functions and frames."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import frames
from .registry import query


def by_user():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


@query("""SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n,
round(percent_rank() OVER w, 9) AS p, round(cume_dist() OVER w, 9) AS c, ntile(3) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS t
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderstatus)""")
def rank_family(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderstatus")
    unique = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.orders.select(
        "o_orderkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d"), F.row_number().over(unique).alias("n"),
        F.round(F.percent_rank().over(w), 9).alias("p"), F.round(F.cume_dist().over(w), 9).alias("c"), F.ntile(3).over(unique).alias("t"))


@query("""SELECT event_id, lag(value) OVER w AS before, lead(value, 2, -1.0) OVER w AS later, first_value(event_type) OVER w AS first,
last_value(event_type) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last, nth_value(event_id, 2) OVER w AS second
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def lag_lead_first_last(t):
    everything = by_user().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return t.events.select(
        "event_id", F.lag("value").over(by_user()).alias("before"), F.lead("value", 2, -1.0).over(by_user()).alias("later"), F.first("event_type").over(by_user()).alias("first"),
        F.last("event_type").over(everything).alias("last"), F.nth_value("event_id", 2).over(by_user()).alias("second"))


@query("""SELECT event_id, sum(event_id) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near, count(*) OVER (w RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
max(event_id) OVER (PARTITION BY user_id) AS biggest FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def row_frames(t):
    return t.events.select(
        "event_id", F.sum("event_id").over(by_user().rowsBetween(-2, 1)).alias("near"), F.count(F.lit(1)).over(by_user()).alias("upto"),
        F.max("event_id").over(Window.partitionBy("user_id")).alias("biggest"))


@query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING) AS n FROM orders")
def range_frame(t):
    orders = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    return frames.range_count(orders, ["o_orderstatus"], "o_totalprice", -500, 500, "n").select("o_orderkey", "n")


@query("SELECT p_partkey, sum(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s FROM part")
def groups_frame(t):
    return frames.groups_frame(t.part, ["p_brand"], "p_size", -1, 0, s=(F.sum, "p_partkey")).select("p_partkey", "s")


@query("SELECT p_partkey, sum(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE CURRENT ROW) AS s FROM part")
def frame_excluding_current(t):
    return frames.sum_excluding(t.part, ["p_brand"], ["p_size", "p_partkey"], "p_partkey", "current", "s").select("p_partkey", "s")


@query("SELECT p_partkey, sum(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP) AS s FROM part")
def frame_excluding_group(t):
    return frames.sum_excluding(t.part, ["p_brand"], ["p_size"], "p_partkey", "group", "s").select("p_partkey", "s")


@query("SELECT p_partkey, sum(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE TIES) AS s FROM part")
def frame_excluding_ties(t):
    return frames.sum_excluding(t.part, ["p_brand"], ["p_size"], "p_partkey", "ties", "s").select("p_partkey", "s")


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM events""")
def ignore_nulls(t):
    bought = F.when(F.col("event_type") == "purchase", F.col("value"))
    return t.events.select("event_id", F.last(bought, ignorenulls=True).over(by_user().rowsBetween(Window.unboundedPreceding, 0)).alias("last_purchase"))


@query("SELECT c_custkey, c_nationkey, c_mktsegment, (SELECT count(DISTINCT b.c_mktsegment) FROM customer b WHERE b.c_nationkey = a.c_nationkey) AS kinds FROM customer a")
def count_distinct_over(t):
    return frames.count_distinct_over(t.customer.select("c_custkey", "c_nationkey", "c_mktsegment"), ["c_nationkey"], "c_mktsegment", "kinds")


@query("SELECT conv_id, turn, length(text) - lag(length(text)) OVER (PARTITION BY conv_id, role ORDER BY turn) AS change FROM conversations")
def change_between_turns(t):
    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    return t.conversations.select("conv_id", "turn", (F.length("text") - F.lag(F.length("text")).over(w)).alias("change"))
