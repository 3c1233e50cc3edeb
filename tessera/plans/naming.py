"""Queries and windows by name, recursion over whole tables, prepared queries, networks, multiranges."""

from pyspark.sql import functions as F

from ..functions import collections as c
from ..functions import inet, ranges
from ..operators import associations as a
from ..operators import frames, joins
from ..operators.dataset import Dataset
from ..sources.prepared import Prepared
from .registry import query


@query("""WITH big AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12), rich AS (SELECT c_custkey AS k, c_name FROM customer WHERE c_acctbal > 0)
SELECT k, c_name, n FROM big JOIN rich USING (k)""")
def named_ctes(t):
    big = Dataset(t.orders).group(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n")).having(F.col("n") > 12)
    rich = Dataset(t.customer).where(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("k"), "c_name")
    return Dataset(t.customer).with_("big", big).with_("rich", rich).from_("big").join("rich", ["k"]).select("k", "c_name", "n").df


@query("""WITH RECURSIVE t AS (SELECT c_custkey + 1 AS id, (c_custkey + 1) // 3 AS parent_id FROM customer), w(id, level) AS (SELECT id, 0 FROM t WHERE parent_id = 0
UNION ALL SELECT t.id, level + 1 FROM w JOIN t ON parent_id = w.id) SELECT level, count(*) AS n, sum(id) AS ids FROM w GROUP BY level""")
def recursive_cte_whole(t):
    tree = t.customer.select((F.col("c_custkey") + 1).alias("child"), F.expr("(c_custkey + 1) div 3").alias("parent_id"))
    base = tree.where("parent_id = 0").select(F.col("child").alias("id"), F.lit(0).alias("level"))
    step = lambda w: w.join(tree, F.col("parent_id") == F.col("id")).select(F.col("child").alias("id"), (F.col("level") + 1).alias("level"))
    levels = Dataset(t.customer).with_recursive("w", base, step).from_("w")
    return levels.group("level").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids")).df


@query("""SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS of_user,
sum(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM events""")
def named_and_inherited_windows(t):
    named = Dataset(t.events).window("p", ["user_id"]).window("o", order=["ts", "event_id"], base="p").window("f", rows=(-1, 1), base="o")
    return named.select("event_id").over("o", n=F.row_number()).over("p", of_user=F.count(F.lit(1))).over("f", near=F.sum("event_id")).df


FRAME = "OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 2 PRECEDING AND 1 FOLLOWING EXCLUDE {})"


@query(f"""SELECT p_partkey, min(p_partkey) {FRAME.format('GROUP')} AS low, max(p_partkey) {FRAME.format('CURRENT ROW')} AS high, round(avg(p_partkey) {FRAME.format('TIES')}, 6) AS mean,
count(p_partkey) {FRAME.format('GROUP')} AS n FROM part""")
def aggregates_excluding(t):
    out = frames.aggregate_excluding(t.part, ["p_brand"], "p_size", "p_partkey", "group", -2, 1, low="min", n="count")
    out = frames.aggregate_excluding(out, ["p_brand"], "p_size", "p_partkey", "current", -2, 1, high="max")
    out = frames.aggregate_excluding(out, ["p_brand"], "p_size", "p_partkey", "ties", -2, 1, mean="avg")
    return out.select("p_partkey", "low", "high", F.round("mean", 6).alias("mean"), "n")


@query("""SELECT c_custkey, (SELECT string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey DESC) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS done,
(SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer""")
def eager_with_conditions(t):
    every = a.Association("orders", t.orders.select("o_custkey", "o_orderkey", "o_orderstatus"), {"c_custkey": "o_custkey"})
    done = every.refined(lambda o: o.where("o_orderstatus = 'F'"), name="done", order=[F.desc("o_orderkey")])
    keys = F.array_join(F.transform("done", lambda o: o.o_orderkey.cast("string")), ",")
    return a.eager(t.customer, every, done).select("c_custkey", F.when(F.size("done") > 0, keys).alias("done"), F.size("orders").cast("long").alias("n"))


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 1000")
def prepared_and_called(t):
    sql = "SELECT c_custkey, n_name FROM {c} JOIN {n} ON n_nationkey = c_nationkey WHERE c_mktsegment = :segment AND c_acctbal > :least"
    return Prepared(t.spark, sql, (("c", t.customer), ("n", t.nation))).bind(segment="MACHINERY", least=1000).call(segment="BUILDING")


@query("""SELECT a.p_partkey AS i, b.s_suppkey AS j, greatest(a.p_partkey, b.s_suppkey * 3) AS lo, least(a.p_partkey + 2, b.s_suppkey * 3 + b.s_nationkey) AS hi FROM part a JOIN supplier b
ON b.s_nationkey > 0 AND a.p_partkey < b.s_suppkey * 3 + b.s_nationkey AND b.s_suppkey * 3 < a.p_partkey + 2""")
def range_overlap_join(t):
    part = t.part.select(F.col("p_partkey").alias("i"), ranges.make(F.col("p_partkey"), F.col("p_partkey") + 2).alias("a"))
    three = F.col("s_suppkey") * 3
    supplier = t.supplier.select(F.col("s_suppkey").alias("j"), ranges.make(three, three + F.col("s_nationkey")).alias("b"))
    both = joins.overlap_join(part, supplier, "a", "b", 16).select("i", "j", ranges.intersection("a", "b").alias("r"))
    return both.select("i", "j", F.col("r.lower").alias("lo"), F.col("r.upper").alias("hi"))


@query("""SELECT n_nationkey AS k, CASE WHEN n_regionkey <= 2 THEN 0 END AS both_lo, CASE WHEN n_regionkey <= 2 THEN n_regionkey + 3 END AS both_hi,
CASE WHEN n_regionkey = 0 THEN '' WHEN n_regionkey < 2 THEN '0-' || n_regionkey ELSE '0-2' END AS cut,
CASE WHEN n_regionkey <= 2 THEN '0-' || n_regionkey + 3 ELSE '0-2,' || n_regionkey || '-' || n_regionkey + 3 END AS joined, n_regionkey <= 2 AS has_two FROM nation""")
def range_sets(t):
    r = F.col("n_regionkey")
    x, y = ranges.make(F.lit(0), F.lit(2)), ranges.make(r, r + 3)
    show = lambda rs: F.array_join(F.transform(rs, lambda p: F.concat_ws("-", p.lower.cast("string"), p.upper.cast("string"))), ",")
    many = ranges.multirange(F.array(y, x, ranges.make(r, r)))
    return t.nation.select(
        F.col("n_nationkey").alias("k"), ranges.union(x, y).lower.alias("both_lo"), ranges.union(x, y).upper.alias("both_hi"), show(ranges.difference(x, y)).alias("cut"),
        show(many).alias("joined"), ranges.multirange_contains(many, 2).alias("has_two"))


@query("""SELECT s_suppkey, 6 AS family, s_nationkey < 16 AS inside, false AS other, 'fe' || lower(printf('%02x', s_nationkey)) AS tail, '10.0.' || (s_suppkey + 300) // 256 || '.' || (s_suppkey + 300) % 256 AS further,
s_suppkey AS apart, '10.0.0.0' AS masked FROM supplier WHERE s_suppkey < 60000""")
def inet_families(t):
    six = F.concat(F.lit("2001:db8::fe"), F.lpad(F.lower(F.hex("s_nationkey")), 2, "0"))
    four = F.concat(F.lit("10.0."), F.expr("cast(s_suppkey div 256 as string)"), F.lit("."), (F.col("s_suppkey") % 256).cast("string"))
    return t.supplier.where("s_suppkey < 60000").select(
        "s_suppkey", inet.family(six).alias("family"), inet.contained_by(six, F.lit("2001:0DB8:0::fe00/124")).alias("inside"), inet.contained_by(four, F.lit("::/0")).alias("other"),
        F.lower(F.hex(F.conv(F.right(inet.bits(six), F.lit(16)), 2, 10).cast("long"))).alias("tail"), inet.added(four, 300).alias("further"),
        inet.distance(four, F.lit("10.0.0.0")).alias("apart"), inet.both_bits(four, F.lit("255.255.0.0")).alias("masked"))


@query("SELECT event_id, user_id AS id, event_type AS kind, true AS there, false AS none FROM events UNION ALL SELECT event_id, NULL, 'x', true, false FROM events")
def json_table_of_elements(t):
    text = F.concat(F.lit('{"a":[{"id":'), F.col("user_id").cast("string"), F.lit(',"kind":"'), F.col("event_type"), F.lit('"},{"id":"?","kind":"x"}]}'))
    rows = t.events.select("event_id", text.alias("j"))
    flags = {"there": c.json_path_exists("j", "$.a[*].id"), "none": c.json_path_exists("j", "$.a[*].more")}
    return c.json_table(rows.withColumns(flags), "j", "$.a", id="long", kind="string").drop("j")
