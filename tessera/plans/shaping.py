"""Clauses edited and taken back, constraints, functions of one's own, maps, arrays and JSON in other forms."""

import operator

import numpy as np
from pyspark.sql import functions as F

from ..functions import collections as c
from ..functions import custom, ranges
from ..operators import associations, constraints, modify, paging, recursion
from ..operators import filters as f
from ..operators.dataset import Dataset, where_all
from .complex_types import NESTED, nested
from .recursion import TREE, tree
from .registry import query


@query("SELECT c_custkey, c_name, c_acctbal * 2 AS twice FROM customer")
def projection_edited(t):
    return Dataset(t.customer).where(c_custkey=1).select("c_name").select_prepend("c_custkey").select_append((F.col("c_acctbal") * 2).alias("twice")).unfiltered().df


@query("SELECT c_custkey, c_nationkey, c_mktsegment FROM customer ORDER BY c_nationkey DESC, c_mktsegment, c_custkey LIMIT 40")
def order_edited(t):
    return Dataset(t.customer).order("c_mktsegment").order_prepend(("c_nationkey", "desc")).order_append("c_custkey").limit(40).select("c_custkey", "c_nationkey", "c_mktsegment").df


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def clauses_taken_back(t):
    rows = Dataset(t.orders).where(o_orderstatus="F").order("o_orderkey").limit(3, 2).group("o_custkey").agg(F.count("*"))
    return rows.ungrouped().unlimited().unordered().select("o_orderkey", "o_orderstatus").df


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def group_appended(t):
    return Dataset(t.orders).group("o_orderstatus").group_append("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).df


@query("SELECT n.*, r_name FROM nation n JOIN region r ON n_regionkey = r_regionkey")
def select_all_of_tables(t):
    both = Dataset(t.nation.alias("n")).join(t.region.alias("r"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select_all("n").select_append("r_name").df


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0 AND c_nationkey IN (1, 2, 3, 4, 5)")
def where_all_conditions(t):
    return where_all(t.customer, {"c_mktsegment": "BUILDING"}, F.col("c_acctbal") > 0, {"c_nationkey": [1, 2, 3, 4, 5]}).select("c_custkey")


def rich(rows, least):
    return rows.where(F.col("c_acctbal") >= least)


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal >= 5000")
def subset_by_name(t):
    return Dataset(t.customer).where(c_mktsegment="MACHINERY").pipe(rich, 5000).select("c_custkey").df


@query("""SELECT o_orderkey, (CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderstatus END) != (CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderstatus END) AS held FROM orders""")
def in_empty_list_null_aware(t):
    return t.orders.select("o_orderkey", f.is_in_null_aware(F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")), []).alias("held"))


@query("""SELECT p_partkey, p_size > 10 AND p_size > p_partkey % 40 AS above_all, p_size = 10 OR p_size = p_partkey % 40 AS equals_any FROM part""")
def array_compared(t):
    values = F.array(F.lit(10), (F.col("p_partkey") % 40).cast("int"))
    return t.part.select("p_partkey", c.compares_all(F.col("p_size"), operator.gt, values).alias("above_all"), c.compares_any(F.col("p_size"), operator.eq, values).alias("equals_any"))


@query("SELECT p_partkey, '[' || len(string_split(p_name, ' ')) || '][2]' AS dims, 2 AS inner_length, len(string_split(p_name, ' ')) AS outer_length FROM part")
def array_dimensions(t):
    words = F.transform(F.split("p_name", " "), lambda w: F.array(w, F.upper(w)))
    return t.part.select("p_partkey", c.dimensions(words, 2).alias("dims"), c.length(words, 2).alias("inner_length"), c.length(words).cast("long").alias("outer_length"))


@query("""SELECT p_partkey, p_size = 7 AS held, p_size % 2 = 0 AS known, p_brand || ',' || p_size AS vals, 'brand,size' AS keys, p_size AS size, NULL::INTEGER AS brand, NULL::DOUBLE AS weight FROM part""")
def map_to_record(t):
    m = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"))
    half = F.create_map(F.lit("h"), F.when(F.col("p_size") % 2 == 0, "x"))
    seven = F.create_map(F.lit("size"), F.lit("7"))
    rows = t.part.select("p_partkey", c.map_contains(m, seven).alias("held"), c.defined(half, "h").alias("known"), m.alias("m"), c.record(m, size="int", brand="int", weight="double").alias("r"))
    return rows.select("p_partkey", "held", "known", F.array_join(F.map_values("m"), ",").alias("vals"), F.array_join(F.map_keys("m"), ",").alias("keys"), "r.*")


@query("SELECT event_id, true AS every, true AS some, false AS none, user_id % 2 = 0 AS within, NOT json_valid(event_type) AS broken FROM events")
def json_has_keys(t):
    within = c.json_contained_by(F.concat(F.lit('{"n":'), (F.col("user_id") - F.col("user_id") % 2).cast("string"), F.lit("}")), "j")
    return nested(t).select(
        "event_id", c.json_has_all("j", "a", "n").alias("every"), c.json_has_any("j", "q", "s").alias("some"), c.json_has_any("j", "q", "b").alias("none"),
        within.alias("within"), (~c.is_json("event_type")).alias("broken"))


@query(f"""SELECT event_id, CAST(json_extract(k, '$.a.b') AS BIGINT) AS b, array_to_string(list_sort(json_keys(k, '$.a')), ',') AS of_a, array_to_string(list_sort(json_keys(k)), ',') AS keys,
CAST(json_extract(k, '$.s.t') AS INTEGER) AS t FROM (SELECT event_id, json_merge_patch(j, '{{"a":{{"c":null,"d":[1]}},"n":null,"s":{{"t":1}},"q":2}}') AS k FROM ({NESTED}))""")
def json_merge_patch(t):
    out = nested(t).select("event_id", c.json_patch("j", {"a": {"c": None, "d": [1]}, "n": None, "s": {"t": 1}, "q": 2}).alias("k"))
    keys = lambda j: F.array_join(F.sort_array(c.json_keys(j)), ",")
    return out.select("event_id", c.json_text("k", "a", "b").cast("long").alias("b"), keys(c.json_text("k", "a")).alias("of_a"), keys("k").alias("keys"), c.json_text("k", "s", "t").cast("int").alias("t"))


@query(f"""SELECT event_id, fullkey AS path, CASE type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'NULL' THEN 'null' ELSE 'number' END AS type
FROM ({NESTED}) e, json_tree(e.j)""")
def json_tree_of_values(t):
    return recursion.json_tree(nested(t), "j", ["event_id"]).select("event_id", "path", "type")


@query("SELECT l_orderkey, l_linenumber, l_quantity >= 10 AND l_quantity + 5 <= 40 AS within, l_quantity >= 40 AS beyond FROM lineitem")
def range_contained_and_right_of(t):
    own, fixed = ranges.make(F.col("l_quantity"), F.col("l_quantity") + 5), ranges.make(10.0, 40.0)
    rows = t.lineitem.select("l_orderkey", "l_linenumber", own.alias("a"), fixed.alias("b"))
    return rows.select("l_orderkey", "l_linenumber", ranges.contains("b", "a").alias("within"), ranges.right_of("a", "b").alias("beyond"))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE NOT (c_acctbal > 0)")
def check_violations(t):
    return constraints.check_violations(t.customer, F.col("c_acctbal") > 0).select("c_custkey", "c_acctbal")


@query("SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def unique_violations(t):
    return constraints.unique_violations(t.orders, "o_custkey", "o_orderpriority")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey + 20 NOT IN (SELECT n_nationkey FROM nation)")
def missing_references(t):
    far = t.customer.withColumn("far", F.col("c_nationkey") + 20)
    return constraints.missing_references(far, t.nation, {"far": "n_nationkey"}).select("c_custkey", "c_nationkey")


@query("""SELECT o_orderkey FROM orders a WHERE EXISTS (SELECT 1 FROM orders b WHERE a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey
AND a.o_orderdate < b.o_orderdate + INTERVAL 30 DAY AND b.o_orderdate < a.o_orderdate + INTERVAL 30 DAY)""")
def overlap_violations(t):
    spans = t.orders.withColumn("till", F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS"))
    return constraints.overlap_violations(spans, ["o_custkey"], "o_orderdate", "till").select("o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P'")
def delete_returning(t):
    return modify.deleted_rows(t.orders, {"o_orderstatus": "P"}).select("o_orderkey", "o_totalprice")


@query("""WITH busy AS (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 12) SELECT c_custkey, c_mktsegment FROM customer
UNION ALL SELECT -o_custkey, NULL FROM busy""")
def insert_from_cte(t):
    busy = Dataset(t.orders).group("o_custkey").agg(F.count(F.lit(1)).alias("n")).having(F.col("n") > 12).select((-F.col("o_custkey")).alias("c_custkey"))
    return modify.insert(t.customer.select("c_custkey", "c_mktsegment"), Dataset(t.orders).with_("busy", busy).from_("busy").df)


@query("SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS found_rows FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 10")
def found_rows(t):
    rows = Dataset(t.orders).where(o_orderstatus="O").order("o_orderkey").select("o_orderkey")
    return paging.with_found_rows(rows.limit(10).df, rows.unordered().df)


@query("SELECT l_returnflag, l_linestatus, round(exp(avg(ln(l_extendedprice))), 4) AS mean, count(*) AS n FROM lineitem GROUP BY ALL")
def own_aggregate(t):
    state = lambda rows: {"logs": float(np.log(rows["l_extendedprice"]).sum()), "held": len(rows)}
    mean = F.round(F.exp(F.sum("logs") / F.sum("held")), 4).alias("mean")
    rows = t.lineitem.select("l_returnflag", "l_linestatus", "l_extendedprice")
    return custom.aggregate(rows, ["l_returnflag", "l_linestatus"], state, "logs double, held long", mean, F.sum("held").alias("n"))


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, unnest(generate_series(1, len(string_split(p_name, ' ')))) AS place FROM part")
def own_table_function(t):
    class Words:
        def eval(self, text):
            yield from ((i, w) for i, w in enumerate(text.split(" "), 1))

    return custom.generate(t.part.select("p_partkey", "p_name"), Words, "place long, word string", "p_name").drop("p_name")


@query(f"""WITH RECURSIVE t AS ({TREE}), w(root, node, level) AS (SELECT id, id, 0 FROM t WHERE id IN (1, 2, 24)
UNION ALL SELECT root, id, level + 1 FROM w JOIN t ON parent_id = node)
SELECT root AS id, coalesce(string_agg(level || ':' || node, ',' ORDER BY level, node) FILTER (level > 0), '') AS below FROM w GROUP BY root""")
def tree_eager(t):
    out = recursion.with_descendants(tree(t), F.col("id").isin(1, 2, 24), "below")
    return out.select("id", F.array_join(F.transform("below", lambda x: F.concat_ws(":", x.level.cast("string"), x.row.id.cast("string"))), ",").alias("below"))


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def association_left_join(t):
    own = associations.Association("orders", t.orders.select("o_custkey", "o_orderkey"), {"c_custkey": "o_custkey"})
    return associations.association_join(t.customer, own, "left").select("c_custkey", F.col("orders.o_orderkey").alias("o_orderkey"))


@query("""SELECT p_partkey, len(regexp_extract_all(p_name || ' Bolt bolts', '(?i)\\b(small|bolt)\\b')) AS rank FROM part""")
def words_ranked(t):
    return t.part.select("p_partkey", f.words_rank(F.concat("p_name", F.lit(" Bolt bolts")), ["small", "bolt"]).cast("long").alias("rank"))


@query("SELECT o_orderstatus, true AS close FROM orders GROUP BY o_orderstatus")
def approximate_distinct_count(t):
    exact, rough = F.count_distinct("o_custkey"), F.approx_count_distinct("o_custkey", 0.02)
    return t.orders.groupBy("o_orderstatus").agg((F.abs(rough - exact) <= exact * 0.1).alias("close"))
