"""Recursive queries over conversations and generated trees."""

from pyspark.sql import functions as F

from ..operators import recursion as r
from .registry import query

TREE = "SELECT n_nationkey AS id, CASE WHEN n_nationkey > 0 THEN (n_nationkey - 1) // 3 END AS parent_id FROM nation"


def tree(t):
    return t.nation.select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") > 0, F.expr("(n_nationkey - 1) div 3").cast("int")).alias("parent_id"))


@query(f"""WITH RECURSIVE t AS ({TREE}), w(root, node, level) AS (SELECT id, id, 0 FROM t WHERE id IN (1, 2)
UNION ALL SELECT root, id, level + 1 FROM w JOIN t ON parent_id = node) SELECT * FROM w WHERE level > 0""")
def tree_descendants(t):
    return r.descendants(tree(t), F.col("id").isin(1, 2))


@query(f"""WITH RECURSIVE t AS ({TREE}), w(root, node, level) AS (SELECT id, id, 0 FROM t WHERE id = 0
UNION ALL SELECT root, id, level + 1 FROM w JOIN t ON parent_id = node WHERE level < 2) SELECT * FROM w WHERE level > 0""")
def tree_descendants_limited(t):
    return r.descendants(tree(t), F.col("id") == 0, most_levels=2)


@query(f"""WITH RECURSIVE t AS ({TREE}), w(start, node, level) AS (SELECT id, id, 0 FROM t WHERE id >= 20
UNION ALL SELECT start, parent_id, level + 1 FROM w JOIN t ON id = node WHERE parent_id IS NOT NULL) SELECT * FROM w WHERE level > 0""")
def tree_ancestors(t):
    return r.ancestors(tree(t), F.col("id") >= 20)


EDGES = "SELECT DISTINCT n_nationkey AS a, (n_nationkey * 2 + 1) % 25 AS b FROM nation"


def edges(t):
    return t.nation.select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") * 2 + 1) % 25).alias("b"))


@query(f"WITH RECURSIVE e AS ({EDGES}), w(node) AS (SELECT 3 UNION SELECT b FROM w JOIN e ON a = node) SELECT node FROM w")
def reachable_nodes(t):
    start = t.spark.createDataFrame([(3,)], "node int")
    return r.recursive(start, lambda rows: rows.join(edges(t), F.col("node") == F.col("a")).select(F.col("b").alias("node")), distinct=True)


@query(f"""WITH RECURSIVE e AS ({EDGES}), w(node, path, is_cycle) AS (SELECT 3, [3], false UNION ALL
SELECT b, list_append(path, b), list_contains(path, b) FROM w JOIN e ON a = node WHERE NOT is_cycle)
SELECT node, len(path) AS steps, is_cycle FROM w""")
def walk_until_cycle(t):
    out = r.walk(edges(t), t.spark.createDataFrame([(3,)], "node int"), "a", "b")
    return out.select("node", F.size("path").cast("long").alias("steps"), "is_cycle")


@query(f"SELECT a.id, b.id AS sibling FROM ({TREE}) a JOIN ({TREE}) b ON a.parent_id = b.parent_id AND a.id <> b.id")
def tree_siblings(t):
    other = tree(t).select(F.col("id").alias("sibling"), F.col("parent_id").alias("p"))
    return tree(t).join(other, (F.col("parent_id") == F.col("p")) & (F.col("id") != F.col("sibling"))).select("id", "sibling")


@query(f"""WITH RECURSIVE t AS ({TREE}), w(id, sort_path) AS (SELECT id, lpad(id::VARCHAR, 3, '0') FROM t WHERE parent_id IS NULL
UNION ALL SELECT t.id, sort_path || '/' || lpad(t.id::VARCHAR, 3, '0') FROM w JOIN t ON parent_id = w.id) SELECT id, sort_path FROM w""")
def tree_depth_first(t):
    pad = lambda c: F.lpad(F.col(c).cast("string"), 3, "0")
    below = tree(t).select(F.col("id").alias("child"), F.col("parent_id").alias("p"))
    base = tree(t).where("parent_id IS NULL").select("id", pad("id").alias("sort_path"))
    return r.recursive(base, lambda w: w.join(below, F.col("id") == F.col("p")).select(F.col("child").alias("id"), F.concat_ws("/", "sort_path", pad("child")).alias("sort_path")))
