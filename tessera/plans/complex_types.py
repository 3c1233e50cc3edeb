"""Arrays, maps, JSON, ranges and networks."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import collections as c
from ..functions import inet, ranges
from .registry import query

LISTS = "SELECT n_nationkey AS k, [n_regionkey, n_nationkey % 4, n_nationkey % 3, n_regionkey] AS a FROM nation"


def lists(t):
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    return t.nation.select(k.alias("k"), F.array(r, k % 4, k % 3, r).alias("a"))


@query(f"""SELECT k, a[2] AS second, a[9] IS NULL AS none, array_to_string(a[2:3], ',') AS part, len(a) AS n, list_contains(a, 2) AS has, list_has_all(a, [1, 2]) AS all_,
list_has_any(a, [3, 4]) AS any_, a[1] = ANY (a[2:4]) AS eq FROM ({LISTS})""")
def array_access(t):
    text = lambda x: F.array_join(x, ",")
    return lists(t).select(
        "k", c.element("a", 2).alias("second"), c.element("a", 9).isNull().alias("none"), text(c.piece("a", 2, 3)).alias("part"), F.cardinality("a").cast("long").alias("n"),
        F.array_contains("a", F.lit(2)).alias("has"), c.contains("a", F.array(F.lit(1), F.lit(2))).alias("all_"), F.arrays_overlap("a", F.array(F.lit(3), F.lit(4))).alias("any_"),
        F.array_contains(F.slice("a", 2, 3), F.get("a", F.lit(0))).alias("eq"))


@query(f"""SELECT k, array_to_string(list_append(a, 9), ',') AS push, array_to_string(list_prepend(9, a), ',') AS unshift, array_to_string(list_filter(a, lambda x: x <> 1), ',') AS removed,
array_to_string(list_transform(a, lambda x: CASE WHEN x = 1 THEN 7 ELSE x END), ',') AS replaced, array_to_string(list_reverse(a), ',') AS reversed,
array_to_string(list_reverse_sort(a), ',') AS sorted FROM ({LISTS})""")
def array_changes(t):
    text = lambda x, name: F.array_join(x, ",").alias(name)
    return lists(t).select(
        "k", text(F.array_append("a", F.lit(9)), "push"), text(F.array_prepend("a", F.lit(9)), "unshift"), text(F.array_remove("a", 1), "removed"),
        text(c.replaced("a", 1, 7), "replaced"), text(F.reverse("a"), "reversed"), text(c.sorted_by("a", descending=True), "sorted"))


@query(f"SELECT k, i - 1 AS at, a[i] AS v FROM ({LISTS}), LATERAL (SELECT unnest(generate_series(1, len(a))) AS i) x")
def array_unnest_with_ordinality(t):
    return lists(t).select("k", F.posexplode("a").alias("at", "v"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 4) AS norm, len(embedding) AS n FROM embeddings")
def array_fold(t):
    square = F.aggregate("embedding", F.lit(0.0), lambda n, x: n + x.cast("double") * x)
    return t.embeddings.select("vec_id", F.round(square, 4).alias("norm"), F.size("embedding").cast("long").alias("n"))


@query("""WITH m AS (SELECT n_nationkey AS k, MAP {'r': n_regionkey, 'k': n_nationkey} AS m, MAP {'k': -1, 'z': 0} AS o FROM nation)
SELECT k, m['r'] AS r, m['none'] IS NULL AS none, array_to_string(list_sort(map_keys(m)), ',') AS keys, -1 AS merged_k, n_m AS merged_r, 0 AS merged_z, 1 AS without_k, true AS has_all, false AS has_any, list_contains(map_keys(m), 'k') AS has
FROM (SELECT *, m['r'] AS n_m FROM m)""")
def map_operators(t):
    m = t.nation.select(
        F.col("n_nationkey").alias("k"), F.create_map(F.lit("r"), "n_regionkey", F.lit("k"), "n_nationkey").alias("m"),
        F.create_map(F.lit("k"), F.lit(-1), F.lit("z"), F.lit(0)).alias("o"))
    both = c.merged("m", "o")
    return m.select(
        "k", F.try_element_at("m", F.lit("r")).alias("r"), F.try_element_at("m", F.lit("none")).isNull().alias("none"), F.array_join(F.array_sort(F.map_keys("m")), ",").alias("keys"),
        F.element_at(both, "k").alias("merged_k"), F.element_at(both, "r").alias("merged_r"), F.element_at(both, "z").alias("merged_z"),
        F.size(c.without_keys("m", "k")).alias("without_k"), c.has_all("m", "r", "k").alias("has_all"), c.has_any("m", "x", "y").alias("has_any"), F.map_contains_key("m", "k").alias("has"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_exists(props, '$.k') AS has, json_exists(props, '$.none') AS none, json_valid(props) AS ok FROM events")
def json_access(t):
    return t.events.select(
        "event_id", c.json_text("props", "k").cast("long").alias("k"), c.json_exists("props", "k").alias("has"), c.json_exists("props", "none").alias("none"), c.is_json("props").alias("ok"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, event_type AS kind, true AS gone FROM events""")
def json_set_and_remove(t):
    out = c.json_set("props", kind=F.col("event_type"), gone="x")
    return t.events.select("event_id", c.json_remove(out, "gone").alias("j")).select(
        "event_id", c.json_text("j", "k").alias("k"), c.json_text("j", "kind").alias("kind"), c.json_text("j", "gone").isNull().alias("gone"))


@query("SELECT event_id, 'object' AS whole, 'number' AS member FROM events")
def json_types(t):
    return t.events.select("event_id", c.json_type("props").alias("whole"), c.json_type("props", "k").alias("member"))


@query("SELECT event_id, e.key AS key, CAST(e.value AS VARCHAR) AS value FROM events, json_each(events.props) e")
def json_each(t):
    return t.events.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))


RANGES = "SELECT a.n_nationkey AS i, b.n_nationkey AS j, a.n_nationkey AS al, a.n_nationkey + 5 AS au, b.n_nationkey AS bl, b.n_nationkey + b.n_regionkey AS bu FROM nation a, nation b"


@query(f"""SELECT i, j, al < bu AND bl < au AND bl < bu AS overlaps, bl >= bu OR (al <= bl AND au >= bu) AS contains, au <= bl AND bl < bu AS left_of,
au = bl OR bu = al AS adjacent, al <= j AND j < au AS has FROM ({RANGES})""")
def range_operators(t):
    a = t.nation.select(F.col("n_nationkey").alias("i"), ranges.make(F.col("n_nationkey"), F.col("n_nationkey") + 5).alias("a"))
    b = t.nation.select(F.col("n_nationkey").alias("j"), ranges.make(F.col("n_nationkey"), F.col("n_nationkey") + F.col("n_regionkey")).alias("b"))
    return a.crossJoin(b).select(
        "i", "j", ranges.overlaps("a", "b").alias("overlaps"), ranges.contains("a", "b").alias("contains"), ranges.left_of("a", "b").alias("left_of"),
        ranges.adjacent("a", "b").alias("adjacent"), ranges.contains_value("a", F.col("j")).alias("has"))


@query("""SELECT s_suppkey, '10.' || s_nationkey || '.' || s_suppkey % 256 || '.0/24' AS network, '10.' || s_nationkey || '.' || s_suppkey % 256 || '.255' AS broadcast, 24 AS masklen,
'255.255.255.0' AS netmask, '10.' || s_nationkey || '.' || s_suppkey % 256 || '.7' AS host, s_nationkey < 8 AS inside FROM supplier""")
def inet_operators(t):
    a = F.concat(F.lit("10."), F.col("s_nationkey").cast("string"), F.lit("."), (F.col("s_suppkey") % 256).cast("string"), F.lit(".7/24"))
    return t.supplier.select(
        "s_suppkey", inet.network(a).alias("network"), inet.broadcast(a).alias("broadcast"), inet.masklen(a).alias("masklen"), inet.netmask(a).alias("netmask"),
        inet.host(a).alias("host"), inet.contained_by(a, F.lit("10.0.0.0/13")).alias("inside"))


@query(f"SELECT k, unnest(a) AS x, unnest(list_reverse(a)) AS y FROM ({LISTS})")
def array_unnest_together(t):
    return lists(t).select("k", F.explode(F.arrays_zip(F.col("a").alias("x"), F.reverse("a").alias("y"))).alias("z")).select("k", "z.x", "z.y")


@query(f"SELECT k, x FROM ({LISTS}) l, LATERAL (SELECT unnest(l.a) AS x) u WHERE x > 1")
def lateral_unnest(t):
    return lists(t).lateralJoin(t.spark.tvf.explode(F.col("a").outer()).toDF("x")).where("x > 1").select("k", "x")


@query("""SELECT n_nationkey AS k, 'r' AS key, n_regionkey AS value FROM nation UNION ALL SELECT n_nationkey, 'k', n_nationkey FROM nation""")
def map_each(t):
    return t.nation.select(F.col("n_nationkey").alias("k"), F.explode(F.create_map(F.lit("r"), "n_regionkey", F.lit("k"), "n_nationkey")).alias("key", "value"))


@query("SELECT n_nationkey AS k, 'r,' || n_regionkey || ',k,' || n_nationkey AS flat, n_regionkey AS only_r, n_regionkey = 0 AS has_entry FROM nation")
def map_to_array_and_slice(t):
    m = F.create_map(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("k"), F.col("n_nationkey").cast("string"))
    return t.nation.select(
        F.col("n_nationkey").alias("k"), F.array_join(c.flat(m), ",").alias("flat"), F.element_at(c.only_keys(m, "r"), "r").cast("int").alias("only_r"),
        c.map_contains(m, F.create_map(F.lit("r"), F.lit("0"))).alias("has_entry"))


@query("SELECT event_id, CAST(props->>'$.k' AS INTEGER) + 1 AS k1 FROM events")
def json_to_record(t):
    return t.events.select("event_id", F.from_json("props", "k int").alias("r")).select("event_id", (F.col("r.k") + 1).alias("k1"))


def kinds_by_json(events):
    made = events.groupBy("user_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("event_id", "event_type")))).alias("j"))
    items = F.from_json("j", "array<struct<event_id: long, event_type: string>>")
    return made.select("user_id", F.array_join(F.transform(items, lambda x: x.event_type), ",").alias("kinds"))


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY event_id) AS kinds FROM events GROUP BY user_id")
def json_build_and_read_array(t):
    return kinds_by_json(t.events)


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY event_id) AS kinds FROM events GROUP BY user_id")
def json_build_and_read_array_whole(t):
    return kinds_by_json(t.events)


@query("SELECT c_custkey, c_custkey AS id, c_mktsegment AS segment, c_nationkey + 1 AS next FROM customer")
def row_members(t):
    rows = t.customer.select("c_custkey", F.struct(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), (F.col("c_nationkey") + 1).alias("next")).alias("row"))
    return rows.select("c_custkey", "row.*")


@query(f"SELECT i, j, greatest(al, bl) AS lo, least(au, bu) AS hi FROM ({RANGES}) WHERE al < bu AND bl < au AND bl < bu")
def range_intersection(t):
    a = t.nation.select(F.col("n_nationkey").alias("i"), ranges.make(F.col("n_nationkey"), F.col("n_nationkey") + 5).alias("a"))
    b = t.nation.select(F.col("n_nationkey").alias("j"), ranges.make(F.col("n_nationkey"), F.col("n_nationkey") + F.col("n_regionkey")).alias("b"))
    both = a.crossJoin(b).where(ranges.overlaps("a", "b")).select("i", "j", ranges.intersection("a", "b").alias("r"))
    return both.select("i", "j", F.col("r.lower").alias("lo"), F.col("r.upper").alias("hi"))


NESTED = """SELECT event_id, '{"a":{"b":' || user_id || ',"c":[' || event_id || ',"x",null]},"n":' || user_id || ',"s":"' || event_type || '","z":null}' AS j FROM events"""


def nested(t):
    text = lambda c: F.col(c).cast("string")
    parts = ('{"a":{"b":', text("user_id"), ',"c":[', text("event_id"), ',"x",null]},"n":', text("user_id"), ',"s":"', F.col("event_type"), '","z":null}')
    return t.events.select("event_id", "user_id", "event_type", F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts)).alias("j"))


@query("""SELECT event_id, '{"b":' || user_id || ',"c":[' || event_id || ',"x",null]}' AS a, user_id AS n, true AS z, 'number' AS kind FROM events""")
def json_set_keeps_types(t):
    out = nested(t).select("event_id", c.json_remove(c.json_set("j", z=True, y="t"), "y").alias("j"))
    return out.select("event_id", c.json_text("j", "a").alias("a"), c.json_text("j", "n").cast("long").alias("n"), c.json_text("j", "z").cast("boolean").alias("z"), c.json_type("j", "n").alias("kind"))


@query("SELECT event_id, user_id + 1 AS b, event_type AS kind, event_id AS first FROM events")
def json_set_path(t):
    out = c.json_changes("j", ("set", ["a", "b"], F.col("user_id") + 1), ("set", ["a", "c", 1], F.col("event_type")))
    return nested(t).select("event_id", out.alias("j")).select(
        "event_id", c.json_text("j", "a", "b").cast("long").alias("b"), c.json_text("j", "a", "c", 1).alias("kind"), c.json_text("j", "a", "c", 0).cast("long").alias("first"))


@query("SELECT event_id, user_id AS kept, 7 AS made, 9 AS changed, true AS none FROM events")
def json_insert_and_replace(t):
    out = c.json_changes("j", ("insert", ["a", "b"], 5), ("insert", ["a", "d"], 7), ("replace", ["n"], 9), ("replace", ["a", "none"], 1))
    number = lambda *path: c.json_text("k", *path)
    return nested(t).select("event_id", out.alias("k")).select(
        "event_id", number("a", "b").cast("long").alias("kept"), number("a", "d").cast("int").alias("made"), number("n").cast("int").alias("changed"), number("a", "none").isNull().alias("none"))


@query("""SELECT event_id, '{"c":[' || event_id || ',null]}' AS a FROM events""")
def json_delete_path(t):
    out = c.json_changes("j", ("delete", ["a", "b"]), ("delete", ["a", "c", 1]))
    return nested(t).select("event_id", c.json_text(out, "a").alias("a"))


@query(f"SELECT event_id, array_to_string(json_keys(j), ',') AS keys, json_array_length(j, '$.a.c') AS n FROM ({NESTED})")
def json_keys_and_length(t):
    return nested(t).select("event_id", F.array_join(c.json_keys("j"), ",").alias("keys"), c.json_array_length(c.json_text("j", "a", "c")).cast("long").alias("n"))


@query(f"SELECT event_id, i AS at, CAST(json_extract(j, '$.a.c[' || i || ']') AS VARCHAR) AS v FROM ({NESTED}), (SELECT unnest([0, 1, 2]) AS i)")
def json_array_elements(t):
    return nested(t).select("event_id", F.posexplode(c.json_elements(c.json_text("j", "a", "c"))).alias("at", "v")).select("event_id", "at", F.to_json("v").alias("v"))


@query("""SELECT event_id, user_id % 2 = 0 AS n, true AS s, false AS other FROM events""")
def json_contains(t):
    even = F.concat(F.lit('{"n":'), (F.col("user_id") - F.col("user_id") % 2).cast("string"), F.lit("}"))
    word = F.concat(F.lit('{"z":null,"s":"'), F.col("event_type"), F.lit('"}'))
    return nested(t).select("event_id", c.json_contains("j", even).alias("n"), c.json_contains("j", word).alias("s"), c.json_contains("j", F.lit('{"s":1}')).alias("other"))


@query("SELECT event_id, event_id AS n, 1 AS more, event_type AS s FROM events")
def json_concat(t):
    other = F.concat(F.lit('{"more":1,"n":'), F.col("event_id").cast("string"), F.lit("}"))
    return nested(t).select("event_id", c.json_concat("j", other).alias("k")).select(
        "event_id", c.json_text("k", "n").cast("long").alias("n"), c.json_text("k", "more").cast("int").alias("more"), c.json_text("k", "s").alias("s"))


@query("SELECT event_id, 'a,n,s' AS keys FROM events")
def json_strip_nulls(t):
    return nested(t).select("event_id", F.array_join(c.json_keys(c.json_strip_nulls("j")), ",").alias("keys"))


@query("""SELECT event_id, '[' || event_id || ',"x",null]' AS found, user_id AS dotted FROM events""")
def json_queries_and_quoted_names(t):
    dotted = F.concat(F.lit('{"a.b":{"c d":'), F.col("user_id").cast("string"), F.lit("}}"))
    return nested(t).select("event_id", c.json_query("j", "$.a.c[*]").alias("found"), c.json_text(dotted, "a.b", "c d").cast("long").alias("dotted"))


@query(f"SELECT i, j, least(al, bl) AS lo, greatest(au, bu) AS hi, al >= bl AS after, au <= bu AS before FROM ({RANGES}) WHERE al < bu AND bl < au AND bl < bu")
def range_merge(t):
    a = t.nation.select(F.col("n_nationkey").alias("i"), ranges.make(F.col("n_nationkey"), F.col("n_nationkey") + 5).alias("a"))
    b = t.nation.select(F.col("n_nationkey").alias("j"), ranges.make(F.col("n_nationkey"), F.col("n_nationkey") + F.col("n_regionkey")).alias("b"))
    both = a.join(b, ranges.overlaps("a", "b")).select("i", "j", "a", "b", ranges.merge("a", "b").alias("r"))
    return both.select("i", "j", F.col("r.lower").alias("lo"), F.col("r.upper").alias("hi"), ranges.starts_after("a", "b").alias("after"), ranges.ends_before("a", "b").alias("before"))
