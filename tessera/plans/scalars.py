"""Scalar expressions."""

from pyspark.sql import functions as F

from ..functions import texts as x
from .registry import query


@query("""SELECT l_orderkey, l_linenumber, (l_orderkey + l_partkey) * 2 - l_suppkey AS a, power(l_linenumber, 2) AS p, l_orderkey % 7 AS m, l_orderkey // 7 AS d,
(l_orderkey & 12) | 1 AS b, xor(l_orderkey, 5) AS x, l_orderkey << 2 AS l, l_orderkey >> 1 AS r, ~l_orderkey AS n FROM lineitem""")
def arithmetic_and_bits(t):
    k = F.col("l_orderkey")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", ((k + F.col("l_partkey")) * 2 - F.col("l_suppkey")).alias("a"), F.pow("l_linenumber", F.lit(2)).alias("p"), (k % 7).alias("m"),
        F.expr("l_orderkey div 7").alias("d"), k.bitwiseAND(F.lit(12)).bitwiseOR(F.lit(1)).alias("b"), k.bitwiseXOR(F.lit(5)).alias("x"),
        F.shiftleft(k, 2).alias("l"), F.shiftright(k, 1).alias("r"), F.bitwise_not(k).alias("n"))


@query("SELECT c_custkey, c_name || ' / ' || CAST(c_nationkey AS VARCHAR) || ' / ' || c_mktsegment AS label, length(c_name) AS n, trim('  x ') AS t, upper(c_mktsegment) AS u FROM customer")
def text_functions(t):
    return t.customer.select(
        "c_custkey", x.join([F.col("c_name"), F.col("c_nationkey"), F.col("c_mktsegment")], " / ").alias("label"), F.char_length("c_name").alias("n"),
        F.trim(F.lit("  x ")).alias("t"), F.upper("c_mktsegment").alias("u"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'big' WHEN o_totalprice > 20000 THEN 'mid' ELSE 'small' END AS size,
CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS code FROM orders""")
def case_expressions(t):
    p = F.col("o_totalprice")
    return t.orders.select("o_orderkey", x.case([(p > 100000, "big"), (p > 20000, "mid")], "small").alias("size"), x.case({"F": 1, "O": 2}, 0, on="o_orderstatus").alias("code"))


@query("""SELECT p_partkey, CAST(p_size AS VARCHAR) AS s, CAST(floor(p_retailprice) AS BIGINT) AS i, try_cast(p_brand AS INTEGER) IS NULL AS none, coalesce(nullif(p_size, 1), -1) AS c,
greatest(p_size, 25) AS g, least(p_size, 25) AS l, abs(p_size - 25) AS a, round(p_retailprice, 1) AS r FROM part""")
def casts_and_nulls(t):
    return t.part.select(
        "p_partkey", F.col("p_size").cast("string").alias("s"), F.floor("p_retailprice").alias("i"), F.col("p_brand").try_cast("int").isNull().alias("none"),
        F.coalesce(F.nullif(F.col("p_size"), F.lit(1)), F.lit(-1)).alias("c"), F.greatest("p_size", F.lit(25)).alias("g"), F.least("p_size", F.lit(25)).alias("l"),
        F.abs(F.col("p_size") - 25).alias("a"), F.round("p_retailprice", 1).alias("r"))


@query("""SELECT o_orderkey, extract(year FROM o_orderdate) AS y, extract(month FROM o_orderdate) AS m, extract(day FROM o_orderdate) AS d, extract(quarter FROM o_orderdate) AS q,
extract(dow FROM o_orderdate) AS w, extract(hour FROM o_orderdate) AS h FROM orders""")
def extract_parts(t):
    parts = {"y": "year", "m": "month", "d": "day", "q": "quarter", "w": "dow", "h": "hour"}
    return t.orders.select("o_orderkey", *(x.extract(p, "o_orderdate").cast("long").alias(n) for n, p in parts.items()))


@query("""SELECT event_id, strftime(ts + INTERVAL 1 MONTH + INTERVAL 3 DAY + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS later,
strftime(ts - INTERVAL 1 WEEK - to_minutes(user_id), '%Y-%m-%d %H:%M:%S') AS earlier FROM events""")
def date_arithmetic(t):
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return t.events.select(
        "event_id", text(x.date_add("ts", months=1, days=3, hours=2)).alias("later"),
        text(x.date_sub(x.date_sub("ts", minutes=F.col("user_id").cast("int")), weeks=1)).alias("earlier"))


@query("SELECT event_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, CAST(ts AS DATE)::VARCHAR AS day FROM events")
def timestamp_rounding(t):
    return t.events.select("event_id", F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm").alias("hour"), F.col("ts").cast("date").cast("string").alias("day"))


@query("SELECT c_custkey, md5(c_name) AS m, reverse(c_mktsegment) AS r, substr(c_name, 1, 4) AS s, lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS p, strpos(c_name, '#') AS at FROM customer")
def named_functions(t):
    return t.customer.select(
        "c_custkey", F.md5("c_name").alias("m"), F.reverse("c_mktsegment").alias("r"), F.substring("c_name", 1, 4).alias("s"),
        F.lpad(F.col("c_nationkey").cast("string"), 3, "0").alias("p"), F.instr("c_name", "#").alias("at"))


@query("SELECT o_orderkey, round(o_totalprice * 1.19, 4) AS gross FROM orders")
def vectorised_function(t):
    """A function of the user's own, over Arrow batches."""

    @F.pandas_udf("double")
    def gross(price):
        return price * 1.19

    return t.orders.select("o_orderkey", F.round(gross("o_totalprice"), 4).alias("gross"))


@query("SELECT o_orderstatus, round(median(o_totalprice), 4) AS mid FROM orders GROUP BY o_orderstatus")
def median_of_groups(t):
    return t.orders.groupBy("o_orderstatus").agg(F.round(F.median("o_totalprice"), 4).alias("mid"))
