"""Projection and filters."""

import re

from pyspark.sql import functions as F

from ..operators import filters as f
from ..operators.dataset import Dataset
from .registry import query

KEEP = "o_orderkey", "o_orderstatus", "o_totalprice"


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 1000 AND o_totalprice < 50000")
def where_pairs(t):
    return t.orders.where(f.conditions({"o_orderstatus": "F", "o_totalprice": f.Between(1000, 50000, exclusive=True)})).select(*KEEP)


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice > 20000)")
def exclude_pairs(t):
    return Dataset(t.orders).exclude((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 20000)).select(*KEEP).df


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'P' OR o_totalprice > 100000")
def or_widens(t):
    return Dataset(t.orders).where(o_orderstatus="P").or_(F.col("o_totalprice") > 100000).select(*KEEP).df


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def or_without_filter(t):
    return Dataset(t.orders).or_(o_orderstatus="P").select(*KEEP).df


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE NOT (o_orderstatus = 'F')")
def invert_filter(t):
    return Dataset(t.orders).where(o_orderstatus="F").invert().select(*KEEP).df


@query("SELECT o_orderkey FROM orders WHERE false")
def invert_without_filter(t):
    return Dataset(t.orders).invert().select("o_orderkey").df


LABELLED = "SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


def labelled(t):
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", "toxic")


@query(f"SELECT * FROM ({LABELLED}) x WHERE NOT (toxic = 1)")
def exclude_drops_nulls(t):
    return f.exclude(labelled(t), {"toxic": 1})


@query(f"SELECT * FROM ({LABELLED}) x WHERE NOT coalesce(toxic = 1, false)")
def exclude_or_null(t):
    return f.exclude_or_null(labelled(t), {"toxic": 1})


@query(f"SELECT * FROM ({LABELLED}) x WHERE toxic IS NULL OR toxic IN (1)")
def in_list_with_null(t):
    return labelled(t).where(f.is_in("toxic", [1, None], nulls_known=True))


@query(f"SELECT * FROM ({LABELLED}) x WHERE toxic NOT IN (1) AND toxic IS NOT NULL")
def not_in_list_with_null(t):
    return labelled(t).where(f.not_in("toxic", [1, None], nulls_known=True))


@query("SELECT n_nationkey FROM nation WHERE false")
def in_empty_list(t):
    return t.nation.where(f.is_in("n_nationkey", [])).select("n_nationkey")


@query(f"SELECT * FROM ({LABELLED}) x")
def not_in_empty_list(t):
    return labelled(t).where(f.not_in("toxic", []))


@query("SELECT n_nationkey, n_name FROM nation WHERE (n_regionkey, n_nationkey) IN ((0, 0), (1, 2), (2, 8))")
def tuples_in_list(t):
    return t.nation.where(f.tuples_in(["n_regionkey", "n_nationkey"], [(0, 0), (1, 2), (2, 8)])).select("n_nationkey", "n_name")


@query(f"SELECT doc_id, toxic IS NULL AS unknown, (toxic = 1) IS TRUE AS yes, (toxic = 1) IS FALSE AS no FROM ({LABELLED}) x")
def is_true_false_null(t):
    toxic = F.col("toxic") == 1
    return labelled(t).select("doc_id", F.isnull("toxic").alias("unknown"), f.pair(toxic, True).alias("yes"), f.pair(toxic, False).alias("no"))


@query(f"SELECT doc_id FROM ({LABELLED}) x WHERE toxic IS DISTINCT FROM 0")
def distinct_from(t):
    return labelled(t).where(f.distinct_from("toxic", F.lit(0))).select("doc_id")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%' OR p_type LIKE '%STEEL%'")
def like_patterns(t):
    return t.part.where(f.like("p_name", "%a%") | f.like("p_type", "%STEEL%")).select("p_partkey", "p_name")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE 'b%' OR c_mktsegment ILIKE '%y'")
def ilike_patterns(t):
    return t.customer.where(f.like("c_mktsegment", "b%", "%y", ignore_case=True)).select("c_custkey")


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(text, 'token = \"[[:xdigit:]]{40}')")
def regex_posix_class(t):
    return t.documents.where(f.matches("text", 'token = "[[:xdigit:]]{40}')).select("doc_id")


@query("SELECT p_partkey FROM part WHERE (p_name LIKE '%e%' OR p_type LIKE '%e%') AND (p_name LIKE '%1%' OR p_type LIKE '%1%')")
def grep_all_patterns(t):
    return f.grep(t.part, ["p_name", "p_type"], ["%e%", "%1%"], all_patterns=True).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE (p_brand ILIKE '%BRAND%' OR p_brand ILIKE '%x%') AND (p_type ILIKE '%BRAND%' OR p_type ILIKE '%s%')")
def grep_all_columns(t):
    return f.grep(t.part, ["p_brand", "p_type"], ["%brand%", "%x%", "%s%"], all_columns=True, ignore_case=True).select("p_partkey").intersect(
        t.part.where(f.like("p_type", "%brand%", "%s%", ignore_case=True) & f.like("p_brand", "%brand%", "%x%", ignore_case=True)).select("p_partkey"))


@query("SELECT doc_id FROM documents WHERE contains(text, '100%') OR contains(text, '_')")
def like_escaped(t):
    return t.documents.where(f.like("text", f"%{f.escape_like('100%')}%", f"%{f.escape_like('_')}%")).select("doc_id")


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)\bidiot\b') AND regexp_matches(text, '(?i)\bclown\b')")
def full_text_words(t):
    return t.documents.where(f.words_search("text", ["idiot", "clown"])).select("doc_id")


@query("SELECT event_type, value FROM events WHERE event_type <> 'view' AND NOT (value > 50)")
def no_pair(t):
    return t.events.where(f.no_pair({"event_type": "view", "value": f.Between(50.0, None)}) | ((F.col("event_type") != "view") & (F.col("value") == 50))).select("event_type", "value")


@query("SELECT n_nationkey, n_name, upper(n_name) AS loud FROM nation")
def select_append_and_remove(t):
    return Dataset(t.nation).select_append(F.upper("n_name").alias("loud")).select_remove("n_regionkey").df


@query("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def select_distinct(t):
    return Dataset(t.customer).select("c_mktsegment", "c_nationkey").distinct().df


@query("SELECT c_mktsegment, c_nationkey FROM customer GROUP BY c_mktsegment, c_nationkey")
def select_group(t):
    return Dataset(t.customer).select_group("c_mktsegment", "c_nationkey").df


@query("SELECT a, b FROM (SELECT n_name AS a, n_regionkey AS b FROM nation) t1 WHERE b > 2")
def from_self_with_columns(t):
    return Dataset(t.nation.select("n_name", "n_regionkey")).from_self("t1", ["a", "b"]).where(F.col("b") > 2).df


@query("SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) v(id, name)")
def values_table(t):
    from ..sources.tables import values

    return values(t.spark, [(1, "a"), (2, "b"), (3, None)], "id int, name string")


@query("SELECT p_partkey, p_size FROM part WHERE p_size > 10 AND p_brand = 'Brand#11'")
def raw_sql_with_placeholders(t):
    from ..sources.tables import fetch

    t.part.createOrReplaceTempView("tessera_part")
    return fetch(t.spark, "SELECT p_partkey, p_size FROM tessera_part WHERE p_size > :size AND p_brand = :brand", size=10, brand="Brand#11")


@query("SELECT c_custkey FROM customer WHERE length(c_name) BETWEEN 1 AND 200 AND c_acctbal IS NOT NULL AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
def validation_rules(t):
    rules = [F.length("c_name").between(1, 200), F.col("c_acctbal").isNotNull(), f.is_in("c_mktsegment", ["BUILDING", "MACHINERY"]), f.matches("c_name", ".")]
    return t.customer.where(f.all_of(rules)).select("c_custkey")


@query("SELECT doc_id FROM documents WHERE regexp_matches(lang, '^(de|FR)$', 'i')")
def regex_ignore_case(t):
    return t.documents.where(f.conditions({"lang": re.compile("^(de|FR)$", re.IGNORECASE)})).select("doc_id")
