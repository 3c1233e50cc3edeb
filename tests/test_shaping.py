"""Constraints, functions of one's own, JSON trees and addresses on small tables with nulls and odd values."""

import operator
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import collections as c
from tessera.functions import custom, inet
from tessera.operators import constraints, paging, recursion
from tessera.operators import filters as f
from tessera.operators.dataset import Dataset
from tessera.sources import tables


def of(spark, kind, *values):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def test_constraints_let_nulls_pass(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "a"), (-2, None)], "k int, s string")
    assert [r.k for r in constraints.check_violations(rows, F.col("k") > 0).collect()] == [-2]
    assert [tuple(r) for r in constraints.unique_violations(rows, "k", "s").collect()] == [(1, "a", 2)]
    assert [r.k for r in constraints.missing_references(rows, of(spark, "int", 1, None), {"k": "v"}).collect()] == [-2]


def test_overlaps_against_pairs(spark):
    chance = random.Random(3)
    rows = [(i, chance.randrange(6), s, s + chance.randrange(0, 9)) for i in range(300) for s in [chance.randrange(150)]]
    want = {a[0] for a in rows for b in rows if a[0] != b[0] and a[1] == b[1] and a[2] < a[3] and b[2] < b[3] and a[2] < b[3] and b[2] < a[3]}
    df = spark.createDataFrame([*rows, (900, 1, None, 5), (901, 1, 5, None)], "id int, k int, a int, b int")
    assert {r.id for r in constraints.overlap_violations(df, ["k"], "a", "b").collect()} == want


def test_aggregate_of_ones_own(spark):
    big = 2**60 + 1
    rows = [(big, 1.0), (big, 3.0), (None, 5.0), (None, 7.0), (big - 1, 9.0)]
    df = spark.createDataFrame(rows * 50, "k long, v double").repartition(3)
    state = lambda g: {"n": len(g), "total": float(g["v"].sum())}
    out = custom.aggregate(df, ["k"], state, "n long, total double", F.sum("n").alias("n"), F.sum("total").alias("total"))
    assert {tuple(r) for r in out.collect()} == {(big, 100, 200.0), (None, 100, 600.0), (big - 1, 50, 450.0)}
    whole = custom.aggregate(df, [], state, "n long, total double", F.sum("n").alias("n"))
    assert whole.first().n == 250
    assert custom.aggregate(df.where("false"), ["k"], state, "n long, total double", F.sum("n").alias("n")).count() == 0


def test_table_function_of_ones_own(spark):
    class Upto:
        def eval(self, n):
            yield from ((i,) for i in range(n or 0))

    rows = custom.generate(of(spark, "int", 2, 0, None), Upto, "i int", "v").collect()
    assert sorted(tuple(r) for r in rows) == [(2, 0), (2, 1)]


def test_comparisons_with_all_and_any(spark):
    out = of(spark, "array<int>", [1, 2], [1, None], [9, None], [], None).select(
        c.compares_all(F.lit(5), operator.gt, "v").alias("all"), c.compares_any(F.lit(5), operator.lt, "v").alias("any"), c.dimensions("v", 1).alias("d"))
    assert [tuple(r) for r in out.collect()] == [(True, False, "[2]"), (None, None, "[2]"), (False, True, "[2]"), (True, False, None), (None, None, None)]


def test_json_tree_and_patch(spark):
    rows = spark.createDataFrame([(1, '{"a":[1,{"b":null}],"c":{}}'), (2, "7"), (3, "no"), (4, None)], "id int, j string")
    assert {tuple(r) for r in recursion.json_tree(rows, "j", ["id"]).select("id", "path", "type").collect()} == {
        (1, "$", "object"), (1, "$.a", "array"), (1, "$.a[0]", "number"), (1, "$.a[1]", "object"), (1, "$.a[1].b", "null"), (1, "$.c", "object"), (2, "$", "number")}
    out = {r.id: r.k for r in rows.select("id", c.json_patch("j", {"a": None, "c": {"d": {"e": "x"}}}).alias("k")).collect()}
    assert out == {1: '{"c":{"d":{"e":"x"}}}', 2: '{"c":{"d":{"e":"x"}}}', 3: None, 4: None}


def test_tree_without_descendants(spark):
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2)], "id int, parent_id int")
    out = {r.id: [(x.level, x.row.id) for x in r.below] for r in recursion.with_descendants(tree, F.col("id") != 2, "below").collect()}
    assert out == {1: [(1, 2), (2, 3)], 3: []}


def test_addresses_with_a_tail(spark):
    out = of(spark, "string", "::ffff:10.1.2.3", "64:ff9b::1.2.3.400", "::10.0.0.1/120").select(inet.family("v").alias("f"), F.right(inet.bits("v"), F.lit(32)).alias("b"))
    want = [(6, f"{0x0A010203:032b}"), (None, None), (6, f"{0x0A000001:032b}")]
    assert [tuple(r) for r in out.collect()] == want
    inside = of(spark, "string", "::ffff:10.1.2.3").select(inet.contained_by_or_equals("v", F.lit("::ffff:a01:200/120"))).first()[0]
    assert inside


def test_found_rows_of_an_empty_query(spark):
    rows = of(spark, "int", 1, 2, 3)
    assert [r.found_rows for r in paging.with_found_rows(rows.limit(2), rows).collect()] == [3, 3]
    assert paging.with_found_rows(rows.where("v > 5").limit(2), rows.where("v > 5")).count() == 0


def test_ranks_of_words(spark):
    out = of(spark, "string", "A bolt, a BOLT.", "bolts", None, "x.y xzy").select(f.words_rank("v", ["bolt", "x.y"]).alias("n"))
    assert [r.n for r in out.collect()] == [2, 0, 0, 1]


@pytest.mark.parametrize("order", [("v",), (("v", "desc"),), (("v", "asc", "last"),)])
def test_paged_datasets(spark, order):
    rows = Dataset(of(spark, "int", *range(10), None)).order(*order)
    pages = [[r.v for r in p.all()] for p in rows.paged_datasets(4)]
    assert [len(p) for p in pages] == [4, 4, 3]
    assert [v for p in pages for v in p] == [r.v for r in rows.all()]
    assert [len(p.all()) for p in rows.paged_datasets(11)] == [11]
    assert list(rows.nullify().order("v").paged_datasets(4)) == []


def test_loose_count(spark, tmp_path):
    of(spark, "int", 1, 2, 3).write.option("path", str(tmp_path / "t")).mode("overwrite").saveAsTable("loosely_counted")
    try:
        assert tables.loose_count(spark, "loosely_counted") is None
        spark.sql("ANALYZE TABLE loosely_counted COMPUTE STATISTICS")
        assert tables.loose_count(spark, "loosely_counted") == 3
    finally:
        spark.sql("DROP TABLE loosely_counted")
