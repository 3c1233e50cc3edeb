"""Behaviour that the registered queries do not show: golden windows, actions, files, streams, errors."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import collections as c
from tessera.functions import inet, ranges, texts
from tessera.operators import associations, frames, joins, modify, paging, recursion
from tessera.operators import filters as f
from tessera.operators.dataset import Dataset, NoMatchingRow
from tessera.sources import tables
from tessera.streaming import windows


@pytest.fixture(scope="module")
def win(spark):
    rows = [(1, 1, 1), (2, 1, 10), (3, 1, 100), (4, 2, 1000), (5, 2, 10000), (6, 2, 100000)]
    return spark.createDataFrame(rows, "id int, group_id int, amount int")


def column(df, name, order="id"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_groups_frame_golden(win):
    out = frames.groups_frame(win, [], "group_id", -1, 0, s=(F.sum, "amount"))
    assert column(out, "s") == [111, 111, 111, 111111, 111111, 111111]


@pytest.mark.parametrize(("start", "end", "kind"), [(-2, 2, "double"), (-1, 0, "double"), (1, 3, "bigint"), (-3, -1, "int"), (-100, 100, "double"), (-0.5, 0.25, "double")])
def test_range_count_is_a_range_frame(spark, start, end, kind):
    odd = ["NaN", "Infinity", "-Infinity", "-0.0", "0.1", "0.35", "0.6"] if kind == "double" else []
    values = [None, None, *odd, *odd[:2], *(str(n * n % 17) for n in range(30)), *["40"] * 9]
    rows = [(i, p, x) for i, (p, x) in enumerate((p, x) for p in ("a", "b", None) for x in values)]
    df = spark.createDataFrame(rows, "id int, p string, x string").withColumn("x", F.col("x").cast(kind))
    frame = " AND ".join(f"{abs(n)}{'D' if isinstance(n, float) else ''} {'PRECEDING' if n < 0 else 'FOLLOWING'}" for n in (start, end))
    for partition, parts in ((["p"], 2), (["p"], 1024), ([], 1024)):
        want = F.expr(f"count(*) OVER ({'PARTITION BY p' if partition else ''} ORDER BY x RANGE BETWEEN {frame})")
        assert column(frames.range_count(df, partition, "x", start, end, "n", parts), "n") == column(df.withColumn("n", want), "n")
    assert frames.range_count(df.limit(0), ["p"], "x", start, end, "n").collect() == []


def test_range_frame_does_not_go_over_its_frame_for_each_row(spark):
    from tessera.plans.catalog import QUERIES

    plan = QUERIES["range_frame"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "rangeframe" not in plan.lower().replace(" ", "")


@pytest.mark.parametrize(("exclude", "want"), [
    ("current", [None, 1, 11, 111, 1111, 11111]),
    ("group", [None, None, None, 111, 111, 111]),
    ("ties", [1, 10, 100, 1111, 10111, 100111]),
])
def test_exclude_golden(win, exclude, want):
    order = ["id"] if exclude == "current" else ["group_id"]
    assert column(frames.sum_excluding(win, [], order, "amount", exclude, "s"), "s") == want


def test_string_agg_golden(spark):
    rows = [(1, "a", 3), (1, "a", 3), (1, "b", 5), (1, "c", 4), (2, "aa", 2), (2, "bb", 1), (3, None, 1)]
    df = spark.createDataFrame(rows, "id int, s string, o int")
    assert column(frames.string_agg(df, ["id"], "s", "v", [F.col("o")]), "v") == ["a,a,c,b", "bb,aa", ""]
    assert column(frames.string_agg(df, ["id"], "s", "v", distinct=True, separator="-"), "v") == ["a-b-c", "aa-bb", ""]


def test_conditions(spark):
    df = spark.createDataFrame([(1, True, "a_b"), (2, False, "a%b"), (3, None, None)], "n int, flag boolean, s string")
    ids = lambda spec: [r.n for r in df.where(f.conditions(spec)).orderBy("n").collect()]
    assert ids({"flag": True}) == [1] and ids({"flag": None}) == [3] and ids({}) == [1, 2, 3] and ids(None) == []
    assert ids({"n": f.Between(2, None)}) == [2, 3] and ids({"n": f.Between()}) == [1, 2, 3] and ids({"n": [1, 3]}) == [1, 3] and ids({"n": []}) == []
    assert ids(f.like("s", f"a{f.escape_like('%')}b")) == [2] and ids(f.any_pair({"n": 1, "flag": False})) == [1, 2]
    with pytest.raises(TypeError):
        f.conditions("n = 1")


def test_dataset_actions(win):
    d = Dataset(win).order("amount")
    assert d.first().id == 1 and d.last().id == 6 and d.get("amount") == 1 and d.count() == 6
    assert (d.sum("amount"), d.min("id"), d.max("id"), d.avg("id")) == (111111, 1, 6, 3.5)
    assert d.as_hash("group_id", "id") == {1: 3, 2: 6} and d.to_groups("group_id", "id") == {1: [1, 2, 3], 2: [4, 5, 6]}
    assert [r.id for r in d.paged_each(2)] == d.select_map("id") == [1, 2, 3, 4, 5, 6]
    assert d.where(F.col("id") > 9).first() is None and d.where(F.col("id") > 9).empty() and len(list(d)) == 6
    with pytest.raises(NoMatchingRow):
        d.where(F.col("id") > 9).first_or_raise()
    for wrong in (lambda: d.limit(0), lambda: d.offset(-1), lambda: d.unordered().last(), lambda: list(d.unordered().paged_each())):
        with pytest.raises(ValueError):
            wrong()


def test_datasets_do_not_change(win):
    d = Dataset(win).where(F.col("id") > 1)
    e = d.where(F.col("id") < 4).select("id").reverse("id").limit(1)
    assert d.count() == 5 and e.all()[0].id == 3 and e.unlimited().unfiltered().count() == 6 and d.columns == ["id", "group_id", "amount"]
    assert d.group("group_id").agg(F.count(F.lit(1)).alias("n")).ungrouped().count() == 5
    assert d.order("id").order_prepend(("group_id", "desc")).order_append("amount").select_prepend(F.lit(1).alias("one")).first().id == 4


def test_page(win):
    page = paging.paginate(win.orderBy("id"), 2, 4)
    assert (page.record_count, page.page_count, page.previous, page.next) == (6, 2, 1, None) and [r.id for r in page.df.collect()] == [5, 6]
    with pytest.raises(ValueError):
        paging.paginate(win, 0, 4)


def test_null_in_not_in(spark, win):
    keys = spark.createDataFrame([(1,), (None,)], "k int")
    assert joins.not_in_query(win, "id", keys).collect() == []
    assert joins.not_in_query(win, "id", keys.where("k = 1")).count() == 5 and joins.not_in_query(win, "id", keys.where("k > 5")).count() == 6


def test_recursion_in_a_cycle_raises(spark):
    start, hop = spark.createDataFrame([(1,)], "n int"), spark.createDataFrame([(1, 2), (2, 1)], "a int, b int")
    step = lambda rows: rows.join(hop, F.col("n") == F.col("a")).select(F.col("b").alias("n"))
    assert sorted(r.n for r in recursion.recursive(start, step, distinct=True).collect()) == [1, 2]
    with pytest.raises(RecursionError):
        recursion.recursive(start, step, most_steps=3)


def test_merge_sequence(spark):
    m1 = spark.createDataFrame([], "i1 int, a int")
    m2 = spark.createDataFrame([(1, 2)], "i2 int, b int")
    new = modify.Branch("not_matched", {"i1": F.col("s.i2"), "a": F.col("s.b") + 11})
    change = modify.Branch("matched", {"a": F.col("t.a") + F.col("s.b") + 20})
    gone = modify.Branch("matched", None, F.col("t.a") > 30)
    out = []
    for branches in ([new], [change, new], [change, new], [gone, change], [modify.Branch("matched", nothing=True), new]):
        m1 = modify.merge(m1, m2, {"i1": "i2"}, branches)
        out.append([tuple(r) for r in m1.collect()])
    assert out == [[(1, 13)], [(1, 35)], [(1, 57)], [], [(1, 13)]]


def test_snapshot_and_files(spark, win, tmp_path):
    again = modify.write_snapshot(modify.delete(win, {"id": 1}), str(tmp_path / "v2"))
    assert again.count() == 5
    for kind, options in (("csv", {"header": "true"}), ("json", {}), ("orc", {}), ("parquet", {}), ("xml", {"rowTag": "row"})):
        tables.write_file(win, str(tmp_path / kind), kind, **options)
        back = tables.read_file(spark, str(tmp_path / kind), kind, None if kind in ("orc", "parquet") else "id int, group_id int, amount int", **options)
        assert sorted(map(tuple, back.select("id", "amount").collect())) == sorted(map(tuple, win.select("id", "amount").collect()))


def test_collections(spark):
    df = spark.createDataFrame([({"a": "1", "b": None}, [3, None, 1], '{"a": [1, {"b": true}], "c": null}')], "m map<string,string>, a array<int>, j string")
    r = df.select(
        c.defined("m", "a"), c.defined("m", "b"), c.map_contains("m", F.create_map(F.lit("a"), F.lit("1"))), c.flat("m"), c.only_keys("m", "a"),
        c.sorted_by("a", nulls_first=True), c.sorted_by("a", descending=True), c.json_type("j", "a"), c.json_type("j", "a", 1, "b"), c.json_exists("j", "a", 2), c.is_json(F.lit("{"))).first()
    assert list(r) == [True, False, True, ["a", "1", "b", None], {"a": "1"}, [None, 1, 3], [3, 1, None], "array", "boolean", False, False]


def test_ranges(spark):
    a, b = ranges.make(1, 5), ranges.make(3, 9, "[]")
    r = spark.range(1).select(
        ranges.intersection(a, b).alias("i"), ranges.merge(a, b).alias("m"), ranges.is_empty(ranges.make(2, 2)).alias("e"), ranges.contains_value(ranges.make(F.lit(None).cast("int"), 4), 4).alias("c"),
        ranges.right_of(ranges.make(5, 6), a).alias("r")).first()
    assert tuple(r.i) == (3, 5, True, False) and tuple(r.m) == (1, 9, True, True) and (r.e, r.c, r.r) == (True, False, True)


def test_date_units_are_checked():
    with pytest.raises(ValueError):
        texts.date_add("ts", fortnights=1)


def test_bucketed_tables_join_without_a_shuffle(spark, win):
    for name in ("tessera_left", "tessera_right"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        tables.co_located(win, name, ["id"], 4)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("tessera_left").join(spark.table("tessera_right"), "id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 6
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
        for name in ("tessera_left", "tessera_right"):
            spark.sql(f"DROP TABLE {name}")


def test_filters_and_columns_reach_the_scan(spark, win, tmp_path):
    win.write.parquet(str(tmp_path / "t"))
    plan = Dataset(spark.read.parquet(str(tmp_path / "t"))).where(id=3).select("amount").df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,3)" in plan and "ReadSchema: struct<id:int,amount:int>" in plan


def test_stream_agrees_with_its_batch_twin(spark, tmp_path):
    rows = spark.sql("SELECT id AS event_id, timestamp_seconds(id * 137) AS ts, id % 3 AS user_id, CAST(id AS DOUBLE) AS value FROM range(200)")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = windows.read_stream(spark, str(tmp_path / "in"), rows.schema, pattern="*.parquet")
    running = windows.tumbling(stream, "1 hour", ("user_id",)).writeStream.outputMode("complete").format("memory").queryName("tessera_out").trigger(availableNow=True).start()
    running.awaitTermination(120)
    got, want = spark.table("tessera_out"), windows.tumbling(rows, "1 hour", ("user_id",))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_results_shaped(spark):
    rows = Dataset(spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "v int, k string"))
    assert rows.select_hash_groups("k", "v") == {"a": [1, 3], "b": [2], None: [4]} and rows.select_hash("v", "k")[2] == "b"
    assert rows.select_set("k") == {"a", "b", None} and rows.order("v").first(2) == rows.order("v").limit(2).all()
    assert rows.first(k="b").v == 2 and rows.where(v=3).single_value() == 3 and rows.nullify().all() == []
    assert rows.select_order_map("v") == [1, 2, 3, 4] and "Physical Plan" in rows.explain()
    assert [[r.v for r in p.df.collect()] for p in rows.order("v").each_page(3)] == [[1, 2, 3], [4]]


def test_aggregates_of_a_limited_query(spark):
    rows = Dataset(spark.range(100).toDF("v"))
    assert rows.order(("v", "desc")).limit(5).avg("v") == 97 and rows.order("v").limit(5).max("v") == 4 and rows.order("v").offset(98).sum("v") == 197


def test_pages_reach_null_keys(spark):
    table = spark.createDataFrame([(1, None), (2, 5), (3, None), (4, 7)], "id int, k int")
    for way in ("asc", "desc"):
        for nulls in ("first", "last", None):
            rows = Dataset(table).order(("k", way, nulls), "id")
            for size in (1, 2, 3):
                assert list(rows.paged_each(size)) == rows.all()


def test_association_order_and_limits(spark):
    own = spark.createDataFrame([(1,), (2,)], "id int")
    other = spark.createDataFrame([(9, 1, "a"), (3, 1, "b"), (6, 1, "c")], "k int, own int, s string")
    loaded = lambda **more: {r.id: r.x for r in associations.eager(own, associations.Association("x", other, {"id": "own"}, **more)).collect()}
    assert [r.k for r in loaded(order=(F.col("s"),))[1]] == [9, 3, 6] and loaded(order=(F.col("s"),))[2] == []
    assert len(loaded(limit=2)[1]) == 2 and loaded(one=True)[1].own == 1 and loaded(one=True)[2] is None
    assert associations.eager(own, associations.Association("x", other, {"id": "own"}, one=True)).count() == 2


def test_queries_and_windows_by_name(spark, win):
    d = Dataset(win).with_("some", Dataset(win).where(group_id=1), columns=["i", "g", "x"])
    assert sorted(r.i for r in d.from_("some").all()) == [1, 2, 3]
    assert d.join("some", F.col("id") == F.col("some.i")).count() == 3
    with pytest.raises(LookupError):
        d.from_("none")
    with pytest.raises(ValueError):
        d.window("w", ["id"]).window("v", ["group_id"], base="w")
    with pytest.raises(ValueError):
        d.window("w", order=["id"]).window("v", order=["amount"], base="w")


def test_open_ranges_join_and_split(spark):
    rows = [(1, None, 3), (2, 5, None), (3, 2, 6), (4, 4, 4), (5, None, None)]
    df = spark.createDataFrame(rows, "i int, lo int, hi int").select("i", ranges.make(F.col("lo"), F.col("hi")).alias("a"))
    other = df.select(F.col("i").alias("j"), F.col("a").alias("b"))
    want = {(1, 1), (1, 3), (1, 5), (2, 2), (2, 3), (2, 5), (3, 1), (3, 2), (3, 3), (3, 5), (5, 1), (5, 2), (5, 3), (5, 5)}
    got = [(r.i, r.j) for r in joins.overlap_join(df, other, "a", "b", 2).collect()]
    assert len(got) == len(want) and set(got) == want
    cut = {r.i: r.n for r in df.select("i", F.size(ranges.difference("a", ranges.make(F.lit(3), F.lit(5)))).alias("n")).collect()}
    assert cut == {1: 1, 2: 1, 3: 2, 4: 0, 5: 2}


def test_addresses_that_are_none(spark):
    texts_ = ["::", "1::", "::1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::8", "1::2::3", ":::", "1:2", "g::", "1.2.3.4", "1.2.3.400", "12345::"]
    df = spark.createDataFrame([(x,) for x in texts_], "x string")
    assert [r[0] for r in df.select(inet.family("x")).collect()] == [6, 6, 6, 6, None, None, None, None, None, 4, None, None]


def test_json_changes_made_together(spark):
    from tessera.plans.catalog import QUERIES

    texts = ['{"a":{"b":1,"c":[1,null,3]},"n":2,"s":"x"}', '{"n":null,"a":{"b":null,"c":[]}}', '{"a":{"d":{"e":0.50}},"z":[1]}', '{"a":[1]}', "{}", "[1]", "{bad", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, j string")
    steps = [("insert", ["a", "b"], 5), ("set", ["n"], F.col("id")), ("delete", ["a", "c", 0]), ("replace", ["a", "c", 0], "y"), ("delete", ["a", "d", "e"]), ("insert", ["a", "q"], {"k": None}), ("replace", ["z"], 1)]
    alone = {"set": c.json_set_path, "insert": c.json_insert, "replace": c.json_replace, "delete": c.json_delete_path}
    one_by_one = F.col("j")
    for how, *rest in steps:
        one_by_one = alone[how](one_by_one, *rest)
    together = column(df.select("id", c.json_changes("j", *steps).alias("k")), "k")
    assert together == column(df.select("id", one_by_one.alias("k")), "k")
    assert together[:3] == ['{"s":"x","n":0,"a":{"b":1,"c":["y",3],"q":{"k":null}}}', '{"n":1,"a":{"b":null,"c":[],"q":{"k":null}}}', '{"n":2,"a":{"b":5,"d":{},"q":{"k":null}},"z":1}']
    for name in ("json_insert_and_replace", "json_set_path", "json_delete_path"):  # each text is read and written once
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
        assert plan.count("from_json(") == plan.count("to_json(") == 1
