import itertools

import pytest
from pyspark.sql import functions as F

from quillon.errors import NoSuchObjectError, TypeMismatchError, UnsupportedError
from quillon.operators import dml, indexes
from quillon.operators import relational as R


@pytest.fixture(scope="module")
def sales(spark):
    rows = [(i, 200 * i, 100 * i, "US" if i % 2 == 0 else "EU", ["Electronics", "Books", "Clothing"][i % 3]) for i in range(6)]
    return spark.createDataFrame(rows, "sale_id long, revenue long, cost long, region string, category string")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def naive(left, right, how="inner"):
    out, seen = [], set()
    for a in left:
        hits = [(k, b) for k, b in enumerate(right) if a[0] is not None and a[0] == b[0]]
        seen |= {k for k, _ in hits}
        out += [(*a, *b) for _, b in hits] or ([(*a, None, None)] if how in ("left", "full") else [])
    if how in ("right", "full"):
        out += [(None, None, *b) for k, b in enumerate(right) if k not in seen]
    return sorted(out, key=str)


SIDES = {
    "basic": ([(1, "a"), (2, "b"), (3, "c"), (4, "d")], [(1, "x"), (3, "y"), (6, "z")]),
    "nulls": ([(1, "a"), (None, "b")], [(1, "x"), (None, "y")]),
    "duplicates": ([(1, "a"), (1, "b"), (1, "c"), (2, "d"), (3, "e")], [(1, "x"), (1, "y"), (2, "z"), (4, "w")]),
    "empty both": ([], []),
    "empty left": ([], [(1, "x")]),
    "empty right": ([(1, "a")], []),
    "large": ([(k % 97, str(k)) for k in range(500)], [(k % 89, str(k)) for k in range(400)]),
}


@pytest.mark.parametrize("case", SIDES)
@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_join_matrix(spark, case, how):
    left, right = SIDES[case]
    a, b = spark.createDataFrame(left, "k long, v string"), spark.createDataFrame(right, "j long, w string")
    assert rows_of(R.join(a, b, a["k"] == b["j"], how)) == naive(left, right, how)


@pytest.mark.parametrize(("strategy", "node"), [("hash", "ShuffledHashJoin"), ("merge", "SortMergeJoin"), ("broadcast", "BroadcastHashJoin"), ("nested_loop", "CartesianProduct")])
def test_join_strategies(spark, strategy, node):
    left, right = SIDES["duplicates"]
    a, b = spark.createDataFrame(left, "k long, v string"), spark.createDataFrame(right, "j long, w string")
    out = R.join(a, b, a["k"] == b["j"], strategy=strategy)
    assert rows_of(out) == naive(left, right)
    assert node in out._jdf.queryExecution().toString()


def test_composite_keys_theta_and_semi(spark):
    t1 = spark.createDataFrame([(1, 10, "a"), (1, 20, "b"), (2, 10, "c")], "a long, b long, v string")
    t2 = spark.createDataFrame([(1, 10, "x"), (1, 30, "y")], "c long, d long, w string")
    assert rows_of(R.join(t1, t2, (t1["a"] == t2["c"]) & (t1["b"] == t2["d"]))) == [(1, 10, "a", 1, 10, "x")]
    assert R.join(t1, t2, t1["b"] < t2["d"]).count() == sum(x < y for x, y in itertools.product([10, 20, 10], [10, 30]))
    assert rows_of(R.join(t1, t2, t1["a"] == t2["c"], "semi")) == [(1, 10, "a"), (1, 20, "b")]
    assert rows_of(R.join(t1, t2, t1["a"] == t2["c"], "anti")) == [(2, 10, "c")]
    assert len(R.join_using(t1.select("a"), t1.select("a"), ["a"]).columns) == 2


def test_aggregates(spark):
    df = spark.createDataFrame([("US", 100), (None, 200), (None, 300), ("US", None)], "g string, x long")
    out = R.aggregate(df, ["g"], F.sum("x").alias("s"), F.count("x").alias("c"), R.count_rows().alias("n"))
    assert rows_of(out) == [("US", 100, 1, 2), (None, 500, 2, 2)]
    none = df.filter("x < 0")
    assert rows_of(R.aggregate(none, [], F.sum("x").alias("s"))) == [(None,)]
    assert rows_of(R.aggregate(none, [], F.sum("x").alias("s"), empty_row=False)) == []
    assert rows_of(R.aggregate(df, ["g"], R.count_rows().alias("n"), F.sum("x").alias("s"), having=F.col("s") > 400)) == [(None, 2, 500)]
    assert rows_of(R.aggregate(spark.createDataFrame([("Banana",), ("Apple",), ("Zebra",)], "s string"), [], F.min("s"), F.max("s"))) == [("Apple", "Zebra")]


def test_sort_limit_top(sales):
    rows = sales.filter("sale_id > 0")
    assert [tuple(r) for r in R.sort(rows, F.col("region"), F.col("revenue").desc()).select("region", "revenue").collect()] == [("EU", 1000), ("EU", 600), ("EU", 200), ("US", 800), ("US", 400)]
    assert [r[0] for r in R.top_n(sales, 3, F.col("revenue")).select("revenue").collect()] == [0, 200, 400]
    assert [r[0] for r in R.top_n(sales, 2, F.col("revenue"), offset=3).select("revenue").collect()] == [600, 800]
    assert "TakeOrderedAndProject" in R.top_n(sales, 3, F.col("revenue"))._jdf.queryExecution().toString()
    assert R.limit(sales, 100).count() == 6
    assert R.limit(sales, 0).count() == 0


def test_index_operations(spark, sales):
    back = indexes.range_scan(sales, ["region", "revenue"], ("US", 400), forward=False)
    assert [r[0] for r in back.select("sale_id").collect()] == [2, 0, 5, 3, 1]
    forward = indexes.range_scan(sales, ["region", "revenue"], ("EU", 600))
    assert [r[0] for r in forward.select("sale_id").collect()] == [3, 5, 0, 2, 4]
    whole = spark.createDataFrame([(1,), (None,), (3,)], "k long")
    assert [r[0] for r in indexes.range_scan(whole, ["k"]).collect()] == [None, 1, 3]
    assert [r[0] for r in indexes.range_scan(whole, ["k"], (3,), forward=False).collect()] == [3, 1]
    assert indexes.lookup(whole, {"k": None}).count() == 1
    assert indexes.lookup(whole, {"k": 3}).count() == 1


def test_filters_reach_the_scan(spark, sales, tmp_path):
    path = str(tmp_path / "sales")
    indexes.clustered(sales, path, ["sale_id"], 2)
    plan = indexes.lookup(spark.read.parquet(path), {"sale_id": 3}).select("revenue")._jdf.queryExecution().toString()
    assert "EqualTo(sale_id,3)" in plan
    assert "ReadSchema: struct<sale_id:bigint,revenue:bigint>" in plan


def test_dml(spark, sales):
    after, n = dml.update(sales, {"region": F.lit("CA"), "revenue": F.lit(9999)}, F.col("sale_id") == 1)
    assert n.first()[0] == 1
    assert tuple(after.filter("sale_id = 1").first()) == (1, 9999, 100, "CA", "Books")
    swapped, _ = dml.update(sales, {"revenue": F.col("cost"), "cost": F.col("revenue")})
    assert tuple(swapped.filter("sale_id = 2").select("revenue", "cost").first()) == (200, 400)
    nulls = spark.createDataFrame([(1,), (None,), (3,)], "k long")
    assert rows_of(dml.delete(nulls, F.col("k") > 2)[0]) == [(1,), (None,)]
    twice = spark.createDataFrame([(1,), (1,), (1,), (2,), (None,)], "k long")
    left, gone = dml.delete(twice, None, [F.col("k")], 3)
    assert (rows_of(left), gone.first()[0]) == ([(1,), (2,)], 3)
    own, n = dml.insert(sales, sales.filter("sale_id = 1"))
    assert (own.count(), n.first()[0]) == (7, 1)
    part, _ = dml.insert(nulls.withColumn("v", F.lit("x")), spark.createDataFrame([(9,)], "a long"), ["k"])
    assert part.filter("k = 9").first()["v"] is None
    with pytest.raises(TypeMismatchError):
        dml.insert(nulls, sales)
    with pytest.raises(NoSuchObjectError):
        dml.update(nulls, {"z": F.lit(1)})
    with pytest.raises(UnsupportedError):
        dml.delete(nulls, None, None, 1)
