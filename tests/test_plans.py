import pytest
from pyspark.errors import ParseException
from pyspark.sql import functions as F

from quillon import __main__ as cli
from quillon.catalog import INT, STRING, Catalog, Column
from quillon.errors import ConflictError, DuplicateObjectError, NoSuchObjectError, TypeMismatchError, UnsupportedError
from quillon.operators import dml
from quillon.plans.cost import JoinGraph, Predicate, best_plan, explain, one_line, rule_plan
from quillon.plans.joins import Hint, Input, JoinQuery, Size, join_hint
from quillon.plans.sql import Engine, read_joins
from quillon.sources.files import formatted, load_csvs
from quillon.sources.store import Store


def graph(rows, indexed, **more):
    links = [Predicate(k, k + 1) for k in range(len(rows) - 1)]
    return JoinGraph([f"T{k}" for k in range(len(rows))], rows, links, {k: [("id",)] for k in indexed}, 100, untracked=True, **more)


def test_two_tables():
    g = graph([1000, 10000], [1])
    assert (rule_plan(g).cost, best_plan(g).cost, one_line(best_plan(g))) == (12000, 11000, "(T1 HashJoin T0)")


@pytest.mark.parametrize("n", range(2, 8))
def test_chains(n):
    g = graph([150_000] * n, range(n))
    assert (rule_plan(g).cost, best_plan(g).cost) == (600_000 * n - 480_000, 270_000 * n - 240_000)


def test_skewed_and_mixed():
    g = graph([25, 100_000, 150_000, 1_500_000], range(4))
    assert (rule_plan(g).cost, rule_plan(g, [3, 2, 1, 0]).cost, best_plan(g).cost) == (2_200_100, 17_568_000, 1_930_100)
    assert one_line(best_plan(g)) == "(((T0 IndexNestedLoopJoin T1) HashJoin T2) HashJoin T3)"
    sizes = [50, 1_000_000, 1_000_000, 40_000]
    assert rule_plan(graph(sizes, range(4))).cost == 8_640_200
    mixed = best_plan(graph(sizes, [0, 1, 3], sorted_inputs=True))
    assert (mixed.cost, one_line(mixed)) == (2_760_200, "(((T0 IndexNestedLoopJoin T3) IndexNestedLoopJoin T1) SortMergeJoin T2)")


def test_no_cross_products_where_predicates_are():
    g = JoinGraph(["a", "b", "c"], [10, 1000, 20], [Predicate(0, 1, True, "x", "y"), Predicate(1, 2, True, "y", "z")])
    order = best_plan(g).order()
    assert set(order[:2]) != {0, 2}
    assert best_plan(JoinGraph(["a", "b", "c"], [1, 1, 1], [Predicate(0, 1)])) is None
    assert best_plan(JoinGraph(["a", "b"], [3, 4], [])).algorithm == "BlockNestedLoopJoin"
    assert best_plan(JoinGraph(["a", "b"], [0, -1], [])).rows == 1


def test_explain_marks_the_choice():
    g = graph([1000, 10000], [1])
    told = explain(g, best_plan(g))
    assert "total_cost: 11000.00" in told and "* HashJoin" in told and "not applicable" in told


@pytest.fixture(scope="module")
def engine(spark):
    own = Engine(spark)
    for name, rows, schema in (
        ("region", [(1, "N"), (2, "S")], "r_id long, r_name string"),
        ("customer", [(k, k % 2 + 1, f"c{k}") for k in range(40)], "c_id long, c_region long, c_name string"),
        ("orders", [(k, k % 40, k * 10) for k in range(400)], "o_id long, o_customer long, amount long"),
    ):
        own.spark.createDataFrame(rows, schema).createOrReplaceTempView(name)
    return own


JOINED = "SELECT * FROM orders o JOIN customer c ON o.o_customer = c.c_id JOIN region r ON r_id = c_region WHERE o.amount > 100 AND (c.c_name = 'c7' OR r.r_name = 'N') AND o_id BETWEEN 5 AND 300"


def test_reordered_sql_gives_the_same_rows_and_columns(engine):
    plain, best = engine.sql(JOINED), engine.cbo(JOINED)
    assert plain.columns == best.columns
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, best.collect()))
    assert "FROM region r, customer c, orders o WHERE" in engine.reordered(JOINED)
    assert "Best left-deep plan" in engine.joinopt(JOINED)
    assert "best join cost" in engine.cost_report(JOINED)


#: Conditions over orders (o_id, o_customer, amount), customer (c_id, c_region, c_name) and region (r_id, r_name).
CONDITIONS = [
    "o.amount > 1e2", "o.amount > 1.5E+2", "o.amount < .5e3", "o.amount == 100", "o.o_id >> 2 = 5", "o.o_id << 1 < 50", "o.o_id >>> 1 > 20", "o.amount <> 100", "o.amount != 100", "o.o_id <=> 7",
    "o.o_id < 9 OR c.c_id = 3", "o.o_id < 9 OR c.c_id = 3 AND r.r_id = 1", "c.c_id = 1 AND o.o_id > 5 OR c.c_id = 2 AND o.o_id < 100", "(o.o_id < 9 OR c.c_id = 3) AND r.r_id = 1", "NOT (o.o_id < 9 OR c.c_id = 3)", "NOT o.o_id < 9 AND r.r_id = 1",
    "NOT o.o_id < 9 OR r.r_id = 1", "o.o_id BETWEEN 5 AND 50", "o.o_id BETWEEN 5 AND 50 AND c.c_id < 7", "o.o_id NOT BETWEEN 5 AND 50 OR c.c_id < 7", "o.o_id BETWEEN 5 AND 50 OR c.c_id BETWEEN 1 AND 3 AND r.r_id = 1",
    "CASE WHEN o.o_id > 5 AND c.c_id < 9 OR r.r_id = 1 THEN true ELSE false END", "CASE WHEN o.o_id > 5 THEN 1 ELSE 0 END = 1 AND c.c_id < 9", "c.c_name LIKE 'c%1' AND o.o_id < 40", "c.c_name = 'c''7' OR c.c_name = 'c7'", "c.c_name = 'c\\'7' OR r.r_id = 1",
    "c.c_name = 'a AND b' OR o.o_id = 3", "c.c_name <> 'x OR y' AND o.o_id = 3", "o.o_id IN (1, 2, 3) OR c.c_id IN (4, 5)", "o.o_id IN (SELECT c_id FROM customer WHERE c_id < 9 OR c_id = 11)", "EXISTS (SELECT 1 FROM region WHERE r_id = c.c_region AND r_id = 1) OR o.o_id = 2",
    "o.o_id IS DISTINCT FROM 4 AND c.c_id < 5", "o.o_id IS NOT DISTINCT FROM 4 OR c.c_id < 2", "o.amount IS NULL OR o.o_id < 5", "o.amount IS NOT NULL AND o.o_id < 5", "o.o_id / 2 = 10 OR c.c_id = 3", "o.o_id % 7 = 1 AND c.c_id % 2 = 1", "-o.o_id < -50 AND +c.c_id > 3",
    "o.o_id - 1 > 5 /* AND c.c_id = 9 */ AND c.c_id < 4", "o.o_id > 5 -- OR c.c_id = 9\n AND c.c_id < 4", "`o`.`o_id` < 10 OR `c`.c_id = 2", "o.o_id < 10L AND c.c_id > 1S", "o.amount < 100.5BD OR c.c_id = 2", "o.amount < 1e2D AND c.c_id = 2", "coalesce(o.o_id, 0) < 10 AND c.c_id > 1",
    "((o.o_id < 10) AND (c.c_id > 1)) OR ((r.r_id = 1))", "(o.o_id < 10 AND c.c_id > 1 OR r.r_id = 1)", "o.o_id & 3 = 1 AND c.c_id | 1 = 3", "o.o_id ^ 3 > 9 OR ~c.c_id = -3", "c.c_name || 'x' = 'c7x' OR o.o_id = 1", "CAST(o.o_id AS STRING) = '7' OR o.o_id::string = '8'", "true OR false AND o.o_id = 1", "o.o_id = 1 OR NOT c.c_id = 2 AND NOT r.r_id = 1",
]


@pytest.mark.parametrize("place", ["WHERE", "ON"])
def test_reordering_keeps_the_meaning_of_conditions(engine, place):
    joined = "SELECT o.o_id, c.c_id, r.r_id FROM orders o JOIN customer c ON o.o_customer = c.c_id JOIN region r ON r.r_id = c.c_region"
    for condition in CONDITIONS:
        query = f"{joined} WHERE {condition}" if place == "WHERE" else f"{joined} AND ({condition})"
        assert sorted(map(tuple, engine.sql(query).collect())) == sorted(map(tuple, engine.cbo(query).collect())), condition
        assert len(read_joins(engine.dialect(query)).conditions) >= 3 or place == "ON"


def test_a_number_and_a_string_do_not_compare(engine):
    for query in ("SELECT * FROM orders WHERE o_id = 'a'", "SELECT * FROM orders o JOIN customer c ON o.o_id = c.c_name", "SELECT c_name < 3 AS x FROM customer"):
        with pytest.raises(TypeMismatchError):
            engine.sql(query)
    assert engine.sql("SELECT * FROM orders WHERE CAST(o_id AS STRING) = '7' AND o_id = NULL").count() == 0


def test_no_large_side_is_sent_or_hashed_whole(spark):
    def chain(rows):
        inputs = [Input(f"t{k}", spark.range(10).select(F.col("id").alias("a"), F.col("id").alias("b")).repartition(3), (), n) for k, n in enumerate(rows)]
        out = JoinQuery(*inputs)
        for k in range(len(rows) - 1):
            out.on(f"t{k}", "b", f"t{k + 1}", "a")
        return out.dataframe()._jdf.queryExecution().optimizedPlan().toString()

    small = chain((5, 25, 1500))
    assert small.count("broadcast") == 2 and "shuffle_hash" not in small
    large = chain((10**9, 25, 1500))  # the small ones are sent, never what holds the large one
    assert large.count("strategy=broadcast") == 2
    none = chain((10**9, 10**9, 10**9))
    assert "strategy" not in none
    assert join_hint("HashJoin", Size(10**9, width=8), Size(10**8, width=8), 200) == Hint("shuffle_hash", True)
    assert join_hint("HashJoin", Size(10**8, width=8), Size(10**9, width=8), 200) == Hint("shuffle_hash", False)


def test_what_has_no_join_order_runs_as_written(engine):
    for q in ("SELECT * FROM orders o LEFT JOIN customer c ON o.o_customer = c.c_id", "SELECT s.o_id FROM (SELECT o_id FROM orders) s", "SELECT o_id FROM orders UNION SELECT c_id FROM customer"):
        with pytest.raises(UnsupportedError):
            read_joins(q)
        assert engine.cbo(q).count() == engine.sql(q).count()


def test_dialect(engine):
    told = engine.sql("SELECT 7 / 2 AS q, -7 / 2 AS m, 5 / 0 AS z, 5 % 0 AS y, 1 = 1 AS t, 9223372036854775807 + 1 AS w FROM region WHERE 42").collect()
    assert [tuple(r) for r in told] == [(3, -3, None, None, 1, -(1 << 63))] * 2
    assert engine.sql("SELECT 'a / b' AS s FROM region LIMIT 1").first()[0] == "a / b"
    assert "Scan" in engine.explain("SELECT * FROM orders") and "(2 rows)" in engine.run("SELECT * FROM region")


def test_join_query_keeps_columns_in_order(spark):
    a = Input("a", spark.createDataFrame([(k, k) for k in range(50)], "x long, y long"))
    b = Input("b", spark.createDataFrame([(k % 5, k) for k in range(20)], "x long, z long"), (("x",),))
    d = Input("d", spark.createDataFrame([(k, k) for k in range(3)], "z long, w long"))
    query = JoinQuery(a, b, d).on("a", "x", "b", "x").on("b", "z", "d", "z")
    assert query.dataframe().columns == ["x", "y", "x", "z", "z", "w"]
    assert sorted(map(tuple, query.dataframe().collect())) == sorted(map(tuple, query.dataframe(reorder=False).collect()))


def test_catalog(tmp_path):
    catalog = Catalog(str(tmp_path / "catalog.json"))
    table = catalog.add_table("t", [Column("a", INT), Column("b", STRING)])
    index = catalog.add_index("i", "t", "btree", ["A"])
    catalog.save()
    again = Catalog.load(catalog.path)
    assert again.table("t") == table and again.index_by_oid(index.oid) == index and again.next_oid == catalog.next_oid
    assert [t.name for t in again.tables_with_column("B")] == ["t"] and again.table_by_oid(table.oid).schema.names == ["a", "b"]
    with pytest.raises(DuplicateObjectError):
        again.add_table("t", [])
    with pytest.raises(DuplicateObjectError):
        again.add_index("i", "t", "hash", ["a"])
    with pytest.raises(NoSuchObjectError):
        again.add_index("j", "t", "hash", ["z"])
    with pytest.raises(NoSuchObjectError):
        again.index_by_oid(99)


def test_store_and_statements(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    catalog = Catalog()
    table = catalog.add_table("kv", [Column("k", INT), Column("v", STRING)])
    store.create("kv", table.schema)
    (tmp_path / "kv.csv").write_text('1,"a,b"\n2,"say ""x"""\n')
    (tmp_path / "other.csv").write_text("1\n")
    assert load_csvs(spark, catalog, [f"file://{tmp_path}/kv.csv", f"file://{tmp_path}/other.csv"], store) == {"kv": 2}
    engine = Engine(spark, store, catalog)
    count = lambda s: engine.execute(s).first()[0]
    assert count("INSERT INTO kv VALUES (3, 'c'), (4, 'd')") == 2
    assert count("INSERT INTO kv (k) SELECT k + 10 FROM kv") == 4
    assert count("UPDATE kv SET v = concat(v, '!'), k = k + 0 WHERE k < 3") == 2
    assert count("DELETE FROM kv WHERE k > 10 ORDER BY k DESC LIMIT 1") == 1
    for nothing in ("v = 'nothing'", "k >= 1e3", "k == 99 -- none", "k >> 1 = 77", "k % 1"):
        assert count(f"DELETE FROM kv WHERE {nothing}") == 0
    assert count("UPDATE kv SET v = v WHERE k % 2") == 4 and count("UPDATE kv SET k = k WHERE k >= 1.1e1") == 3
    for garbage in ("DELETE FROM kv WHER k = 1", "DELETE FROM kv x", "DELETE FROM kv WHERE k = 1 LIMIT 1 x", "DELETE FROM kv WHERE", "UPDATE kv SET k", "INSERT INTO kv", "DELETE kv", "DELETE FROM kv ORDER k LIMIT 1"):
        with pytest.raises(UnsupportedError):
            engine.execute(garbage)
    for garbage in ("DELETE FROM kv WHERE k = 1 x", "UPDATE kv SET k = 1 y", "UPDATE kv SET v = 'q' WHERE k >= 1 e3"):
        with pytest.raises(ParseException):
            engine.execute(garbage)
    assert sorted(map(tuple, store.table("kv").collect()), key=lambda r: r[0]) == [(1, "a,b!"), (2, 'say "x"!'), (3, "c"), (4, "d"), (11, None), (12, None), (13, None)]
    assert "NULL(string)" in engine.run("SELECT * FROM kv ORDER BY k")
    for statement in ("UPDATE kv SET v = 'x' LIMIT 1", "CREATE TABLE x (a INT)", ""):
        with pytest.raises(UnsupportedError):
            engine.execute(statement)
    one, two = store.begin(), store.begin()
    one.delete("kv")
    two.insert("kv", spark.createDataFrame([(9, "z")], "k long, v string"))
    one.commit()
    with pytest.raises(ConflictError):
        two.commit()
    assert store.table("kv").count() == 0 and store.vacuum() == 0 and store.vacuum(older_than=-1) > 0
    with pytest.raises(RuntimeError), store.begin() as t:
        t.insert("kv", spark.createDataFrame([(9, "z")], "k long, v string"))
        raise RuntimeError
    assert store.table("kv").count() == 0 and store.tables() == ["kv"]


def test_delete_with_limit_tells_equal_rows_by_number(spark):
    rows = [(1, "a"), (1, "a"), (1, "a"), (2, None), (2, None), (None, None), (3, "b")]
    table = spark.createDataFrame(rows, "k long, v string").repartition(3)
    left, affected = dml.delete(table, F.col("v").isNull() | (F.col("k") == 1), [F.col("k").asc_nulls_first(), F.col("v")], 3)
    assert affected.first()[0] == 3 and sorted(map(tuple, left.collect()), key=str) == sorted([(1, "a"), (2, None), (2, None), (3, "b")], key=str)


def test_command_line(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    catalog = Catalog("catalog.json")
    catalog.add_table("kv", [Column("k", INT), Column("v", STRING)])
    catalog.save()
    (tmp_path / "kv.csv").write_text("1,a\n2,b\n")
    flags = ["-db", f"file://{tmp_path}/store"]
    assert cli.load(spark, cli.arguments(["load", *flags, f"file://{tmp_path}/kv.csv", "file:///no.csv"])) == ["kv: 2 rows", "file:///no.csv: no such table"]
    assert cli.load(spark, cli.arguments(["load", *flags, "-truncate", f"file://{tmp_path}/kv.csv"])) == ["kv: 2 rows"]
    lines = ["help", "", "SELECT k", "  FROM kv WHERE k = 2;", "SELECT nothing FROM kv;", "cbo SELECT a.k FROM kv a JOIN kv b ON a.k = b.k;", "joinopt SELECT a.k FROM kv a JOIN kv b ON a.k = b.k;", "tables;", "DELETE FROM kv;", "exit", "SELECT 1;"]
    told = list(cli.shell(spark, cli.arguments(["shell", *flags]), lines))
    assert len(told) == 7 and "joinopt" in told[0] and "(1 rows)" in told[1] and told[2].startswith("error: ") and "best join cost" in told[3] and "Steps" in told[4] and told[5] == "kv(k bigint, v string)" and "2" in told[6]


def test_formatting(spark):
    told = formatted(spark.createDataFrame([(1, "a"), (None, None)], "n long, s string"))
    assert told.splitlines() == ["n          s", '1          "a"', "NULL(int)  NULL(string)", "(2 rows)"]


def test_whole_outer_joins_have_unmatched_rows(spark):
    import __spark_entry__

    sf_dir = "/root/testdata/sf0.01"
    for name in ("nation", "orders"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    for how in ("left", "right", "full"):
        name = f"join_{how}"
        got = sorted(map(tuple, __spark_entry__.queries()[name](spark, sf_dir).collect()), key=str)
        assert got == sorted(map(tuple, spark.sql(__spark_entry__.oracle_sql()[name]).collect()), key=str)
        assert any(x[1] is None for x in got) == (how != "right") and any(x[0] is None for x in got) == (how != "left")
