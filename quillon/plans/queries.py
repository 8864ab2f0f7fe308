"""Registered queries of the relational engine and the SQL that must give the same rows.

Each query goes through the engine's own operators; the SQL is written apart from them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import INT, STRING, Catalog, Column
from ..functions import expressions as E
from ..operators import dml, indexes
from ..operators import relational as R
from ..sources.files import read_csv, scan, shared_folder, values
from ..sources.store import Store
from .joins import Input, JoinQuery
from .sql import Engine

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """tables.orders is the scan of orders."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return scan(self._spark, self._dir, name)


def query(name: str, oracle: str | None = None):
    """Registers a function of (tables) under a name; oracle: the same in SQL."""

    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLE[name] = oracle
        return build

    return register


# Columns are made inside functions only: importing this module needs no session.
def c(name: str):
    return F.col(name)


def agg_sum(column):
    return F.sum(column).cast("bigint")


def on_customer():
    return c("c_custkey") == c("o_custkey")



# ---------------------------------------------------------------- flagship

FLAGSHIP = """
SELECT c_mktsegment, COUNT(*) AS orders, CAST(SUM(o_orderkey) AS BIGINT) AS key_sum
FROM customer JOIN orders ON c_custkey = o_custkey
WHERE o_orderstatus = 'F' GROUP BY c_mktsegment ORDER BY orders DESC, c_mktsegment LIMIT 5
"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    done = R.where(t.orders, c("o_orderstatus") == "F").select("o_custkey", "o_orderkey")
    joined = R.join(done, t.customer.select("c_custkey", "c_mktsegment"), c("c_custkey") == c("o_custkey"))
    grouped = R.aggregate(joined, ["c_mktsegment"], R.count_rows().alias("orders"), agg_sum("o_orderkey").alias("key_sum"))
    return R.top_n(grouped, 5, c("orders").desc(), c("c_mktsegment"))


QUERIES["flagship"], ORACLE["flagship"] = flagship, FLAGSHIP

# ------------------------------------------------- scans, projection, filter

query("scan_nation", "SELECT * FROM nation")(lambda t: t.nation)
query("values_rows", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'a'), (2, 'b'), (3, NULL)) v(id, name)")(lambda t: values(t._spark, [(1, "a"), (2, "b"), (3, None)], "id long, name string"))
query("project_expr_alias", "SELECT o_orderkey AS k, o_orderkey + o_custkey AS total FROM orders")(lambda t: R.project(t.orders, k=c("o_orderkey"), total=E.add(c("o_orderkey"), c("o_custkey"))))
query("project_star", "SELECT * FROM customer")(lambda t: t.customer.select("*"))
query("project_qualified_star", "SELECT n.* FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r_name < 'B'")(lambda t: R.join(t.nation.alias("n"), t.region.alias("r"), c("n.n_regionkey") == c("r.r_regionkey")).filter(c("r_name") < "B").select("n.*"))
query("project_pred_as_int", "SELECT o_orderkey, CAST(o_orderstatus = 'F' AS BIGINT) AS f, CAST(NULLIF(o_custkey % 7, 0) > 3 AS BIGINT) AS g FROM orders")(
    lambda t: R.project(t.orders, "o_orderkey", f=E.as_int(c("o_orderstatus") == "F"), g=E.as_int(F.nullif(E.remainder(c("o_custkey"), E.integer(7)), E.integer(0)) > 3))
)
query("projection_fusion", "SELECT o_orderkey * 2 + 1 AS x FROM orders")(lambda t: t.orders.select(E.multiply(c("o_orderkey"), E.integer(2)).alias("y")).select(E.add(c("y"), E.integer(1)).alias("x")))
for name, sign, test in (("eq", "=", lambda a, b: a == b), ("ne", "<>", lambda a, b: a != b), ("gt", ">", lambda a, b: a > b), ("lt", "<", lambda a, b: a < b), ("ge", ">=", lambda a, b: a >= b), ("le", "<=", lambda a, b: a <= b)):
    query(f"filter_{name}", f"SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey {sign} 100")(lambda t, test=test: R.where(t.orders, test(c("o_custkey"), E.integer(100))).select("o_orderkey", "o_custkey"))
query("filter_string", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus <> 'O'")(lambda t: t.lineitem.filter((c("l_returnflag") == "R") & (c("l_linestatus") != "O")).select("l_orderkey", "l_linenumber"))
query("filter_truthy", "SELECT o_orderkey FROM orders WHERE o_custkey % 3 <> 0")(lambda t: t.orders.filter(E.truthy(E.remainder(c("o_custkey"), E.integer(3)))).select("o_orderkey"))

_NULLS = "SELECT o_orderkey, NULLIF(o_custkey % 7, 0) AS a, NULLIF(o_custkey % 5, 0) AS b FROM orders"


def with_nulls(t: Tables) -> DataFrame:
    left = lambda n: F.nullif(E.remainder(c("o_custkey"), E.integer(n)), E.integer(0))
    return t.orders.select("o_orderkey", left(7).alias("a"), left(5).alias("b"))


query("filter_and_or_not_3vl", f"SELECT * FROM ({_NULLS}) WHERE (a > 3 AND b > 2) OR NOT (a > 5)")(lambda t: with_nulls(t).filter(((c("a") > 3) & (c("b") > 2)) | ~(c("a") > 5)))
query("three_valued_logic", f"SELECT o_orderkey, CAST(a > 3 AND b > 2 AS BIGINT) AS both_, CAST(a > 3 OR b > 2 AS BIGINT) AS any_, CAST(NOT (a > 3) AS BIGINT) AS not_ FROM ({_NULLS})")(
    lambda t: with_nulls(t).select("o_orderkey", E.as_int((c("a") > 3) & (c("b") > 2)).alias("both_"), E.as_int((c("a") > 3) | (c("b") > 2)).alias("any_"), E.as_int(~(c("a") > 3)).alias("not_"))
)
query("is_null", f"SELECT o_orderkey FROM ({_NULLS}) WHERE a IS NULL")(lambda t: with_nulls(t).filter(c("a").isNull()).select("o_orderkey"))
query("is_not_null", f"SELECT o_orderkey, a FROM ({_NULLS}) WHERE a IS NOT NULL")(lambda t: with_nulls(t).filter(c("a").isNotNull()).select("o_orderkey", "a"))

# ------------------------------------------------------------- expressions

query("arith_add_sub_mul", "SELECT o_orderkey, o_orderkey + o_custkey AS s, o_orderkey - o_custkey AS d, o_orderkey * o_custkey AS p FROM orders")(
    lambda t: R.project(t.orders, "o_orderkey", s=E.add(c("o_orderkey"), c("o_custkey")), d=E.subtract(c("o_orderkey"), c("o_custkey")), p=E.multiply(c("o_orderkey"), c("o_custkey")))
)
query("arith_wraparound", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(-9223372036854775808 AS BIGINT), CAST(9223372036854775807 AS BIGINT), CAST(-2 AS BIGINT))) v(id, s, d, p)")(
    lambda t: values(t._spark, [(1, (1 << 63) - 1)], "id long, m long").select("id", E.add(c("m"), E.integer(1)).alias("s"), E.subtract(E.subtract(E.integer(0), c("m")), E.integer(2)).alias("d"), E.multiply(c("m"), E.integer(2)).alias("p"))
)
query("int_div", "SELECT o_orderkey, (o_orderkey - 5000) // 7 AS q FROM orders")(lambda t: R.project(t.orders, "o_orderkey", q=E.divide(E.subtract(c("o_orderkey"), E.integer(5000)), E.integer(7))))
query("int_mod", "SELECT o_orderkey, (o_orderkey - 5000) % 7 AS r FROM orders")(lambda t: R.project(t.orders, "o_orderkey", r=E.remainder(E.subtract(c("o_orderkey"), E.integer(5000)), E.integer(7))))
query("div_zero_null", "SELECT o_orderkey, o_orderkey // NULLIF(o_custkey % 3, 0) AS q FROM orders")(lambda t: R.project(t.orders, "o_orderkey", q=E.divide(c("o_orderkey"), E.remainder(c("o_custkey"), E.integer(3)))))
query("mod_zero_null", "SELECT o_orderkey, o_orderkey % NULLIF(o_custkey % 3, 0) AS r FROM orders")(lambda t: R.project(t.orders, "o_orderkey", r=E.remainder(c("o_orderkey"), E.remainder(c("o_custkey"), E.integer(3)))))
query("concat", "SELECT c_custkey, c_name || c_mktsegment AS s, c_name || NULLIF(c_mktsegment, 'BUILDING') AS n FROM customer")(lambda t: R.project(t.customer, "c_custkey", s=E.concat(c("c_name"), c("c_mktsegment")), n=E.concat(c("c_name"), F.nullif(c("c_mktsegment"), E.string("BUILDING")))))
for name, pattern in (("prefix", "Customer#00000%"), ("contains", "%77%"), ("underscore", "Customer#______1_1")):
    query(f"like_{name}", f"SELECT c_custkey FROM customer WHERE c_name LIKE '{pattern}' ESCAPE '\\'")(lambda t, pattern=pattern: t.customer.filter(E.like(c("c_name"), pattern)).select("c_custkey"))

query("like_escape", "SELECT c_custkey FROM customer WHERE c_name || '_' || c_mktsegment LIKE '%\\_B%' ESCAPE '\\'")(lambda t: t.customer.filter(E.like(E.concat(E.concat(c("c_name"), E.string("_")), c("c_mktsegment")), "%\\_B%")).select("c_custkey"))

# ------------------------------------------------------------------- joins

_PAIR = "SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey"
for name, strategy in (("hash", "hash"), ("merge", "merge"), ("index_nl", "broadcast")):
    query(f"join_{name}", _PAIR)(lambda t, strategy=strategy: R.join(t.orders.select("o_orderkey", "o_custkey"), t.customer.select("c_custkey", "c_name"), on_customer(), strategy=strategy).select("o_orderkey", "c_name"))
query("join_inner", _PAIR)(lambda t: R.join(t.orders, t.customer, on_customer()).select("o_orderkey", "c_name"))
query("join_bnl_theta", "SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey < n_nationkey")(lambda t: R.join(t.supplier, t.nation, c("s_nationkey") < c("n_nationkey"), strategy="broadcast").select("s_suppkey", "n_nationkey"))
query("join_using", "SELECT a.n_nationkey, a.n_name, b.n_nationkey AS right_key FROM nation a JOIN nation b USING (n_nationkey)")(lambda t: R.join_using(a := t.nation, b := t.nation.select("n_nationkey"), ["n_nationkey"]).select(a["n_nationkey"], a["n_name"], b["n_nationkey"].alias("right_key")))
query("join_cross", "SELECT n_name, r_name FROM nation, region")(lambda t: R.join(t.nation, t.region, None).select("n_name", "r_name"))
query("join_comma_where", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")(lambda t: R.join(t.nation, t.region, None).filter(c("n_regionkey") == c("r_regionkey")).select("n_name", "r_name"))
# Whole tables: nations whose key is over 6 or 0, and orders without a key, are unmatched.
for name in ("left", "right", "full"):
    query(f"join_{name}", f"SELECT n_nationkey, o_orderkey FROM nation {name.upper()} JOIN ({_NULLS}) x ON n_nationkey = x.a")(
        lambda t, how=name: R.join(t.nation, with_nulls(t), c("n_nationkey") == c("a"), how).select("n_nationkey", "o_orderkey")
    )
query("join_self", "SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")(
    lambda t: R.join(t.supplier.alias("a"), t.supplier.alias("b"), (c("a.s_nationkey") == c("b.s_nationkey")) & (c("a.s_suppkey") < c("b.s_suppkey"))).select(c("a.s_suppkey").alias("x"), c("b.s_suppkey").alias("y"))
)
query("join_multi_key", "SELECT a.l_orderkey, a.l_linenumber, b.l_quantity FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE a.l_returnflag = 'A'")(
    lambda t: R.join(t.lineitem.alias("a"), t.lineitem.alias("b"), (c("a.l_orderkey") == c("b.l_orderkey")) & (c("a.l_linenumber") == c("b.l_linenumber"))).filter(c("a.l_returnflag") == "A").select("a.l_orderkey", "a.l_linenumber", "b.l_quantity")
)
query("join_residual", "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND o_custkey < l_partkey")(lambda t: R.join(t.orders, t.lineitem, (c("o_orderkey") == c("l_orderkey")) & (c("o_custkey") < c("l_partkey"))).select("o_orderkey", "l_linenumber"))
query("join_null_keys", f"SELECT x.o_orderkey, n_name FROM ({_NULLS}) x JOIN nation ON x.a = n_nationkey")(lambda t: R.join(with_nulls(t), t.nation, c("a") == c("n_nationkey")).select("o_orderkey", "n_name"))
query("join_null_safe", f"SELECT x.o_orderkey, y.k FROM ({_NULLS}) x JOIN (VALUES (CAST(1 AS BIGINT), 'one'), (NULL, 'none')) y(a, k) ON x.a IS NOT DISTINCT FROM y.a")(lambda t: R.join_null_safe(with_nulls(t), values(t._spark, [(1, "one"), (None, "none")], "a long, k string"), [("a", "a")]).select("o_orderkey", "k"))

# ------------------------------------------------- cost-based join ordering

_CHAIN = [("region", None, None), ("nation", "r_regionkey", "n_regionkey"), ("customer", "n_nationkey", "c_nationkey"), ("orders", "c_custkey", "o_custkey"), ("lineitem", "o_orderkey", "l_orderkey"), ("part", "l_partkey", "p_partkey")]
_COLUMNS = {"region": "r_regionkey r_name", "nation": "n_nationkey n_regionkey", "customer": "c_custkey c_nationkey", "orders": "o_orderkey o_custkey", "lineitem": "l_orderkey l_linenumber l_partkey", "part": "p_partkey p_brand"}


def chain(t: Tables, n: int, reverse: bool = False) -> JoinQuery:
    names = [x for x, _, _ in _CHAIN[:n]]
    inputs = [Input(x, getattr(t, x).select(*_COLUMNS[x].split()), ((_COLUMNS[x].split()[0],),)) for x in names]
    out = JoinQuery(*(inputs[::-1] if reverse else inputs))
    for (a, _, _), (b, x, y) in zip(_CHAIN, _CHAIN[1:n]):
        out.on(a, x, b, y)
    return out


for _n in range(2, 7):
    _from = " JOIN ".join(x if y is None else f"{x} ON {y} = {z}" for x, y, z in _CHAIN[:_n])
    query(f"cbo_chain_{_n}", f"SELECT {', '.join(col for x, _, _ in _CHAIN[:_n] for col in _COLUMNS[x].split())} FROM {_from}")(lambda t, n=_n: chain(t, n).dataframe())
query("cbo_skewed", f"SELECT r_name, COUNT(*) AS n FROM {' JOIN '.join(x if y is None else f'{x} ON {y} = {z}' for x, y, z in _CHAIN[:5])} GROUP BY r_name")(lambda t: chain(t, 5, reverse=True).dataframe().groupBy("r_name").agg(F.count("*").alias("n")))
#: Rows of the tables of cbo_explain.
_SKEWED = (25, 100_000, 150_000, 1_500_000)
#: What the fixed formulas give for these sizes: an index join from 25 rows, then hash joins, at 1930100 in all.
_EXPLAINED = """
Best left-deep plan
(((T0 IndexNestedLoopJoin T1) HashJoin T2) HashJoin T3)

Summary
  total_cost: 1930100.00
  output_rows: 1200000.00
  joins: 3

Tree
  HashJoin (cost=1930100.00, rows=1200000.00)
    HashJoin (cost=310100.00, rows=120000.00)
      IndexNestedLoopJoin (cost=80100.00, rows=80000.00)
        Scan T0 (rows=25.00)
        Scan T1 (rows=100000.00)
      Scan T2 (rows=150000.00)
    Scan T3 (rows=1500000.00)

Steps
  1. {T0} with T1
   * IndexNestedLoopJoin  cost=80100.00
     SortMergeJoin        cost=1761105.14
     HashJoin             cost=100025.00
     BlockNestedLoopJoin  cost=100025.00
  2. {T0, T1} with T2
     IndexNestedLoopJoin  cost=440000.00
     SortMergeJoin        cost=4112207.44
   * HashJoin             cost=230000.00
     BlockNestedLoopJoin  cost=120080000.00
  3. {T0, T1, T2} with T3
     IndexNestedLoopJoin  cost=1680000.00
     SortMergeJoin        cost=34419517.59
   * HashJoin             cost=1620000.00
     BlockNestedLoopJoin  cost=1800120000.00
""".strip("\n").split("\n")


@query("cbo_explain", f"SELECT * FROM (VALUES {', '.join(f'({k}, {chr(39)}{x}{chr(39)})' for k, x in enumerate(_EXPLAINED))}) v(line, told)")
def _(t: Tables) -> DataFrame:
    """Four tables of given sizes in a chain: the text names each table, its join and the costs."""
    out = JoinQuery(*[Input(f"T{k}", t.region.select(c("r_regionkey").alias("a")), (("a",),), n) for k, n in enumerate(_SKEWED)])
    for k in range(len(_SKEWED) - 1):
        out.on(f"T{k}", "a", f"T{k + 1}", "a")
    return values(t._spark, [(k, line) for k, line in enumerate(out.explain().split("\n"))], "line int, told string")


_CBO_SQL = "SELECT r_name, COUNT(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey, region WHERE n_regionkey = r_regionkey AND o_orderstatus = 'F' GROUP BY r_name"


def engine_over(t: Tables, *names: str) -> Engine:
    engine = Engine(t._spark)
    for name in names:
        engine.register(name, f"{t._dir}/{name}.parquet")
    return engine


query("cbo_sql", _CBO_SQL)(lambda t: engine_over(t, "lineitem", "orders", "customer", "nation", "region").cbo(_CBO_SQL))

_OR_SQL = "SELECT c_custkey, o_orderkey FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE c.c_nationkey = 1 OR c.c_nationkey = 2 AND o.o_orderkey < 100"
query("cbo_sql_or", _OR_SQL)(lambda t: engine_over(t, "orders", "customer").cbo(_OR_SQL))
_SIGNS = "SELECT c_custkey, o_orderkey FROM customer c JOIN orders o ON c.c_custkey == o.o_custkey WHERE o.o_orderkey < {} AND c.c_nationkey <> 2 AND o.o_custkey {} 2 >= 5 AND o.o_orderkey <= .5E+3"
query("cbo_sql_operators", _SIGNS.format("1e3", ">>"))(lambda t: engine_over(t, "orders", "customer").cbo(_SIGNS.format("1e3", ">>")))


@query("sql_dialect", "SELECT o_orderkey, o_orderkey // NULLIF(o_custkey % 3, 0) AS q, CAST(o_custkey > 50 AS BIGINT) AS big FROM orders WHERE o_custkey % 2 <> 0")
def _(t: Tables) -> DataFrame:
    engine = Engine(t._spark)
    engine.register("orders", f"{t._dir}/orders.parquet")
    return engine.sql("SELECT o_orderkey, o_orderkey / (o_custkey % 3) AS q, o_custkey > 50 AS big FROM orders WHERE o_custkey % 2")


# ------------------------------------------------------------- aggregation

query("agg_count_star", "SELECT COUNT(*) AS n FROM orders")(lambda t: R.aggregate(t.orders, [], R.count_rows().alias("n")))
query("agg_count_col", f"SELECT COUNT(*) AS n, COUNT(a) AS a FROM ({_NULLS})")(lambda t: R.aggregate(with_nulls(t), [], R.count_rows().alias("n"), F.count("a").alias("a")))
query("agg_sum", f"SELECT CAST(SUM(a) AS BIGINT) AS a, CAST(SUM(o_orderkey) AS BIGINT) AS k FROM ({_NULLS})")(lambda t: R.aggregate(with_nulls(t), [], agg_sum("a").alias("a"), agg_sum("o_orderkey").alias("k")))
query("agg_min_max", "SELECT MIN(o_custkey) AS low, MAX(o_custkey) AS high FROM orders")(lambda t: R.aggregate(t.orders, [], F.min("o_custkey").alias("low"), F.max("o_custkey").alias("high")))
query("agg_min_max_string", "SELECT c_mktsegment, MIN(c_name) AS low, MAX(c_name) AS high FROM customer GROUP BY c_mktsegment")(lambda t: R.aggregate(t.customer, ["c_mktsegment"], F.min("c_name").alias("low"), F.max("c_name").alias("high")))
query("agg_group_multi", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, CAST(SUM(l_orderkey) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag, l_linestatus")(lambda t: R.aggregate(t.lineitem, ["l_returnflag", "l_linestatus"], R.count_rows().alias("n"), agg_sum("l_orderkey").alias("s")))
query("agg_group_expr", "SELECT o_custkey % 10 AS bucket, COUNT(*) AS n FROM orders GROUP BY o_custkey % 10")(lambda t: R.aggregate(t.orders, [E.remainder(c("o_custkey"), E.integer(10)).alias("bucket")], R.count_rows().alias("n")))
query("agg_group_null_key", f"SELECT a, COUNT(*) AS n FROM ({_NULLS}) GROUP BY a")(lambda t: R.aggregate(with_nulls(t), ["a"], R.count_rows().alias("n")))
query("agg_having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12")(lambda t: R.aggregate(t.orders, ["o_custkey"], R.count_rows().alias("n"), having=c("n") > 12))
query("agg_global_empty", "SELECT COUNT(*) AS n FROM orders WHERE o_orderkey < 0 HAVING COUNT(*) > 0")(lambda t: R.aggregate(t.orders.filter("o_orderkey < 0"), [], R.count_rows().alias("n"), empty_row=False))
query("agg_all_null", "SELECT CAST(SUM(x) AS BIGINT) AS s, MIN(x) AS low, MAX(x) AS high, COUNT(x) AS n FROM (SELECT CAST(NULL AS BIGINT) AS x FROM region)")(lambda t: R.aggregate(t.region.select(E.null("bigint").alias("x")), [], agg_sum("x").alias("s"), F.min("x").alias("low"), F.max("x").alias("high"), F.count("x").alias("n")))
query("agg_count_distinct", "SELECT COUNT(DISTINCT o_custkey) AS n FROM orders")(lambda t: t.orders.agg(F.countDistinct("o_custkey").alias("n")))
query("select_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")(lambda t: t.orders.select("o_orderstatus", "o_orderpriority").distinct())

# ------------------------------------------------------------- sort, limit


def placed(df: DataFrame, *order) -> DataFrame:
    """Sorted rows with their position, so that an order-blind comparison sees the order."""
    return R.sort_numbered(df, *order).withColumn("position", c("position").cast("int"))


_PLACE = "CAST(row_number() OVER (ORDER BY {}) AS INTEGER) AS position"
query("sort_asc", f"SELECT c_custkey, {_PLACE.format('c_custkey')} FROM customer")(lambda t: placed(t.customer.select("c_custkey"), c("c_custkey")))
query("sort_desc", f"SELECT c_custkey, {_PLACE.format('c_custkey DESC')} FROM customer")(lambda t: placed(t.customer.select("c_custkey"), c("c_custkey").desc()))
query("sort_multi", f"SELECT c_custkey, {_PLACE.format('c_mktsegment, c_nationkey DESC, c_custkey')} FROM customer")(lambda t: placed(t.customer.select("c_custkey", "c_mktsegment", "c_nationkey"), c("c_mktsegment"), c("c_nationkey").desc(), c("c_custkey")).select("c_custkey", "position"))
query("sort_expr", f"SELECT c_custkey, {_PLACE.format('c_custkey % 10, c_custkey')} FROM customer")(lambda t: placed(t.customer.select("c_custkey"), E.remainder(c("c_custkey"), E.integer(10)), c("c_custkey")).select("c_custkey", "position"))
query("sort_nulls", f"SELECT c_custkey, {_PLACE.format('NULLIF(c_custkey % 7, 0) NULLS FIRST, c_custkey')} FROM customer")(lambda t: placed(t.customer.select("c_custkey"), F.nullif(E.remainder(c("c_custkey"), E.integer(7)), E.integer(0)), c("c_custkey")).select("c_custkey", "position"))
query("sort_nonprojected", "SELECT c_name FROM customer ORDER BY c_custkey DESC LIMIT 7")(lambda t: R.sort(t.customer, c("c_custkey").desc()).select("c_name").limit(7))
query("limit", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 7")(lambda t: R.limit(R.sort(t.customer, c("c_custkey")), 7).select("c_custkey"))
query("limit_offset", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 7 OFFSET 20")(lambda t: R.limit(R.sort(t.customer, c("c_custkey")), 7, 20).select("c_custkey"))
query("topn", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 10")(lambda t: R.top_n(t.orders, 10, c("o_custkey"), c("o_orderkey")).select("o_orderkey", "o_custkey"))
query("topn_multi", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderstatus, o_custkey DESC, o_orderkey LIMIT 10")(lambda t: R.top_n(t.orders, 10, c("o_orderstatus"), c("o_custkey").desc(), c("o_orderkey")).select("o_orderkey", "o_custkey"))
query("topn_larger_than_input", "SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 1000")(lambda t: R.top_n(t.nation, 1000, c("n_nationkey")).select("n_nationkey"))
query("subquery_from", "SELECT s.k, COUNT(*) AS n FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O') s GROUP BY s.k")(lambda t: R.subquery(t.orders.filter("o_orderstatus = 'O'").select(c("o_custkey").alias("k")), "s").groupBy("s.k").agg(F.count("*").alias("n")))


@query("materialized_reuse", "SELECT a.o_custkey AS k, a.n AS n, b.total AS total FROM (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) a CROSS JOIN (SELECT COUNT(*) AS total FROM (SELECT o_custkey FROM orders GROUP BY o_custkey)) b")
def _(t: Tables) -> DataFrame:
    counts = R.materialize(t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")))
    return counts.crossJoin(F.broadcast(counts.agg(F.count("*").alias("total")))).select(c("o_custkey").alias("k"), "n", "total")


# ----------------------------------------------------------------- indexes

query("index_lookup", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 77")(lambda t: indexes.lookup(t.orders, {"o_orderkey": 77}).select("o_orderkey", "o_custkey"))
query("index_lookup_dup", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 10 AND o_orderstatus = 'F'")(lambda t: indexes.lookup(t.orders, {"o_custkey": 10, "o_orderstatus": "F"}).select("o_orderkey", "o_custkey"))
query("index_lookup_null", f"SELECT o_orderkey FROM ({_NULLS}) WHERE a IS NULL")(lambda t: indexes.lookup(with_nulls(t), {"a": None}).select("o_orderkey"))
query("index_range_fwd", "SELECT o_orderkey FROM orders WHERE o_orderkey >= 1000")(lambda t: indexes.range_scan(t.orders, ["o_orderkey"], (1000,)).select("o_orderkey"))
query("index_range_back", "SELECT o_orderkey FROM orders WHERE o_orderkey <= 1000")(lambda t: indexes.range_scan(t.orders, ["o_orderkey"], (1000,), forward=False).select("o_orderkey"))
query("index_range_between", "SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 100 AND 200")(lambda t: indexes.range_scan(t.orders, ["o_orderkey"], (100,), stop=(200,)).select("o_orderkey"))
query("index_composite_range", "SELECT o_custkey, o_orderkey FROM orders WHERE (o_custkey, o_orderkey) <= (50, 700)")(lambda t: indexes.range_scan(t.orders, ["o_custkey", "o_orderkey"], (50, 700), forward=False).select("o_custkey", "o_orderkey"))

# --------------------------------------------------------------------- DML

_NEW = [(100, "ATLANTIS", 1), (101, "MU", 2)]
_SCHEMA = "n_nationkey int, n_name string, n_regionkey int"
query("insert_values", "SELECT * FROM nation UNION ALL SELECT * FROM (VALUES (100, 'ATLANTIS', 1), (101, 'MU', 2)) v")(lambda t: dml.insert(t.nation, values(t._spark, _NEW, _SCHEMA))[0])
query("insert_affected", "SELECT CAST(2 AS BIGINT) AS affected")(lambda t: dml.insert(t.nation, values(t._spark, _NEW, _SCHEMA))[1])
query("insert_select", "SELECT * FROM nation UNION ALL SELECT n_nationkey + 100, n_name, n_regionkey FROM nation WHERE n_regionkey = 1")(lambda t: dml.insert(t.nation, t.nation.filter("n_regionkey = 1").select(c("n_nationkey") + 100, "n_name", "n_regionkey"))[0])
query("insert_partial_null", "SELECT * FROM nation UNION ALL SELECT 200, NULL, 3")(lambda t: dml.insert(t.nation, values(t._spark, [(3, 200)], "a int, b int"), ["n_regionkey", "n_nationkey"])[0])
query("update_const", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'X' ELSE n_name END AS n_name, n_regionkey FROM nation")(lambda t: dml.update(t.nation, {"n_name": F.lit("X")}, c("n_regionkey") == 1)[0])
query("update_expr", "SELECT n_nationkey, n_name, CASE WHEN n_nationkey > 10 THEN n_regionkey + n_nationkey ELSE n_regionkey END AS n_regionkey FROM nation")(lambda t: dml.update(t.nation, {"n_regionkey": c("n_regionkey") + c("n_nationkey")}, c("n_nationkey") > 10)[0])
query("update_swap_old_values", "SELECT n_regionkey AS n_nationkey, n_name, n_nationkey AS n_regionkey FROM nation")(lambda t: dml.update(t.nation, {"n_nationkey": c("n_regionkey"), "n_regionkey": c("n_nationkey")})[0])
query("delete_where", "SELECT * FROM nation WHERE n_regionkey <> 1")(lambda t: dml.delete(t.nation, c("n_regionkey") == 1)[0])
query("delete_null_pred_keeps", f"SELECT * FROM ({_NULLS}) WHERE NOT COALESCE(a > 3, FALSE)")(lambda t: dml.delete(with_nulls(t), c("a") > 3)[0])
query("delete_all", "SELECT * FROM nation WHERE FALSE")(lambda t: dml.delete(t.nation)[0])
query("delete_order_limit", "SELECT * FROM nation WHERE n_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1 ORDER BY n_name DESC LIMIT 2)")(lambda t: dml.delete(t.nation, c("n_regionkey") == 1, [c("n_name").desc()], 2)[0])



def after(t: Tables, table: str, *statements: str) -> DataFrame:
    """A table of a new store after statements as text, which commit one after the other."""
    store = Store(t._spark, shared_folder(t._spark))
    rows = getattr(t, table)
    store.create(table, rows.schema)
    with store.begin() as transaction:
        transaction.insert(table, rows)
    engine = Engine(t._spark, store)
    for statement in statements:
        engine.execute(statement)
    return store.table(table)


query("sql_insert", "SELECT * FROM nation UNION ALL SELECT 100, 'ATLANTIS', 1 UNION ALL SELECT n_nationkey + 200, NULL, n_regionkey FROM nation WHERE n_regionkey = 3")(
    lambda t: after(t, "nation", "INSERT INTO nation VALUES (100, 'ATLANTIS', 1);", "INSERT INTO nation (n_regionkey, n_nationkey) SELECT n_regionkey, n_nationkey + 200 FROM nation WHERE n_regionkey = 3")
)
query("sql_update", "SELECT n_nationkey, CASE WHEN n_regionkey % 2 <> 0 THEN n_name || '; WHERE' ELSE n_name END AS n_name, CASE WHEN n_regionkey % 2 <> 0 THEN n_nationkey // 7 ELSE n_regionkey END AS n_regionkey FROM nation")(
    lambda t: after(t, "nation", "UPDATE nation SET n_name = n_name || '; WHERE', n_regionkey = n_nationkey / 7 WHERE n_regionkey % 2 -- odd ones")
)
query("sql_delete", "SELECT * FROM nation WHERE NOT (n_nationkey >= 2e1 OR n_regionkey = 1 AND n_nationkey < 10) AND n_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2 AND n_nationkey < 20 ORDER BY n_name DESC LIMIT 2)")(
    lambda t: after(t, "nation", "DELETE FROM nation WHERE n_nationkey >= 1e3", "DELETE FROM nation WHERE n_nationkey >= 2e1 OR n_regionkey == 1 AND n_nationkey < 10", "DELETE FROM nation WHERE n_regionkey = 2 ORDER BY n_name DESC LIMIT 2")
)

# --------------------------------------------------------- catalog, sources


@query("catalog_listing", "SELECT * FROM (VALUES ('nation', 'n_nationkey', 'bigint'), ('nation', 'n_name', 'string'), ('region', 'r_regionkey', 'bigint')) v(table_name, column_name, kind)")
def _(t: Tables) -> DataFrame:
    catalog = Catalog()
    catalog.add_table("nation", [Column("n_nationkey", INT), Column("n_name", STRING)])
    catalog.add_table("region", [Column("r_regionkey", INT)])
    rows = [(x.name, f.name, f.dataType.simpleString()) for x in catalog.tables.values() for f in x.schema]
    return values(t._spark, rows, "table_name string, column_name string, kind string")


@query("csv_load", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")
def _(t: Tables) -> DataFrame:
    path = f"{shared_folder(t._spark)}/nation.csv"
    t.nation.select("n_nationkey", "n_name").write.csv(path, escape='"')
    catalog = Catalog()
    return read_csv(t._spark, path, catalog.add_table("nation", [Column("n_nationkey", INT), Column("n_name", STRING)]))
