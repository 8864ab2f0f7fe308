import pytest
from pyspark.sql import functions as F

from quillon.errors import TypeMismatchError
from quillon.functions import expressions as E

LOW, HIGH = -(1 << 63), (1 << 63) - 1


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_three_valued_logic(spark):
    t, f, n = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    told = spark.range(1).select(*[E.as_int(x).alias(f"c{k}") for k, x in enumerate([t & t, t & f, t & n, f & n, n & n, t | t, t | f, t | n, f | n, n | n, ~t, ~f, ~n])]).first()
    assert list(told) == [1, 0, None, 0, None, 1, 1, 1, None, None, 0, 1, None]


@pytest.mark.parametrize(
    ("operation", "a", "b", "expected"),
    [
        (E.add, 10, 2, 12), (E.subtract, 10, 2, 8), (E.multiply, 10, 2, 20), (E.divide, 10, 2, 5), (E.remainder, 10, 2, 0),
        (E.add, 10, None, None), (E.multiply, None, 2, None), (E.divide, 10, 0, None), (E.remainder, 10, 0, None),
        (E.divide, -7, 2, -3), (E.remainder, -7, 2, -1), (E.add, HIGH, 1, LOW), (E.subtract, LOW, 1, HIGH),
        (E.multiply, HIGH, HIGH, 1), (E.multiply, LOW, LOW, 0), (E.multiply, LOW, 3, LOW), (E.divide, LOW, -1, LOW), (E.divide, 7, -1, -7),
    ],
)
@pytest.mark.parametrize("ansi", ["true", "false"])
def test_arithmetic(spark, operation, a, b, expected, ansi):
    own = spark.newSession()
    own.conf.set("spark.sql.ansi.enabled", ansi)
    df = own.createDataFrame([(a, b)], "a long, b long")
    assert df.select(operation(F.col("a"), F.col("b"))).first()[0] == expected


@pytest.mark.parametrize(
    ("text", "pattern", "expected"),
    [("hello", "he%", 1), ("hello", "%ll%", 1), ("hello", "he__o", 1), ("hello", "world", 0), ("100%", "100\\%", 1), ("100x", "100\\%", 0), ("a\nb", "a%", 0), ("a.b", "a.b", 1), ("axb", "a.b", 0), ("a\\b", "a\\b", 1), ("x&&y", "x&&y", 1), ("", "%", 1), ("Hello", "hello", 0)],
)
def test_like(spark, text, pattern, expected):
    assert value(spark, E.as_int(E.like(F.lit(text), pattern))) == expected


def test_concat_and_nulls(spark):
    assert value(spark, E.concat(E.string("hello"), E.string("world"))) == "helloworld"
    assert value(spark, E.concat(E.string("hello"), E.null("string"))) is None
    assert value(spark, E.fits(F.lit("é" * 17))) is False


def test_truth_and_types(spark):
    assert value(spark, E.truthy(E.integer(42))) is True
    df = spark.createDataFrame([(1, "a", 2)], "a long, b string, c int")
    E.check_comparable(df, "a", "c")
    with pytest.raises(TypeMismatchError):
        E.check_comparable(df, "a", "b")
    assert df.filter(E.conjuncts(F.col("a") == 1, F.col("c") == 2)).count() == 1
    assert df.filter(E.conjuncts()).count() == 1
