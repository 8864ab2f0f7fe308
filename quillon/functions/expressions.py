"""The engine's expressions as Spark columns.

Integers are 64 bits wide and wrap around; division truncates towards zero and gives null for a
divisor of zero, as the remainder does; null operands give null; AND, OR and NOT have three values. Everything stays a
JVM expression, whatever spark.sql.ansi.enabled says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TypeMismatchError

_WIDE = "decimal(38,0)"


def integer(value: int) -> Column:
    return F.lit(value).cast("bigint")


def string(value: str) -> Column:
    return F.lit(value)


def null(kind: str) -> Column:
    """A null of a type: bigint or string."""
    return F.lit(None).cast(kind)


def as_int(predicate: Column) -> Column:
    """1, 0 or null."""
    return predicate.cast("bigint")


def truthy(value: Column) -> Column:
    """True for numbers other than 0."""
    return value != 0


def _wrapped(exact: Column) -> Column:
    """The low 64 bits of a wide number, with sign."""
    two64, two63 = F.lit(str(1 << 64)).cast(_WIDE), F.lit(str(1 << 63)).cast(_WIDE)
    low = F.pmod(exact, two64)
    return F.when(low >= two63, low - two64).otherwise(low).cast("bigint")


def add(a: Column, b: Column) -> Column:
    a, b = a.cast("bigint"), b.cast("bigint")
    return F.coalesce(F.try_add(a, b), _wrapped(a.cast(_WIDE) + b.cast(_WIDE)))


def subtract(a: Column, b: Column) -> Column:
    a, b = a.cast("bigint"), b.cast("bigint")
    return F.coalesce(F.try_subtract(a, b), _wrapped(a.cast(_WIDE) - b.cast(_WIDE)))


def multiply(a: Column, b: Column) -> Column:
    a, b = a.cast("bigint"), b.cast("bigint")
    return F.coalesce(F.try_multiply(a, b), _wrapped(a.cast("decimal(19,0)") * b.cast("decimal(19,0)")))


def divide(a: Column, b: Column) -> Column:
    """Truncated; null for a divisor of zero."""
    a, b = a.cast("bigint"), b.cast("bigint")
    plain = F.call_function("div", a, F.nullif(b, F.lit(0).cast("bigint")))
    return F.when(b == -1, subtract(integer(0), a)).otherwise(plain)


def remainder(a: Column, b: Column) -> Column:
    """With the sign of a; null for a divisor of zero."""
    return F.try_mod(a.cast("bigint"), b.cast("bigint"))


def concat(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def like_regex(pattern: str) -> str:
    """A whole-string expression: % any characters, _ one, each but line ends; a backslash makes these two literal."""
    special, out, k = set("\\.[]{}()*+-?^$|&~#"), [], 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\" and k + 1 < len(pattern) and pattern[k + 1] in "%_":
            out.append(pattern[k + 1])
            k += 1
        elif c in "%_":
            out.append("[^\\n]*" if c == "%" else "[^\\n]")
        else:
            out.append("\\" + c if c in special else c)
        k += 1
    return f"^{''.join(out)}\\z"


def like(value: Column, pattern: str) -> Column:
    """Case-sensitive; % does not reach over line ends."""
    return value.rlike(like_regex(pattern))


def fits(value: Column, width: int = 32) -> Column:
    """True for strings that a fixed-width column can hold."""
    return F.octet_length(value) <= width


def _kind(kind: T.DataType) -> str:
    return "number" if isinstance(kind, T.NumericType) else kind.simpleString()


def check_comparable(df: DataFrame, a: str, b: str) -> None:
    """Raises where Spark would convert one side silently."""
    left, right = df.schema[a].dataType, df.schema[b].dataType
    if _kind(left) != _kind(right):
        raise TypeMismatchError(f"{a} is {left.simpleString()}, {b} is {right.simpleString()}")


def conjuncts(*predicates: Column) -> Column:
    """All of the predicates; true if there is none."""
    out = F.lit(True)
    for p in predicates:
        out = out & p
    return out
