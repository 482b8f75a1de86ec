"""Sums along an order, without a task that holds the whole order.

A value becomes a 64-bit number of the same order (whole numbers are one), and that number a few
digits of 16 bits. What stands below a value is what stands below its first
digit, plus what stands below its second digit among values of the same first,
and so on. Every window orders at most 65,536 rows (a digit's sums), whatever
the distribution of values, and ties are one row before any of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_FRACTION = 1 << 52
_LEAST = 2.0**-1022
_BELOW = Window.unboundedPreceding, -1


def order_key(value: Column) -> Column:
    """A long in the order of value (double): null first, then numbers, then NaN; 0 and -0 are equal."""
    v = value.cast("double")
    a = F.abs(v)
    guess = F.greatest(F.floor(F.log2(a)), F.lit(-1022))
    down = F.when(F.pow(F.lit(2.0), guess) > a, guess - 1).otherwise(guess)
    up = F.greatest(F.when(F.pow(F.lit(2.0), down + 1) <= a, down + 1).otherwise(down), F.lit(-1022))
    normal = (up + 1023) * _FRACTION + ((a / F.pow(F.lit(2.0), up) - 1) * _FRACTION).cast("long")
    inf = float("inf")
    size = (
        F.when(a == 0, F.lit(0).cast("long"))
        .when(a == inf, F.lit(2047 * _FRACTION))
        .when(a < _LEAST, (a / F.lit(_LEAST) * _FRACTION).cast("long"))
        .otherwise(normal)
    )
    return F.when(v.isNull(), F.lit(-(1 << 63)).cast("long")).when(F.isnan(v), F.lit(2047 * _FRACTION + 1)).otherwise(F.when(v < 0, -size).otherwise(size))


def digits(value: Column, kind: str) -> list[Column]:
    """The digits of value, none null: two for floats and bytes to ints, four for others. Whole numbers have those of their own bits."""
    if kind in ("tinyint", "smallint", "int"):
        whole = F.coalesce(value.cast("long") + (1 << 31), F.lit(-1).cast("long"))
        return [F.shiftright(whole, 16), whole.bitwiseAND(F.lit(0xFFFF).cast("long"))]
    if kind == "bigint":
        first = F.coalesce(F.shiftright(value, 48), F.lit(-(1 << 16)).cast("long"))  # null is below all
        return [first, *[F.coalesce(F.shiftright(value, s).bitwiseAND(F.lit(0xFFFF).cast("long")), F.lit(0).cast("long")) for s in (32, 16, 0)]]
    key = order_key(value)
    if kind == "float":
        key = F.shiftright(key, 29)
        return [F.shiftright(key, 16), key.bitwiseAND(F.lit(0xFFFF).cast("long"))]
    low = F.lit(0xFFFF).cast("long")
    return [F.shiftright(key, 48), *[F.shiftright(key, s).bitwiseAND(low) for s in (32, 16)], key.bitwiseAND(low)]


def same(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", filled: tuple[str, ...] = ()) -> DataFrame:
    """Equi join on columns of both, in which null equals null; their columns come once, from left.

    filled: those of on that are never null. Where all are, rows that a window dealt by them stay where they are.
    """
    renamed = right.select(*[F.col(c).alias(f"__r_{c}" if c in on else c) for c in right.columns])
    if not on:
        return left.crossJoin(renamed)
    match = None
    for c in on:
        one = F.col(c) == F.col(f"__r_{c}") if c in filled else F.col(c).eqNullSafe(F.col(f"__r_{c}"))
        match = one if match is None else match & one
    return left.join(renamed, match, how).drop(*[f"__r_{c}" for c in on])


_OPS = {"sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))), "min": (F.min, F.least), "max": (F.max, F.greatest)}


def before(rows: DataFrame, keys: tuple[str, ...], value: str, into: dict[str, tuple[str, str]]) -> DataFrame:
    """rows, one for each keys and value, with what stands before it in the order of value.

    into: name to (sum, min or max; column). A sum of nothing is 0, a least or
    largest of nothing null.
    """
    kind = rows.schema[value].dataType.simpleString()
    parts = digits(F.col(value), kind)
    names = [f"__d{i}" for i in range(len(parts))]
    marked = rows.withColumns(dict(zip(names, parts, strict=True)))
    upper: DataFrame | None = None
    for level in range(1, len(names) + 1):
        path, parent = names[:level], names[: level - 1]
        last = level == len(names)
        table = marked if last else marked.groupBy(*keys, *path).agg(*[_OPS[op][0](column).alias(f"__s_{name}") for name, (op, column) in into.items()])
        order = Window.partitionBy(*keys, *parent).orderBy(path[-1]).rowsBetween(*_BELOW)
        table = table.withColumns({f"__o_{name}": _OPS[op][0](column if last else f"__s_{name}").over(order) for name, (op, column) in into.items()})
        if not last:
            table = table.drop(*[f"__s_{name}" for name in into])
        if upper is not None:
            table = same(table, upper, [*keys, *parent], filled=tuple(parent))
        joined = {name: _OPS[op][1](F.col(f"__o_{name}"), F.col(f"__u_{name}") if upper is not None else (F.lit(0) if op == "sum" else F.col(f"__o_{name}"))) for name, (op, _) in into.items()}
        if last:
            return table.withColumns(joined).drop(*names, *[f"__{x}_{name}" for x in "ou" for name in into])
        upper = table.select(*keys, *path, *[c.alias(f"__u_{name}") for name, c in joined.items()])
    raise AssertionError


#: Rows of a key up to which one window orders them, as many as a digit has values.
WHOLE = 1 << 16


def tied_ranks(rows: DataFrame, keys: tuple[str, ...], value: str, sums: tuple[str, ...] = (), split: bool = False) -> DataFrame:
    """(keys, value, n, sums, rk): each value once, how many rows have it, sums of columns over these, and their average rank.

    split: keys of at most WHOLE rows, which are dealt once, are ordered as they
    are, and only larger ones by digits. Best for many keys; rows are read three times.
    """
    own = rows.select(*keys, value, *sums)
    count = lambda part: part.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in sums])
    rank = lambda ranked: ranked.withColumn("rk", F.col("__b") + (F.col("n") + 1) / F.lit(2.0)).drop("__b")
    if not (split and keys):
        return rank(before(count(own), keys, value, {"__b": ("sum", "n")}))
    large = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > WHOLE).select(*keys)
    large = F.broadcast(large)  # at most one of WHOLE rows
    ordered = Window.partitionBy(*keys).orderBy(value).rowsBetween(*_BELOW)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # all of them: a row takes many times its size there
    few = count(same(own, large, list(keys), "left_anti").repartition(tasks, *keys)).withColumn("__b", F.coalesce(F.sum("n").over(ordered), F.lit(0)))
    many = before(count(same(own, large, list(keys), "left_semi")), keys, value, {"__b": ("sum", "n")})
    return rank(few.unionByName(many))


def numbered(rows: DataFrame, keys: tuple[str, ...], value: str, ties: tuple[str, ...], into: str = "number") -> DataFrame:
    """rows with their number, from 1, in the order of value and, for equal ones, of ties, within keys.

    Only rows of one value are ordered together.
    """
    counts = before(rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n")), keys, value, {"__b": ("sum", "__n")}).drop("__n")
    placed = same(rows, counts, [*keys, value])
    within = Window.partitionBy(*keys, value).orderBy(*ties) if ties else Window.partitionBy(*keys, value).orderBy(value)
    return placed.withColumn(into, (F.col("__b") + F.row_number().over(within)).cast("long")).drop("__b")
