"""Exact quartiles, however many values one key has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Values of a key up to which they may meet in one task.
HELD = 1 << 20
#: Parts that a pass counts in a range, and ranges up to which their table is broadcast.
PARTS, BROADCAST_RANGES = 1024, 20_000
QUARTILES = (0.25, 0.5, 0.75)


def quartiles(rows: DataFrame, key: str, value: str, held: int | None = None) -> DataFrame:
    """(key, _q): quartiles, interpolated, of a double column without nulls and NaNs, by a key without nulls.

    A key of more than `held` values isn't gathered: the ranges that hold its quartiles' ranks are counted in parts, pass by pass, until each
    holds one value. A pass shuffles counts of parts alone. Infinite values count as the outermost; an empty table gives no rows.
    """
    held = HELD if held is None else held
    of = rows.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    hot = of.groupBy("_k").agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).where(F.col("n") > held).collect()
    if not hot:
        return _gathered(of, key)
    kind = of.schema["_k"].dataType
    values = _select(of, kind, [(r["_k"], r["n"], r["lo"], r["hi"]) for r in hot])
    found = rows.sparkSession.createDataFrame([(r["_k"], [_interpolated(values[r["_k"]], p * (r["n"] - 1)) for p in QUARTILES]) for r in hot], T.StructType([T.StructField("_k", kind), T.StructField("_q", T.ArrayType(T.DoubleType()))]))
    rest = of.join(_small(found.select("_k"), len(hot)), "_k", "left_anti")
    return _gathered(rest, key).union(found.select(F.col("_k").alias(key), "_q"))


def _gathered(of: DataFrame, key: str) -> DataFrame:
    return of.groupBy("_k").agg(F.percentile("_v", F.array(*map(F.lit, QUARTILES))).alias("_q")).select(F.col("_k").alias(key), "_q")


def _small(table: DataFrame, n: int) -> DataFrame:
    return F.broadcast(table) if n <= BROADCAST_RANGES else table


def _interpolated(value: dict[int, float], at: float) -> float:
    low = int(at)
    return value[low] if at == low or value[low] == value[low + 1] else (low + 1 - at) * value[low] + (at - low) * value[low + 1]


def _part() -> Column:
    """Which part of lo..hi a value is in: never falling as values rise, lo in the first and hi in the last, all others between, so ranges always narrow.

    Parts are even in the value where lo and hi have one sign and differ twofold at most, else in its signed logarithm. Two passes at most bring
    a range of all doubles to the first case, which holds 2^52 values at most; so eight passes end on any table.
    """
    v, lo, hi = F.col("_v"), F.col("lo"), F.col("hi")
    size = lambda x: F.when(x == 0, 0.0).otherwise(F.signum(x) * F.least(F.log2(F.abs(x)) + 1075, F.lit(2200.0)))
    even = (F.signum(lo) * F.signum(hi) > 0) & (F.greatest(F.abs(lo), F.abs(hi)) / 2 <= F.least(F.abs(lo), F.abs(hi)))
    share = F.when(even, F.try_divide(v - lo, hi - lo)).otherwise(F.try_divide(size(v) - size(lo), size(hi) - size(lo)))
    inner = F.least(F.greatest(F.floor(F.nanvl(F.coalesce(share, F.lit(0.5)), F.lit(0.5)) * (PARTS - 2)) + 1, F.lit(1)), F.lit(PARTS - 2))
    return F.when(v == lo, 0).when(v == hi, PARTS - 1).otherwise(inner).cast("int")


def _select(of: DataFrame, kind: T.DataType, hot: list[tuple]) -> dict:
    """By key: the values at the ranks (from 0) beside its quartiles."""
    found: dict = {k: {} for k, *_ in hot}
    at = lambda n: sorted({min(int(p * (n - 1)) + i, n - 1) for p in QUARTILES for i in (0, 1)})
    ranges = [(k, lo, hi, 0, at(n)) for k, n, lo, hi in hot]  # with the values before it, and the ranks in it
    shape = T.StructType([T.StructField("_k", kind), T.StructField("_range", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in ("lo", "hi")], T.StructField("ranks", T.ArrayType(T.LongType()))])
    while True:
        for k, lo, hi, _, ranks in ranges:
            if lo == hi:
                found[k] |= dict.fromkeys(ranks, lo)
        ranges = [r for r in ranges if r[1] != r[2]]
        if not ranges:
            return found
        table = of.sparkSession.createDataFrame([(k, i, lo, hi, [r - before for r in ranks]) for i, (k, lo, hi, before, ranks) in enumerate(ranges)], shape)
        inside = of.join(_small(table, len(ranges)), "_k").where(F.col("_v").between(F.col("lo"), F.col("hi")))
        parts = inside.groupBy("_range", "ranks", _part().alias("_part")).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        parts = parts.withColumn("_end", F.sum("n").over(Window.partitionBy("_range").orderBy("_part"))).withColumn("_in", F.filter("ranks", lambda r: (r < F.col("_end")) & (r >= F.col("_end") - F.col("n"))))
        narrower = parts.where(F.size("_in") > 0).select("_range", "lo", "hi", (F.col("_end") - F.col("n")).alias("start"), "_in").collect()
        ranges = [(ranges[r["_range"]][0], r["lo"], r["hi"], ranges[r["_range"]][3] + r["start"], [x + ranges[r["_range"]][3] for x in r["_in"]]) for r in narrower]
