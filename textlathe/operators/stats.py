"""Grouped statistics: distributions, backoff, spread, missingness, correlation, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Two-sided 95 % points of Student's t for 1 to 29 degrees of freedom, and the normal one.
T95 = [12.7062, 4.3027, 3.1824, 2.7764, 2.5706, 2.4469, 2.3646, 2.306, 2.2622, 2.2281, 2.201, 2.1788, 2.1604, 2.1448, 2.1314, 2.1199, 2.1098, 2.1009, 2.093, 2.086, 2.0796, 2.0739, 2.0687, 2.0639, 2.0595, 2.0555, 2.0518, 2.0484, 2.0452]
Z95 = 1.96


def standard_error(c: str) -> Column:
    return F.stddev_samp(c) / F.sqrt(F.count(c))


def describe(df: DataFrame, by: list[str], cols: list[str], exact: bool = True) -> DataFrame:
    """count, mean, std, min, quartiles and max of each column, long.

    Exact quartiles (linear between ranks) hold a group's distinct values in memory; for
    groups of unbounded size `exact=False` takes sketches of bounded size instead.
    """
    long = df.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in cols])).alias("x")).select(*by, "x.metric", "x.v")
    q = F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))) if exact else F.percentile_approx("v", [0.25, 0.5, 0.75], 10_000)
    out = long.groupBy(*by, "metric").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("low"), q.alias("q"), F.max("v").alias("high"))
    r = lambda c: F.round(c, 4)
    return out.select(*by, "metric", "n", r("mean").alias("mean"), r("std").alias("std"), r("low").alias("low"), r(F.col("q")[0]).alias("q25"), r(F.col("q")[1]).alias("q50"), r(F.col("q")[2]).alias("q75"), r("high").alias("high"))


def missingness(df: DataFrame, by: str, cols: list[str]) -> DataFrame:
    """Share of missing values (nulls, and NaN in float columns) of each column, by group."""
    kinds = dict(df.dtypes)
    gone = lambda c: F.col(c).isNull() | F.isnan(c) if kinds[c] in ("double", "float") else F.col(c).isNull()
    return df.groupBy(by).agg(*[F.round(F.avg(gone(c).cast("double")), 6).alias(f"{c}_missing") for c in cols])


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson's correlation of each pair over the rows that have both, long."""
    pairs = [(a, b) for n, a in enumerate(cols) for b in cols[n + 1 :]]
    one = df.agg(*[F.corr(a, b).alias(f"c{n}") for n, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{n}").alias("r")) for n, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def shares(df: DataFrame, by: list[str], value: str, name: str = "p") -> DataFrame:
    """P(value | by): counts first, then a window over the counted rows only."""
    counted = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by)) if by else F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counted.withColumn(name, F.col("n") / total)


def backoff(df: DataFrame, given: str, rest: list[str], mark: str = "<gen>") -> DataFrame:
    """Conditional shares of `rest[-1]` with the conditioning value, and without it
    (marked), from one pass of grouping sets."""
    spec = [[*rest[:-1], given, rest[-1]], rest]
    grouped = df.groupingSets([[F.col(c) for c in s] for s in spec], *[F.col(c) for c in [*rest[:-1], given, rest[-1]]])
    counted = grouped.agg(F.count("*").alias("n"), F.grouping(given).alias("g")).withColumn(given, F.when(F.col("g") == 1, mark).otherwise(F.col(given)))
    total = F.sum("n").over(Window.partitionBy("g", *rest[:-1], given))
    return counted.select(*rest[:-1], given, rest[-1], "n", (F.col("n") / total).alias("p"))


def average_rank(c: str, part: str, descending: bool = False) -> Column:
    """Ranks where equal values share the mean of their places."""
    order = F.desc(c) if descending else F.asc(c)
    return F.rank().over(Window.partitionBy(part).orderBy(order)) + (F.count("*").over(Window.partitionBy(part, c)) - 1) / 2


def interval(df: DataFrame, by: list[str], c: str) -> DataFrame:
    """Mean and half width of its 95 % interval: Student's t below 30 values, else normal."""
    base = df.groupBy(*by).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), standard_error(c).alias("sem"))
    t = F.element_at(F.array(*[F.lit(x) for x in T95]), F.greatest(F.lit(1), F.least(F.lit(len(T95)), (F.col("n") - 1).cast("int"))))
    width = F.when(F.col("n") < 2, F.lit(None)).when(F.col("n") < 30, t).otherwise(Z95) * F.col("sem")
    return base.select(*by, "n", F.round("mean", 4).alias("mean"), F.round(width, 4).alias("half_width"))


def first_wins(df: DataFrame, key: str, order: list) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
