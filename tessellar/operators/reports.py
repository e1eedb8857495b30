"""Counts, grouped reports and quantile summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def counts(df: DataFrame, key: str) -> DataFrame:
    """Rows per key, the most first, ties by key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key)


def eligible(df: DataFrame, key: str, least: int) -> DataFrame:
    return counts(df, key).filter(F.col("n") >= least)


def counts_by_source_and_overall(df: DataFrame, source: str, domain: str) -> DataFrame:
    """Rows per (source, domain) and per domain in one pass; ``source`` is ALL for the latter."""
    return df.groupingSets([[source, domain], [domain]], source, domain).agg(F.grouping(source).alias("overall"), F.count(F.lit(1)).alias("n")).select(F.when(F.col("overall") == 1, "ALL").otherwise(F.col(source)).alias("source"), F.col(domain).alias("domain"), "n")


def conditional_sums(df: DataFrame, key: str, kind: str, kinds: Sequence[str], value: str) -> DataFrame:
    """Per key, the sum of ``value`` for each kind."""
    return df.groupBy(key).agg(*[F.sum(F.when(F.col(kind) == k, F.col(value)).otherwise(0)).alias(f"{k}_sum") for k in kinds])


def averages(df: DataFrame, columns: Sequence[str], key: str | None = None) -> DataFrame:
    """Means that leave out NaN."""
    means = [F.avg(F.when(~F.isnan(F.col(c).cast("double")), F.col(c))).alias(f"{c}_mean") for c in columns]
    return df.groupBy(key).agg(*means) if key else df.agg(*means)


def floor_quantile(values: Column, p: float) -> Column:
    """The value at index floor(p * (n - 1)) of the sorted values; no interpolation. ``values`` is a sorted array."""
    return F.element_at(values, (F.floor(F.lit(p) * (F.size(values) - 1)) + 1).cast("int"))


def summary(df: DataFrame, key: str, value: str) -> DataFrame:
    """n, mean, median, quartiles by floor index, least and most per key; no list of a group's values is made.

    Values are counted first; a quartile is the first value whose running count goes beyond its index.
    """
    g = df.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.min(value).alias("least"), F.max(value).alias("most"))
    times = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_c"))
    upto = times.withColumn("_upto", F.sum("_c").over(Window.partitionBy(key).orderBy(value))).join(g.select(key, "n"), key)
    at = lambda p: F.min(F.when(F.col("_upto") > F.floor(F.lit(p) * (F.col("n") - 1)), F.col(value)))
    quartiles = upto.groupBy(key).agg(at(0.25).alias("p25"), at(0.75).alias("p75"))
    return g.join(quartiles, key, "left").select(key, "n", "mean", "median", "p25", "p75", "least", "most")


def quantiles(df: DataFrame, key: str, value: str, ps: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """Linearly interpolated quantiles, from value counts rather than lists."""
    return df.groupBy(key).agg(*[F.percentile(value, F.lit(p)).alias(f"p{round(100 * p)}") for p in ps])


def joined_values(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Values of a group in order, joined by a bar."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("string").alias("v"))))
    return df.groupBy(key).agg(F.array_join(F.transform(pairs, lambda x: x["v"]), "|").alias("joined"))


def count_where(df: DataFrame, key: str, test: Column, name: str) -> DataFrame:
    """Rows of each key for which a test holds."""
    return df.groupBy(key).agg(F.count_if(test).alias(name))


def ratios(df: DataFrame, key: str, columns: Sequence[str], digits: int | None = 2) -> DataFrame:
    """Per key its rows and, of each column, the sum and the sum for a row; the most rows first, ties by key. Without ``digits`` nothing is rounded."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in columns])
    rounded = lambda x: x if digits is None else F.round(x, digits)
    each = [rounded(F.col(c) / F.greatest("n", F.lit(1))).alias(f"{c}_each") for c in columns]
    return g.select(key, "n", *columns, *each).orderBy(F.desc("n"), key)


def most_common(df: DataFrame, column: str, n: int, pos: str | None = None) -> DataFrame:
    """The n commonest values; ties by their first place, or by value."""
    first = F.min(pos).alias("_first") if pos else F.lit(0).alias("_first")
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"), first).orderBy(F.desc("n"), "_first", column).limit(n).drop("_first")


def renamed(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """A report's columns by other names, in the given order; those not named are left out."""
    return df.select(*[F.col(a).alias(b) for a, b in columns.items()])


def number(c: Column) -> Column:
    """A text as a number; 0 where it isn't one."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def numbers_or_none(*cs: Column) -> list[Column]:
    """Several texts as numbers; if one isn't a number, all are 0."""
    values = [c.try_cast("double") for c in cs]
    missing = F.lit(False)
    for v in values:
        missing = missing | v.isNull()
    return [F.when(missing, F.lit(0.0)).otherwise(v) for v in values]
