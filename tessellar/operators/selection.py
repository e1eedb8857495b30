"""Threshold filters, weighted top lists, seeded samples and splits."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .linkage import by_priority


def passes(thresholds: dict[str, float], mode: str = "any") -> Column:
    """Any or all of the active thresholds (0: inactive); none active passes."""
    tests = [F.col(c) >= t for c, t in thresholds.items() if t > 0]
    return reduce(or_ if mode == "any" else and_, tests) if tests else F.lit(True)


def weighted_top(df: DataFrame, weights: dict[str, float], n: int, key: str) -> DataFrame:
    """The n highest weighted sums, ties to the greater key."""
    score = reduce(lambda a, b: a + b, [F.lit(w) * F.col(c) for c, w in weights.items()])
    return df.withColumn("score", score).orderBy(F.desc("score"), F.desc(key)).limit(n)


def seeded(key: str, seed: int) -> Column:
    """A reproducible random order."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))


def balanced_sample(df: DataFrame, key: str, group: str, least: int, take: int, seed: int = 42) -> DataFrame:
    """``take`` rows of each group that has ``least`` rows."""
    return _first_seeded(df, key, [group], least, take, seed)


def _first_seeded(df: DataFrame, key: str, group: list[str], least: int, take: int, seed: int) -> DataFrame:
    # counts meet by partial sums, and a rank's bound lets each task keep its own first rows: no group is whole in a task
    large = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).drop("_n")
    nth = F.row_number().over(Window.partitionBy(*group).orderBy(seeded(key, seed), key))
    return df.withColumn("_nth", nth).filter(F.col("_nth") <= take).drop("_nth").join(large, group, "left_semi")


def split(df: DataFrame, key: str, group: list[str], least: int, test: int, seed: int = 42, sources: dict[str, list[str]] | None = None) -> DataFrame:
    """``split``: test for the first rows of each large enough group in a seeded order, else corpus. Keys are distinct.

    ``sources`` names, by column, the values that may give tests.
    """
    may = reduce(and_, [F.col(c).isin(*values) for c, values in (sources or {}).items()], F.lit(True))
    chosen = _first_seeded(df, key, group, least, test, seed).filter(may).select(key, F.lit(True).alias("_test"))
    return df.join(chosen, key, "left").withColumn("split", F.when(F.col("_test"), "test").otherwise("corpus")).drop("_test")


def prefer(entries: Column, preferred) -> Column:
    """The preferred elements of an array if it has any, else all."""
    some = F.filter(entries, preferred)
    return F.when(F.size(some) > 0, some).otherwise(entries)


def capped(sample: DataFrame, order: list[Column], most: int) -> DataFrame:
    """A sample cut to ``most`` rows in a stated order."""
    return sample.orderBy(*order).limit(most)


def balanced(df: DataFrame, key: str, group: str, least: int = 30, take: int = 5, cap: int = 100, seed: int = 42) -> DataFrame:
    """A balanced sample, then the cap over all groups, in the order of groups."""
    return capped(balanced_sample(df, key, group, least, take, seed), [F.col(group), seeded(key, seed), F.col(key)], cap)


def collected(df: DataFrame, key: str, group: str, source: str, priority: list[str], least: int) -> DataFrame:
    """Two passes: groups of ``least`` rows over all sources, then each id once, from the first source that has it."""
    large = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select(group)
    return by_priority(df.filter(F.col(key).isNotNull()), [key], source, priority, [F.col(group)]).join(large, group, "left_semi")


def above(entries: Column, least: int) -> Column:
    """Of a map of texts, those of ``least`` characters."""
    return F.map_filter(entries, lambda k, v: F.length(v) >= least)


def titled(entries: Column, include: str | None = None, exclude: str | None = None) -> Column:
    """Of a map, the entries whose key matches a pattern and doesn't match another, in any case."""
    keep = lambda k: (k.rlike(f"(?i){include}") if include else F.lit(True)) & (~k.rlike(f"(?i){exclude}") if exclude else F.lit(True))
    return F.map_filter(entries, lambda k, v: keep(k)) if include or exclude else entries


def prefer_source(entries: Column, sources: Column, preferred: str) -> Column:
    """Of a map, the entries whose source (another map of the same keys) is the preferred one if there are any, else all."""
    some = F.map_filter(entries, lambda k, v: F.coalesce(F.element_at(sources, k) == preferred, F.lit(False)))
    return F.when(F.cardinality(some) > 0, some).otherwise(entries)
