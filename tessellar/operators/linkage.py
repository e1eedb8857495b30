"""Record linkage: membership, deduplication by rank, confidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..session import cut


def without(df: DataFrame, excluded: DataFrame, on: str) -> DataFrame:
    return df.join(excluded, on, "left_anti")


def within(df: DataFrame, included: DataFrame, on: str) -> DataFrame:
    return df.join(included, on, "left_semi")


def ranked(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def numbered(df: DataFrame, order: Sequence[Column], name: str = "pos") -> DataFrame:
    """``df`` with each row's number from 1 in an order over the whole table.

    Rows are sorted by ranges, each range counts its own, and the counts of the ranges before it, a row a range, are added.
    """
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, nth = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)  # the range, and the place in it
    counts = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    found = ranged.withColumn("_part", part).join(F.broadcast(offsets), "_part")  # a row for each range
    return found.withColumn(name, (F.col("_before") + nth + 1).cast("long")).drop("_part", "_at", "_before")


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in the order (``dropDuplicates`` has none)."""
    return ranked(df, key, order).filter("_nth = 1").drop("_nth")


def dropped(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The rows that ``keep_first`` leaves out."""
    return ranked(df, key, order).filter("_nth > 1").drop("_nth")


def by_priority(df: DataFrame, key: Sequence[str], source: str, priority: Sequence[str], tie: Sequence[Column]) -> DataFrame:
    """One row per key, of the first source in ``priority`` that has it."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, priority)), F.col(source)), F.lit(0))
    return keep_first(df, key, [F.when(place > 0, place).otherwise(len(priority) + 1), *tie])


def confidence(title: Column, source: Column, open_access: Column) -> Column:
    """0.7 of the title's similarity, 0.3 of the source's weight, 0.05 for open access; within 0 and 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.7 * title + 0.3 * source + 0.05 * open_access))


def status(found: Column, score: Column, threshold: float) -> Column:
    return F.when(~found, "no_match").when(score >= threshold, "OK").otherwise("low_confidence")


def with_status(df: DataFrame, key: str, status: str, allowed: Sequence[str] = ()) -> DataFrame:
    """Rows that have a key, of any status or the allowed ones."""
    has = F.trim(T.blank(F.col(key).cast("string"))) != ""
    return df.filter(has & F.col(status).isin(*allowed)) if allowed else df.filter(has)


def in_order(ids: DataFrame, rows: DataFrame, key: str, pos: str) -> DataFrame:
    """The rows of listed keys in the list's order; keys without a row are left out."""
    return ids.join(rows, key).orderBy(pos, key)


def filled_in(df: DataFrame, known: DataFrame, on: str, column: str) -> DataFrame:
    """``df`` with a column filled from ``known`` (one row a key) where it is null or blank; other values stay."""
    k = known.select(on, F.col(column).alias("_known"))
    own = F.nullif(F.trim(F.col(column)), F.lit(""))
    return df.join(k, on, "left").withColumn(column, F.coalesce(own, "_known")).drop("_known")


def with_defaults(df: DataFrame, known: DataFrame, on: str, defaults: dict[str, object]) -> tuple[DataFrame, DataFrame]:
    """``df`` with columns of ``known``, defaults where it has no row; and the number of such misses, one row."""
    j = df.join(known.select(on, *defaults, F.lit(True).alias("_hit")), on, "left")
    return j.select(*df.columns, *[F.coalesce(c, F.lit(v)).alias(c) for c, v in defaults.items()]), j.agg(F.count_if(F.col("_hit").isNull()).alias("misses"))


def paired(ids: DataFrame, left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """All ids with the rows of two sides and, where a side is missing, which: no_bio, no_article_sections."""
    a, b = left.withColumn("_a", F.lit(True)), right.withColumn("_b", F.lit(True))
    reason = F.when(F.col("_a").isNull(), "no_bio").when(F.col("_b").isNull(), "no_article_sections")
    return ids.join(a, key, "left").join(b, key, "left").withColumn("reason", reason).drop("_a", "_b")


def richest(df: DataFrame, key: str, size: Column, pos: Column) -> DataFrame:
    """One row per key: the one of the greatest size, the first of these."""
    return keep_first(df, [key], [F.desc(size), pos])


def tagged(parts: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """The rows of several frames with the name of theirs; missing columns are null."""
    frames = [df.withColumn(tag, F.lit(name)) for name, df in parts.items()]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def all_ids(*parts: DataFrame) -> DataFrame:
    """The distinct ids (one column) of several frames."""
    out = parts[0]
    for df in parts[1:]:
        out = out.union(df)
    return out.distinct()


def merged_lists(*lists: Column) -> Column:
    """Several arrays as one, each value once, at its first place."""
    return F.array_distinct(F.concat(*lists))
