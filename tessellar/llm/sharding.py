"""Sharding by fixed virtual slots.

Every record is hashed into one of thousands of virtual slots; bytes and rows are summed per slot; a versioned map
says which shard holds a slot. Balancing edits the map, never the hash: a new version moves some slots and leaves
the others where they were. The slot table has a fixed size (``slots`` rows), so the map is built in one small task
and broadcast, whatever the corpus holds; the texts themselves are never shuffled. Versions of a map are kept as a table
in the shared folder (``save_map``, ``load_map``); records are placed by the version that is read from there.

Equal records hash alike, so many of them would make one slot hot. Slots with more than ``HOT`` times the mean bytes are
marked ``spread`` in the map. Equal records of such a slot are told apart by a number from 0 on, and a record goes to the slot
that its hash and its number give; so the map and the record say where it lies (``located``), whatever order rows are read in.
Numbers are given without gathering equal records: they are counted in salted groups, and each group takes its run of numbers.

Cases: a null text counts no bytes beyond the fixed overhead, and its crc32 is 0; null ids and repeated rows are
placed like any others (the hash also takes the text's crc32, so that rows without an id spread out); texts of any length
are one record; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, shared_folder

SLOTS = 8192
OVERHEAD = 16
#: Times the mean bytes of a slot beyond which its records are spread over all slots.
HOT = 8
#: Groups in which equal records of a hot slot are counted, and the numbers that a task gives them in one run.
SALTS, RUN = 64, 100_000


def _hashed(slots: int, *parts: Column) -> Column:
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), F.lit(slots)).cast("int")


def _home(slots: int) -> Column:
    """The slot of a record by its id and the crc32 of its text."""
    return _hashed(slots, F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text_crc32").cast("string"))


def _numbered(slots: int) -> Column:
    """The slot of a record of a spread slot, by its number, too."""
    return _hashed(slots, F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text_crc32").cast("string"), F.col("nth").cast("string"))


def measured(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual slot of each record; a map-side projection."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    return rows.withColumn("vslot", _home(slots))


def slot_stats(records: DataFrame) -> DataFrame:
    """Bytes and rows of each virtual slot: at most ``slots`` rows after map-side sums."""
    return records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))


def spread(records: DataFrame, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """The records, those of hot slots with a number and the slot that it gives; and the hot slots (vslot, spread)."""
    kept = cut(records.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))))
    stats = slot_stats(kept)
    mean = stats.agg((F.sum("bytes") / F.lit(slots)).alias("mean"))
    hot = cut(stats.crossJoin(F.broadcast(mean)).filter((F.col("bytes") > HOT * F.col("mean")) & (F.col("n") > 1)).select("vslot", F.lit(True).alias("spread")))
    # ``slots`` rows at most
    alone = kept.join(F.broadcast(hot.select("vslot")), "vslot", "left_anti").select("doc_id", "size", "text_crc32", "vslot", F.lit(0).cast("long").alias("nth"))
    equal = ["doc_id", "size", "text_crc32"]
    groups = kept.join(F.broadcast(hot.select("vslot")), "vslot", "left_semi").groupBy(*equal, "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*equal).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)  # SALTS rows at most
    runs = groups.withColumn("begin", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # runs are dealt out before they become rows again
    dealt = runs.select(*equal, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))).alias("run"), "begin", "n").repartition(*equal, "run")
    numbers = F.sequence(F.col("begin") + F.col("run") * RUN, F.col("begin") + F.least(F.col("n"), (F.col("run") + 1) * RUN) - 1)
    many = dealt.select(*equal, F.explode(numbers).alias("nth"))
    return cut(alone.unionByName(many.withColumn("vslot", _numbered(slots)).select("doc_id", "size", "text_crc32", "vslot", "nth"))), hot


def _longs(n: int) -> Column:
    return F.array_repeat(F.lit(0).cast("long"), n)


def _deal(slots: Column, loads: Column, shards: int) -> Column:
    """Give each slot, the heaviest first, to the shard with the least bytes; ties go to the lowest shard."""
    ordered = F.array_sort(slots, lambda a, b: F.when(a["bytes"] != b["bytes"], F.when(a["bytes"] > b["bytes"], -1).otherwise(1)).otherwise((a["vslot"] - b["vslot"]).cast("int")))
    empty = F.from_json(F.lit("[]"), "array<struct<vslot:int,shard:int,bytes:bigint,n:bigint>>")
    start = F.struct(loads.alias("loads"), empty.alias("out"))

    def put(state: Column, slot: Column) -> Column:
        at = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        return F.struct(
            F.transform(state["loads"], lambda x, i: F.when(i == at, x + slot["bytes"]).otherwise(x)).alias("loads"),
            F.concat(state["out"], F.array(F.struct(slot["vslot"].alias("vslot"), at.alias("shard"), slot["bytes"].alias("bytes"), slot["n"].alias("n")))).alias("out"),
        )

    return F.aggregate(ordered, start, put, lambda s: s["out"])


def first_map(stats: DataFrame, shards: int, version: int = 1) -> DataFrame:
    """Version 1 of the slot map: vslot, shard, version, and where the slot's rows begin in the shard."""
    packed = stats.agg(F.collect_list(F.struct("vslot", "bytes", "n")).alias("slots"))
    dealt = packed.select(F.explode(_deal(F.col("slots"), _longs(shards), shards)).alias("s")).select("s.*")
    return _placed(dealt, version)


def rebalanced(old: DataFrame, stats: DataFrame, shards: int) -> DataFrame:
    """The next version of a map for new sums and a possibly larger number of shards.

    A shard keeps its slots up to the mean of bytes; only the slots beyond it, and those of shards that no longer
    exist, are dealt anew. ``stats`` may hold slots that the old map has not.
    """
    mean = stats.agg((F.sum("bytes") / F.lit(shards)).alias("mean"))
    now = stats.join(F.broadcast(old.select("vslot", "shard")), "vslot", "left")
    upto = Window.partitionBy("shard").orderBy("bytes", "vslot")
    now = now.withColumn("upto", F.sum("bytes").over(upto)).crossJoin(F.broadcast(mean))
    keep = F.col("shard").isNotNull() & (F.col("shard") < shards) & (F.col("upto") <= F.col("mean"))
    now = now.select("vslot", "bytes", "n", F.when(keep, F.col("shard")).alias("shard"))
    loads = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.coalesce(F.element_at(F.col("held"), i), F.lit(0).cast("long")))
    sums = now.filter("shard is not null").groupBy("shard").agg(F.sum("bytes").alias("b"))
    held = sums.agg(F.map_from_entries(F.collect_list(F.struct("shard", "b"))).alias("held"))
    pool = now.filter("shard is null").agg(F.collect_list(F.struct("vslot", "bytes", "n")).alias("slots"))
    moved = pool.crossJoin(held).select(F.explode(_deal(F.col("slots"), loads, shards)).alias("s")).select("s.*")
    kept = now.filter("shard is not null").select("vslot", "shard", "bytes", "n")
    version = old.agg((F.coalesce(F.max("version"), F.lit(0)) + 1).cast("int").alias("version"))
    return _placed(kept.unionByName(moved), 0).drop("version").crossJoin(F.broadcast(version))


def save_map(slot_map: DataFrame, path: str) -> None:
    """Add a version of a map to its versions; one that is there already stays as it is."""
    spark = slot_map.sparkSession
    version = slot_map.agg(F.max("version")).first()[0]
    at = f"{path}/version={version or 0}"
    if not _exists(spark, f"{at}/_SUCCESS"):
        slot_map.drop("version").write.mode("overwrite").parquet(at)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version of a map, the latest unless one is named."""
    versions = spark.read.schema("vslot int, shard int, bytes long, n long, begins long, spread boolean, version int").parquet(path)
    if version is None:
        version = versions.agg(F.max("version")).first()[0]
    return versions.filter(F.col("version") == F.lit(version))


def located(records: DataFrame, slot_map: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Records (doc_id, text_crc32, nth: from 0 among equal ones) with the slot and shard that a map puts them in."""
    of = F.broadcast(slot_map.select("vslot", "shard", "spread"))  # ``slots`` rows at most
    home = records.withColumn("vslot", _home(slots)).join(of.select("vslot", "spread"), "vslot", "left")
    return home.withColumn("vslot", F.when(F.col("spread"), _numbered(slots)).otherwise(F.col("vslot"))).drop("spread").join(of.select("vslot", "shard"), "vslot", "left")


def _placed(slots: DataFrame, version: int) -> DataFrame:
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    begins = F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long")
    return slots.select("vslot", "shard", "bytes", "n", begins.alias("begins"), F.lit(version).cast("int").alias("version"))


def assigned(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Each record's shard and its gapless place there. The map has a fixed number of rows, so it is broadcast."""
    inside = Window.partitionBy("vslot").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32", "size", "nth")
    joined = records.withColumn("place", F.row_number().over(inside) - 1).join(F.broadcast(slot_map.select("vslot", "shard", "begins", "version")), "vslot")
    return joined.withColumn("slot", (F.col("begins") + F.col("place")).cast("long"))


def shard_documents(docs: DataFrame, shards: int = 40, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """All of it by the law ``bytes``: shards of near equal size; the contract's columns, then the virtual slot, the map's
    version, and the shard under the next version, which is the stored one edited for one more shard.

    The map's versions are kept at ``path``; by default it is named by the slots' sums and the number of shards, so that runs over the
    same records write the map once and share it.
    """
    spark = docs.sparkSession
    records, hot = spread(measured(docs, slots), slots)
    none = hot.select("vslot", F.lit(0).cast("long").alias("bytes"), F.lit(0).cast("long").alias("n"))  # a hot slot that is left empty keeps its mark
    stats = cut(slot_stats(records).unionByName(none).groupBy("vslot").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")))
    if path is None:
        sums = stats.agg(F.hex(F.bit_xor(F.xxhash64("vslot", "bytes", "n"))).alias("a"), F.hex(F.bit_xor(F.xxhash64("n", "bytes", "vslot"))).alias("b")).first()
        path = f"{shared_folder(spark)}/slot-map-{sums['a']}{sums['b']}-{slots}-{shards}"
    marked = lambda m: m.join(F.broadcast(hot), "vslot", "left").withColumn("spread", F.coalesce("spread", F.lit(False)))
    save_map(marked(first_map(stats, shards)), path)
    now = load_map(spark, path, 1)
    save_map(marked(rebalanced(now.drop("spread"), stats, shards + 1)), path)
    edited = load_map(spark, path, 2).select("vslot", F.col("shard").alias("next_shard"))
    out = assigned(records, now).join(F.broadcast(edited), "vslot")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", F.col("version").alias("map_version"), "next_shard"
    )
