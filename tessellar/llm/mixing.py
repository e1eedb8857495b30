"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Targets: the sources share all words by weight; a target stops at ``max_repeat`` times its source's words and the
   excess goes to the others by weight (water-filling in closed form over the few rows of the source table).
2. Quotas: a source gives every document ``floor(target / words)`` times; the rest of the target is a prefix of its
   blocks in a seeded random order. Only the block at the edge is settled by documents: it is filled until none of its
   documents fits, whatever their sizes.
3. Tree: the drawn blocks of all sources are split exactly among the output shards. A node halves its shards; the
   left half's share of each source is drawn from the multivariate hypergeometric law, source after source, given
   the left half's capacity. The leaves say how many blocks of a source a shard gets; the blocks in the source's
   random order are cut into disjoint runs accordingly. Each task orders its
   rows of a shard by a seeded hash (``mix``).

Blocks of a source are at most ``MAX_BLOCKS`` hash buckets, so that the tree works on bounded numbers; a hot source
is spread over its blocks by map-side sums, and only edge blocks are sorted document by document.

Cases: a null or empty text has size 0 and is taken 0 words; a null source is a source of its own, ordered last;
a source without words has target 0; repeated rows count separately and share a block; a document of any length is whole;
an empty table gives an empty result; other columns, of any names, are carried by ``mix`` and ignored by ``mix_report``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, small, text_or_empty, word_count

MAX_BLOCKS = 512
DOCS_PER_BLOCK = 64
#: Rounds of filling edge blocks between two looks whether a document still fits.
EDGE_ROUNDS = 3
SEED = 20


def _words(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), word_count(text_or_empty()).alias("_size"), F.xxhash64(F.lit(SEED), F.col("doc_id"), F.crc32(text_or_empty().cast("binary"))).alias("_h"))


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """One row per source (``_source, source_size, source_docs``) gets place, weight and target.

    Windows over all rows of the source table: the rule itself ranks the sources, one row each.
    """
    order = Window.orderBy(F.col("_source").asc_nulls_last())
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = sources.withColumn("place", F.row_number().over(order) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(max_repeat))).withColumn("fill", F.col("cap") / F.col("weight"))
    by_fill = Window.orderBy("fill", "place")
    s = s.withColumn("all", F.sum("source_size").over(everything).cast("double"))
    s = s.withColumn("caps_before", F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("weights_from", F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.col("all") - F.col("caps_before")) / F.col("weights_from"))
    s = s.withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    level = F.first(F.when(~F.col("capped"), F.col("level")), ignorenulls=True).over(by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    s = s.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("weight")))
    return s.select("_source", "place", "source_size", "source_docs", "target")


def _quotas(sources: DataFrame, max_repeat: int) -> DataFrame:
    """Whole passes and the words left for the part of a pass; the number of blocks."""
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.least(F.floor(ratio + 1e-9), F.lit(max_repeat)).cast("int")
    blocks = F.least(F.lit(MAX_BLOCKS), F.greatest(F.lit(1), F.ceil(F.col("source_docs") / DOCS_PER_BLOCK))).cast("int")
    return sources.withColumn("whole", whole).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))).withColumn("blocks", blocks)


def _blocks(placed: DataFrame) -> DataFrame:
    """Each block's words, its place in its source's random order, and whether the partial pass takes it wholly or at the edge."""
    b = placed.groupBy("place", "block").agg(F.sum("_size").alias("words"), F.first("rest").alias("rest"), F.first("whole").alias("whole"))
    order = Window.partitionBy("place").orderBy(F.xxhash64(F.lit(SEED + 1), "place", "block"), "block")
    b = b.withColumn("at", F.row_number().over(order) - 1).withColumn("upto", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    left = F.col("rest") - (F.col("upto") - F.col("words"))
    return b.select("place", "block", "whole", "at", (F.col("upto") <= F.col("rest")).alias("full"), F.when((F.col("upto") > F.col("rest")) & (left > 0), left).alias("left"))


def _edge(docs: DataFrame) -> DataFrame:
    """Documents that the partial pass takes from edge blocks: of those that fit, a random prefix within the rest, by rounds until none fits; then the one nearest to the gap if that lessens the miss."""
    of_source = Window.partitionBy("place")
    order = Window.partitionBy("place", "fits").orderBy("_h", "_id", "_size").rowsBetween(Window.unboundedPreceding, 0)
    gap = F.col("left") - F.coalesce(F.sum(F.col("_size") * F.col("extra")).over(of_source), F.lit(0))
    d = docs.withColumn("extra", F.lit(0))
    while True:
        for _ in range(EDGE_ROUNDS):
            d = d.withColumn("gap", gap)
            d = d.withColumn("fits", (F.col("extra") == 0) & (F.col("_size") <= F.col("gap")))
            d = d.withColumn("extra", F.when(F.col("fits") & (F.sum("_size").over(order) <= F.col("gap")), 1).otherwise(F.col("extra")))
        d = cut(d.withColumn("gap", gap))
        if d.filter("extra = 0 and _size <= gap").isEmpty():
            break
    off = F.abs(F.col("_size") - F.col("gap"))
    d = d.withColumn("nth", F.row_number().over(Window.partitionBy("place", "extra").orderBy(off, "_h", "_id")))
    d = d.withColumn("extra", F.when((F.col("nth") == 1) & (off < F.col("gap")), 1).otherwise(F.col("extra")))
    return d.drop("gap", "fits", "nth", "left")


def _log_ratio(k: Column, marked: Column, drawn: Column, total: Column) -> Column:
    """log of P(k+1) / P(k) of the hypergeometric law."""
    return F.log((marked - k) * (drawn - k)) - F.log((k + 1) * (total - marked - drawn + k + 1))


def _hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """A draw by inversion: how many of ``marked`` among ``total`` fall among ``drawn``; u is uniform on [0, 1)."""
    low, high = F.greatest(F.lit(0).cast("long"), drawn + marked - total), F.least(marked, drawn)
    ks = F.when(high > low, F.sequence(low, high - 1)).otherwise(F.expr("cast(array() as array<bigint>)"))
    zero = F.lit(0.0)
    # one pass for the log of the sum of weights against a running maximum, one to find where the sum passes u
    start = F.struct(zero.alias("w"), zero.alias("top"), F.lit(1.0).alias("sum"))

    def add(s: Column, k: Column) -> Column:
        w = s["w"] + _log_ratio(k, marked, drawn, total)
        top = F.greatest(s["top"], w)
        return F.struct(w.alias("w"), top.alias("top"), (s["sum"] * F.exp(s["top"] - top) + F.exp(w - top)).alias("sum"))

    norm = F.aggregate(ks, start, add, lambda s: s["top"] + F.log(s["sum"]))
    begin = F.struct(zero.alias("w"), norm.alias("norm"), F.exp(-norm).alias("sum"), low.alias("k"))

    def seek(s: Column, k: Column) -> Column:
        w = s["w"] + _log_ratio(k, marked, drawn, total)
        return F.struct(w.alias("w"), s["norm"].alias("norm"), (s["sum"] + F.exp(w - s["norm"])).alias("sum"), F.when(s["sum"] <= u, k + 1).otherwise(s["k"]).alias("k"))

    return F.aggregate(ks, begin, seek, lambda s: s["k"])


def split_tree(drawn: DataFrame, shards: int = 16) -> DataFrame:
    """Exact numbers of blocks of each source (``place, n``) for each shard: place, shard, n, before (in lower shards).

    One row per node; its array holds a number per source, so the work is sources x shards, apart from the data.
    """
    packed = drawn.agg(F.array_sort(F.collect_list(F.struct("place", F.col("n").cast("long").alias("n")))).alias("counts"))
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    nodes = packed.withColumn("total", total).withColumn("lo", F.lit(0)).withColumn("hi", F.lit(shards)).filter(F.size("counts") > 0)
    cut_at = lambda j: F.floor(j * F.col("total") / shards).cast("long")
    for _ in range((shards - 1).bit_length()):
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        room, there = cut_at(mid) - cut_at(F.col("lo")), cut_at(F.col("hi")) - cut_at(F.col("lo"))
        start = F.struct(room.alias("room"), there.alias("rest"), F.expr("cast(array() as array<struct<place:int,n:bigint>>)").alias("out"))

        def draw(s: Column, x: Column) -> Column:
            u = F.pmod(F.xxhash64(F.lit(SEED + 2), F.col("lo"), F.col("hi"), x["place"]), F.lit(1 << 52)) / F.lit(float(1 << 52))
            k = _hypergeometric(s["rest"], x["n"], s["room"], u)
            # an array of one, so that the draw is computed once
            return F.element_at(F.transform(F.array(k), lambda d: F.struct((s["room"] - d).alias("room"), (s["rest"] - x["n"]).alias("rest"), F.concat(s["out"], F.array(F.struct(x["place"].alias("place"), d.alias("n")))).alias("out"))), 1)

        left = F.aggregate("counts", start, draw, lambda s: s["out"])
        halves = nodes.withColumn("mid", mid).withColumn("left", F.when(F.col("mid") > F.col("lo"), left).otherwise(F.expr("transform(counts, x -> struct(x.place as place, 0L as n))")))
        right = F.zip_with("counts", "left", lambda a, b: F.struct(a["place"].alias("place"), (a["n"] - b["n"]).alias("n")))
        nodes = halves.select("total", F.explode(F.array(F.struct("lo", F.col("mid").alias("hi"), F.col("left").alias("counts")), F.struct(F.col("mid").alias("lo"), "hi", right.alias("counts")))).alias("x")).select("total", "x.*").filter("hi > lo")
    leaves = nodes.select(F.col("lo").alias("shard"), F.explode("counts").alias("x")).select("x.place", "shard", "x.n")
    before = Window.partitionBy("place").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return leaves.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long"))


def plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3, shards: int = 16) -> DataFrame:
    """One row per document: _id, _source, _size, _h, source_size, target, copies, and the shard of each copy."""
    w = _words(docs)
    sizes = w.groupBy("_source").agg(F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    s = cut(_quotas(targets(sizes, weights, max_repeat), max_repeat))
    held = small(s.withColumnRenamed("_source", "_of"))
    placed = w.join(held, w["_source"].eqNullSafe(held["_of"])).drop("_of").withColumn("block", F.pmod(F.xxhash64(F.lit(SEED + 3), "_h"), F.col("blocks")).cast("int"))
    blocks = cut(_blocks(placed))
    drawn = blocks.groupBy("place").agg(F.sum(F.col("whole") + (F.col("full") | F.col("left").isNotNull()).cast("int")).alias("n"), F.count(F.lit(1)).alias("of"))
    leaves = cut(split_tree(drawn, shards)).groupBy("place").agg(F.array_sort(F.collect_list(F.struct("before", "n", "shard"))).alias("leaves"))
    at = blocks.join(drawn.select("place", "of"), "place").join(leaves, "place")  # narrow rows, sources x MAX_BLOCKS at most
    copies = F.col("whole") + (F.col("full") | F.col("left").isNotNull()).cast("int")
    # copy c of the block at place `at` is draw number c * of + at of its source
    shard_of = lambda c: F.element_at(F.filter("leaves", lambda x: (x["before"] <= c * F.col("of") + F.col("at")) & (x["before"] + x["n"] > c * F.col("of") + F.col("at"))), 1)["shard"]
    block_shards = F.when(copies > 0, F.transform(F.sequence(F.lit(0), copies - 1), shard_of)).otherwise(F.expr("cast(array() as array<int>)"))
    # sources x MAX_BLOCKS rows at most
    at = small(cut(at.select("place", "block", "full", "left", block_shards.alias("block_shards"))))
    p = placed.select("_id", "_source", "_size", "_h", "place", "block", "source_size", "target", "whole").join(at, ["place", "block"])
    sure = p.filter("left is null").withColumn("extra", F.col("full").cast("int")).drop("left")
    out = sure.unionByName(_edge(p.filter("left is not null")))
    n = F.when(F.col("_size") > 0, F.col("whole") + F.col("extra")).otherwise(0)
    return out.select("_id", "_source", "_size", "_h", "source_size", "target", n.alias("copies"), F.slice("block_shards", 1, n).alias("shards"))


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """The contract's columns, then the number of copies and their output shards."""
    return plan(docs, **options).select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("copies")).alias("taken"), "copies", "shards")


def mix(docs: DataFrame, shard: str | None = "mix_shard", order: str | None = None, **options) -> DataFrame:
    """The mixed corpus: a row for each copy of a document with the columns of ``docs``, shuffled inside each shard.

    The copy's shard, and the seeded number that orders rows inside shards, are added by the names given. Each task puts its
    rows in that order shard by shard, so files written by shard are shuffled; no text is moved for it.

    The plan of equal rows (id, text, source) is settled by their number: each takes what all of them take, and the first
    ones take a copy more where the plan gives some of them one.
    """
    own = [F.col("doc_id"), F.xxhash64(F.lit(SEED), F.col("doc_id"), F.crc32(text_or_empty().cast("binary"))), F.col("source")]
    p = plan(docs, **options).groupBy("_id", "_h", "_source")
    p = cut(p.agg(F.min("copies").alias("each"), F.count_if(F.col("copies") > 0).alias("some"), F.max_by("shards", "copies").alias("shards"), F.sum("copies").alias("all"), F.count(F.lit(1)).alias("rows")))
    p = p.filter("some > 0").withColumn("more", F.col("all") - F.col("each") * F.col("rows"))
    even, uneven = small(p.filter("more = 0")), small(p.filter("more > 0"))
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *[c.alias(name) for c, name in zip(own, ("k_id", "k_h", "k_source"), strict=True)])
    same = lambda q: keyed["k_id"].eqNullSafe(q["_id"]) & (keyed["k_h"] == q["_h"]) & keyed["k_source"].eqNullSafe(q["_source"])
    # only rows of equal ones that don't all take the same are numbered
    nth = F.row_number().over(Window.partitionBy("k_id", "k_h", "k_source").orderBy(F.lit(0)))
    numbered = keyed.join(uneven, same(uneven)).withColumn("take", F.col("each") + (nth <= F.col("more")).cast("int"))
    all_rows = keyed.join(even, same(even)).withColumn("take", F.col("each")).unionByName(numbered)
    out = all_rows.select("row", "k_id", "k_h", F.posexplode(F.slice("shards", F.lit(1), F.col("take").cast("int"))).alias("copy", "shard"))
    out = out.withColumn("place", F.xxhash64(F.lit(SEED + 4), "k_id", "k_h", "copy")).sortWithinPartitions("shard", "place")
    return out.select("row.*", *([F.col("shard").alias(shard)] if shard else []), *([F.col("place").alias(order)] if order else []))
