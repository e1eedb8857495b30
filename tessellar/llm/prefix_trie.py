"""The prefix trie of conversations, with totals of every subtree by leaf-peeling message passing.

1. Turns get a place in their conversation by a running window, and every prefix a 128-bit fingerprint: the exclusive or of
   hashes of (place, turn) up to there, so it is one more running window over narrow rows; texts are never shuffled.
2. Rows of equal depth and fingerprint are a node, counted with partial sums. The nodes whose smallest member is the same
   conversation form a path from its top down to that conversation's end; a path hangs below a node of another path.
3. Paths are peeled: each keeps the number of paths that still hang below it; a path without any sends the totals of its
   subtree to the node that it hangs below, a message for each such node, and leaves; until only the root's path is left.
   A round is a join of paths with the messages summed by their receivers, so a node with a third of all paths below it
   gets one row. After ``ROUNDS`` rounds the rest, if counted to be at most ``FEW`` paths, is peeled in one task in the same
   way, which bounds the rounds of tries that hang path below path.
4. Inside a path the totals are running sums from its end up to its top, of the nodes' own values and their messages.

The digest of the conversations that end at a node is a hash of one long text, so its bytes pass one hash function in order.
Ids are sorted by ranges and joined to pieces of up to ``PIECE`` ids where they lie; a node's pieces are then read in
order, one held at a time.

Cases: null roles and texts are empty; a null turn comes first; turns of equal number are ordered by their fingerprint, so
repeated rows are repeated turns and the table's order doesn't matter; rows without a conversation id take no part; an empty
table gives an empty result, as there is no conversation that a root could have; texts of any length are hashed whole;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, doc_crc, small, text_or_empty, word_count

#: Children below a node from which it is sent to its children by a broadcast, if these nodes are few.
HOT = 10_000
#: Rounds over all paths, and the paths that may then be peeled in one task.
ROUNDS, FEW = 12, 100_000
#: Ids of a piece of the list of conversations that end at a node.
PIECE = 8192

NODE = ["depth", "a", "b"]


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, n (the place from 1), key (128 bits of role and text), words of the text."""
    role, text = text_or_empty("role"), text_or_empty("text")
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.unhex(F.md5(F.concat(F.length(role), F.lit(":"), role, text))).alias("key"),
        word_count(text).alias("words"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "key")
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("n"), "key", "words")


def rebuilt(own: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Turns (conv_id, place, key, words) with a shared beginning: the first h turns of conversation c - c % group, then those
    of c after its own first h; h is the crc32 of c, modulo ``most``. A conversation that gets no turn has a row without a place."""
    ids = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns")).withColumn("h", doc_crc("conv_id") % most)
    turn = F.struct("n", "key", "words")
    heads = own.filter((F.col("conv_id") % group == 0) & (F.col("n") < most)).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(turn)).alias("head"))  # under ``most`` turns each
    none = F.array().cast(heads.schema["head"].dataType)
    of = ids.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(heads, "base", "left")
    of = of.select("conv_id", "turns", "h", F.slice(F.coalesce("head", none), 1, F.col("h").cast("int")).alias("head"))
    first = of.select("conv_id", F.lit(0).alias("mine"), F.explode("head").alias("t")).select("conv_id", "mine", "t.*")
    rest = own.filter(F.col("n") > doc_crc("conv_id") % most).select("conv_id", F.lit(1).alias("mine"), "n", "key", "words")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("mine", "n")).cast("long")
    both = first.unionByName(rest).select("conv_id", place.alias("place"), "key", "words")
    without = of.filter((F.size("head") == 0) & (F.col("turns") <= F.col("h"))).select("conv_id", F.lit(None).cast("long").alias("place"), F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("words"))
    return both.unionByName(without)


def prefixes(rows: DataFrame) -> DataFrame:
    """Each turn (conv_id, place, key, words) with the fingerprint (a, b) of the prefix that it ends, that of the prefix before (pa, pb), and whether it is the last."""
    order = Window.partitionBy("conv_id").orderBy("place")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x, y = F.xxhash64("place", "key"), F.xxhash64("key", "place", F.lit(1))
    marked = rows.withColumns({"x": x, "y": y})
    summed = marked.withColumns({"a": F.bit_xor("x").over(so_far), "b": F.bit_xor("y").over(so_far), "last": F.lead("place").over(order).isNull()})
    return summed.select("conv_id", F.col("place").alias("depth"), "a", "b", F.col("a").bitwiseXOR(F.col("x")).alias("pa"), F.col("b").bitwiseXOR(F.col("y")).alias("pb"), "words", "last")


def _nodes(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """A row for each node: depth, fingerprint, the parent's, conv (smallest member), members, words of its last turn; the root as depth 0."""
    zero = F.lit(0).cast("long")
    inner = rows.groupBy(*NODE).agg(F.min("conv_id").alias("conv"), F.count(F.lit(1)).alias("members"), F.first("words").alias("words"), F.first("pa").alias("pa"), F.first("pb").alias("pb"))
    root = ids.agg(F.min("conv_id").alias("conv"), F.count(F.lit(1)).alias("members")).filter("members > 0")
    none = F.lit(None).cast("long")
    return inner.unionByName(root.select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "conv", "members", zero.alias("words"), none.alias("pa"), none.alias("pb")))


def _paths(nodes: DataFrame) -> DataFrame:
    """A row for each path: conv, top and bottom depth, its nodes' own saved tokens, and where it hangs: conv ``p`` and depth ``at`` (null for the root's)."""
    top = F.min_by(F.struct("pa", "pb"), "depth")
    own = cut(nodes.groupBy("conv").agg(F.min("depth").alias("top"), F.max("depth").alias("bottom"), F.sum((F.col("members") - 1) * F.col("words")).alias("saved"), top.alias("up")).select("conv", "top", "bottom", "saved", "up.pa", "up.pb"))
    below = own.filter("top > 0").withColumn("at", F.col("top") - 1)
    above = nodes.select(F.col("depth").alias("at"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv").alias("p"))
    keys = ["at", "pa", "pb"]
    crowded = cut(below.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= HOT).join(above, keys).select(*keys, "p"))
    many = below.join(small(crowded), keys)
    others = below.join(small(crowded.select(*keys)), keys, "left_anti").join(above, keys)
    root = own.filter("top = 0").withColumns({"at": F.lit(None).cast("long"), "p": F.lit(None).cast("long")})
    columns = ["conv", "top", "bottom", "saved", "p", "at"]
    return many.select(columns).unionByName(others.select(columns)).unionByName(root.select(columns))


MAIL = "p long, at long, leaves long, saved long, n long"


def _peeled_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All messages of the paths (conv, p, at, leaves, saved, remaining) that one task holds."""
    paths = {r["conv"]: r for b in batches for r in b.to_pylist()}
    ready, mail = [c for c, r in paths.items() if not r["remaining"]], []
    while ready:
        r = paths[ready.pop()]
        if r["p"] is None:
            continue
        mail.append({"p": r["p"], "at": r["at"], "leaves": r["leaves"], "saved": r["saved"], "n": 1})
        up = paths[r["p"]]
        up["leaves"] += r["leaves"]
        up["saved"] += r["saved"]
        up["remaining"] -= 1
        if not up["remaining"]:
            ready.append(up["conv"])
    yield pa.RecordBatch.from_pylist(mail, schema=pa.schema([(f.split()[0], pa.int64()) for f in MAIL.split(", ")]))


def _peel(paths: DataFrame, kids: DataFrame) -> DataFrame:
    """The messages (p, at, leaves, saved) that nodes get, of paths that hang below them (kids: p, at, kids)."""
    hanging = kids.groupBy("p").agg(F.sum("kids").alias("remaining"), F.max("at").alias("deepest"))
    state = paths.join(hanging.withColumnRenamed("p", "conv"), "conv", "left")
    leaf = F.when(F.col("deepest") == F.col("bottom"), 0).otherwise(1).cast("long")
    state = cut(state.select("conv", "p", "at", leaf.alias("leaves"), "saved", F.coalesce("remaining", F.lit(0)).alias("remaining")))
    sums = [F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")]
    sent, number = None, 0
    while True:
        number += 1
        if number > ROUNDS and state.limit(FEW + 1).count() <= FEW:
            rest = state.repartition(1).mapInArrow(_peeled_here, MAIL)
            return rest if sent is None else sent.unionByName(rest)
        done = state.filter("remaining = 0 and p is not null")
        mail = cut(done.groupBy("p", "at").agg(*sums, F.count(F.lit(1)).alias("n")))
        if mail.isEmpty():
            return mail if sent is None else sent
        sent = mail if sent is None else sent.unionByName(mail)
        got = mail.groupBy("p").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"), F.sum("n").alias("n")).withColumnRenamed("p", "conv")
        left = state.filter("remaining > 0").join(got, "conv", "left")
        more = lambda c, x: (F.col(c) + F.coalesce(x, F.lit(0))).alias(c)
        state = cut(left.select("conv", "p", "at", more("leaves", "l"), more("saved", "s"), (F.col("remaining") - F.coalesce("n", F.lit(0))).alias("remaining")))


def _pieces(most: int):
    """Of rows (depth, a, b, conv_id) in order: pieces of each node's list (depth, a, b, first, ids), of ``most`` ids at most."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True))[:4]), pa.array([r[4] for r in rows], pa.string())], names=[*NODE, "first", "ids"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, out = None, [], []
        for batch in batches:
            for *k, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids and (k != key or len(ids) == most):
                    out.append((*key, ids[0], ",".join(map(str, ids))))
                    ids.clear()
                key = k
                ids.append(conv)
            if out:
                yield batch_of(out)
                out.clear()
        if ids:
            yield batch_of([(*key, ids[0], ",".join(map(str, ids)))])

    return work


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pieces in order: each node's digest (depth, a, b, digest)."""
    key, sha, out = None, None, []

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True))[:3]), pa.array([r[3] for r in rows], pa.string())], names=[*NODE, "digest"])

    for batch in batches:
        *keys, ids = (c.to_pylist() for c in batch.columns)
        for *k, part in zip(*keys[:3], ids, strict=True):
            if k == key:
                sha.update(b",")
            else:
                if key is not None:
                    out.append((*key, sha.hexdigest()))
                key, sha = k, hashlib.sha256()
            sha.update(part.encode())
        if out:
            yield batch_of(out)
            out.clear()
    if key is not None:
        yield batch_of([(*key, sha.hexdigest())])


def ends_digests(ends: DataFrame) -> DataFrame:
    """depth, a, b, digest: SHA-256 of the ids (conv_id) that end at each node, ascending, joined by commas. ``ends`` should be cut."""
    in_ranges = ends.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    pieces = in_ranges.select(*NODE, "conv_id").mapInArrow(_pieces(PIECE), "depth long, a long, b long, first long, ids string")
    in_order = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first")
    return in_order.mapInArrow(_digests, "depth long, a long, b long, digest string")


def trie(rows: DataFrame) -> DataFrame:
    """The nodes of conversations (conv_id, place, key, words), those without turns having one row without a place.

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: see the query ``op11_prefix_trie``.
    """
    zero = F.lit(0).cast("long")
    placed = cut(prefixes(rows.filter("place is not null")))
    without = rows.filter("place is null").select("conv_id")
    ends = cut(placed.filter("last").select(*NODE, "conv_id").unionByName(without.select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "conv_id")))
    nodes = cut(_nodes(placed, ends.select("conv_id")))
    paths = cut(_paths(nodes))
    kids = cut(paths.filter("p is not null").groupBy("p", "at").agg(F.count(F.lit(1)).alias("kids")))
    mail = _peel(paths, kids).groupBy("p", "at").agg(F.sum("leaves").alias("in_leaves"), F.sum("saved").alias("in_saved")).join(kids, ["p", "at"])
    mail = mail.select(F.col("p").alias("conv"), F.col("at").alias("depth"), "in_leaves", "in_saved", "kids")
    of = nodes.join(ends_digests(ends), NODE, "left").select("conv", "depth", "members", "words", "digest").join(mail, ["conv", "depth"], "left")
    up = Window.partitionBy("conv").orderBy(F.desc("depth"))
    last = F.lag("depth").over(up).isNull()
    number = lambda c: F.coalesce(c, zero)
    of = of.join(paths.select("conv", "top", "p"), "conv").withColumns({"inside": F.when(last, zero).otherwise(1), "kids": number("kids")})
    total = lambda x: F.sum(x).over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    own_leaf = F.when((F.col("inside") == 0) & (F.col("kids") == 0), 1).otherwise(0)
    return of.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.when(F.col("depth") > F.col("top"), F.col("conv")).otherwise(F.col("p")).alias("parent_conv_id"),
        F.col("members").alias("n_convs"),
        (F.col("kids") + F.col("inside")).cast("long").alias("n_children"),
        total(own_leaf + number("in_leaves")).cast("long").alias("n_leaves"),
        total((F.col("members") - 1) * F.col("words") + number("in_saved")).cast("long").alias("saved_tokens"),
        F.coalesce("digest", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def report(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of a table (conv_id, turn, role, text)."""
    return trie(cut(rebuilt(cut(turns(conversations)))))
