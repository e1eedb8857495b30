"""Dependency graphs over extracted steps."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def category_edges(nodes: DataFrame) -> DataFrame:
    """Edges (key, u, v) between steps u < v whose category comes earlier; a step that is repeated is paired once."""
    a = nodes.select("key", F.col("idx").alias("u"), "cat").repartition("key").distinct()
    b = a.select("key", F.col("u").alias("v"), F.col("cat").alias("cat_v"))
    return a.join(b, "key").filter("u < v and cat < cat_v").select("key", "u", "v").distinct()


def material_edges(nodes: DataFrame) -> DataFrame:
    """Edges (key, u, v) from a step that makes a material to a later or earlier step that uses it; no loops, repeated steps once."""
    of = lambda c, idx: nodes.select("key", F.col("idx").alias(idx), F.explode(F.transform(c, lambda m: F.lower(F.trim(m)))).alias("m")).repartition("key", "m").distinct()
    return of("outputs", "u").join(of("inputs", "v"), ["key", "m"]).filter("u <> v").select("key", "u", "v").distinct()


def topological_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """key, idx, pos: first in, first out over nodes without open predecessors; what cycles hold back follows by index."""
    packed = nodes.groupBy("key").agg(F.sort_array(F.collect_set("idx")).alias("idx"))
    links = edges.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("u", "v"))).alias("links"))

    def order(frames):
        for f in frames:
            rows = []
            for key, idx, linked in f.itertuples(index=False):
                after, open_ = {i: [] for i in idx}, dict.fromkeys(idx, 0)
                for x in linked if linked is not None else []:
                    after[x["u"]].append(x["v"])
                    open_[x["v"]] += 1
                queue, done = deque(i for i in idx if not open_[i]), []
                while queue:
                    done.append(i := queue.popleft())
                    for v in after[i]:
                        open_[v] -= 1
                        if not open_[v]:
                            queue.append(v)
                seen = set(done)
                rows += [(key, i, p) for p, i in enumerate(done + [i for i in idx if i not in seen])]
            yield pd.DataFrame(rows, columns=["key", "idx", "pos"])

    return packed.join(links, "key", "left").mapInPandas(order, "key long, idx long, pos long")
