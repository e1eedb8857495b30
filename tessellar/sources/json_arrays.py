"""Files that are one large JSON array each, read by many tasks.

A file is read through Spark's text source, cut at closing braces in place of line ends, so it is split by byte ranges like a
file of lines, in any store. Where an element ends depends on what stands before a split: whether its first byte is inside a
string, and how deep it is nested. Both are sums that can be taken split by split:

1. Each split tells whether it holds an odd number of quotes, and how far it goes up or down in depth, once for either case
   of its first byte. These few numbers are added up in the order of a file's splits: a row for each split.
2. Each split, now knowing where it begins, cuts its bytes at the commas of depth 1. What lies between two cuts is an element;
   the first and the last piece of a split go to the elements that it shares with its neighbours, and are joined by file.

A split is scanned in chunks, array operations over its bytes; nothing is parsed but by Spark's own reader of JSON, element by
element. An escape never straddles two pieces, as no escape is made with a brace.

Cases: an empty file or array has no elements; white space around elements is dropped; an element that isn't what the schema
says is left out, or an error if ``strict``; strings hold any signs, escapes, braces and quotes; files without an array have no elements.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as st

from ..session import cut

#: Bytes of a split that are scanned at once; splits whose beginnings are broadcast.
CHUNK, FEW = 1 << 20, 500_000

_PLACE = "file long, split long"


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[tuple[int, int], bytes]]:
    """Of rows (file, split, value), value up to a brace: each split's bytes, chunk by chunk, the braces put back."""
    key, held, size = None, [], 0
    for batch in batches:
        for *k, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if tuple(k) != key or size > most:
                if held:
                    yield key, b"".join(held)
                key, held, size = tuple(k), [], 0
            data = value.encode() + b"}"
            held.append(data)
            size += len(data)
    if held:
        yield key, b"".join(held)


def _marks(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes; how many quotes that aren't escaped stand up to each byte; the step in depth at each byte, strings or not."""
    b = np.frombuffer(data, np.uint8)
    at = np.arange(len(b))
    last = np.maximum.accumulate(np.where(b != 92, at, -1))  # of what isn't a backslash
    before = np.concatenate([[-1], last[:-1]])
    quotes = np.cumsum((b == 34) & ((at - 1 - before) % 2 == 0))
    step = ((b == 123) | (b == 91)).astype(np.int8) - ((b == 125) | (b == 93)).astype(np.int8)
    return b, quotes, step


def _summaries(most: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list[int]] = {}  # of the splits of one task: parity of quotes, depth from outside and from inside a string
        for key, data in _pieces(batches, most):
            own = sums.setdefault(key, [0, 0, 0])
            _, quotes, step = _marks(data)
            inside = (quotes + own[0]) % 2 == 1
            own[1] += int(step[~inside].sum())
            own[2] += int(step[inside].sum())
            own[0] = (own[0] + int(quotes[-1])) % 2
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*((*k, *v) for k, v in sums.items()), strict=True)], names=["file", "split", "odd", "out", "within"])

    return work


def _begins(d: pd.DataFrame) -> pd.DataFrame:
    """Where each split of a file begins: inside a string or not, and how deep. A file's rows are as many as its splits."""
    d, inside, depth, rows = d.sort_values("split"), 0, 0, []
    for r in d.itertuples():
        rows.append((r.file, r.split, inside, depth))
        depth += r.within if inside else r.out
        inside ^= r.odd
    return pd.DataFrame(rows, columns=["file", "split", "inside", "depth"])


def _elements(most: int):
    """Of rows (file, split, value) and each split's beginning: (file, split, nth, first, last, text); ``first`` and ``last`` say that an element is open on that side."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, depth, held, nth, whole_before = None, 0, 0, [], 0, False
        begins: dict[tuple[int, int], tuple[int, int]] = {}

        def plain() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for f, s, i, dp in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4)), strict=True):
                    begins.setdefault((f, s), (i, dp))
                yield batch.select([0, 1, 2])

        def row(texts: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*texts, strict=True)], names=["file", "split", "nth", "open", "going", "text"])

        for k, data in _pieces(plain(), most):
            out = []
            if k != key:
                if key is not None:
                    out.append((*key, nth, not whole_before, True, b"".join(held).decode(errors="replace")))
                key, (inside, depth) = k, begins[k]
                held, nth, whole_before = [], 0, False
            b, quotes, step = _marks(data)
            outside = (quotes + inside) % 2 == 0
            deep = depth + np.cumsum(np.where(outside, step, 0))
            cuts = np.flatnonzero(outside & (((b == 44) & (deep == 1)) | ((b == 91) & (deep == 1)) | ((b == 93) & (deep == 0))))
            at = 0
            for c in cuts.tolist():
                held.append(data[at:c])
                out.append((*key, nth, not whole_before, False, b"".join(held).decode(errors="replace")))
                held, nth, whole_before, at = [], nth + 1, True, c + 1
            held.append(data[at:])
            inside, depth = (inside + int(quotes[-1])) % 2, int(deep[-1])
            if out:
                yield row(out)
        if key is not None:
            yield row([(*key, nth, not whole_before, True, b"".join(held).decode(errors="replace"))])

    return work


def _joined(d: pd.DataFrame) -> pd.DataFrame:
    """The elements that several splits of a file share, from their pieces: at most two a split."""
    out, held = [], []
    for r in d.sort_values(["split", "nth"]).itertuples():
        held.append(r.text)
        if not r.going:
            out.append("".join(held))
            held = []
    return pd.DataFrame({"text": out}, columns=["text"])


def elements(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The elements (text) of the arrays that the files hold, as JSON texts, in no order."""
    rows = spark.read.option("lineSep", "}").text(path).select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")
    sums = rows.mapInArrow(_summaries(CHUNK), f"{_PLACE}, odd long, out long, within long")
    begins = cut(sums.groupBy("file").applyInPandas(_begins, f"{_PLACE}, inside long, depth long"))
    columns = ["file", "split", "value", "inside", "depth"]
    if begins.count() <= FEW:  # four numbers for each split; the rows of a split stay in their order
        found = rows.join(F.broadcast(begins), ["file", "split"]).select(columns)
    else:
        found = rows.withColumn("at", F.monotonically_increasing_id()).join(begins, ["file", "split"]).sortWithinPartitions("file", "split", "at").select(columns)
    pieces = found.mapInArrow(_elements(CHUNK), f"{_PLACE}, nth long, open boolean, going boolean, text string")
    whole = pieces.filter("not open and not going").select("text")
    shared = pieces.filter("open or going").groupBy("file").applyInPandas(_joined, "text string")
    return whole.unionByName(shared).select(F.regexp_replace("text", r"^\s+|\s+$", "").alias("text")).filter("text <> ''")


def read_array(spark: SparkSession, path: str | list[str], schema: str | st.StructType, strict: bool = False) -> DataFrame:
    """The elements as rows of a schema; malformed ones are errors if strict, else left out."""
    kind = st.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    marked = st.StructType([*kind.fields, st.StructField("_bad", st.StringType())])
    parsed = elements(spark, path).select(F.from_json("text", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"), "text")
    if strict:
        wrong = F.raise_error(F.concat(F.lit("malformed element: "), F.left("text", F.lit(200))))
        return parsed.filter(F.when(F.col("r._bad").isNotNull() | ~F.startswith("text", F.lit("{")), wrong.cast("boolean")).otherwise(F.lit(True))).select(*[F.col(f"r.{f.name}") for f in kind.fields])
    return parsed.filter(F.col("r._bad").isNull() & F.startswith("text", F.lit("{"))).select(*[F.col(f"r.{f.name}") for f in kind.fields])
