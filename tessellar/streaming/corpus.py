"""Incremental corpus: a stream of documents, each id once within the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.lexical_index import LexicalIndex


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Rows per window and key of a stream or a table."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    return e.groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def first_seen(docs: DataFrame, key: str, time: str | None = None, late: str = "1 hour") -> DataFrame:
    """Each id once.

    On a stream, ``time`` is the column of event times: an id is remembered until the watermark, ``late`` behind the latest time
    seen, has passed the id's own time by ``late``; then its state is dropped. Rows that come later than the watermark are
    dropped, and an id that comes back after it was forgotten is new. Without a time the state would grow with all ids ever
    seen, so that is an error.
    """
    if not docs.isStreaming:
        return docs.dropDuplicates([key])
    if time is None:
        raise ValueError("a stream is deduplicated within a watermark: name its column of event times")
    return docs.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def read_stream(spark: SparkSession, path: str, schema: str, arrays: bool = False, files: int = 100) -> DataFrame:
    """Records of JSON files as they come, lines or arrays, ``files`` of them a batch."""
    return spark.readStream.schema(schema).option("multiLine", arrays).option("maxFilesPerTrigger", files).json(path)


def grow_index(docs: DataFrame, path: str, checkpoint: str, key: str = "doc_id", text: str = "text") -> StreamingQuery:
    """A stream's documents into a kept lexical index, batch by batch; a batch that runs again replaces its own postings.

    After a merge of the index, numbers of batches go on above those that were merged.
    """

    def add(batch: DataFrame, number: int) -> None:
        index = LexicalIndex(batch.sparkSession, path, key)
        index.append(batch, number + 1, text)  # 0 is the batch of a merge

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
