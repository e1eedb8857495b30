"""Readers and writers of the corpus files."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..session import exists
from .json_arrays import read_array


def read_json(spark: SparkSession, path: str | list[str], schema: str, lines: bool = True, strict: bool = False) -> DataFrame:
    """JSON lines, or files of one array each, which many tasks read; malformed records are errors if strict, else left out."""
    if not lines:
        return read_array(spark, path, schema, strict)
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str | None:
    """The first of several candidate paths that is there."""
    return next((p for p in paths if exists(spark, p)), None)


def read_any_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files of arrays or of lines, each by its own first character that isn't white space; a missing path is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    texts = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), F.trim("value").alias("line"))
    heads = texts.filter("line <> ''").groupBy("file").agg(F.min_by(F.substring("line", 1, 1), "at").alias("head"))
    files = {kind: [r["file"] for r in heads.filter(test).select("file").collect()] for kind, test in (("arrays", "head = '['"), ("lines", "head <> '['"))}  # file names only
    parts = [read_json(spark, names, schema, lines=kind == "lines") for kind, names in files.items() if names]
    out = parts[0] if parts else spark.createDataFrame([], schema)
    return out.unionByName(parts[1]) if len(parts) > 1 else out


def id_set(spark: SparkSession, path: str, column: str) -> DataFrame:
    """The distinct ids of a column of a table file that aren't blank."""
    return read_table(spark, path).select(F.trim(column).alias(column)).filter(F.col(column) != "").distinct()


def read_articles(spark: SparkSession, folder: str, pattern: str = "*.xml") -> DataFrame:
    """id (the file's name without ending), path and text of the article files of a folder."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", pattern).text(folder)
    return files.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("id"), F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_documents(spark: SparkSession, folder: str, pages: Callable[[bytes], list[str]], pattern: str = "*.pdf") -> DataFrame:
    """path and text of binary documents: the texts of their pages, a line feed between; ``pages`` is the format's reader.

    A document that it can't read has a null text and the error.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for content in batch.column(1):
                try:
                    texts.append("\n".join(pages(content.as_py())))
                    errors.append(None)
                except Exception as e:  # whatever the reader raises belongs to its document
                    texts.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["path", "text", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "content").mapInArrow(work, "path string, text string, error string")


def read_table(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    return spark.read.option("header", True).option("sep", sep).csv(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("line")).filter("line <> ''")


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: path and text."""
    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def write_table(df: DataFrame, path: str, sep: str = ",", quote: bool = True, mode: str = "overwrite") -> None:
    w = df.write.mode(mode).option("header", True).option("sep", sep)
    (w if quote else w.option("quote", "")).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_index(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """An index table: overwritten, or appended to."""
    df.write.mode(mode).parquet(path)


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A report of one row as one JSON object; more than one row is an error."""
    rows = df.limit(2).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))  # two rows at most
    rows = rows.filter(F.when(F.col("_n") > 1, F.raise_error(F.lit("a report of more than one row")).cast("boolean")).otherwise(F.lit(True))).drop("_n")
    rows.select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode(mode).text(path)


def write_by(df: DataFrame, path: str, columns: Sequence[str], mode: str = "overwrite") -> None:
    """Rows routed into a folder for each value of the columns: splits, or diagnostics by key."""
    df.write.mode(mode).partitionBy(*columns).json(path)


def write_run(df: DataFrame, root: str, status: str, day: Column | None = None) -> None:
    """A run's rows, appended under its date and split by status."""
    df.withColumns({"run_date": T.run_date(day), "run_status": F.col(status)}).write.mode("append").partitionBy("run_date", "run_status").json(root)
