"""Sources and sinks. Tables are Parquet; pair and prediction files may be CSV."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairmatch.operators.joins import lookup_join
from pairmatch.session import written

PAIR_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("qid1", T.LongType()),
        T.StructField("qid2", T.LongType()),
        T.StructField("question1", T.StringType()),
        T.StructField("question2", T.StringType()),
        T.StructField("is_duplicate", T.IntegerType()),
    ]
)
VECTOR_SCHEMA = "word string, vector array<float>"
MANIFEST = "batch string, folder string, at long"


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pair CSV with a header; quoted texts may hold quotes and line ends."""
    return (
        spark.read.schema(PAIR_SCHEMA)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .csv(path)
    )


def read_wordlist(spark: SparkSession, path: str, column: str | None = None) -> DataFrame:
    """One-column CSV as ``(word)``; byte-order mark and CR line ends are accepted."""
    raw = spark.read.option("header", True).csv(path)
    name = column or raw.columns[0]
    return raw.select(F.col(f"`{name}`").cast("string").alias("word"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Word vectors ``(word, vector)``."""
    return spark.read.schema(VECTOR_SCHEMA).parquet(path)


def write_stage(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write an intermediate table, as Parquet or as CSV with a header."""
    writer = df.write.mode("errorifexists")
    if fmt == "csv":
        writer.options(
            header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
        ).csv(path)
    else:
        writer.parquet(path)


def append_features(df: DataFrame, path: str, batch: str | None = None) -> None:
    """Append rows ``(id, type, ..)`` to a feature store.

    A store has its rows below ``data``, one folder per append and in it one per ``type``, and a
    ``manifest`` that names the folder of each ``batch``. Rows are sorted by type and id over the
    files of an append, with a Bloom filter of the ids, so that ranges and single ids skip most
    row groups. The manifest is added to last, and a batch counts by its latest entry: an append
    that failed leaves no trace in what is read, and one that is repeated replaces itself.
    """
    spark = df.sparkSession
    at = time.time_ns()
    folder = f"data/entry={at:020d}-{uuid.uuid4().hex}"
    # dealing by ranges reads the rows twice, so they are computed once first
    df = written(df, "appended")
    in_order = df.repartitionByRange(F.col("type"), F.col("id")).sortWithinPartitions("type", "id")
    in_order.write.partitionBy("type").options(
        **{"compression": "zstd", "parquet.bloom.filter.enabled#id": "true"}
    ).parquet(f"{path}/{folder}")
    entry = spark.createDataFrame([(batch or uuid.uuid4().hex, folder, at)], MANIFEST)
    entry.coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def store_folders(spark: SparkSession, path: str) -> list[str]:
    """The folders that count, in the order they were added: one per batch."""
    entries = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    latest = entries.groupBy("batch").agg(F.max_by("folder", "at").alias("folder"))
    return sorted(f"{path}/{r['folder']}" for r in latest.collect())


def _store_files(spark: SparkSession, path: str, files: list[str]) -> DataFrame:
    """Rows of some folders or files of a store, with the name of their ``entry``."""
    return spark.read.option("basePath", f"{path}/data").parquet(*files)


def read_features(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Rows of a feature store; ``kind`` reads only the folders of that type."""
    store = _store_files(spark, path, store_folders(spark, path)).drop("entry")
    return store if kind is None else store.where(F.col("type") == kind)


def read_feature_range(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """The rows at the places ``start`` to ``stop - 1`` of a feature store.

    Rows are counted from 0 in the order of appends, types and ids. Only files with rows in the
    range are read; their names and counts are what the driver gets.
    """
    store = _store_files(spark, path, store_folders(spark, path))
    found = file_places(store).where(
        (F.col("before") < stop) & (F.col("before") + F.col("n") > start)
    )
    files = [(r["file"], r["before"]) for r in found.collect()] if stop > start else []
    if not files:
        return store.drop("entry").limit(0)
    rows = _store_files(spark, path, [file for file, _ in files])
    table = spark.createDataFrame(files, "file string, before long")
    place = F.col("before") + F.col("_at")
    return (
        with_row_index(rows)
        .join(F.broadcast(table), "file")
        .where((place >= start) & (place < stop))
        .drop("file", "before", "_at", "entry")
    )


def with_row_index(rows: DataFrame) -> DataFrame:
    """Rows of a Parquet table with their ``file`` and their place ``_at`` in it."""
    return rows.select(
        "*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("_at")
    )


def file_places(rows: DataFrame) -> DataFrame:
    """``(file, n, before)`` of a Parquet table: rows of each file and of those before it.

    Files are ordered by their path. Counting rows reads no column, and the window has a row per
    file.
    """
    files = rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def read_chunked(spark: SparkSession, path: str, size: int = 50_000) -> DataFrame:
    """A Parquet table with the number ``chunk`` of each row, ``size`` rows in each.

    Every chunk but the last has exactly ``size`` rows, however these lie in files: the place of
    a row is its index in its file plus the rows of all files before. Nothing is shuffled; the
    table of files is counted before it is broadcast. Chunks are for functions and sinks that
    take a bounded number of rows (``apply_by_key``, ``partitionBy("chunk")``).
    """
    files = written(file_places(spark.read.parquet(path)), "files")
    keyed = with_row_index(spark.read.parquet(path))
    placed = lookup_join(keyed, files.drop("n"), ["file"], files, F.col("_at"))
    chunk = F.floor((F.col("before") + F.col("_at")) / size)
    return placed.withColumn("chunk", chunk).drop("file", "before", "_at")


def prediction_rows(scored: DataFrame) -> DataFrame:
    """``(test_id, is_duplicate)`` in ascending order of ``test_id``."""
    return scored.select(
        F.col("test_id").cast("long").alias("test_id"),
        F.col("is_duplicate_1").cast("float").alias("is_duplicate"),
    ).orderBy("test_id")


def write_predictions(scored: DataFrame, path: str) -> None:
    """Write predictions as CSV with a header, sorted by ``test_id`` across its files."""
    prediction_rows(scored).write.option("header", True).csv(path)
