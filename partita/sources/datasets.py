"""Datasets as tables: Parquet in place of pickles, text and CSV, chunks, word lists, folders."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table; pickles are never read, since reading one runs code."""
    if path.endswith((".pickle", ".pkl")):
        raise ValueError("convert pickles to Parquet before; they are not read")
    return spark.read.parquet(path)


def save_text(df: DataFrame, path: str, column: str = "text") -> None:
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def save_pairs(df: DataFrame, path: str) -> None:
    """(pitch, word) pairs as CSV with a header."""
    df.select("pitch", "word").write.mode("overwrite").option("header", "true").csv(path)


def load_chunks(spark: SparkSession, path: str, size: int = 6) -> DataFrame:
    """Chunks (chunk array) cut to between three and eight tokens."""
    return cut_chunks(spark.read.parquet(path), size)


def cut_chunks(chunks: DataFrame, size: int = 6) -> DataFrame:
    return chunks.withColumn("chunk", F.slice("chunk", 1, max(3, min(8, size))))


def load_syllables(spark: SparkSession, path: str) -> DataFrame:
    """A dictionary of (word, syllables) lines."""
    return spark.read.csv(path, schema="word string, syllables string")


def load_words(spark: SparkSession, path: str) -> DataFrame:
    """(rank, word) of a ranked list with a word a line; the file's order is its rank."""
    lines = spark.read.option("wholetext", "true").text(path)
    return lines.select(F.posexplode(F.split("value", r"\s+")).alias("rank", "word")).where(F.col("word") != "")


def files(spark: SparkSession, path: str, pattern: str = "*", most_bytes: int | None = None) -> DataFrame:
    """(path, length, depth, name) of the files under a folder, without their contents."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "length", "modificationTime")
    found = found.where(F.col("length") <= most_bytes) if most_bytes else found
    return found.select("path", "length", F.size(F.split("path", "/")).alias("depth"), F.element_at(F.split("path", "/"), -1).alias("name")).orderBy("path")


def stamped(name: str, ending: str = "", now: datetime | None = None) -> str:
    """A file name with the time in it."""
    return f"{name}_{(now or datetime.now(timezone.utc)).strftime('%Y-%m-%d_%H%M%S_%f')}{ending}"
