"""Files as rows and rows as files: text corpora, attachments, JSON payloads; trace append, retention, upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Attachments whose content is read as text.
TEXT_EXTENSIONS = ("txt", "md", "log", "json", "xml", "csv", "yaml", "yml", "ini", "conf", "sql", "html", "htm", "js", "ts", "cs")


def corpus(spark: SparkSession, *folders: str) -> DataFrame:
    """(path, text) of the .md and .txt files below the given folders."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,txt}").format("binaryFile").load(list(folders))
    return files.select("path", F.col("content").cast("string").alias("text"))


def attachments(spark: SparkSession, folder: str, most_bytes: int = 1 << 20) -> DataFrame:
    """(path, length, text) of all files; text is null for other kinds and for files over the limit."""
    files = spark.read.option("recursiveFileLookup", "true").format("binaryFile").load(folder)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.select("path", "length", F.when(kind.isin(*TEXT_EXTENSIONS) & (F.col("length") <= most_bytes), F.col("content").cast("string")).alias("text"))


def json_rows(payload: Column, most_rows: int = 20, most_properties: int = 20, longest: int = 250) -> Column:
    """An object or an array of objects as an array of maps: the first rows, of each the first properties; nested values as
    text cut at `longest` characters."""
    as_array = F.when(F.ltrim(payload).startswith("["), payload).otherwise(F.concat(F.lit("["), payload, F.lit("]")))
    rows = F.slice(F.from_json(as_array, "array<map<string,string>>"), 1, most_rows)
    cut = lambda e: F.struct(e["key"].alias("key"), F.substring(e["value"], 1, longest).alias("value"))
    return F.transform(rows, lambda m: F.map_from_entries(F.transform(F.slice(F.map_entries(m), 1, most_properties), cut)))


def append(rows: DataFrame, path: str, *partitions: str) -> None:
    rows.write.mode("append").partitionBy(*partitions).parquet(path)


def retained(rows: DataFrame, column: str, cutoff) -> DataFrame:
    return rows.filter(F.col(column) >= F.lit(cutoff))


def latest(log: DataFrame, key: str, order: str) -> DataFrame:
    """An append log read as a table of the newest row per key."""
    newest = Window.partitionBy(key).orderBy(F.desc(order))
    return log.withColumn("__r", F.row_number().over(newest)).filter("__r = 1").drop("__r")
