"""Comparison of results: as multisets of rows, whatever the names and order of columns, and by fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal(col: Column) -> Column:
    """Null token; numbers to four digits, half to even; ISO dates; other text trimmed and lower-cased."""
    text = F.lower(F.trim(col.cast("string")))
    number = text.try_cast("double")
    date = text.try_cast("timestamp_ntz")
    return F.when(col.isNull(), "<null>").when(number.isNotNull(), F.bround(number, 4).cast("string")).when(date.isNotNull(), F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(text)


def bags(df: DataFrame) -> DataFrame:
    """Each row as a sorted list of normal values, with its count."""
    return df.select(F.to_json(F.array_sort(F.array(*(normal(F.col(f"`{c}`")) for c in df.columns)))).alias("row")).groupBy("row").agg(F.count("*").alias("n"))


def multiset_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether both have the same rows as often."""
    both = bags(a).withColumnRenamed("n", "na").join(bags(b).withColumnRenamed("n", "nb"), "row", "full")
    return both.agg((F.count_if(~F.col("na").eqNullSafe(F.col("nb"))) == 0).alias("equal"))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: a sum of row hashes, the same in any order of rows, and their number."""
    return df.agg(F.coalesce(F.sum(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("fingerprint"), F.count("*").alias("n_rows"))
