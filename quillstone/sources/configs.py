"""JSON configuration as rows: suites of questions with their expected answers, cue patterns, tool definitions.

Files may have // comments. A suite's cases are rows of one table, however many files there are; fields that a case lacks
are null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT, _LONG, _REAL, _TRUE = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()
#: A case's fields.
CASE = T.StructType(
    [T.StructField(n, _TEXT) for n in ("Code", "Question", "Category", "Difficulty", "ExpectedIntent", "ExpectedSql", "ExpectedOperation", "ExpectedPrimaryEntity")]
    + [T.StructField(n, _LONG) for n in ("MaxLatencyMs", "ExpectedRowCount", "ExpectedMinRows", "ExpectedMaxRows", "ExpectedLimit")]
    + [T.StructField("ExpectedScalar", _REAL), T.StructField("ExpectedInvalid", _TRUE), T.StructField("GoldVerified", _TRUE)]
    + [T.StructField(n, T.ArrayType(_TEXT)) for n in ("ExpectedColumns", "ExpectedFields", "ExpectedGroupBy")]
    + [T.StructField("ExpectedAggregations", T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (("function", _TEXT), ("column", _TEXT), ("distinct", _TRUE), ("alias", _TEXT))])))]
    + [T.StructField("ExpectedFilters", T.ArrayType(T.StructType([T.StructField(n, _TEXT) for n in ("Column", "Op", "Value")])))]
)
_SUITE = T.StructType([T.StructField("name", _TEXT), T.StructField("version", _TEXT), T.StructField("Scenarios", T.ArrayType(CASE))])
_PATTERNS = T.StructType([T.StructField("default", _TEXT), T.StructField("patterns", T.ArrayType(T.StructType([T.StructField("shape", _TEXT), T.StructField("keywords", T.ArrayType(_TEXT)), T.StructField("regex", T.ArrayType(_TEXT))])))])
_TOOLS = T.StructType([T.StructField("tools", T.ArrayType(T.StructType([T.StructField(n, _TEXT) for n in ("toolKey", "title", "description", "toolType", "endpointUrl", "keywordHints", "queryExtractionHint", "responseFormatHint", "testPrompt")] + [T.StructField("isEnabled", _TRUE), T.StructField("sortOrder", _LONG)])))])


def _documents(spark: SparkSession, schema: T.StructType, *paths: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").option("allowComments", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(list(paths))


def suites(spark: SparkSession, *paths: str) -> DataFrame:
    """One row a case: its suite's file, name and version, its place in the suite, and its fields."""
    found = _documents(spark, _SUITE, *paths).select(F.input_file_name().alias("file"), "name", "version", F.posexplode("Scenarios").alias("place", "case"))
    return found.select("file", "name", "version", "place", "case.*")


def cues(spark: SparkSession, *paths: str) -> DataFrame:
    """(place, name, word, is_pattern): words and patterns in the order in which they are tried."""
    each = _documents(spark, _PATTERNS, *paths).select(F.posexplode("patterns").alias("place", "p"))
    words = lambda c, is_pattern: each.select("place", F.col("p.shape").alias("name"), F.explode(f"p.{c}").alias("word"), F.lit(is_pattern).alias("is_pattern"))
    return words("keywords", False).unionAll(words("regex", True))


def tools(spark: SparkSession, *paths: str) -> DataFrame:
    """Enabled tools in their order, one row each, with their hints as an array."""
    each = _documents(spark, _TOOLS, *paths).select(F.explode("tools").alias("t")).select("t.*").filter(F.coalesce("isEnabled", F.lit(True)))
    return each.withColumn("keywordHints", F.transform(F.split("keywordHints", ","), lambda x: F.trim(x))).orderBy("sortOrder", "toolKey")
