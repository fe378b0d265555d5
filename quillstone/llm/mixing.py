"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Sources in code point order (null last) have weights 5, 2, 1, repeating. Targets share the size of all documents by weight;
no target exceeds 3 times its source's size, and what is cut off is shared anew among the others by weight. With ratio
r = cap / weight, the sources with the smallest r are the capped ones, so a prefix sum over sources in order of r gives
the final level at once, with no rounds.

Every document of a source expects target / source size copies (at most 3). Their prefix sum runs over the source's
documents in order of a size class (an eighth of an octave) and then of a hash, so that neighbours are about as long and
the words taken are near the target; one offset per source is added and a copy is emitted for each integer crossed.

The prefix sum is distributed: documents are counted by cell (source, size class, part of the hash); prefix sums over the
cells' counts (at most CLASSES * PARTS a source) give each cell its start, and ranks are taken inside cells. So a source
with a third of all rows, or thousands of copies of one text, is dealt over many tasks, and rows are shuffled once, by cell.
Targets are found by windows over one row a source: sources are meant to be named collections, not single hosts.

Defined results: a null or blank text has size 0 and is taken like its neighbours; a source of total size 0 has target 0
and nothing is taken; a null source is a source of its own; rows with the same id are ranked one after the other, by their texts' hashes; a
null id is hashed as empty text; an empty table gives an empty result; other columns are ignored by `plan` and kept by `mixed`
unless they bear the name of an added column, which replaces them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

CAP = 3
SEED = "mix-1"
#: Hex digits of the hash that divide a size class: 16**2 parts.
DIGITS = 2
#: Orders sizes by their bit length and the three bits after the first; the same text in Spark and in DuckDB.
CLASS = "lpad(cast(length(bin(size)) as {text}), 2, '0') || rpad(substr(bin(size), 2, 3), 3, '0')"
SPACES = r"[^\x20\x09-\x0D]+"


def _unit(digest):
    """The first 13 hex digits of a digest as a number in [0, 1)."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") / float(1 << 52)


def _sized(documents: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(SPACES)), F.lit(0)).cast("bigint")
    return (
        documents.withColumn("size", size)
        .withColumn("__source", F.col(source_col))
        .withColumn("__key", F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")))  # never null, so that joins and windows share a partitioning
        .withColumn("__text_hash", F.xxhash64(text_col))
        .withColumn("__hash", F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))))
        .withColumn("__class", F.expr(CLASS.format(text="string")))
        .withColumn("__part", F.substring("__hash", 1, DIGITS))
    )


def targets(sizes: DataFrame) -> DataFrame:
    """sizes: (__key, __source, source_size). Adds the target. One row a source, so windows over all of them are small."""
    order = Window.orderBy(F.col("__source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order), F.lit(3))
    weighed = sizes.withColumn("weight", F.when(turn == 1, 5).when(turn == 2, 2).otherwise(1).cast("bigint"))
    # The order by r = size / weight, with the source's own order for ties.
    by_ratio = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("__source").asc_nulls_last())
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    leveled = (
        weighed.withColumn("__total", F.sum("source_size").over(every))
        .withColumn("__capped", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * CAP)
        .withColumn("__rest", F.sum("weight").over(onward))
        # the level if all sources before this one are capped and this one is not
        .withColumn("__level", (F.col("__total") - F.col("__capped")) / F.col("__rest"))
        .withColumn("__at", F.row_number().over(by_ratio))
        .withColumn("__fits", F.col("__level") * F.col("weight") <= F.col("source_size") * CAP)
    )
    level = F.min(F.when(F.col("__fits"), F.struct("__at", F.col("__level").alias("level")))).over(every)["level"]
    capped = (F.col("source_size") * CAP).cast("double")
    return leveled.withColumn("__final", level).select("__key", "__source", "source_size", F.when(F.col("__final").isNull(), capped).otherwise(F.least(capped, F.col("__final") * F.col("weight"))).alias("target"))


def _planned(documents: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    docs = _sized(documents, id_col, text_col, source_col)
    # Written out: both prefix sums and targets follow from it, and texts are counted once for them.
    cells = C.persisted(docs.groupBy("__key", "__source", "__class", "__part").agg(F.count("*").alias("__n"), F.sum("size").alias("__size")), "mix-cells")
    within = Window.partitionBy("__key").orderBy("__class", "__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("__before", F.coalesce(F.sum("__n").over(within), F.lit(0)))
    sources = targets(cells.groupBy("__key", "__source").agg(F.sum("__size").alias("source_size")))
    rates = sources.withColumn("__rate", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(CAP)))).otherwise(0.0)).withColumn(
        "__offset", _unit(F.md5(F.concat(F.lit(SEED + ":offset:"), F.col("__key"))))
    )
    starts = starts.join(rates.drop("__source"), "__key").select("__key", "__class", "__part", "__before", "source_size", "target", "__rate", "__offset")
    docs = docs.drop("__before", "source_size", "target", "__rate", "__offset")
    cell = Window.partitionBy("__key", "__class", "__part").orderBy("__hash", F.col(id_col), F.col("size"), "__text_hash")
    joined = docs.withColumn("__rank", F.row_number().over(cell)).join(starts, ["__key", "__class", "__part"])
    k = F.col("__before") + F.col("__rank")
    crossed = lambda n: F.floor(n.cast("double") * F.col("__rate") + F.col("__offset"))
    return joined.withColumn("copies", (crossed(k) - crossed(k - 1)).cast("bigint"))


def plan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document: its id, size, source_size, target, copies and taken (copies * size)."""
    own = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    return _planned(own, "doc_id", "text", "source").select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each document's columns once per copy, with `copy` counting from 1."""
    names = [c for c in documents.columns if c != "copy"]
    wide = _planned(documents.select(F.struct(*names).alias("__row"), F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.col(source_col).alias("__src")), "__id", "__text", "__src")
    return wide.filter("copies > 0").select("__row.*", F.explode(F.expr("sequence(1L, copies)")).alias("copy"))


def op5_mixing(spark, sf_dir):
    return plan(C.table(spark, sf_dir, "documents")).drop("copies")


def _unit_sql(digest: str) -> str:
    return f"CAST(CAST('0x' || substr({digest}, 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0"


ORACLE_SQL = {
    "op5_mixing": f"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
                  md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE row_number() OVER (ORDER BY source NULLS LAST) % 3 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 1 END AS weight FROM s),
l AS (SELECT *, (sum(source_size) OVER () - {CAP} * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT level FROM l WHERE level * weight <= {CAP} * source_size ORDER BY source_size / weight, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CAST(least({CAP} * source_size, coalesce((SELECT level FROM f) * weight, {CAP} * source_size)) AS DOUBLE) AS target,
             {_unit_sql(f"md5('{SEED}:offset:' || coalesce('=' || source, ''))")} AS u FROM l),
k AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, {CAP}.0) ELSE 0.0 END AS rate,
             row_number() OVER (PARTITION BY d.source ORDER BY {CLASS.format(text="varchar")}, h, doc_id) AS k
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(floor(k * rate + u) - floor((k - 1) * rate + u) AS BIGINT) * size AS taken FROM k"""
}
