"""Exact percentiles without gathering a group's values in one task.

Values are put into BUCKETS ranges cut at approximate quantiles (a sketch of bounded size); counts by range tell which
range holds a wanted rank. A range of more than LIMIT rows is cut again in the same way, until it is smaller or cannot be
divided; then its distinct values are counted and summed up. Building a plan runs the jobs that find the ranges; what they
return is one row a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64
#: Rows of a range whose values one task may sort; groups whose ranges are broadcast.
LIMIT, BROADCAST_GROUPS = 1 << 20, 10_000
#: Equal values whose keys are simply sorted.
FEW = 10_000


def _cuts(rows: DataFrame) -> DataFrame:
    """rows: (k, v). Per group: k, cuts, n."""
    return rows.groupBy("k").agg(F.percentile_approx("v", [i / BUCKETS for i in range(1, BUCKETS)], 1000).alias("cuts"), F.count("*").alias("n")).persist()


def _at_ranks(rows: DataFrame, cuts: DataFrame, wanted: DataFrame, limit: int, before: int | None = None) -> DataFrame:
    """rows: (k, v); wanted: (k, name, rank from 0). (k, name, v)."""
    # One row a group, and one for each rank: broadcast if the counted groups are few.
    few = F.broadcast if cuts.count() <= BROADCAST_GROUPS else lambda df: df
    placed = rows.join(few(cuts), "k").select("k", "v", F.size(F.filter("cuts", lambda c: c < F.col("v"))).alias("b"))
    counted = placed.groupBy("k", "b").agg(F.count("*").alias("c"))
    earlier = F.coalesce(F.sum("c").over(Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = (F.col("rank") >= F.col("earlier")) & (F.col("rank") < F.col("earlier") + F.col("c"))
    target = counted.withColumn("earlier", earlier).join(wanted, "k").filter(inside).select("k", "b", "name", (F.col("rank") - F.col("earlier")).alias("rank"), "c").persist()
    most = target.agg(F.max("c")).first()[0] or 0
    if most > limit and (before is None or most < before):
        own = F.struct("k", "b").alias("k")
        part = placed.join(few(target.select("k", "b").distinct()), ["k", "b"]).select(own, "v")
        found = _at_ranks(part, _cuts(part), target.select(own, "name", "rank"), limit, most)
        return found.select("k.k", "name", "v")
    values = placed.join(few(target.select("k", "b", "name", "rank")), ["k", "b"]).groupBy("k", "name", "rank", "v").agg(F.count("*").alias("c"))
    low = F.coalesce(F.sum("c").over(Window.partitionBy("k", "name").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return values.withColumn("low", low).filter("rank >= low and rank < low + c").select("k", "name", "v")


def values_at(df: DataFrame, groups: list[str], value: str, ranks: dict[str, Column], limit: int = LIMIT) -> DataFrame:
    """One row a group with a column for each rank (from 0; an expression of `n`, the group's number of values), and n."""
    key = F.struct(*(F.col(g).alias(f"k{i}") for i, g in enumerate(groups))) if groups else F.struct(F.lit(0).alias("k0"))
    rows = df.filter(F.col(value).isNotNull()).select(key.alias("k"), F.col(value).alias("v"))
    cuts = _cuts(rows)
    wanted = cuts.select("k", F.explode(F.array(*(F.struct(F.lit(name).alias("name"), r.cast("bigint").alias("rank")) for name, r in ranks.items()))).alias("w")).select("k", "w.*")
    found = _at_ranks(rows, cuts, wanted, limit).groupBy("k").agg(*(F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in ranks))
    out = found.join(cuts.select("k", "n"), "k")
    return out.select(*(F.col(f"k.k{i}").alias(g) for i, g in enumerate(groups)), *ranks, F.col("n").alias("__n"))


def nearest_ranks(df: DataFrame, groups: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """The value at int(n * share) of the sorted values."""
    return values_at(df, groups, value, {name: F.least(F.floor(F.col("n") * s), F.col("n") - 1) for name, s in shares.items()}).drop("__n")


def continuous_percentiles(df: DataFrame, groups: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Interpolated between the two nearest values, as PERCENTILE_CONT."""
    ranks = {}
    for name, s in shares.items():
        at = (F.col("n") - 1) * F.lit(s)
        ranks |= {f"{name}__low": F.floor(at), f"{name}__high": F.ceil(at)}
    found = values_at(df, groups, value, ranks)
    part = lambda s: (F.col("__n") - 1) * F.lit(s) - F.floor((F.col("__n") - 1) * F.lit(s))
    return found.select(*groups, *((F.col(f"{n}__low") + (F.col(f"{n}__high") - F.col(f"{n}__low")) * part(s)).alias(n) for n, s in shares.items()))


def top_percent(df: DataFrame, percent: float, value: str, key: str) -> DataFrame:
    """The ceil(n * percent / 100) rows of the largest values, by key among equals; both numbers. The last of them is found by
    rank, so no task sorts or holds a share of the rows; then a filter on two literals is left."""
    edge = values_at(df, [], value, {"edge": F.col("n") - F.ceil(F.col("n") * percent / 100)}).first()
    if edge is None:
        return df.limit(0)
    wanted = -int(-edge["__n"] * percent // 100)
    beyond, n_ties = df.agg(F.count_if(F.col(value) > F.lit(edge.edge)), F.count_if(F.col(value) == F.lit(edge.edge))).first()
    ties = df.filter(F.col(value) == F.lit(edge.edge))
    if n_ties <= FEW:
        last = ties.select(key).orderBy(key).offset(wanted - beyond - 1).first()[0]
    else:
        last = values_at(ties, [], key, {"last": F.lit(wanted - beyond - 1)}).first()["last"]
    return df.filter((F.col(value) > F.lit(edge.edge)) | ((F.col(value) == F.lit(edge.edge)) & (F.col(key) <= F.lit(last))))
