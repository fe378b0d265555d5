"""The star schema: its tables, keys and row sources."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: Tables and their primary keys; Parquet carries no constraints.
PRIMARY_KEYS = {
    "region": ("r_regionkey",),
    "nation": ("n_nationkey",),
    "customer": ("c_custkey",),
    "supplier": ("s_suppkey",),
    "part": ("p_partkey",),
    "orders": ("o_orderkey",),
    "lineitem": ("l_orderkey", "l_linenumber"),
    "events": ("event_id",),
    "documents": ("doc_id",),
    "labels": ("doc_id",),
    "embeddings": ("vec_id",),
    "pages": ("page_id",),
    "conversations": ("conv_id", "turn"),
    "benchmark": ("item_id",),
}


@dataclass(frozen=True)
class ForeignKey:
    table: str
    column: str
    target: str
    target_column: str


FOREIGN_KEYS = (
    ForeignKey("nation", "n_regionkey", "region", "r_regionkey"),
    ForeignKey("customer", "c_nationkey", "nation", "n_nationkey"),
    ForeignKey("supplier", "s_nationkey", "nation", "n_nationkey"),
    ForeignKey("orders", "o_custkey", "customer", "c_custkey"),
    ForeignKey("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ForeignKey("lineitem", "l_partkey", "part", "p_partkey"),
    ForeignKey("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ForeignKey("labels", "doc_id", "documents", "doc_id"),
)


class Tables:
    """Tables of one folder as attributes: Tables(spark, dir).orders."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in PRIMARY_KEYS:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def names(self) -> list[str]:
        """What the folder holds as Parquet, in any store that Spark reads."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        found = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).listStatus(path)
        return sorted(n.removesuffix(".parquet") for n in (f.getPath().getName() for f in found) if n.endswith(".parquet"))

    def register(self, *names: str) -> None:
        for name in names or PRIMARY_KEYS:
            getattr(self, name).createOrReplaceTempView(name)
