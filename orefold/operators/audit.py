"""Self-verification: each invariant as the rows that break it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose key has no parent; null keys have none."""
    p = parent.select(F.col(parent_key).alias(child_key)).where(F.col(child_key).isNotNull()).distinct()
    return child.join(p, child_key, "left_anti")


def unordered(df: DataFrame, position: str, keys: list[str], *, block: int = 100_000) -> DataFrame:
    """Rows whose key is smaller than that of the row before by position.

    Neighbours are compared inside blocks of positions; each block also sees the last row of the filled
    block before it, so no task sorts more than a block or one row per block. Positions are whole numbers."""
    k = F.struct(*keys)
    b = df.withColumn("_b", F.floor(F.col(position) / block))
    last = b.groupBy("_b").agg(F.max_by(k, F.col(position)).alias("_k"))
    heads = last.select("_b", F.lag("_k").over(Window.orderBy("_b")).alias("_k"))
    w = Window.partitionBy("_b").orderBy(position)
    rows = b.withColumn("_prev", F.lag(k).over(w)).join(heads, "_b", "left")
    before = F.coalesce(F.col("_prev"), F.col("_k"))
    return rows.where(before > k).select(*df.columns)


def missing(present: DataFrame, column: str, required: list[str]) -> DataFrame:
    """(value): required values that the column never has."""
    spark = present.sparkSession
    want = spark.createDataFrame([(r,) for r in required], f"{column} string")
    return want.join(present.select(column).distinct(), column, "left_anti")


def mismatched(df: DataFrame, stated: Column, derived: Column, tolerance: float = 1e-6) -> DataFrame:
    """Rows whose stated number differs from the derived one, or of which only one is there."""
    return df.where(~F.coalesce(F.abs(stated - derived) <= tolerance, stated.isNull() & derived.isNull()))


def with_url(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column): text columns that hold a web address or an absolute host path."""
    c = F.explode(F.array(*[F.when(F.col(x).rlike(r"https?://|(^|[\s\"'=(])(/home/|/root/|/Users/|[A-Za-z]:\\)"), F.lit(x)) for x in columns])).alias("column")
    return df.select(key, c).where(F.col("column").isNotNull())
