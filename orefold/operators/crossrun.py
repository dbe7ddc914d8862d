"""Across runs: pooled rates, trend, life cycle of findings, comparability, incremental recompute."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orefold.session import exists


def pooled(findings: DataFrame, run: str, n_records: int) -> DataFrame:
    """(code, json_pointer, total_findings, runs_present_in, per_100): over all runs, per 100 records."""
    per = findings.groupBy("code", "json_pointer", run).agg(F.count(F.lit(1)).alias("n"))
    p = per.groupBy("code", "json_pointer").agg(F.sum("n").alias("total_findings"), F.count(F.lit(1)).alias("runs_present_in"))
    return p.withColumn("per_100", F.round(F.lit(100.0) * F.col("total_findings") / F.lit(n_records), 3))


def trend(findings: DataFrame, runs: DataFrame, run: str) -> DataFrame:
    """(code, first_per_100, last_per_100, change): rates of the first and last run by (logical_time, run).

    runs has run, logical_time, n_records; a run without records has no rate. One row per code; only the
    two ends of the series are looked up, both one row."""
    ends = runs.agg(F.min(F.struct("logical_time", run, "n_records")).alias("a"), F.max(F.struct("logical_time", run, "n_records")).alias("z"))
    per = findings.join(F.broadcast(ends)).groupBy("code").agg(
        F.count_if(F.col(run) == F.col(f"a.{run}")).alias("n_a"), F.count_if(F.col(run) == F.col(f"z.{run}")).alias("n_z"), F.any_value("a.n_records").alias("r_a"), F.any_value("z.n_records").alias("r_z")
    )
    rate = lambda n, r: F.round(F.when(F.col(r) > 0, F.lit(100.0) * F.col(n) / F.col(r)), 3)
    out = per.select("code", rate("n_a", "r_a").alias("first_per_100"), rate("n_z", "r_z").alias("last_per_100"))
    return out.withColumn("change", F.round(F.col("last_per_100") - F.col("first_per_100"), 3))


def rates(findings: DataFrame, runs: DataFrame, run: str) -> DataFrame:
    """(code, run, per_100): the rate of every code that occurs in every run with records, 0 where it is absent.

    Codes and runs are both few; their product is joined with the counts, not the findings."""
    per = findings.where(F.col("code").isNotNull()).groupBy("code", run).agg(F.count(F.lit(1)).alias("n"))
    every = per.select("code").distinct().groupBy().agg(F.collect_list("code").alias("codes"))
    grid = runs.select(run, "n_records").join(F.broadcast(every)).select(run, "n_records", F.explode("codes").alias("code"))
    out = grid.join(per, ["code", run], "left")
    return out.select("code", run, F.round(F.when(F.col("n_records") > 0, F.lit(100.0) * F.coalesce("n", F.lit(0)) / F.col("n_records")), 3).alias("per_100"))


def lifecycle(findings: DataFrame, run_order: str) -> DataFrame:
    """(fingerprint, state): new if only in the last run, resolved if only before it, else persistent.

    One pass: the first and last run of each fingerprint are aggregated before the shuffle."""
    last = findings.agg(F.max(run_order).alias("_last"))
    f = findings.where(F.col("fingerprint").isNotNull()).groupBy("fingerprint").agg(F.min(run_order).alias("a"), F.max(run_order).alias("z"))
    f = f.join(F.broadcast(last))
    state = F.when(F.col("z") < F.col("_last"), "resolved").when(F.col("a") == F.col("_last"), "new").otherwise("persistent")
    return f.select("fingerprint", state.alias("state"))


def comparability(runs: DataFrame, columns: list[str]) -> DataFrame:
    """(aspect, n_values, comparable): how many different non-null values each aspect of the runs has."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("aspect"), F.col(c).cast("string").alias("v")) for c in columns]))
    return runs.select(pairs.alias("p")).groupBy("p.aspect").agg(F.countDistinct("p.v").alias("n_values")).withColumn("comparable", F.col("n_values") <= 1)


def misses(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Rows whose content key is not in the cache; null keys are always missing."""
    return wanted.join(cache.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def hits(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    return wanted.join(cache, key)


def recompute(wanted: DataFrame, folder: str, key: str, compute) -> DataFrame:
    """Results of wanted: those stored under their content key, and the others computed and appended."""
    spark = wanted.sparkSession
    todo = misses(wanted, spark.read.parquet(folder), key) if exists(spark, folder) else wanted
    compute(todo).write.mode("append").parquet(folder)
    return spark.read.parquet(folder).join(wanted.select(key).distinct(), key, "left_semi")


def differences(recorded: DataFrame, current: DataFrame, path: str = "path", value: str = "value") -> DataFrame:
    """(path, change, recorded, current): paths added, removed or changed between two flattened documents."""
    a = recorded.select(path, F.col(value).alias("recorded"), F.lit(True).alias("_a"))
    b = current.select(path, F.col(value).alias("current"), F.lit(True).alias("_b"))
    j = a.join(b, path, "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("recorded").eqNullSafe(F.col("current")), "changed")
    return j.select(path, change.alias("change"), "recorded", "current").where(F.col("change").isNotNull())


def lineage(recorded: DataFrame, current: DataFrame, part: str, digest: str) -> DataFrame:
    """(part, state): MATCH, DIVERGED, or UNKNOWN where either side has no digest."""
    j = recorded.select(part, F.col(digest).alias("r")).join(current.select(part, F.col(digest).alias("c")), part, "full_outer")
    return j.select(part, F.when(F.col("r").isNull() | F.col("c").isNull(), "UNKNOWN").when(F.col("r") == F.col("c"), "MATCH").otherwise("DIVERGED").alias("state"))


def runs_of(findings: DataFrame, run: str, record: str, time: str) -> DataFrame:
    """(run, logical_time, n_records, n_findings): one row per run."""
    return findings.where(F.col(run).isNotNull()).groupBy(run).agg(F.min(time).alias("logical_time"), F.countDistinct(record).alias("n_records"), F.count(F.lit(1)).alias("n_findings"))


def ranked(df: DataFrame, by: str, order: list, k: int) -> DataFrame:
    """The first k rows of each group in the given order, with rank."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
