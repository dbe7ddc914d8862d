"""Admission: the first conforming record of an id wins; others are set apart; every rule is accounted for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orefold.plans.skew import dictionary_join
from orefold.reference.taxonomy import RULES


def admit(df: DataFrame, id_col: str, order: list[str], conforming: Column, *, total: int | None = None) -> DataFrame:
    """df with decision: duplicate if an earlier conforming row has the id, else nonconforming or admitted.

    The earliest conforming position of each id is found by a partial aggregate and joined back with hot ids
    apart, so an id that repeats very often is neither sorted nor joined in one task. Rows with a null id
    are never duplicates; a null condition does not conform."""
    at = F.struct(*order)
    ok = F.coalesce(conforming, F.lit(False))
    firsts = df.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(F.when(ok, at)).alias("_first"), F.count(F.lit(1)).alias("n"))
    out = dictionary_join(df, firsts, [id_col], spread=F.xxhash64(*order), total=df.count() if total is None else total, keep=F.col("_first").isNotNull())
    late = F.col("_first").isNotNull() & (F.col("_first") < at)
    return out.select(*df.columns, F.when(late, "duplicate").when(~ok, "nonconforming").otherwise("admitted").alias("decision"))


def quarantine_codes(issues: DataFrame, key: str) -> DataFrame:
    """(key, violation_code, n_issues): the code of a record's first issue by pointer, code."""
    return issues.groupBy(key).agg(F.min(F.struct("json_pointer", "code")).alias("m"), F.count(F.lit(1)).alias("n_issues")).select(key, F.col("m.code").alias("violation_code"), "n_issues")


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "rule_id string, action string, code string")


def ledger(hits: DataFrame, registered: DataFrame, *, examples: int = 5) -> DataFrame:
    """(rule_id, action, code, n_hits, examples): every registered rule, those without a hit with 0.

    hits has rule_id, example, seq; examples are the first distinct ones seen, then sorted. Distinct
    examples are found per (rule, example) before any rule's rows come together, and only the lowest
    positions are kept, so a rule hit very often stays small."""
    n = hits.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_hits"))
    seen = hits.where(F.col("example").isNotNull()).groupBy("rule_id", "example").agg(F.min("seq").alias("seq"))
    salted = seen.withColumn("_s", F.pmod(F.xxhash64("example"), F.lit(64)))
    w = Window.partitionBy("rule_id", "_s").orderBy("seq", "example")
    few = salted.withColumn("r", F.row_number().over(w)).where(F.col("r") <= examples)
    w = Window.partitionBy("rule_id").orderBy("seq", "example")
    few = few.withColumn("r", F.row_number().over(w)).where(F.col("r") <= examples)
    ex = few.groupBy("rule_id").agg(F.array_sort(F.collect_list("example")).alias("examples"))
    out = F.broadcast(registered).join(n, "rule_id", "left").join(ex, "rule_id", "left")
    return out.select("rule_id", "action", "code", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def counts(df: DataFrame) -> DataFrame:
    """One row: records in, admitted, quarantined, duplicates; in = admitted + quarantined."""
    d = F.col("decision")
    return df.agg(F.count(F.lit(1)).alias("records_in"), F.count_if(d == "admitted").alias("admitted"), F.count_if(d != "admitted").alias("quarantined"), F.count_if(d == "duplicate").alias("duplicates"))
