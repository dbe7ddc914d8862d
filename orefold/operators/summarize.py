"""Batch summaries: histograms, reward statistics, calibration, recommendations, projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orefold.reference import wording
from orefold.reference.taxonomy import ADVICE


def code_by_field(findings: DataFrame) -> DataFrame:
    """(code, json_pointer, n): counts by code, by field and by both in one pass; null marks the other grouping.

    Rows with a null code or pointer count under the text (null)."""
    f = findings.select(F.coalesce("code", F.lit("(null)")).alias("code"), F.coalesce("json_pointer", F.lit("(null)")).alias("json_pointer"))
    c, p = F.col("code"), F.col("json_pointer")
    return f.groupingSets([[c], [p], [c, p]], c, p).agg(F.count(F.lit(1)).alias("n"))


#: Distinct values that one task sorts; more are narrowed down first.
SORTED = 100_000


def upper_median(values: DataFrame, value: str, *, margin: float = 1 / 2000) -> DataFrame:
    """One row: n, mean, min, max, p50 of the non-null values; p50 is the element at n/2 of the sorted values.

    While more than SORTED distinct values may hold the element, a quantile sketch of them brackets it with a
    margin of five times the sketch's error, and the values below the bracket are counted; only what is left is
    sorted, so the element is exact. The mean is summed as a decimal, so it does not depend on the order of the
    rows. No values give nulls and n 0."""
    spark, kind = values.sparkSession, values.schema[value].dataType
    rows = values.where(F.col(value).isNotNull()).select(F.col(value).alias("v"))
    s = rows.agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.sum(F.col("v").cast("decimal(26,12)")).cast("double").alias("s")).first()
    mean, found = (s["s"] / s["n"] if s["n"] else None), None
    if s["n"]:
        low, high, under, at = s["low"], s["high"], 0, s["n"] // 2
        while True:
            inside = rows.where(F.col("v").between(low, high))
            counted = inside.groupBy("v").agg(F.count(F.lit(1)).alias("c"))
            size = counted.agg(F.count("v").alias("m"), F.sum("c").alias("r")).first()
            if size["m"] <= SORTED:
                break
            p = (at - under) / size["r"]
            a, z = inside.agg(F.percentile_approx("v", [max(0.0, p - margin), min(1.0, p + margin)], 10_000)).first()[0]
            below, within = inside.agg(F.count_if(F.col("v") < a), F.count_if(F.col("v").between(a, z))).first()
            if (a, z) == (low, high) or not under + below <= at < under + below + within:
                break
            low, high, under = a, z, under + below
        run = counted.withColumn("below", F.lit(under) + F.coalesce(F.sum("c").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        found = run.where((F.col("below") <= at) & (F.lit(at) < F.col("below") + F.col("c"))).first()["v"]
    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("mean", T.DoubleType()), *[T.StructField(c, kind) for c in ("min", "max", "p50")]])
    return spark.createDataFrame([(s["n"], mean, s["low"], s["high"], found)], schema)


def calibration_outcomes(confidences: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """confidences (key, json_pointer, confidence, unavailable) with outcome.

    A finding counts against a field if its pointer is the field's or below it. Findings are spread over
    the prefixes of their pointers and reduced to one row per field before they meet the confidences."""
    steps = F.split(F.col("json_pointer"), "/")
    prefixes = F.transform(F.sequence(F.lit(2), F.greatest(F.size(steps), F.lit(2))), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
    f = findings.where(F.col("level").isin("error", "warning")).select(key, F.explode(F.when(F.size(steps) > 1, prefixes)).alias("json_pointer"), (F.col("level") == "error").alias("e"))
    f = f.groupBy(key, "json_pointer").agg(F.max("e").alias("e"))
    out = confidences.join(f, [key, "json_pointer"], "left")
    return out.withColumn("outcome", F.when(F.col("unavailable") & F.col("e").isNull(), "unverifiable").when(F.col("e"), "incorrect").otherwise("correct")).drop("e")


def calibration(pairs: DataFrame) -> DataFrame:
    """One row: n_pairs, brier, mean confidence when correct and when incorrect; null where there is none."""
    c, o = F.col("confidence"), F.col("outcome")
    hit = F.when(o == "correct", 1.0).when(o == "incorrect", 0.0)
    return pairs.agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.avg((c - hit) * (c - hit)).alias("brier"),
        F.avg(F.when(o == "correct", c)).alias("mean_confidence_when_correct"),
        F.avg(F.when(o == "incorrect", c)).alias("mean_confidence_when_incorrect"),
    )


def advice(spark: SparkSession) -> DataFrame:
    """The recommendation rules: what to change, for which codes."""
    return spark.createDataFrame([(a, t, list(c)) for a, t, c in ADVICE], "advice_id string, target string, codes array<string>")


def statements(spark: SparkSession) -> DataFrame:
    """(advice_id, statement): what each rule recommends."""
    return spark.createDataFrame([(a, text) for (a, _, _), text in zip(ADVICE, wording.ADVICE)], "advice_id string, statement string")


def recommendations(findings: DataFrame, key: str, rules: DataFrame, total: Column | int, *, pointer: str | None = None, example: str | None = None, most: int = 20, examples: int = 5) -> DataFrame:
    """(rank, advice_id, target, n_records, fraction): per rule the distinct records with any of its codes.

    Only rules that apply, most records first, ties by target and id. A record is counted once per rule
    before the rule's rows come together. With pointer and example, the columns that hold them, also codes,
    json_pointers and example_ids: which of the codes were met, the first `most` pointers and the first
    `examples` ids, in order; each is reduced to its distinct values, of which the first are taken per rule."""
    r = F.broadcast(rules.select("advice_id", "target", F.explode("codes").alias("code")))
    hit = findings.where(F.col(key).isNotNull()).join(r, "code")
    n = hit.groupBy("advice_id", "target", key).agg(F.lit(1).alias("one")).groupBy("advice_id", "target").agg(F.count(F.lit(1)).alias("n_records"))
    n = n.withColumn("fraction", F.col("n_records") / (F.lit(total) if isinstance(total, int) else total))
    for column, name, k in ((None if pointer is None else "code", "codes", None), (pointer, "json_pointers", most), (example, "example_ids", examples)):
        if column is not None:
            n = n.join(first_values(hit, "advice_id", column, k).withColumnRenamed("values", name), "advice_id", "left")
    return n.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_records"), "target", "advice_id")))


def observed_fields(findings: DataFrame, rules: DataFrame, k: int = 20) -> DataFrame:
    """(advice_id, pointers): the first k pointers, in order, at which a rule's codes stand."""
    r = F.broadcast(rules.select("advice_id", F.explode("codes").alias("code")))
    return first_values(findings.join(r, "code"), "advice_id", "json_pointer", k).withColumnRenamed("values", "pointers")


def first_values(rows: DataFrame, group: str, column: str, k: int | None) -> DataFrame:
    """(group, values): the first k distinct values of a column per group, in order; all of them without k.

    A value stands once per group before the groups come together; ranks are taken over 64 parts of a group
    first, so that no task sorts more of a large group than its part and k values of each."""
    d = rows.where(F.col(column).isNotNull()).select(group, column).distinct()
    if k is not None:
        part = F.pmod(F.xxhash64(column), F.lit(64))
        for keys in ([F.col(group), part], [F.col(group)]):
            d = d.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(column))).where(F.col("_i") <= k).drop("_i")
    return d.groupBy(group).agg(F.array_sort(F.collect_list(column)).alias("values"))


def scalar_rewards(verdicts: DataFrame) -> DataFrame:
    """The projection for reward training: records with a terminal status."""
    return verdicts.where(F.col("status").isin("accepted", "rejected"))


def top_k(counted: DataFrame, n: str, ties: list[str], k: int) -> DataFrame:
    """The k largest by n, ties in order; a sort that keeps k rows per task."""
    return counted.orderBy(F.desc(n), *ties).limit(k)


def component_means(verdicts: DataFrame, columns: list[str]) -> DataFrame:
    """(component, n, mean): each component over the records that have it, summed as decimals; others have no row."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).alias("v")) for c in columns]))
    v = verdicts.select(pairs.alias("p")).select("p.*").where(F.col("v").isNotNull())
    g = v.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("v").cast("decimal(26,12)")).alias("s"))
    return g.select("component", "n", (F.col("s").cast("double") / F.col("n")).alias("mean"))


def assumptions(verdicts: DataFrame, key: str, config: dict) -> DataFrame:
    """(key, assumptions): what a record's verdict takes for granted, by the checks that ran, as (id, statement,
    value); value is the threshold or setting it rests on."""
    v, f = config["validity"], config["feasibility"]
    lines = (
        (F.lit(True), "formula_as_written", "The formula is read as written; a point separates adducts.", None),
        (F.col("composition_key").isNotNull(), "common_states", "Only common oxidation states are tried.", v["max_combinations"]),
        (F.col("frame") == "closed_0k", "closed_system", "Energies are those of a closed system at 0 K, from enthalpies at 298 K.", f["threshold"]),
        (F.col("frame") == "grand_potential", "open_system", "The atmosphere fixes the oxygen reservoir; suboxides and kinetics are left out.", f["temperature"]),
        (F.col("value_structure_valid").isNotNull(), "nearest_cells", "Distances reach into the neighbouring cells only.", v["min_distance"]),
        (F.col("value_structure_valid").isNotNull(), "metric_tolerance", "Edges are equal within this tolerance.", v["metric_length"]),
        (F.col("value_claims_supported").isNotNull(), "wide_ranges", "Plausible ranges are wide; a value inside one is not confirmed.", None),
        (F.col("unavailable"), "silent_provider", "A provider could not answer.", None),
    )
    made = [F.when(when, F.struct(F.lit(i).alias("id"), F.lit(t).alias("statement"), F.lit(None if x is None else float(x)).cast("double").alias("value"))) for when, i, t, x in lines]
    return verdicts.select(key, F.array_compact(F.array(*made)).alias("assumptions"))
