"""A folder of batches verified as files arrive: what is new is processed once, then the query ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefold.plans import verification
from orefold.reference.config import resolve
from orefold.session import exists
from orefold.sources import envelopes as env

#: Binary file rows as a stream source needs them declared.
FILES = "path string, modificationTime timestamp, length long, content binary"


def verify_stream(spark: SparkSession, source: str, sink: str, *, config: dict | None = None) -> None:
    """Verifies every *.json file of source not seen before and adds verdicts, findings and refusals to sink.

    The stream's checkpoint under sink remembers the files. Each micro-batch writes partitions of its own, so
    one that fails and is run again overwrites what it had written. An id counts once over all micro-batches:
    a later record of an id that an earlier micro-batch admitted is refused as a duplicate."""
    config = resolve() if config is None else config
    lines = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.json").load(source)
    named = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length"), F.col("value").cast("binary").alias("content"))

    def each(batch: DataFrame, number: int) -> None:
        parsed = env.parse_files(batch, config["input"])
        before = spark.read.parquet(f"{sink}/verdicts").where(F.col("micro_batch") < number).select("proposal_id") if exists(spark, f"{sink}/verdicts") else None
        checked, _, rows = verification.check_batches(parsed, config, seen=before)
        refused = rows.where(F.col("decision") != "admitted").select("path", "pos", "key", "proposal_id", "decision")
        tables = {"refused": refused} if checked is None else {"refused": refused, "verdicts": checked.verdicts, "findings": checked.findings}
        for name, df in tables.items():
            own = df.withColumn("micro_batch", F.lit(number).cast("bigint"))
            own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("micro_batch").parquet(f"{sink}/{name}")

    query = named.writeStream.foreachBatch(each).option("checkpointLocation", f"{sink}/_stream").trigger(availableNow=True).start()
    query.awaitTermination()
