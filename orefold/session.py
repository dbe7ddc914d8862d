"""Session settings and the shared folder that lineage is cut into."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows of one Arrow batch handed to Python. Texts may be long, so a batch stays far below Spark's 10,000.
ARROW_ROWS = 2000


def build_session(master: str = "local[*]", app: str = "orefold", **conf: str) -> SparkSession:
    """A session with the settings the operators are written for: UTC, AQE, few local shuffle partitions."""
    b = SparkSession.builder.master(master).appName(app)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(ARROW_ROWS),
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for k, v in {**base, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Bounds the Arrow batches of a foreign session; everything else of it is left alone."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset a local master gets a temporary
    folder, as in tests; on a cluster that is an error, since executors would each write to their own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    sc = spark.sparkContext
    if found is None:
        if sc._jsc.sc().getCheckpointDir().isDefined():
            return sc._jsc.sc().getCheckpointDir().get()
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="orefold-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Writes df into the shared folder and returns it without its lineage; a lost executor loses nothing of it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder of its own below the shared one, removed at the end: for tables several steps read again."""
    folder = f"{shared_dir(spark).rstrip('/')}/orefold-{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        remove(spark, folder)


def exists(spark: SparkSession, folder: str) -> bool:
    """Whether a path is there, on whatever file system it lies; other errors are raised."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder on whatever file system it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, folder: str) -> DataFrame:
    """df written to a folder as columns and read from there, so that it is computed once."""
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
