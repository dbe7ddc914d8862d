"""Reference corpora kept as JSON documents: a file that is missing or broken is data, not an empty corpus."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.errors.exceptions.captured import CapturedException as SparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefold.functions import formula as fm
from orefold.reference.corpora import PROVIDERS
from orefold.session import cut

ENTRY = "array<struct<formula:string,identifier:string,n_documents:int>>"


def load_folder(spark: SparkSession, folder: str, *, only: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """load() of folder/<provider>.json for every known provider, or those of only."""
    names = {p.name for p in PROVIDERS}
    if wrong := sorted({*(only or ())} - names):
        raise ValueError(f"unknown providers: {', '.join(wrong)}")
    return load(spark, {p.name: (f"{folder.rstrip('/')}/{p.name}.json", p.mode, p.evidence) for p in PROVIDERS if only is None or p.name in only})


def load(spark: SparkSession, files: dict[str, tuple[str, str, str]]) -> tuple[DataFrame, DataFrame]:
    """(sources, entries) for evidence.answers() of {provider: (path, mode, evidence)}.

    Each file holds an object whose entries list objects with formula, identifier and optionally n_documents. A provider whose file is absent, no JSON, or without such a list is there with available false
    and no entries. Formulas that do not parse are left out; of several spellings of a composition the first
    in the list counts."""
    rows, parts = [], None
    for name, (path, mode, evidence) in files.items():
        read = None
        try:
            text = spark.read.text(path, wholetext=True).select(F.from_json("value", f"entries {ENTRY}").alias("d"))
            listed = cut(text.where(F.col("d.entries").isNotNull()))
            read = listed if not listed.isEmpty() else None
        except (AnalysisException, Py4JJavaError, SparkException) as e:
            print(f"{name} cannot be read and counts as unavailable: {str(e).splitlines()[0]}", file=sys.stderr)
        rows.append((name, mode, evidence, read is not None))
        if read is not None:
            part = read.select(F.lit(name).alias("provider"), F.posexplode("d.entries").alias("pos", "e")).select("provider", "pos", "e.*")
            parts = part if parts is None else parts.unionByName(part)
    sources = spark.createDataFrame(rows, "provider string, mode string, evidence string, available boolean")
    schema = "provider string, pos int, key string, reduced_formula string, identifier string, n_documents int"
    if parts is None:
        return sources, spark.createDataFrame([], schema).drop("pos")

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parsed = [fm.parse(f) for f in pdf["formula"]]
            out = pdf[[p.ok for p in parsed]].copy()
            good = [p.counts for p in parsed if p.ok]
            out["key"], out["reduced_formula"] = [fm.key(c) for c in good], [fm.spell(c) for c in good]
            yield out[["provider", "pos", "key", "reduced_formula", "identifier", "n_documents"]]

    entries = parts.mapInPandas(keyed, schema)
    rest = [c for c in entries.columns if c not in ("provider", "key")]
    first = entries.groupBy("provider", "key").agg(F.min_by(F.struct(*rest), "pos").alias("f"))
    return sources, first.select("provider", "key", "f.reduced_formula", "f.identifier", "f.n_documents")
