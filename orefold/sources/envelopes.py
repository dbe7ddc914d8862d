"""Untrusted JSON batches: budget before reading, depth before parsing, strict parsing, bounds, version."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orefold.functions.text import canonical
from orefold.schemas import issues, step

_TOKENS = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\Z)|[\[{]|[\]}]', re.S)
_STAMP = re.compile(r"\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})\Z")
STAMPS = ("created_at", "retrieved_at", "timestamp")


class Rejected(ValueError):
    def __init__(self, code: str, rule: str, detail: str) -> None:
        super().__init__(detail)
        self.code, self.rule, self.detail = code, rule, detail


def check_depth(text: str, most: int) -> None:
    """Nesting measured on the raw text, so that no parser meets what is too deep."""
    depth = 0
    for m in _TOKENS.finditer(text):
        c = m[0][0]
        if c in "[{":
            depth += 1
            if depth > most:
                raise Rejected("FMT.JSON.DEPTH_EXCEEDED", "input.nesting_depth", f"deeper than {most}")
        elif c != '"':
            depth -= 1


def _unique(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise Rejected("FMT.JSON.DUPLICATE_KEY", "input.duplicate_keys", "an object repeats a key")
    return out


def _no_constant(name: str) -> float:
    raise Rejected("FMT.JSON.NON_FINITE_NUMBER", "input.non_finite_numbers", name)


def _finite(text: str) -> float:
    value = float(text)
    return value if math.isfinite(value) else _no_constant(text)


def strict(text: str) -> object:
    """The parsed text; repeated keys, NaN, infinities and numbers too large for a float are refused."""
    try:
        return json.loads(text, object_pairs_hook=_unique, parse_constant=_no_constant, parse_float=_finite)
    except Rejected:
        raise
    except (ValueError, RecursionError) as e:
        raise Rejected("FMT.JSON.UNPARSEABLE", "input.json_parseable", str(e)[:200]) from None


def check_bounds(value: object, limits: dict) -> list[str]:
    """Counts nodes, keys included, and measures strings and arrays; returns pointers of naive timestamps."""
    nodes, naive, stack = 0, [], [("", value)]
    while stack:
        p, v = stack.pop()
        nodes += 1
        if isinstance(v, str) and len(v) > limits["max_string"]:
            raise Rejected("FMT.SCHEMA.TYPE_MISMATCH", "input.string_length", p)
        if isinstance(v, list):
            if len(v) > limits["max_array"]:
                raise Rejected("FMT.SCHEMA.TYPE_MISMATCH", "input.array_length", p)
            stack += [(step(p, i), x) for i, x in enumerate(v)]
        elif isinstance(v, dict):
            nodes += len(v)
            for k, x in v.items():
                if len(k) > limits["max_string"]:
                    raise Rejected("FMT.SCHEMA.TYPE_MISMATCH", "input.string_length", p)
                if k in STAMPS and isinstance(x, str) and not _STAMP.match(x):
                    naive.append(step(p, k))
                stack.append((step(p, k), x))
        if nodes > limits["max_nodes"]:
            raise Rejected("FMT.JSON.SIZE_EXCEEDED", "input.node_count", f"more than {limits['max_nodes']}")
    return sorted(naive)


def read_batch(content: bytes, limits: dict) -> dict:
    """One envelope: batch_id, proposals as canonical JSON, naive timestamps; raises Rejected with the reason."""
    try:
        text = bytes(content).decode("utf-8")
    except UnicodeDecodeError:
        raise Rejected("FMT.JSON.UNPARSEABLE", "input.json_parseable", "not UTF-8") from None
    check_depth(text, limits["max_depth"])
    doc = strict(text)
    naive = check_bounds(doc, limits)
    if not isinstance(doc, dict):
        raise Rejected("FMT.JSON.UNPARSEABLE", "input.json_parseable", "not an object")
    version = doc.get("schema_version")
    if not isinstance(version, str) or not re.fullmatch(r"\d+-\d+-\d+", version) or version.split("-")[0] != limits["model"]:
        raise Rejected("FMT.SCHEMA.VERSION_UNSUPPORTED", "input.schema_version", str(version)[:64])
    proposals = doc.get("proposals")
    if not isinstance(proposals, list) or not proposals:
        raise Rejected("FMT.SCHEMA.REQUIRED_FIELD_MISSING", "record.schema_conformance", "no proposals")
    return {"batch_id": str(doc.get("batch_id", ""))[:64], "proposals": [canonical(p) for p in proposals], "naive": naive}


_RESULT = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("code", "rule", "detail", "batch_id")] + [T.StructField("proposals", T.ArrayType(T.StringType())), T.StructField("naive", T.ArrayType(T.StringType()))]
)


def envelopes(spark: SparkSession, path: str, limits: dict) -> DataFrame:
    """(path, length, digest, code, rule, detail, batch_id, proposals, naive): one row per *.json file of path."""
    return parse_files(spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path), limits)


def parse_files(files: DataFrame, limits: dict) -> DataFrame:
    """envelopes() of (path, length, content) rows.

    Files over the byte budget are rejected by their length alone; their content is not read."""

    @F.pandas_udf(_RESULT)
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = []
            for content in s:
                try:
                    ok = read_batch(content, limits)
                    rows.append((None, None, None, ok["batch_id"], ok["proposals"], ok["naive"]))
                except Rejected as e:
                    rows.append((e.code, e.rule, e.detail, None, None, None))
            yield pd.DataFrame(rows, columns=_RESULT.fieldNames())

    small = files.where(F.col("length") <= limits["max_bytes"]).select("path", "length", F.sha2("content", 256).alias("digest"), parse("content").alias("r"))
    small = small.select("path", "length", "digest", "r.*")
    large = files.where(F.col("length") > limits["max_bytes"]).select(
        "path", "length", F.lit(None).cast("string").alias("digest"), F.lit("FMT.JSON.SIZE_EXCEEDED").alias("code"), F.lit("input.byte_budget").alias("rule"), F.col("length").cast("string").alias("detail"),
        F.lit(None).cast("string").alias("batch_id"), F.lit(None).cast("array<string>").alias("proposals"), F.lit(None).cast("array<string>").alias("naive"),
    )
    return small.unionByName(large)


_ISSUES = T.ArrayType(T.StructType([T.StructField("json_pointer", T.StringType()), T.StructField("code", T.StringType())]))


@F.pandas_udf(_ISSUES)
def conformance(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Issues of a proposal's JSON against the closed schema, sorted by pointer and code; empty if it conforms."""
    for s in batches:
        yield pd.Series([[{"json_pointer": p, "code": c} for p, c in issues(json.loads(d))] for d in s], dtype=object)


def proposals_of(batches: DataFrame) -> DataFrame:
    """(path, pos, key, proposal_id, doc, candidate_key, issues): the proposals of admitted envelopes in order."""
    rows = batches.where(F.col("code").isNull()).select("path", F.posexplode("proposals").alias("pos", "doc"))
    name = F.get_json_object("doc", "$.proposal_id")
    key = F.concat(F.regexp_extract("path", r"([^/]+)$", 1), F.lit("#"), F.lpad(F.col("pos").cast("string"), 6, "0"))
    return rows.select("path", "pos", key.alias("key"), name.alias("proposal_id"), "doc", F.concat(F.lit("sha256:"), F.sha2("doc", 256)).alias("candidate_key"), conformance("doc").alias("issues"))
