"""Sinks of a run: canonical JSON and JSON lines, each with its digest, and a manifest; tables as Parquet."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orefold.functions.text import canonical, rounded


def prepare(folder: str) -> Path:
    """An empty output folder; what stood there is removed, never merged with."""
    out = Path(folder)
    if out.exists():
        shutil.rmtree(out)
    out.mkdir(parents=True)
    return out


def _typed(row: dict) -> dict:
    """A finding's observed value as what it was, instead of its text."""
    kind, seen = row.pop("observed_kind", None), row.get("observed")
    if isinstance(seen, str) and kind in ("number", "integer", "boolean"):
        row["observed"] = seen == "true" if kind == "boolean" else int(seen) if kind == "integer" else float(seen)
    return row


def _line(row: dict) -> bytes:
    row = _typed(row) if "observed_kind" in row else row
    kept = {k: v for k, v in rounded(row).items() if v is not None}
    return canonical(kept, ascii_only=True).encode() + b"\n"


def write_lines(df: DataFrame, path: Path, order: list[str]) -> dict:
    """Sorted JSON lines with sorted keys, nulls left out, six significant digits. Rows are streamed partition
    by partition from a sorted table, so the driver holds one partition at a time. Returns digest and size."""
    h, size, n = hashlib.sha256(), 0, 0
    with path.open("wb") as f:
        for row in df.orderBy(*order).toLocalIterator():
            line = _line(row.asDict(recursive=True))
            f.write(line)
            h.update(line)
            size, n = size + len(line), n + 1
    return {"path": path.name, "sha256": h.hexdigest(), "bytes": size, "rows": n}


def write_table(df: DataFrame, folder: str) -> None:
    """The same rows as Parquet, written by all tasks: for runs too large for one file on the driver."""
    df.write.mode("overwrite").parquet(folder)


def write_document(value: object, path: Path) -> dict:
    data = _line(value) if isinstance(value, dict) else canonical(rounded(value), ascii_only=True).encode()
    path.write_bytes(data)
    return {"path": path.name, "sha256": hashlib.sha256(data).hexdigest(), "bytes": len(data)}


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a fixed schema; blank lines are skipped."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", schema).alias("r")).select("r.*")


def broken_lines(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """(value, why): the lines of a JSON lines file that are no JSON object, hold a field the schema lacks or a
    value of another type, or lack a required field; blank lines are skipped. The strict side of read_lines()."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    kind = T.StructType.fromDDL(schema)
    read = lines.select("value", F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"), F.json_object_keys("value").alias("keys"))
    missing = F.array_except(F.array(*[F.lit(c) for c in required]).cast("array<string>"), F.coalesce("keys", F.array().cast("array<string>")))
    unknown = F.array_except("keys", F.array(*[F.lit(c) for c in kind.fieldNames()]))
    why = F.when(F.col("keys").isNull(), F.lit("no object")).when(F.col("r._corrupt").isNotNull(), F.lit("type")).when(F.size(unknown) > 0, F.concat(F.lit("unknown "), F.array_join(unknown, " "))).when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, " ")))
    return read.select("value", why.alias("why")).where(F.col("why").isNotNull())


def numbered_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """read_lines() with the place of each line in its file, which zipWithIndex tells, as line."""
    rows = spark.read.text(path).rdd.zipWithIndex().map(lambda x: (x[1], x[0][0])).toDF("line bigint, value string")
    return rows.where(F.trim("value") != "").select("line", F.from_json("value", schema).alias("r")).select("line", "r.*")


def provenance() -> dict:
    """Commit and dirtiness as the environment states them; null where it does not."""
    dirty = os.environ.get("GIT_DIRTY")
    return {"commit": os.environ.get("GIT_COMMIT"), "dirty": None if dirty is None else dirty.lower() in ("1", "true", "yes")}


def file_digest(path: Path) -> str:
    """Digest of a file, read piece by piece."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def tree_digest(folder: str) -> str:
    """Digest over the names and contents of all files of a folder, in order of name."""
    h = hashlib.sha256()
    for p in sorted(Path(folder).rglob("*.py")):
        h.update(str(p.relative_to(folder)).encode() + b"\0" + hashlib.sha256(p.read_bytes()).digest())
    return h.hexdigest()


def verify_files(folder: str) -> list[str]:
    """Problems of a written run: files whose digest or size differs from the manifest, missing or extra ones."""
    out = Path(folder)
    try:
        manifest = json.loads((out / "manifest.json").read_text())
    except (OSError, ValueError) as e:
        return [f"manifest: {e}"]
    problems = []
    for a in manifest["artifacts"]:
        p = out / a["path"]
        if Path(a["path"]).is_absolute() or ".." in Path(a["path"]).parts:
            problems.append(f"{a['path']}: leaves the folder")
            continue
        if not p.is_file():
            problems.append(f"{a['path']}: missing")
        elif file_digest(p) != a["sha256"] or p.stat().st_size != a["bytes"]:
            problems.append(f"{a['path']}: content differs from the manifest")
    known = {a["path"] for a in manifest["artifacts"]} | {"manifest.json"}
    return problems + [f"{p.name}: not in the manifest" for p in sorted(out.iterdir()) if p.is_file() and p.name not in known]
