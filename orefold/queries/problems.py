"""Queries of the general data problems 1, 3, 4 and 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefold.operators import drift, rejects, shred, unify_units
from orefold.session import tune
from orefold.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return drift.changes(table(tune(spark), folder, "run_files", "producer", "file_seq", "payload"))


def p1_runs(spark: SparkSession, folder: str) -> DataFrame:
    return drift.unify(table(tune(spark), folder, "run_files", "row_no", "producer", "file_seq", "payload"), "row_no", "payload")


def p1_columns(spark: SparkSession, folder: str) -> DataFrame:
    """The columns of p1_runs alone."""
    return p1_runs(spark, folder).drop("others")


def p1_casts(spark: SparkSession, folder: str) -> DataFrame:
    return drift.cast_table(table(tune(spark), folder, "run_files", "producer", "file_seq", "payload"))


def _rejected(spark: SparkSession, folder: str, *, with_fields: bool) -> DataFrame:
    return rejects.reject_lines(table(tune(spark), folder, "claim_lines", "line_id", "raw_line"), "line_id", "raw_line", with_fields=with_fields)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _rejected(spark, folder, with_fields=False).where(F.col("reason").isNotNull()).select("line_id", "reason")


def p3_loaded(spark: SparkSession, folder: str) -> DataFrame:
    return rejects.load_lines(_rejected(spark, folder, with_fields=True), "line_id")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return shred.children(table(tune(spark), folder, "batch_files", "batch_no", "payload"), "batch_no", "payload")


def p4_proposals(spark: SparkSession, folder: str) -> DataFrame:
    return shred.proposals(table(tune(spark), folder, "batch_files", "batch_no", "payload"), "batch_no", "payload")


def p4_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return shred.shred(table(tune(spark), folder, "batch_files", "batch_no", "payload"), "batch_no", "payload")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    cols = ("proposal_no", "structure", "claimed_properties", "synthesis_hint", "rationale")
    return unify_units.converted(table(tune(spark), folder, "proposals", *cols), "proposal_no")


def p5_common(spark: SparkSession, folder: str) -> DataFrame:
    cols = ("proposal_no", "structure", "claimed_properties", "synthesis_hint", "rationale")
    return unify_units.common_units(table(tune(spark), folder, "proposals", *cols), "proposal_no")


QUERIES = {f.__name__: f for f in (p1_found, p1_runs, p1_columns, p1_casts, p3_found, p3_loaded, p4_found, p4_proposals, p4_nodes, p5_found, p5_common)}
_NUMBER = r"^ *[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)? *\z"
_FIELDS = r"""SELECT line_id, raw_line, regexp_extract_all(',' || raw_line, ',("[^"]*(?:""[^"]*)*"|[^",]*)', 1) AS f FROM claim_lines"""


def _finite(v: str) -> str:
    return f"(regexp_matches({v}, '{_NUMBER}') AND coalesce(abs(TRY_CAST(trim({v}) AS DOUBLE)) < 'inf'::DOUBLE, false))"


def _field(i: int) -> str:
    return f"CASE WHEN f[{i}] LIKE '\"%' THEN replace(substring(f[{i}], 2, length(f[{i}]) - 2), '\"\"', '\"') ELSE f[{i}] END"


def _alias_case(name: str, paths: tuple[str, ...]) -> str:
    folded = [x.lower().replace("_", "").replace("-", "") for x in paths]
    steps = ", ".join(f"'{x}'" for x in folded if "." not in x) or "''"
    return f"WHEN fold IN ({', '.join(repr(x) for x in folded)}) OR step IN ({steps}) THEN '{name}'"


SQL: dict[str, str] = {
    "p1_found": """WITH leaf AS (SELECT producer, file_seq, replace(substring(t.fullkey, 3), '"', '') AS path,
          CASE t.type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' ELSE 'number' END AS kind,
          CASE WHEN t.type IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(CAST(t.atom AS VARCHAR)::DOUBLE AS VARCHAR) ELSE CAST(t.value AS VARCHAR) END AS v
        FROM run_files r, json_tree(r.payload) t WHERE t.type NOT IN ('OBJECT', 'NULL') AND t.fullkey NOT LIKE '%[%'),
      d AS (SELECT DISTINCT * FROM leaf), k AS (SELECT producer, file_seq, path, list_sort(list(DISTINCT kind)) AS kinds FROM d GROUP BY ALL),
      files AS (SELECT producer, file_seq, lag(file_seq) OVER (PARTITION BY producer ORDER BY file_seq) AS prev FROM (SELECT DISTINCT producer, file_seq FROM run_files)),
      now AS (SELECT k.*, prev FROM k JOIN files USING (producer, file_seq) WHERE prev IS NOT NULL), old AS (SELECT f.producer, f.file_seq, k.path, k.kinds, f.prev FROM files f JOIN k ON k.producer = f.producer AND k.file_seq = f.prev),
      j AS (SELECT producer, file_seq, path, now.kinds AS a, old.kinds AS b FROM now FULL OUTER JOIN old USING (producer, file_seq, path)),
      come AS (SELECT producer, file_seq, path FROM j WHERE b IS NULL), gone AS (SELECT producer, file_seq, path FROM j WHERE a IS NULL),
      ren AS (SELECT DISTINCT g.producer, g.file_seq, g.path AS old_path, c.path AS new_path FROM gone g JOIN come c USING (producer, file_seq) JOIN files f USING (producer, file_seq)
        JOIN d x ON x.producer = g.producer AND x.file_seq = f.prev AND x.path = g.path JOIN d y ON y.producer = g.producer AND y.file_seq = g.file_seq AND y.path = c.path AND y.kind = x.kind AND y.v = x.v)
      SELECT producer, file_seq, 'renamed' AS change_kind, old_path, new_path FROM ren
      UNION ALL SELECT producer, file_seq, 'removed', path, '' FROM gone g WHERE NOT EXISTS (SELECT 1 FROM ren r WHERE r.producer = g.producer AND r.file_seq = g.file_seq AND r.old_path = g.path)
      UNION ALL SELECT producer, file_seq, 'added', '', path FROM come c WHERE NOT EXISTS (SELECT 1 FROM ren r WHERE r.producer = c.producer AND r.file_seq = c.file_seq AND r.new_path = c.path)
      UNION ALL SELECT producer, file_seq, 'retyped', path, path FROM j WHERE a <> b""",
    "p1_columns": f"""WITH leaf AS (SELECT row_no, replace(substring(t.fullkey, 3), '"', '') AS path, CASE t.type WHEN 'VARCHAR' THEN t.atom->>'$' ELSE replace(CAST(t.value AS VARCHAR), ' ', '') END AS v FROM run_files r, json_tree(r.payload) t WHERE t.type NOT IN ('OBJECT', 'NULL') AND t.fullkey NOT LIKE '%[%'),
      f AS (SELECT *, regexp_replace(lower(path), '[^a-z0-9.]', '', 'g') AS fold FROM leaf), g AS (SELECT *, list_extract(string_split(fold, '.'), -1) AS step FROM f), c AS (SELECT *, CASE {' '.join(_alias_case(name, paths) for name, _, paths in drift.ALIASES)} END AS col FROM g)
      SELECT r.row_no, {', '.join(f"TRY_CAST(arg_min(v, path) FILTER (col = '{n}') AS {'VARCHAR' if k == 'string' else k.upper()}) AS {n}" for n, k, _ in drift.ALIASES)} FROM run_files r LEFT JOIN c USING (row_no) GROUP BY 1""",
    "p1_casts": f"""WITH leaf AS (SELECT DISTINCT producer, file_seq, replace(substring(t.fullkey, 3), '"', '') AS path, CASE t.type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' ELSE 'number' END AS kind FROM run_files r, json_tree(r.payload) t WHERE t.type NOT IN ('OBJECT', 'NULL') AND t.fullkey NOT LIKE '%[%'),
      files AS (SELECT producer, file_seq, row_number() OVER (PARTITION BY producer ORDER BY file_seq) AS r FROM (SELECT DISTINCT producer, file_seq FROM run_files)), n AS (SELECT *, r - row_number() OVER (PARTITION BY producer, path, kind ORDER BY r) AS island FROM leaf JOIN files USING (producer, file_seq)),
      spans AS (SELECT producer, path, kind, min(file_seq) AS first_seq, max(file_seq) AS last_seq FROM n GROUP BY producer, path, kind, island), f AS (SELECT *, regexp_replace(lower(path), '[^a-z0-9.]', '', 'g') AS fold FROM spans), g AS (SELECT *, list_extract(string_split(fold, '.'), -1) AS step FROM f),
      c AS (SELECT *, CASE {' '.join(_alias_case(name, paths) for name, _, paths in drift.ALIASES)} END AS col FROM g)
      SELECT producer, path, kind, first_seq, last_seq, coalesce(col, path) AS "column", CASE {' '.join(f"WHEN col = '{name}' THEN '{kind}'" for name, kind, _ in drift.ALIASES)} ELSE kind END AS cast_to FROM c""",
    "p3_loaded": f"""WITH p AS ({_FIELDS}), q AS (SELECT *, raw_line IS NOT NULL AND coalesce(list_sum(list_transform(f, lambda x: length(x) + 1)), 0) = length(raw_line) + 1 AND len(f) = 9 AS ok, {_field(3)} AS v, {_field(7)} AS t FROM p)
      SELECT line_id, {', '.join(f'TRY_CAST(trim({_field(i)}) AS DOUBLE) AS {c}' if c in ('value', 'temperature') else f'{_field(i)} AS "{c}"' for i, c in enumerate(rejects.CLAIM_HEADER, 1))} FROM q WHERE ok AND {_finite('v')} AND ({_finite('t')} OR regexp_full_match(t, '\\s*'))""",
    "p3_found": f"""WITH p AS ({_FIELDS}), q AS (SELECT line_id, CASE WHEN raw_line IS NULL OR coalesce(list_sum(list_transform(f, lambda x: length(x) + 1)), 0) <> length(raw_line) + 1 THEN 'quoting' WHEN len(f) <> 9 THEN 'column_count' END AS why, {_field(3)} AS v, {_field(7)} AS t FROM p),
      r AS (SELECT line_id, coalesce(why, CASE WHEN NOT {_finite('v')} THEN 'value' WHEN NOT ({_finite('t')} OR regexp_full_match(t, '\\s*')) THEN 'temperature' END) AS reason FROM q) SELECT line_id, reason FROM r WHERE reason IS NOT NULL""",
}
