"""Queries of the training-text problems 2, 6, 7, 8 and 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefold.llm import bpe, history, leak, level, merkle
from orefold.session import tune
from orefold.sources.tables import evened, table

#: The findings reach the index in so many consecutive arrivals; shards are merged once so many stand side by side.
ARRIVALS, COMPACT_EVERY = 3, 2


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.copies(evened(table(tune(spark), folder, "corpus_entries", "entry_id", "entry_text")), "entry_id", "entry_text")


def p2_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.distinct_records(evened(table(tune(spark), folder, "corpus_entries", "entry_id", "entry_text")), "entry_id", "entry_text")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(tune(spark), folder, "violations", "finding_id", "proposal_id", "message", "fingerprint")
    return history.repeats_by_arrival(rows, "finding_id", "proposal_id", "message", "fingerprint", parts=ARRIVALS, compact_every=COMPACT_EVERY)


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(evened(table(tune(spark), folder, "documents", "doc_id", "text")), "doc_id", "text", f"{bpe.TOKENIZERS}/byte_bpe_50k.json")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    docs = evened(table(tune(spark), folder, "documents", "doc_id", "text"))
    return leak.leaks(docs, "doc_id", "text", table(spark, folder, "eval_items", "item_id", "text"), "item_id", "text")


def p8_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    docs = evened(table(tune(spark), folder, "documents", "doc_id", "text"))
    return leak.cleaned(docs, "doc_id", "text", table(spark, folder, "eval_items", "item_id", "text"), "item_id", "text")


def p9_levels(spark: SparkSession, folder: str) -> DataFrame:
    docs = evened(table(tune(spark), folder, "documents", "doc_id", "text"))
    labels = table(spark, folder, "reading_labels", "doc_id", "reading_level")
    return level.levels(docs, "doc_id", "text", level.train(docs, "doc_id", "text", labels, "doc_id", "reading_level"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_levels(spark, folder).where(F.col("level") >= level.HARD).select("doc_id")


QUERIES = {f.__name__: f for f in (p2_found, p2_distinct, p6_found, p7_ids, p8_found, p8_cleaned, p9_found, p9_levels)}
_FORMS = r"""WITH t AS (SELECT entry_id, x.fullkey, x.type, x.atom FROM corpus_entries c, json_tree(c.entry_text) x WHERE c.entry_text IS NOT NULL),
      n AS (SELECT entry_id, regexp_replace(lower(fullkey), '[^\p{L}\p{N}.]+', '', 'g') AS k, CASE WHEN type = 'VARCHAR' THEN 's' || regexp_replace(regexp_replace(regexp_replace(lower(atom->>'$'), '([0-9])\.([0-9])', '\1ţ\2', 'g'), '([0-9])\.([0-9])', '\1ţ\2', 'g'), '[^\p{L}\p{N}]+', '', 'g')
        WHEN type IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN 'n' || CAST(CAST(CAST(atom AS VARCHAR) AS DOUBLE) AS VARCHAR) WHEN type = 'OBJECT' THEN 'o' ELSE type || coalesce(CAST(atom AS VARCHAR), '') END AS v FROM t),
      g AS (SELECT entry_id, string_agg(k || '=' || v, '|' ORDER BY k, v) AS form FROM n GROUP BY 1)"""
SQL: dict[str, str] = {
    "p2_found": _FORMS + ", m AS (SELECT entry_id, min(entry_id) OVER (PARTITION BY form) AS keep_id FROM g) SELECT keep_id, entry_id AS copy_id FROM m WHERE keep_id <> entry_id",
    "p2_distinct": _FORMS + " SELECT min(entry_id) AS keep_id, count(*) AS copies FROM g GROUP BY form",
    "p8_found": r"""WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL), ig AS (SELECT DISTINCT item_id, array_to_string(w[s:s + 9], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 8)) AS s FROM i)),
      d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL), dg AS (SELECT doc_id, array_to_string(w[s:s + 9], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 8)) AS s FROM d))
      SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
}
