"""Schemas that drift between files: a catalogue of path lifespans, the changes it implies, one cast table.

A file is the rows of one producer and file_seq. Its footer is the set of (path, type) its payloads show.
Per producer, path and type the files form islands; the start and end of an island are the changes. The casts
of the islands, from an alias table and the renames found, bring all rows into one table. Payloads are parsed
once, into a written table of leaves.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orefold.plans.skew import dictionary_join
from orefold.session import cut, scratch, stored

#: Characters of a value from which on its digest stands for it where values are compared.
LONG_VALUE = 64
#: Rounds in which a column's name is handed on from one renamed path to the next.
HANDED_ON = 8
Aliases = tuple[tuple[str, str, tuple[str, ...]], ...]


def _content(value: object) -> tuple[str, str]:
    """Type and content of a leaf; numbers by value, strings as they are, arrays as canonical JSON."""
    if isinstance(value, bool):
        return "boolean", str(value).lower()
    if isinstance(value, (int, float, Decimal)):
        d = Decimal(value) if not isinstance(value, float) else Decimal(repr(value))
        return "number", format(d.normalize() if d else Decimal(0), "f") if abs(d.adjusted()) < 400 else str(d.normalize())
    if isinstance(value, str):
        return "string", value
    return "array", _canonical(value)


def _canonical(value: object) -> str:
    """JSON without blanks, members sorted by key, numbers by value: equal arrays have one text, others another."""
    if isinstance(value, list):
        return "[" + ",".join(map(_canonical, value)) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{_canonical(v)}" for k, v in sorted(value.items())) + "}"
    if value is None or isinstance(value, str):
        return json.dumps(value)
    return _content(value)[1]


def leaves_of(text: str | None) -> list[tuple[str, str, str]]:
    """(path, type, content) of each non-null leaf of a JSON object; none for null, broken or other text."""
    try:
        doc = json.loads(text, parse_float=Decimal, parse_constant=lambda _: None) if text is not None else None
    except (ValueError, RecursionError):
        return []
    if not isinstance(doc, dict):
        return []
    out, stack = [], [("", doc)]
    while stack:
        prefix, node = stack.pop()
        for key, value in node.items():
            path = f"{prefix}.{key}" if prefix else key
            if isinstance(value, dict):
                stack.append((path, value))
            elif value is not None:
                out.append((path, *_content(value)))
    return out


def leaves(runs: DataFrame, producer: str, seq: str, payload: str, key: str | None = None) -> DataFrame:
    """(row, producer, file_seq, path, kind, content): every leaf of every payload, rows numbered in no order.

    key names a column to be carried along as _key. A row without a leaf, since its payload is null, broken or empty, has one with a null path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at, path, kind, content = [], [], [], []
            for i, text in enumerate(pdf["payload"]):
                for p, k, c in leaves_of(text) or [(None, None, None)]:
                    at.append(i)
                    path.append(p)
                    kind.append(k)
                    content.append(c)
            out = pdf[["row", "producer", "file_seq", *own]].iloc[np.array(at, np.int64)].reset_index(drop=True)
            yield out.assign(path=path, kind=kind, content=content)

    own = [] if key is None else ["_key"]
    kinds = {c: runs.schema[c].dataType.simpleString() for c in (producer, seq, *([] if key is None else [key]))}
    carried = [] if key is None else [F.col(key).cast("string").alias("_key")]
    rows = runs.select(F.monotonically_increasing_id().alias("row"), F.col(producer).alias("producer"), F.col(seq).cast("string").alias("file_seq"), *carried, F.col(payload).alias("payload"))
    flat = rows.mapInPandas(run, f"row bigint, producer {kinds[producer]}, file_seq string, {'' if key is None else '_key string, '}path string, kind string, content string")
    # Numbers travel as text: pandas would take whole numbers with a null among them as floats.
    out = flat.withColumn("file_seq", F.col("file_seq").cast(kinds[seq]))
    return out if key is None else out.withColumn("_key", F.col("_key").cast(kinds[key]))


def in_files(leaf: DataFrame) -> DataFrame:
    """The leaves that belong to a file and have a path."""
    return leaf.where(F.col("producer").isNotNull() & F.col("file_seq").isNotNull() & F.col("path").isNotNull())


def footers(leaf: DataFrame) -> DataFrame:
    """(producer, file_seq, path, kind, n): the footer metadata of each file, exploded, with the leaves of each."""
    return in_files(leaf).groupBy("producer", "file_seq", "path", "kind").agg(F.count(F.lit(1)).alias("n"))


def catalogue(runs: DataFrame, producer: str, seq: str, payload: str) -> DataFrame:
    """(producer, file_seq, path, kind): the footer metadata of each file, exploded and made distinct."""
    return footers(leaves(runs, producer, seq, payload)).drop("n")


def files_of(runs: DataFrame, producer: str, seq: str) -> DataFrame:
    """(producer, file_seq, before, after): each file with its neighbours among the files present."""
    files = runs.where(F.col(producer).isNotNull() & F.col(seq).isNotNull()).select(F.col(producer).alias("producer"), F.col(seq).alias("file_seq")).distinct()
    w = Window.partitionBy("producer").orderBy("file_seq")
    return files.withColumns({"before": F.lag("file_seq").over(w), "after": F.lead("file_seq").over(w)})


def lifespans(entries: DataFrame, files: DataFrame) -> DataFrame:
    """(producer, path, kind, first_seq, last_seq, next_seq): each island of consecutive files per path and type.

    next_seq is the file after the island, null if the island reaches the producer's last file.
    """
    w = Window.partitionBy("producer", "path", "kind").orderBy("file_seq")
    e = entries.join(files, ["producer", "file_seq"]).withColumn("_prev", F.lag("file_seq").over(w))
    e = e.withColumn("_new", F.when(F.col("_prev").eqNullSafe(F.col("before")) & F.col("before").isNotNull(), 0).otherwise(1))
    e = e.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max(F.struct("file_seq", "after"))
    first = F.min(F.struct("file_seq", "before"))
    return e.groupBy("producer", "path", "kind", "_island").agg(first.alias("a"), last.alias("z")).select(
        "producer", "path", "kind", F.col("a.file_seq").alias("first_seq"), F.col("a.before").alias("before_seq"), F.col("z.file_seq").alias("last_seq"), F.col("z.after").alias("next_seq")
    )


def _edges(spans: DataFrame) -> DataFrame:
    """(producer, file_seq, before, path, came, went): per file the types of a path that start or end there."""
    starts = spans.where(F.col("before_seq").isNotNull()).select("producer", F.col("first_seq").alias("file_seq"), F.col("before_seq").alias("before"), "path", F.col("kind").alias("came"), F.lit(None).cast("string").alias("went"))
    ends = spans.where(F.col("next_seq").isNotNull()).select("producer", F.col("next_seq").alias("file_seq"), F.col("last_seq").alias("before"), "path", F.lit(None).cast("string").alias("came"), F.col("kind").alias("went"))
    return starts.unionByName(ends)


def changes(runs: DataFrame, producer: str = "producer", seq: str = "file_seq", payload: str = "payload") -> DataFrame:
    """(producer, file_seq, change_kind, old_path, new_path): every difference of a file to the one before it.

    A path that goes and one that comes in the same file are renamed if some value, equal in type and
    content, stands in both; else they are removed (new_path '') and added (old_path ''). A path that
    stays with another set of types is retyped. A path that matches several others gives a row for each.
    A file whose rows hold no readable value has no path. Rows without producer or file_seq belong to no
    file; a null or broken payload adds nothing; an empty table gives no rows.
    """
    with scratch(runs.sparkSession) as work:
        leaf = stored(leaves(runs, producer, seq, payload), f"{work}/leaves")
        moved, renamed = _moves(leaf, work)
        gone = renamed.select("producer", "file_seq", F.col("old_path").alias("path"), F.lit("removed").alias("what")).distinct()
        come = renamed.select("producer", "file_seq", F.col("new_path").alias("path"), F.lit("added").alias("what")).distinct()
        single = moved.join(gone.unionByName(come), ["producer", "file_seq", "path", "what"], "left_anti")
        single = single.select(
            "producer",
            "file_seq",
            F.col("what").alias("change_kind"),
            F.when(F.col("what") == "added", F.lit("")).otherwise(F.col("path")).alias("old_path"),
            F.when(F.col("what") == "removed", F.lit("")).otherwise(F.col("path")).alias("new_path"),
        )
        return cut(single.unionByName(renamed.select("producer", "file_seq", F.lit("renamed").alias("change_kind"), "old_path", "new_path")))


def _moves(leaf: DataFrame, work: str) -> tuple[DataFrame, DataFrame]:
    """What comes, goes or changes its type in which file, and which of the comings and goings are renames."""
    entries = stored(footers(leaf), f"{work}/entries")
    files = stored(files_of(leaf, "producer", "file_seq"), f"{work}/files")
    spans = lifespans(entries.drop("n"), files)
    at = ["producer", "file_seq", "before", "path"]
    edges = _edges(spans).groupBy(*at).agg(F.count("came").alias("came"), F.count("went").alias("went"))
    # A path with an edge that is still there under an unchanged type neither comes nor goes as a whole.
    here = entries.groupBy("producer", "file_seq", "path").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n"))
    here = stored(here, f"{work}/here")
    now = here.select("producer", "file_seq", "path", F.col("kinds").alias("n_now"))
    old = here.select("producer", F.col("file_seq").alias("before"), "path", F.col("kinds").alias("n_old"))
    moved = edges.join(now, ["producer", "file_seq", "path"], "left").join(old, ["producer", "before", "path"], "left")
    what = F.when(F.col("n_old").isNull(), F.lit("added")).when(F.col("n_now").isNull(), F.lit("removed")).otherwise(F.lit("retyped"))
    moved = stored(moved.select(*at, what.alias("what")), f"{work}/moved")
    return moved, stored(_renames(leaf, here, moved.where(F.col("what") != "retyped"), work), f"{work}/renamed")


def _renames(leaf: DataFrame, here: DataFrame, moved: DataFrame, work: str) -> DataFrame:
    """(producer, file_seq, kind, old_path, new_path) of goings and comings of one file that share a value.

    Of files with both only the leaves at paths that move are kept; they meet on (file, type, value), where
    each side is distinct. A path of a file may hold many of the leaves, so leaves find their paths with hot
    ones apart."""
    both = moved.groupBy("producer", "file_seq").agg(F.count_if(F.col("what") == "removed").alias("g"), F.count_if(F.col("what") == "added").alias("c")).where("g > 0 AND c > 0")
    some = moved.join(both.select("producer", "file_seq"), ["producer", "file_seq"], "left_semi")
    wanted = some.select("producer", F.when(F.col("what") == "removed", F.col("before")).otherwise(F.col("file_seq")).alias("seq"), "path", F.when(F.col("what") == "removed", F.col("file_seq")).alias("leaves"), F.when(F.col("what") == "added", F.col("file_seq")).alias("enters"))
    wanted = wanted.groupBy("producer", "seq", "path").agg(F.max("leaves").alias("leaves_in"), F.max("enters").alias("enters_in"))
    wanted = wanted.join(here.select("producer", F.col("file_seq").alias("seq"), "path", "n"), ["producer", "seq", "path"])
    value = F.when(F.length("content") <= LONG_VALUE, F.col("content")).otherwise(F.sha2("content", 256))
    rows = in_files(leaf).select("producer", F.col("file_seq").alias("seq"), "path", "kind", value.alias("value"))
    found = dictionary_join(rows, wanted, ["producer", "seq", "path"], spread=F.col("value"), total=leaf.count()).where("leaves_in IS NOT NULL OR enters_in IS NOT NULL")
    met = stored(found.select("producer", "path", "kind", "value", "leaves_in", "enters_in").distinct(), f"{work}/met")
    left = met.where(F.col("leaves_in").isNotNull()).select("producer", F.col("leaves_in").alias("file_seq"), "kind", "value", F.col("path").alias("old_path"))
    right = met.where(F.col("enters_in").isNotNull()).select("producer", F.col("enters_in").alias("file_seq"), "kind", "value", F.col("path").alias("new_path"))
    return left.join(right, ["producer", "file_seq", "kind", "value"]).groupBy("producer", "file_seq", "old_path", "new_path").agg(F.min("kind").alias("kind"))


#: The alias table: (column, type, paths a producer may store it under). Paths are compared without case and
#: punctuation at their last step and in full.
ALIASES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("run_id", "string", ("run_id",)),
    ("taxonomy_version", "string", ("taxonomy_version", "tax_version", "violation_taxonomy", "provenance.taxonomy")),
    ("reward_fn_id", "string", ("reward_fn_id", "reward_function", "score_rule")),
    ("corpus_fingerprint", "string", ("corpus_fingerprint", "corpus_fp", "reference_digest", "meta.corpora")),
    ("logical_time", "string", ("logical_time",)),
    ("status", "string", ("status",)),
    ("mean_reward", "double", ("mean_reward",)),
    ("n_admitted", "bigint", ("counts.admitted",)),
    ("n_quarantined", "bigint", ("counts.quarantined",)),
)


def _fold(path: Column) -> Column:
    return F.regexp_replace(F.lower(path), r"[^a-z0-9.]", "")


def _column_of(path: Column, aliases: Aliases) -> Column:
    """The column a path stands for: it, or its last step, folds to one of the column's aliases; null for none."""
    full, out = _fold(path), F.lit(None).cast("string")
    for name, _, paths in reversed(aliases):
        names = [p.lower().replace("_", "").replace("-", "") for p in paths]
        hit = full.isin(names) | F.element_at(F.split(full, r"\."), -1).isin([n for n in names if "." not in n])
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def placed(entries: DataFrame, renamed: DataFrame, aliases: Aliases) -> DataFrame:
    """(producer, path, column, n): what each path of a producer stands for, null for what stands for itself.

    The alias table comes first. A path outside it takes the column of a path it was renamed from or to by the
    same producer, over several renames if need be, where a text was the shared value, the column holds text
    and no other column lays claim to it; equal numbers are too often chance."""
    paths = entries.groupBy("producer", "path").agg(F.sum("n").alias("n"))
    known = cut(paths.withColumn("column", _column_of(F.col("path"), aliases)))
    texts = [name for name, kind, _ in aliases if kind == "string"]
    a = renamed.where(F.col("kind") == "string").select("producer", F.col("old_path").alias("path"), F.col("new_path").alias("from"))
    links = cut(a.unionByName(a.select("producer", F.col("from").alias("path"), F.col("path").alias("from"))).distinct())
    for _ in range(HANDED_ON):
        told = known.where(F.col("column").isin(texts)).select("producer", F.col("path").alias("from"), "column")
        fresh = links.join(told, ["producer", "from"]).groupBy("producer", "path").agg(F.min("column").alias("to"), F.max("column").alias("last"))
        fresh = cut(fresh.where("to = last").join(known.where("column IS NULL").select("producer", "path"), ["producer", "path"], "left_semi").select("producer", "path", "to"))
        if fresh.isEmpty():
            break
        known = cut(known.join(fresh, ["producer", "path"], "left").select("producer", "path", F.coalesce("column", "to").alias("column"), "n"))
    return known


def unify(runs: DataFrame, key: str, payload: str, *, producer: str = "producer", seq: str = "file_seq", aliases: Aliases = ALIASES) -> DataFrame:
    """One consistent table of all rows: key, a column per alias, cast to its type, and others.

    What a path stands for is told by placed(), that is by the alias table and the renames of its producer. Of
    several paths of a column the first in alphabetical order that is not null decides. Arrays stand in a
    string column as canonical JSON. others holds every leaf that no column holds, in alphabetical order, as
    (path, kind, content): paths that stand for themselves under their own type, paths that did not decide,
    and values that do not cast, whose column is null. It is a list, since a payload can write a dotted path
    in two ways. A row whose payload is null or broken keeps its key and an empty list. Leaves come together
    by row, after their paths were looked up with hot paths apart.
    """
    with scratch(runs.sparkSession) as work:
        leaf = stored(leaves(runs, producer, seq, payload, key), f"{work}/leaves")
        _, renamed = _moves(leaf, work)
        mine = leaf.withColumn("producer", F.coalesce("producer", F.lit("")))
        counted = mine.where(F.col("path").isNotNull()).groupBy("producer", "path").agg(F.count(F.lit(1)).alias("n"))
        columns = stored(placed(counted, renamed, aliases), f"{work}/columns").where(F.col("column").isNotNull())
        rows = dictionary_join(mine, columns, ["producer", "path"], spread=F.col("row"), total=mine.count())
        one = F.struct("path", "kind", "content")
        # A leaf casts by itself; the first path of a column decides, whatever it casts to.
        own = [F.min(F.when(F.col("column") == name, one)).alias(f"_{i}") for i, (name, _, _) in enumerate(aliases)]
        per = rows.groupBy("row").agg(F.any_value("_key").alias(key), *own, F.array_sort(F.collect_list(F.when(F.col("path").isNotNull(), one))).alias("_all"))
        casts_ = [(F.col(f"_{i}"), name, F.col(f"_{i}.content") if kind == "string" else F.col(f"_{i}.content").try_cast(kind)) for i, (name, kind, _) in enumerate(aliases)]
        held = F.array_compact(F.array(*[F.when(c.isNotNull(), first) for first, _, c in casts_]))
        return cut(per.select(key, *[c.alias(name) for _, name, c in casts_], F.filter("_all", lambda x: ~F.array_contains(held, x)).alias("others")))


def casts(spans: DataFrame, columns: DataFrame | None = None, aliases: Aliases = ALIASES) -> DataFrame:
    """(producer, path, kind, first_seq, last_seq, column, cast_to): the cast each lifespan needs.

    columns is placed(), the alias table alone where it is not given. Paths that stand for themselves keep
    their path as column and their own type."""
    if columns is None:
        out = spans.withColumn("_column", _column_of(F.col("path"), aliases))
    else:
        out = spans.join(columns.select("producer", "path", F.col("column").alias("_column")), ["producer", "path"], "left")
    target = F.col("kind")
    for name, kind, _ in aliases:
        target = F.when(F.col("_column") == name, F.lit(kind)).otherwise(target)
    return out.select("producer", "path", "kind", "first_seq", "last_seq", F.coalesce("_column", "path").alias("column"), target.alias("cast_to"))


def cast_table(runs: DataFrame, producer: str = "producer", seq: str = "file_seq", payload: str = "payload", aliases: Aliases = ALIASES) -> DataFrame:
    """casts() of every lifespan of the runs, with the columns that unify() uses."""
    with scratch(runs.sparkSession) as work:
        leaf = stored(leaves(runs, producer, seq, payload), f"{work}/leaves")
        _, renamed = _moves(leaf, work)
        entries = runs.sparkSession.read.parquet(f"{work}/entries")
        spans = lifespans(entries.drop("n"), runs.sparkSession.read.parquet(f"{work}/files"))
        return cut(casts(spans, placed(entries, renamed, aliases), aliases))
