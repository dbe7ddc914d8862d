"""New batches against all history: index shards of postings, exact reranking, acceptance in order of arrival.

Rows agree if their proposal does and either the fingerprint is the same or the messages share three
quarters of their token set. Two messages that similar share one of their rarest tokens (those of the
prefix), so a shard stores each accepted row under (proposal, prefix token) and (proposal, fingerprint);
a new row is compared only with the rows it meets under a key. A key with many rows is replaced by keys of
two tokens, since similar messages share two in a prefix longer by one. A batch adds a shard; shards are
compacted on schedule.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orefold.plans.skew import dictionary_join
from orefold.session import cut, remove, scratch, stored

#: Token counts are kept in this many hashed buckets, one byte each: a table of fixed size for any corpus.
BUCKETS = 8192
#: Rows under one token beyond which the token's rows meet under pairs of tokens instead.
PAIR_ROWS = 2_000
#: Rows under one key beyond which its rows are split into blocks, each met by all queries of the key.
BLOCK_ROWS = 20_000
#: Undecided rows of one proposal that one task decides in order; more are decided in consecutive parts.
PART_ROWS = 20_000
#: Similarity as a fraction.
SHARE = (3, 4)

ROWS = "id bigint, k binary, f binary, form string"
POSTINGS = "h bigint, id bigint"


def _tokens(message: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(message), F.lit("([a-z0-9]+)"), F.lit(1))))


def normalised(df: DataFrame, id_col: str, key: str, message: str, fp: str) -> DataFrame:
    """(id, k, f, form): 128-bit digests of proposal and fingerprint, and the sorted distinct tokens of the message.

    Rows without id or proposal, or with neither fingerprint nor tokens, agree with nothing and are left out."""
    digest = lambda c: F.unhex(F.md5(c))
    k = F.lower(F.regexp_replace(F.col(key), "[^A-Za-z0-9]", ""))
    f = F.regexp_replace(F.lower(F.trim(F.col(fp))), "^sha256:", "")
    form = F.array_join(_tokens(F.col(message)), " ")
    out = df.select(F.col(id_col).cast("bigint").alias("id"), digest(k).alias("k"), digest(f).alias("f"), F.when(form != "", form).alias("form"))
    return out.where(F.col("id").isNotNull() & F.col("k").isNotNull() & (F.col("f").isNotNull() | F.col("form").isNotNull()))


def token_weights(forms: DataFrame) -> bytes:
    """One byte per bucket: the logarithm of the number of distinct rows whose tokens fall into it."""
    t = forms.select(F.explode(F.split("form", " ")).alias("t"))
    counted = t.groupBy(F.pmod(F.xxhash64("t"), F.lit(BUCKETS)).cast("int").alias("b")).count().collect()
    out = bytearray(BUCKETS)
    for b, n in counted:
        out[b] = min(255, int(8 * math.log2(1 + n)))
    return bytes(out)


def _needed(n: Column) -> Column:
    """Tokens of n that a similar message must share: the share, rounded up."""
    num, den = SHARE
    return F.floor((n * num + den - 1) / den).cast("int")


def _ranked(weights: bytes) -> Column:
    """Hashes of a form's tokens, the rarest first: by weight, then by hash."""
    weight = lambda t: F.substr(F.lit(bytearray(weights)), F.pmod(F.xxhash64(t), F.lit(BUCKETS)).cast("int") + 1, F.lit(1))
    pairs = F.array_sort(F.transform(F.split("form", " "), lambda t: F.struct(weight(t).alias("w"), F.xxhash64(t).alias("t"))))
    return F.transform(pairs, lambda s: s["t"])


def _token_key(t: Column) -> Column:
    return F.xxhash64(F.col("k"), F.lit("t"), t)


def postings(rows: DataFrame, weights: bytes) -> DataFrame:
    """(h, id): a row under each key it can be met by.

    Of n tokens the first n - ceil(3n/4) + 1 suffice: any message that shares three quarters shares one."""
    ranked, n = _ranked(weights), F.size(F.split("form", " "))
    by_token = F.when(F.col("form").isNotNull(), F.transform(F.slice(ranked, F.lit(1), n - _needed(n) + 1), _token_key))
    by_print = F.when(F.col("f").isNotNull(), F.array(F.xxhash64(F.col("k"), F.lit("f"), F.col("f"))))
    none = F.array().cast("array<bigint>")
    keys = F.array_union(F.coalesce(by_token, none), F.coalesce(by_print, none))
    return rows.select(F.explode(keys).alias("h"), "id")


def paired(hot: DataFrame, weights: bytes) -> DataFrame:
    """hot (h, id, k, f, form, ...) with the keys of hot tokens replaced by keys of two tokens.

    Messages that share the tokens needed share two of the first n - ceil(3n/4) + 2; the first of them is the
    token of h, the second makes the new key. Messages of one token, and fingerprints, keep h."""
    ranked, n = _ranked(weights), F.size(F.split("form", " "))
    prefix = F.slice(ranked, F.lit(1), F.least(n - _needed(n) + 2, n))
    at = F.array_position(F.transform(prefix, _token_key), F.col("h")).cast("int")
    later = F.transform(F.slice(prefix, at + 1, F.greatest(F.size(prefix) - at, F.lit(0))), lambda t: F.xxhash64(F.col("h"), t))
    keys = F.when(F.col("form").isNull() | (at == 0) | (n == 1), F.array("h")).otherwise(later)
    rest = [c for c in hot.columns if c != "h"]
    return hot.select(F.explode(keys).alias("h"), *rest)


def _agree(a: tuple, b: tuple) -> bool:
    """a and b are (k, f, tokens)."""
    if a[0] != b[0]:
        return False
    if a[1] is not None and a[1] == b[1]:
        return True
    x, y = a[2], b[2]
    if not x or not y:
        return False
    num, den = SHARE
    if den * min(len(x), len(y)) < num * max(len(x), len(y)):
        return False
    common = len(x & y)
    return den * common >= num * (len(x) + len(y) - common)


def _row(k: bytes, f: bytes | None, form: str | None) -> tuple:
    """Digests come as bytes, so no null among them turns them into floats."""
    return bytes(k), None if f is None else bytes(f), frozenset(form.split(" ")) if isinstance(form, str) else frozenset()


def _meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each query of a key, in order of id, the smallest held row before it that it agrees with."""
    key, index = None, []
    for pdf in batches:
        new, old = [], []
        for h, b, i, k, f, form, asks, holds in zip(pdf["h"], pdf["b"], pdf["id"], pdf["k"], pdf["f"], pdf["form"], pdf["asks"], pdf["holds"]):
            if (h, b) != key:
                key, index = (h, b), []
            me = _row(k, f, form)
            if asks:
                for j, other in index:
                    if _agree(me, other):
                        new.append(i)
                        old.append(j)
                        break
            if holds:
                index.append((i, me))
        yield pd.DataFrame({"new_id": new, "old_id": old})


def _nearest(posted: DataFrame) -> DataFrame:
    """(new_id, old_id): per asking row the smallest holding row before it that it agrees with, over all its keys.

    posted has h, the columns of ROWS, asks, holds and n, the rows under the key. Keys with more than
    BLOCK_ROWS rows are split: each row is held in one block and asks in all, so no task holds more than about
    BLOCK_ROWS rows."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(BLOCK_ROWS)).cast("int"))
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    spread = posted.withColumn("own", own).withColumn("b", F.explode(F.when(F.col("asks"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array("own"))))
    spread = spread.withColumn("holds", F.col("holds") & (F.col("b") == F.col("own"))).where("asks OR holds")
    even = spread.select("h", "b", "id", "k", "f", "form", "asks", "holds").repartition("h", "b").sortWithinPartitions("h", "b", "id")
    return even.mapInPandas(_meet, "new_id bigint, old_id bigint").groupBy("new_id").agg(F.min("old_id").alias("old_id"))


def _in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Decides undecided rows, sorted by proposal and id, one by one: (new_id, old_id) of those that repeat.

    A row repeats the smaller of `before`, the accepted row of an earlier part, and the smallest row accepted
    here that it agrees with; one with neither is accepted."""
    key, by_key, kept = None, {}, {}
    for pdf in batches:
        new, old = [], []
        for k, i, f, form, hs, before in zip(pdf["k"], pdf["id"], pdf["f"], pdf["form"], pdf["hs"], pdf["before"]):
            if k != key:
                key, by_key, kept = k, {}, {}
            me = _row(k, f, form)
            hit = next((j for j in sorted({j for h in hs for j in by_key.get(h, ()) if before < 0 or j < before}) if _agree(me, kept[j])), before)
            if hit >= 0:
                new.append(i)
                old.append(hit)
                continue
            kept[i] = me
            for h in hs:
                by_key.setdefault(h, []).append(i)
        yield pd.DataFrame({"new_id": new, "old_id": old})


def decide(posted: DataFrame) -> DataFrame:
    """(new_id, old_id) of every asking row that repeats an accepted one; rows that do not ask are accepted.

    posted has h, the columns of ROWS, asks and n. A row without agreeing predecessor is accepted; one whose
    smallest is accepted repeats it. The others hang on rows that repeat something themselves. Agreement never
    leaves a proposal, so each proposal's open rows are decided in order in a task of their own; a proposal
    with more than PART_ROWS of them goes in consecutive parts, each of which first meets all that was
    accepted before. There are as many rounds as the largest proposal has parts, however long the chains."""
    near = cut(_nearest(posted.withColumn("holds", F.lit(True))))
    repeating = near.select(F.col("new_id").alias("old_id"))
    done = cut(near.join(repeating, "old_id", "left_anti").select("new_id", "old_id"))
    opened = cut(near.join(repeating, "old_id", "left_semi").select(F.col("new_id").alias("id")))
    if opened.isEmpty():
        return done
    lists = posted.join(opened, "id", "left_semi").select("h").distinct()
    rest = posted.drop("asks").join(lists, "h", "left_semi").join(done.select(F.col("new_id").alias("id")), "id", "left_anti")
    rest = cut(rest.join(opened.withColumn("open", F.lit(True)), "id", "left").withColumn("open", F.coalesce("open", F.lit(False))))
    most = rest.where("open").dropDuplicates(["id"]).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("a"), F.max("id").alias("z")).where(F.col("n") > PART_ROWS)
    edges = _edges(rest, most)
    refused: DataFrame | None = None
    for low, high in zip([None, *edges], [*edges, None]):
        inside = F.col("open")
        if low is not None:
            inside = inside & (F.col("id") >= low)
        if high is not None:
            inside = inside & (F.col("id") < high)
        state = rest.withColumn("asks", inside)
        if low is None:
            state = state.withColumn("holds", ~F.col("open"))
        else:
            state = state.join(refused.select(F.col("new_id").alias("id")), "id", "left_anti").withColumn("holds", ~F.col("open") | (F.col("id") < low))
        before = _nearest(state)
        mine = rest.where(inside).groupBy("id").agg(F.first("k").alias("k"), F.first("f").alias("f"), F.first("form").alias("form"), F.collect_list("h").alias("hs"))
        mine = mine.join(before.select(F.col("new_id").alias("id"), F.col("old_id").alias("before")), "id", "left").withColumn("before", F.coalesce("before", F.lit(-1)))
        part = cut(mine.repartition("k").sortWithinPartitions("k", "id").mapInPandas(_in_order, "new_id bigint, old_id bigint"))
        refused = part if refused is None else cut(refused.unionByName(part))
    return done.unionByName(refused)


def _edges(rest: DataFrame, most: DataFrame) -> list[int]:
    """Ids that part the open rows so that no proposal has many more than PART_ROWS between two of them."""
    largest = most.agg(F.max("n")).first()[0]
    if largest is None:
        return []
    parts = -(-largest // PART_ROWS)
    hot = rest.where("open").join(most.select("k"), "k", "left_semi").dropDuplicates(["id"])
    cuts = hot.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)], 100 * parts)).first()[0]
    return sorted({*cuts})


class Shards:
    """Accepted rows as (h, id) postings beside (id, k, f, form) rows, in one folder or several."""

    def __init__(self, spark: SparkSession, folders: list[str]) -> None:
        self.postings = spark.read.schema(POSTINGS).parquet(*[f"{f}/postings" for f in folders])
        self.rows = spark.read.schema(ROWS).parquet(*[f"{f}/rows" for f in folders])


def repeats(df: DataFrame, id_col: str, key: str, message: str, fp: str, *, history: Shards | None = None, weights: bytes | None = None, keep: str | None = None, learned: Callable[[bytes], None] | None = None) -> DataFrame:
    """(old_id, new_id): every row that repeats an accepted row, with the smallest accepted row it repeats.

    Rows are taken by id; history holds what was accepted before, whose ids are smaller. Of it only the
    postings under keys the new rows ask under, and the rows these name, go further. Rows with equal proposal,
    fingerprint and tokens form one class: only its first row is searched, the others repeat it or what it
    repeats. A row with a null proposal, and the fingerprint or message that is null or without tokens, agree
    with nothing. keep names a folder that receives the accepted rows and their postings; learned is told the
    token weights made from these rows where none are given."""
    with scratch(df.sparkSession) as work:
        base = stored(normalised(df, id_col, key, message, fp), f"{work}/base")
        first = stored(base.groupBy("k", "f", "form").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), f"{work}/first")
        if weights is None:
            weights = token_weights(first)
            if learned is not None:
                learned(weights)
        posted = stored(postings(first, weights), f"{work}/posted")
        found = cut(decide(_met(posted, first.drop("n"), history, weights, work)))
        if keep is not None:
            gone = found.select(F.col("new_id").alias("id"))
            first.join(gone, "id", "left_anti").select("id", "k", "f", "form").write.parquet(f"{keep}/rows")
            posted.join(gone, "id", "left_anti").write.parquet(f"{keep}/postings")
        mark = F.unhex(F.md5(F.concat_ws("|", F.hex("k"), F.coalesce(F.hex("f"), F.lit("-")), F.coalesce(F.col("form"), F.lit("-")))))
        classes = first.where(F.col("n") > 1).select(F.col("id").alias("rep"), "n", mark.alias("c"))
        classes = classes.join(found.select(F.col("new_id").alias("rep"), F.col("old_id").alias("old")), "rep", "left").select("c", "n", F.coalesce("old", "rep").alias("old_id"))
        members = base.select(F.col("id").alias("new_id"), mark.alias("c"))
        copies = dictionary_join(members, classes, ["c"], spread=F.col("new_id"), total=base.count(), whole=False)
        copies = copies.where(F.col("old_id").isNotNull() & (F.col("old_id") != F.col("new_id"))).select("old_id", "new_id")
        return cut(found.select("old_id", "new_id").unionByName(copies).distinct())


def _met(posted: DataFrame, rows: DataFrame, history: Shards | None, weights: bytes, work: str) -> DataFrame:
    """(h, ROWS, asks, n) of every posting that shares its key with another one, written once."""
    met, known = posted.withColumn("asks", F.lit(True)), rows.select("id", "k", "f", "form")
    if history is not None:
        asked = stored(history.postings.join(posted.select("h").distinct(), "h", "left_semi"), f"{work}/asked")
        met = met.unionByName(asked.withColumn("asks", F.lit(False)))
        known = known.unionByName(history.rows.join(asked.select("id").distinct(), "id", "left_semi"))
    shared = met.groupBy("h").agg(F.count(F.lit(1)).alias("n")).withColumn("held", F.col("n"))
    total = posted.count() + (0 if history is None else asked.count())
    met = dictionary_join(met, shared, ["h"], spread=F.col("id"), total=total, keep=F.col("n") > 1, whole=False).where(F.col("held") > 1).withColumnRenamed("held", "n")
    met = stored(met.join(known, "id").select("h", "id", "k", "f", "form", "asks", "n"), f"{work}/met")
    hot = met.where(F.col("n") > PAIR_ROWS)
    if hot.isEmpty():
        return met
    pairs = stored(paired(hot.drop("n"), weights), f"{work}/pairs")
    shared = pairs.groupBy("h").agg(F.count(F.lit(1)).alias("n")).withColumn("held", F.col("n"))
    pairs = dictionary_join(pairs, shared, ["h"], spread=F.col("id"), total=pairs.count(), keep=F.col("n") > 1, whole=False).where(F.col("held") > 1).withColumnRenamed("held", "n")
    return met.where(F.col("n") <= PAIR_ROWS).unionByName(stored(pairs, f"{work}/paired"))


class Index:
    """The accepted rows of all history as shards in a folder: one per batch, compacted every so often."""

    def __init__(self, spark: SparkSession, folder: str, *, compact_every: int = 8) -> None:
        self.spark, self.folder, self.compact_every = spark, folder.rstrip("/"), compact_every
        self.shards: list[str] = []
        self.weights: bytes | None = None
        self._made = 0

    def history(self) -> Shards | None:
        return Shards(self.spark, self.shards) if self.shards else None

    def add(self, batch: DataFrame, id_col: str, key: str, message: str, fp: str) -> DataFrame:
        """The repeats of one batch; what it adds to the accepted rows becomes a new shard. The token order is
        fixed by the first batch: it decides how many rows meet, never which are found."""
        if len(self.shards) >= self.compact_every:
            self.compact()
        shard = self._next()
        found = repeats(batch, id_col, key, message, fp, history=self.history(), weights=self.weights, keep=shard, learned=self._learn)
        self.shards.append(shard)
        return found

    def _learn(self, weights: bytes) -> None:
        self.weights = weights

    def _next(self) -> str:
        self._made += 1
        return f"{self.folder}/shard-{self._made:06d}"

    def compact(self) -> None:
        """Merges all shards into one, postings in order of their key, rows in order of their id."""
        merged, all_ = self._next(), self.history()
        all_.postings.repartitionByRange("h").sortWithinPartitions("h", "id").write.parquet(f"{merged}/postings")
        all_.rows.repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{merged}/rows")
        for s in self.shards:
            remove(self.spark, s)
        self.shards = [merged]


def arrivals(df: DataFrame, id_col: str, parts: int) -> list[DataFrame]:
    """df in at most `parts` consecutive ranges of ids with about equally many rows; rows without id in none."""
    cuts = df.agg(F.percentile_approx(id_col, [i / parts for i in range(1, parts)], 10_000)).first()[0] if parts > 1 else []
    edges = sorted({*(cuts or [])})
    out = []
    for low, high in zip([None, *edges], [*edges, None]):
        inside = F.col(id_col).isNotNull()
        inside = inside if low is None else inside & (F.col(id_col) > low)
        out.append(df.where(inside if high is None else inside & (F.col(id_col) <= high)))
    return out


def repeats_by_arrival(df: DataFrame, id_col: str, key: str, message: str, fp: str, *, parts: int, compact_every: int) -> DataFrame:
    """repeats() of a whole table whose rows arrive in consecutive parts, each met with the shards of those before."""
    out: DataFrame | None = None
    with scratch(df.sparkSession) as folder:
        index = Index(df.sparkSession, folder, compact_every=compact_every)
        for part in arrivals(df, id_col, parts):
            found = index.add(part, id_col, key, message, fp)
            out = found if out is None else out.unionByName(found)
    return out
