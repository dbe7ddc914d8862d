"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefold.session import cut

#: A key is hot if it holds at least one in HOT_SHARE of all rows, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000
#: A hot key longer than this is left to the shuffled join, so the broadcast is at most HOT_SHARE * this.
HOT_BYTES = 4096
#: A dictionary of at most this many bytes and entries is broadcast as a whole.
SMALL_BYTES, SMALL_ROWS = 8 << 20, 100_000


def key_bytes(keys: Sequence[str]) -> Column:
    total: Column = F.lit(0)
    for k in keys:
        total = total + F.coalesce(F.octet_length(F.col(k).cast("string")), F.lit(0))
    return total


def dictionary_join(
    rows: DataFrame,
    dictionary: DataFrame,
    keys: Sequence[str],
    *,
    spread: Column,
    total: int,
    n: str = "n",
    keep: Column | None = None,
    whole: bool = True,
) -> DataFrame:
    """Left join of rows to a dictionary with unique keys, in one pass over the rows.

    dictionary[n] is the number of rows of its key and total the number of all rows. The at most HOT_SHARE
    keys that hold 1/HOT_SHARE of the rows are broadcast (bounded by HOT_SHARE * HOT_BYTES), and their rows
    are spread over the shuffle by the column spread; all other keys meet in a shuffled join, where no key
    is hot any more. A dictionary whose measured size is small is broadcast as a whole, without any shuffle,
    unless whole says that it grows with the data and is better left in the shuffle from the start;
    where all entries are hot, or none is, the other join is left out. keep restricts the shuffled part of
    the dictionary to the entries of interest; other rows keep nulls. Rows with a null key match nothing. The
    dictionary's n is not returned.

    The entries that are hot or kept are written into the shared folder first, so the dictionary is made
    once although both joins read it.
    """
    attrs = [c for c in dictionary.columns if c not in keys and c != n]
    is_hot = (F.col(n) * HOT_SHARE >= F.lit(total)) & (key_bytes(keys) <= HOT_BYTES)
    entries = cut(dictionary if keep is None else dictionary.where(is_hot | keep))
    width = key_bytes(keys)
    for a in attrs:
        simple = entries.schema[a].dataType.typeName() not in ("struct", "array", "map", "binary")
        width = width + F.coalesce(F.octet_length(F.col(a).cast("string") if simple else F.to_json(F.struct(a))), F.lit(0))
    size = entries.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes"), F.count_if(is_hot).alias("hot")).first()
    small = whole and size["rows"] <= SMALL_ROWS and size["bytes"] <= SMALL_BYTES
    mine = lambda side, c: f"_of_{side}_{c}"
    pick = lambda df, side: df.select(*[F.col(k).alias(mine(side, f"key{i}")) for i, k in enumerate(keys)], *[F.col(a).alias(mine(side, a)) for a in attrs], F.lit(True).alias(mine(side, "there")))
    hot, rest = (entries, entries.limit(0)) if small else (entries.where(is_hot), entries.where(~is_hot))
    with_hot, with_rest = (size["rows"] > 0, False) if small else (size["hot"] > 0, size["rows"] > size["hot"])
    out = rows
    if with_hot:
        out = out.join(F.broadcast(pick(hot, "hot")), [F.col(k) == F.col(mine("hot", f"key{i}")) for i, k in enumerate(keys)], "left")
    if with_rest:
        aside = F.col(mine("hot", "there")).isNotNull() if with_hot else F.lit(False)
        for k in keys:
            aside = aside | F.col(k).isNull()
        # Rows that need no shuffled partner are spread by a salt no entry has, under null keys.
        out = out.withColumn(mine("row", "salt"), F.when(aside, 1 + F.pmod(F.xxhash64(spread), F.lit(1 << 20)).cast("int")).otherwise(F.lit(0)))
        out = out.withColumns({mine("row", f"key{i}"): F.when(F.col(mine("row", "salt")) == 0, F.col(k)) for i, k in enumerate(keys)})
        cold = pick(rest, "cold").withColumn(mine("cold", "salt"), F.lit(0).cast("int"))
        meet = [F.col(mine("row", c)) == F.col(mine("cold", c)) for c in ("salt", *[f"key{i}" for i in range(len(keys))])]
        out = out.join(cold, meet, "left")

    def value(a: str) -> Column:
        if with_hot and with_rest:
            return F.when(F.col(mine("hot", "there")).isNotNull(), F.col(mine("hot", a))).otherwise(F.col(mine("cold", a)))
        if with_hot or with_rest:
            return F.col(mine("hot" if with_hot else "cold", a))
        return F.lit(None).cast(entries.schema[a].dataType)

    return out.select(*[F.col(c) for c in rows.columns], *[value(a).alias(a) for a in attrs])


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly before costly Python: small in bytes, they would else be coalesced into one task."""
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n)
