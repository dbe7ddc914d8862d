"""Duplicates hidden by formatting: bottom-up hashing of nested records, then a structural comparison.

Leaves are normalised, the digests of an object's members sorted, those of an array kept in order; the root
digest groups the records and the canonical form confirms each group.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from decimal import Decimal
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefold.plans.skew import dictionary_join
from orefold.session import cut, scratch, stored

DIGEST_BYTES = 16
_STRAY_POINT = regex.compile(r"(?<!\d)\.|\.(?!\d)")
_ASCII_DRESS = re.compile(r"[^0-9A-Za-z.]+")
_DRESS = regex.compile(r"(?V1)[\p{P}\p{S}\p{Z}\p{C}--[.]]+")
_PLAIN = re.compile(r"[a-z0-9]*\Z")


def _normal(text: str) -> str:
    if "." in text:
        text = _STRAY_POINT.sub("", text)
    return _ASCII_DRESS.sub("", text).lower() if text.isascii() else _DRESS.sub("", text).casefold()


@lru_cache(maxsize=1 << 16)
def _normal_short(text: str) -> str:
    return _normal(text)


def normal(text: str) -> str:
    """The text without case, blanks, punctuation, symbols, control and format characters; a point between two
    digits stays."""
    if _PLAIN.match(text):
        return text
    return _normal_short(text) if len(text) <= 128 else _normal(text)


class Node(tuple):
    """(digest, canonical form) of a parsed value."""

    __slots__ = ()


def _sized(part: bytes) -> bytes:
    return len(part).to_bytes(4, "big") + part


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST_BYTES).digest()


@lru_cache(maxsize=1 << 16)
def _number(written: str) -> Node:
    """A number by its value, sign included: digits without outer zeros, and the exponent behind them."""
    d = Decimal(written)
    text = "0"
    if d:
        sign, digits, exponent = d.as_tuple()
        whole = "".join(map(str, digits)).lstrip("0")
        cut_ = whole.rstrip("0")
        text = f"{'-' if sign else ''}{cut_}e{exponent + len(whole) - len(cut_)}"
    return Node((_digest(b"n" + text.encode()), text))


def _constant(name: str) -> Node:
    """null, true, false, and NaN, Infinity or -Infinity, which Python reads although JSON has no such number."""
    return Node((_digest(b"c" + name.encode()), name))


_WORDS = {None: _constant("null"), True: _constant("true"), False: _constant("false")}


def _string(text: str) -> Node:
    plain = normal(text)
    return Node((_digest(b"s" + plain.encode("utf-8", "surrogatepass")), json.dumps(plain)))


_short_string = lru_cache(maxsize=1 << 16)(_string)


@lru_cache(maxsize=1 << 14)
def _short_key(key: str) -> tuple[bytes, str]:
    """What stands before a member's digest, and before its form."""
    plain = normal(key)
    return b"m" + _sized(plain.encode("utf-8", "surrogatepass")), json.dumps(plain) + ":"


def _key(key: str) -> tuple[bytes, str]:
    return _short_key(key) if len(key) <= 128 else _short_key.__wrapped__(key)


def merkle(value: object) -> Node:
    """The node of a parsed value, whose objects are nodes already."""
    kind = type(value)
    if kind is Node:
        return value
    if kind is str:
        return _short_string(value) if len(value) <= 128 else _string(value)
    if kind is list:
        items = [merkle(v) for v in value]
        return Node((_digest(b"a" + b"".join([d for d, _ in items])), "[" + ",".join([c for _, c in items]) + "]"))
    return _WORDS[value]


def _object(pairs: list[tuple[str, object]]) -> Node:
    """An object by its members in the order of their digests; repeated keys stay."""
    members = []
    for k, v in pairs:
        before, name = _key(k)
        d, c = merkle(v)
        members.append((_digest(before + d), name + c))
    members.sort()
    return Node((_digest(b"o" + b"".join([d for d, _ in members])), "{" + ",".join([c for _, c in members]) + "}"))


_DECODER = json.JSONDecoder(object_pairs_hook=_object, parse_float=_number, parse_int=_number, parse_constant=_constant)


def fingerprint(text: str | None) -> tuple[bytes | None, str | None]:
    """Root digest and canonical form of a record. Null has none; text that is not JSON is one string leaf, and
    if nothing of it counts (empty text, blanks) it has none either.

    Objects are hashed as the decoder closes them, so children always come before their parent."""
    if text is None:
        return None, None
    try:
        return merkle(_DECODER.decode(text))
    except (ValueError, ArithmeticError, RecursionError):
        return merkle(text) if normal(text) else (None, None)


def rooted(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, root, form) of every record that has a digest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *fingerprint(t)) for k, t in zip(pdf["k"], pdf["t"])]
            rows = [r for r in rows if r[1] is not None]
            if rows:
                yield pd.DataFrame(rows, columns=["k", "root", "form"])

    kind = df.schema[key].dataType.simpleString()
    records = df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return records.mapInPandas(run, f"k {kind}, root binary, form string").withColumnRenamed("k", key)


def copies(df: DataFrame, key: str, text: str) -> DataFrame:
    """(keep_id, copy_id): one row for each member of a group of copies but its smallest id.

    Null texts belong to no group. Equal ids in several rows count as one record. Records are copies if
    their keys and values agree but for the order of members at every depth and for case, blanks and
    punctuation in keys and strings; numbers agree by value.

    Digests are made once and written with the canonical forms. Groups are counted by the digest alone; only
    the forms of groups with two and more rows are compared, and a digest that stands for several forms has
    its group split by form."""
    with scratch(df.sparkSession) as work:
        return cut(confirmed(stored(rooted(df, key, text), f"{work}/records"), key, work))


def confirmed(records: DataFrame, key: str, work: str) -> DataFrame:
    """(keep_id, copy_id) of (key, root, form) rows that agree in root and form; work receives what is read twice."""
    sizes = records.groupBy("root").agg(F.min(key).alias("keep_id"), F.count(F.lit(1)).alias("n"))
    met = dictionary_join(records, sizes, ["root"], spread=F.col(key), total=records.count(), keep=F.col("n") > 1)
    met = stored(met.where(F.col("keep_id").isNotNull()), f"{work}/met")
    pairs = met.select("root", "keep_id", F.col(key).alias("copy_id"))
    clash = stored(met.groupBy("root").agg(F.min("form").alias("a"), F.max("form").alias("z")).where("a <> z").select("root"), f"{work}/clash")
    if not clash.isEmpty():
        split = met.join(clash, "root", "left_semi")
        heads = split.groupBy("root", "form").agg(F.min(key).alias("keep_id"))
        split = split.drop("keep_id").join(heads, ["root", "form"]).select("root", "keep_id", F.col(key).alias("copy_id"))
        pairs = pairs.join(clash, "root", "left_anti").unionByName(split)
    return pairs.where(F.col("keep_id") != F.col("copy_id")).select("keep_id", "copy_id")


def distinct_records(df: DataFrame, key: str, text: str) -> DataFrame:
    """(keep_id, copies): every record once, with the number of rows it stood in.

    Grouping by digest and form confirms the structure in full; the partial aggregate runs before the
    shuffle, so that a record copied very often arrives as one row per task."""
    g = rooted(df, key, text).groupBy("root", "form").agg(F.min(key).alias("keep_id"), F.count(F.lit(1)).alias("n"))
    return g.select("keep_id", F.col("n").alias("copies"))
