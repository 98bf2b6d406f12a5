"""Semi and anti joins of a wide table with few keys, without shuffling the rows that have no chance.

A bitmap of the keys' hashes, 16 bits a key and at most ``MAX_BITS`` (a fixed size), is broadcast as a table of 64-bit
words. Rows whose bit isn't set stay where they are; only the others meet the keys in an ordinary join, so results are
exact at any number of keys; beyond ``MAX_BITS / 16`` keys the bitmap merely lets more rows through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.shared import unused

MAX_BITS = 1 << 25


def marked(df: DataFrame, column: str, keys: DataFrame, key: str) -> tuple[DataFrame, str]:
    """df with one more column, and its name: whether the row's bit is set."""
    n = keys.count()
    bits = min(MAX_BITS, 1 << max(12, (16 * n).bit_length()))
    place = lambda c: F.xxhash64(F.col(c), F.lit(3)).bitwiseAND(F.lit(bits - 1))
    p, w, b, hit = unused(df, "__p", "__w", "__bits", "__hit")
    words = keys.select(place(key).alias(p)).groupBy(F.shiftright(p, 6).alias(w))
    words = words.agg(F.bit_or(F.expr(f"shiftleft(1L, cast(`{p}` & 63 as int))")).alias(b))
    df = df.withColumn(p, place(column))
    df = df.join(F.broadcast(words), F.shiftright(p, 6) == F.col(w), "left")
    return df.withColumn(hit, F.coalesce(F.expr(f"shiftright(`{b}`, cast(`{p}` & 63 as int)) & 1L"), F.lit(0)) == 1).drop(p, w, b), hit


def _keys(df: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, str]:
    name = unused(df, "__key")[0]
    return keys.select(F.col(key).alias(name)), name


def only(df: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose column is among the keys (distinct, not null)."""
    rows, hit = marked(df, column, keys, key)
    keys, name = _keys(df, keys, key)
    return rows.where(F.col(hit)).drop(hit).join(keys, F.col(column) == F.col(name), "left_semi")


def without(df: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose column is not among the keys; null is not."""
    rows, hit = marked(df, column, keys, key)
    keys, name = _keys(df, keys, key)
    clear = rows.where(F.col(column).isNull() | ~F.col(hit)).drop(hit)
    some = rows.where(F.col(column).isNotNull() & F.col(hit)).drop(hit)
    return clear.unionByName(some.join(keys, F.col(column) == F.col(name), "left_anti"))
