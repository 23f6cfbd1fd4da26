"""What the operators of this subpackage share: tables, the shared folder, materialised tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.session import cut, drop_path, fresh_path, open_fs, shared_dir, written  # noqa: F401  for the operators

#: Keys that hold more than one in so many rows are hot; there are never more of them than this.
HOT_KEYS = 1_000
#: Rows of a listing of keys that is broadcast, at most; a longer one is joined by a shuffle.
LISTED_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read with Spark, so any store that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(name: str, columns: list[str]) -> str:
    """``name``, longer by as many underscores as keep it apart from the columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices start[i], start[i] + 1, ... of each i, so many as size[i]."""
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(total)


def join_counted(rows: DataFrame, keyed: DataFrame, key: str, count: str, how: str = "inner", total: int | None = None, alike: bool = False) -> DataFrame:
    """``rows`` with the columns of ``keyed``, a written table of one row per key and ``count``, how many rows have it.

    A key may hold any share of the rows. Those that hold more than one in ``HOT_KEYS`` are at most ``HOT_KEYS``, so
    they are broadcast, whatever the size of the tables, and their rows stay where they are; all others are joined by
    a shuffle, in which no key is hot. Rows whose key is null have no match (``how``: "inner" drops them, "left" not).
    With ``alike`` that join is planned as a shuffle at every size, for large rows whose cost should grow evenly.
    """
    if total is None:
        total = keyed.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    is_hot = F.col(count) * HOT_KEYS > total
    hot, rest = keyed.where(is_hot).drop(count), keyed.where(~is_hot).drop(count)
    others = rows.where(F.col(key).isNotNull()).join(F.broadcast(hot.select(key)), key, "left_anti")
    out = rows.join(F.broadcast(hot), key).unionByName(others.join(rest.hint("shuffle_hash") if alike else rest, key, how))
    if how == "left":
        out = out.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)
    return out


def join_listed(rows: DataFrame, listed: DataFrame, keys: list[str], count: str, total: int | None = None) -> DataFrame:
    """``rows`` with the other columns of ``listed``, null where it has no such keys; ``count`` says how many of the
    ``total`` rows (by default, of those that are listed) have them. Few keys are expected to be listed; their number is checked before they are broadcast."""
    listed = cut(listed)
    if listed.count() <= LISTED_ROWS:
        return rows.join(F.broadcast(listed.drop(count)), keys, "left")
    as_key = F.struct(*keys)
    met = join_counted(rows.withColumn("_key", as_key), listed.withColumn("_key", as_key).drop(*keys), "_key", count, "left", total)
    return met.drop("_key")
