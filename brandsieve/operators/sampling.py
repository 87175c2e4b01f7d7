"""Reproducible exact-size samples without sorting or moving the rows."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brandsieve.functions.text import stable_hash

_DIGITS = 4  # hex digits per level: 65,536 counters


def _any(tests: list[Column]) -> Column:
    return reduce(or_, tests, F.lit(False))


def _edges(hashed: DataFrame, width: int, wanted: dict) -> dict:
    """Per stratum the prefix that holds its ``wanted``-th smallest hash, and how many hashes precede it.

    The window runs over at most 65,536 counters per stratum, never over rows; one row per
    stratum reaches the driver.
    """
    counted = hashed.groupBy("_stratum", F.substring("_hash", 1, width).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    running = counted.withColumn("upto", F.sum("n").over(Window.partitionBy("_stratum").orderBy("prefix")))
    reached = _any([(F.col("_stratum") == s) & (F.col("upto") >= k) for s, k in wanted.items()])
    edges = (
        running.where(reached)
        .groupBy("_stratum")
        .agg(F.min(F.struct("prefix", (F.col("upto") - F.col("n")).alias("before"))).alias("edge"))
        .collect()
    )
    return {r["_stratum"]: r["edge"] for r in edges}


def in_samples(pool: DataFrame, id_col: str, stratum_col: str, wanted: dict, *, seed: int = 42) -> Column:
    """Predicate: is a row among the ``wanted[stratum]`` rows of its stratum with the smallest seeded hashes?

    Meant for a handful of strata. Two counting passes over the ids narrow each k-th hash
    down to an eight-digit prefix; the few ids under it (about one in four billion) are
    ranked, and the k-th (hash, id) is the cut. The result is a filter against those
    constants, so the sampled rows are never shuffled, sorted or limited into one task,
    however large k is. A k above the size of a stratum keeps all of it.
    """
    hashed = pool.select(id_col, F.col(stratum_col).alias("_stratum"), stable_hash(F.col(id_col), seed).alias("_hash"))
    left = {s: k for s, k in wanted.items() if k > 0}
    whole = []
    for width in (_DIGITS, 2 * _DIGITS):
        edges = _edges(hashed, width, left)
        whole += [s for s in left if s not in edges]
        left = {s: k - edges[s]["before"] for s, k in left.items() if s in edges}
        inside = [(F.col("_stratum") == s) & (F.substring("_hash", 1, width) == edges[s]["prefix"]) for s in left]
        hashed = hashed.where(_any(inside))
    ranked = hashed.withColumn("_rank", F.row_number().over(Window.partitionBy("_stratum").orderBy("_hash", id_col)))
    cuts = ranked.where(_any([(F.col("_stratum") == s) & (F.col("_rank") == k) for s, k in left.items()])).collect()
    mine, ident, stratum = stable_hash(F.col(id_col), seed), F.col(id_col), F.col(stratum_col)
    chosen = [
        (stratum == c["_stratum"]) & ((mine < c["_hash"]) | ((mine == c["_hash"]) & (ident <= c[id_col]))) for c in cuts
    ]
    return _any(chosen + [stratum == s for s in whole])


def take_sample(df: DataFrame, id_col: str, k: int, *, seed: int = 42) -> DataFrame:
    """The k rows with the smallest seeded hashes: a random sample of exact size, without replacement."""
    rows = df.withColumn("_one", F.lit(1))
    return rows.where(in_samples(rows, id_col, "_one", {1: k}, seed=seed)).drop("_one")


def shuffled(df: DataFrame, id_col: str, *, seed: int = 42) -> DataFrame:
    """Rows in a reproducible pseudo-random order (a range-partitioned sort)."""
    return df.orderBy(stable_hash(F.col(id_col), seed), id_col)


def head(df: DataFrame, id_col: str, n: int, *, last: bool = False) -> DataFrame:
    """The n rows with the smallest (or largest) ids."""
    return df.orderBy(F.col(id_col).desc() if last else F.col(id_col)).limit(n)
