"""Exact nearest binary codes by incremental multi-index hashing.

Codes are cut into m segments of about log2(n) bits. In round s a query looks up, for each
segment, all values that differ from its own in exactly s bits, and verifies the codes there.
After round s every code within m (s + 1) - 1 bits has been seen: a farther-off segment in each
place would add up to more. A query is done once its k-th verified distance is within that;
the others go on to the next radius, up to whole segments, so the result is exact.

The index is dealt by segment and leading bits of the segment's value, large parts are split,
and a query goes only to parts whose leading bits it can reach; it enumerates values there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from brandsieve.llm.tables import cut

BITS = 64
NEAREST = 10
EVERY = 50
#: Codes of an index part; it is split beyond twice as many.
PART = 1 << 16
_KEYS = ["segment", "part", "block"]


@lru_cache(maxsize=256)
def _masks(width: int, ones: int) -> np.ndarray:
    return np.array([sum(1 << b for b in bits) for bits in combinations(range(width), ones)], np.uint64)


def segments(codes: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment for so many codes."""
    m = max(1, math.ceil(bits / max(1.0, math.log2(max(2, codes)))))
    m = max(m, math.ceil(bits / 20))  # keeps the enumeration of one segment small
    edges = [bits * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def sign_code(vector: Column) -> Column:
    """A 64-bit code from the signs of an array of numbers: bit i is set if the sum of the
    components i, i + 64, ... is over zero. Null if there is no component or one that is null
    or not finite."""
    usable = (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    folded = F.transform(
        F.sequence(F.lit(0), F.lit(BITS - 1)),
        lambda i: F.aggregate(F.filter(vector, lambda x, j: (j % BITS) == i), F.lit(0.0), lambda total, x: total + x),
    )
    sums = F.when(F.size(vector) > BITS, folded).otherwise(vector.cast("array<double>"))
    signs = F.transform(
        sums, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    )
    wide = F.aggregate(signs, F.lit(0).cast("long"), lambda code, bit: code.bitwiseOR(bit))
    return F.when(usable, wide)


def _closest(rows: tuple[np.ndarray, ...], queries: np.ndarray, shift: int, width: int, lead: int, part: int, ones: int, k: int):
    """Codes of a part whose segment differs from the query's in exactly ``ones`` bits: the k
    nearest, ties to the smaller representative."""
    values, codes, reps = rows
    out = []
    for query in queries.tolist():
        value = np.uint64((query % (1 << 64)) >> shift & ((1 << width) - 1))
        probes = _masks(width, ones) ^ value
        probes = probes[probes >> np.uint64(width - lead) == np.uint64(part)] if lead else probes
        start, stop = np.searchsorted(values, probes), np.searchsorted(values, probes, side="right")
        some = np.flatnonzero(stop > start)
        if not len(some):
            continue
        sizes = stop[some] - start[some]
        at = np.repeat(start[some] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
        distance = np.bitwise_count(codes[at] ^ np.uint64(query % (1 << 64))).astype(np.int64)
        order = np.lexsort((reps[at], distance))[:k]
        out.append(pd.DataFrame({"query": query, "code": codes[at[order]].view(np.int64), "distance": distance[order]}))
    return out


def _probed(batches: Iterator[pd.DataFrame], cuts: list[tuple[int, int]], lead: int, ones: int, k: int):
    """Rows come sorted by part, indexed codes (asks: 0) before queries (asks: 1)."""
    key, held, ready = None, [], None
    for batch in batches:
        if batch.empty:
            continue
        where = batch[[*_KEYS, "asks"]].to_numpy()
        starts = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]).any(axis=1)])
        for start, stop in zip(starts, [*starts[1:], len(batch)]):
            own, rows = tuple(where[start, :-1].tolist()), batch.iloc[start:stop]
            if own != key:
                key, held, ready = own, [], None
            if not where[start, -1]:
                held.append(rows[["code", "rep"]])
                continue
            shift, width = cuts[own[0]]
            if ready is None and held:
                codes = pd.concat(held)
                values = codes["code"].to_numpy().view(np.uint64)
                segment = values >> np.uint64(shift) & np.uint64((1 << width) - 1)
                order = np.argsort(segment, kind="stable")
                ready = segment[order], values[order], codes["rep"].to_numpy()[order]
            if ready is not None:
                yield from _closest(ready, rows["code"].to_numpy(), shift, width, min(lead, width), own[1], ones, k)


def _segment(code: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(code, shift).bitwiseAND(F.lit((1 << width) - 1))


def nearest_codes(table: DataFrame, k: int = NEAREST, every: int = EVERY, bits: int = BITS) -> DataFrame:
    """query_id, rank (from 1), vec_id, distance for every vec_id divisible by ``every``.

    ``table``: vec_id, code (long). Rows with a null id or code take no part; of rows that
    repeat an id with one code one answers. Ties go to the smaller id; with fewer than ``k``
    others, all of them are returned.
    """
    rows = cut(table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("code").cast("long").alias("code")).dropna())
    of_code = Window.partitionBy("code").orderBy("vec_id")
    members = cut(
        rows.distinct().withColumn("place", F.row_number().over(of_code)).where(F.col("place") <= k + 1)
    )
    codes = cut(members.where("place = 1").select("code", F.col("vec_id").alias("rep")))
    count, total = codes.count(), members.count()
    cuts = segments(count, bits)
    lead = min(max(0, math.ceil(math.log2(max(1, count) / PART))), min(w for _, w in cuts))
    asked = rows.where(F.col("vec_id") % every == 0).distinct()

    def dealt(df: DataFrame, reach: int) -> DataFrame:
        """One row for each segment and each run of leading bits within reach."""
        leads = [m for n in range(min(reach, lead) + 1) for m in _masks(lead, n).tolist()]
        places = [
            F.struct(
                F.lit(i).alias("segment"),
                _segment(F.col("code"), shift + width - lead, lead).bitwiseXOR(F.lit(m)).cast("int").alias("part"),
            )
            for i, (shift, width) in enumerate(cuts)
            for m in leads
        ]
        return df.withColumn("place", F.explode(F.array(*places))).select("place.*", *df.columns)

    index = cut(dealt(codes, 0))
    large = cut(
        index.groupBy("segment", "part").agg(F.ceil(F.count("*") / PART).cast("int").alias("blocks")).where("blocks > 2")
    )
    blocks = F.coalesce("blocks", F.lit(1))
    index = cut(
        index.join(large, ["segment", "part"], "left").select(
            "segment", "part", F.pmod(F.xxhash64("code"), blocks).cast("int").alias("block"), F.lit(0).alias("asks"), "code", "rep"
        )
    )
    best = Window.partitionBy("query").orderBy("distance", "vec_id")
    state, done = None, []
    todo = cut(asked.select("code").distinct())
    ones = 0
    while todo.limit(1).count():
        probes = (
            dealt(todo, ones)
            .join(large, ["segment", "part"], "left")
            .select(
                "segment", "part", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"),
                F.lit(1).alias("asks"), "code", F.lit(0).cast("long").alias("rep"),
            )
        )
        found = (
            index.unionByName(probes)
            .repartition(*_KEYS)
            .sortWithinPartitions(*_KEYS, "asks")
            .mapInPandas(
                lambda it, ones=ones: _probed(it, cuts, lead, ones, k + 1), "query long, code long, distance long"
            )
            .distinct()
            .join(members.select("code", "vec_id"), "code")
            .select("query", "vec_id", "distance")
        )
        if state is not None:
            found = found.unionByName(state.join(todo.withColumnRenamed("code", "query"), "query", "left_semi")).distinct()
        state = cut(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k + 1).drop("rank"))
        covered = len(cuts) * (ones + 1) - 1
        last = ones >= max(w for _, w in cuts)
        complete = (
            state.groupBy("query")
            .agg(F.count("*").alias("n"), F.max("distance").alias("worst"))
            .where(F.lit(last) | ((F.col("n") >= min(k + 1, total)) & (F.col("worst") <= covered)))
            .select("query")
        )
        complete = cut(complete)
        done.append(state.join(complete, "query", "left_semi"))
        todo = cut(todo.join(complete.withColumnRenamed("query", "code"), "code", "left_anti"))
        ones += 1
        if last:
            break
    schema = "query long, vec_id long, distance long"
    answers = done[0] if done else table.sparkSession.createDataFrame([], schema)
    for more in done[1:]:
        answers = answers.unionByName(more)
    rank = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return (
        asked.select(F.col("vec_id").alias("query_id"), F.col("code").alias("query"))
        .join(answers, "query")
        .where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(rank))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "distance")
    )


ORACLE = f"""
WITH codes AS (
  SELECT vec_id, list_transform(range({BITS}), lambda i: coalesce(embedding[i + 1], 0) > 0) AS bits
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) BETWEEN 1 AND {BITS}),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         len(list_filter(list_zip(q.bits, c.bits), lambda p: p[1] <> p[2])) AS distance
  FROM codes q JOIN codes c ON q.vec_id % {EVERY} = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, CAST(distance AS BIGINT) AS distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs)
WHERE rank <= {NEAREST}
"""
