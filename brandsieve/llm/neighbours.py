"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables.

A hash turns the unit vector by three rounds of random signs and a fast Hadamard transform and
takes the nearest signed axis. Every vector lies in one bucket of each table; a query visits
the buckets of its ``probes`` nearest signed axes, as many as find ``RECALL`` of the true neighbours
of ``SAMPLE`` queries, whatever the size of the table and the number of hashes. Buckets with more than ``BLOCK`` vectors are
split and the queries go to every part, so a hot bucket is many tasks. Each part answers with
its nearest vectors by cosine in double precision, and the best of all parts are returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import BinaryType, FloatType

from brandsieve.llm.tables import cut

NEAREST = 5
EVERY = 50
TABLES = 12
#: Queries whose true neighbours are found to set the probes, what share of these the probes
#: have to reach, and the most probes before a hash less is joined.
SAMPLE, RECALL, MOST_PROBES = 128, 0.96, 1024
#: Vectors a bucket should hold; sets how many hashes a table joins.
BUCKET = 1000
BLOCK = 4096
_CHUNK = 64
_KEYS = ["dim", "t", "code", "block"]


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (a power of two long), orthonormal."""
    n, step = rows.shape[1], 1
    while step < n:
        pairs = rows.reshape(len(rows), n // (2 * step), 2, step)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(rows), n)
        step *= 2
    return rows / math.sqrt(n)


def rotated(rows: np.ndarray, table: int, part: int) -> np.ndarray:
    """The rows, padded to a power of two and turned as the table's ``part``-th hash does."""
    n = 1 << max(0, rows.shape[1] - 1).bit_length()
    signs = np.random.default_rng([rows.shape[1], table, part]).choice([-1.0, 1.0], size=(3, n))
    rows = np.pad(rows, ((0, 0), (0, n - rows.shape[1])))
    for row in signs:
        rows = hadamard(rows * row)
    return rows


def codes(rows: np.ndarray, table: int, hashes: int, probes: int) -> np.ndarray:
    """(rows, probes) bucket codes, the nearest first; the vectors' own bucket is the first."""
    best_codes, best = np.zeros((len(rows), 1), np.int64), np.zeros((len(rows), 1))
    for part in range(hashes):
        turned = rotated(rows, table, part)
        axes = np.hstack([turned, -turned])
        some = np.argsort(-axes, axis=1, kind="stable")[:, :probes]
        near = np.take_along_axis(axes, some, 1)
        best = (best[:, :, None] + near[:, None, :]).reshape(len(rows), -1)
        best_codes = (best_codes[:, :, None] * axes.shape[1] + some[:, None, :]).reshape(len(rows), -1)
        order = np.argsort(-best, axis=1, kind="stable")[:, :probes]
        best, best_codes = np.take_along_axis(best, order, 1), np.take_along_axis(best_codes, order, 1)
    return best_codes


def _hashed(batches: Iterator[pd.DataFrame], kind: str, tables: int, hashes: int, probes: int):
    for batch in batches:
        for dim, rows in batch.groupby("dim"):
            vectors = np.frombuffer(b"".join(rows["vector"]), kind).reshape(-1, dim).astype("f8")
            # scaled first: squares of tiny or huge components must not vanish or overflow
            vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
            vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
            for table in range(tables):
                found = codes(vectors, table, hashes, probes)
                yield pd.DataFrame(
                    {
                        "dim": np.int32(dim),
                        "t": np.int32(table),
                        "code": found.ravel(),
                        "vec_id": np.repeat(rows["vec_id"].to_numpy(), found.shape[1]),
                        "vector": np.repeat(rows["vector"].to_numpy(object), found.shape[1]),
                    }
                )


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows in double precision; the same for a pair wherever it meets."""
    a = a / np.abs(a).max(axis=1, keepdims=True)
    b = b / np.abs(b).max(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


def _nearest(queries: pd.DataFrame, ids: np.ndarray, rows: np.ndarray, kind: str, k: int):
    """The k nearest of the rows to each query, ties to the smaller id."""
    asked = queries["vec_id"].to_numpy()
    vectors = np.frombuffer(b"".join(queries["vector"]), kind).reshape(len(asked), -1).astype("f8")
    unit = rows / np.abs(rows).max(axis=1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for at in range(0, len(asked), _CHUNK):
        q, own = vectors[at : at + _CHUNK], asked[at : at + _CHUNK]
        scaled = q / np.abs(q).max(axis=1, keepdims=True)
        near = (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)) @ unit.T
        near[own[:, None] == ids[None, :]] = -np.inf
        least = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(q), -2.0)
        i, j = np.nonzero((near >= least[:, None] - 1e-9) & (near > -np.inf))
        score = cosines(q[i], rows[j])
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        first = np.searchsorted(i, i)  # the place where each query's rows begin
        keep = np.arange(len(i)) - first < k
        yield pd.DataFrame({"query_id": own[i[keep]], "vec_id": ids[j[keep]], "score": score[keep]})


def _answer(batches: Iterator[pd.DataFrame], kind: str, k: int) -> Iterator[pd.DataFrame]:
    """Rows come sorted by bucket part, indexed vectors (asks: 0) before queries (asks: 1)."""
    key, ids, vectors = None, [], []
    for batch in batches:
        where = batch[[*_KEYS, "asks"]].to_numpy()
        starts = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]).any(axis=1)]) if len(batch) else []
        for start, stop in zip(starts, [*starts[1:], len(batch)]):
            own, asks = tuple(where[start, :-1]), where[start, -1]
            rows = batch.iloc[start:stop]
            if own != key:
                key, ids, vectors = own, [], []
            if not asks:
                ids.append(rows["vec_id"].to_numpy())
                vectors.append(np.frombuffer(b"".join(rows["vector"]), kind).reshape(len(rows), -1).astype("f8"))
            elif ids:
                ids, vectors = [np.concatenate(ids)], [np.concatenate(vectors)]
                yield from _nearest(rows, ids[0], vectors[0], kind, k)


def _first_probes(pairs: list, vectors: dict[int, np.ndarray], tables: int, hashes: int) -> np.ndarray:
    """For each pair (query, neighbour): the number of probes with which some table finds it."""
    first = np.full(len(pairs), np.iinfo(np.int64).max)
    dims = np.array([len(vectors[a]) for a, _ in pairs])
    for dim in np.unique(dims):
        which = np.flatnonzero(dims == dim)
        asked, found = (np.stack([vectors[pairs[i][side]] for i in which]) for side in (0, 1))
        for table in range(tables):
            codes_asked = codes(asked, table, hashes, MOST_PROBES)
            hit = codes_asked == codes(found, table, hashes, 1)
            first[which] = np.minimum(first[which], np.where(hit.any(axis=1), hit.argmax(axis=1) + 1, first[which]))
    return first


def fitted(pairs: list, vectors: dict[int, np.ndarray], tables: int, hashes: int, at_most: bool) -> tuple[int, int]:
    """(hashes, probes) that find ``RECALL`` of the pairs; fewer hashes, if ``at_most``, where
    more than ``MOST_PROBES`` would be needed. One hash with all its axes finds every pair."""
    if not pairs:
        return hashes, 1
    while True:
        needed = int(np.sort(_first_probes(pairs, vectors, tables, hashes))[math.ceil(RECALL * len(pairs)) - 1])
        if needed <= MOST_PROBES or hashes == 1 or not at_most:
            return hashes, min(needed, MOST_PROBES)
        hashes -= 1


def nearest(
    table: DataFrame,
    k: int = NEAREST,
    every: int = EVERY,
    tables: int = TABLES,
    probes: int | None = None,
    hashes: int | None = None,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for every vec_id divisible by ``every``.

    ``table``: vec_id, embedding (array of numbers). Vectors that are null, empty or zero or
    hold null or non-finite components, and rows without an id, take no part; vectors of
    different lengths never meet. Of repeated rows one answers. Ties go to the smaller id.
    A query whose buckets hold fewer than ``k`` others is compared with all vectors in blocks,
    so it gets fewer rows only if there are no more. ``hashes`` (joined in a table) follows from
    the number of vectors, ``probes`` (buckets that a query visits in a table) from the true
    neighbours of the ``SAMPLE`` queries with the smallest hashes of their ids.
    """
    element = getattr(table.schema["embedding"].dataType, "elementType", None)
    kind, number = ("<f4", "float") if isinstance(element, FloatType) else ("<f8", "double")
    usable = (
        (F.size("embedding") > 0)
        & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    as_numbers = F.col("embedding").cast(f"array<{number}>").alias("embedding")

    def packed(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: np.asarray(v, kind).tobytes())

    rows = cut(
        table.select(F.col("vec_id").cast("long").alias("vec_id"), as_numbers)
        .where(F.col("vec_id").isNotNull() & usable)
        .select("vec_id", F.size("embedding").alias("dim"), F.pandas_udf(packed, BinaryType())("embedding").alias("vector"))
    )
    count, widest = rows.agg(F.count("*"), F.max("dim")).first()
    at_most = hashes is None
    if at_most:
        axes = 2 << max(0, (widest or 1) - 1).bit_length()
        hashes = max(1, round(math.log(max(1, count / BUCKET)) / math.log(axes)))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def answered(parts: DataFrame) -> DataFrame:
        return (
            parts.repartition(*_KEYS)
            .sortWithinPartitions(*_KEYS, "asks")
            .mapInPandas(lambda it: _answer(it, kind, k), "query_id long, vec_id long, score double")
            .groupBy("query_id", "vec_id")
            .agg(F.max("score").alias("score"))
            .withColumn("rank", F.row_number().over(best))
            .where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score")
        )

    last = max(1, -(-count // BLOCK)) - 1
    everywhere = [F.lit(-1).alias("t"), F.lit(0).cast("long").alias("code")]

    def compared(some: DataFrame) -> DataFrame:
        """The queries against all vectors, in blocks."""
        block = F.pmod(F.xxhash64("vec_id"), F.lit(last + 1)).cast("int").alias("block")
        blocks = F.explode(F.sequence(F.lit(0), F.lit(last))).alias("block")
        return answered(
            rows.select("dim", *everywhere, block, F.lit(0).alias("asks"), "vec_id", "vector").unionByName(
                some.select("dim", *everywhere, blocks, F.lit(1).alias("asks"), "vec_id", "vector")
            )
        )

    queries = rows.where(F.col("vec_id") % every == 0)
    if probes is None:
        sample = cut(queries.dropDuplicates(["vec_id"]).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE))
        pairs = [(r["query_id"], r["vec_id"]) for r in compared(sample).collect()]
        ids = table.sparkSession.createDataFrame([(i,) for i in {i for pair in pairs for i in pair}], "vec_id long")
        held = rows.join(F.broadcast(ids), "vec_id").dropDuplicates(["vec_id"]).collect()
        vectors = {r["vec_id"]: np.frombuffer(r["vector"], kind).astype("f8") for r in held}
        vectors = {i: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for i, v in vectors.items()}
        pairs = [(a, b) for a, b in pairs if len(vectors[a]) == len(vectors[b])]
        hashes, probes = fitted(pairs, vectors, tables, hashes, at_most)
    schema = "dim int, t int, code long, vec_id long, vector binary"
    index = rows.mapInPandas(lambda it: _hashed(it, kind, tables, hashes, 1), schema)
    asked = queries.mapInPandas(lambda it: _hashed(it, kind, tables, hashes, probes), schema)
    bucket = ["dim", "t", "code"]
    hot = cut(
        index.groupBy(bucket)
        .agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        .where("blocks > 1")
    )
    blocks = F.coalesce("blocks", F.lit(1))
    parts = (
        index.join(hot, bucket, "left")
        .select(*bucket, F.pmod(F.xxhash64("vec_id"), blocks).cast("int").alias("block"), F.lit(0).alias("asks"), "vec_id", "vector")
        .unionByName(
            asked.join(hot, bucket, "left").select(
                *bucket, F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(1).alias("asks"), "vec_id", "vector"
            )
        )
    )
    found = cut(answered(parts))
    full = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = cut(queries.join(full, "vec_id", "left_anti"))
    if not short.limit(1).count():
        return found
    return found.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(compared(short))
