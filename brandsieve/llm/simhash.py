"""SimHash near-duplicates, found by covering locality-sensitive hashing.

Each of the 64 bits gets a non-zero vector of 4 bits. Table v of 15 keeps the bits whose
vector has an odd product with v. Three differing bits span at most three dimensions, so some
v is orthogonal to all of them and the two fingerprints agree on everything that table v
keeps: every pair within the radius meets in some table.

A table keeps about half of the bits. Buckets over ``BUCKET`` distinct fingerprints are split
by a second covering of the bits that the first leaves free. At most 16 bits are free then, so
no bucket has more than 2**16 fingerprints, whatever the data, and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType

from brandsieve.llm.tables import cut, split_words

RADIUS = 3
SEED = 42
SHINGLE = 3
#: Distinct fingerprints up to which a bucket is compared without a second covering.
BUCKET = 4096
_BLOCK = 1 << 16


def _coverings(bits: list[int]) -> list[int]:
    """For v = 1..15 the mask of those bits whose vector has an odd product with v."""
    vectors = {bit: 1 + i % 15 for i, bit in enumerate(bits)}
    return [
        sum(1 << bit for bit, vector in vectors.items() if (vector & v).bit_count() % 2)
        for v in range(1, 16)
    ]


MASKS = _coverings(list(range(64)))
#: For each mask, the coverings of the bits that it leaves free.
SUB_MASKS = [_coverings([b for b in range(64) if not mask >> b & 1]) for mask in MASKS]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """The XXH64 of all word shingles, block by block; one of all words if there are fewer, none
    without words."""
    words = split_words(text)
    if not words:
        return
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) < shingle:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), _BLOCK):
        spans = zip(starts[at : at + _BLOCK].tolist(), ends[at : at + _BLOCK].tolist())
        yield np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash, unsigned, over the XXH64 of all word shingles; 0 without words."""
    n, ones = 0, np.zeros(64, np.int64)
    for hashes in shingle_hashes(text, shingle):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


@F.pandas_udf(LongType())
def simhash(texts: pd.Series) -> pd.Series:
    """The fingerprint of each text as a signed long; null counts as empty."""
    return pd.Series([_signed(fingerprint(x)) for x in texts], dtype="int64")


def _forest(codes: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the links among the codes: each is compared with those that no
    earlier one has reached."""
    left, a, b = np.arange(len(codes)), [], []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        for x in queue:
            if not len(left):
                break
            near = np.bitwise_count(codes[left] ^ codes[x]) <= radius
            if near.any():
                found = left[near].tolist()
                left = left[~near]
                queue += found
                a += [x] * len(found)
                b += found
    return a, b


def _link(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Links within each bucket; the rows come sorted by bucket and span batches."""
    keys, rest = ["t", "k", "t2", "k2"], None

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        where = rows[keys].to_numpy()
        starts = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]).any(axis=1)])
        codes, ids = rows["fp"].to_numpy().view("u8"), rows["rep"].to_numpy()
        a, b = [], []
        for start, stop in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)]):
            if stop - start > 1:
                x, y = _forest(codes[start:stop], radius)
                a += ids[start:stop][x].tolist()
                b += ids[start:stop][y].tolist()
        return pd.DataFrame({"a": np.array(a, "int64"), "b": np.array(b, "int64")})

    for batch in batches:
        if batch.empty:
            continue
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        open_ = (rows[keys] == rows[keys].iloc[-1]).all(axis=1).to_numpy()
        rest = rows[open_].reset_index(drop=True)
        yield links(rows[~open_].reset_index(drop=True))
    if rest is not None:
        yield links(rest)


def _explode_keys(masks: list[int], table: str, key: str):
    pairs = [
        F.struct(F.lit(v).alias(table), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias(key))
        for v, m in enumerate(masks)
    ]
    return F.explode(F.array(*pairs)).alias("bucket")


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) of representatives whose fingerprints differ in 1 to ``radius`` <= 3 bits,
    as spanning forests of the buckets: same components as all links. ``fps``: fp, rep, with
    distinct fp."""
    if radius > RADIUS:
        raise ValueError(f"the coverings hold for radius {RADIUS} at most")
    rows = fps.select("fp", "rep", _explode_keys(MASKS, "t", "k")).select("fp", "rep", "bucket.*")
    counts = cut(rows.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1"))
    met = rows.join(counts, ["t", "k"])
    small = met.where(F.col("n") <= bucket).select(
        "t", "k", F.lit(-1).alias("t2"), F.lit(0).cast("long").alias("k2"), "fp", "rep"
    )
    parts = [small]
    if counts.where(F.col("n") > bucket).limit(1).count():
        by_table = [
            F.array(
                *(
                    F.struct(F.lit(v).alias("t2"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k2"))
                    for v, m in enumerate(masks)
                )
            )
            for masks in SUB_MASKS
        ]
        parts.append(
            met.where(F.col("n") > bucket)
            .select("t", "k", "fp", "rep", F.explode(F.element_at(F.array(*by_table), F.col("t") + 1)).alias("s"))
            .select("t", "k", "s.t2", "s.k2", "fp", "rep")
        )
    buckets = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    keys = ["t", "k", "t2", "k2"]
    return (
        buckets.repartition(*keys)
        .sortWithinPartitions(*keys, "fp")
        .mapInPandas(lambda it: _link(it, radius), "a long, b long")
        .distinct()
    )


def _settled(edges: DataFrame) -> bool:
    """Whether the links (a, b), a > b, are stars: a node with a link to a smaller one has no other."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up > 0 AND up + down > 1").count() == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root: the smallest reachable node.

    Large-star and small-star rounds until only stars are left. Minima are written before they are
    joined, so that adaptive execution can split the links of a hub.
    """
    edges = cut(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    while True:
        if _settled(edges):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = cut(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        edges = cut(
            large.join(least, "a")
            .where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b")))
            .distinct()
        )


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (hexadecimal), component_id (smallest doc_id reachable) per row.

    Null and empty texts have fingerprint zero and are linked like any other. Every row comes
    back, repeated ones too; fingerprints with the same smallest doc_id count as linked. Rows
    with a null doc_id link nothing: they get the component of their fingerprint, null if no
    document with an id has it. Other columns are ignored.
    """
    rows = cut(docs.select(F.col(doc_id).cast("long").alias("doc_id"), simhash(F.col(text).cast("string")).alias("fp")))
    fps = cut(rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    groups = components(links(fps))
    classes = cut(
        fps.join(groups, F.col("rep") == F.col("node"), "left").select(
            "fp", F.coalesce("root", "rep").alias("component_id")
        )
    )
    return rows.join(classes, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """The documents that are the smallest doc_id of their group, with all their columns.
    Rows without an id stay; rows that repeat a doc_id stay or go together. ``groups``: doc_id
    and component_id of the documents, by default :func:`near_duplicates`."""
    groups = near_duplicates(docs) if groups is None else groups
    drop = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(cut(drop), "doc_id", "left_anti").select(docs.columns)
