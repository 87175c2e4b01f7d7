"""Groups of documents by the similarity of their word shingles, checked on the whole sets.

Candidates come from MinHash: ``BANDS`` keys a document, each over ``ROWS`` minima of its set of
shingles. Two sets of similarity s share a key with probability 1 - (1 - s**ROWS)**BANDS, which
is above 0.999996 at 0.8. A bucket of up to ``SMALL`` documents gives all its pairs; a larger one
links each document to one of its own, another in each of four orders of the ids, so that the
pairs grow with the documents only. Links that SimHash found come to these pairs. A pair counts if the sets themselves, not their minima,
reach the similarity.

Copies of one text are one component after that. Where a large bucket still holds several
components (pages that share a template), its documents are compared by prefix filtering,
which is exact: with the shingles of every set in one order, rare ones first, two similar sets
meet in a shingle near the start of both. Only pairs of different components are looked at.

SimHash codes can't do this: pairs of similarity 0.8 differ in 4 to 14 of 64 bits, and a
covering of radius r needs 2**(r + 1) - 1 tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from brandsieve.llm.simhash import components, shingle_hashes
from brandsieve.llm.tables import cut

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 4
SMALL = 8
_BLOCK = 2048
_RANDOM = np.random.default_rng(42)
_FACTORS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_ORDERS = _RANDOM.integers(0, 1 << 63, 4, np.int64).tolist()


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of the word shingles, ascending; none for null and empty texts."""
    return np.unique(np.concatenate([np.zeros(0, "<u8"), *shingle_hashes(text, shingle)]))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), _BLOCK):
        mixed = shingles[at : at + _BLOCK, None] * _FACTORS + _TERMS
        least = np.minimum(least, mixed.min(axis=0))
    keys = np.zeros(BANDS, np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ row) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.md5(shingles.tobytes()).digest()


def _sketched(batches: Iterator[pd.DataFrame], shingle: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sets = [shingle_set(t, shingle) for t in batch["text"]]
        yield pd.DataFrame(
            {
                "doc_id": batch["doc_id"].astype("Int64"),
                "digest": [_digest(s) for s in sets],
                "bands": [band_keys(s).view(np.int64) for s in sets],
            }
        )


def _sets(batches: Iterator[pd.DataFrame], shingle: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sets = [shingle_set(t, shingle) for t in batch["text"]]
        yield pd.DataFrame(
            {"rep": batch["doc_id"], "digest": [_digest(s) for s in sets], "shingles": [s.tobytes() for s in sets]}
        )


def _checked(batches: Iterator[pd.DataFrame], similarity: float) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keep = []
        for one, two in zip(batch["one"], batch["two"]):
            x, y = np.frombuffer(one, "<u8"), np.frombuffer(two, "<u8")
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both >= similarity * (len(x) + len(y) - both))
        yield batch.loc[keep, ["a", "b"]]


def _buckets(reps: DataFrame) -> DataFrame:
    """rep, t, k, n, first: the buckets of more than one, their size and one of their documents.
    ``reps``: rep, bands."""
    rows = reps.select("rep", F.posexplode("bands").alias("t", "k"))
    order = F.element_at(F.array(*map(F.lit, _ORDERS)), F.col("t") % len(_ORDERS) + 1)
    counts = cut(
        rows.groupBy("t", "k")
        .agg(F.count("*").alias("n"), F.min(F.col("rep").bitwiseXOR(order)).alias("first"))
        .where("n > 1")
        .select("t", "k", "n", F.col("first").bitwiseXOR(order).alias("first"))
    )
    return cut(rows.join(counts, ["t", "k"]))


def _candidates(met: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of representatives that share a bucket."""

    def ordered(a: Column, b: Column) -> list[Column]:
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    small = (
        met.where(F.col("n") <= SMALL)
        .groupBy("t", "k")
        .agg(F.collect_list("rep").alias("reps"))
        .select("reps", F.explode("reps").alias("one"))
        .select("one", F.explode("reps").alias("two"))
        .where("one < two")
        .select(F.col("one").alias("a"), F.col("two").alias("b"))
    )
    large = met.where((F.col("n") > SMALL) & (F.col("rep") != F.col("first")))
    return small.unionByName(large.select(*ordered(F.col("rep"), F.col("first")))).distinct()


def _linked_pairs(linked: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of representatives and the smallest doc_id of their component."""
    pairs = linked.where("component_id < doc_id").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b"))
    return pairs.join(reps.select(F.col("rep").alias("b")), "b", "left_semi").select("a", "b").distinct()


def _sets_of(texts: DataFrame, reps: DataFrame, asked: DataFrame, shingle: int) -> DataFrame:
    """rep, shingles of the representatives in ``asked`` (rep, distinct)."""
    # repeated doc_ids may have several texts; the digest tells which set is meant
    asked = cut(asked.join(reps.select("rep", "digest"), "rep").select("rep", "digest"))
    return cut(
        texts.join(asked.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
        .mapInPandas(lambda it: _sets(it, shingle), "rep long, digest binary, shingles binary")
        .join(asked, ["rep", "digest"], "left_semi")
        .dropDuplicates(["rep", "digest"])
        .select("rep", "shingles")
    )


def _similar_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    return cut(
        pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("one")), "a")
        .join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("two")), "b")
        .mapInPandas(lambda it: _checked(it, similarity), "a long, b long")
    )


def _unsettled(met: DataFrame, groups: DataFrame) -> DataFrame:
    """rep, root: documents of the large buckets that hold more than one component."""
    large = (
        met.where(F.col("n") > SMALL)
        .join(groups.withColumnRenamed("node", "rep"), "rep", "left")
        .select("t", "k", "rep", F.coalesce("root", "rep").alias("root"))
    )
    several = large.groupBy("t", "k").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    return cut(large.join(several, ["t", "k"], "left_semi").select("rep", "root").distinct())


def _listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sizes = (batch["shingles"].str.len() // 8).to_numpy()
        yield pd.DataFrame(
            {
                "rep": np.repeat(batch["rep"].to_numpy(), sizes),
                "root": np.repeat(batch["root"].to_numpy(), sizes),
                "size": np.repeat(sizes, sizes),
                "s": np.frombuffer(b"".join(batch["shingles"]), "<i8"),
            }
        )


def _prefix_pairs(open_: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b), a < b, of different roots, all similar ones among them.

    The smaller set of a pair shares at least 2s / (1 + s) of its shingles, the larger one s of
    its own, so their first common shingle comes before the rest that is too short for that.
    """
    listed = cut(
        sets.join(open_, "rep").mapInPandas(_listed, "rep long, root long, size int, s long")
    )
    common = listed.groupBy("s").agg(F.count("*").alias("df"))
    at_least = similarity / (1 + similarity)
    ranked = (
        listed.join(common, "s")
        .groupBy("rep", "root", "size")
        .agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("shingles"))
        .select("rep", "root", "size", F.posexplode(F.expr(f"slice(shingles, 1, size - int(ceil({similarity} * size - 1e-6)) + 1)")))
        .select("rep", "root", "size", F.col("pos").alias("at"), F.col("col.s").alias("s"), F.col("col.df").alias("df"))
        .where("df > 1")
    )
    ranked = cut(ranked.drop("df"))
    short = ranked.where(F.col("at") <= F.col("size") - F.ceil(2 * at_least * F.col("size") - 1e-6))
    x, y = short.alias("x"), ranked.alias("y")
    both = F.least(F.col("x.size") - F.col("x.at"), F.col("y.size") - F.col("y.at"))
    smaller = (F.col("x.size") < F.col("y.size")) | ((F.col("x.size") == F.col("y.size")) & (F.col("x.rep") < F.col("y.rep")))
    return (
        x.join(
            y,
            (F.col("x.s") == F.col("y.s"))
            & (F.col("x.root") != F.col("y.root"))
            & smaller
            & (F.col("x.size") >= similarity * F.col("y.size") - 1e-6)
            & (both >= at_least * (F.col("x.size") + F.col("y.size")) - 1e-6),
        )
        .select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))
        .distinct()
    )


def similar_groups(
    docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, linked: DataFrame | None = None
) -> DataFrame:
    """doc_id, component_id (smallest doc_id reachable over similar pairs) per row.

    Similarity is that of the sets of word shingles; a text of fewer words is one shingle, and
    null and empty texts have none and are alike. Every row comes back, repeated ones too; sets
    with the same smallest doc_id count as linked. Rows with a null doc_id link nothing: they
    get the component of an equal set, null if no document with an id has it. ``linked``: doc_id and
    component_id by another method (:func:`~brandsieve.llm.simhash.near_duplicates`), whose pairs
    count if their sets are similar.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = cut(texts.mapInPandas(lambda it: _sketched(it, shingle), "doc_id long, digest binary, bands array<long>"))
    reps = cut(
        rows.where("doc_id is not null")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    )
    met = _buckets(reps)
    pairs = _candidates(met)
    if linked is not None:
        pairs = pairs.unionByName(_linked_pairs(linked, reps)).distinct()
    pairs = cut(pairs)
    asked = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
    edges = _similar_pairs(pairs, _sets_of(texts, reps, asked, shingle), similarity)
    groups = components(edges)
    open_ = _unsettled(met, groups)
    if open_.limit(1).count():
        sets = _sets_of(texts, reps, open_.select("rep"), shingle)
        more = _similar_pairs(_prefix_pairs(open_, sets, similarity), sets, similarity)
        groups = components(groups.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    classes = cut(
        reps.join(groups, F.col("rep") == F.col("node"), "left").select(
            "digest", F.coalesce("root", "rep").alias("component_id")
        )
    )
    return rows.join(classes, "digest", "left").select("doc_id", "component_id")
