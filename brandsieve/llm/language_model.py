"""Scores of texts under a smoothed bigram model held in Elias-Fano tries.

P1(w) = (c(w) + 1) / (N + V + 1) and P2(w | v) = (c(v w) + m P1(w)) / (c(v) + m): a Dirichlet
prior of m words, the same m for every word. The logarithm splits into a part for the pair and
one for v, and each needs only the counts around one word. So every occurrence goes to the shard
of its word, with the word before it, once: the shard counts its training pairs, builds its trie,
maps its levels and scores its occurrences. No table of the model is sent to all tasks, and
nothing is pruned. The sums of a chunk of documents come back from the shards as one row each.

How occurrences are routed has no part in any score. Words above an eighth of a shard, in all
rows, held out or not, are listed with their training counts (at most eight a shard). The pairs
of a listed word are dealt to all shards by the word before; its own count is known from the
list. Pairs above an eighth of a shard are listed as well, and their occurrences are dealt to all
shards by chunk. Equal occurrences in one document travel as one entry with their number.
"""

from __future__ import annotations

import math
import pickle
import tempfile
from array import array
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from brandsieve.llm.elias_fano import EliasFano
from brandsieve.llm.tables import in_fold, remove, split_words
from brandsieve.session import new_path

FOLDS, HELD_OUT = 7, 2
#: Tokens of a shard.
SHARD = 4_000_000
#: m, in words.
PRIOR = 100.0
#: Characters of text that are routed together.
_CHUNK = 8_000_000


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


#: No word holds a blank.
END, START = word_hash(b" end"), word_hash(b" start")


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for held, rows in batch.groupby("held_out"):
            counts: Counter[bytes] = Counter()
            for text in rows["text"]:
                counts.update(split_words(text))
            words = np.array([*map(word_hash, counts), END], np.uint64)
            n = np.array([*counts.values(), len(rows)], np.int64)
            yield pd.DataFrame({"word": _signed(words), "n": n, "train": n * (not held)})


def _pair_counts(batches: Iterator[pd.DataFrame], hot: set[int]) -> Iterator[pd.DataFrame]:
    """Counts of those pairs both of whose words are in ``hot``."""
    order = np.array(sorted(hot), np.uint64)
    index, known = {int(h): i for i, h in enumerate(order)}, {}
    start, end = index.get(START, -1), index.get(END, -1)
    for batch in (rows for batch in batches for _, rows in batch.groupby("held_out")):
        places = array("q")
        for text in batch["text"]:
            words = split_words(text)
            for w in set(words).difference(known):
                known[w] = index.get(word_hash(w), -1)
            places.append(start)
            places.extend(map(known.__getitem__, words))
            places.extend((end, -1))  # no pair goes over the end of a document
            if len(known) > 250_000:
                known.clear()
        flat = np.frombuffer(places, np.int64)
        both = np.flatnonzero((flat[:-1] >= 0) & (flat[1:] >= 0))
        pairs, n = np.unique(flat[both] * len(order) + flat[both + 1], return_counts=True)
        before, word = order[pairs // len(order)], order[pairs % len(order)]
        train = n * (not batch["held_out"].iloc[0])
        yield pd.DataFrame({"before": _signed(before), "word": _signed(word), "n": n, "train": train})


class Trie:
    """Level 1: the words; level 2: for each word the words before it, and a quantised score.

    Words and contexts are ascending hashes; the children of word i are the ranks of their
    contexts plus i times the number of contexts, which makes level 2 ascending as well, and
    pointers say where each word's children begin. All are Elias-Fano coded. A score is one
    byte, the next lower step of 256 that divide the range of the scores evenly. All levels lie
    in one file that the task maps.
    """

    def __init__(self, words: EliasFano, contexts: EliasFano, pointers: EliasFano, children: EliasFano, codes: np.ndarray, ladder: np.ndarray):
        self.words, self.contexts, self.pointers, self.children = words, contexts, pointers, children
        self.codes, self.ladder = codes, ladder

    @classmethod
    def build(cls, words: np.ndarray, contexts: np.ndarray, pairs: np.ndarray, scores: np.ndarray) -> Trie:
        """``pairs``: ascending numbers, place of the word * number of contexts + place of the
        context; ``scores``: one for each."""
        n = max(1, len(contexts))
        starts = np.searchsorted(pairs, np.arange(len(words) + 1) * n)
        ladder = np.unique(np.linspace(scores.min(), scores.max(), 256)) if len(scores) else np.zeros(1)
        codes = (np.searchsorted(ladder, scores, side="right") - 1).astype(np.uint8)
        return cls(
            EliasFano.encode(words, 1 << 64),
            EliasFano.encode(contexts, 1 << 64),
            EliasFano.encode(starts, len(pairs) + 1),
            EliasFano.encode(pairs, max(1, len(words)) * n),
            codes,
            ladder,
        )

    @property
    def nbytes(self) -> int:
        coded = (self.words, self.contexts, self.pointers, self.children)
        return sum(x.nbytes for x in coded) + self.codes.nbytes + self.ladder.nbytes

    def mapped(self) -> Trie:
        """The same trie over a mapped file without a name, which goes with the last level."""
        coded = (self.words, self.contexts, self.pointers, self.children)
        arrays = [*(x for c in coded for x in c.levels), self.codes]
        places = []
        with tempfile.TemporaryFile() as file:
            for array in arrays:
                places.append(file.tell())
                array.tofile(file)
                file.write(bytes(-file.tell() % 8))
            file.write(bytes(8))  # an empty file can't be mapped
            file.flush()
            whole = np.asarray(np.memmap(file, np.uint8, "r"))
        levels = iter([whole[at : at + x.nbytes].view(x.dtype) for at, x in zip(places, arrays)])
        return Trie(*(c.mapped(levels) for c in coded), next(levels), self.ladder)

    def score(self, words: np.ndarray, contexts: np.ndarray, word: np.ndarray, context: np.ndarray) -> np.ndarray:
        """The stored score of each (words[word], contexts[context] before it), NaN where there
        is none.

        The context's rank is searched between the pointers of its word. Equal neighbours are
        searched once."""
        out = np.full(len(word), np.nan)
        if not len(word):
            return out
        new = np.r_[True, (word[1:] != word[:-1]) | (context[1:] != context[:-1])]
        once, (place, known), (rank, seen) = np.flatnonzero(new), self.words.find(words), self.contexts.find(contexts)
        begin, end = (self.pointers.access(np.where(known, place + i, 0)).astype(np.int64) for i in (0, 1))
        w, c = word[once], context[once]
        asked = np.flatnonzero(known[w] & seen[c])
        w, c = w[asked], c[asked]
        at, hit = self.children.find(place[w] * max(1, len(self.contexts)) + rank[c], begin[w], end[w])
        found = np.full(len(once), np.nan)
        found[asked[hit]] = self.ladder[self.codes[at[hit]]]
        return found[np.cumsum(new) - 1]


class Listed:
    """Training counts of the listed words and pairs (before, word) by hash, how often documents
    begin in the training text, its sizes, and all tokens, held out or not."""

    def __init__(
        self,
        counts: dict[int, int],
        tokens: int,
        words: int,
        pairs: dict[tuple[int, int], int],
        all_tokens: int,
        prior: float = PRIOR,
    ):
        order = sorted(counts)
        self.hashes = np.array(order, np.uint64)
        self.counts = np.array([counts[h] for h in order], np.int64)
        self.tokens, self.words, self.all_tokens, self.prior = tokens, words, all_tokens, prior
        self.pairs = np.array([*pairs], np.uint64).reshape(-1, 2)
        self.pair_counts = np.array([*pairs.values()], np.int64)

    def pairs_among(self, words: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The listed pairs whose words are in the ascending hashes ``words`` and ``contexts``, as
        place of the word * number of contexts + place of the context, and their counts."""
        if not (len(self.pairs) and len(words) and len(contexts)):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        before, word = self.pairs.T
        i = np.minimum(np.searchsorted(words, word), len(words) - 1)
        j = np.minimum(np.searchsorted(contexts, before), len(contexts) - 1)
        there = (words[i] == word) & (contexts[j] == before)
        return (i * len(contexts) + j)[there], self.pair_counts[there]

    def count(self, hashes: np.ndarray) -> np.ndarray:
        """Counts of listed words, -1 for others."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.counts[at], -1)


class Part(NamedTuple):
    """Occurrences that one chunk of documents sends to one shard, by word; equal ones of a
    document are one entry."""

    words: np.ndarray  # hashes
    times: np.ndarray  # entries of each word
    contexts: np.ndarray  # hashes
    context: np.ndarray  # of each entry, in contexts
    place: np.ndarray  # of each entry, in docs
    number: np.ndarray  # of the occurrences of each entry
    docs: np.ndarray  # numbers in the chunk
    held: np.ndarray  # of docs
    ids: tuple | None  # ids, missing ids and held_out of the whole chunk, in its first part only


class Sums(NamedTuple):
    """What a shard adds to the documents of a chunk."""

    docs: np.ndarray
    tokens: np.ndarray
    known: np.ndarray
    base: np.ndarray
    model: np.ndarray
    ids: tuple | None


def _routed(rows: pd.DataFrame, listed: Listed, shards: int, chunk: int = 0) -> Iterator[tuple[int, bytes]]:
    """(shard, occurrences) of some documents, for each shard that gets any."""
    places: dict[bytes, int] = {}
    sequences = []
    for text in rows["text"]:
        words = split_words(text)
        sequences.append(np.array([0, *(places.setdefault(w, len(places) + 2) for w in words), 1], np.int64))
    hashes = np.array([START, END, *map(word_hash, places)], np.uint64)
    flat = np.concatenate(sequences)
    doc = np.repeat(np.arange(len(sequences), dtype=np.int32), [len(s) for s in sequences])
    after = np.flatnonzero(flat != 0)
    pairs, pair = np.unique(flat[after] * len(hashes) + flat[after - 1], return_inverse=True)
    entries, number = np.unique(pair * len(sequences) + doc[after], return_counts=True)
    pair, doc = entries // len(sequences), entries % len(sequences)
    word, before = np.divmod(pairs, len(hashes))
    split = listed.count(hashes) >= 0
    mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
    spread = np.where(split[word], mixed[before] ^ hashes[word], hashes[word])
    by_hash = np.argsort(hashes)
    hot, _ = listed.pairs_among(hashes[by_hash], hashes[by_hash])
    hot = np.isin(pairs, by_hash[hot // len(hashes)] * len(hashes) + by_hash[hot % len(hashes)])
    spread[hot] ^= np.uint64(xxhash.xxh64_intdigest(str(chunk)))
    shard = ((spread >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)[pair]
    word, before = word[pair], before[pair]
    order = np.argsort(shard * len(hashes) + word, kind="stable")
    shard, word, before, doc, number = shard[order], word[order], before[order], doc[order], number[order]
    ids = rows["doc_id"].astype("Int64")
    held = rows["held_out"].to_numpy(bool)
    own_ids = (ids.fillna(0).to_numpy(np.int64), ids.isna().to_numpy(bool), held)
    edges = np.searchsorted(shard, np.arange(shards + 1))
    for target in range(shards):
        own = slice(edges[target], edges[target + 1])
        if own.start == own.stop:
            continue
        first = np.flatnonzero(np.r_[True, word[own][1:] != word[own][:-1]])
        contexts, context = np.unique(before[own], return_inverse=True)
        docs, place = np.unique(doc[own], return_inverse=True)
        part = Part(
            hashes[word[own][first]],
            _narrow(np.diff(np.r_[first, own.stop - own.start])),
            hashes[contexts],
            _narrow(context),
            _narrow(place),
            _narrow(number[own]),
            _narrow(docs),
            held[docs],
            own_ids,
        )
        own_ids = None
        yield target, pickle.dumps(tuple(part), protocol=5)


def _narrow(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def _route(batches: Iterator[pd.DataFrame], listed: Listed, shards: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        chunk = batch["text"].str.len().cumsum().sub(1).clip(lower=0) // _CHUNK
        for _, rows in batch.groupby(chunk.to_numpy()):
            first = int(rows["row"].iloc[0])
            out = pd.DataFrame(list(_routed(rows, listed, shards, first)), columns=["shard", "occurrences"])
            yield out.assign(chunk=first)[["shard", "chunk", "occurrences"]]


def _score(group: pd.DataFrame, listed: Listed) -> pd.DataFrame:
    """For each routed chunk of documents its sums in this shard (:class:`Sums`).

    All occurrences are counted first, then scored one chunk after the other."""
    group = group.sort_values("chunk")
    parts = [Part(*pickle.loads(x)) for x in group["occurrences"]]
    words = np.unique(np.concatenate([p.words for p in parts]))
    contexts = np.unique(np.concatenate([p.contexts for p in parts]))
    n = max(1, len(contexts))

    def unpacked(part: Part) -> tuple[np.ndarray, np.ndarray]:
        word = np.repeat(np.searchsorted(words, part.words), part.times)
        return word, np.searchsorted(contexts, part.contexts)[part.context]

    counts, numbers, amounts = np.zeros(len(words), np.int64), [], []
    for part in parts:
        word, context = unpacked(part)
        train = ~part.held[part.place]
        counts += np.bincount(word[train], part.number[train], len(words)).astype(np.int64)
        numbers.append((word * n + context)[train])
        amounts.append(part.number[train])
    # listed pairs have their counts from the list, whatever part of them is here
    pairs, times = listed.pairs_among(words, contexts)
    numbers, amounts = np.concatenate(numbers), np.concatenate(amounts)
    if len(pairs):
        other = ~np.isin(numbers, pairs)
        seen = times > 0
        numbers, amounts = np.r_[numbers[other], pairs[seen]], np.r_[amounts[other], times[seen]]
    order = np.argsort(numbers)
    numbers, amounts = numbers[order], amounts[order]
    del order
    first = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]]) if len(numbers) else np.zeros(0, np.int64)
    pairs = numbers[first]
    times = np.add.reduceat(amounts, first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)
    del numbers, amounts

    known = listed.count(words)
    counts = np.where(known >= 0, known, counts)
    single = (counts + 1) / (listed.tokens + listed.words + 1)
    weight = listed.prior * single
    trie = Trie.build(words, contexts, pairs, np.log10(times + weight[pairs // n])).mapped()
    del pairs, times
    # every token but the end is the context of the next one
    as_context = np.where(words == END, 0.0, np.log10(counts + listed.prior))
    base, unseen, seen = np.log10(counts + 1.0), np.log10(weight), counts > 0
    out = []
    for part in parts:
        own = np.repeat(np.arange(len(part.words)), part.times)
        word = np.searchsorted(words, part.words)[own]
        stored = trie.score(part.words, part.contexts, own, part.context)
        model = np.where(np.isnan(stored), unseen[word], stored) - as_context[word]
        docs = len(part.docs)
        sums = Sums(
            part.docs,
            _narrow(np.bincount(part.place, part.number, docs).astype(np.int64)),
            _narrow(np.bincount(part.place, part.number * seen[word], docs).astype(np.int64)),
            np.bincount(part.place, base[word] * part.number, docs),
            np.bincount(part.place, model * part.number, docs),
            part.ids,
        )
        out.append(pickle.dumps(tuple(sums), protocol=5))
    return pd.DataFrame({"shard": group["shard"], "chunk": group["chunk"], "sums": out})


def _gathered(group: pd.DataFrame) -> pd.DataFrame:
    """The sums of a chunk over all shards, in their order, for each document."""
    parts = [Sums(*pickle.loads(x)) for x in group.sort_values("shard")["sums"]]
    ids, absent, held = next(p.ids for p in parts if p.ids is not None)
    tokens, known = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    base, model = np.zeros(len(ids)), np.zeros(len(ids))
    for part in parts:  # a document is there once at most in each
        tokens[part.docs] += part.tokens
        known[part.docs] += part.known
        base[part.docs] += part.base
        model[part.docs] += part.model
    return pd.DataFrame(
        {
            "doc_id": pd.Series(ids, dtype="Int64").mask(absent),
            "held_out": held,
            "n_tokens": tokens,
            "n_known": known,
            "base": base,
            "model": model,
        }
    )


def listed_words(rows: DataFrame, shard: int = SHARD, prior: float = PRIOR) -> Listed:
    """Word counts of the texts (columns text, held_out), reduced to totals and the listed words
    and pairs. A pair above an eighth of a shard has two words above it."""
    spark, texts = rows.sparkSession, rows.select("text", "held_out")
    path = new_path(spark, "word-counts")
    sums = [F.sum("n").alias("n"), F.sum("train").alias("train")]
    texts.mapInPandas(_counts, "word long, n long, train long").groupBy("word").agg(*sums).write.parquet(path)
    counts = spark.read.parquet(path)
    all_tokens, tokens, words = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("train"), F.lit(0)), F.count_if(F.col("train") > 0)
    ).first()
    often = counts.where(F.col("n") > shard / 8).collect()
    listed = {r["word"] % (1 << 64): r["train"] for r in often}
    hot = set(listed)
    documents = counts.where(F.col("word") == int(_signed(np.array([END], np.uint64))[0])).select("n", "train").first()
    remove(spark, path)
    listed[START] = documents["train"] if documents else 0
    if documents and documents["n"] > shard / 8:
        hot.add(START)
    pairs = {}
    if all_tokens > shard and hot:  # at most eight words and eight pairs a shard
        shared = spark.sparkContext.broadcast(hot)
        found = (
            texts.mapInPandas(lambda it: _pair_counts(it, shared.value), "before long, word long, n long, train long")
            .groupBy("before", "word")
            .agg(*sums)
            .where(F.col("n") > shard / 8)
        )
        pairs = {(r["before"] % (1 << 64), r["word"] % (1 << 64)): r["train"] for r in found.collect()}
    return Listed(listed, tokens, words, pairs, all_tokens, prior)


def score_texts(docs: DataFrame, shard: int = SHARD, prior: float = PRIOR) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows that are not held out; rows with a null doc_id never are. Null texts
    are empty: one token, the end. Repeated rows are scored, and learnt from, once each.
    Without training rows every token is unknown. Other columns are ignored. ``shard`` bounds
    what a task holds and changes scores by their quantising only.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        in_fold(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    listed = listed_words(rows, shard, prior)
    shared = spark.sparkContext.broadcast(listed)
    shards = max(1, math.ceil(listed.all_tokens / shard))
    scored = (
        rows.withColumn("row", F.monotonically_increasing_id())
        .mapInPandas(lambda it: _route(it, shared.value, shards), "shard int, chunk long, occurrences binary")
        .repartitionById(shards, "shard")  # a shard a task
        .groupBy("shard")
        .applyInPandas(lambda group: _score(group, shared.value), "shard int, chunk long, sums binary")
        .groupBy("chunk")
        .applyInPandas(
            _gathered, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double"
        )
    )
    start = np.array([START], np.uint64)
    opening = math.log10(int(listed.count(start)[0]) + prior)
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(listed.tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * math.log10(listed.tokens + listed.words + 1)).alias("base_score"),
        (F.col("model") - opening).alias("score"),
    )
