"""Phrases that occur often, and how strongly their words hold together, mined by sampling.

A phrase is frequent with ``MIN_COUNT`` occurrences. A sample of the documents, mined level by level
with a lowered threshold, proposes frequent phrases. One pass over all documents then counts the
proposals and their negative border, exactly: every word, and every longer phrase whose two
phrases of one word less are proposed. A border phrase that turns out frequent is a failure of the
sample: it joins the proposals, and a further pass counts the border that they open. That pass
follows the border through all lengths: what it newly reaches counts as proposed. So it closes the
mining, whatever the sample held: a frequent phrase has frequent parts only, and each of these was
proposed, is a failure of the first pass, or is newly reached by the second.

The proposals reach the tasks as a Bloom filter of ``FILTER_BITS`` bits: a fixed size. A phrase that
it takes for proposed is counted, or its border, without need; counts stay exact, as all occurrences
of a phrase meet the same answer. Tasks number the words and phrases of a few megabytes of text at
a time and count them with numpy. Proposals travel to the sum by name. The border, which is large and
mostly rare, travels by hash: a hash's count is that of its phrase at least, so no failure is missed,
and the pass after counts each failure by name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from brandsieve.llm.tables import cut

MIN_COUNT, MOST_WORDS, TOP = 100, 5, 2000
#: Share of the documents in the sample, and of MIN_COUNT that a proposal needs in it.
SAMPLE, LOWERED = 1 / 8, 0.4
FILTER_BITS = 1 << 26
_PROBES = 4
#: Bytes of text numbered together.
_CHUNK = 6 << 20
#: Bits of a hash that are kept: fewer make the border's rows shorter, and more of its phrases share a
#: count, so that more of them are counted by name without need.
_KEPT = np.uint64((1 << 40) - 1)
_STOP = b"\xff"  # no byte of UTF-8: ends a piece
#: Rows sent to the sum at once.
_ROWS = 50_000
_MIX, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)  # odd numbers

_TABLE = bytearray(range(256))
_TABLE[ord("A") : ord("Z") + 1] = b"abcdefghijklmnopqrstuvwxyz"
for _c in b".,;:!?\x0a\x0b\x0c\x0d":
    _TABLE[_c] = _STOP[0]
_TABLE[9] = 32
_TABLE = bytes(_TABLE)


# --- the filter ---


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _TURN
    return x ^ (x >> np.uint64(29))


def _longer(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one word more at their end."""
    return _mixed(hashes * _MIX + words) & _KEPT


def _word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words)) & _KEPT


def _places(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    step = _mixed(hashes * _MIX) | np.uint64(1)
    for i in range(_PROBES):
        yield (hashes + np.uint64(i) * step) % np.uint64(bits)


def _holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the phrases the filter takes for proposed."""
    found = np.ones(len(hashes), bool)
    for at in _places(hashes, 8 * len(bits)):
        found &= (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return found


def _shared(context: SparkContext, bits: np.ndarray) -> Broadcast:
    return context.broadcast(zlib.compress(bits.tobytes(), 1))


def _opened(shared: Broadcast | None) -> np.ndarray | None:
    return None if shared is None else np.frombuffer(zlib.decompress(shared.value), np.uint8)


def _added(keys: DataFrame, bits: np.ndarray, shared: Broadcast) -> tuple[np.ndarray, bool]:
    """The filter with the phrases of some hashes in it, and whether it held all of them before."""
    size = 8 * len(bits)

    def absent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = _opened(shared)
        for rows in batches:
            hashes = rows["key"].to_numpy().view(np.uint64)
            hashes = hashes[~_holds(own, hashes)]
            yield pd.DataFrame({"at": np.concatenate(list(_places(hashes, size))).astype("int64") + 1})

    # The function counts from 1, in buckets of 4 KB; at most the whole filter comes back.
    parts = (
        keys.mapInPandas(absent, "at long")
        .groupBy(F.bitmap_bucket_number("at").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
        .collect()
    )
    bits = bits.copy()
    for bucket, part in parts:
        own = bits[4096 * (bucket - 1) : 4096 * bucket]
        own |= np.frombuffer(part, np.uint8)[: len(own)]
    return bits, not parts


# --- counting ---


def _chunks(langs: list[str], texts: list[bytes]) -> Iterator[tuple[str, bytes]]:
    """Lang and pieces, each ended by ``_STOP``, in chunks of about ``_CHUNK`` bytes; only a single
    longer piece makes a longer one."""
    order = sorted(range(len(langs)), key=langs.__getitem__)
    for lang, own in groupby(order, key=langs.__getitem__):
        blob = _STOP.join(texts[i] for i in own).translate(_TABLE) + _STOP
        at = 0
        while at < len(blob):
            end = blob.rfind(_STOP, at, at + _CHUNK) + 1 or blob.index(_STOP, at) + 1
            yield lang, blob[at:end]
            at = end


def _numbered(blob: bytes) -> tuple[np.ndarray, pa.Array]:
    """The words of a chunk as numbers of a list of different words; 0 is an end of a piece."""
    content = np.frombuffer(_STOP + blob, np.uint8)
    gap, stop = content == 32, content == _STOP[0]
    opens = stop.copy()
    opens[1:] |= gap[:-1] | stop[:-1]
    offsets = np.append(np.flatnonzero(opens[~gap]), np.count_nonzero(~gap)).astype(np.int32)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(content[~gap])]
    coded = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, buffers).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


def _count_chunk(lang: str, blob: bytes, new: np.ndarray, old: np.ndarray | None, most: int, named: bool, again: bool):
    """(words, phrases, hashes, counts) of the phrases that are due; phrases is None for what comes
    by hash.

    A phrase is reached if both its parts are in ``new``; due is what the pass before, with ``old``,
    did not reach, and in the first pass all words. Where names are wanted at all, only the border of
    the first pass comes by hash. With ``again``, in the pass that expands its failures, these are due
    once more, by name, and what is newly reached counts as held, so that the border is followed
    through all lengths at once.
    """
    ids, words = _numbered(blob)
    n_words = len(words)
    word_hashes = hashes = _word_hashes(words.to_pylist(), lang)
    held = _holds(new, hashes)
    held[0] = False
    if old is None:
        counts = np.bincount(ids, minlength=n_words)[1:]
        if named:
            yield 0, pa.array([b""]), None, np.array([counts.sum()])
            yield 1, words[1:], hashes[1:], counts
        else:
            yield 1, None, hashes[1:], counts
    columns = [np.arange(n_words, dtype=np.int32)]
    was = np.zeros(n_words, bool) if old is None else _holds(old, hashes)
    here = np.where(held, columns[0], np.int32(-1))[ids]
    for n in range(2, most + 1):
        starts = np.flatnonzero((here[:-1] >= 0) & (here[1:] >= 0))
        if not len(starts):
            return
        own, keys = pd.factorize(here[starts].astype(np.int64) * n_words + ids[starts + n - 1])
        first = np.empty(len(keys), np.int64)
        first[own[::-1]] = starts[::-1]
        before, after, last = here[first], here[first + 1], (keys % n_words).astype(np.int32)
        columns = [c[before] for c in columns] + [last]
        hashes = _longer(hashes[before], word_hashes[last])
        held, reached = _holds(new, hashes), was[before] & was[after]
        was = reached & _holds(old, hashes) if old is not None else reached
        counts = np.bincount(own, minlength=len(keys))
        due = ~reached
        if again:
            held |= due
            due |= held & ~was & (n < most)
        by_name = held | (n == most) | (old is not None) if named else np.zeros(len(keys), bool)
        at = np.flatnonzero(due & by_name)
        if len(at):
            yield n, pc.binary_join_element_wise(*(words.take(pa.array(c[at])) for c in columns), b" "), hashes[at], counts[at]
        at = np.flatnonzero(due & ~by_name)
        if len(at):
            yield n, None, hashes[at], counts[at]
        here = np.full(len(ids), -1, np.int32)
        here[starts] = np.where(held, np.arange(len(keys), dtype=np.int32), np.int32(-1))[own]


def _counts(docs: DataFrame, new: Broadcast, old: Broadcast | None, least: float, most: int, named: bool, again: bool) -> DataFrame:
    """lang, words, phrase, key, f of the phrases due that occur often enough, in a written table;
    lang and phrase are null for what came by hash. Of each lang, a row of 0 words counts them all."""

    def count_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new_bits, old_bits = _opened(new), _opened(old)
        for batch in batches:
            langs, texts = (batch.column(c) for c in ("lang", "text"))
            for lang, blob in _chunks(langs.to_pylist(), texts.cast(pa.binary()).to_pylist()):
                for n, phrases, hashes, counts in _count_chunk(lang, blob, new_bits, old_bits, most, named, again):
                    for at in range(0, len(counts), _ROWS):
                        some = slice(at, at + _ROWS)
                        size = len(counts[some])
                        nothing = pa.nulls(size, pa.string())
                        yield pa.RecordBatch.from_arrays(
                            [
                                nothing if phrases is None else pa.array([lang] * size),
                                pa.array(np.full(size, n, np.int8)),
                                nothing if phrases is None else phrases[some].cast(pa.string()),
                                pa.nulls(size, pa.int64()) if hashes is None else pa.array(hashes[some].view(np.int64)),
                                pa.array(counts[some]),
                            ],
                            ["lang", "words", "phrase", "key", "n"],
                        )

    return cut(
        docs.mapInArrow(count_batch, "lang string, words byte, phrase string, key long, n long")
        .groupBy("lang", "words", "phrase", "key")
        .agg(F.sum("n").alias("f"))
        .where((F.col("f") >= least) | (F.col("words") == 0))
    )


def _failures(counted: DataFrame) -> DataFrame:
    """What was frequent and may be part of something longer; no matter if it was proposed."""
    return counted.where((F.col("words") > 0) & (F.col("words") < MOST_WORDS)).select("key")


def _proposals(sample: DataFrame, bits: np.ndarray, least: float, most: int) -> np.ndarray:
    """The filter of the phrases of up to ``most`` words with ``least`` occurrences, level by level."""
    context, old = sample.sparkSession.sparkContext, None
    for _ in range(most):
        new = _shared(context, bits)
        counted = _counts(sample, new, old, least, most, named=False, again=False)
        bits, closed = _added(_failures(counted), bits, new)
        if old:
            old.destroy()  # written tables need it no more
        old = new
        if closed:
            break
    old.destroy()
    return bits


def frequent_phrases(
    docs: DataFrame, min_count: int = MIN_COUNT, most: int = MOST_WORDS, sample: float = SAMPLE, bits: int = FILTER_BITS
) -> DataFrame:
    """lang, words (how many), phrase, f: all phrases of up to ``most`` words, single words too, with
    ``min_count`` occurrences, and of each lang one row of 0 words with the number of all words.

    Null langs are ``und``, null texts empty; rows count one by one, repeated ones too; an empty
    table gives an empty result. Other columns are ignored.
    """
    rows = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    nothing = np.zeros(bits // 8, np.uint8)
    proposed = _proposals(rows.sample(sample, seed=1), nothing, LOWERED * sample * min_count, most - 1)
    context = docs.sparkSession.sparkContext
    old = _shared(context, proposed)
    found = _counts(rows, old, None, min_count, most, named=True, again=False)
    wider, closed = _added(_failures(found), proposed, old)
    if not closed:
        new = _shared(context, wider)
        found = found.unionByName(_counts(rows, new, old, min_count, most, named=True, again=True))
        new.destroy()
    old.destroy()
    return found.where("phrase IS NOT NULL").select("lang", "words", "phrase", "f")


# --- scores ---


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, **options) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: of each lang the first phrases by score.

    Candidates have 2 to 5 words; the cut with the lowest score counts, ties to the smallest first
    part. A candidate inside a longer one that occurs as often is dropped: then the same holds for
    one that is a single word longer, whose first or last cut shows it. All arithmetic is in
    integers of up to 36 digits. See :func:`frequent_phrases` for odd rows.
    """
    found = cut(frequent_phrases(docs, min_count, **options))
    f, words = found.select("lang", "phrase", "f").where("phrase <> ''"), F.col("words").cast("int")
    cuts = (
        found.where("words > 1")
        .withColumn("k", F.explode(F.sequence(F.lit(1), words - 1)))
        .select(
            "lang",
            "phrase",
            "words",
            "k",
            F.col("f").alias("a"),
            F.expr("substring_index(phrase, ' ', k)").alias("first"),
            F.expr("substring_index(phrase, ' ', k - words)").alias("rest"),
        )
        .join(f.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
        .join(f.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    )
    # A lang may hold most rows: the number of its words is repeated for each slot.
    slots = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slot = F.pmod(F.xxhash64("phrase"), F.lit(slots)).cast("int")
    totals = found.where("words = 0").select(
        "lang", F.col("f").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot")
    )
    score = F.expr(f"{_wide('a')} * {_wide('n')} * cast(1000 AS decimal(4)) div ({_wide('l')} * {_wide('r')})")
    scored = cuts.withColumn("slot", slot).join(totals, ["lang", "slot"]).withColumn("score", score)
    whole = scored.select("lang", "phrase", "a", "n", F.struct("score", "k", "l", "r").alias("best"), F.lit(False).alias("inside"))

    def inside(part: str, other: Column) -> DataFrame:
        nothing = {c: F.lit(None).cast(whole.schema[c].dataType) for c in ("a", "n", "best")}
        rows = scored.where(other).select("lang", F.col(part).alias("phrase"))
        return rows.withColumns(nothing | {"inside": F.lit(True)})

    shown = (
        whole.unionByName(inside("rest", (F.col("k") == 1) & (F.col("words") > 2) & (F.col("r") == F.col("a"))))
        .unionByName(inside("first", (F.col("k") == words - 1) & (F.col("words") > 2) & (F.col("l") == F.col("a"))))
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("a"), F.max("n").alias("n"), F.min("best").alias("best"), F.max("inside").alias("inside"))
        .where("NOT inside")
        .select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    )
    order = F.desc("score"), F.desc("a"), F.asc("phrase")

    def first(rows: DataFrame, *group: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
        return rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)

    # The first of each slot of a lang, then of the lang: no task sorts all phrases of a lang.
    return first(first(shown.withColumn("slot", slot), "lang", "slot").drop("rank"), "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )


def _wide(name: str) -> str:
    return f"cast({name} AS decimal(15))"


ORACLE = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
split AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
totals AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM split GROUP BY lang),
f AS MATERIALIZED (
  SELECT lang, words, phrase, count(*) AS f
  FROM (SELECT lang, m AS words, array_to_string(words[i:i + m - 1], ' ') AS phrase
        FROM (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM split), (SELECT unnest([1, 2, 3, 4, 5]) AS m)
        WHERE i + m - 1 <= len(words))
  GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
  SELECT lang, phrase, words, f AS a, k, array_to_string(list[1:k], ' ') AS first, array_to_string(list[k + 1:], ' ') AS rest
  FROM (SELECT *, string_split(phrase, ' ') AS list, unnest(range(1, words)) AS k FROM f WHERE words > 1)),
scored AS (
  SELECT c.*, l.f AS l, r.f AS r, t.n, (1000::HUGEINT * c.a * t.n) // (l.f::HUGEINT * r.f) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.first JOIN f r ON r.lang = c.lang AND r.phrase = c.rest
       JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n,
       CAST(score AS BIGINT) AS score
FROM lowest s
WHERE NOT EXISTS (SELECT 1 FROM f y WHERE y.lang = s.lang AND y.words > s.words AND y.f >= s.a
                  AND contains(' ' || y.phrase || ' ', ' ' || s.phrase || ' '))
QUALIFY rank <= 2000
"""
