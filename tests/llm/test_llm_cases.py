"""Nulls, empty and very long texts, repeated rows, ties, empty tables and clashing columns."""

import itertools
import pickle
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brandsieve.llm import (
    chat,
    hamming,
    language_model,
    mixing,
    neighbours,
    packing,
    quality,
    secret_scan,
    similar,
    simhash,
    token_counts,
)
from brandsieve.llm.tables import in_fold

LONG = "word " * 200_000
ROWS = [
    (1, "plain text of a few words", "en", "a", 25),
    (1, "plain text of a few words", "en", "a", 25),
    (2, "", "en", "a", 0),
    (3, None, None, None, None),
    (None, "no id, password: x9$Lq!72zP", "en", None, 28),
    (4, LONG, "en", "b", len(LONG)),
    (5, " \t\n ", "de", "b", 4),
    (6, "Ünïcödé 中文   text", "de", "\U0001f600", 18),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("row", "size", "place", "fp", "t", "k", "n", "label", "quality_score", "score", "copy", "bucket", "shard",
            "held_out", "target", "secret_spans", "component_id", "length", "r", "s")
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(f"x{c}") for c in CLASHING})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 1), (None, 1, 0), (9, 0, 0)], LABELS)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_simhash(spark, docs):
    rows = by_id(simhash.near_duplicates(docs))
    assert simhash.near_duplicates(docs).count() == len(ROWS)
    assert rows[2]["fingerprint"] == rows[3]["fingerprint"] == rows[5]["fingerprint"] == "0" * 16
    assert rows[2]["component_id"] == rows[3]["component_id"] == rows[5]["component_id"] == 2
    assert rows[None]["component_id"] is None
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 1, 2, 4, 6]


def test_token_counts(docs):
    rows = by_id(token_counts.count_tokens(docs))
    assert (rows[3]["n_words"], rows[3]["n_pieces"], rows[2]["longest_word"]) == (0, 0, 0)
    assert rows[4]["n_words"] == 200_000 == rows[4]["n_pieces"]
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


def test_hamming(spark):
    rows = [(0, 5), (0, 5), (50, 5), (1, 5), (2, -1), (None, 5), (3, None)]
    table = spark.createDataFrame(rows, "vec_id long, code long").withColumn("rank", F.lit(1))
    found = sorted(map(tuple, hamming.nearest_codes(table).collect()))
    assert found == [(0, 1, 1, 0), (0, 2, 50, 0), (0, 3, 2, 62), (50, 1, 0, 0), (50, 2, 1, 0), (50, 3, 2, 62)]
    assert hamming.nearest_codes(table.limit(0)).count() == 0


def test_secrets(docs):
    rows = by_id(secret_scan.secret_report(docs))
    assert rows[3]["spans"] == rows[2]["spans"] == "" and rows[None]["spans"] == "guess:17:27"
    assert rows[3]["base_sha256"].startswith("e3b0c442")
    assert secret_scan.secret_report(docs.limit(0)).count() == 0
    clean = secret_scan.redact(docs)
    assert clean.columns == docs.columns and clean.count() == len(ROWS)
    assert by_id(clean)[None]["text"] == "no id, password: [SECRET]" and by_id(clean)[None]["n_chars"] == 25
    assert by_id(clean)[3]["text"] is None


def test_language_model(docs):
    rows = by_id(language_model.score_texts(docs))
    assert language_model.score_texts(docs).count() == len(ROWS)
    assert rows[3]["n_tokens"] == rows[2]["n_tokens"] == 1 and rows[4]["n_tokens"] == 200_001
    assert not rows[None]["held_out"] and rows[3]["score"] == rows[2]["score"] < 0
    assert language_model.score_texts(docs.limit(0)).count() == 0


def test_neighbours(spark):
    vectors = [
        (0, [1.0, 0.0, 0.5]), (0, [1.0, 0.0, 0.5]), (1, [2.0, 0.0, 1.0]), (2, [1.0, 0.0, 0.5]), (50, [-1.0, 2.0, 0.0]),
        (3, None), (4, [0.0, 0.0, 0.0]), (5, [None, 1.0, 1.0]), (6, [float("nan"), 1.0, 1.0]), (7, [1.0, 1.0]),
        (None, [1.0, 1.0, 1.0]), (8, []),
    ]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    found = [tuple(r)[:3] for r in neighbours.nearest(table).orderBy("query_id", "rank").collect()]
    assert found == [(0, 1, 1), (0, 2, 2), (0, 3, 50), (50, 1, 0), (50, 2, 1), (50, 3, 2)]
    assert neighbours.nearest(table.limit(0)).count() == 0


def test_mixing(docs):
    rows = mixing.shares(docs)
    assert rows.count() == len(ROWS)
    for row in rows.collect():
        assert row["taken"] in {row["size"] * n for n in range(4)} and row["target"] <= 3 * row["source_size"]
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    taken = rows.agg(F.sum("taken")).first()[0]
    assert mixed.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == taken
    assert mixing.shares(docs.limit(0)).count() == mixing.mix(docs.limit(0)).count() == 0


def test_quality(docs, labels):
    rows = quality.quality_report(docs, labels)
    assert rows.count() == len(ROWS)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows.collect())
    kept = quality.accepted(docs, labels, threshold=0.0)
    assert kept.columns == docs.columns and {r["score"] for r in kept.collect()} == {"xscore"}
    assert quality.quality_report(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in quality.quality_report(docs, labels.limit(0)).collect()} == {0.5}


def test_packing(docs):
    rows = packing.packed_documents(docs).collect()
    assert sum(r["doc_id"] == 1 for r in rows) == 2
    assert {(r["piece"], r["start"], r["length"]) for r in rows if r["doc_id"] in (2, 3)} == {(0, 0, 1)}
    assert sum(r["doc_id"] is None for r in rows) == 1
    long = sorted((r["piece"], r["length"]) for r in rows if r["doc_id"] == 4)
    assert all(n == 1024 for _, n in long[1:])
    assert packing.packed_documents(docs.limit(0)).count() == 0


def test_chat(spark):
    rows = [
        (1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 0, "user", "x"),
        (2, 0, "tool", ""), (3, 0, "assistant", LONG),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    found = {r["conv_id"]: r for r in chat.formatted_conversations(table).collect()}
    assert found[1]["formatted"] == "[ROLE]  [TEXT]  [/TEXT][INST] a [/INST][INST] a [/INST]<s> b </s>"
    assert found[1]["n_turns"] == 4 and found[3]["loss_chars"] == len(LONG) and found[2]["loss_chars"] == 0
    assert set(found) == {1, 2, 3, None}
    assert chat.formatted_conversations(table.limit(0)).count() == 0


def test_stages_keep_the_columns(spark, docs, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, str(tmp_path))
            assert out.columns == docs.columns
            assert out.count() <= 3 * len(ROWS)
        corpus_pipeline.STAGES[-1][1](spark, rows, str(tmp_path)).count()


def test_similar_texts_stay_once(spark, docs):
    """The stage against all pairs: near copies of one text, some linked through others only."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for group in range(12):
        text = rng.choices(words, k=150)
        for _ in range(20 if group < 2 else 3):
            rows.append((len(rows) + 100, " ".join(text)))
            for _ in range(3):
                text[rng.randrange(len(text))] = rng.choice(words)
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    least = {i: i for i in sets}
    before = None
    while before != least:
        before = dict(least)
        for a, b in itertools.combinations(sets, 2):
            if least[a] != least[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                least[a] = least[b] = min(least[a], least[b])
    table = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, table, "").collect()}
    assert kept == {i for i in least if least[i] == i}
    assert len(kept) < simhash.keep_one(table).count()
    found = by_id(similar.similar_groups(docs))
    assert similar.similar_groups(docs).count() == len(ROWS)
    assert found[2]["component_id"] == found[3]["component_id"] == found[5]["component_id"] == 2
    assert found[None]["component_id"] is None and found[1]["component_id"] == 1


def test_a_common_pair_is_dealt_over_the_shards(spark):
    """A word over and over, and a pair with a third of all tokens: no shard gets most of them."""
    rng = random.Random(5)
    rows = [(i, "x " * 300 if i % 40 == 0 else " ".join(["a b", *rng.choices("cdefghijklm", k=3)] * 6)) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    listed = language_model.listed_words(docs.withColumn("held_out", F.lit(False)), 2000)
    tokens, words, pairs = Counter(), set(), Counter()
    for _, text in rows:
        own = [*text.split(), None]
        tokens.update(own)
        pairs.update(zip(["start", *own], own))
    assert len(listed.pairs) == sum(n > 250 for n in pairs.values()) and sorted(listed.pair_counts) == sorted(n for n in pairs.values() if n > 250)
    shards, entries, number = 12, Counter(), 0
    frame = docs.toPandas().assign(held_out=False)
    for chunk in range(0, 800, 10):
        for shard, part in language_model._routed(frame[chunk : chunk + 10].reset_index(drop=True), listed, shards, chunk):
            part = language_model.Part(*pickle.loads(part))
            entries[shard] += len(part.place)
            number += int(part.number.sum())
    assert number == sum(tokens.values()) and max(entries.values()) < sum(entries.values()) / 4
    only_held = language_model.listed_words(docs.withColumn("held_out", F.lit(True)), 2000)
    assert (only_held.hashes == listed.hashes).all() and not only_held.counts.any()  # listed all the same
    assert len(only_held.pairs) == len(listed.pairs) and not only_held.pair_counts.any() and only_held.tokens == 0

    held = {r["doc_id"] for r in docs.where(in_fold(F.col("doc_id"), 7, 2)).collect()}
    small, large = by_id(language_model.score_texts(docs, 2000)), by_id(language_model.score_texts(docs, 2000 * 100))
    listed = {r["train_tokens"] for r in small.values()}
    assert len(listed) == 1 and held == {i for i, r in small.items() if r["held_out"]}
    for i, row in small.items():
        assert (row["n_tokens"], row["n_known"]) == (large[i]["n_tokens"], large[i]["n_known"])
        assert row["base_score"] == pytest.approx(large[i]["base_score"], abs=1e-6)
        assert abs(row["score"] - large[i]["score"]) <= 0.03 * row["n_tokens"]


def test_quality_keeps_all_without_evidence(spark, docs):
    for rows in ([], [(1, 1, 0)]):
        assert quality.accepted(docs, spark.createDataFrame(rows, LABELS)).count() == len(ROWS)
