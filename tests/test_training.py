import hashlib
import math

import pytest
from pyspark.sql import functions as F

from brandsieve.operators import sampling, training


def digest(i, seed=42):
    return hashlib.md5(f"{i}|{seed}".encode()).hexdigest()


@pytest.mark.parametrize("k", [0, 1, 7, 999, 1000, 5000])
def test_sample_is_exact(spark, k):
    df = spark.range(1000)
    got = {r["id"] for r in sampling.take_sample(df, "id", k).collect()}
    assert got == set(sorted(range(1000), key=digest)[:k])


def labelled_rows(spark, positives, negatives):
    return spark.range(positives + negatives).withColumn("label", (F.col("id") < positives).cast("int"))


@pytest.mark.parametrize(("positives", "negatives"), [(300, 80), (300, 30), (40, 10), (20, 90), (60, 60), (5, 0)])
def test_balance(spark, positives, negatives):
    df = labelled_rows(spark, positives, negatives)
    got = training.balance(df, "id").collect()
    kept = sorted(r["id"] for r in got if r["label"] == 1)
    target = min(positives, negatives)
    assert len(kept) == target and sum(r["label"] == 0 for r in got) == target
    if positives > target > 50:
        assert set(range(positives - 50, positives)) <= set(kept)
        assert set(kept) == set(range(positives - 50, positives)) | set(sorted(range(positives - 50), key=digest)[: target - 50])
    elif positives > target:
        tail = list(range(max(0, positives - 50), positives))
        assert kept == tail[:target]


@pytest.mark.parametrize(("positives", "negatives"), [(33, 19), (7, 2), (100, 0)])
def test_exact_split(spark, positives, negatives):
    got = training.split_exact(labelled_rows(spark, positives, negatives), "id").groupBy("label", "split").count().collect()
    sizes = {(r["label"], r["split"]): r["count"] for r in got}
    assert sum(n for (_, s), n in sizes.items() if s == "test") == math.ceil((positives + negatives) * 0.2)
    assert abs(sizes.get((1, "test"), 0) - positives * 0.2) < 1
    assert sum(sizes.values()) == positives + negatives


def test_hash_split_is_a_stable_partition(spark):
    small = {r["id"]: r["split"] for r in training.split_by_hash(spark.range(500), "id").collect()}
    large = {r["id"]: r["split"] for r in training.split_by_hash(spark.range(2000), "id").collect()}
    assert all(large[i] == s for i, s in small.items())
    assert 300 < sum(s == "test" for s in large.values()) < 500


def test_labels(spark):
    rows = [("a", "original"), ("b", "paraphrase"), ("c", "gibberish"), ("d", "web"), ("", "original"), ("e", None)]
    df = spark.createDataFrame(rows, "business_description string, source string")
    assert [(r[0], r["label"]) for r in training.labelled(df).collect()] == [("a", 1), ("b", 1), ("c", 0)]


def test_metrics_with_an_absent_class(spark):
    df = spark.createDataFrame([(1, 1), (1, 0)], "label int, prediction int")
    row = training.classification_metrics(df).first()
    assert (row["accuracy"], row["precision_gibberish"], row["recall_gibberish"]) == (0.5, 0.0, 0.0)
    assert row["f1_legitimate"] == pytest.approx(2 / 3)


def test_padding(spark):
    df = training.add_tokens(spark.createDataFrame([("a b c",), ("",)], "t string"), training.token_ids(F.col("t"), 2), max_length=2)
    full, empty = training.pad_tokens(df).collect()
    assert (full["bucket"], full["attention_mask"], full["labels"][2:]) == (8, [1, 1] + [0] * 6, [-100] * 6)
    assert (empty["bucket"], empty["input_ids"]) == (0, [])


def test_batches_are_bounded_and_padded_to_their_longest(spark):
    words = F.array_join(F.array_repeat(F.lit("w"), (F.col("id") * 7 % 30).cast("int")), " ")
    df = training.add_tokens(spark.range(400).withColumn("t", words), training.token_ids(F.col("t"), 24), max_length=24)
    made = training.token_batches(df, "id", max_tokens=64, slot_rows=100)
    rows = made.collect()
    assert sorted(i for r in rows for i in r["ids"]) == list(range(400)) and len({r["slot"] for r in rows}) == 4
    for r in rows:
        lengths = [min(24, i * 7 % 30) for i in r["ids"]]
        assert r["n_tokens"] == sum(lengths) and r["ids"] == sorted(r["ids"])
        assert {len(x) for c in ("input_ids", "attention_mask", "labels") for x in r[c]} == {-(-max(lengths) // 8) * 8}
        assert [sum(m) for m in r["attention_mask"]] == lengths and len(r["ids"]) * r["bucket"] <= 64
    fresh = training.token_batches(df, "id", max_tokens=64, slot_rows=100)
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    alone = training.token_batches(df, "id", max_tokens=10).where("bucket = 24").collect()
    assert {len(r["ids"]) for r in alone} == {1}


def test_first_and_last(spark):
    assert [r["id"] for r in sampling.head(spark.range(100), "id", 3, last=True).collect()] == [99, 98, 97]


def test_eval_subset_disjoint(spark):
    rows = training.eval_subset(spark.range(10), "id", 3, disjoint=True)
    assert sorted(r["id"] for r in rows.where("split = 'eval'").collect()) == [0, 1, 2] and rows.count() == 10


def test_shuffled_order_is_that_of_the_hashes(spark):
    got = [r["id"] for r in sampling.shuffled(spark.range(500), "id").collect()]
    assert got == sorted(range(500), key=lambda i: (digest(i), i))
