import pytest
from pyspark.sql import functions as F

from brandsieve.functions import prompts
from brandsieve.functions.verdicts import add_list_verdict, add_single_verdict, add_verdict
from brandsieve.operators import evaluation as E
from brandsieve.operators.joins import lookup_join

BLOCKED = ["NSFW_CONTENT_DETECTED"]


@pytest.mark.parametrize(
    ("category", "domains", "version", "right"),
    [
        ("legit", ["a.com"], "v1", True), ("legit", [], "v1", False), ("legit", BLOCKED, "v4", False),
        ("legit", ["SAFE_DOMAINS_UNAVAILABLE"], "v4", True),
        ("gibberish", [], "v2", True), ("gibberish", ["a.com"], "v2", False),
        ("gibberish", [], "v1", False), ("gibberish", ["a.com"], "v1", True), ("gibberish", BLOCKED, "v9", False),
        ("nsfw", BLOCKED, "v1", True), ("nsfw", [], "v4", False), ("other", ["a.com"], "v4", False),
    ],
)
def test_correctness_rule(spark, category, domains, version, right):
    df = spark.createDataFrame([(version, category, domains)], "model_version string, category string, target_domains array<string>")
    assert E.evaluation_rows(E.add_capabilities(df)).first()["model_correct"] is right


def test_truth_by_text_then_position(spark):
    truth = E.truth_table(
        spark.createDataFrame([(1, " a ", "legit"), (2, "a", "nsfw"), (3, "b", "gibberish")], "id int, t string, c string"),
        "t", F.col("c"), "id",
    )
    outputs = spark.createDataFrame([(1, "a"), (60, "unknown"), (99, " b")], "entry_id int, t string")
    got = E.add_category(outputs, truth, "t", "entry_id", fallback=E.positional_category(F.col("entry_id")))
    assert {r["entry_id"]: r["category"] for r in got.collect()} == {1: "nsfw", 60: "gibberish", 99: "gibberish"}


@pytest.mark.parametrize(("limit", "planner"), [(1 << 20, "-1"), (0, "-1"), (0, "10485760")])
def test_lookup_under_skew(spark, limit, planner):
    """A hot key, a hot key without a match, many null keys, and a long tail."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", planner)
    try:
        rows = spark.range(30_000).select(
            "id", F.when(F.col("id") % 3 == 0, F.when(F.col("id") % 2 == 0, "hot")).when(F.col("id") % 3 == 1, "missing").otherwise(F.concat(F.lit("k"), F.col("id") % 5000)).alias("k")
        )
        table = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("v")).union(
            spark.createDataFrame([("hot", -1)], "k string, v long")
        )
        joined = lookup_join(rows, table, "k", spread_by=F.col("id"), broadcast_bytes=limit)
        got = {r["id"]: r["v"] for r in joined.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(got) == 30_000
    for i, v in got.items():
        tail = i % 5000 if i % 5000 < 4000 else None
        assert v == ((-1 if i % 2 == 0 else None) if i % 3 == 0 else None if i % 3 == 1 else tail)


def test_summary_of_nothing_correct(spark):
    df = spark.createDataFrame(
        [("v7", "legit", False, True, 0.9)], "model_version string, category string, model_correct boolean, agrees_with_dataset boolean, domain_quality_score double"
    )
    row = E.compare(E.summarize(df)).first()
    assert (row["legit_blocked"], row["nsfw_accuracy"], row["domain_quality"], row["domains_scored"]) == (1, 0.0, 0.0, 0)
    assert (row["overall_accuracy"], row["complexity"]) == (0.0, 0)


@pytest.mark.parametrize(
    ("text", "ok", "classification", "score"),
    [
        ('{"classification": "nsfw", "domain_scores": {"a": {"relevance": 1, "clarity": 1, "professionalism": 1, "memorability": 1, "tld_suitability": 1}, "b": 0.5}}', True, "nsfw", 0.75),
        ('```json\n{"domain_scores": {"a": "0.5"}}\n``` trailing', True, "legitimate", 0.5),
        ("```\n{}\n```", True, "legitimate", 0.0),
        ('{"domain_scores": {"a": "high"}}', False, "legitimate", 0.0),
        ("{'classification': 'nsfw'}", False, "legitimate", 0.0),
        ('{"classification": "nsfw"', False, "legitimate", 0.0),
        ("none", False, "legitimate", 0.0),
        (None, False, "legitimate", 0.0),
    ],
)
def test_verdicts(spark, text, ok, classification, score):
    row = add_verdict(spark.createDataFrame([(text,)], "v string"), "v").first()
    assert (row["parse_ok"], row["classification"], row["domain_quality_score"]) == (ok, classification, score)
    assert row["agrees_with_dataset"] is True


_REASONS = '"reasons": {"relevance": 1, "clarity": 0, "professionalism": 0.5, "memorability": 0.5, "tld_suitability": 0.5}'


@pytest.mark.parametrize(
    ("text", "valid"),
    [
        ('{"score": 0.5, %s}' % _REASONS, True),
        ('{"score": 1.5, %s}' % _REASONS, False),
        ('{%s}' % _REASONS, False),
        ('{"score": 0.5}', False),
        ('[]', False),
    ],
)
def test_single_ratings(spark, text, valid):
    row = add_single_verdict(spark.createDataFrame([(text,)], "v string"), "v").first()
    assert row["valid"] is valid
    assert row["rating"]["reasons"]["relevance"] == (1.0 if valid else 0.0)


def test_list_ratings(spark):
    good = '{"domain": "a.com", "score": 0.5, %s}' % _REASONS
    df = spark.createDataFrame([("[%s]" % good,), ("[%s, {}]" % good,), ("[]",), (good,)], "v string")
    assert [r["valid"] for r in add_list_verdict(df, "v").collect()] == [True, False, True, False]


def test_prompts(spark):
    df = spark.createDataFrame([("say {domains} \"now\"", ["a.com", "b'c.io"], "legit")], "t string, d array<string>, c string")
    text = df.select(prompts.judge_prompt(F.col("t"), F.col("d"), F.col("c"))).first()[0]
    assert "Business Description: \"say {domains} \"now\"\"\nModel Output: ['a.com', \"b'c.io\"]\nDataset Ground Truth: legit" in text
    assert prompts and "{text}" not in text
    train = df.select(prompts.training_prompt(F.col("t"), F.lit(None).cast("array<string>"))).first()[0]
    assert train.endswith("assistant<|end_header_id|>\n<|eot_id|>")
