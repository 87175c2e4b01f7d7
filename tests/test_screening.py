import pytest
from pyspark.sql import functions as F

from brandsieve.functions.unsafe import add_blocklist_check, add_keyword_check
from brandsieve.operators import screening
from brandsieve.operators.screening import add_gate, add_response, match_blocklist


@pytest.mark.parametrize(
    ("text", "category", "keyword"),
    [
        ("Adult education college", None, None),
        ("Adult shop", "explicit_sexual", "adult"),
        ("Weapon safety", None, None),
        ("weapon store", "violence", "weapon"),
        ("a new method", "drugs", "meth"),
        ("ponzi sex", "explicit_sexual", "sex"),
        ("adult school for murder", "violence", "murder"),
        ("ok", None, None),
    ],
)
def test_keywords(spark, text, category, keyword):
    row = add_keyword_check(spark.createDataFrame([(text,)], "t string"), "t").first()["unsafe"]
    assert (row["category"], row["detected_keyword"], row["is_unsafe"]) == (category, keyword, category is not None)
    assert row["method"] == ("length_check" if len(text) < 3 else "keyword_fallback")


@pytest.mark.parametrize(
    ("text", "censored"),
    [
        ("A Scam, really", "A ****, really"),
        ("scammer", None),
        ("anti-money-laundering", "anti-****"),
        ("Cheat-STEAL", "****-****"),
    ],
)
def test_blocklist(spark, text, censored):
    row = add_blocklist_check(spark.createDataFrame([(text,)], "t string"), "t").first()["unsafe"]
    assert (row["is_unsafe"], row["censored_version"]) == (censored is not None, censored)


@pytest.mark.parametrize("limit", [screening.BROADCAST_BYTES, -1])
def test_blocklist_table(spark, monkeypatch, limit):
    monkeypatch.setattr(screening, "BROADCAST_BYTES", limit)
    docs = spark.createDataFrame([(1, "a-b-c SCAM x"), (2, "nothing"), (3, "b-c"), (4, None)], "id long, t string")
    terms = spark.createDataFrame([("scam",), ("b-c",), ("B-C",)], "term string")
    got = {r["id"]: (r["n_terms"], r["first_term"]) for r in match_blocklist(docs, "t", "id", terms).collect()}
    assert got == {1: (2, "b-c"), 3: (1, "b-c")}


@pytest.mark.parametrize("limit", [screening.BROADCAST_BYTES, -1])
def test_blocklist_table_takes_terms_of_any_length(spark, monkeypatch, limit):
    monkeypatch.setattr(screening, "BROADCAST_BYTES", limit)
    rows = [(i, f"the word number {i}") for i in range(300)]  # hot words that are not listed
    rows += [(1000, "a four-part-Listed-TERM here"), (1001, "two words"), (1002, "two  words"), (1003, "part-listed-term")]
    docs = spark.createDataFrame(rows, "id long, t string")
    terms = spark.createDataFrame([("four-part-listed-term",), ("Two Words",), (None,), ("",)], "term string")
    got = {r["id"]: (r["n_terms"], r["first_term"]) for r in match_blocklist(docs, "t", "id", terms).collect()}
    assert got == {1000: (1, "four-part-listed-term"), 1001: (1, "two words")}


@pytest.mark.parametrize("limit", [screening.BROADCAST_BYTES, -1])
def test_blocklist_table_looks_for_long_terms_behind_their_first_word_only(spark, monkeypatch, limit):
    monkeypatch.setattr(screening, "BROADCAST_BYTES", limit)
    ten = "one two three four five six seven eight nine ten"
    rows = [(1, f"so {ten.upper()}."), (2, ten[:-1]), (3, f"{ten}th"), (4, "one"), (5, "one-two, one two"), (None, "x [a] ONE two"), (6, None)]
    docs = spark.createDataFrame(rows, "id long, t string").withColumns({c: F.lit(1) for c in ("_word", "_term", "_low", "_longer")})
    terms = spark.createDataFrame([(ten,), ("one two",), ("one",), ("one \\E two",), ("ten",)], "term string")
    got = {r["id"]: (r["n_terms"], r["first_term"]) for r in match_blocklist(docs, "t", "id", terms).collect()}
    assert got == {1: (4, "one"), 2: (2, "one"), 3: (2, "one"), 4: (1, "one"), 5: (2, "one"), None: (2, "one")}
    assert match_blocklist(docs, "t", "id", terms.limit(0)).count() == 0 == match_blocklist(docs.limit(0), "t", "id", terms).count()


def test_blocklist_table_refuses_terms_without_word_edges(spark):
    docs = spark.createDataFrame([(1, "x")], "id long, t string")
    with pytest.raises(Exception, match="unsupported term"):
        match_blocklist(docs, "t", "id", spark.createDataFrame([("$$",)], "term string")).collect()


def test_gate_order_and_messages(spark):
    rows = [(None, []), ("  ", []), ("sex {", ["NSFW_CONTENT_DETECTED"]), ("{a b c d e f}", []), ("Organic coffee shop", ["a.com"]), ("Organic coffee bar", ["SAFE_DOMAINS_UNAVAILABLE"])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, target_domains array<string>")
    got = add_response(add_gate(df, "t"), "t").orderBy("i").collect()
    assert [r["gate"] for r in got] == ["error", "error", "blocked", "filtered", "pass", "pass"]
    assert [r["status"] for r in got] == ["error", "error", "blocked", "filtered", "success", "blocked"]
    assert [r["http_code"] for r in got] == [500, 500, 200, 200, 200, 200]
    assert got[5]["message"] == "Unable to generate safe domain suggestions" and got[4]["message"] is None


def test_other_classifier_decides(spark):
    df = spark.createDataFrame([("plain text here", False), ("from { code", True)], "t string, ok boolean")
    assert [r["gate"] for r in add_gate(df, "t", legitimate=F.col("ok")).collect()] == ["filtered", "pass"]


def test_screening_does_not_shuffle(spark, sf_dir):
    from brandsieve.plans.catalog import QUERIES

    for name in ("gibberish_score", "nsfw_keyword", "extract_v4", "confidence_rank", "response_status", "batch_generation"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan, name
