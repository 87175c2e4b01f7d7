import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brandsieve import fixed_values as V
from brandsieve.functions.gibberish import add_gibberish_rules, add_gibberish_score, drop_low_quality, low_quality

GOLDEN = [
    ("Hand-made soap and candles sold at weekly markets", 0),
    ("host v127.0.0.1 is down now", 9),
    ("see 127.0.0.1234 there today", 9),
    ("A startup that sells blockchain ledgers", 1),
    ("price <= 12 and stock > 3;", 8),
    ("AI", 3),
    ("中国菜餐厅", 4),
    ("https://a.b/c startup", 7),
    ("Farm-to-table dinners made from local produce", 8),
    ("", 3),
    (None, 3),
]


def scores(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = add_gibberish_score(df, "text").orderBy("i").collect()
    return [r["score_tenths"] for r in rows]


def test_golden_scores(spark):
    assert scores(spark, [t for t, _ in GOLDEN]) == [s for _, s in GOLDEN]


def slow_score(text):
    """Direct reading of the rules with Python's regexes: the maximum over all of them."""
    low = text.lower()

    def any_of(*patterns):
        return any(re.search(p, low) for p in patterns)

    phrases = [rf"{a}\s+{b}" for a, b in V.TECH_PHRASES]
    fired = {
        "network": any_of(r"\b\d{1,3}(\.\d{1,3}){3}\b", r"localhost:\d|127\.0\.0\.1", r"https?://\S", r"(npm|pip|apt)\s+install")
        or any(p in low for p in V.JAVA_PREFIXES),
        "repeated_char": re.search(r"(.)\1{10,}", text),
        "lorem": "lorem ipsum" in low,
        "code": any_of(r"[{}\[\]<>()=;]", r"console\.log", r"import\s", r"from\s", r"throw\s+new"),
        "database": any_of(*V.DATABASE_PRODUCTS, r"db\.[a-z]+\."),
        "symbols": any_of(r"[!?]{5,}", r"\.{5,}", r",{3,}", r"[_\-]{5,}", V.GLYPHS),
        "long_word": any(len(w) > 25 for w in text.split()),
        "random": any_of(r"^[a-z]{20,}$", r"^[0-9]{10,}$", r"[!@#$%^&*()_+]{5,}", r"[a-z0-9]{30,}", r"^\w{3,}\d{3,}\w{3,}"),
        "few_letters": len(text) > 10 and sum(c.isalpha() for c in text) / len(text) < 0.5,
        "scripts": any_of("[ऀ-ॿ֐-׿؀-ۿ一-鿿぀-ヿЀ-ӿͰ-Ͽ฀-๿]"),
        "tech": any_of(*[re.escape(w) for w in V.TECH_WORDS], *phrases),
        "short": len(text.strip()) < 10,
    }
    best = max((V.GIBBERISH_WEIGHTS[name] for name, hit in fired.items() if hit), default=0)
    return max(0, best - 2) if any(w in low for w in V.BUSINESS_WORDS) else best


PIECES = st.sampled_from(
    [
        " ", " ", "　", "\n", "\t", "\r", "word", "Business", "app", "from", "import", "neural", "network", "npm", "install",
        "127.0.0.1", "1.2.3", "localhost:", "http://", "aaaaaaaaaaa", "zzzzzzzzzz", "{", ";", "!!!", "??", "..", "...", ",,",
        "--", "___", "♠", "█", "मानक", "中", "Ж", "é", "abc123abc", "0123456789", "qwertyuiopasdfghjklz", "lorem ipsum",
        "db.x.", "redis", "malloc", "java.", "@#$", "%^",
    ]
)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.lists(PIECES, max_size=9).map("".join), min_size=60, max_size=120))
def test_against_direct_reading(spark, texts):
    got = scores(spark, texts)
    assert [(t, g) for t, g in zip(texts, got)] == [(t, slow_score(t)) for t in texts]
    assert all(0 <= g <= 10 for g in got)


def test_rules_name_what_fired(spark):
    df = spark.createDataFrame([("x" * 12 + " {lorem ipsum}",)], "text string")
    row = add_gibberish_rules(df, "text").first()
    assert row["rule_repeated_char"] and row["rule_code"] and row["rule_lorem"] and not row["rule_scripts"]


@pytest.mark.parametrize(
    ("domains", "bad"),
    [([], True), (["domain1.com", "domain3.com"], True), (["domain1.com", "a.com"], False), (["a.com", "MyTest.io"], True)],
)
def test_low_quality(spark, domains, bad):
    df = spark.createDataFrame([(domains,)], "d array<string>")
    row = df.select(low_quality(F.col("d")).alias("bad"), drop_low_quality(F.col("d")).alias("kept")).first()
    assert row["bad"] is bad
    assert row["kept"] == ([] if bad else domains)


def test_blank_set_is_the_unicode_one():
    blanks = {chr(c) for c in range(0x3001) if chr(c).isspace()}
    assert set(V.BLANKS) == blanks
    assert all(unicodedata.category(c) in {"Cc", "Zs", "Zl", "Zp"} for c in V.BLANKS)
