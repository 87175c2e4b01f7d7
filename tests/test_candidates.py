import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brandsieve.functions import candidates as C
from brandsieve.functions.confidence import factors, suggestions, total, word_sets
from brandsieve.functions.unsafe import safe_domains


def one(spark, value, build, type_="string"):
    return spark.createDataFrame([(value,)], f"x {type_}").select(build(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("version", "response", "expected"),
    [
        ("v0", "- A.com\n• b.io!\nno name\n* A.com", ["a.com", "b.io"]),
        ("v0", "1. a.com", ["1. a.com"]),
        ("v0", "x.co\n" + "y" * 30 + ".com\nz.ai\nq.io\nr.io", ["x.co", "z.ai", "q.io"]),
        ("v1", "1. a.com\nstartup.ai\nDomain: B.io", ["a.com", "b.io", "domain3.com"]),
        ("v1", "", ["domain1.com", "domain2.com", "domain3.com"]),
        ("v2", "  ", []),
        ("v2", "none here", ["domain1.com"]),
        ("v2", "Startup.ai", ["startup.ai", "domain2.com", "domain3.com"]),
        ("v3", "the assistant says assistant\n a.com, B.io , startup.ai", ["a.com", "b.io", "domain3.com"]),
        ("v3", "2. a.com\nb.io.", ["a.com", "b.io", "domain3.com"]),
        ("v3", "Startup.ai", ["domain1.com", "domain2.com", "domain3.com"]),
        ("v4", '1. Foo.com\n2) bar.health | - "baz.io"', ["Foo.com", "bar.heal", "baz.io"]),
        ("v4", "Domains:\nmail.example.com, mail.example.com", ["mail.exam", "mail.exam", "domain3.com"]),
        ("v4", "nothing", ["domain1.com", "domain2.com", "domain3.com"]),
        ("v4", "-foo.com\n--bar.io", ["foo.com", "domain2.com", "domain3.com"]),
        ("v4", "a.com,b.com,c.com,d.com", ["a.com", "b.com", "c.com"]),
    ],
)
def test_extraction(spark, version, response, expected):
    assert one(spark, response, C.EXTRACTORS[version]) == expected


def test_long_run_without_dot_is_linear(spark):
    assert one(spark, "x." + "a" * 200_000, C.extract_v4)[0] == "x.aaaa"
    assert one(spark, "a" * 200_000 + " .", C.extract_v4)[0] == "domain1.com"


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(alphabet="ab.- ,\n|1\"'", max_size=30), min_size=40, max_size=60))
def test_three_names_or_fewer(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    sizes = df.select(*[F.size(f(F.col("x"))).alias(v) for v, f in C.EXTRACTORS.items()]).collect()
    assert all(r["v0"] <= 3 and r["v1"] == 3 and r["v2"] in (0, 1, 3) and r["v3"] == 3 and r["v4"] == 3 for r in sizes)


def test_prompt_and_header(spark):
    df = spark.createDataFrame([("PQ a.com", "PQ")], "r string, p string")
    assert df.select(C.strip_prompt(F.col("r"), F.col("p"))).first()[0] == "a.com"
    text = "x<|start_header_id|>assistant<|end_header_id|>\n a.com "
    assert one(spark, text, C.assistant_section) == "a.com"
    assert one(spark, " plain ", C.assistant_section) == " plain "


def test_keyword_fallback(spark):
    text = "Telemedicine platform that connects, with licensed therapists."
    assert one(spark, text, lambda c: C.keyword_fallback(c, 4)) == ["telemedi.com", "connects.co", "licensed.ai", "therapis.io"]
    assert one(spark, "a b", C.keyword_fallback) == ["startup0.com", "startup1.com", "startup2.com"]


@pytest.mark.parametrize(
    ("name", "valid"),
    [("a.com", True), ("a-b.io", True), ("-a.com", False), ("a.b.com", False), ("a.c", False), ("a" * 60 + ".com", False)],
)
def test_domain_format(spark, name, valid):
    assert one(spark, name, C.valid_domain) is valid


@pytest.mark.parametrize(
    ("domain", "text", "expected"),
    [
        ("organicbrew.com", "organic coffee shop in downtown area", (1000, 1000, 200, 1000, 1000, 800)),
        ("downtowncoffee.org", "organic coffee shop in downtown area", (1000, 1000, 400, 900, 1000, 830)),
        ("coffee.io", "organic coffee shop", (800, 1000, 600, 850, 700, 780)),
        ("k9-3d-prrrnt.shop", "3D printing service", (1000, 200, 0, 400, 400, 350)),
        ("", "x", (300, 1000, 0, 400, 1000, 525)),
        ("trckr.net", "Blockchain-based supply chain tracking system", (600, 1000, 0, 800, 400, 530)),
    ],
)
def test_confidence(spark, domain, text, expected):
    df = spark.createDataFrame([(domain, text)], "d string, t string").withColumn("s", word_sets(F.col("t")))
    f = df.withColumn("f", factors(F.col("d"), F.col("s"))).select("f.*", total(F.col("f")).alias("total")).first()
    assert tuple(f) == expected


def test_suggestions_are_sorted_and_stable(spark):
    df = spark.createDataFrame([(["b.xyz", "coffee.io", "q.xyz"], "organic coffee shop")], "d array<string>, t string")
    got = df.select(suggestions(F.col("d"), F.col("t")).alias("s")).first()["s"]
    assert [s["domain"] for s in got] == ["coffee.io", "b.xyz", "q.xyz"]
    assert got[0]["confidence"] == 0.78


def test_second_screening(spark):
    assert one(spark, ["a.com", "SexShop.com"], safe_domains, "array<string>") == ["a.com"]
    assert one(spark, ["kkk.com"], safe_domains, "array<string>") == ["SAFE_DOMAINS_UNAVAILABLE"]
    assert one(spark, [], safe_domains, "array<string>") == ["SAFE_DOMAINS_UNAVAILABLE"]
