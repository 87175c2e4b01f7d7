"""Inputs of the registered queries, derived by Spark from the given tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brandsieve import fixed_values as V
from brandsieve.functions.text import no_strings, strings


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_remainder(id_: Column, variants: Sequence[Column]) -> Column:
    """Variant number ``id % len(variants)``."""
    chosen = F
    for i, variant in enumerate(variants):
        chosen = chosen.when(id_ % len(variants) == i, variant)
    return chosen


def noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents with a disturbance around them that makes each gibberish rule fire for some."""
    text = F.col("text")

    def before(prefix: str, body: Column = text) -> Column:
        return F.concat(F.lit(prefix), body)

    def after(suffix: str) -> Column:
        return F.concat(text, F.lit(suffix))

    return table(spark, sf_dir, "documents").select(
        "doc_id",
        "lang",
        by_remainder(
            F.col("doc_id"),
            [
                after(" 10.20.30.40"),
                before("aaaaaaaaaaaa "),
                before("Lorem ipsum "),
                after(" {x}"),
                after(" redis db.users.find"),
                after(" what!!!!!"),
                F.replace(text, F.lit(" "), F.lit("_")),
                F.lower(F.regexp_replace(text, "[^a-zA-Z]", "")),
                before("12 12 ", F.regexp_replace(text, "[a-zA-Z]", "")),
                before("Привет "),
                before("Blockchain "),
                F.char_length(text).cast("string"),
                before("Startup app "),
                before("npm   install "),
                before("abc12345xyz "),
                before("http://x.y startup "),
                before("console.log import os "),
                before("machine  learning "),
                after(" ,,, "),
                text,
                before("host v127.0.0.1 is down now "),
                after(" see 127.0.0.1234 there today"),
                F.lpad(F.char_length(text).cast("string"), 12, "0"),
            ],
        ).alias("text"),
    )


def unsafe_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with phrases that meet the unsafe-content rules and their exceptions, and short texts besides."""
    phrases = [
        "adult education course", "adult shop", "weapon safety training", "weapon store", "money-laundering",
        "anti-money-laundering desk", "SCAM!", "exploit", "cheating", "a pyramid scheme", "illegal-criminal mix",
        "method chateau", "bomb", "meth dealer", "", "x",
    ]
    doc_id, text = F.col("doc_id"), F.col("text")
    docs = table(spark, sf_dir, "documents")
    marked = docs.select("doc_id", F.concat(text, F.lit(" "), by_remainder(doc_id, [F.lit(p) for p in phrases])).alias("text"))
    short = docs.where(doc_id % 16 == 15).select((-1 - doc_id).alias("doc_id"), F.lit(" x ").alias("text"))
    return marked.unionByName(short)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, key = F.col("p_name"), F.col("p_partkey")
    joined = F.replace(name, F.lit(" "), F.lit(""))

    def ending(stem: Column, tail: str) -> Column:
        return F.concat(stem, F.lit(tail))

    return table(spark, sf_dir, "part").select(
        key.alias("entry_id"),
        F.concat(name, F.lit(" "), F.lower("p_type"), F.lit(" shop")).alias("description"),
        by_remainder(
            key,
            [
                ending(joined, ".com"),
                ending(joined, ".org"),
                ending(joined, ".net"),
                ending(joined, ".io"),
                ending(F.split_part(name, F.lit(" "), F.lit(1)), ".ai"),
                ending(joined, ".co"),
                ending(F.split_part(name, F.lit(" "), F.lit(2)), ".app"),
                ending(joined, "online.tech"),
                ending(joined, ".biz"),
                ending(joined, ".info"),
                F.concat(F.replace(name, F.lit(" "), F.lit("-")), F.lit("-"), F.col("p_size").cast("string"), F.lit(".com")),
                ending(joined, "zzz.shop"),
                ending(F.substring(name, 1, 3), "mrkt.health"),
            ],
        ).alias("domain"),
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw answers in the shapes that models produce."""
    d = F.col("domain")

    def say(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    return candidates(spark, sf_dir).withColumn(
        "response",
        by_remainder(
            F.col("entry_id"),
            [
                say("1. ", d, "\n2. alt-", d, "\n3. my", d),
                say("- ", F.upper(d), "\n* ", d, "\nDomain: get", d, "!"),
                say(d, ", go", d, ", ", d, "."),
                say('Domains:\n"', d, "\" | 'x", d, "'"),
                say("businessname.com\nstartup.ai\n", d),
                F.lit("No suggestion for this input"),
                F.lit(""),
                say("user question assistant\n", d, "\nerror-", d),
            ],
        ),
    )


# {d} and {e} stand for digits of the row's key, so that numbers differ from row to row.
_RATED = (
    '{"relevance": 0.{d}, "clarity": 0.{e}, "professionalism": 0.7, "memorability": 0.6{d}, "tld_suitability": 1}'
)
VERDICTS = [
    '{"classification": "legitimate", "agrees_with_dataset": true, "domain_scores": {"a.com": ' + _RATED + "}}",
    '```json\n{"classification": "gibberish", "agrees_with_dataset": false, "domain_scores": {}}\n```',
    '```\n{"classification": "nsfw", "domain_scores": {"a.com": 0.{d}5, "b.ai": 0.{e}}}\n```',
    'Here is my answer: {"agrees_with_dataset": true, "domain_scores": {"a.com": {"relevance": 0.{e}, "clarity": 0.5}}} '
    "Thanks.",
    '{"classification": "legitimate", "domain_scores": {"a.com": ' + _RATED.replace("0.7", "1.{d}") + "}}",
    "I cannot rate this.",
    '{"classification": "nsfw", "agrees_with_dataset": "yes", "domain_scores": {"c.io": 0.{d}}}',
    '{"classification": "nsfw", "domain_scores": {"a.com": ' + _RATED.replace("0.{d},", "null,") + "}}",
    '{"classification": "nsfw", "domain_scores": {"a.com": ' + _RATED.replace("0.{e},", '"0.{e}",') + "}}",
    '{"classification": "gibberish", "agrees_with_dataset": null, "domain_scores": {"a.com": ' + _RATED + "}}",
]

_FULL = (
    '"score": 0.{d}, "reasons": {"relevance": 0.25, "clarity": 0.{e}, "professionalism": 0.75, "memorability": 1, '
    '"tld_suitability": 0}'
)
RATINGS = [
    "{" + _FULL + "}",
    "```json\n{" + _FULL + "}\n```",
    "```\n{" + _FULL.replace("0.75", "1.75") + "}\n```",
    "{" + _FULL.replace('"clarity": 0.{e}, ', "") + "}",
    "{" + _FULL.replace("0.25", '"high"') + "}",
    "not rated",
]
LIST_RATINGS = [
    '[{"domain": "a.com", ' + _FULL + '}, {"domain": "b.ai", ' + _FULL + "}]",
    '```json\n[{"domain": "a.com", ' + _FULL + '}, {"domain": "b.ai", ' + _FULL + "}]\n```",
    '[{"domain": "a.com", ' + _FULL + '}, {"domain": "b.ai", "score": 0.{d}}]',
    "{" + _FULL + "}",
    "not rated",
]


def with_digits(key: Column, templates: Sequence[str]) -> Column:
    """The row's template, with the last digits of the key in it."""
    chosen = by_remainder(key, [F.lit(t) for t in templates])
    chosen = F.replace(chosen, F.lit("{d}"), (key % 10).cast("string"))
    return F.replace(chosen, F.lit("{e}"), (F.floor(key / 10) % 10).cast("string"))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc_id = F.col("doc_id")
    return table(spark, sf_dir, "labels").select("doc_id", with_digits(doc_id, VERDICTS).alias("verdict"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One single-domain rating and one list rating per candidate."""
    key = F.col("entry_id")
    return candidates(spark, sf_dir).select(
        "entry_id",
        "description",
        F.array(F.lit("a.com"), F.lit("b.ai"), F.col("domain")).alias("domains"),
        with_digits(key, RATINGS).alias("rating_text"),
        with_digits(key, LIST_RATINGS).alias("list_text"),
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their category: from the labels, and by position."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    place = F.col("doc_id") % 100
    return docs.join(labels, "doc_id", "left").select(
        (F.col("doc_id") + 1).alias("entry_id"),
        F.col("text").alias("business_description"),
        "lang",
        F.when(F.col("toxic") == 1, "nsfw")
        .when(F.col("quality") == 0, "gibberish")
        .when(F.col("quality").isNotNull(), "legit")
        .alias("gt_category"),
        F.when(place < 50, "legit").when(place < 80, "gibberish").otherwise("nsfw").alias("positional_category"),
    )


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of five model versions for every document, with a judge's verdict text."""
    docs = table(spark, sf_dir, "documents")
    entry_id, place = F.col("doc_id") + 1, F.col("doc_id") % 100
    versions = F.array(
        *[F.struct(F.lit(v).alias("model_version"), F.lit(i).alias("v")) for i, v in enumerate(V.CAPABILITIES)]
    )
    stem = F.concat(F.lit("d"), F.col("entry_id").cast("string"))
    blocked, unavailable = F.array(F.lit(V.BLOCKED_MARK)), F.array(F.lit(V.NO_SAFE_MARK))
    named = F.array(F.concat(stem, F.lit(".com")), F.concat(stem, F.lit(".io")), F.concat(stem, F.lit(".ai")))
    return docs.select(
        entry_id.alias("entry_id"),
        F.col("text").alias("business_description"),
        F.when(place < 50, "legit").when(place < 80, "gibberish").otherwise("nsfw").alias("positional_category"),
        with_digits(entry_id, VERDICTS).alias("verdict"),
        F.inline(versions),
    ).select(
        "model_version",
        "entry_id",
        "business_description",
        "positional_category",
        "verdict",
        by_remainder(
            F.col("entry_id") * 3 + F.col("v"),
            [no_strings(), blocked, no_strings(), blocked, unavailable, named, named],
        ).alias("target_domains"),
    )


def request_text(event_id: Column) -> Column:
    plain = F.translate("props", '{}":', "")
    return (
        F.when(event_id % 10 == 0, F.lit("   "))
        .when(event_id % 10 == 1, F.lit(None).cast("string"))
        .when(event_id % 10 == 2, F.concat_ws(" ", "event_type", "props"))
        .when(event_id % 10 == 3, F.concat(F.col("event_type"), F.lit(" adult shop "), plain))
        .otherwise(F.concat(F.col("event_type"), F.lit(" service for "), F.col("user_id").cast("string"), F.lit(" shops "), plain))
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", request_text(F.col("event_id")).alias("business_description")
    )


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents in the shape of a training set."""
    doc_id = F.col("doc_id")
    good = F.col("quality") == 1
    stem = F.concat(F.lit("d"), doc_id.cast("string"))
    return (
        table(spark, sf_dir, "documents")
        .join(table(spark, sf_dir, "labels"), "doc_id")
        .select(
            "doc_id",
            F.col("text").alias("business_description"),
            F.when(good, F.array(F.concat(stem, F.lit(".com")), F.concat(stem, F.lit(".io"))))
            .otherwise(strings([]))
            .alias("target_domains"),
            F.when(good & (doc_id % 3 == 0), "paraphrase")
            .when(good, "original")
            .when(doc_id % 7 == 0, "scraped")
            .otherwise("gibberish")
            .alias("source"),
        )
    )
