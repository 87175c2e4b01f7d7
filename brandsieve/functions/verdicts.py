"""Read a judge model's free-text verdict: find the JSON, parse it, apply defaults, check it, roll it up."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brandsieve import fixed_values as V
from brandsieve.functions.text import fixed, let, trim_ws

_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
_VERDICT = "classification string, agrees_with_dataset string, domain_scores map<string,string>"
_CRITERIA = ", ".join(f"{c} double" for c in V.CRITERIA)
_REASONS = f"struct<{', '.join(f'{c}: double' for c in V.CRITERIA)}>"
_RATING = f"struct<domain: string, score: double, reasons: {_REASONS}>"


def unfenced(verdict: Column) -> Column:
    """What stands inside the first code fence, or the whole text when there is none."""
    text = trim_ws(verdict)
    return (
        F.when(
            text.contains("```json"),
            trim_ws(F.split_part(F.split_part(text, F.lit("```json"), F.lit(2)), F.lit("```"), F.lit(1))),
        )
        .when(text.contains("```"), trim_ws(F.split_part(text, F.lit("```"), F.lit(2))))
        .otherwise(text)
    )


def json_part(verdict: Column) -> Column:
    """The unfenced text from its first { to its last }."""
    return F.regexp_extract(unfenced(verdict), r"(?s)\{.*\}", 0)


def _domain_score(raw: Column) -> Column:
    """Mean of the five criteria, or the bare number; null when neither can be read.

    A criterion that is missing counts 0; one that is null or no number spoils the score.
    """
    both = F.struct(
        F.from_json(raw, f"{_CRITERIA}, _bad string", {**_STRICT, "columnNameOfCorruptRecord": "_bad"}).alias("rated"),
        F.map_keys(F.from_json(raw, "map<string,string>", _STRICT)).alias("names"),
    )

    def mean(parsed: Column) -> Column:
        rated = parsed["rated"]
        nulls = [F.array_contains(parsed["names"], c) & rated[c].isNull() for c in V.CRITERIA]
        whole = sum((F.coalesce(rated[c], F.lit(0.0)) for c in V.CRITERIA), F.lit(0.0)) / len(V.CRITERIA)
        return F.when(rated["_bad"].isNull() & ~reduce(or_, nulls), whole)

    mean = let(both, mean)
    return F.when(raw.startswith("{"), mean).otherwise(raw.try_cast("double"))


def _truth(flag: Column, named: Column) -> Column:
    """The flag as the reference takes it: true where it is missing, false where it is null, any
    other text by whether it says anything."""
    return F.when(~named, True).otherwise(F.coalesce(~flag.isin("false", "0", "0.0", ""), F.lit(False)))


def add_verdict(df: DataFrame, verdict_col: str) -> DataFrame:
    """Add classification, agrees_with_dataset, domain_scores, domain_quality_score and parse_ok.

    A verdict that cannot be read gets the default row (legitimate, agrees, score 0) with
    ``parse_ok`` false, so callers can tell it from a real one.
    """
    scores = F.transform(F.map_values("_v.domain_scores"), _domain_score)
    total = F.aggregate("_scores", F.lit(0.0), lambda acc, x: acc + x)
    readable = F.col("_json").startswith("{") & F.col("_v").isNotNull() & F.col("_bad").isNull()
    ok = readable & ~F.coalesce(F.exists("_scores", lambda x: x.isNull()), F.lit(False))
    empty = F.create_map().cast("map<string,string>")
    return (
        df.withColumn("_json", json_part(F.col(verdict_col)))
        .withColumn(
            "_v",
            F.from_json(
                "_json", _VERDICT + ", _bad string", {**_STRICT, "columnNameOfCorruptRecord": "_bad"}
            ),
        )
        .withColumn("_bad", F.col("_v._bad"))
        .withColumn(
            "_flagged",
            F.coalesce(
                F.array_contains(F.map_keys(F.from_json("_json", "map<string,string>", _STRICT)), "agrees_with_dataset"),
                F.lit(False),
            ),
        )
        .withColumn("_scores", scores)
        .withColumn("parse_ok", F.coalesce(ok, F.lit(False)))
        .withColumn(
            "classification",
            F.when(F.col("parse_ok"), F.coalesce("_v.classification", F.lit("legitimate"))).otherwise("legitimate"),
        )
        .withColumn(
            "agrees_with_dataset",
            F.when(F.col("parse_ok"), _truth(F.col("_v.agrees_with_dataset"), F.col("_flagged"))).otherwise(True),
        )
        .withColumn(
            "domain_scores", F.when(F.col("parse_ok"), F.coalesce("_v.domain_scores", empty)).otherwise(empty)
        )
        .withColumn(
            "domain_quality_score",
            F.when(F.col("parse_ok") & (F.size("_scores") > 0), total / F.size("_scores")).otherwise(0.0),
        )
        .drop("_json", "_v", "_bad", "_scores", "_flagged")
    )


def _in_range(entry: Column) -> Column:
    numbers = [entry["score"]] + [entry["reasons"][c] for c in V.CRITERIA]
    return reduce(and_, [n.isNotNull() & n.between(0.0, 1.0) for n in numbers])


def add_single_verdict(df: DataFrame, verdict_col: str) -> DataFrame:
    """Add ``valid`` and ``rating`` for one rated domain; an invalid verdict rates 0 everywhere."""
    parsed = F.from_json(unfenced(F.col(verdict_col)), _RATING, _STRICT)
    zero = F.struct(
        F.lit(0.0).alias("score"), F.struct(*[F.lit(0.0).alias(c) for c in V.CRITERIA]).alias("reasons")
    )
    return (
        df.withColumn("_entry", parsed)
        .withColumn("valid", F.coalesce(_in_range(F.col("_entry")), F.lit(False)))
        .withColumn(
            "rating",
            F.when(F.col("valid"), F.struct(F.col("_entry.score"), F.col("_entry.reasons"))).otherwise(zero),
        )
        .drop("_entry")
    )


def add_list_verdict(df: DataFrame, verdict_col: str) -> DataFrame:
    """Add ``valid`` and ``ratings`` for a verdict on a list of domains; one bad entry spoils the list."""
    text = unfenced(F.col(verdict_col))
    rated = (
        df.withColumn("_text", text)
        .withColumn("_entries", F.when(F.col("_text").startswith("["), F.from_json("_text", f"array<{_RATING}>", _STRICT)))
        .withColumn("valid", F.coalesce(F.forall("_entries", lambda e: F.coalesce(_in_range(e), F.lit(False))), F.lit(False)))
        .withColumn("ratings", F.when(F.col("valid"), F.col("_entries")))
        .drop("_text", "_entries")
    )
    return fixed(rated, "valid", "ratings")  # callers split on ``valid``
