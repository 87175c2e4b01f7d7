"""Gibberish score of a text, in integer tenths.

The score is the weight of the heaviest rule that fires, less a discount when a business
word occurs. All rules are native expressions: literals use ``contains``, a regex runs only
behind a cheap literal test where one exists, and ``CASE WHEN`` goes from heavy to light, so
most rules are skipped for texts that an earlier rule decides. Wide character classes stand
behind a single-range class, and runs are tried from their first character only.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brandsieve import fixed_values as V
from brandsieve.functions.text import contains_any, trim_ws

_GAP = f"{V.BLANK}+"
# Single ranges around the glyphs and the scripts.
_GLYPH_SPAN = r"[\x{2588}-\x{266F}]"
_SCRIPT_SPAN = r"[\x{0370}-\x{9FFF}]"


def rules(text: Column, low: Column) -> dict[str, Column]:
    """One boolean per rule; ``low`` is the lower-case text."""
    edge_before, edge_after = rf"(?<!{V.WORD})", rf"(?!{V.WORD})"
    return {
        "network": (
            (low.rlike(r"\p{Nd}\.\p{Nd}") & low.rlike(edge_before + V.IPV4 + edge_after))
            | low.contains("127.0.0.1")
            | (low.contains("localhost:") & low.rlike(r"localhost:\p{Nd}"))
            | (low.contains("://") & low.rlike(rf"https?://[^{V.BLANK_CLASS}]"))
            | contains_any(low, V.JAVA_PREFIXES)
            | (low.contains("install") & low.rlike(f"(?:{'|'.join(V.PACKAGE_MANAGERS)}){_GAP}install"))
        ),
        "repeated_char": text.rlike(r"([^\n])\1{10}"),
        "lorem": low.contains("lorem ipsum"),
        "code": (
            low.rlike(V.CODE_CHARS)
            | low.contains("console.log")
            | (low.contains("import") & low.rlike(f"import{V.BLANK}"))
            | (low.contains("from") & low.rlike(f"from{V.BLANK}"))
            | (low.contains("throw") & low.rlike(f"throw{_GAP}new"))
        ),
        "database": (
            contains_any(low, V.DATABASE_PRODUCTS)
            | (low.contains("db.") & low.rlike(r"db\.[a-z]+\."))
            | contains_any(low, [".find(", ".insert(", ".update("])
        ),
        "symbols": (
            low.contains(".....")
            | low.contains(",,,")
            | low.rlike(V.SHOUT_RUN)
            | low.rlike(V.RULE_RUN)
            | (low.rlike(_GLYPH_SPAN) & low.rlike(V.GLYPHS))
        ),
        "long_word": text.rlike(r"(?<!\S)\S{26}") & text.rlike(f"[^{V.BLANK_CLASS}]{{26}}"),
        "random": (
            low.rlike(V.LETTERS_ONLY)
            | low.rlike(V.DIGITS_ONLY)
            | low.rlike(V.SPECIAL_RUN)
            | low.rlike(V.MIXED_START)
        ),
        "few_letters": (F.char_length(text) > 10)
        & (F.char_length(F.regexp_replace(text, r"\P{L}+", "")) * 2 < F.char_length(text)),
        "scripts": low.rlike(_SCRIPT_SPAN) & low.rlike(V.SCRIPT_CHARS),
        "tech": contains_any(low, V.TECH_WORDS)
        | reduce(or_, [low.contains(a) & low.rlike(f"{a}{_GAP}{b}") for a, b in V.TECH_PHRASES]),
        "short": F.char_length(trim_ws(text)) < 10,
    }


def alnum_run(low: Column) -> Column:
    """A part of the random rule that never decides a score: such a run is a long word already."""
    return low.rlike("(?<![a-z0-9])" + V.ALNUM_RUN)


def business_word(low: Column) -> Column:
    return contains_any(low, V.BUSINESS_WORDS)


def _score(text: Column, low: Column) -> Column:
    fired = rules(text, low)
    by_weight: dict[int, list[Column]] = {}
    for name, weight in V.GIBBERISH_WEIGHTS.items():
        by_weight.setdefault(weight, []).append(fired[name])
    heaviest = F
    for weight in sorted(by_weight, reverse=True):
        heaviest = heaviest.when(reduce(or_, by_weight[weight]), weight)
    return heaviest.otherwise(0)


def add_gibberish_score(df: DataFrame, text_col: str, *, score_col: str = "score_tenths") -> DataFrame:
    """Add the score (0 to 10). A missing text counts as an empty one. No shuffle."""
    return (
        df.withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
        .withColumn("_low", F.lower("_text"))
        .withColumn("_heaviest", _score(F.col("_text"), F.col("_low")))
        .withColumn(
            score_col,
            F.when(F.col("_heaviest") == 0, 0)
            .when(business_word(F.col("_low")), F.greatest(F.col("_heaviest") - V.BUSINESS_DISCOUNT, F.lit(0)))
            .otherwise(F.col("_heaviest")),
        )
        .drop("_text", "_low", "_heaviest")
    )


def add_gibberish_rules(df: DataFrame, text_col: str, *, prefix: str = "rule_") -> DataFrame:
    """Add one boolean column per rule, plus the business-word test, for inspection."""
    prepared = df.withColumn("_text", F.coalesce(F.col(text_col), F.lit(""))).withColumn("_low", F.lower("_text"))
    low = F.col("_low")
    fired = rules(F.col("_text"), low)
    fired |= {"random": fired["random"] | alnum_run(low), "business": business_word(low)}
    return prepared.withColumns({prefix + name: test for name, test in fired.items()}).drop("_text", "_low")


def is_gibberish(score: Column) -> Column:
    return score > V.GIBBERISH_LIMIT


def low_quality(domains: Column) -> Column:
    """A generated list that is only fallbacks (an empty one too) or holds a generic word."""
    generic = F.exists(
        F.transform(domains, lambda d: F.lower(d)),
        lambda d: contains_any(d, V.GENERIC_WORDS),
    )
    return F.forall(domains, lambda d: d.isin(V.FALLBACK_DOMAINS)) | generic


def drop_low_quality(domains: Column) -> Column:
    return F.when(low_quality(domains), F.array().cast("array<string>")).otherwise(domains)
