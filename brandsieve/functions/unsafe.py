"""Unsafe-content rules: an ordered keyword list with safe contexts, and a whole-word blocklist."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brandsieve import fixed_values as V
from brandsieve.functions.text import contains_any, let, trim_ws


def _keyword_hits(low: Column):
    """(category, keyword, test) in the order in which a text is checked."""
    for category, keywords in V.UNSAFE_KEYWORDS.items():
        for keyword in keywords:
            test = low.contains(keyword)
            if keyword in V.SAFE_CONTEXTS:
                test = test & ~contains_any(low, V.SAFE_CONTEXTS[keyword])
            yield category, keyword, test


def keyword_index(low: Column) -> Column:
    """1-based position of the first keyword that fires, 0 for none."""
    chain = F
    for i, (_, _, test) in enumerate(_keyword_hits(low), 1):
        chain = chain.when(test, i)
    return chain.otherwise(0)


def _names() -> list[tuple[str, str]]:
    return [(c, k) for c, keywords in V.UNSAFE_KEYWORDS.items() for k in keywords]


def add_keyword_check(df: DataFrame, text_col: str, *, out_col: str = "unsafe") -> DataFrame:
    """Add the result struct of the keyword rules. A missing text counts as an empty one. No shuffle."""
    categories = F.array(*[F.lit(c) for c, _ in _names()])
    keywords = F.array(*[F.lit(k) for _, k in _names()])
    hit, short = F.col("_hit") > 0, F.col("_short")
    category = F.when(hit, F.get(categories, F.col("_hit") - 1))
    keyword = F.when(hit, F.get(keywords, F.col("_hit") - 1))
    return (
        df.withColumn("_low", F.lower(trim_ws(F.coalesce(F.col(text_col), F.lit("")))))
        .withColumn("_short", F.char_length("_low") < V.UNSAFE_MIN_CHARS)
        .withColumn("_hit", F.when(short, 0).otherwise(keyword_index(F.col("_low"))))
        .withColumn(
            out_col,
            F.struct(
                hit.alias("is_unsafe"),
                F.when(short, V.REASON_SHORT)
                .when(hit, F.concat(F.lit("Contains inappropriate content ("), category, F.lit("): '"), keyword, F.lit("'")))
                .otherwise(V.REASON_SAFE)
                .alias("reason"),
                F.when(short, V.METHOD_SHORT).otherwise(V.METHOD_KEYWORD).alias("method"),
                category.alias("category"),
                keyword.alias("detected_keyword"),
                F.lit(None).cast("string").alias("censored_version"),
            ),
        )
        .drop("_low", "_short", "_hit")
    )


def _any_word(terms: Iterable[str]) -> str:
    """Case-blind regex for any of the terms as whole words."""
    joined = "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True))
    return rf"(?iu)(?<!{V.WORD})(?:{joined})(?!{V.WORD})"


def censored(text: Column, terms: Iterable[str] = tuple(V.BLOCKLIST)) -> Column:
    """The text with every listed whole word replaced by a mask."""
    return F.regexp_replace(text, _any_word(terms), V.CENSOR_MASK)


def add_blocklist_check(
    df: DataFrame, text_col: str, *, terms: Iterable[str] = tuple(V.BLOCKLIST), out_col: str = "unsafe"
) -> DataFrame:
    """Add the result struct of a whole-word check against a short literal list. No shuffle.

    For a list kept as a table use :func:`brandsieve.operators.screening.match_blocklist`.
    """
    terms = list(terms)
    # The literal tests settle most texts; the boundary regex only confirms.
    listed = contains_any(F.col("_low"), [t.lower() for t in terms]) & F.col("_clean").rlike(_any_word(terms))
    short = F.col("_short")
    return (
        df.withColumn("_clean", trim_ws(F.coalesce(F.col(text_col), F.lit(""))))
        .withColumn("_low", F.lower("_clean"))
        .withColumn("_short", F.char_length("_clean") < V.UNSAFE_MIN_CHARS)
        .withColumn("_listed", ~short & listed)
        .withColumn(
            out_col,
            F.struct(
                F.col("_listed").alias("is_unsafe"),
                F.when(short, V.REASON_SHORT)
                .when(F.col("_listed"), V.REASON_LISTED)
                .otherwise(V.REASON_NOT_LISTED)
                .alias("reason"),
                F.when(short, V.METHOD_SHORT).otherwise(V.METHOD_LISTED).alias("method"),
                F.lit(None).cast("string").alias("category"),
                F.lit(None).cast("string").alias("detected_keyword"),
                F.when(F.col("_listed"), censored(F.col("_clean"), terms)).alias("censored_version"),
            ),
        )
        .drop("_clean", "_low", "_short", "_listed")
    )


def safe_domains(domains: Column) -> Column:
    """Drop the candidates that a keyword rule rejects; none left gives the no-safe marker.

    One look at all names together decides whether any needs the rules.
    """
    screened = F.transform(
        F.filter(
            F.transform(domains, lambda d: F.struct(d.alias("name"), F.lower(trim_ws(d)).alias("low"))),
            lambda d: (F.char_length(d["low"]) < V.UNSAFE_MIN_CHARS) | (keyword_index(d["low"]) == 0),
        ),
        lambda d: d["name"],
    )
    keywords = dict.fromkeys(k for _, k in _names())
    together = F.lower(F.array_join(domains, "\n"))
    suspect = let(together, lambda low: reduce(or_, [low.contains(k) for k in keywords]))
    kept = F.when(suspect, screened).otherwise(F.array_compact(domains))
    return let(kept, lambda k: F.when(F.size(k) == 0, F.array(F.lit(V.NO_SAFE_MARK))).otherwise(k))
