"""Gates and routing: from a description to a response status, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brandsieve import fixed_values as V
from brandsieve.functions.candidates import EXTRACTORS
from brandsieve.functions.confidence import suggestions
from brandsieve.functions.gibberish import add_gibberish_score, is_gibberish
from brandsieve.functions.text import fixed, let, no_strings, trim_ws, words
from brandsieve.functions.unsafe import add_keyword_check, safe_domains
from brandsieve.operators.joins import BROADCAST_BYTES, lookup_join, measured_bytes
from brandsieve.session import written_once


def add_gate(df: DataFrame, text_col: str, *, legitimate: Column | None = None) -> DataFrame:
    """Add ``gate``: error (no text), blocked (unsafe), filtered (gibberish) or pass, in that order.

    ``legitimate`` replaces the gibberish rules by another decision, for example the label
    column of :func:`brandsieve.operators.classifier.add_prediction`.
    """
    blank = trim_ws(F.coalesce(F.col(text_col), F.lit(""))) == ""
    checked = add_keyword_check(df, text_col, out_col="_unsafe")
    if legitimate is None:
        checked = add_gibberish_score(checked, text_col, score_col="_score")
        legitimate = ~is_gibberish(F.col("_score"))
    return checked.withColumn(
        "gate",
        F.when(blank, "error").when(F.col("_unsafe.is_unsafe"), "blocked").when(legitimate, "pass").otherwise("filtered"),
    ).drop("_unsafe", "_score")


def only_legitimate(df: DataFrame, text_col: str) -> DataFrame:
    """Rows whose text is not gibberish; the explicit filter to put before a model."""
    scored = fixed(add_gibberish_score(df, text_col, score_col="_score"), "_score")
    return scored.where(~is_gibberish(F.col("_score"))).drop("_score")


def add_domains(
    df: DataFrame, response_col: str, *, extract: Callable[[Column], Column] = EXTRACTORS["v4"]
) -> DataFrame:
    """Add ``target_domains``: parsed and re-screened names for passed rows, markers for the others."""
    return df.withColumn("_found", F.when(F.col("gate") == "pass", extract(F.col(response_col)))).withColumn(
        "target_domains",
        F.when(F.col("gate") == "blocked", F.array(F.lit(V.BLOCKED_MARK)))
        .when(F.col("gate") == "pass", safe_domains(F.coalesce("_found", no_strings())))
        .otherwise(no_strings()),
    ).drop("_found")


def status_of(domains: Column) -> Column:
    """filtered, blocked or success, from the in-band markers."""
    return (
        F.when(F.size(domains) == 0, "filtered")
        .when((domains == F.array(F.lit(V.BLOCKED_MARK))) | (domains == F.array(F.lit(V.NO_SAFE_MARK))), "blocked")
        .otherwise("success")
    )


def add_response(df: DataFrame, text_col: str, *, domains_col: str = "target_domains", failed: Column | None = None, invalid: Column | None = None) -> DataFrame:
    """Add ``status``, ``message``, ``http_code`` and ``suggestions``.

    ``failed`` marks rows whose processing broke; they answer with an internal error.
    ``invalid`` (see :func:`brandsieve.sources.requests.body_failure`) answers for bodies that
    are no requests.
    """
    if invalid is None:
        invalid = F.lit(None).cast("struct<message: string, http_code: int>")
    failed = F.coalesce(failed, F.lit(False)) if failed is not None else F.lit(False)
    domains = F.coalesce(F.col(domains_col), no_strings())
    blank = trim_ws(F.coalesce(F.col(text_col), F.lit(""))) == ""
    return (
        df.withColumn("_invalid", invalid)
        .withColumn("status", F.when(blank | failed | F.col("_invalid").isNotNull(), "error").otherwise(status_of(domains)))
        .withColumn(
            "message",
            F.when(F.col("_invalid").isNotNull(), F.col("_invalid.message"))
            .when(blank, V.MSG_REQUIRED)
            .when(failed, V.MSG_INTERNAL)
            .when(F.col("status") == "filtered", V.MSG_FILTERED)
            .when(domains == F.array(F.lit(V.BLOCKED_MARK)), V.MSG_BLOCKED)
            .when(F.col("status") == "blocked", V.MSG_NO_SAFE),
        )
        .withColumn("http_code", F.coalesce("_invalid.http_code", F.when(F.col("status") == "error", 500).otherwise(200)))
        .drop("_invalid")
        .withColumn(
            "suggestions",
            # The text is null, and its words are not gathered, where nothing is suggested.
            suggestions(
                F.when(F.col("status") == "success", domains).otherwise(no_strings()),
                F.when(F.col("status") == "success", F.col(text_col)),
            ),
        )
    )


def _first_words(blocklist: DataFrame) -> DataFrame:
    """The first-word index of a blocklist: _word, _single (it is a term itself), _longer (the terms
    of more words that begin with it)."""
    term = F.col("_term")
    shape = term.rlike(rf"^{V.WORD}(?:[\s\S]*{V.WORD})?\z")
    terms = blocklist.select(F.lower("term").alias("_term")).where("_term <> ''").distinct()
    terms = terms.select(
        F.when(shape, term).otherwise(F.raise_error(F.concat(F.lit("unsupported term: "), term))).alias("_term")
    ).withColumn("_word", F.regexp_extract(term, f"^{V.WORD}+", 0))
    longer = term != F.col("_word")
    return terms.groupBy("_word").agg(
        F.max(~longer).alias("_single"), F.array_sort(F.collect_list(F.when(longer, term))).alias("_longer")
    )


def match_blocklist(df: DataFrame, text_col: str, id_col: str, blocklist: DataFrame) -> DataFrame:
    """Whole-word check against a blocklist table (column ``term``): one row per id that has a hit.

    Terms are words, or words with anything between them (hyphens, blanks). A term that doesn't
    begin and end with a word character stops the job rather than pass unnoticed; null and empty
    terms are none. Each text contributes its distinct words, once each, which meet the first words
    of the terms; only texts that hold the first word of a longer term are looked through for that
    term, so long terms cost nothing elsewhere. The index is measured first and broadcast up to
    ``BROADCAST_BYTES``; beyond that, frequent words are split over all shuffle partitions. So are
    the texts to look through: their ids and terms are broadcast, or the texts move.
    """
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    index = written_once(_first_words(blocklist))
    # The outer form: explode alone adds a filter on its input, which would split every text again.
    spoken = df.select(F.col(id_col).alias("_id"), F.explode_outer(F.array_distinct(words(low))).alias("_word"))
    met = lookup_join(spoken, index, "_word", spread_by=F.col("_id"), broadcast_bytes=BROADCAST_BYTES).where(
        F.col("_single").isNotNull()
    )
    if index.where(F.size("_longer") > 0).isEmpty():
        hits = met.select("_id", F.col("_word").alias("_term"))
    else:
        met = written_once(met)
        wanted = met.where(F.size("_longer") > 0).groupBy("_id").agg(F.flatten(F.collect_list("_longer")).alias("_longer"))
        wanted = written_once(wanted)
        how = "broadcast" if measured_bytes(wanted) <= BROADCAST_BYTES else "shuffle_hash"
        texts = df.select(F.col(id_col).alias("_own"), low.alias("_low"))

        def stands(term: Column, text: Column) -> Column:
            whole = F.concat(F.lit(rf"(?<!{V.WORD})\Q"), term, F.lit(rf"\E(?!{V.WORD})"))
            return text.contains(term) & F.rlike(text, whole)

        looked = texts.join(wanted.hint(how), F.col("_own").eqNullSafe(F.col("_id"))).select(
            "_id",
            F.explode(
                let(F.col("_low"), lambda text: F.filter("_longer", lambda term: stands(term, text)))
            ).alias("_term"),
        )
        hits = met.where("_single").select("_id", F.col("_word").alias("_term")).unionByName(looked)
    return hits.groupBy(F.col("_id").alias(id_col)).agg(
        F.count(F.lit(1)).alias("n_terms"), F.min("_term").alias("first_term")
    )
