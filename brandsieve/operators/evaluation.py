"""Measure several model versions against ground truth: rows, summaries and comparison tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brandsieve import fixed_values as V
from brandsieve.functions.text import no_strings, percent, text_key, trim_ws
from brandsieve.operators.joins import lookup_join

CATEGORIES = ("legit", "gibberish", "nsfw")


def positional_category(position: Column, cut_points: tuple[int, int] = V.CUT_POINTS) -> Column:
    first, second = cut_points
    return F.when(position <= first, "legit").when(position <= second, "gibberish").otherwise("nsfw")


def truth_table(entries: DataFrame, text_col: str, category: Column, id_col: str) -> DataFrame:
    """One row per distinct trimmed description: ``truth_key`` and the category of its last entry."""
    return (
        entries.select(
            text_key(trim_ws(F.coalesce(F.col(text_col), F.lit("")))).alias("truth_key"),
            F.struct(F.col(id_col).alias("id"), category.alias("category")).alias("_entry"),
        )
        .groupBy("truth_key")
        .agg(F.max("_entry").alias("_entry"))
        .select("truth_key", F.col("_entry.category").alias("truth_category"))
    )


def add_category(outputs: DataFrame, truth: DataFrame, text_col: str, id_col: str, *, fallback: Column) -> DataFrame:
    """Add ``category``: the ground truth of the description, else the category of its position."""
    keyed = outputs.withColumn("truth_key", text_key(trim_ws(F.coalesce(F.col(text_col), F.lit("")))))
    return (
        lookup_join(keyed, truth, "truth_key", spread_by=F.col(id_col))
        .withColumn("category", F.coalesce("truth_category", fallback))
        .drop("truth_key", "truth_category")
    )


def add_capabilities(
    df: DataFrame, version_col: str = "model_version", capabilities: dict[str, tuple[bool, bool]] = V.CAPABILITIES
) -> DataFrame:
    """Add ``filters_gibberish`` and ``filters_nsfw`` (false for an unknown version) from a literal map."""
    def flag(which: int) -> Column:
        table = F.create_map(*[F.lit(x) for v, flags in capabilities.items() for x in (v, flags[which])])
        return F.coalesce(F.try_element_at(table, F.col(version_col)), F.lit(False))

    return df.withColumns({"filters_gibberish": flag(0), "filters_nsfw": flag(1)})


def is_correct(category: Column, domains: Column, filters_gibberish: Column) -> Column:
    """Did the version behave as its capabilities and the category ask for?"""
    blocked = domains == F.array(F.lit(V.BLOCKED_MARK))
    named = (F.size(domains) > 0) & ~blocked
    return (
        F.when(category == "legit", named)
        .when((category == "gibberish") & filters_gibberish, F.size(domains) == 0)
        .when(category == "gibberish", named)
        .when(category == "nsfw", blocked)
        .otherwise(False)
    )


def evaluation_rows(outputs: DataFrame, *, domains_col: str = "target_domains") -> DataFrame:
    """Add ``model_correct``; needs category, filters_gibberish and the judged columns."""
    domains = F.coalesce(F.col(domains_col), no_strings())
    return outputs.withColumn("model_correct", is_correct(F.col("category"), domains, F.col("filters_gibberish")))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def summarize(rows: DataFrame, version_col: str = "model_version") -> DataFrame:
    """One flat summary row per version, from a single conditional aggregate."""
    category, correct, score = F.col("category"), F.col("model_correct"), F.col("domain_quality_score")
    scored = (category == "legit") & correct & (score > 0)
    aggregates = [F.count(F.lit(1)).alias("total_entries")]
    for name in CATEGORIES:
        aggregates += [
            F.count_if(category == name).alias(f"{name}_total"),
            F.count_if((category == name) & correct).alias(f"{name}_correct"),
        ]
    aggregates += [
        F.count_if(F.col("agrees_with_dataset")).alias("agreement_correct"),
        F.avg(F.when(scored, score)).alias("_quality"),
        F.count_if(scored).alias("domains_scored"),
    ]
    summary = rows.groupBy(version_col).agg(*aggregates)
    for name in CATEGORIES:
        summary = summary.withColumn(f"{name}_accuracy", _ratio(F.col(f"{name}_correct"), F.col(f"{name}_total")))
    summary = summary.withColumns(
        {
            "agreement": _ratio(F.col("agreement_correct"), F.col("total_entries")),
            "legit_blocked": F.col("legit_total") - F.col("legit_correct"),
            "domain_quality": F.round(F.coalesce("_quality", F.lit(0.0)), 3),
        }
    ).drop("_quality")
    return add_capabilities(summary, version_col)


def compare(summary: DataFrame) -> DataFrame:
    """Comparison table: the summary plus overall accuracy and the number of filters."""
    right = sum((F.col(f"{c}_correct") for c in CATEGORIES), F.lit(0))
    return summary.withColumns(
        {
            "overall_accuracy": _ratio(right, F.col("total_entries")),
            "complexity": F.col("filters_gibberish").cast("int") + F.col("filters_nsfw").cast("int"),
        }
    )


def display_table(comparison: DataFrame, version_col: str = "model_version") -> DataFrame:
    """The comparison with percent texts and short column names."""
    return comparison.select(
        F.col(version_col).alias("model"),
        percent(F.col("overall_accuracy")).alias("overall_acc"),
        percent(F.col("legit_accuracy")).alias("legit_acc"),
        percent(F.col("gibberish_accuracy")).alias("gibberish_acc"),
        percent(F.col("nsfw_accuracy")).alias("nsfw_acc"),
        F.round("domain_quality", 3).alias("quality_score"),
        F.col("legit_blocked").alias("false_positives"),
        percent(F.col("agreement")).alias("agreement"),
    )


def chart_series(comparison: DataFrame, version_col: str = "model_version") -> DataFrame:
    """Long format (model, metric, value) of what the four charts show."""
    series = {
        "overall_pct": F.col("overall_accuracy") * 100,
        "legit_pct": F.col("legit_accuracy") * 100,
        "gibberish_pct": F.col("gibberish_accuracy") * 100,
        "nsfw_pct": F.col("nsfw_accuracy") * 100,
        "domains_scored": F.col("domains_scored").cast("double"),
        "complexity": F.col("complexity").cast("double"),
        "domain_quality": F.col("domain_quality"),
    }
    points = F.array(*[F.struct(F.lit(name).alias("metric"), value.alias("value")) for name, value in series.items()])
    return comparison.select(F.col(version_col).alias("model"), F.inline(points))


def side_by_side(comparison: DataFrame, metric: str, versions: list[str], version_col: str = "model_version") -> DataFrame:
    """One row, one column per version."""
    return comparison.groupBy().pivot(version_col, versions).agg(F.first(metric))


def success_rate(outputs: DataFrame, *, by: str | None = None, domains_col: str = "target_domains") -> DataFrame:
    """Rows, rows with a non-empty output, and their share in percent (0 for no rows)."""
    named = F.size(F.coalesce(F.col(domains_col), no_strings())) > 0
    grouped = outputs.groupBy(by) if by else outputs.groupBy()
    counted = grouped.agg(F.count(F.lit(1)).alias("total"), F.count_if(named).alias("successful"))
    return counted.withColumn("success_rate", _ratio(F.col("successful"), F.col("total")) * 100)


def generation_stats(outputs: DataFrame, *, by: str | None = None, domains_col: str = "target_domains") -> DataFrame:
    """Legitimate and gibberish rows as told by their output, with percentages."""
    stats = success_rate(outputs, by=by, domains_col=domains_col)
    return stats.select(
        *([by] if by else []),
        F.col("total").alias("processed"),
        F.col("successful").alias("legitimate"),
        (F.col("total") - F.col("successful")).alias("gibberish"),
        F.col("success_rate").alias("legitimate_pct"),
        (_ratio(F.col("total") - F.col("successful"), F.col("total")) * 100).alias("gibberish_pct"),
        F.col("successful").alias("with_domains"),
    )


def source_breakdown(df: DataFrame, source_col: str = "source") -> DataFrame:
    """Rows per source and their share of all rows; a missing source counts as unknown."""
    counts = df.groupBy(F.coalesce(F.col(source_col), F.lit("unknown")).alias(source_col)).agg(
        F.count(F.lit(1)).alias("n")
    )
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    return counts.withColumn("share_pct", F.col("n") / total * 100)
