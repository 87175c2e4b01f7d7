"""Nested evaluation reports: one JSON document per version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brandsieve.operators.evaluation import CATEGORIES
from brandsieve.sources.json_lines import existing

_PART = "struct<correct: bigint, total: bigint, accuracy: double>"
REPORT = (
    "model_version string, total_entries bigint, summary struct<"
    "total_entries: bigint, "
    f"classification_performance: struct<legit: {_PART}, gibberish: {_PART}, nsfw: {_PART}>, "
    f"gpt_dataset_agreement: {_PART}, "
    "legit_blocked: bigint, "
    "domain_quality: struct<average_score: double, total_scored: bigint>, "
    "model_capabilities: struct<has_gibberish_filtering: boolean, has_nsfw_filtering: boolean>>"
)


def nest_summary(summary: DataFrame, version_col: str = "model_version") -> DataFrame:
    """The flat summary as the nested report document."""
    def part(right: str, whole: str, share: str):
        return F.struct(
            F.col(right).alias("correct"), F.col(whole).alias("total"), F.col(share).alias("accuracy")
        )

    performance = F.struct(*[part(f"{c}_correct", f"{c}_total", f"{c}_accuracy").alias(c) for c in CATEGORIES])
    return summary.select(
        F.col(version_col).alias("model_version"),
        "total_entries",
        F.struct(
            "total_entries",
            performance.alias("classification_performance"),
            part("agreement_correct", "total_entries", "agreement").alias("gpt_dataset_agreement"),
            "legit_blocked",
            F.struct(
                F.col("domain_quality").alias("average_score"), F.col("domains_scored").alias("total_scored")
            ).alias("domain_quality"),
            F.struct(
                F.col("filters_gibberish").alias("has_gibberish_filtering"),
                F.col("filters_nsfw").alias("has_nsfw_filtering"),
            ).alias("model_capabilities"),
        ).alias("summary"),
    )


def flatten_summary(reports: DataFrame) -> DataFrame:
    """The nested report document as the flat summary."""
    performance = "summary.classification_performance"
    columns = [F.col("model_version"), F.col("summary.total_entries").alias("total_entries")]
    for c in CATEGORIES:
        columns += [
            F.col(f"{performance}.{c}.total").alias(f"{c}_total"),
            F.col(f"{performance}.{c}.correct").alias(f"{c}_correct"),
            F.col(f"{performance}.{c}.accuracy").alias(f"{c}_accuracy"),
        ]
    return reports.select(
        *columns,
        F.col("summary.gpt_dataset_agreement.correct").alias("agreement_correct"),
        F.col("summary.gpt_dataset_agreement.accuracy").alias("agreement"),
        F.col("summary.legit_blocked").alias("legit_blocked"),
        F.col("summary.domain_quality.average_score").alias("domain_quality"),
        F.col("summary.domain_quality.total_scored").alias("domains_scored"),
        F.coalesce("summary.model_capabilities.has_gibberish_filtering", F.lit(False)).alias("filters_gibberish"),
        F.coalesce("summary.model_capabilities.has_nsfw_filtering", F.lit(False)).alias("filters_nsfw"),
    )


def read_reports(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Flat summaries of the reports that exist, each tagged with its version."""
    tables = [
        flatten_summary(spark.read.schema(REPORT).option("multiLine", True).json(path)).withColumn(
            "model_version", F.lit(version)
        )
        for version, path in existing(spark, paths).items()
    ]
    union = tables[0]
    for table in tables[1:]:
        union = union.unionByName(table)
    return union
