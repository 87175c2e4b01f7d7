"""Sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brandsieve.functions.text import base_name
from brandsieve.operators.dedup import rows_not_known
from brandsieve.operators.training import dataset_metadata
from brandsieve.sources.digest_index import known_keys
from brandsieve.sources.reports import nest_summary


def write_results(rows: DataFrame, path: str) -> None:
    """Result rows as JSON Lines, replacing what is there."""
    rows.write.mode("overwrite").json(path)


def append_new(batch: DataFrame, path: str, text_col: str, id_col: str) -> None:
    """Append the batch rows whose text is neither in the JSON Lines at ``path`` nor earlier in the batch.

    A path that does not exist yet is created. Lines of it that cannot be read are skipped. The old
    texts are not read but their digests, which are kept beside them
    (:mod:`brandsieve.sources.digest_index`).
    """
    spark = batch.sparkSession
    new = rows_not_known(batch, known_keys(spark, path, text_col), text_col, id_col)
    new.drop(id_col).write.mode("append").json(path)
    known_keys(spark, path, text_col)  # takes in what was just written


def report_name(path: Column) -> Column:
    """Name of the report made from an outputs file."""
    return F.concat(F.lit("evaluated_"), base_name(path))


def write_report(rows: DataFrame, summary: DataFrame, path: str) -> None:
    """Evaluation rows as a table partitioned by version; only the short summaries are nested documents."""
    rows.write.mode("overwrite").partitionBy("model_version").json(f"{path}/rows")
    nest_summary(summary).withColumn("version", F.col("model_version")).write.mode("overwrite").partitionBy(
        "version"
    ).json(f"{path}/summary")


def write_tokens(tokens: DataFrame, path: str, *, split: str = "train", **options: str | int) -> None:
    """Token arrays as Parquet, one folder per split, and one metadata document."""
    tokens.withColumn("split", F.lit(split)).write.mode("overwrite").partitionBy("split").parquet(f"{path}/data")
    written = tokens.sparkSession.read.parquet(f"{path}/data")
    dataset_metadata(written, **options).write.mode("overwrite").json(f"{path}/metadata")


def read_tokens(spark: SparkSession, path: str, *, split: str | None = None) -> DataFrame:
    """Reload a token set: the named split, or the first one by name."""
    data = spark.read.parquet(f"{path}/data")
    if split is None:
        first = data.agg(F.min("split").alias("split")).scalar()
        return data.where(F.col("split") == first).drop("split")
    return data.where(F.col("split") == split).drop("split")


def read_metadata(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(f"{path}/metadata")
