"""The digests of a set of texts, kept beside it, so that an append needn't read the old texts.

The index lies in ``_digests`` within the set's folder, which readers of the set pass over: a table of
digests in buckets, and a list of the files whose texts it holds. Files of the set that are not
listed, those of the last append or of an append that broke off, are read and added. Where a listed
file is gone, or the index is, all files count as not listed and the index is built anew. One writer
at a time.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brandsieve.operators.dedup import normalised_key
from brandsieve.operators.row_marks import file_paths
from brandsieve.session import remove
from brandsieve.sources.json_lines import path_exists, read_lines, readable

FOLDER = "_digests"


def _listed(spark: SparkSession, index: str) -> tuple[set[str], int | None]:
    """The files that the index holds and the number of its buckets."""
    try:
        rows = spark.read.schema("file string, buckets int").parquet(f"{index}/files").collect()
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = []
    return {r["file"] for r in rows}, rows[0]["buckets"] if rows else None


def _table(spark: SparkSession, index: str, buckets: int) -> str:
    """The name under which this session reads the digests, bucketed so that no digest moves."""
    name = f"digests_{hashlib.md5(index.encode()).hexdigest()}"
    place = index.replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} (_key STRING) USING parquet"
        f" CLUSTERED BY (_key) SORTED BY (_key) INTO {buckets} BUCKETS LOCATION '{place}/by_digest'"
    )
    spark.catalog.refreshTable(name)
    return name


def _drop(spark: SparkSession, index: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS digests_{hashlib.md5(index.encode()).hexdigest()}")
    remove(spark, index)


def known_keys(spark: SparkSession, path: str, text_col: str) -> DataFrame:
    """_key of every text in the JSON Lines at ``path``; the index is brought up to date first.

    New indexes have as many buckets as there are shuffle partitions. Lines that cannot be read have
    no key; a missing text counts as empty.
    """
    nothing = spark.createDataFrame([], "_key string")
    if not path_exists(spark, path):
        return nothing
    index = f"{path.rstrip('/')}/{FOLDER}"
    files = set(file_paths(spark.read.text(path)))
    if not files:
        return nothing
    held, buckets = _listed(spark, index)
    if not held or held - files:
        _drop(spark, index)
        held, buckets = set(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, added = _table(spark, index, buckets), sorted(files - held)
    if added:
        lines = read_lines(spark, path, f"{text_col} string").where(F.col("file_path").isin(added))
        keys = readable(lines).select(normalised_key(F.col(text_col)).alias("_key")).distinct()
        keys.repartition(buckets, "_key").write.insertInto(name)
        spark.createDataFrame([(f, buckets) for f in added], "file string, buckets int").coalesce(1).write.mode(
            "append"
        ).parquet(f"{index}/files")
    return spark.table(name)
