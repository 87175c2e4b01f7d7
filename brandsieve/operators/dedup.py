"""First-occurrence and append-only-new operators over a normalised text key.

Only digests, ids and places are shuffled: they give the rows that go. Rows that come straight from
Parquet files are taken out by bitmaps of their places, so that no text moves however many go.
Other rows are taken out by their ids: these are written once and measured, and up to
``BROADCAST_BYTES`` of them are broadcast. The copies of a hot text meet in no task: their digest is
counted with partial aggregation, and the join with the count is split where it is skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brandsieve.functions.text import text_key, trim_ws
from brandsieve.operators.joins import BROADCAST_BYTES, measured_bytes
from brandsieve.operators.row_marks import PLACE, has_places, place_columns, without_places
from brandsieve.session import written_once


def normalised_key(text: Column) -> Column:
    """Key under which two descriptions count as the same: stripped, lower case."""
    return text_key(F.lower(trim_ws(F.coalesce(text, F.lit("")))))


def _keyed(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """_key, _at (what orders and tells the rows: the id, then the place if there is one)."""
    places = place_columns() if has_places(df) else []
    row = F.when(F.col(id_col).isNotNull(), F.struct(F.col(id_col).alias("_id"), *places))
    return written_once(df.select(normalised_key(F.col(text_col)).alias("_key"), row.alias("_at")))


def _without(df: DataFrame, drop: DataFrame, id_col: str) -> DataFrame:
    """The rows that are not to drop. ``drop``: _at."""
    if has_places(df):
        return without_places(df, drop.select(*(F.col(f"_at.{c}").alias(c) for c in PLACE)))
    drop = written_once(drop.select(F.col("_at._id").alias(id_col)))
    if measured_bytes(drop) <= BROADCAST_BYTES:
        drop = F.broadcast(drop)
    return df.join(drop, id_col, "left_anti").select(df.columns)


def first_occurrence(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """Rows with the smallest id among equal normalised texts; rows with a null id stay.

    Rows from Parquet files may repeat an id: the first of them stays. Elsewhere ids must be unique.
    """
    keyed = _keyed(df, text_col, id_col)
    repeated = keyed.groupBy("_key").agg(F.min("_at").alias("_first"), F.count("_at").alias("_n")).where("_n > 1")
    later = keyed.join(written_once(repeated), "_key").where(F.col("_at") > F.col("_first"))
    return _without(df, later.select("_at"), id_col)


def _new_ids(batch: DataFrame, target: DataFrame, text_col: str, id_col: str) -> DataFrame:
    key = normalised_key(F.col(text_col)).alias("_key")
    offered = batch.select(key, F.col(id_col).alias("_id"), F.lit(0).alias("_known"))
    known = target.select(key, F.lit(None).cast(batch.schema[id_col].dataType).alias("_id"), F.lit(1).alias("_known"))
    return (
        offered.unionByName(known)
        .groupBy("_key")
        .agg(F.min("_id").alias("_id"), F.max("_known").alias("_known"))
        .where("_known = 0")
        .select(F.col("_id").alias(id_col))
    )


def new_rows(batch: DataFrame, target: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """Batch rows whose text is neither in the target nor earlier in the batch."""
    return rows_not_known(batch, target.select(normalised_key(F.col(text_col)).alias("_key")), text_col, id_col)


def rows_not_known(batch: DataFrame, known: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """Batch rows whose key is neither known (column _key) nor that of an earlier row of the batch."""
    offered = _keyed(batch, text_col, id_col)
    known = known.select("_key").distinct().withColumn("_known", F.lit(1))
    first = offered.groupBy("_key").agg(F.min("_at").alias("_first"), F.count("_at").alias("_n"))
    gone = written_once(first.join(known, "_key", "left").where("_known = 1 OR _n > 1"))
    drop = offered.join(gone, "_key").where((F.col("_known") == 1) | (F.col("_at") > F.col("_first")))
    return _without(batch, drop.where("_at IS NOT NULL").select("_at"), id_col)


def append_counts(batch: DataFrame, target: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """How many batch rows :func:`new_rows` adds and skips; needs no document to move."""
    added = _new_ids(batch, target, text_col, id_col).agg(F.count(F.lit(1)).alias("added"))
    offered = batch.agg(F.count(F.lit(1)).alias("offered")).scalar()
    return added.select("added", (offered - F.col("added")).alias("skipped"))
