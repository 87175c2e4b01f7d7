"""Intermediate tables and the text rules that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from brandsieve.session import written_once

#: A word: a run of anything but blank, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"


#: The same rows from the checkpoint folder: nothing is computed twice, and a lost executor
#: costs a read.
cut = written_once


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that the caller wrote and nobody reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def in_fold(key: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the key as text leaves ``fold`` modulo ``folds``; null keys never do."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as make it new to the table."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def split_words(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8, A-Z lower-cased; none for null."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []
