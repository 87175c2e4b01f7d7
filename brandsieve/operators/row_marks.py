"""Deletion bitmaps: rows of Parquet files taken out by their place, so that they never move.

A row is known by its file and its number in the file, which the scan gives for free. The places
that go become one bitmap a file, an array of 64-bit words; reading the files again, each row looks
at its own bit. Bitmaps are an eighth of a byte a row however many rows go, and files without
a row to drop have none. They are broadcast in groups of files of up to ``GROUP_BYTES``, each group of
files being read with its own bitmaps only.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brandsieve.session import written_once

GROUP_BYTES = 32 << 20
_FILE, _ROW = "_metadata.file_path", "_metadata.row_index"
#: What tells a file from all others: 128 bits of its path.
PLACE = ("_file", "_file_too", "_row")


def place_columns() -> list[Column]:
    """The place of a row, as columns of a table read from Parquet files."""
    path = F.col(_FILE)
    hashed = F.xxhash64(path).alias("_file"), F.xxhash64(F.lit(1), path).alias("_file_too")
    return [*hashed, F.col(_ROW).alias("_row")]


def file_paths(df: DataFrame) -> list[str]:
    """The files that a table is read from, as their rows name them; listed, not read."""
    return sorted(re.sub(r"^([\w+.-]+):///", r"\1:/", path) for path in df.inputFiles())


def has_places(df: DataFrame) -> bool:
    """Whether the rows come straight from Parquet files (filters may lie between)."""
    try:
        df.select(_ROW)
    except AnalysisException:
        return False
    return True


def bitmaps(places: DataFrame) -> DataFrame:
    """_file, _file_too, _bits: one row a file that has places to drop. Places may repeat."""
    word = F.shiftright("_row", 6)
    file = list(PLACE[:2])
    marked = places.groupBy(*file, word.alias("_word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_row").bitwiseAND(63).cast("int"))).alias("_bits")
    )
    empty = (
        places.groupBy(file)
        .agg(F.max(word).alias("_last"))
        .select(*file, F.explode(F.sequence(F.lit(0).cast("long"), "_last")).alias("_word"), F.lit(0).cast("long").alias("_bits"))
    )
    return (
        marked.unionByName(empty)
        .groupBy(*file, "_word")
        .agg(F.bit_or("_bits").alias("_bits"))
        .groupBy(file)
        .agg(F.sort_array(F.collect_list(F.struct("_word", "_bits"))).alias("_words"))
        .select(*file, F.col("_words._bits").alias("_bits"))
    )


def _kept(df: DataFrame, maps: DataFrame) -> DataFrame:
    own = df.select(*df.columns, *place_columns())
    word = F.get("_bits", F.shiftright("_row", 6).cast("int"))
    bit = F.call_function("getbit", word, F.col("_row").bitwiseAND(63).cast("int"))
    return own.join(F.broadcast(maps), list(PLACE[:2]), "left").where(F.coalesce(bit, F.lit(0)) == 0).select(df.columns)


def without_places(df: DataFrame, places: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The rows of ``df`` (see :func:`has_places`) whose place is not among ``places``.

    Nothing of ``df`` is shuffled, whatever the number of places.
    """
    maps = written_once(bitmaps(places))
    size = 8 * F.size("_bits") + 64
    total = maps.agg(F.sum(size)).first()[0] or 0
    if total <= group_bytes:
        return _kept(df, maps)
    # One row a file: groups by running size, and the paths that belong to them.
    upto = F.sum(size).over(Window.orderBy(*PLACE[:2]))
    grouped = written_once(maps.withColumn("_group", F.floor(upto / group_bytes)))
    path = F.col("_path")
    listed = (
        df.sparkSession.createDataFrame([(p,) for p in file_paths(df)], "_path string")
        .select("_path", F.xxhash64(path).alias("_file"), F.xxhash64(F.lit(1), path).alias("_file_too"))
        .join(grouped.drop("_bits"), list(PLACE[:2]), "left")
        .groupBy("_group")
        .agg(F.collect_list("_path"))
        .collect()
    )
    parts = []
    for group, own in listed:
        some = df.where(F.col(_FILE).isin(own))
        parts.append(some if group is None else _kept(some, grouped.where(F.col("_group") == group).drop("_group")))
    return reduce(DataFrame.unionByName, parts)
