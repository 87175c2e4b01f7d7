"""Lookup join that stays balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brandsieve.session import written_once

BROADCAST_BYTES = 64 << 20  # measured size up to which a lookup table is broadcast
HOT_SHARE = 1000  # a key is hot when it holds more than 1/HOT_SHARE of the rows


def measured_bytes(table: DataFrame) -> int:
    """Size of a small-looking table as JSON text, from one aggregate."""
    return table.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    *,
    spread_by: Column,
    spread: int | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Left join of ``rows`` to ``table`` (one row per ``key``), exact under any skew.

    The table is measured first. Up to ``broadcast_bytes`` it is broadcast, and the rows are
    neither shuffled nor read twice. A larger table is joined by shuffle, with hot keys split:
    at most ``HOT_SHARE`` keys can hold more than 1/HOT_SHARE of all rows, so the hot keys may
    be broadcast whatever the data. Rows of a hot key take one of ``spread`` slots (the
    shuffle partitions by default) and the table row of that key is repeated for each slot;
    all other keys have slot 0 only. Null keys match nothing and are spread too.
    """
    table = written_once(table)  # measured and joined
    if measured_bytes(table) <= broadcast_bytes:
        return rows.join(F.broadcast(table), key, "left").select(*rows.columns, *[c for c in table.columns if c != key])
    spread = spread or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = [c for c in table.columns if c != key]
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    hot = (
        rows.groupBy(key)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") * HOT_SHARE > total)
        .select(F.col(key).alias("_hot_key"))
    )

    def flagged(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")

    spare = F.pmod(F.xxhash64(spread_by), F.lit(spread)).cast("int")
    scattered = F.col("_hot_key").isNotNull() | F.col(key).isNull()
    probes = flagged(rows).withColumn("_slot", F.when(scattered, spare).otherwise(0))
    slots = F.when(F.col("_hot_key").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(spread - 1)))
    targets = flagged(table).select(key, *values, F.explode_outer(slots).alias("_slot"))
    return probes.join(targets, [key, "_slot"], "left").select(*rows.columns, *values)
