"""Cross-run deduplication as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from brandsieve.operators.dedup import normalised_key

#: Groups of texts that share one state in :func:`first_and_late`.
BUCKETS = 1 << 12
_DIGEST = "S32"
_NEVER = -(2**63)


def distinct_texts(stream: DataFrame, text_col: str, *, time_col: str | None = None, keep_for: str | None = None) -> DataFrame:
    """First arrival of every normalised text.

    The state holds one digest per text, never the text. With a time column it is bounded:
    a digest is forgotten ``keep_for`` after its event time, and **rows that arrive later than
    that are dropped**, new texts too. Choose ``keep_for``, which has no default, to exceed the
    longest delay. Without a time column nothing is dropped, and the state grows with the
    number of distinct texts, which suits an append-only set of known size.
    """
    keyed = stream.withColumn("text_key", normalised_key(F.col(text_col)))
    if time_col is None:
        return keyed.dropDuplicates(["text_key"])
    if keep_for is None:
        raise ValueError("state that is bounded by time drops late rows: say how late a row may be (keep_for)")
    return keyed.withWatermark(time_col, keep_for).dropDuplicatesWithinWatermark(["text_key"])


def first_and_late(
    stream: DataFrame,
    text_col: str,
    *,
    time_col: str,
    arrival_col: str,
    keep_for_seconds: int,
    arrival_delay: str = "1 hour",
    buckets: int = BUCKETS,
) -> DataFrame:
    """First arrival of every normalised text, with ``text_key`` and ``late``; late new texts are kept apart,
    not dropped.

    A row is late if it arrives more than ``keep_for_seconds`` after its time. A digest is forgotten
    when its text has not arrived for that long, so a late row whose text is not known may be new
    or forgotten: it is let through, marked late, for another sink to decide on. Late or not, a row
    whose text is known is dropped. Of the copies in one batch, one in time goes before a late one,
    and then the earliest. Rows without a time are in time. The clock is that of the arrivals:
    ``arrival_col`` may be out of order by ``arrival_delay``.

    The state holds a digest and a time a text, 40 bytes. Texts are dealt over ``buckets`` by their
    digests, and Python is called once a bucket and batch, not once a text. A batch reads and writes
    the state of the buckets that it meets: take more of them for small batches over very many
    texts. A checkpoint is bound to its number of buckets.
    """
    keyed = (
        stream.withColumn("text_key", normalised_key(F.col(text_col)))
        .withColumn(
            "late",
            F.coalesce(F.unix_seconds(arrival_col) - F.unix_seconds(time_col) > keep_for_seconds, F.lit(False)),
        )
        .withWatermark(arrival_col, arrival_delay)
    )

    rest = "_" * max(map(len, keyed.columns))  # makes names longer than all others
    bucket, time, at = f"{rest}bucket", f"{rest}time", f"{rest}at"
    columns, keep = keyed.columns, 1000 * keep_for_seconds + 1

    def firsts(rows: pd.DataFrame) -> tuple[np.ndarray, pd.DataFrame]:
        """The digests of the texts, ascending, and the row to keep of each with its newest arrival."""
        order = np.lexsort([rows[time].to_numpy(), rows["late"].to_numpy(bool)])
        digests = np.frombuffer(bytes.fromhex("".join(rows["text_key"])), _DIGEST)[order]
        digests, place, text = np.unique(digests, return_index=True, return_inverse=True)
        newest = np.full(len(digests), _NEVER)
        np.maximum.at(newest, text, rows[at].to_numpy()[order])
        return digests, rows.iloc[order[place]].assign(**{at: newest})

    def first(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, until = (np.frombuffer(x, t) for x, t in zip(state.getOption or (b"", b""), (_DIGEST, "<i8")))
        now, kept = state.getCurrentWatermarkMs(), None
        for rows in () if state.hasTimedOut else batches:
            digests, kept = firsts(rows if kept is None else pd.concat([kept, rows]))
        if kept is not None:
            new = ~np.isin(digests, known)
            if new.any():
                yield kept.loc[new, columns]
            others = ~np.isin(known, digests)
            known = np.concatenate([known[others], digests])
            until = np.concatenate([until[others], np.maximum(kept[at].to_numpy(), now) + keep])
        known, until = known[until >= now], until[until >= now]
        if not len(known):
            state.remove()
            return
        state.update((known.tobytes(), until.tobytes()))
        state.setTimeoutTimestamp(int(until.min()))

    return (
        keyed.withColumns(
            {
                bucket: F.pmod(F.xxhash64("text_key"), F.lit(buckets)).cast("int"),
                time: F.coalesce(F.unix_micros(time_col), F.lit(2**63 - 1)),
                at: F.coalesce(F.unix_millis(arrival_col), F.lit(_NEVER)),
            }
        )
        .groupBy(bucket)
        .applyInPandasWithState(
            first, keyed.schema, "digests binary, until binary", "append", GroupStateTimeout.EventTimeTimeout
        )
    )
