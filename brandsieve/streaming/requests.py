"""Request scoring as a stream: the batch functions on an unbounded table, without state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from brandsieve.operators.screening import add_domains, add_gate, add_response


def read_request_stream(spark: SparkSession, path: str, schema: str, *, fmt: str = "json", files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def score_requests(requests: DataFrame, text_col: str, response: Column, *, invalid: Column | None = None) -> DataFrame:
    """Gate, parse and answer each request; works on a batch or a streaming DataFrame alike.

    ``invalid`` marks bodies that are no requests (:func:`brandsieve.sources.requests.body_failure`).
    """
    gated = add_gate(requests, text_col).withColumn("_response", response)
    return add_response(add_domains(gated, "_response"), text_col, invalid=invalid).drop("_response")


def append_to(stream: DataFrame, path: str, checkpoint: str, *, fmt: str = "parquet", once: bool = False) -> StreamingQuery:
    """Start an append-mode query; ``once`` processes what is there and stops."""
    writer = stream.writeStream.outputMode("append").format(fmt).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start(path)
