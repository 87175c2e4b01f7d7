"""Requests through gates and model as a stream, to answers, failures and quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from brandsieve.operators.inference import Load, Predict
from brandsieve.plans.generation import generate
from brandsieve.sources.requests import body_failure, body_text

ROUTES = ("answers", "failures", "quarantine")


def answer_bodies(bodies: DataFrame, body_col: str, *, load: Load, predict: Predict, options: dict | None = None) -> DataFrame:
    """A batch of JSON bodies answered, with ``route``: quarantine where a body is no request, failures
    where the model failed, answers otherwise. Other columns stay; ``text`` is the description."""
    invalid = body_failure(F.col(body_col))
    asked = bodies.withColumn("text", body_text(F.col(body_col)))
    done = generate(asked, "text", load=load, predict=predict, invalid=invalid, options=options)
    route = F.when(invalid.isNotNull(), "quarantine").when(F.col("error").isNotNull(), "failures").otherwise("answers")
    return done.withColumn("route", route)


def serve(
    stream: DataFrame,
    body_col: str,
    path: str,
    checkpoint: str,
    *,
    load: Load,
    predict: Predict,
    options: dict | None = None,
    once: bool = False,
) -> StreamingQuery:
    """Start answering a stream of bodies; each micro-batch becomes one folder of ``path``.

    A batch is computed and written once for all routes, so the model sees each request once, and it
    overwrites the folder of its number: one that is run again after a crash adds nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        answered = answer_bodies(batch, body_col, load=load, predict=predict, options=options)
        answered.write.mode("overwrite").partitionBy("route").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_routed(spark: SparkSession, path: str, route: str) -> DataFrame:
    """What a serving stream has written to one of ``ROUTES``."""
    return spark.read.parquet(path).where(F.col("route") == route).drop("route", "batch")
