"""One model call per distinct prompt, asked again until the answer is valid or attempts run out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brandsieve.functions.text import text_key
from brandsieve.operators.inference import Load, Predict, add_model_output
from brandsieve.operators.joins import BROADCAST_BYTES, lookup_join, measured_bytes
from brandsieve.session import new_path, remove, written_once

#: Adds a boolean column ``valid`` to rows with a column ``answer``.
Check = Callable[[DataFrame], DataFrame]


def _write_prompts(df: DataFrame, prompt: Column, path: str) -> DataFrame:
    """prompt, prompt_key of the distinct prompts, from a table of all prompts written at ``path``.

    Prompts are long, and an aggregate that carries them sorts them: only digests and row numbers are
    grouped, and the first row of each digest is picked by a join that sorts nothing.
    """
    row = F.monotonically_increasing_id().alias("row")
    wanted = df.select(prompt.alias("prompt")).where(F.col("prompt").isNotNull())
    wanted.select(row, text_key(F.col("prompt")).alias("prompt_key"), "prompt").write.parquet(path)
    prompts = df.sparkSession.read.parquet(path)
    first = written_once(prompts.groupBy("prompt_key").agg(F.min("row").alias("row")).select("row"))
    first = F.broadcast(first) if measured_bytes(first) <= BROADCAST_BYTES else first.hint("shuffle_hash")
    return prompts.join(first, "row", "left_semi").select("prompt", "prompt_key")


def answer_table(
    df: DataFrame,
    prompt_col: str,
    *,
    load: Load,
    predict: Predict,
    check: Check,
    attempts: int = 3,
    options: dict | None = None,
) -> DataFrame:
    """One row per distinct prompt: prompt_key (its digest), answer, error, valid, attempts.

    Attempt n asks those prompts only that no earlier attempt answered validly; ``predict`` gets
    ``attempt=n`` with the other options, so it can change temperature or seed. Each attempt is
    written before the next reads it: a sampling model is never asked twice because a task ran
    again. All prompts are written before the first. Null prompts are not asked. The driver learns only whether any prompt is open. The
    written table belongs to the caller.
    """
    spark = df.sparkSession
    path, prompts = new_path(spark, "answers"), new_path(spark, "prompts")
    waiting = _write_prompts(df, F.col(prompt_col), prompts)
    for attempt in range(1, attempts + 1):
        here = f"{path}/attempts={attempt}"
        asked = add_model_output(
            waiting, "prompt", load=load, predict=predict, out_col="answer", options={**(options or {}), "attempt": attempt}
        )
        failed = F.col("error").isNotNull()
        judged = check(asked).withColumn("valid", F.coalesce(F.col("valid") & ~failed, F.lit(False)))
        judged.select("prompt_key", "prompt", "answer", "error", "valid").write.parquet(here)
        if attempt == 1:
            remove(spark, prompts)
        waiting = spark.read.parquet(here).where(~F.col("valid")).select("prompt", "prompt_key")
        if waiting.isEmpty():
            break
    done = spark.read.parquet(path).where(F.col("valid") | (F.col("attempts") == attempts))
    return done.select("prompt_key", "answer", "error", "valid", F.col("attempts").cast("int").alias("attempts"))


def with_answers(df: DataFrame, prompt_col: str, answers: DataFrame, *, spread_by: str) -> DataFrame:
    """``df`` with answer, error, valid and attempts of its prompts; null where none was asked.

    Joined by digest, balanced however many rows ask the same prompt.
    """
    keyed = df.withColumn("prompt_key", F.when(F.col(prompt_col).isNotNull(), text_key(F.col(prompt_col))))
    return lookup_join(keyed, answers, "prompt_key", spread_by=F.col(spread_by)).drop("prompt_key")
