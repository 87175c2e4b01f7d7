"""The one Python hook: batch model inference over a column.

Only the prompt column crosses to Python (Arrow batches); all other columns stay in the JVM.
Rows with a null prompt are not sent to the model, so a gate can switch rows off without a
second scan of the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LETTERS = str.maketrans("0123456789", "ghijklmnop")

Load = Callable[[], Any]
Predict = Callable[..., list]


def _answers(model: Any, predict: Predict, prompts: list[str], options: dict) -> list[tuple]:
    """(value, error) per prompt. A failing batch is tried again prompt by prompt."""
    try:
        values = list(predict(model, prompts, **options))
        if len(values) == len(prompts):
            return [(v, None) for v in values]
        problem = f"{len(values)} answers for {len(prompts)} prompts"
    except Exception as e:  # noqa: BLE001 - any model error is data here
        problem = str(e)
    if len(prompts) == 1:
        return [(None, problem)]
    return [_answers(model, predict, [p], options)[0] for p in prompts]


def add_model_output(
    df: DataFrame,
    prompt_col: str,
    *,
    load: Load,
    predict: Predict,
    out_col: str = "response",
    out_type: str = "string",
    error_col: str = "error",
    batch_size: int = 32,
    options: dict | None = None,
) -> DataFrame:
    """Add ``predict(model, prompts, **options)`` as a column, and the error of rows that failed.

    ``load`` runs once per task. ``options`` carries sampling parameters. A task holds one
    Arrow batch of prompts at a time, bounded by ``spark.sql.execution.arrow.maxBytesPerBatch``
    (64 MB by default).
    """
    settings = dict(options or {})

    @F.pandas_udf(f"value {out_type}, error string")
    def infer(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for prompts in batches:
            answers = [(None, None)] * len(prompts)
            asked = np.flatnonzero(prompts.notna().to_numpy())
            texts = prompts.iloc[asked].tolist()
            for start in range(0, len(asked), batch_size):
                found = _answers(model, predict, texts[start : start + batch_size], settings)
                for at, answer in zip(asked[start : start + batch_size].tolist(), found):
                    answers[at] = answer
            values, errors = zip(*answers) if answers else ((), ())
            yield pd.DataFrame({"value": pd.Series(values, dtype=object), "error": pd.Series(errors, dtype=object)})

    # A sampling model is not a pure function; this also keeps the plan from calling it twice.
    answer = infer.asNondeterministic()(F.col(prompt_col))
    return (
        df.withColumn("_answer", answer)
        .withColumn(out_col, F.col("_answer.value"))
        .withColumn(error_col, F.col("_answer.error"))
        .drop("_answer")
    )


def load_stub() -> None:
    return None


def predict_stub(model: None, prompts: list[str], *, endings: tuple[str, ...] = (".com", ".io", ".ai")) -> list[str]:
    """Deterministic stand-in for a generator: twelve letters made of the whole prompt's MD5 with fixed endings, one per line."""
    answers = []
    for prompt in prompts:
        key = hashlib.md5(prompt.encode()).hexdigest()[:12].translate(_LETTERS)
        answers.append("\n".join(key + e for e in endings))
    return answers
