"""The whole generation job: screen, ask a model, parse, screen again, answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brandsieve.functions.prompts import chat_prompt
from brandsieve.operators.inference import Load, Predict, add_model_output
from brandsieve.operators.screening import add_domains, add_gate, add_response


def generate(
    df: DataFrame,
    text_col: str,
    *,
    load: Load,
    predict: Predict,
    prompt: Column | None = None,
    legitimate: Column | None = None,
    invalid: Column | None = None,
    options: dict | None = None,
) -> DataFrame:
    """Add gate, response, error, target_domains, status, message, http_code and suggestions.

    One scan and no shuffle. Rows stopped by a gate reach the model hook as nulls, which it
    skips, instead of being split off and united again over a second scan. ``invalid`` marks bodies
    that are no requests (:func:`brandsieve.sources.requests.body_failure`).
    """
    prompt = chat_prompt(F.col(text_col)) if prompt is None else prompt
    gated = add_gate(df, text_col, legitimate=legitimate)
    asked = gated.withColumn("_prompt", F.when(F.col("gate") == "pass", prompt))
    answered = add_model_output(asked, "_prompt", load=load, predict=predict, options=options).drop("_prompt")
    named = add_domains(answered, "response")
    # A row whose model call failed gives an empty list, not a padded one.
    named = named.withColumn(
        "target_domains",
        F.when(F.col("error").isNotNull(), F.array().cast("array<string>")).otherwise(F.col("target_domains")),
    )
    return add_response(named, text_col, failed=F.col("error").isNotNull(), invalid=invalid)
