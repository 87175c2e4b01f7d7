"""The whole evaluation job over all model versions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from brandsieve.functions.verdicts import add_verdict
from brandsieve.operators.evaluation import add_capabilities, add_category, evaluation_rows


def evaluate(outputs: DataFrame, truth: DataFrame, *, fallback: Column, verdict_col: str = "verdict") -> DataFrame:
    """Evaluation rows: category, correctness and the parsed verdict for every output."""
    rows = add_category(outputs, truth, "business_description", "entry_id", fallback=fallback)
    judged = add_verdict(add_capabilities(rows), verdict_col).drop(verdict_col)
    return evaluation_rows(judged)
