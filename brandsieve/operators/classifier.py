"""Gibberish classifier: hashed words, inverse document frequency and weighted logistic regression."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brandsieve import fixed_values as V
from brandsieve.operators.training import classification_metrics
from brandsieve.session import new_path


class MacroF1(Evaluator):
    """Macro-averaged F1 of two labels, from one four-counter aggregate."""

    def _evaluate(self, dataset: DataFrame) -> float:
        return classification_metrics(dataset).select("f1_macro").first()[0]

    def isLargerBetter(self) -> bool:
        return True


def train_classifier(
    df: DataFrame,
    text_col: str,
    label_col: str = "label",
    weight_col: str = "weight",
    *,
    features: int = 1 << 16,
    regularisation: tuple[float, ...] = (0.001, 0.01),
    validation: float = 0.2,
    seed: int = 42,
) -> PipelineModel:
    """Fit, keeping the regularisation with the best macro F1 on a held-out share.

    Words are hashed, so no vocabulary is gathered. The texts are read once: their word
    counts are written to the shared folder, and everything that iterates reads that table,
    which also survives a lost executor.
    """
    spark = df.sparkSession
    words = RegexTokenizer(inputCol="_text", outputCol="_words", pattern=rf"{V.WORD}+", gaps=False)
    frequencies = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features)
    counts_path = new_path(spark, "word-counts")
    frequencies.transform(words.transform(_prepared(df, text_col))).select(
        "_tf", F.col(label_col).cast("double").alias("label"), F.col(weight_col).alias("weight")
    ).write.parquet(counts_path)
    counts = spark.read.parquet(counts_path)
    idf = IDF(inputCol="_tf", outputCol="features", minDocFreq=2).fit(counts)
    regression = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", maxIter=30)
    grid = ParamGridBuilder().addGrid(regression.regParam, list(regularisation)).build()
    search = TrainValidationSplit(
        estimator=regression,
        estimatorParamMaps=grid,
        evaluator=MacroF1(),
        trainRatio=1 - validation,
        seed=seed,
        parallelism=len(grid),
    )
    best = search.fit(idf.transform(counts).select("features", "label", "weight")).bestModel
    return PipelineModel([words, frequencies, idf, best])


def _prepared(df: DataFrame, text_col: str) -> DataFrame:
    return df.withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))


def add_prediction(df: DataFrame, model: PipelineModel, text_col: str, *, out_col: str = "result") -> DataFrame:
    """Add the result struct. A text that cannot be scored counts as legitimate with confidence 0.5."""
    scored = model.transform(_prepared(df, text_col)).withColumn("_p", vector_to_array("probability"))
    missing = F.col(text_col).isNull()
    gibberish = F.when(missing, 0.5).otherwise(F.get("_p", F.lit(0)))
    legitimate = F.when(missing, 0.5).otherwise(F.get("_p", F.lit(1)))
    chosen = missing | (F.col("prediction") == 1.0)
    result = F.struct(
        chosen.alias("is_legitimate"),
        F.when(chosen, "legitimate").otherwise("gibberish").alias("label"),
        F.greatest(gibberish, legitimate).alias("confidence"),
        F.struct(gibberish.alias("gibberish"), legitimate.alias("legitimate")).alias("probabilities"),
        F.when(missing, "missing text").alias("error"),
    )
    return scored.withColumn(out_col, result).select(*df.columns, out_col)
