"""Training-set preparation: labels, balance, split, weights, tokens and classifier metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brandsieve import fixed_values as V
from brandsieve.functions.text import hash_fraction, words
from brandsieve.operators.sampling import in_samples
from brandsieve.session import written_once


def label_of(source: Column) -> Column:
    """1 legitimate, 0 gibberish, null for any other source."""
    return F.when(source.isin(V.LEGITIMATE_SOURCES), 1).when(source.isin(V.GIBBERISH_SOURCES), 0)


def labelled(df: DataFrame, text_col: str = "business_description", source_col: str = "source") -> DataFrame:
    """Rows with a text and a known source, with their label."""
    text, source = F.col(text_col), F.col(source_col)
    kept = df.where(text.isNotNull() & (text != "") & source.isNotNull() & (source != ""))
    return kept.withColumn("label", label_of(source)).where(F.col("label").isNotNull())


def label_counts(df: DataFrame, label_col: str = "label") -> DataFrame:
    """One row: positives, negatives and the share of positives in percent."""
    return df.agg(
        F.count_if(F.col(label_col) == 1).alias("positives"),
        F.count_if(F.col(label_col) == 0).alias("negatives"),
        (F.avg(F.col(label_col).cast("double")) * 100).alias("positive_pct"),
    )


def balance(df: DataFrame, id_col: str, label_col: str = "label", *, tail: int = V.PRESERVED_TAIL, seed: int = 42) -> DataFrame:
    """Undersample the larger class to the size of the smaller one.

    Of surplus positives the last ``tail`` by id are kept and the rest is sampled; if the
    target is not above ``tail``, the oldest of that tail are kept. Surplus negatives are
    sampled. Which rows stay is decided by filters against a few constants that small
    aggregates find beforehand (see :func:`brandsieve.operators.sampling.in_samples`); no
    class is gathered in one task.
    """
    pool = written_once(df.select(id_col, label_col))  # texts are read once, at the end
    counts = label_counts(pool, label_col).first()
    target = min(counts["positives"], counts["negatives"])
    ident, label = F.col(id_col), F.col(label_col)
    keep_positive = keep_negative = F.lit(True)
    if counts["positives"] > target:
        positives = pool.where(label == 1).select(id_col)
        last = positives.orderBy(ident.desc()).limit(tail)
        if target > tail:
            start = last.agg(F.min(id_col)).first()[0]
            older = pool.where((label == 1) & (ident < start))
            keep_positive = (ident >= start) | in_samples(older, id_col, label_col, {1: target - tail}, seed=seed)
        else:
            kept = last.orderBy(id_col).limit(target).agg(F.min(id_col), F.max(id_col)).first()
            keep_positive = ident.between(*kept)
    if counts["negatives"] > target:
        keep_negative = in_samples(pool, id_col, label_col, {0: target}, seed=seed)
    return df.where(F.when(label == 1, keep_positive).otherwise(keep_negative))


def split_by_hash(df: DataFrame, id_col: str, *, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``split``: a seeded hash of the id against the test share. Narrow, stable under appends."""
    return df.withColumn("split", F.when(hash_fraction(F.col(id_col), seed) < test_size, "test").otherwise("train"))


def split_exact(
    df: DataFrame, id_col: str, label_col: str = "label", *, test_size: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``split`` with exact stratified sizes: ceil(n * test_size) test rows, shared in proportion.

    The place left over by rounding down goes to the label with the larger remainder.
    """
    pool = written_once(df.select(id_col, label_col))
    counts = label_counts(pool, label_col).first()
    ones, zeros = counts["positives"], counts["negatives"]
    n = ones + zeros
    wanted = math.ceil(n * test_size)
    test_ones, rest_ones = divmod(wanted * ones, max(n, 1))
    test_zeros, rest_zeros = divmod(wanted * zeros, max(n, 1))
    spare = wanted - test_ones - test_zeros
    if rest_ones > rest_zeros:
        test_ones += spare
    else:
        test_zeros += spare
    in_test = in_samples(pool, id_col, label_col, {1: test_ones, 0: test_zeros}, seed=seed)
    return df.withColumn("split", F.when(in_test, "test").otherwise("train"))


def eval_subset(df: DataFrame, id_col: str, n: int = 50, *, disjoint: bool = False) -> DataFrame:
    """The first n rows by id, as an evaluation set.

    They stay in the training set too, unless ``disjoint``: then all rows come back with
    ``split`` eval or train. Ids must be unique for that.
    """
    if not disjoint:
        return df.orderBy(id_col).limit(n)
    last = df.select(id_col).orderBy(id_col).limit(n).agg(F.max(id_col)).first()[0]
    return df.withColumn("split", F.when(F.col(id_col) <= F.lit(last), "eval").otherwise("train"))


def class_weights(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Balanced weight per label: rows / (labels * rows of the label)."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    overall = (
        df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(label_col).alias("labels"))
        .select(F.struct("rows", "labels").alias("o"))
        .scalar()
    )
    return counts.withColumn("weight", overall["rows"] / (overall["labels"] * F.col("n")))


def add_class_weight(df: DataFrame, label_col: str = "label") -> DataFrame:
    """The balanced weight as a column, for two labels, from one scalar."""
    positives, negatives = F.col("positives"), F.col("negatives")
    rows = positives + negatives
    present = (positives > 0).cast("int") + (negatives > 0).cast("int")
    weights = F.struct(
        F.try_divide(rows, present * positives).alias("positive"),
        F.try_divide(rows, present * negatives).alias("negative"),
    )
    weight = label_counts(df, label_col).select(weights.alias("weights")).scalar()
    return df.withColumn(
        "weight", F.when(F.col(label_col) == 1, weight["positive"]).otherwise(weight["negative"])
    )


def token_ids(text: Column, max_length: int, *, vocabulary: int = 30_000) -> Column:
    """Default tokenizer: the first lower-case words, each hashed to an id in [0, vocabulary)."""
    return F.transform(
        F.slice(words(F.lower(text)), 1, max_length),
        lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint"), F.lit(vocabulary)).cast("int"),
    )


def add_tokens(df: DataFrame, ids: Column, *, max_length: int) -> DataFrame:
    """Add input_ids (truncated), attention_mask and labels (a copy of the ids)."""
    return df.withColumn("input_ids", F.slice(ids, 1, max_length)).withColumns(
        {"attention_mask": F.transform("input_ids", lambda _: F.lit(1)), "labels": F.col("input_ids")}
    )


def pad_tokens(df: DataFrame, *, multiple: int = 8, pad_id: int = 0, ignore_id: int = -100) -> DataFrame:
    """Pad each row to the next multiple; ``bucket`` is that length, by which rows can be batched."""
    size = F.size("input_ids")
    bucket = (F.ceil(size / multiple) * multiple).cast("int")

    def padded(name: str, filler: int) -> Column:
        return F.concat(F.col(name), F.array_repeat(F.lit(filler), bucket - size))

    return df.withColumns(
        {
            "bucket": bucket,
            "input_ids": padded("input_ids", pad_id),
            "attention_mask": padded("attention_mask", 0),
            "labels": padded("labels", ignore_id),
        }
    )


def token_batches(
    df: DataFrame, id_col: str, *, max_tokens: int = 8192, multiple: int = 8, slot_rows: int = 50_000, pad_id: int = 0, ignore_id: int = -100
) -> DataFrame:
    """Padded training batches of rows with input_ids: one row per batch, with bucket, slot, batch, ids and the
    padded input_ids, attention_mask and labels.

    A batch holds sequences of one bucket, the length rounded up to ``multiple``, so all are padded to
    its longest and no further; it has at most ``max_tokens`` of them, padding included (a longer
    sequence is a batch alone). Within a bucket rows are dealt by id to slots of about ``slot_rows``, so a
    bucket with most of the rows, as truncation makes one, is no single task; each slot numbers its own
    batches. One shuffle: a window and a grouping by the same keys.
    """
    size = F.size("input_ids")
    slots = F.greatest(F.lit(1), F.ceil(df.agg(F.count(F.lit(1)).alias("n")).scalar() / slot_rows))
    dealt = pad_tokens(df.select(id_col, "input_ids", "attention_mask", "labels", size.alias("n_tokens")), multiple=multiple, pad_id=pad_id, ignore_id=ignore_id)
    dealt = dealt.withColumn("slot", F.floor(hash_fraction(F.col(id_col), "slot") * slots).cast("int"))
    place = F.row_number().over(Window.partitionBy("bucket", "slot").orderBy(id_col)) - 1
    rows = F.greatest(F.lit(1), F.floor(F.lit(max_tokens) / F.greatest(F.col("bucket"), F.lit(1))))
    members = F.array_sort(F.collect_list(F.struct(id_col, "input_ids", "attention_mask", "labels")))
    return (
        dealt.withColumn("batch", F.floor(place / rows).cast("int"))
        .groupBy("bucket", "slot", "batch")
        .agg(members.alias("members"), F.sum("n_tokens").alias("n_tokens"))
        .select(
            "bucket", "slot", "batch", "n_tokens", F.col(f"members.{id_col}").alias("ids"),
            *[F.col(f"members.{c}").alias(c) for c in ("input_ids", "attention_mask", "labels")],
        )
    )


def dataset_metadata(df: DataFrame, **options: str | int) -> DataFrame:
    """One row: number of examples and the options the set was made with."""
    literals = [F.lit(v).alias(k) for k, v in options.items()]
    return df.agg(F.count(F.lit(1)).alias("total_examples")).select("total_examples", *literals)


def token_profile(df: DataFrame, columns: tuple[str, ...] = ("input_ids", "attention_mask", "labels")) -> DataFrame:
    """Rows and the shortest, longest and mean array length of each token column."""
    measures = []
    for name in columns:
        size = F.size(name)
        measures += [
            F.min(size).cast("bigint").alias(f"{name}_min"),
            F.max(size).cast("bigint").alias(f"{name}_max"),
            F.avg(size).alias(f"{name}_avg"),
        ]
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *measures)


def confusion(df: DataFrame, label_col: str = "label", predicted_col: str = "prediction") -> DataFrame:
    """Row counts per (label, prediction)."""
    return df.groupBy(label_col, predicted_col).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, label_col: str = "label", predicted_col: str = "prediction") -> DataFrame:
    """One row per actual label with a count per predicted label."""
    return df.groupBy(label_col).agg(
        F.count_if(F.col(predicted_col) == 0).alias("predicted_gibberish"),
        F.count_if(F.col(predicted_col) == 1).alias("predicted_legitimate"),
    )


def classification_metrics(df: DataFrame, label_col: str = "label", predicted_col: str = "prediction") -> DataFrame:
    """One row of accuracy, per-class, macro and weighted scores, from one four-counter aggregate."""
    actual, predicted = F.col(label_col), F.col(predicted_col)
    cells = df.agg(
        *[F.count_if((actual == a) & (predicted == p)).alias(f"n{a}{p}") for a in (0, 1) for p in (0, 1)]
    )

    def safe(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(0.0)

    def f1(p: Column, r: Column) -> Column:
        return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)

    n00, n01, n10, n11 = (F.col(c) for c in ("n00", "n01", "n10", "n11"))
    rows = n00 + n01 + n10 + n11
    scored = cells.withColumns(
        {
            "accuracy": safe(n00 + n11, rows),
            "precision_gibberish": safe(n00, n00 + n10),
            "recall_gibberish": safe(n00, n00 + n01),
            "precision_legitimate": safe(n11, n11 + n01),
            "recall_legitimate": safe(n11, n11 + n10),
        }
    ).withColumns(
        {
            "f1_gibberish": f1(F.col("precision_gibberish"), F.col("recall_gibberish")),
            "f1_legitimate": f1(F.col("precision_legitimate"), F.col("recall_legitimate")),
        }
    )
    return scored.withColumns(
        {
            "f1_macro": (F.col("f1_gibberish") + F.col("f1_legitimate")) / 2,
            "precision_macro": (F.col("precision_gibberish") + F.col("precision_legitimate")) / 2,
            "recall_macro": (F.col("recall_gibberish") + F.col("recall_legitimate")) / 2,
            "f1_weighted": safe(
                F.col("f1_gibberish") * (n00 + n01) + F.col("f1_legitimate") * (n10 + n11), rows
            ),
        }
    ).drop("n00", "n01", "n10", "n11")
