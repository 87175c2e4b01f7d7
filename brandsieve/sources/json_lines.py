"""JSON Lines sources with declared schemas and a quarantine for lines that cannot be read."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from brandsieve.functions.text import no_strings, trim_ws
from brandsieve.session import written_once

log = logging.getLogger(__name__)

DESCRIPTION = "business_description string"
DESCRIPTION_OR_ALIAS = "business_description string, description string"
OUTPUT = "business_description string, target_domains array<string>, error string"
TRAINING = "business_description string, target_domains array<string>, source string"
#: Counters of a path and three numbers each: some 200 MB at most.
BROADCAST_SPLITS = 1_000_000


def _parsed(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Every line, blank ones too, as :func:`read_lines` gives them."""
    parsed = F.from_json(
        "line",
        f"{schema}, _bad string",
        {"columnNameOfCorruptRecord": "_bad", "allowSingleQuotes": "false", "mode": "PERMISSIVE"},
    )
    lines = spark.read.text(path).select(
        trim_ws(F.col("value")).alias("line"), F.col("_metadata.file_path").alias("file_path")
    )
    whole = F.col("line").startswith("{") & F.col("line").endswith("}")
    return (
        lines.select("line", "file_path", F.inline(F.array(parsed)))
        .withColumn("malformed", F.col("_bad").isNotNull() | ~whole)
        .drop("_bad")
    )


def read_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Every non-blank line: the fields of ``schema``, the raw ``line`` and ``malformed``.

    ``inline`` turns the parsed struct into columns and keeps filters above it, so each line
    is parsed once.
    """
    return _parsed(spark, path, schema).where(F.col("line") != "")


#: What a line can be to a reader that wants the text of one key.
KINDS = ("blank", "malformed", "keyless", "empty", "good")


def classified_lines(spark: SparkSession, path: str | list[str], schema: str, key: str) -> DataFrame:
    """Every line, blank ones too, with its ``kind``: keyless without the key or with null, empty where
    its text is only white space."""
    kind = (
        F.when(F.col("line") == "", "blank")
        .when(F.col("malformed"), "malformed")
        .when(F.col(key).isNull(), "keyless")
        .when(trim_ws(F.col(key)) == "", "empty")
        .otherwise("good")
    )
    return _parsed(spark, path, schema).withColumn("kind", kind)


def line_counts(lines: DataFrame) -> DataFrame:
    """Of each file, how many lines are of each kind. ``lines``: file_path, kind."""
    return lines.groupBy("file_path").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in KINDS))


def read_counted(spark: SparkSession, path: str | list[str], schema: str, key: str) -> tuple[DataFrame, Observation]:
    """The fields of the good lines, and an observation that holds the number of lines of each kind
    once these rows have been computed: the pass that reads them counts the others too."""
    seen = Observation()
    lines = classified_lines(spark, path, schema, key)
    lines = lines.observe(seen, *(F.count_if(F.col("kind") == k).alias(k) for k in KINDS))
    return lines.where(F.col("kind") == "good").drop("line", "file_path", "malformed", "kind"), seen


def warn_of_skipped(seen: Observation, path: str) -> dict[str, int]:
    """The counts of an observed pass; what was skipped is logged."""
    counts = {k: seen.get[k] for k in KINDS}
    skipped = {k: n for k, n in counts.items() if k != "good" and n}
    if skipped:
        log.warning("%s: %d lines read, skipped: %s", path, counts["good"], skipped)
    return counts


def readable(lines: DataFrame) -> DataFrame:
    return lines.where(~F.col("malformed")).drop("line", "file_path", "malformed")


def quarantined(lines: DataFrame) -> DataFrame:
    return lines.where("malformed").select("file_path", "line")


def read_descriptions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Trimmed, non-empty descriptions."""
    rows = readable(read_lines(spark, path, DESCRIPTION))
    trimmed = rows.select(trim_ws(F.coalesce("business_description", F.lit(""))).alias("business_description"))
    return trimmed.where(F.col("business_description") != "")


def read_descriptions_or_alias(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Descriptions as they are, from ``business_description`` or else ``description``."""
    rows = readable(read_lines(spark, path, DESCRIPTION_OR_ALIAS))
    either = F.coalesce("business_description", "description")
    return rows.select(either.alias("business_description")).where(F.col("business_description").isNotNull())


def read_descriptions_strict(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Descriptions as they are, from ``business_description`` only."""
    return readable(read_lines(spark, path, DESCRIPTION)).where(F.col("business_description").isNotNull())


def read_outputs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Model outputs; a missing description is '' and a missing list is empty."""
    return _with_defaults(readable(read_lines(spark, path, OUTPUT)))


def _with_defaults(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {
            "business_description": F.coalesce("business_description", F.lit("")),
            "target_domains": F.coalesce("target_domains", no_strings()),
        }
    )


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the path can be listed. Any other problem than a missing path is an error."""
    try:
        spark.read.text(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def existing(spark: SparkSession, paths: dict[str, str]) -> dict[str, str]:
    """The entries whose path exists; the others are logged and left out."""
    found = {}
    for version, path in paths.items():
        if path_exists(spark, path):
            found[version] = path
        else:
            log.warning("missing input for %s: %s", version, path)
    if not found:
        raise FileNotFoundError(f"none of the inputs exists: {sorted(paths.values())}")
    return found


def read_versions(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Outputs of several versions in one DataFrame, tagged with ``model_version``."""
    tables = [
        read_outputs(spark, path).withColumn("model_version", F.lit(version))
        for version, path in existing(spark, paths).items()
    ]
    union = tables[0]
    for table in tables[1:]:
        union = union.unionByName(table)
    return union


def read_labelled(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Training rows with a text and a known source, with their label."""
    from brandsieve.operators.training import labelled

    return labelled(readable(read_lines(spark, path, TRAINING)))


def read_training(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Training rows with defaults: '' for the text, no domains, source unknown."""
    rows = _with_defaults(readable(read_lines(spark, path, TRAINING)))
    return rows.withColumn("source", F.coalesce("source", F.lit("unknown")))


def read_numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Raw lines with their 1-based ``position``, in order of file name and place in the file.

    Each file split counts its lines (a small aggregate), offsets are summed over the splits,
    and every line adds its place within its split. No global sort and no single-task window
    over lines: only the split counters, one row per split, are ordered. They are written once
    and counted; up to ``BROADCAST_SPLITS`` they are broadcast, so that no line moves.
    """
    lines = spark.read.text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("_row"),
    )
    splits = (
        lines.groupBy("file_path", "block")
        .agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.orderBy("file_path", "block")) - F.col("_n"))
        .select("file_path", "block", "_first", "_before")
    )
    splits = written_once(splits)
    if splits.count() <= BROADCAST_SPLITS:
        splits = F.broadcast(splits)
    place: Column = F.col("_before") + F.col("_row") - F.col("_first") + 1
    return lines.join(splits, ["file_path", "block"]).select(place.alias("position"), "line", "file_path")
