"""Removal of lines that many documents share, in DataFrame operations only.

Every line becomes a 128-bit hash of its key with its document's place in the table and its own
position, no text. These rows are written once, range-partitioned by hash and sorted by hash,
document and position, so that one pass over each range streams the documents of a key in order and
marks a key's first occurrence. What comes back is one keep bitmap a document, coded as runs of
kept lines; only documents that lose lines have one.

A hash that holds more than 1/``HOT_SHARE`` of the lines is split over all ranges by document. There
are fewer than ``HOT_SHARE`` of these, found on a sample of the written lines (missing one costs
balance, never a result); their documents are counted beforehand with partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from brandsieve.functions.text import let
from brandsieve.llm.tables import cut
from brandsieve.operators.joins import HOT_SHARE

MIN_DOCS = 10
_SAMPLE = 1 / 16
_LEAST = 16  # occurrences in the sample below which no key counts as hot
_BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TO_THE_END = (1 << 31) - 1
_HASH = ["h1", "h2"]


def _text(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def _split(text: Column) -> Column:
    return F.split(text, "\n", -1)


def lines(docs: DataFrame) -> DataFrame:
    """h1, h2 (hash of the key), row, position of every line whose key is not empty."""
    text = _text(docs)
    plain = F.octet_length(text) == F.char_length(text)
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return (
        docs.select(F.monotonically_increasing_id().alias("row"), low.alias("low"))
        .select("row", F.posexplode(_split(F.col("low"))).alias("position", "line"))
        .select("row", "position", F.btrim("line", F.lit(_BLANKS)).alias("key"))
        .where("key <> ''")
        .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "row", "position")
    )


def _hot(found: DataFrame) -> DataFrame:
    """Keys with a large share of the lines: h1, h2, their documents, their first place."""
    sample = found.sample(_SAMPLE, seed=1)
    limit = sample.count() / HOT_SHARE
    often = sample.groupBy(_HASH).agg(F.count("*").alias("n")).where((F.col("n") > limit) & (F.col("n") >= _LEAST))
    return cut(
        found.join(F.broadcast(cut(often.drop("n"))), _HASH)
        .groupBy(*_HASH, "row")
        .agg(F.min("position").alias("position"))
        .groupBy(_HASH)
        .agg(F.count("*").alias("hot_docs"), F.min(F.struct("row", "position")).alias("hot_first"))
    )


def dropped_lines(found: DataFrame, min_docs: int = MIN_DOCS, keep_first: bool = False) -> DataFrame:
    """row, position of the lines that go. ``found``: :func:`lines` in a written table."""
    slots = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slot = F.when(F.col("hot_docs").isNull(), 0).otherwise(F.pmod(F.xxhash64("row"), F.lit(slots)))
    ranged = (
        found.join(F.broadcast(_hot(found)), _HASH, "left")
        .withColumn("slot", slot.cast("int"))
        .repartitionByRange(*_HASH, "slot")
    )
    group = Window.partitionBy(*_HASH, "slot")
    in_order = group.orderBy("row", "position")
    opens = F.coalesce(F.lag("row").over(in_order) != F.col("row"), F.lit(True))
    marked = (
        ranged.withColumn("opens", opens.cast("int"))
        .withColumn("first", F.row_number().over(in_order) == 1)
        .withColumn("n_docs", F.coalesce("hot_docs", F.sum("opens").over(group)))
        .where(F.col("n_docs") >= min_docs)
    )
    if keep_first:
        alone = F.col("hot_first").isNull() | (F.col("hot_first") == F.struct("row", "position"))
        marked = marked.where(~(F.col("first") & alone))
    return marked.select("row", "position")


def keep_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, keep_first: bool = False) -> DataFrame:
    """row, n_dropped, keep: the runs (start, length) of lines that stay in document ``row``.

    A document without a row keeps all its lines. The last run reaches to the end of the
    document. A key counts once a document, each row being a document of its own, repeated rows
    and rows without an id too; lines whose key is empty always stay. With ``keep_first`` the
    first line of each key stays (the first document of the table, its first position). Null texts
    are empty; other columns are ignored; an empty table has no bitmaps. ``docs`` has to return its
    rows in the same order each time it is read, as written tables do: ``row`` is
    ``monotonically_increasing_id()`` over it.
    """
    gone = dropped_lines(cut(lines(docs)), min_docs, keep_first)
    by_row = Window.partitionBy("row")
    holes = (
        gone.withColumn("island", F.col("position") - F.row_number().over(by_row.orderBy("position")))
        .groupBy("row", "island")
        .agg(F.min("position").alias("hole"), F.count("*").cast("int").alias("length"))
    )
    end = F.col("hole") + F.col("length")
    following = F.lead("hole").over(by_row.orderBy("hole"))
    run = F.struct(end.alias("start"), F.coalesce(following - end, F.lit(_TO_THE_END)).alias("length"))
    return (
        holes.withColumn("run", run)
        .groupBy("row")
        .agg(
            F.sum("length").alias("n_dropped"),
            F.min("hole").alias("hole"),
            F.sort_array(F.collect_list("run")).alias("runs"),
        )
        .select(
            "row",
            "n_dropped",
            F.filter(
                F.concat(F.array(F.struct(F.lit(0).alias("start"), F.col("hole").alias("length"))), "runs"),
                lambda r: r["length"] > 0,
            ).alias("keep"),
        )
    )


def _applied(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The documents as ``doc``, with ``kept`` (the text that stays) and ``n_dropped``."""
    text = _text(docs)
    rows = docs.select(F.struct(*docs.columns).alias("doc"), text.alias("text"), F.monotonically_increasing_id().alias("row"))

    def chosen(all_lines: Column) -> Column:
        rest = F.size(all_lines)
        runs = F.transform(
            "keep", lambda r: F.slice(all_lines, r["start"] + 1, F.least(r["length"], rest - r["start"]))
        )
        return F.array_join(F.flatten(runs), "\n")

    # A hash join by shuffle does not sort the texts.
    return rows.join(bitmaps.hint("shuffle_hash"), "row", "left").select(
        "doc",
        "text",
        F.when(F.col("keep").isNull(), F.col("text")).otherwise(let(_split(F.col("text")), chosen)).alias("kept"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
    )


def without_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The documents with the lines of their bitmap gone; a null text without drops stays null."""
    rows = _applied(docs, bitmaps)
    text = F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("doc.text").cast("string"))
    return rows.select(*(text.alias(c) if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns))


def line_report(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines (before dropping), n_dropped, kept_sha256 of every document, in the terms of
    :func:`keep_bitmaps`."""
    docs = docs.select("doc_id", "text")
    return _applied(docs, keep_bitmaps(docs, min_docs)).select(
        "doc.doc_id",
        F.size(_split(F.col("text"))).cast("long").alias("n_lines"),
        "n_dropped",
        F.sha2("kept", 256).alias("kept_sha256"),
    )


ORACLE = r"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS MATERIALIZED (
  SELECT row, position, line,
         trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM (SELECT row, generate_subscripts(lines, 1) AS position, unnest(lines) AS line FROM docs)),
shared AS (SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT row) >= 10),
kept AS (
  SELECT row, count(*) AS n, string_agg(line, chr(10) ORDER BY position) AS text
  FROM lines WHERE key NOT IN (SELECT key FROM shared) GROUP BY row)
SELECT d.doc_id, CAST(len(d.lines) AS BIGINT) AS n_lines, CAST(len(d.lines) - coalesce(k.n, 0) AS BIGINT) AS n_dropped,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (row)
"""
