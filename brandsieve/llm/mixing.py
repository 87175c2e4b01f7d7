"""Mixing of sources to target weights by weighted fair queueing, in DataFrame operations only.

Documents are shuffled by the MD5 of their id and text; rows with both alike follow each other by
row number. A source's documents, up to three times over, queue in that order; each gets the virtual finish time (words of its source up to and with it)
/ (target of its source). The queue of all sources is cut where its words reach the budget.

Prefix sums never meet in one task: a source is split by ranges of the MD5 into buckets of
``BUCKET_ROWS`` documents (rows with the same id and text by their row numbers too), whose sums
are added first, and the queue's place of cutting is
found by two histograms of the finish times, so that a window sees one cell of them only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from brandsieve.llm.tables import WORD, cut, free_name

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
BUCKET_ROWS = 2000
#: Cells of the finish times from 0 to 1, of those beyond 1 up to _LAST, and within one cell.
_CELLS, _LAST, _SUB_CELLS = 1024, 8191, 4096
_EPOCHS = range(MOST_COPIES)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _place(doc_id: Column, text: Column) -> Column:
    """The place in the shuffled order, another for each row: 32 digits of id and text, 16 of the
    row. The order of equal rows can't be told from the result."""
    same = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.concat(F.md5(same.cast("binary")), F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, n, source_size -> with target: weighted shares of all words, none above
    ``MOST_COPIES`` times its source; the excess goes to the others by weight.

    With sources in the order of cap / weight, those before the first whose share fits under
    its cap are full, and the rest divides by weight.
    """
    every = Window.partitionBy(F.lit(1))
    by_name = every.orderBy(F.col("source").isNull(), "source")
    by_cap = every.orderBy("fill", F.col("source").isNull(), "source")
    listed = F.array(*map(F.lit, weights))
    return (
        sizes.withColumn("w", F.element_at(listed, (F.row_number().over(by_name) - 1) % len(weights) + 1))
        .withColumn("fill", MOST_COPIES * F.col("source_size") / F.col("w"))
        .withColumn(
            "full",
            F.coalesce(
                F.sum(MOST_COPIES * F.col("source_size")).over(by_cap.rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
        .withColumn("w_left", F.sum("w").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.sum("source_size").over(every) - F.col("full")) / F.col("w_left"))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "level"))).over(every)["level"])
        .select(
            "source",
            "n",
            "source_size",
            F.least(MOST_COPIES * F.col("source_size").cast("double"), F.col("level") * F.col("w")).alias("target"),
        )
    )


def _crossing(cells: DataFrame, start: int, budget: int) -> tuple[int, int] | None:
    """The first cell whose words pass the budget, and the words before it."""
    upto = F.sum("words").over(Window.partitionBy(F.lit(1)).orderBy("cell")) + start
    row = cells.withColumn("upto", upto).where(F.col("upto") > budget).orderBy("cell").first()
    return None if row is None else (row["cell"], row["upto"] - row["words"])


def decide(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target, cuts: copy k of a document is taken if its place is at
    most ``cuts[k]``. ``rows``: source, place, size, held in a written table."""
    sources = cut(
        targets(rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size")), weights)
    )
    budget = sources.agg(F.sum("source_size")).first()[0] or 0
    same = F.col("r.source").eqNullSafe(F.col("s.source"))
    buckets = F.ceil(F.col("n") / BUCKET_ROWS)
    placed = rows.alias("r").join(sources.alias("s"), same).select(
        "r.*",
        "source_size",
        "target",
        F.shiftright(F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * buckets, 32).alias("bucket"),
    )
    hot = cut(placed.groupBy("source", "bucket").count().where(F.col("count") > 4 * BUCKET_ROWS).select("source", "bucket"))
    part = F.lit("")
    if hot.limit(1).count():
        # many rows with one id and text: parts of at most 4,096 rows, in the order of the places
        found = same & (F.col("r.bucket") == F.col("s.bucket"))
        placed = placed.alias("r").join(hot.withColumn("hot", F.lit(True)).alias("s"), found, "left").select("r.*", "hot")
        part = F.when(F.col("hot"), F.substring("place", 1, 45)).otherwise("")
    placed = placed.withColumn("part", part)
    before = (
        placed.groupBy("source", "bucket", "part")
        .agg(F.sum("size").alias("words"))
        .select(
            "source",
            "bucket",
            "part",
            F.coalesce(
                F.sum("words").over(
                    Window.partitionBy("source").orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ).alias("before"),
        )
    )
    upto = F.sum("size").over(Window.partitionBy("source", "bucket", "part").orderBy("place"))
    queued = (
        placed.withColumn("upto", upto)
        .alias("r")
        .join(before.alias("s"), same & (F.col("r.bucket") == F.col("s.bucket")) & (F.col("r.part") == F.col("s.part")))
        .select("r.source", "place", "size", "source_size", "target", (F.col("upto") + F.col("before")).alias("upto"))
    )
    items = (
        queued.where("target > 0 AND size > 0")
        .withColumn("copy", F.explode(F.array(*map(F.lit, _EPOCHS))))
        .withColumn("finish", (F.col("copy") * F.col("source_size") + F.col("upto")) / F.col("target"))
        .withColumn("cell", F.least(F.floor(F.col("finish") * _CELLS), F.lit(_LAST)))
        .withColumn("sub_cell", F.least(F.floor((F.col("finish") * _CELLS - F.col("cell")) * _SUB_CELLS), F.lit(_SUB_CELLS)))
        .select("source", "place", "size", "copy", "finish", "cell", "sub_cell")
    )
    items = cut(items)
    taken = items.select("source", "place", "copy")
    found = _crossing(items.groupBy("cell").agg(F.sum("size").alias("words")), 0, budget)
    if found:
        cell, words = found
        within = items.where(F.col("cell") == cell)
        sub_cell, words = _crossing(
            within.groupBy(F.col("sub_cell").alias("cell")).agg(F.sum("size").alias("words")), words, budget
        )
        queue = F.sum("size").over(Window.partitionBy("cell").orderBy("finish", "place", "copy"))
        last = within.where(F.col("sub_cell") == sub_cell).withColumn("upto", queue + words).where(F.col("upto") <= budget)
        sooner = (F.col("cell") < cell) | ((F.col("cell") == cell) & (F.col("sub_cell") < sub_cell))
        taken = items.where(sooner).unionByName(last.drop("upto")).select("source", "place", "copy")
    cuts = taken.groupBy("source").agg(
        F.array(*(F.max(F.when(F.col("copy") == k, F.col("place"))) for k in _EPOCHS)).alias("cuts")
    )
    return cut(
        sources.alias("r")
        .join(cuts.alias("s"), same, "left")
        .select("r.source", "source_size", "target", "cuts")
    )


def _copies(place: Column, cuts: Column) -> Column:
    return sum((F.coalesce((place <= cuts[k]).cast("long"), F.lit(0)) for k in _EPOCHS), F.lit(0))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        _place(F.col("doc_id"), F.col("text").cast("string")).alias("place"),
        word_count(F.col("text").cast("string")).alias("size"),
    )


def shares(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken (words in the mix, copies counted).

    Null texts have size 0 and nothing to take; a null source is one of the sources; rows are
    taken one by one, those with a null or repeated doc_id too. An empty table gives an empty
    result.
    """
    rows = cut(_rows(docs))
    return (
        rows.alias("r")
        .join(decide(rows, weights).alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
        .select("doc_id", "size", "source_size", "target", (F.col("size") * _copies(F.col("place"), F.col("cuts"))).alias("taken"))
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mix itself: every document as often as it is taken (0 to 3 times), all columns.

    Rows are numbered as the table reads (files, written tables); were it read in another order,
    only rows with the id and text at which a source is cut could be taken once more or less.
    """
    decisions = decide(cut(_rows(docs)), weights)
    names = [F.col(f"r.`{c}`") for c in docs.columns]
    place = free_name(docs, "place")
    copies = _copies(F.col(f"r.{place}"), F.col("s.cuts")).cast("int")
    return (
        docs.withColumn(place, _place(F.col("doc_id"), F.col("text").cast("string")))
        .alias("r")
        .join(decisions.alias("s"), F.col("r.source").cast("string").eqNullSafe(F.col("s.source")))
        .select(*names, F.explode(F.array_repeat(F.lit(1), copies)).alias(free_name(docs, "copy")))
        .select(docs.columns)
    )


ORACLE = """
WITH rows AS (
  SELECT doc_id, source,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')))
           || lpad(CAST(row_number() OVER (PARTITION BY doc_id, text) AS VARCHAR), 16, '0') AS place,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w FROM sizes),
filled AS (
  SELECT *, 3 * source_size / w AS fill,
         (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (
            ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY 3 * source_size / w, source NULLS LAST
                        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (
  SELECT source, source_size,
         least(3.0::DOUBLE * source_size, w * (SELECT level FROM filled WHERE level <= fill ORDER BY fill, level LIMIT 1)) AS target
  FROM filled),
queued AS (
  SELECT r.*, t.source_size, t.target,
         sum(r.size) OVER (PARTITION BY r.source ORDER BY r.place) AS upto
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source),
queue AS (
  SELECT source, place, size, copy,
         sum(size) OVER (ORDER BY (copy * source_size + upto) / target, place, copy)
           <= (SELECT sum(size) FROM rows) AS taken
  FROM queued, (SELECT unnest([0, 1, 2]) AS copy) WHERE target > 0 AND size > 0),
cuts AS (SELECT source, copy, max(place) AS place FROM queue WHERE taken GROUP BY ALL)
SELECT q.doc_id, CAST(q.size AS BIGINT) AS size, q.source_size, CAST(q.target AS DOUBLE) AS target,
       CAST(q.size * (SELECT count(*) FROM cuts c
                      WHERE c.source IS NOT DISTINCT FROM q.source AND q.place <= c.place) AS BIGINT) AS taken
FROM queued q
"""
