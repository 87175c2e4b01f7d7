"""A Merkle manifest of a table: leaves, roots by source, a root over them, and inclusion proofs.

Leaves are appended in order. Open subtrees stand in a counter to base ``ARITY``; each carries the
partial witnesses of what lies below it, and when later siblings complete a run, the witnesses of
its members are extended by the others. Appends are aligned in blocks of ``ARITY ** BLOCK_LEVELS`` leaves,
one group of rows each, and the root of a block is appended to the next tree up in the same way, until
one root a source is left; the roots of the sources are appended to the last tree. So the number of
rounds is a logarithm of the rows, and a task holds one block.

A witness is a list of steps (digests to the left of the node, digests to the right), from the leaf
up. Witnesses of leaves never travel: a block gets the witness of its own root, and its leaves are
proved where they lie.
"""

from __future__ import annotations

from collections.abc import Iterable
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from brandsieve.llm.tables import cut, in_fold

ARITY = 3
#: Levels of a block: 3 ** 8 = 6,561 leaves.
BLOCK_LEVELS = 8
_STEPS = "steps array<struct<left: string, right: string>>"
_ABOVE = f"tree string, rank long, subroot string, root string, {_STEPS}"

Step = tuple[str, str]


def digest(content: str) -> str:
    return sha256(content.encode()).hexdigest()


class OpenSubtree:
    """A root whose run is not complete, and the witnesses of the nodes below it so far."""

    __slots__ = ("members", "node")

    def __init__(self, node: str, members: list[list[Step]]):
        self.node, self.members = node, members


class Appender:
    """An append-only tree; :meth:`append` takes a node, and the list it returns grows into the
    node's witness."""

    def __init__(self) -> None:
        self.open: list[list[OpenSubtree]] = [[]]

    def append(self, node: str) -> list[Step]:
        witness: list[Step] = []
        self._add(0, OpenSubtree(node, [witness]))
        return witness

    def _add(self, level: int, tree: OpenSubtree) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append(tree)
        if len(self.open[level]) == ARITY:
            self._complete(level)

    def _complete(self, level: int) -> None:
        """The open run of a level becomes a node of the next one."""
        run, self.open[level] = self.open[level], []
        nodes = [tree.node for tree in run]
        for i, tree in enumerate(run):
            step = "".join(nodes[:i]), "".join(nodes[i + 1 :])
            for witness in tree.members:
                witness.append(step)
        members = run[0].members
        for tree in run[1:]:
            members += tree.members
        self._add(level + 1, OpenSubtree(digest("".join(nodes)), members))

    def close(self, levels: int | None = None) -> str:
        """The root, incomplete runs closed from below: at height ``levels``, or once one node is left."""
        level = 0
        while True:
            there = self.open[level] if level < len(self.open) else []
            done = not any(self.open[level + 1 :]) and len(there) == 1
            if done and (levels is None or level == levels):
                return there[0].node
            if there:
                self._complete(level)
            level += 1


def folded(node: str, steps: Iterable[Step]) -> str:
    """The root that a node and its witness lead to."""
    for left, right in steps:
        node = digest(left + node + right)
    return node


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*map(_field, (doc_id, source, lang, n_chars, text))), 256)


def _ranked(nodes: DataFrame, *order: str) -> DataFrame:
    """With ``rank`` from 0 in its ``tree`` and the tree's ``size``, in a written table. Rows are
    sorted by range, so that no tree meets in one task; equal rows are told apart by their place."""
    in_order = [F.col(c).asc_nulls_first() for c in ("tree", *order, "at")]
    placed = cut(
        nodes.withColumn("at", F.monotonically_increasing_id())
        .repartitionByRange(*in_order)
        .sortWithinPartitions(*in_order)
        .withColumn("place", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("place", 33))
    )
    # One row a tree and partition that it lies in: no more than trees and partitions together.
    by_tree = Window.partitionBy("tree")
    runs = (
        placed.groupBy("tree", "part")
        .agg(F.count("*").alias("n"), F.min("place").alias("start"))
        .withColumn("before", F.sum("n").over(by_tree.orderBy("part")) - F.col("n"))
        .withColumn("size", F.sum("n").over(by_tree))
    )
    return cut(
        placed.join(runs, ["tree", "part"]).select(
            *nodes.columns, (F.col("place") - F.col("start") + F.col("before")).alias("rank"), "size"
        )
    )


def _append_all(rows: pd.DataFrame, levels: int) -> tuple[pd.DataFrame, list[list[Step]], str]:
    """The rows of one block in order, their witnesses in it, and its root."""
    rows = rows.sort_values("rank", ignore_index=True)
    tree = Appender()
    witnesses = [tree.append(node) for node in rows["node"]]
    return rows, witnesses, tree.close(levels if rows["size"].iloc[0] > ARITY**levels else None)


def _block(levels: int) -> Column:
    return F.floor(F.col("rank") / ARITY**levels).cast("long").alias("block")


def _closed(nodes: DataFrame, levels: int) -> DataFrame:
    """The roots of the blocks as nodes of the next trees: tree, rank, size, node."""

    def close(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows, _, root = _append_all(rows, levels)
        size = -(-int(rows["size"].iloc[0]) // ARITY**levels)
        return pd.DataFrame({"tree": [key[0]], "rank": [key[1]], "size": [size], "node": [root]})

    schema = "tree string, rank long, size long, node string"
    return nodes.select("tree", "rank", "size", "node").groupBy("tree", _block(levels)).applyInPandas(close, schema)


def _forest(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """Written tables: the nodes, their blocks, blocks of these and so on to one root a tree."""
    tables = [nodes]
    while (tables[-1].agg(F.max("size")).first()[0] or 0) > 1:
        tables.append(cut(_closed(tables[-1], levels)))
    return tables


def _above(steps: Iterable | None) -> list[Step]:
    return [(step["left"], step["right"]) for step in steps]


def _extended(tables: list[DataFrame], ends: DataFrame, levels: int) -> DataFrame:
    """Witnesses up to the root for the roots of the blocks of ``tables[0]``. ``ends``: those of the
    roots of the trees; tree, rank 0, subroot, root, steps."""

    def extend(key: tuple, rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows, witnesses, _ = _append_all(rows, levels)
        rest = _above(above["steps"].iloc[0])
        steps = [[{"left": a, "right": b} for a, b in [*own, *rest]] for own in witnesses]
        roots = {c: above[c].iloc[0] for c in ("subroot", "root")}
        return rows[["tree", "rank"]].assign(**roots, steps=steps)

    for nodes in reversed(tables[1:-1]):
        pairs = nodes.groupBy("tree", _block(levels)).cogroup(ends.groupBy("tree", "rank"))
        ends = cut(pairs.applyInPandas(extend, _ABOVE))
    return ends


def _ends(roots: DataFrame, levels: int) -> DataFrame:
    """Of each tree, the witness of its root in the tree over all of them, and both roots."""

    def extend(key: tuple, rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows, witnesses, _ = _append_all(rows, levels)
        rest = _above(above["steps"].iloc[0])
        steps = [[{"left": a, "right": b} for a, b in [*own, *rest]] for own in witnesses]
        return pd.DataFrame(
            {"tree": rows["name"], "rank": 0, "subroot": rows["node"], "root": above["root"].iloc[0], "steps": steps}
        )

    named = roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node")
    tables = _forest(_ranked(named, "name"), levels)
    top = tables[-1].select(
        "tree",
        "rank",
        F.col("node").alias("subroot"),
        F.col("node").alias("root"),
        F.array().cast(_STEPS.split(" ", 1)[1]).alias("steps"),
    )
    pairs = tables[0].groupBy("tree", _block(levels)).cogroup(_extended(tables, top, levels).groupBy("tree", "rank"))
    return cut(pairs.applyInPandas(extend, _ABOVE))


def _proofs(docs: DataFrame, offered: Column, levels: int, finish, schema: str) -> DataFrame:
    """``finish`` of every block: its rows, the witnesses in it, and the witness of its root."""
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    leaves = docs.select(
        F.coalesce(F.concat(F.lit(":"), F.col("source").cast("string")), F.lit("")).alias("tree"),  # null is first
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf(*values).alias("node"),
        offered.alias("offered"),
    )
    ranked = _ranked(leaves, "doc_id", "node")
    tables = _forest(ranked, levels)
    above = _extended(tables, _ends(tables[-1], levels), levels)

    def prove(key: tuple, rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows, witnesses, _ = _append_all(rows, levels)
        roots = {c: above[c].iloc[0] for c in ("subroot", "root")}
        rows = rows.rename(columns={"node": "leaf"}).assign(**roots)
        return finish(rows, witnesses, _above(above["steps"].iloc[0]))

    pairs = ranked.groupBy("tree", _block(levels)).cogroup(above.groupBy("tree", "rank"))
    return pairs.applyInPandas(prove, schema)


def inclusion_proofs(docs: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """Per row: doc_id, leaf, subroot (of its source), root, steps (the witness, from the leaf up;
    :func:`folded` gives the root). See :func:`manifest_report` for odd rows."""

    def finish(rows: pd.DataFrame, witnesses: list[list[Step]], ends: list[Step]) -> pd.DataFrame:
        steps = [[{"left": a, "right": b} for a, b in [*own, *ends]] for own in witnesses]
        return rows[["doc_id", "leaf", "subroot", "root"]].assign(steps=steps)

    schema = f"doc_id long, leaf string, subroot string, root string, {_STEPS}"
    return _proofs(docs, F.lit(None).cast("string"), levels, finish, schema)


def manifest_report(docs: DataFrame, folds: int = 2, levels: int = BLOCK_LEVELS) -> DataFrame:
    """Per row: doc_id, leaf, subroot (of its source), root, proof_sha256, folded_root, verified.

    Rows whose id falls in fold 0 of ``folds`` are offered for proof without the line feeds of their
    text; ``folded_root`` comes from the offered leaf. A missing value is told from an empty one;
    rows without an id come first in their source and are offered as they are; rows with one id go
    by their leaf, equal ones are leaves of their own; a null source is a source. An empty table
    gives an empty result. Other columns are ignored.
    """
    text = F.col("text").cast("string")
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = in_fold(F.col("doc_id"), folds, 0) & F.coalesce(F.contains(text, F.lit("\n")), F.lit(False))

    def finish(rows: pd.DataFrame, witnesses: list[list[Step]], ends: list[Step]) -> pd.DataFrame:
        tail = "".join(a + b for a, b in ends)
        rows["proof_sha256"] = [digest("".join([a + b for a, b in own]) + tail) for own in witnesses]
        offered = rows["offered"].where(rows["offered"].notna(), rows["leaf"])
        rows["folded_root"] = [folded(folded(node, own), ends) for node, own in zip(offered, witnesses)]
        rows["verified"] = rows["folded_root"] == rows["root"]
        return rows[["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]]

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _proofs(docs, F.when(changed, leaf(*values, F.replace(text, F.lit("\n"), F.lit("")))), levels, finish, schema)


ORACLE = r"""
WITH RECURSIVE rows AS MATERIALIZED (
  SELECT doc_id, coalesce(':' || source, '') AS source, md5(coalesce(text, '')) AS text_md5,
         sha256(concat(
           coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
           coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-'),
           coalesce(strlen(text) || ':' || text, '-'))) AS leaf,
         replace(text, chr(10), '') AS cleaned, lang, n_chars, source AS own_source
  FROM documents),
leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank FROM rows),
inner_nodes(source, level, rank, node, n) AS (
  SELECT source, 0, rank, leaf, count(*) OVER (PARTITION BY source) FROM leaves
  UNION ALL
  SELECT source, level + 1, rank // 3, sha256(string_agg(node, '' ORDER BY rank)), (max(n) + 2) // 3
  FROM inner_nodes WHERE n > 1 GROUP BY source, level, rank // 3),
subroots AS MATERIALIZED (
  SELECT source, node, row_number() OVER (ORDER BY source) - 1 AS rank FROM inner_nodes WHERE n = 1),
outer_nodes(level, rank, node, n) AS (
  SELECT 0, rank, node, count(*) OVER () FROM subroots
  UNION ALL
  SELECT level + 1, rank // 3, sha256(string_agg(node, '' ORDER BY rank)), (max(n) + 2) // 3
  FROM outer_nodes WHERE n > 1 GROUP BY level, rank // 3),
runs AS MATERIALIZED (
  SELECT source, level, rank // 3 AS run, list(node ORDER BY rank) AS nodes FROM inner_nodes WHERE n > 1 GROUP BY ALL),
outer_runs AS MATERIALIZED (
  SELECT level, rank // 3 AS run, list(node ORDER BY rank) AS nodes FROM outer_nodes WHERE n > 1 GROUP BY ALL),
offered AS MATERIALIZED (
  SELECT l.source, l.rank, l.doc_id, l.leaf,
         CASE WHEN list_reduce(  -- crc32 is the complement of this
           list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
           lambda crc, byte: list_reduce(
             list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
             lambda bits, _: xor(bits >> 1, 3988292384 * (bits & 1)))) % 2 = 1 THEN sha256(concat(
           coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(own_source) || ':' || own_source, '-'),
           coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-'),
           coalesce(strlen(cleaned) || ':' || cleaned, '-'))) ELSE leaf END AS offered
  FROM leaves l),
folds(source, leaf_rank, level, rank, node, proof) AS (
  SELECT source, rank, 0, rank, offered, '' FROM offered
  UNION ALL
  SELECT f.source, leaf_rank, f.level + 1, f.rank // 3,
         sha256(concat(array_to_string(r.nodes[1:f.rank % 3], ''), f.node, array_to_string(r.nodes[f.rank % 3 + 2:], ''))),
         concat(f.proof, array_to_string(r.nodes[1:f.rank % 3], ''), array_to_string(r.nodes[f.rank % 3 + 2:], ''))
  FROM folds f JOIN runs r ON r.source = f.source AND r.level = f.level AND r.run = f.rank // 3),
folded AS MATERIALIZED (
  SELECT source, leaf_rank, max_by(node, level) AS node, max_by(proof, level) AS proof FROM folds GROUP BY ALL),
outer_folds(source, leaf_rank, level, rank, node, proof) AS (
  SELECT f.source, leaf_rank, 0, s.rank, f.node, f.proof FROM folded f JOIN subroots s ON s.source = f.source
  UNION ALL
  SELECT f.source, leaf_rank, f.level + 1, f.rank // 3,
         sha256(concat(array_to_string(r.nodes[1:f.rank % 3], ''), f.node, array_to_string(r.nodes[f.rank % 3 + 2:], ''))),
         concat(f.proof, array_to_string(r.nodes[1:f.rank % 3], ''), array_to_string(r.nodes[f.rank % 3 + 2:], ''))
  FROM outer_folds f JOIN outer_runs r ON r.level = f.level AND r.run = f.rank // 3),
done AS (SELECT source, leaf_rank, max_by(node, level) AS node, max_by(proof, level) AS proof FROM outer_folds GROUP BY ALL)
SELECT o.doc_id, o.leaf, s.node AS subroot, r.node AS root, sha256(d.proof) AS proof_sha256, d.node AS folded_root,
       d.node = r.node AS verified
FROM offered o JOIN done d ON d.source = o.source AND d.leaf_rank = o.rank JOIN subroots s ON s.source = o.source,
     (SELECT node FROM outer_nodes WHERE n = 1) r
"""
