"""Numbers of greedy word pieces, counted in linear time by a longest-match automaton.

The automaton is a trie of the vocabulary in which every node also knows what to do when the
next character has no edge: how many pieces the longest matches so far make (``pops``) and
where the rest of the match goes on (``link``). Pieces are counted, never built.

The vocabulary is that of a byte-level tokenizer: pieces that begin a word start with a blank,
pieces that go on with it don't, as in a word-piece vocabulary. Every single byte is a piece,
so each word has a count. Distinct words run through the automaton once a worker.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache
import json

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, functions as F

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
_REMEMBERED, _LONGEST = 800_000, 64


class Automaton:
    """Nodes are numbers: 0 begins a word, 1 goes on with one."""

    def __init__(self, first: Iterable[bytes], following: Iterable[bytes]):
        """``first``: pieces that begin a word; ``following``: pieces after them."""
        self.edges: list[dict[int, int]] = [{}, {}]
        self.ends = [False, False]
        for root, pieces in ((0, first), (1, following)):
            for piece in pieces:
                self._add(root, piece)
        self.pops, self.link = [0] * len(self.edges), [-1] * len(self.edges)
        self._connect()

    def _add(self, node: int, piece: bytes) -> None:
        for byte in piece:
            if (after := self.edges[node].get(byte)) is None:
                after = self.edges[node][byte] = len(self.edges)
                self.edges.append({})
                self.ends.append(False)
            node = after
        self.ends[node] = True

    def _connect(self) -> None:
        """A node that is a piece pops itself and goes on at node 1. Any other pops what its
        parent pops, then more, until the rest has an edge for its last byte."""
        queue = deque((node, byte, after) for node in (0, 1) for byte, after in self.edges[node].items())
        while queue:
            parent, byte, node = queue.popleft()
            if self.ends[node]:
                self.pops[node], self.link[node] = 1, 1
            else:
                at, pops = self.link[parent], self.pops[parent]
                while at != -1 and byte not in self.edges[at]:
                    pops, at = pops + self.pops[at], self.link[at]
                if at != -1:
                    self.pops[node], self.link[node] = pops, self.edges[at][byte]
            queue.extend((node, after_byte, after) for after_byte, after in self.edges[node].items())

    def count(self, word: bytes) -> int | None:
        """Pieces of the word; None if greedy matching gets stuck."""
        edges, pops, link = self.edges, self.pops, self.link
        node, total = 0, 0
        for byte in word:
            while (after := edges[node].get(byte)) is None:
                if link[node] == -1:
                    return None
                total += pops[node]
                node = link[node]
            node = after
        while node > 1:
            if link[node] == -1:
                return None
            total += pops[node]
            node = link[node]
        return total


def bytes_of_characters() -> dict[str, int]:
    """What each character of a byte-level vocabulary stands for: printable Latin-1 characters
    for themselves, the others, in order, for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def vocabulary(path: str = VOCABULARY) -> tuple[list[bytes], list[bytes]]:
    """(pieces that begin a word, without the blank; pieces that go on with it)."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    special = {t["content"] for t in content["added_tokens"]}
    value = bytes_of_characters()
    pieces = [bytes(map(value.__getitem__, t)) for t in content["model"]["vocab"] if t not in special]
    first = [p[1:] for p in pieces if p.startswith(b" ") and len(p) > 1]
    following = [p for p in pieces if not p.startswith(b" ")]
    # a single byte begins a word even where no longer piece with a blank does
    return sorted({*first, *(p for p in following if len(p) == 1)}), following


@lru_cache(maxsize=2)
def automaton(path: str = VOCABULARY) -> Automaton:
    return Automaton(*vocabulary(path))


class _Known(dict):
    def __init__(self, machine: Automaton):
        self.machine = machine

    def __missing__(self, word: bytes) -> int:
        count = self.machine.count(word)
        if len(word) <= _LONGEST and len(self) < _REMEMBERED:
            self[word] = count
        return count


@lru_cache(maxsize=2)
def _known(path: str) -> _Known:
    return _Known(automaton(path))


def _counted(batches: Iterator[pd.DataFrame], path: str) -> Iterator[pd.DataFrame]:
    known = _known(path)
    for batch in batches:
        words = [t.encode("utf-8", "surrogatepass").split() for t in batch["text"]]
        if len(known) >= _REMEMBERED:
            known.clear()
        yield pd.DataFrame(
            {
                "doc_id": batch["doc_id"].astype("Int64"),
                "n_words": [len(w) for w in words],
                "n_pieces": [sum(map(known.__getitem__, w)) for w in words],
                "longest_word": [max(map(known.__getitem__, w), default=0) for w in words],
            }
        )


def count_tokens(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Per row: doc_id, n_words, n_pieces (of all words), longest_word (most pieces of a word).

    Words are runs of anything but ASCII white space, in UTF-8, case kept. Null and empty texts
    have no words; repeated rows and null ids come back as they are; other columns are ignored.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    return rows.mapInPandas(
        lambda it: _counted(it, path), "doc_id long, n_words long, n_pieces long, longest_word long"
    )
