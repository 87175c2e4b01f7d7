"""Packing of tokenised documents into sequences of bounded length by best-two-fit.

Documents become pieces of at most ``LENGTH`` tokens. Full pieces are sequences of their own.
The others are dealt by their place in the written table into groups of about ``GROUP`` pieces,
repeated rows apart; a group packs its pieces alone, so groups are tasks of one size however many there are, and each costs
at most one sequence that is not well filled. A bin takes the longest piece that fits until
none does; if there is room left, its smallest piece gives way to the two unpacked pieces that
fill the larger gap best, if they fill it better.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType
from tokenizers import Tokenizer

from brandsieve.llm.tables import cut
from brandsieve.llm.token_counts import bytes_of_characters

LENGTH = 1024
END = 2
GROUP = 8192
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Characters of text numbered together, and words tokenised as one text.
_CHUNK, _JOINED = 2 << 20, 5000
_ODD = re.compile(r"\s "), re.compile(r" \s")
#: Bytes: marks; ASCII letters; first bytes of letters from U+00C0 to U+023F; and the second bytes
#: of the two signs among these.
_MARK, _LETTER, _LEAD, _SIGN = (np.isin(np.arange(256), list(x)) for x in (
    b".,;:!?", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", b"\xc3\xc4\xc5\xc6\xc7\xc8", b"\x97\xb7"
))
_INNER, _FIRST, _MARKS_ONLY = range(3)  # kinds of parts
_LATIN = "^\n?[!-~\u00c0-\u024f]+$"
_OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


def _odd(text: str) -> bool:
    """Whether white space meets white space somewhere, or an end of the text."""
    if any(pair in text for pair in ("  ", "\n ", " \n", "\n\n")) or text[0].isspace() or text[-1].isspace():
        return True
    return any(c in text for c in _OTHER_SPACE) and any(p.search(text) for p in _ODD)


def _parts(text: str) -> list[str]:
    """An odd text cut at each single blank between characters that are no white space."""
    return _BETWEEN.split(text)


def _rank_encoder(path: str) -> tiktoken.Encoding | None:
    """An encoder by ranks for the tokenizer file's vocabulary, if its ids follow its merges."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    vocabulary, value = content["model"]["vocab"], bytes_of_characters()
    special = {t["content"] for t in content["added_tokens"]}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in content["model"]["merges"]]
    order = [vocabulary["".join(p)] for p in pairs]
    if order != sorted(order) or content["pre_tokenizer"]["type"] != "ByteLevel":
        return None
    ranks = {bytes(map(value.__getitem__, t)): i for t, i in vocabulary.items() if t not in special}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class WordIds:
    """Ids of whole texts, as little-endian unsigned 32-bit numbers.

    The tokenizer's pattern never joins what lies before and after the places where
    :func:`_parts` cuts, nor a letter and the punctuation after it, so each distinct part of a chunk
    of texts is tokenised once: Arrow numbers the parts, and numpy puts their ids in place of the
    numbers. Parts are tokenised many to a text: the only tokens of it that start with a blank or a
    line feed are the first ones of the parts. Parts of plain Latin characters take the same
    vocabulary's faster encoder, which merges the same pairs in the same order; all others, and the
    first word of each text, take the tokenizer itself. Texts where white space meets white space
    are cut at single blanks only.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for token, i in vocabulary.items() if token.startswith(("\u0120", "\u010a"))]] = True
        self.plain = _rank_encoder(path)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _cut(self, text: str, n: int) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of a text of n plain parts, and how many each has, if the ids tell them apart."""
        ids = self.plain.encode_to_numpy(text, disallowed_special=())
        starts = np.flatnonzero(self.opens[ids])
        return (ids, np.diff(starts, append=len(ids))) if len(starts) == n else None

    def _whole(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts with a blank before them, or their line feed, end to end, and how many
        each has."""
        led = pc.if_else(pc.starts_with(parts, "\n"), parts, pc.binary_join_element_wise(" ", parts, ""))
        latin = pc.and_(pc.match_substring_regex(parts, _LATIN), pc.invert(pc.match_substring(parts, "<|")))
        plain = latin.to_numpy(zero_copy_only=False) & (self.plain is not None)
        some, sizes, pools = np.flatnonzero(plain), np.zeros(len(parts), np.int64), [np.zeros(0, "<u4")]
        for at in range(0, len(some), _JOINED):
            own = some[at : at + _JOINED]
            text = pc.binary_join(pa.ListArray.from_arrays([0, len(own)], led.take(pa.array(own))), "")[0].as_py()
            whole = self._cut(text, len(own))
            if whole is None:
                plain[own] = False
            else:
                pools.append(whole[0])
                sizes[own] = whole[1]
        others = np.flatnonzero(~plain)
        found = [self._ids(x) for x in led.take(pa.array(others)).to_pylist()]
        sizes[others] = [len(x) for x in found]
        if not found:
            return np.concatenate(pools), sizes
        # the others take their places among the plain ones
        own = np.repeat(plain, sizes)
        pool = np.empty(len(own), "<u4")
        pool[own], pool[~own] = np.concatenate(pools), np.concatenate(found)
        return pool, sizes

    def _pool(self, words: pa.Array, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts, end to end, and where each begins (one place more at the end). A code is
        a part's number plus its kind times the number of words; first the parts inside of texts."""
        inner = codes < len(words)
        pool, sizes = self._whole(words.take(pa.array(codes[inner])))
        rest = [self._ids(x) for x in words.take(pa.array(codes[~inner] % len(words))).to_pylist()]
        sizes = np.concatenate([sizes, np.array([len(x) for x in rest], np.int64)])
        return np.concatenate([pool, *rest]), np.concatenate([[0], np.cumsum(sizes)])

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts in which no white space meets white space or an end."""
        raw = [t.replace("\n", " \n").encode() for t in texts]
        content = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        gap = content == 32
        opens = np.empty(len(content), bool)
        opens[0], opens[1:] = True, gap[:-1]
        starts, ends = np.flatnonzero(opens & ~gap), np.flatnonzero(gap & ~opens)
        if not len(starts):
            return [b""] * len(texts)
        # punctuation at the end of a part is one of its own if a plain letter stands before it
        marked = np.flatnonzero(_MARK[content[ends - 1]])
        core, least = ends[marked], starts[marked]
        while (more := _MARK[content[core - 1]] & (core > least)).any():
            core = core - more
        last, lead = content[core - 1], content[core - 2]
        latin = (last >= 0x80) & _LEAD[lead] & ~((lead == 0xC3) & _SIGN[last])
        split = (core > least) & (_LETTER[last] | latin)
        marked, core = marked[split], core[split]
        # parts and their marks in order; marks and first parts are tokenised without a blank
        place = np.arange(len(starts))
        place[1:] += np.cumsum(np.bincount(marked, minlength=len(starts)))[:-1]
        n = len(starts) + len(marked)
        kind, stops = np.full(n, _INNER), np.empty(n, np.int64)
        begins = np.empty(n, np.int64)
        begins[place], stops[place] = starts, ends
        begins[place[marked] + 1], stops[place[marked] + 1] = core, ends[marked]
        stops[place[marked]], kind[place[marked] + 1] = core, _MARKS_ONLY
        firsts = np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in raw)]))
        bounds = np.append(place, n)[firsts]
        kind[bounds[:-1][bounds[:-1] < bounds[1:]]] = _FIRST
        offsets = np.concatenate([[0], np.cumsum(stops - begins)]).astype(np.int32)
        buffers = [None, pa.py_buffer(offsets), pa.py_buffer(content[~gap])]
        coded = pa.Array.from_buffers(pa.string(), n, buffers).dictionary_encode()
        words = coded.dictionary
        codes = coded.indices.to_numpy() + kind * len(words)
        there = np.zeros(3 * len(words), bool)
        there[codes] = True
        own = (np.cumsum(there) - 1)[codes]
        pool, begins = self._pool(words, np.flatnonzero(there))
        sizes = np.diff(begins)[own]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ids = pool[np.repeat(begins[own] - upto[:-1], sizes) + np.arange(upto[-1])]
        bounds = upto[bounds].tolist()
        return [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]

    def _encode_odd(self, text: str) -> bytes:
        start, *rest = _parts(text)
        return self._ids(start).tobytes() + self._whole(pa.array(rest, pa.string()))[0].tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        odd = [bool(t) and _odd(t) for t in texts]
        plain = iter(self._encode_plain([t for t, o in zip(texts, odd) if not o]))
        return [self._encode_odd(t) if o else next(plain) for t, o in zip(texts, odd)]


@lru_cache(maxsize=2)
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def _cut_up(total: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: full ones, after a shorter first one if need be."""
    first = total % length or min(total, length)
    return [(0, first), *((at, length) for at in range(first, total, length))]


def _pieces(batches: Iterator[pd.DataFrame], path: str, length: int, end: int, with_ids: bool):
    encoder, last = _word_ids(path), np.array([end], "<u4").tobytes()
    for batch in batches:
        upto = batch["text"].str.len().cumsum().to_numpy()
        for at in np.unique(upto // _CHUNK):  # bounds what one round holds in memory
            rows = batch[upto // _CHUNK == at]
            out = []
            for doc_id, ids in zip(rows["doc_id"], encoder.encode(rows["text"].tolist())):
                ids += last
                for piece, (start, n) in enumerate(_cut_up(len(ids) // 4, length)):
                    own = ids[4 * start : 4 * (start + n)]
                    out.append((doc_id, piece, start, n, zlib.crc32(own), own))
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            frame["piece"] = frame["piece"].astype("int32")
            yield frame if with_ids else frame.drop(columns="ids")


def pieces(
    docs: DataFrame, path: str = VOCABULARY, length: int = LENGTH, end: int = END, with_ids: bool = True
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if wanted, ids (binary, little-endian
    unsigned 32 bits) of every piece of every document; null texts count as empty."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    return rows.mapInPandas(lambda it: _pieces(it, path, length, end, with_ids), schema)


def best_two_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions in ``lengths`` (each 1 to ``capacity``)."""
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in range(len(lengths) - 1, -1, -1):
        stacks[lengths[i]].append(i)
    there = sum(1 << n for n in range(1, capacity + 1) if stacks[n])  # bit n: a piece of length n

    def longest(most: int) -> int:
        return (there & ((2 << most) - 1)).bit_length() - 1 if most > 0 else -1

    def take(n: int) -> int:
        nonlocal there
        i = stacks[n].pop()
        if not stacks[n]:
            there ^= 1 << n
        return i

    def best_pair(gap: int, least: int) -> tuple[int, int] | None:
        """The two lengths with the largest sum over ``least`` and up to ``gap``."""
        best, a = None, longest(gap - 1)
        while a > 0 and 2 * a > least:
            b = longest(min(a, gap - a))
            if b == a and len(stacks[a]) < 2:
                b = longest(a - 1)
            if b > 0 and a + b > least:
                best, least = (a, b), a + b
                if least == gap:
                    break
            a = longest(a - 1)
        return best

    bins = []
    while there:
        own, gap = [], capacity
        while (n := longest(gap)) > 0:
            own.append(take(n))
            gap -= n
        if gap and there:
            smallest = lengths[own[-1]]
            if pair := best_pair(gap + smallest, smallest):
                back = own.pop()
                stacks[smallest].append(back)
                there |= 1 << smallest
                own += [take(n) for n in pair]
        bins.append(own)
    return bins


def _place(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    rows = rows.sort_values(["doc_id", "piece", "ids_crc32"], na_position="first", ignore_index=True)
    sequence, offset = np.zeros(len(rows), "int64"), np.zeros(len(rows), "int64")
    lengths = rows["length"].tolist()
    for number, own in enumerate(best_two_fit(lengths, length)):
        at = 0
        for i in own:
            sequence[i], offset[i] = number, at
            at += lengths[i]
    rows["sequence_id"] = rows["bin_group"] * (1 << 20) + sequence
    rows["offset"] = offset
    return rows.drop(columns="bin_group")


def pack(parts: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """The pieces with sequence_id and offset. ``parts``: doc_id, piece, start, length,
    ids_crc32, and part if they are numbered, held in a written table; anything else stays out of
    the way of the packing."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["part"] if "part" in parts.columns else [])]
    short = parts.where(F.col("length") < length).select(names)
    groups = max(1, -(-short.count() // group))
    whole = parts.where(F.col("length") == length).select(
        *names,
        (F.lit(-1) - F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    dealt = short.withColumn("bin_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    packed = dealt.groupBy("bin_group").applyInPandas(lambda rows: _place(rows, length), whole.schema)
    return packed.unionByName(whole)


def packed_documents(docs: DataFrame, path: str = VOCABULARY, length: int = LENGTH) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty and makes one piece that holds the end token alone; rows with a null
    doc_id and repeated rows are packed like others; an empty table gives an empty result.
    Other columns are ignored.
    """
    return pack(cut(pieces(docs, path, length, with_ids=False)), length)


def sequences(docs: DataFrame, path: str = VOCABULARY, length: int = LENGTH) -> DataFrame:
    """sequence_id and input_ids (array of at most ``length``), the rows to train on. Pieces find
    their tokens by their number in the written table, so null and repeated ids are no matter."""
    parts = cut(pieces(docs, path, length)).withColumn("part", F.monotonically_increasing_id())
    placed = pack(parts, length).select("part", "sequence_id", "offset")
    rows = parts.select("part", "ids").join(placed, "part")

    def joined(binary: pd.Series) -> pd.Series:
        return binary.map(lambda b: np.frombuffer(b, "<u4").astype("int32"))

    return rows.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("own")
    ).select(
        "sequence_id",
        F.pandas_udf(joined, ArrayType(IntegerType()))(
            F.aggregate("own.ids", F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b))
        ).alias("input_ids"),
    )
