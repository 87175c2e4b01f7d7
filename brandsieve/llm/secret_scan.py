"""Secrets in texts: three fixed shapes, and credential values that are expensive to guess.

The value after a credential word is judged by the cheapest way to compose it: a segmentation
into dictionary words, dates, repeats, keyboard walks and sequences, and brute-force spans,
found by dynamic programming over log10 guesses. Separators, and the whole words between them,
are cheap, so that paths, slugs and prose cost little. Values that cost ``LEAST_COST`` or more are
secrets even where the fixed shapes miss them (short ones, other characters, other words); those
of letters of one case only, as names and foreign words are, need ``LEAST_LETTERS_COST``, and
``LEAST_LETTERS_SHARE`` of what brute force would cost.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Maps hexadecimal digits to 1 and other bytes to 0: a run of 16 is found without a regex.
_HEX_DIGITS, _HEX_RUN = bytes(b in b"0123456789abcdef" for b in range(256)), b"\1" * 16
#: Literals of which every text with an assignment has one, lower-cased.
_ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")
_CONTEXT_HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "bearer", "auth")
#: A credential word, a separator, and a value: in quotes (no quote inside, blanks up to
#: ``LONGEST_PHRASE`` characters) or up to white space. ``Bearer`` and ``Basic`` may come between,
#: and ``Bearer`` needs no separator.
CONTEXT = re.compile(
    r"""(?<![A-Za-z])(?:(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|secret)[_-]?key|credentials?|bearer|auth(?:orization)?)"""
    r"""["']?[\x20\t]*(?:[:=]|=>|:=)[\x20\t]*(?:"?(?:bearer|basic)[\x20\t]+)?(?:"([^"\r\n]+)"|'([^'\r\n]+)'|([^\s"',;<>()\[\]{}]+))"""
    r"""|bearer[\x20\t]+([A-Za-z0-9._~+/=-]+))""",
    re.I | re.A,
)
LONGEST_PHRASE = 48
#: Log10 guesses from which a value counts as a secret: beyond online and slow offline attacks.
LEAST_COST, LEAST_LETTERS_COST, LEAST_LETTERS_SHARE = 10.0, 15.0, 0.8
LEAST_LENGTH = 8
WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken")
_LONGEST_WORD = 32
#: Between words of a path, slug or phrase; the cost of one, of a blank, of a whole word there.
_SEPARATORS = "-_./: "
_SEPARATOR_COST, _BLANK_COST, _WHOLE_WORD_COST = math.log10(8), 0.3, 0.7
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_SWAPS = str.maketrans("@4301!$57", "aaeoiisst")
_DATE = re.compile(
    r"(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])"
    r"|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)\d\d"
    r"|(?:19|20)\d\d"
)
#: 200 years, times the days of a year for full dates; a year alone costs the years.
_DATE_COST, _YEAR_COST = math.log10(200 * 366), math.log10(200)


@lru_cache(maxsize=2)
def word_ranks(path: str = WORDS) -> dict[str, int]:
    """Lower-case words of three letters or more by rank in a vocabulary that lists one base64
    token and its rank a line, frequent ones first."""
    ranks: dict[str, int] = {}
    with open(path, "rb") as lines:
        for token, rank in map(bytes.split, lines):
            word = base64.b64decode(token).decode("utf-8", "replace").strip().lower()
            if len(word) >= 3 and word.isalpha():
                ranks[word] = min(int(rank) + 1, ranks.get(word, 1 << 30))
    return ranks


def _neighbours() -> set[tuple[str, str]]:
    """Keys side by side in a row, or one row apart at the same or the next place."""
    pairs = set()
    for y, row in enumerate(_ROWS):
        for x, key in enumerate(row):
            near = [row[x + 1 : x + 2], *(r[x - 1 : x + 1] for r in _ROWS[y + 1 : y + 2] if x), *(r[:1] for r in _ROWS[y + 1 : y + 2] if not x)]
            for other in "".join(near):
                pairs |= {(key, other), (other, key)}
    return pairs


_NEAR = _neighbours()


def _alphabet(part: str) -> int:
    """Size of the smallest usual set of characters that holds all of the text."""
    kinds = {26: r"[a-z]", 27: r"[A-Z]", 10: r"[0-9]", 33: r"[^A-Za-z0-9]"}
    return max(10, sum(26 if n == 27 else n for n, pattern in kinds.items() if re.search(pattern, part)))


def guess_cost(value: str, path: str = WORDS) -> float:
    """Log10 of the guesses for the cheapest segmentation of the value; 0 for an empty one.

    Linear in the length: words are bounded in length, and runs are taken from their start.
    """
    ranks, n, low = word_ranks(path), len(value), value.lower()
    plain = low.translate(_SWAPS)
    per_character = math.log10(_alphabet(value))
    runs: list[list[tuple[int, float]]] = [[] for _ in range(n)]  # at a start: (end, cost)
    for match in _DATE.finditer(value):
        runs[match.start()].append((match.end(), _YEAR_COST if len(match.group()) == 4 else _DATE_COST))
    start = 0
    while start < n:  # the same character again, or steps of one in the character set
        end = start + 1
        step = ord(low[end]) - ord(low[start]) if end < n else None
        while end < n and step in (-1, 0, 1) and ord(low[end]) - ord(low[end - 1]) == step:
            end += 1
        if end - start >= 3:
            runs[start].append((end, per_character + math.log10(end - start) + 0.3))
        start = max(end - 1, start + 1)
    start = 0
    while start < n:  # walks over the keyboard
        end, turns, last = start + 1, 1, None
        while end < n and (low[end - 1], low[end]) in _NEAR:
            way = ord(low[end]) - ord(low[end - 1]) > 0
            turns += last is not None and way != last
            last, end = way, end + 1
        if end - start >= 4:
            runs[start].append((end, math.log10(47) + math.log10(end - start) + turns * math.log10(4)))
        start = max(end - 1, start + 1)
    for size in range(2, 17):  # a block of `size` characters again and again
        start = 0
        while start + 2 * size <= n:
            end = start + size
            while end < n and value[end] == value[end - size]:
                end += 1
            if end - start >= 2 * size:
                runs[start].append((end, size * per_character + math.log10((end - start) // size)))
                start = end - size + 1
            else:
                start += 1
    composite = any(c in value for c in _SEPARATORS)
    best = [0.0] + [math.inf] * n
    for at in range(n):
        cost = best[at]
        separator = composite and value[at] in _SEPARATORS
        one = (_BLANK_COST if value[at] == " " else _SEPARATOR_COST) if separator else per_character
        best[at + 1] = min(best[at + 1], cost + one)
        for end, extra in runs[at]:
            best[end] = min(best[end], cost + extra)
        if not plain[at].isalpha():
            continue
        starts = composite and (at == 0 or value[at - 1] in _SEPARATORS)
        for end in (at + 1, at + 2):  # whole words too short for the list
            if starts and end <= n and value[at:end].isalpha() and (end == n or not value[end].isalnum()):
                best[end] = min(best[end], cost + _WHOLE_WORD_COST)
        for end in range(at + 3, min(n, at + _LONGEST_WORD) + 1):
            word = plain[at:end]
            if not word[-1].isalpha():
                break
            if rank := ranks.get(word):
                part = value[at:end]
                changes = 2 * (part != part.lower() and not part.istitle()) + (part.istitle()) + 2 * (low[at:end] != word)
                price = math.log10(rank) + changes * math.log10(2)
                if starts and low[at:end] == word and changes < 2 and (end == n or not value[end].isalnum()):
                    price = min(price, _WHOLE_WORD_COST)
                best[end] = min(best[end], cost + price)
    return best[n]


def _lower(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def find_secrets(text: str | None, least_cost: float = LEAST_COST, path: str = WORDS) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then in the order of ``KINDS``; code points, end exclusive."""
    if not text:
        return []
    found, low = [], _lower(text)
    if any(hint in low for hint in _ASSIGN_HINTS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    if _HEX_RUN in text.encode("utf-8", "surrogatepass").translate(_HEX_DIGITS):
        found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    if any(hint in low for hint in _CONTEXT_HINTS):
        covered = sorted((a, b) for a, b, _ in found)
        starts, ends = [a for a, _ in covered], list(accumulate((b for _, b in covered), max))
        for match in CONTEXT.finditer(text):
            which = match.lastindex
            a, b = match.span(which)
            while which > 2 and b > a and text[b - 1] in ".!?:":
                b -= 1
            before, value = bisect_right(starts, a), text[a:b]
            if b - a < LEAST_LENGTH or (before and ends[before - 1] >= b):
                continue
            if b - a > LONGEST_PHRASE and any(c in value for c in " \t"):
                continue
            if guess_cost(value, path) >= max(least_cost, _least_for_letters(value)):
                found.append((a, b, "guess"))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def _least_for_letters(value: str) -> float:
    """What a value has to cost that holds only letters, of one case but for the first, and
    separators; 0 for any other."""
    letters = "".join(c for c in value if c not in _SEPARATORS)
    if not letters.isalpha() or not (letters[1:].islower() or letters.isupper()):
        return 0.0
    return max(LEAST_LETTERS_COST, LEAST_LETTERS_SHARE * len(letters) * math.log10(26))


_SPANS = ArrayType(
    StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("kind", StringType())])
)


def secret_spans(docs: DataFrame, text: str = "text", least_cost: float = LEAST_COST, path: str = WORDS) -> DataFrame:
    """The documents with ``secret_spans``: start, end, kind of each secret; none for a null text."""

    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("start", "end", "kind"), x)) for x in find_secrets(t, least_cost, path)] for t in texts])

    return docs.withColumn("secret_spans", F.pandas_udf(spans, _SPANS)(F.col(text).cast("string")))


def redact(docs: DataFrame, least_cost: float = LEAST_COST, path: str = WORDS) -> DataFrame:
    """The documents with every secret replaced by ``[SECRET]``; overlapping spans become one.
    Null texts stay null; a column n_chars follows the text."""

    def cleaned(texts: pd.Series) -> pd.Series:
        return pd.Series([_redacted(t, find_secrets(t, least_cost, path)) for t in texts], dtype=object)

    changed = {"text": F.pandas_udf(cleaned, StringType())(F.col("text").cast("string"))}
    out = docs.withColumns(changed)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _redacted(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    if not spans:
        return text
    parts, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            parts += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _report(batches: Iterator[pd.DataFrame], least_cost: float, path: str) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [find_secrets(t, least_cost, path) for t in batch["text"]]
        base = [[x for x in spans if x[2] != "guess"] for spans in found]
        out = pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64")})
        for kind in KINDS:
            out[f"n_{kind}"] = pd.Series([sum(x[2] == kind for x in spans) for spans in found], dtype="int64")
        out["base_sha256"] = [hashlib.sha256(_joined(x).encode()).hexdigest() for x in base]
        out["spans"] = [_joined(x) for x in found]
        yield out


def secret_report(docs: DataFrame, least_cost: float = LEAST_COST, path: str = WORDS) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans.

    Null and empty texts have no spans (and the digest of an empty text); repeated rows and
    null ids come back as they are; other columns are ignored.
    """
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(lambda it: _report(it, least_cost, path), schema)
