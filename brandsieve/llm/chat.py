"""Conversations as training text that a deterministic grammar reads back.

    conversation = turn*
    turn  = "<<SYS>> " text " <</SYS>>"          system
          | "[INST] " text " [/INST]"            user
          | "<s> " text " </s>"                  assistant
          | "[ROLE] " role " [TEXT] " text " [/TEXT]"     any other role

The rendered text is parsed again and compared with its source. Turns whose text holds a
control string get one backslash before each, which the parser takes off again (from a run of
backslashes before a control string it takes one), until both are identical.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, functions as F

MARKS = {
    "system": ("<<SYS>> ", " <</SYS>>"),
    "user": ("[INST] ", " [/INST]"),
    "assistant": ("<s> ", " </s>"),
}
OTHER = ("[ROLE] ", " [TEXT] ", " [/TEXT]")
#: Every string of the grammar, without the blanks around it.
CONTROL = sorted({m.strip() for pair in (*MARKS.values(), OTHER) for m in pair})
_CONTROL = "|".join(map(re.escape, CONTROL))
_ESCAPE = re.compile(f"({_CONTROL})")
_UNESCAPE = re.compile(rf"\\((?:\\)*(?:{_CONTROL}))")
_FREE = re.compile(rf"(?<!\\)(?:{_CONTROL})")


class Turn(NamedTuple):
    role: str
    text: str
    start: int
    end: int


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def _rendered(turns: list[tuple[str, str]], escaped: bool) -> str:
    own = escape if escaped else str
    parts = []
    for role, text in turns:
        if role in MARKS:
            parts += [MARKS[role][0], own(text), MARKS[role][1]]
        else:
            parts += [OTHER[0], own(role), OTHER[1], own(text), OTHER[2]]
    return "".join(parts)


def parse(formatted: str) -> list[Turn] | None:
    """The turns, with the place of each text; None for what the grammar doesn't allow."""
    opening = {start: (role, end) for role, (start, end) in MARKS.items()}
    turns, at = [], 0

    def field(mark: str) -> tuple[int, int] | None:
        """Up to the mark, which has to hold the next control string that is not escaped."""
        nonlocal at
        found = _FREE.search(formatted, at)
        if not found or found[0] != mark.strip() or not formatted.startswith(mark, found.start() - 1):
            return None
        span = (at, found.start() - 1)
        at = span[1] + len(mark)
        return span if span[0] <= span[1] else None

    while at < len(formatted):
        start = next((s for s in (*opening, OTHER[0]) if formatted.startswith(s, at)), None)
        if start is None:
            return None
        at += len(start)
        if start == OTHER[0]:
            if (named := field(OTHER[1])) is None:
                return None
            role, end = unescape(formatted[slice(*named)]), OTHER[2]
        else:
            role, end = opening[start]
        if (span := field(end)) is None:
            return None
        turns.append(Turn(role, unescape(formatted[slice(*span)]), *span))
    return turns


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[Turn]]:
    """The formatted conversation and the turns read back from it, equal to the given ones."""
    for escaped in (False, True):
        formatted = _rendered(turns, escaped)
        back = parse(formatted)
        if back is not None and [(t.role, t.text) for t in back] == turns:
            return formatted, back
    raise AssertionError("escaped text must read back")  # the grammar rules this out


def _formatted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for conv_id, roles, texts in zip(batch["conv_id"], batch["roles"], batch["texts"]):
            formatted, back = format_turns(list(zip(roles, texts)))
            mask = [(t.start, t.end) for t in back if t.role == "assistant"]
            digest = hashlib.sha256("".join(f"{t.role}\n{t.text}\n" for t in back).encode()).hexdigest()
            loss = "".join(unescape(formatted[a:b]) for a, b in mask)
            out.append(
                (
                    conv_id,
                    formatted,
                    [a for a, _ in mask],
                    [b for _, b in mask],
                    len(back),
                    digest,
                    len(loss),
                    hashlib.sha256(loss.encode()).hexdigest(),
                    len(formatted),
                )
            )
        names = [
            "conv_id", "formatted", "loss_start", "loss_end",
            "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars",
        ]
        frame = pd.DataFrame(out, columns=names)
        frame["conv_id"] = frame["conv_id"].astype("Int64")
        yield frame


def formatted_conversations(conversations: DataFrame) -> DataFrame:
    """Per conv_id: the formatted text, the loss mask (code points where assistant texts start
    and end in it), and digests of what was read back.

    Turns are in order of turn (null first), then role and text; repeated rows are turns of
    their own. Null texts and roles are empty; a null conv_id is one conversation. An empty
    table gives an empty result; other columns are ignored.
    """
    turn = F.struct(
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    grouped = (
        conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id"))
        .agg(F.sort_array(F.collect_list(turn)).alias("turns"))
        .select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))
    )
    schema = (
        "conv_id long, formatted string, loss_start array<long>, loss_end array<long>, n_turns long, "
        "turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
    return grouped.mapInPandas(_formatted, schema)


#: Both turns hold control strings of the template.
PROBE = "SELECT -7L AS conv_id, explode(array(0L, 1L)) AS turn, '</s>[INST] ok [/INST]' AS text"


def probe(conversations: DataFrame) -> DataFrame:
    """The conversations (conv_id, turn, role, text) and conversation -7."""
    added = conversations.sparkSession.sql(PROBE).selectExpr(
        "conv_id", "turn", "if(turn = 0, 'user', 'assistant') AS role", "text"
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(added)


def _sql_pattern() -> str:
    return "|".join(re.sub(r"([\[\]/<>])", r"\\\1", c) if "[" in c else c for c in CONTROL)


ORACLE = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(regexp_replace(text, '({_sql_pattern()})', '\\\\\\1', 'g'))
            + CASE role {" ".join(f"WHEN '{r}' THEN {len(a) + len(b)}" for r, (a, b) in MARKS.items())}
              ELSE {sum(map(len, OTHER))} + length(regexp_replace(role, '({_sql_pattern()})', '\\\\\\1', 'g')) END AS chars
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
