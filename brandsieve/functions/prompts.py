"""Prompt texts as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from brandsieve import fixed_values as V
from brandsieve.functions.text import strings


def _fill(template: str, **values: Column) -> Column:
    """Concat of the literal stretches of a template and the columns for its {name} marks."""
    marks = "|".join(values)
    parts = re.split(rf"\{{({marks})\}}", template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p])


def instruction_prompt(description: Column, n: int = 3) -> Column:
    return _fill(V.INSTRUCTION_PROMPT, text=description, n=F.lit(str(n)))


def chat_prompt(description: Column) -> Column:
    return _fill(V.CHAT_PROMPT, text=description)


def training_prompt(description: Column, domains: Column) -> Column:
    """Prompt plus wanted answer; no domains gives an empty answer."""
    text = F.coalesce(description, F.lit(""))
    listed = F.array_join(F.coalesce(domains, strings([])), ", ")
    return _fill(V.TRAINING_PROMPT, text=text, domains=listed)


def list_literal(items: Column) -> Column:
    """``['a', 'b']``: items quoted with ', or with " when an item holds ' but no "."""
    def quoted(x: Column) -> Column:
        for raw, shown in [("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]:
            x = F.replace(x, F.lit(raw), F.lit(shown))
        single = F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("\\'")), F.lit("'"))
        return F.when(x.contains("'") & ~x.contains('"'), F.concat(F.lit('"'), x, F.lit('"'))).otherwise(single)

    return F.concat(F.lit("["), F.array_join(F.transform(items, quoted), ", "), F.lit("]"))


def judge_prompt(description: Column, domains: Column, category: Column) -> Column:
    return _fill(V.JUDGE_PROMPT, text=description, domains=list_literal(domains), category=category)


def single_judge_prompt(description: Column, domain: Column) -> Column:
    return _fill(V.SINGLE_JUDGE_PROMPT, text=description, domain=domain)


def list_judge_prompt(description: Column, domains: Column) -> Column:
    bullets = F.array_join(F.transform(domains, lambda d: F.concat(F.lit("- "), d)), "\n")
    return _fill(V.LIST_JUDGE_PROMPT, text=description, domains=bullets)
