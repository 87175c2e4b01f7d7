"""Small text helpers shared by every column function."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brandsieve import fixed_values as V


def no_strings() -> Column:
    return F.array().cast("array<string>")


def strings(values: Iterable[str]) -> Column:
    values = list(values)
    return F.array(*[F.lit(v) for v in values]) if values else no_strings()


def trim_ws(col: Column) -> Column:
    """Strip every Unicode blank from both ends (plain ``trim`` strips spaces only)."""
    return F.btrim(col, F.lit(V.BLANKS))


def split_ws(col: Column) -> Column:
    """Words between blanks, without empty strings."""
    return F.filter(F.split(col, f"{V.BLANK}+"), lambda w: w != "")


def words(col: Column) -> Column:
    """Runs of letters, digits and underscores, in order, with repeats."""
    return F.regexp_extract_all(col, F.lit(f"({V.WORD}+)"), F.lit(1))


def contains_any(col: Column, needles: Iterable[str]) -> Column:
    """Plain substring tests joined by OR: cheaper than one long alternation regex."""
    return reduce(or_, [col.contains(n) for n in needles])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Inside a lambda a referenced expression would be evaluated again for every array
    element; binding it to a lambda variable keeps it to one evaluation.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def fixed(df: DataFrame, *columns: str) -> DataFrame:
    """The same rows with ``columns`` computed at this point of the plan.

    The optimizer moves a filter below the projections that compute its columns, and copies
    their expressions into it for every mention. It does not move one below a generator.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*columns))))


def preview(col: Column, n: int) -> Column:
    return F.substring(col, 1, n)


def percent(col: Column) -> Column:
    """A share such as 0.8314 as ``83.1%`` (ties away from zero)."""
    return F.concat(F.round(col * 100, 1).cast("decimal(20,1)").cast("string"), F.lit("%"))


def base_name(path: Column) -> Column:
    """File name of a path without folder and ``.jsonl`` ending."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.jsonl)?/?$", 1)


def stable_hash(col: Column, seed: int | str = 42) -> Column:
    """32 hex digits that fix a reproducible pseudo-random order for an id."""
    return F.md5(F.concat_ws("|", col.cast("string"), F.lit(str(seed))))


def hash_fraction(col: Column, seed: int | str = 42) -> Column:
    """A reproducible number in [0, 1) per id, in steps of 2^-32."""
    head = F.conv(F.substring(stable_hash(col, seed), 1, 8), 16, 10).cast("bigint")
    return head / F.lit(4294967296.0)


def text_key(col: Column) -> Column:
    """Fixed-width digest of a text, so joins and groupings move 64 characters and no documents.

    It is never null; otherwise each join would hash every text once more in a null filter.
    """
    return F.coalesce(F.sha2(col, 256), F.lit(""))
