"""Turn a model's free-text answer into a short list of domain names, one parser per model version."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brandsieve import fixed_values as V
from brandsieve.functions.text import let, no_strings, split_ws, strings, trim_ws

WANTED = 3


def strip_prompt(response: Column, prompt: Column | None = None) -> Column:
    """The answer without a literal copy of the prompt, trimmed."""
    return trim_ws(response if prompt is None else F.replace(response, prompt, F.lit("")))


def join_pieces(pieces: Column) -> Column:
    """One answer from the pieces of a streamed one."""
    return F.array_join(pieces, "")


def assistant_section(response: Column) -> Column:
    """What follows the last assistant header, trimmed; the whole answer when there is none."""
    return F.when(
        response.contains(V.ASSISTANT_HEADER), trim_ws(F.substring_index(response, V.ASSISTANT_HEADER, -1))
    ).otherwise(response)


def _without(col: Column, labels: list[str]) -> Column:
    for label in labels:
        col = F.replace(col, F.lit(label), F.lit(""))
    return col


def _plausible(name: Column) -> Column:
    return name.contains(".") & F.char_length(name).between(3, 30)


def _unpunctuated(name: Column) -> Column:
    return F.rtrim(name, F.lit(V.TRAILING_PUNCTUATION))


def _from_lines(text: Column, labels: list[str]) -> Column:
    lines = F.filter(F.transform(F.split(text, "\n"), trim_ws), lambda x: x.contains("."))
    return F.transform(F.filter(F.transform(lines, lambda x: _without(x, labels)), _plausible), _unpunctuated)


def _lowered(names: Column) -> Column:
    return F.transform(names, lambda x: F.lower(x))


def fallback_slice(n_existing: Column) -> Column:
    """``domain{k}.com`` for every place from n_existing + 1 up to three."""
    missing = F.greatest(F.lit(WANTED) - n_existing, F.lit(0))
    return F.slice(strings(V.FALLBACK_DOMAINS), n_existing + 1, missing)


def pad(names: Column) -> Column:
    """First three names, filled up with numbered fallbacks."""
    return let(names, lambda a: F.slice(F.concat(a, fallback_slice(F.size(a))), 1, WANTED))


def extract_v0(response: Column, *, n: int = WANTED) -> Column:
    """Line parser without padding."""
    names = _from_lines(trim_ws(response), V.LINE_LABELS)
    return F.slice(F.array_distinct(_lowered(names)), 1, n)


def _numbered_lines(text: Column) -> Column:
    names = _from_lines(text, V.LINE_LABELS + V.NUMBER_LABELS)
    return F.array_distinct(_lowered(F.filter(names, lambda x: ~x.isin(V.PLACEHOLDER_DOMAINS))))


def extract_v1(response: Column, prompt: Column | None = None) -> Column:
    """Line parser that also drops numbering and prompt examples, padded to three."""
    return pad(_numbered_lines(strip_prompt(response, prompt)))


def extract_v2(response: Column, prompt: Column | None = None) -> Column:
    """As v1, but an empty answer stays empty and an answer without a name gives one fallback."""
    return let(
        strip_prompt(response, prompt),
        lambda text: let(
            _numbered_lines(text),
            lambda names: F.when(F.size(names) > 0, pad(names))
            .when(text == "", no_strings())
            .otherwise(strings(V.FALLBACK_DOMAINS[:1])),
        ),
    )


def extract_v3(response: Column, prompt: Column | None = None) -> Column:
    """Text after the last "assistant", read as a comma list when it has a comma, else as lines."""
    section = F.when(
        response.contains(V.ASSISTANT_WORD), trim_ws(F.substring_index(response, V.ASSISTANT_WORD, -1))
    ).otherwise(strip_prompt(response, prompt))

    def parse(text: Column) -> Column:
        by_comma = F.transform(F.filter(F.transform(F.split(text, ","), trim_ws), _plausible), _unpunctuated)
        by_line = _from_lines(text, V.LINE_LABELS + V.NUMBER_LABELS)
        names = F.when(text.contains(","), by_comma).otherwise(by_line)
        return pad(F.array_except(_lowered(names), strings(V.PLACEHOLDER_DOMAINS)))

    return let(section, parse)


def valid_domain(name: Column) -> Column:
    """At most 63 characters: letters, digits and hyphens, one dot, a letters-only ending."""
    return (F.char_length(name) <= 63) & name.rlike(V.DOMAIN_FORMAT)


def extract_v4(response: Column, prompt: Column | None = None, *, max_tld: int = 4) -> Column:
    """Split on separators, clean each part, take its first domain-like run. Case and repeats stay."""
    parts = F.transform(F.split(strip_prompt(response, prompt), r"[,\n\r\t|]"), trim_ws)
    parts = F.filter(parts, lambda x: (x != "") & ~F.lower(x).isin(V.HEADER_WORDS))
    bare = F.transform(
        parts,
        lambda x: trim_ws(
            F.regexp_replace(
                F.regexp_replace(x, rf"^\p{{Nd}}+[.)]{V.BLANK}*", ""),
                rf"^[-•*]{V.BLANK}*",
                "",
            )
        ),
    )
    bare = F.filter(bare, lambda x: x.contains(".") & (F.char_length(x) > 3))
    # A run can only match from its start, so the look-behind keeps the search linear.
    run = rf"(?<![a-zA-Z0-9-])([a-zA-Z0-9-]++\.[a-zA-Z]{{2,{max_tld}}})"
    found = F.transform(bare, lambda x: F.regexp_extract(F.regexp_replace(x, r"""^["']|["']$""", ""), run, 1))
    return pad(F.filter(found, valid_domain))


EXTRACTORS = {"v0": extract_v0, "v1": extract_v1, "v2": extract_v2, "v3": extract_v3, "v4": extract_v4}


def keyword_fallback(description: Column, n: int = WANTED) -> Column:
    """Names made from the description's own longer words, filled up with numbered names."""
    plain = F.replace(F.replace(F.lower(description), F.lit("."), F.lit("")), F.lit(","), F.lit(""))
    keys = F.slice(
        F.filter(split_ws(plain), lambda w: (F.char_length(w) > 3) & ~w.isin(V.KEYWORD_STOP_WORDS)), 1, n
    )
    endings = strings(V.KEYWORD_TLDS[i % len(V.KEYWORD_TLDS)] for i in range(n))
    fillers = strings(f"startup{i}.com" for i in range(n))

    def build(found: Column) -> Column:
        named = F.transform(found, lambda w, i: F.concat(F.substring(w, 1, 8), F.get(endings, i)))
        return F.concat(named, F.slice(fillers, F.size(found) + 1, F.lit(n) - F.size(found)))

    return let(keys, build)


def shortfall(domains: Column, n: int = WANTED) -> Column:
    return F.size(domains) < n
