"""Five-factor confidence of a domain name for a description, in exact thousandths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brandsieve import fixed_values as V
from brandsieve.functions.text import let, words


def name_part(domain: Column) -> Column:
    return F.substring_index(domain, ".", 1)


def description_words(description: Column) -> Column:
    """Distinct words of a description, the input of the relevance factor."""
    return F.array_distinct(words(F.lower(description)))


def length_score(name: Column) -> Column:
    size, chain = F.char_length(name), F
    for low, high, score in V.LENGTH_BANDS:
        chain = chain.when(size.between(low, high), score)
    return chain.otherwise(V.OTHER_LENGTH_SCORE)


def readability_score(name: Column) -> Column:
    return (
        F.lit(1000)
        - F.when(name.rlike(r"\p{Nd}"), 300).otherwise(0)
        - F.when(name.contains("-"), 200).otherwise(0)
        - F.when(name.rlike(r"([^\n])\1{2}"), 300).otherwise(0)
    )


def name_words(low_name: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(low_name, F.lit("([a-z]+)"), F.lit(1)))


def relevance_score(mine: Column, known: Column, long_known: Column) -> Column:
    """400 per shared word (at most 1000), 200 per pair where one word holds the other, at most 1000.

    ``mine`` are the words of the name, ``known`` those of the description and ``long_known``
    the latter's words of four letters and more, which alone take part in pairs.
    """
    # A name has one or two words: testing each beats building a set of all description words.
    shared = F.least(F.lit(1000), 400 * F.size(F.filter(mine, lambda d: F.array_contains(known, d))))
    pairs = F.aggregate(
        mine,
        F.lit(0),
        lambda found, d: found + F.size(F.filter(long_known, lambda w: w.contains(d) | d.contains(w))),
    )
    return F.least(F.lit(1000), shared + 200 * pairs)


def tld_score(domain: Column) -> Column:
    ending = F.lower(F.substring_index(domain, ".", -1))
    table = F.create_map(*[F.lit(x) for pair in V.TLD_SCORES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, ending), F.lit(V.OTHER_TLD_SCORE))


def memorability_score(low_name: Column, vowels: Column, consonants: Column) -> Column:
    # 0.3 <= vowels / consonants <= 0.8, kept in integers
    balanced = (vowels * 10 >= consonants * 3) & (vowels * 10 <= consonants * 8)
    base = F.when((consonants == 0) | balanced, 1000).otherwise(700)
    return base - F.when(low_name.rlike("[bcdfghjklmnpqrstvwxyz]{4}"), 300).otherwise(0)


def word_sets(description: Column) -> Column:
    """Struct of the description's distinct words, and of those with four letters and more."""
    return let(
        description_words(description),
        lambda known: F.struct(
            known.alias("known"), F.filter(known, lambda w: F.char_length(w) >= 4).alias("long_known")
        ),
    )


def _named(domain: Column) -> Column:
    name = name_part(domain)
    return F.struct(domain.alias("domain"), name.alias("name"), F.lower(name).alias("low"))


def _measured(named: Column) -> Column:
    low = named["low"]
    return F.struct(
        named["domain"].alias("domain"),
        named["name"].alias("name"),
        low.alias("low"),
        name_words(low).alias("mine"),
        F.char_length(F.regexp_replace(low, "[^aeiou]+", "")).alias("vowels"),
        F.char_length(F.regexp_replace(low, r"[aeiou]+|\P{L}+", "")).alias("consonants"),
    )


def _factors(parts: Column, sets: Column) -> dict[str, Column]:
    return {
        "length": length_score(parts["name"]),
        "readability": readability_score(parts["name"]),
        "relevance": relevance_score(parts["mine"], sets["known"], sets["long_known"]),
        "tld": tld_score(parts["domain"]),
        "memorability": memorability_score(parts["low"], parts["vowels"], parts["consonants"]),
    }


def factors(domain: Column, sets: Column) -> Column:
    """Struct of the five factors; ``sets`` is :func:`word_sets` of the description."""
    def build(parts: Column) -> Column:
        return F.struct(*[score.alias(name) for name, score in _factors(parts, sets).items()])

    return let(let(_named(domain), _measured), build)


def total(scores: Column | dict[str, Column]) -> Column:
    """Weighted total in thousandths; exact, because every term is a multiple of five."""
    weighted = sum((scores[name] * weight for name, weight in V.CONFIDENCE_WEIGHTS.items()), F.lit(0))
    return (weighted / 100).cast("int")


def suggestions(domains: Column, description: Column) -> Column:
    """``array<struct<domain, confidence>>`` sorted by confidence, best first, ties in given order.

    Each step goes over all names at once: binding single values inside a lambda costs more.
    """
    def ranked(sets: Column) -> Column:
        measured = F.transform(F.transform(domains, _named), _measured)
        scored = F.transform(
            measured,
            lambda x, i: F.struct(
                (-total(_factors(x, sets))).alias("order"), i.alias("position"), x["domain"].alias("domain")
            ),
        )
        return F.transform(
            F.array_sort(scored),
            lambda s: F.struct(s["domain"].alias("domain"), (-s["order"] / 1000.0).alias("confidence")),
        )

    return let(word_sets(description), ranked)
