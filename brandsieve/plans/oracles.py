"""SQL counterparts of the registered queries, written for DuckDB against the same tables.

They share only the fixed values with the Spark code. Look-behinds and back-references do not
exist in RE2, so those rules take another form here.
"""

from __future__ import annotations

from brandsieve import fixed_values as V
from brandsieve.plans.views import LIST_RATINGS, RATINGS, VERDICTS

ORACLES: dict[str, str] = {}

WS = "' ' || chr(9) || chr(10) || chr(13)"


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def names(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def anyof(expr: str, values) -> str:
    return "(" + " OR ".join(f"contains({expr}, {q(v)})" for v in values) + ")"


def match(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {q(pattern)})"


def by_remainder(key: str, variants) -> str:
    cases = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(variants))
    return f"(CASE ({key}) % {len(variants)} {cases} END)"


def trim(expr: str) -> str:
    return f"trim({expr}, {WS})"


def joined(expr: str) -> str:
    return f"coalesce(array_to_string({expr}, '|'), '')"


def repeats(expr: str, n: int) -> str:
    """Does some character other than a line feed occur n times in a row?"""
    return (
        f"(len(list_filter(list_distinct(string_split({expr}, '')), "
        f"lambda ch: ch <> chr(10) AND contains({expr}, repeat(ch, {n})))) > 0)"
    )


# --- views ---------------------------------------------------------------------------------

VIEWS: dict[str, str] = {}

VIEWS["v_noisy"] = f"""
SELECT doc_id, lang, {by_remainder('doc_id', [
    "text || ' 10.20.30.40'",
    "'aaaaaaaaaaaa ' || text",
    "'Lorem ipsum ' || text",
    "text || ' {x}'",
    "text || ' redis db.users.find'",
    "text || ' what!!!!!'",
    "replace(text, ' ', '_')",
    "lower(regexp_replace(text, '[^a-zA-Z]', '', 'g'))",
    "'12 12 ' || regexp_replace(text, '[a-zA-Z]', '', 'g')",
    "'Привет ' || text",
    "'Blockchain ' || text",
    "length(text)::VARCHAR",
    "'Startup app ' || text",
    "'npm   install ' || text",
    "'abc12345xyz ' || text",
    "'http://x.y startup ' || text",
    "'console.log import os ' || text",
    "'machine  learning ' || text",
    "text || ' ,,, '",
    "text",
    "'host v127.0.0.1 is down now ' || text",
    "text || ' see 127.0.0.1234 there today'",
    "lpad(length(text)::VARCHAR, 12, '0')",
])} AS text FROM documents"""

VIEWS["v_unsafe"] = f"""
SELECT -1 - doc_id AS doc_id, ' x ' AS text FROM documents WHERE doc_id % 16 = 15
UNION ALL SELECT doc_id, text || ' ' || {by_remainder('doc_id', [
    "'adult education course'", "'adult shop'", "'weapon safety training'", "'weapon store'", "'money-laundering'",
    "'anti-money-laundering desk'", "'SCAM!'", "'exploit'", "'cheating'", "'a pyramid scheme'",
    "'illegal-criminal mix'", "'method chateau'", "'bomb'", "'meth dealer'", "''", "'x'",
])} AS text FROM documents"""

_PACKED = "replace(p_name, ' ', '')"
VIEWS["v_candidates"] = f"""
SELECT p_partkey AS entry_id, p_name || ' ' || lower(p_type) || ' shop' AS description, {by_remainder('p_partkey', [
    f"{_PACKED} || '.com'", f"{_PACKED} || '.org'", f"{_PACKED} || '.net'", f"{_PACKED} || '.io'",
    "split_part(p_name, ' ', 1) || '.ai'", f"{_PACKED} || '.co'", "split_part(p_name, ' ', 2) || '.app'",
    f"{_PACKED} || 'online.tech'", f"{_PACKED} || '.biz'", f"{_PACKED} || '.info'",
    "replace(p_name, ' ', '-') || '-' || p_size || '.com'", f"{_PACKED} || 'zzz.shop'",
    "substr(p_name, 1, 3) || 'mrkt.health'",
])} AS domain FROM part"""

VIEWS["v_responses"] = f"""
SELECT entry_id, description, {by_remainder('entry_id', [
    "'1. ' || domain || chr(10) || '2. alt-' || domain || chr(10) || '3. my' || domain",
    "'- ' || upper(domain) || chr(10) || '* ' || domain || chr(10) || 'Domain: get' || domain || '!'",
    "domain || ', go' || domain || ', ' || domain || '.'",
    "'Domains:' || chr(10) || '\"' || domain || '\" | ''x' || domain || ''''",
    "'businessname.com' || chr(10) || 'startup.ai' || chr(10) || domain",
    "'No suggestion for this input'",
    "''",
    "'user question assistant' || chr(10) || domain || chr(10) || 'error-' || domain",
])} AS response FROM v_candidates"""

def with_digits(key: str, templates) -> str:
    chosen = by_remainder(key, [q(t) for t in templates])
    return f"replace(replace({chosen}, '{{d}}', (({key}) % 10)::VARCHAR), '{{e}}', ((({key}) // 10) % 10)::VARCHAR)"


def unfenced(text: str) -> str:
    t = trim(text)
    return (
        f"CASE WHEN contains({t}, '```json') THEN {trim(f"split_part(split_part({t}, '```json', 2), '```', 1)")} "
        f"WHEN contains({t}, '```') THEN {trim(f"split_part({t}, '```', 2)")} ELSE {t} END"
    )


_NUMERIC = "('DOUBLE', 'UBIGINT', 'BIGINT')"


def numeric(value: str, path: str) -> str:
    """The number at a path, null where something else or nothing stands."""
    return f"CASE WHEN json_type({value}, '{path}') IN {_NUMERIC} THEN json_extract_string({value}, '{path}')::DOUBLE END"


def read_verdicts(table: str) -> str:
    """The table's columns and what its JSON verdicts say, read by the rules of the reference."""
    criteria = " + ".join(
        f"CASE WHEN json_type(v, '$.{c}') IS NULL THEN 0 ELSE {numeric('v', '$.' + c)} END" for c in V.CRITERIA
    )
    cut = f"SELECT *, regexp_extract({unfenced('verdict')}, '(?s)\\{{.*\\}}', 0) AS _j FROM {table}"
    valid = f"SELECT *, CASE WHEN _j <> '' AND json_valid(_j) THEN _j::JSON END AS _v FROM ({cut})"
    parts = f"""SELECT *, json_extract(_v, '$.domain_scores') AS _ds FROM ({valid})"""
    rated = f"""SELECT *, list_transform(list_transform(coalesce(json_keys(_ds), []), lambda k: json_extract(_ds, '$."' || k || '"')),
      lambda v: CASE json_type(v) WHEN 'OBJECT' THEN ({criteria}) / {len(V.CRITERIA)} ELSE {numeric('v', '$')} END) AS _s FROM ({parts})"""
    checked = f"SELECT *, _v IS NOT NULL AND len(list_filter(_s, lambda x: x IS NULL)) = 0 AS parse_ok FROM ({rated})"
    return f"""SELECT * EXCLUDE (_j, _v, _ds, _s),
      CASE WHEN parse_ok THEN coalesce(json_extract_string(_v, '$.classification'), 'legitimate') ELSE 'legitimate' END AS classification,
      CASE WHEN NOT parse_ok THEN true ELSE CASE json_type(_v, '$.agrees_with_dataset') WHEN 'BOOLEAN' THEN json_extract_string(_v, '$.agrees_with_dataset')::BOOLEAN
        WHEN 'VARCHAR' THEN json_extract_string(_v, '$.agrees_with_dataset') <> '' WHEN 'NULL' THEN false ELSE true END END AS agrees_with_dataset,
      CASE WHEN parse_ok AND len(_s) > 0 THEN list_sum(_s) / len(_s) ELSE 0 END::DOUBLE AS domain_quality_score,
      CASE WHEN parse_ok THEN len(_s) ELSE 0 END AS n_scores FROM ({checked})"""


VIEWS["v_verdicts"] = f"SELECT doc_id, {with_digits('doc_id', VERDICTS)} AS verdict FROM labels"
VIEWS["v_read"] = read_verdicts("v_verdicts")

VIEWS["v_ratings"] = f"""
SELECT entry_id, description, ['a.com', 'b.ai', domain] AS domains,
       {with_digits('entry_id', RATINGS)} AS rating_text,
       {with_digits('entry_id', LIST_RATINGS)} AS list_text
FROM v_candidates"""

_PLACE = "CASE WHEN d.doc_id % 100 < 50 THEN 'legit' WHEN d.doc_id % 100 < 80 THEN 'gibberish' ELSE 'nsfw' END"
VIEWS["v_entries"] = f"""
SELECT d.doc_id + 1 AS entry_id, d.text AS business_description,
       CASE WHEN l.toxic = 1 THEN 'nsfw' WHEN l.quality = 0 THEN 'gibberish' WHEN l.doc_id IS NOT NULL THEN 'legit' END AS gt_category,
       {_PLACE} AS positional_category
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""

_STEM = "'d' || (d.doc_id + 1)"
_NAMED = f"[{_STEM} || '.com', {_STEM} || '.io', {_STEM} || '.ai']"
VIEWS["v_outputs"] = f"""
SELECT c.model_version, c.has_gib, c.has_nsfw, d.doc_id + 1 AS entry_id, d.text AS business_description,
       {_PLACE} AS positional_category, {with_digits('(d.doc_id + 1)', VERDICTS)} AS verdict,
       {by_remainder('(d.doc_id + 1) * 3 + c.v', ["[]::VARCHAR[]", "['NSFW_CONTENT_DETECTED']", "[]::VARCHAR[]",
        "['NSFW_CONTENT_DETECTED']", "['SAFE_DOMAINS_UNAVAILABLE']", _NAMED, _NAMED])} AS target_domains
FROM documents d CROSS JOIN (VALUES ('v0', 0, true, true), ('v1', 1, false, false), ('v2', 2, true, false),
     ('v3', 3, true, false), ('v4', 4, true, true)) AS c(model_version, v, has_gib, has_nsfw)"""

VIEWS["v_truth"] = f"""
SELECT {trim('business_description')} AS k, arg_max(gt_category, entry_id) AS truth_category
FROM v_entries WHERE gt_category IS NOT NULL GROUP BY 1"""

VIEWS["v_categorised"] = f"""
SELECT o.*, coalesce(t.truth_category, o.positional_category) AS category
FROM v_outputs o LEFT JOIN v_truth t ON {trim('o.business_description')} = t.k"""

VIEWS["v_rows"] = f"""
SELECT c.*,
       CASE c.category
         WHEN 'legit' THEN len(c.target_domains) > 0 AND c.target_domains <> ['NSFW_CONTENT_DETECTED']
         WHEN 'gibberish' THEN CASE WHEN c.has_gib THEN len(c.target_domains) = 0
              ELSE len(c.target_domains) > 0 AND c.target_domains <> ['NSFW_CONTENT_DETECTED'] END
         WHEN 'nsfw' THEN c.target_domains = ['NSFW_CONTENT_DETECTED'] ELSE false END AS model_correct
FROM ({read_verdicts('v_categorised')}) c"""

_PARTS = ", ".join(
    f"count(*) FILTER (category = '{c}') AS {c}_total, count(*) FILTER (category = '{c}' AND model_correct) AS {c}_correct, "
    f"CASE WHEN count(*) FILTER (category = '{c}') > 0 THEN count(*) FILTER (category = '{c}' AND model_correct)::DOUBLE "
    f"/ count(*) FILTER (category = '{c}') ELSE 0 END AS {c}_accuracy"
    for c in ("legit", "gibberish", "nsfw")
)
_SCORED = "category = 'legit' AND model_correct AND domain_quality_score > 0"
VIEWS["v_summary"] = f"""
SELECT model_version, count(*) AS total_entries, {_PARTS},
       count(*) FILTER (agrees_with_dataset) AS agreement_correct,
       count(*) FILTER (agrees_with_dataset)::DOUBLE / count(*) AS agreement,
       count(*) FILTER (category = 'legit' AND NOT model_correct) AS legit_blocked,
       round(coalesce(avg(domain_quality_score) FILTER ({_SCORED}), 0), 3) AS domain_quality,
       count(*) FILTER ({_SCORED}) AS domains_scored,
       bool_or(has_gib) AS filters_gibberish, bool_or(has_nsfw) AS filters_nsfw
FROM v_rows GROUP BY model_version"""

VIEWS["v_comparison"] = """
SELECT *, (legit_correct + gibberish_correct + nsfw_correct)::DOUBLE / total_entries AS overall_accuracy,
       filters_gibberish::BIGINT + filters_nsfw::BIGINT AS complexity
FROM v_summary"""

VIEWS["v_requests"] = """
SELECT event_id, ts, CASE event_id % 10 WHEN 0 THEN '   ' WHEN 1 THEN NULL WHEN 2 THEN event_type || ' ' || props
       WHEN 3 THEN event_type || ' adult shop ' || plain ELSE event_type || ' service for ' || user_id || ' shops ' || plain END AS business_description
FROM (SELECT *, translate(props, '{}":', '') AS plain FROM events)"""

VIEWS["v_training"] = """
SELECT d.doc_id, d.text AS business_description,
       CASE WHEN l.quality = 1 THEN ['d' || d.doc_id || '.com', 'd' || d.doc_id || '.io'] ELSE []::VARCHAR[] END AS target_domains,
       CASE WHEN l.quality = 1 AND d.doc_id % 3 = 0 THEN 'paraphrase' WHEN l.quality = 1 THEN 'original'
            WHEN d.doc_id % 7 = 0 THEN 'scraped' ELSE 'gibberish' END AS source
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""

VIEWS["v_labelled"] = """
SELECT *, CASE source WHEN 'gibberish' THEN 0 ELSE 1 END AS label FROM v_training
WHERE source IN ('original', 'paraphrase', 'gibberish')"""


def _needed(sql: str) -> list[str]:
    found: list[str] = []
    for name, body in VIEWS.items():
        if name in sql:
            for inner in [*_needed(body), name]:
                if inner not in found:
                    found.append(inner)
    return found


def add(name: str, sql: str, **local: str) -> None:
    """Register a query, with the views it uses and its own named steps in front."""
    everything = " ".join([sql, *local.values()])
    steps = {n: VIEWS[n] for n in _needed(everything)} | local
    head = "WITH " + ", ".join(f"{n} AS ({body.strip()})" for n, body in steps.items()) + " " if steps else ""
    ORACLES[name] = head + sql.strip()


# --- gibberish -----------------------------------------------------------------------------

_GAP = r"[\t-\r ]+"


def rule_sql(t: str, low: str) -> dict[str, str]:
    phrases = "|".join(rf"{a}{_GAP}{b}" for a, b in V.TECH_PHRASES)
    return {
        "network": " OR ".join([
            match(low, rf"(^|[^\p{{L}}\p{{N}}_]){V.IPV4}($|[^\p{{L}}\p{{N}}_])"),
            match(low, r"localhost:\p{Nd}|https?://[^\t-\r ]"),
            anyof(low, V.JAVA_PREFIXES),
            match(low, rf"(npm|pip|apt){_GAP}install"),
            f"contains({low}, '127.0.0.1')",
        ]),
        "repeated_char": repeats(t, 11),
        "lorem": f"contains({low}, 'lorem ipsum')",
        "code": match(low, V.CODE_CHARS + rf"|console\.log|import{_GAP}|from{_GAP}|throw{_GAP}new"),
        "database": match(low, "|".join(V.DATABASE_PRODUCTS) + r"|db\.[a-z]+\.|\.find\(|\.insert\(|\.update\("),
        "symbols": match(low, r"[!?]{5,}|[.]{5,}|,{3,}|[_\-]{5,}|" + V.GLYPHS),
        "long_word": match(t, r"[^\t-\r ]{26,}"),
        "random": " OR ".join([
            match(low, V.LETTERS_ONLY), match(low, V.DIGITS_ONLY), match(low, V.SPECIAL_RUN), match(low, V.ALNUM_RUN),
            match(low, V.MIXED_START),
        ]),
        "few_letters": f"length({t}) > 10 AND length(regexp_replace({t}, '[^\\p{{L}}]', '', 'g'))::DOUBLE / length({t}) < 0.5",
        "scripts": match(low, V.SCRIPT_CHARS),
        "tech": match(low, "|".join(V.TECH_WORDS) + "|" + phrases),
        "short": f"length({trim(t)}) < 10",
        "business": anyof(low, V.BUSINESS_WORDS),
    }


def score_sql(t: str) -> str:
    """The maximum over all rules, less the discount: the direct reading, not the ordered one."""
    rules = rule_sql(t, f"lower({t})")
    fired = ", ".join(f"CASE WHEN {rules[r]} THEN {w} ELSE 0 END" for r, w in V.GIBBERISH_WEIGHTS.items())
    return f"greatest(0, greatest({fired}) - CASE WHEN {rules['business']} THEN {V.BUSINESS_DISCOUNT} ELSE 0 END)::BIGINT"


for _name, _table, _key, _text in [
    ("gibberish_score", "documents", "doc_id", "text"),
    ("gibberish_score_noisy", "v_noisy", "doc_id", "text"),
    ("gibberish_score_html", "pages", "page_id", "html"),
]:
    add(_name, "SELECT *, score_tenths > 7 AS is_gibberish FROM s",
        s=f"SELECT {_key}, {score_sql(_text)} AS score_tenths FROM {_table}")

add("gibberish_rules", "SELECT lang, " + ", ".join(
    f"count(*) FILTER ({sql}) AS rule_{name}" for name, sql in rule_sql("text", "lower(text)").items()
) + " FROM v_noisy GROUP BY lang")

add("gibberish_by_lang", """SELECT lang, s > 7 AS is_gibberish, count(*) AS n_docs, sum(n_chars)::BIGINT AS n_chars
FROM scored GROUP BY 1, 2""", scored=f"SELECT lang, n_chars, {score_sql('text')} AS s FROM documents")

add("gibberish_filter", f"""SELECT conv_id, turn, md5(text) AS text_md5, length(text) AS text_chars
FROM conversations WHERE {score_sql('text')} <= 7""")

# --- unsafe content ------------------------------------------------------------------------

_LOW = f"lower({trim('text')})"


def unsafe_case(low: str, result) -> str:
    """CASE over the keywords in order; ``result(category, keyword)`` is the value."""
    arms = []
    for category, keywords in V.UNSAFE_KEYWORDS.items():
        for k in keywords:
            test = f"contains({low}, {q(k)})"
            if k in V.SAFE_CONTEXTS:
                test += f" AND NOT {anyof(low, V.SAFE_CONTEXTS[k])}"
            arms.append(f"WHEN {test} THEN {result(category, k)}")
    return "CASE " + " ".join(arms) + " END"


add("nsfw_keyword", """SELECT doc_id, hit IS NOT NULL AS is_unsafe,
  CASE WHEN short THEN 'Text too short for meaningful analysis' WHEN hit IS NOT NULL
       THEN 'Contains inappropriate content (' || split_part(hit, '/', 1) || '): ''' || split_part(hit, '/', 2) || ''''
       ELSE 'Content appears safe' END AS reason,
  CASE WHEN short THEN 'length_check' ELSE 'keyword_fallback' END AS method,
  CASE WHEN hit IS NOT NULL THEN split_part(hit, '/', 1) END AS category,
  CASE WHEN hit IS NOT NULL THEN split_part(hit, '/', 2) END AS detected_keyword
FROM c""", c=f"""SELECT doc_id, length({trim('text')}) < 3 AS short,
  CASE WHEN length({trim('text')}) >= 3 THEN {unsafe_case(_LOW, lambda c, k: q(c + '/' + k))} END AS hit FROM v_unsafe""")

EDGE_BEFORE, EDGE_AFTER = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
_ANY_LISTED = r"(^|[^\p{L}\p{N}_])(" + "|".join(V.BLOCKLIST) + r")($|[^\p{L}\p{N}_])"
add("nsfw_blocklist", f"""SELECT doc_id, NOT short AND listed AS is_unsafe,
  CASE WHEN short THEN {q(V.REASON_SHORT)} WHEN listed THEN {q(V.REASON_LISTED)} ELSE {q(V.REASON_NOT_LISTED)} END AS reason,
  CASE WHEN short THEN 'length_check' ELSE 'better_profanity' END AS method
FROM c""", c=f"SELECT doc_id, length({trim('text')}) < 3 AS short, {match('lower(text)', _ANY_LISTED)} AS listed FROM v_unsafe")

# One constant pattern per term: DuckDB compiles a pattern from a column anew for every row.
_EACH_LISTED = ", ".join(
    f"CASE WHEN {match('lower(text)', EDGE_BEFORE + t + EDGE_AFTER)} THEN {q(t)} END" for t in V.BLOCKLIST
)
add("nsfw_blocklist_table", "SELECT doc_id, len(hits) AS n_terms, list_min(hits) AS first_term FROM h WHERE len(hits) > 0",
    h=f"SELECT doc_id, list_filter([{_EACH_LISTED}], lambda x: x IS NOT NULL) AS hits FROM v_unsafe")

# RE2 consumes the character before a hit, so words are masked one at a time between kept separators.
add("nsfw_censor", "SELECT doc_id, md5(t) AS censored_md5, length(t) AS censored_chars FROM c", c=f"""
SELECT doc_id, array_to_string(list_transform(
  regexp_extract_all(replace(replace({trim('text')}, 'money-laundering', '****'), 'Money-laundering', '****'), '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+'),
  lambda w: CASE WHEN lower(w) IN ({', '.join(q(w) for w in V.BLOCKLIST)}) THEN '****' ELSE w END), '') AS t
FROM v_unsafe""")

_D = "domain"
add("nsfw_candidate_filter", f"""SELECT entry_id, CASE WHEN len(kept) = 0 THEN 'SAFE_DOMAINS_UNAVAILABLE' ELSE {joined('kept')} END AS domains FROM k""",
    o=f"""SELECT entry_id, CASE WHEN entry_id % 5 = 0 THEN ['kkk' || {_D}] ELSE [{_D}, 'Sex' || {_D}, 'adult' || {_D}, 'my' || {_D}] END AS offered FROM v_candidates""",
    k=f"""SELECT entry_id, list_filter(offered, lambda d: {unsafe_case('lower(d)', lambda c, k: '1')} IS NULL) AS kept FROM o""")

# --- candidates ----------------------------------------------------------------------------

FALLBACKS = names(V.FALLBACK_DOMAINS)


def ordered_distinct(expr: str) -> str:
    return f"list_filter({expr}, lambda x, i: list_position({expr}, x) = i)"


def without(expr: str, labels) -> str:
    for label in labels:
        expr = f"replace({expr}, {q(label)}, '')"
    return expr


def from_lines(text: str, labels) -> str:
    lines = f"list_filter(list_transform(string_split({text}, chr(10)), lambda x: {trim('x')}), lambda x: contains(x, '.'))"
    clean = f"list_transform({lines}, lambda x: {without('x', labels)})"
    kept = f"list_filter({clean}, lambda x: contains(x, '.') AND length(x) BETWEEN 3 AND 30)"
    return f"list_transform({kept}, lambda x: rtrim(x, '.,!?'))"


def padded(expr: str) -> str:
    return f"list_concat({expr}, {FALLBACKS}[len({expr}) + 1:])[1:3]"


_SHORT = "len(d) < 3 AS is_short"
_T = trim("response")
_PH = ", ".join(q(p) for p in V.PLACEHOLDER_DOMAINS)
_NUMBERED = V.LINE_LABELS + V.NUMBER_LABELS

add("extract_v0", f"SELECT entry_id, {joined('d')} AS domains, {_SHORT} FROM e",
    l=f"SELECT entry_id, list_transform({from_lines(_T, V.LINE_LABELS)}, lambda x: lower(x)) AS a FROM v_responses",
    e=f"SELECT entry_id, {ordered_distinct('a')}[1:3] AS d FROM l")

_V12 = f"""SELECT entry_id, {_T} AS t, list_transform(list_filter({from_lines(_T, _NUMBERED)}, lambda x: x NOT IN ({_PH})), lambda x: lower(x)) AS a FROM v_responses"""
add("extract_v1", f"SELECT entry_id, {joined('d')} AS domains, {_SHORT} FROM e",
    l=_V12, u=f"SELECT entry_id, {ordered_distinct('a')} AS b FROM l", e=f"SELECT entry_id, {padded('b')} AS d FROM u")

_V2_STEPS = {
    "l": _V12,
    "u": f"SELECT entry_id, t, {ordered_distinct('a')} AS b FROM l",
    "e": f"SELECT entry_id, CASE WHEN len(b) > 0 THEN {padded('b')} WHEN t = '' THEN []::VARCHAR[] ELSE ['domain1.com'] END AS d FROM u",
}
add("extract_v2", f"SELECT entry_id, {joined('d')} AS domains, {_SHORT} FROM e", **_V2_STEPS)
add("low_quality_output", f"""SELECT entry_id, bad AS is_low_quality, CASE WHEN bad THEN '' ELSE {joined('d')} END AS domains FROM f""",
    **_V2_STEPS,
    f=f"""SELECT entry_id, d, len(list_filter(d, lambda x: x NOT IN ({', '.join(q(x) for x in V.FALLBACK_DOMAINS)}))) = 0
  OR len(list_filter(d, lambda x: {anyof('lower(x)', V.GENERIC_WORDS)})) > 0 AS bad FROM e""")

_COMMA = f"list_transform(list_filter(list_transform(string_split(t, ','), lambda x: {trim('x')}), lambda x: contains(x, '.') AND length(x) BETWEEN 3 AND 30), lambda x: rtrim(x, '.,!?'))"
add("extract_v3", f"SELECT entry_id, {joined('d')} AS domains, {_SHORT} FROM e",
    t=f"SELECT entry_id, CASE WHEN contains(response, 'assistant') THEN {trim('string_split(response, ' + q('assistant') + ')[-1]')} ELSE {_T} END AS t FROM v_responses",
    l=f"SELECT entry_id, list_filter(list_transform(CASE WHEN contains(t, ',') THEN {_COMMA} ELSE {from_lines('t', _NUMBERED)} END, lambda x: lower(x)), lambda x: x NOT IN ({_PH})) AS a FROM t",
    u=f"SELECT entry_id, {ordered_distinct('a')} AS b FROM l", e=f"SELECT entry_id, {padded('b')} AS d FROM u")

_V4_STEPS = {
    "p": f"""SELECT entry_id, description, list_filter(list_transform(regexp_split_to_array({_T}, '[,\\n\\r\\t|]'), lambda x: {trim('x')}),
      lambda x: x <> '' AND lower(x) NOT IN ({', '.join(q(h) for h in V.HEADER_WORDS)})) AS a FROM v_responses""",
    "b": f"""SELECT entry_id, description, list_filter(list_transform(a, lambda x: {trim("regexp_replace(regexp_replace(x, '^[0-9]+[.)][\\t-\\r ]*', ''), '^[-•*][\\t-\\r ]*', '')")}),
      lambda x: contains(x, '.') AND length(x) > 3) AS a FROM p""",
    "m": """SELECT entry_id, description, list_transform(a, lambda x: regexp_extract(regexp_replace(x, '^["'']|["'']$', '', 'g'), '([a-zA-Z0-9-]+\\.[a-zA-Z]{2,4})', 1)) AS a FROM b""",
    "f": """SELECT entry_id, description, list_filter(a, lambda x: length(x) <= 63 AND regexp_matches(x, '^[a-zA-Z0-9][a-zA-Z0-9-]*[a-zA-Z0-9]*\\.[a-zA-Z]{2,}$')) AS a FROM m""",
    "e": f"SELECT entry_id, description, {padded('a')} AS d FROM f",
}
add("extract_v4", f"SELECT entry_id, {joined('d')} AS domains, {_SHORT} FROM e", **_V4_STEPS)

_VALID = r"'^[a-zA-Z0-9][a-zA-Z0-9-]*[a-zA-Z0-9]*\.[a-zA-Z]{2,}$'"
add("domain_valid", f"""SELECT page_id, host, length(host) <= 63 AND regexp_matches(host, {_VALID}) AS host_valid,
  length(site) <= 63 AND regexp_matches(site, {_VALID}) AS site_valid
FROM (SELECT page_id, host, array_to_string(string_split(host, '.')[-2:], '.') AS site FROM h)""",
    h="SELECT page_id, split_part(split_part(split_part(split_part(url, '//', 2), '/', 1), '?', 1), ':', 1) AS host FROM pages")


def keyword_steps(table: str, key: str, text: str, n: int) -> dict[str, str]:
    plain = f"replace(replace(lower({text}), '.', ''), ',', '')"
    tlds = names(V.KEYWORD_TLDS[i % 5] for i in range(n))
    fillers = names(f"startup{i}.com" for i in range(n))
    return {
        "kw": f"""SELECT {key}, {text}, list_filter(regexp_split_to_array({plain}, '[\\t-\\r ]+'),
          lambda w: length(w) > 3 AND w NOT IN ({', '.join(q(w) for w in V.KEYWORD_STOP_WORDS)}))[1:{n}] AS k FROM {table}""",
        "kd": f"""SELECT {key}, {text}, list_concat(list_transform(k, lambda w, i: substr(w, 1, 8) || {tlds}[i]), {fillers}[len(k) + 1:]) AS d FROM kw""",
    }


add("keyword_fallback", f"SELECT doc_id, {joined('d')} AS domains FROM kd", **keyword_steps("documents", "doc_id", "text", 5))

_CHAT_A, _CHAT_B = V.CHAT_PROMPT.split("{text}")
_ECHO = f"{q(_CHAT_A)} || description || {q(_CHAT_B)} || chr(10) || response"
add("strip_prompt", f"""SELECT entry_id, {trim('response')} AS answer, {trim('response')} AS section FROM v_responses""")
add("joined_pieces", "SELECT entry_id, response AS answer FROM v_responses")

# --- confidence ----------------------------------------------------------------------------


def factor_sql(domain: str, words: str) -> dict[str, str]:
    name = f"split_part({domain}, '.', 1)"
    low = f"lower({name})"
    mine = f"list_distinct(regexp_extract_all({low}, '[a-z]+'))"
    vowels = f"length(regexp_replace({low}, '[^aeiou]', '', 'g'))"
    consonants = f"length(regexp_replace({low}, '[aeiou]|[^\\p{{L}}]', '', 'g'))"
    pairs = (
        f"coalesce(list_sum(list_transform(list_filter({words}, lambda w: length(w) >= 4), "
        f"lambda w: len(list_filter({mine}, lambda d: contains(w, d) OR contains(d, w))))), 0)"
    )
    ratio = f"({vowels}::DOUBLE / {consonants})"
    tld = " ".join(f"WHEN {q(k)} THEN {v}" for k, v in V.TLD_SCORES.items())
    return {
        "length": f"CASE WHEN length({name}) BETWEEN 8 AND 15 THEN 1000 WHEN length({name}) BETWEEN 6 AND 18 THEN 800 WHEN length({name}) BETWEEN 4 AND 20 THEN 600 ELSE 300 END",
        "readability": f"1000 - CASE WHEN regexp_matches({name}, '[0-9]') THEN 300 ELSE 0 END - CASE WHEN contains({name}, '-') THEN 200 ELSE 0 END - CASE WHEN {repeats(name, 3)} THEN 300 ELSE 0 END",
        "relevance": f"least(1000, least(1000, 400 * len(list_intersect({words}, {mine}))) + 200 * {pairs})",
        "tld": f"CASE lower(split_part({domain}, '.', -1)) {tld} ELSE 400 END",
        "memorability": f"CASE WHEN {consonants} = 0 OR {ratio} BETWEEN 0.3 AND 0.8 THEN 1000 ELSE 700 END - CASE WHEN regexp_matches({low}, '[bcdfghjklmnpqrstvwxyz]{{4,}}') THEN 300 ELSE 0 END",
    }


def known_words(text: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+'))"


TOTAL = '(length * 15 + readability * 20 + relevance * 25 + tld * 20 + memorability * 20) // 100'


def factor_columns(domain: str, words: str) -> str:
    return ", ".join(f"({sql})::BIGINT AS {name}" for name, sql in factor_sql(domain, words).items())


add("confidence_factors", f"SELECT entry_id, length, readability, relevance, tld, memorability, {TOTAL} AS total FROM f",
    k=f"SELECT entry_id, domain, {known_words('description')} AS known FROM v_candidates",
    f=f"SELECT entry_id, {factor_columns('domain', 'known')} FROM k")


def ranked_steps(source: str, key: str, text: str) -> dict[str, str]:
    return {
        "x": f"SELECT {key} AS entry_id, {known_words(text)} AS known, unnest(d) AS domain, generate_subscripts(d, 1) AS pos FROM {source}",
        "sc": f"SELECT entry_id, domain, pos, {factor_columns('domain', 'known')} FROM x",
        "rk": f"SELECT entry_id, domain, pos, {TOTAL} AS confidence_milli FROM sc",
    }


_RANKED = """SELECT entry_id, row_number() OVER (PARTITION BY entry_id ORDER BY confidence_milli DESC, pos) AS rank, domain,
  confidence_milli::BIGINT AS confidence_milli FROM rk"""
add("confidence_rank", _RANKED, **_V4_STEPS, **ranked_steps("e", "entry_id", "description"))
add("confidence_long_text", _RANKED, **keyword_steps("documents", "doc_id", "text", 3), **ranked_steps("kd", "doc_id", "text"))

_TLD_CASE = " ".join(f"WHEN {q(k)} THEN {v}" for k, v in V.TLD_SCORES.items())
add("tld_quality", f"""SELECT lower(split_part(domain, '.', -1)) AS tld, count(*) AS n,
  max(CASE lower(split_part(domain, '.', -1)) {_TLD_CASE} ELSE 400 END)::BIGINT AS score FROM v_candidates GROUP BY 1""")

# --- routing -------------------------------------------------------------------------------

_GATE = {
    "g": f"""SELECT event_id, ts, business_description AS text, CASE WHEN business_description IS NULL OR {trim('business_description')} = '' THEN 'error'
      WHEN length({trim('business_description')}) >= 3 AND {unsafe_case('lower(business_description)', lambda c, k: '1')} IS NOT NULL THEN 'blocked'
      WHEN {score_sql('business_description')} > 7 THEN 'filtered' ELSE 'pass' END AS gate FROM v_requests""",
}
_STATUS_STEPS = {
    **_GATE,
    **keyword_steps("g", "event_id", "text", 3),
    # The answer is the keyword names; every one must survive the v4 parser and the second screening.
    "m": """SELECT event_id, text, list_filter(list_transform(d, lambda x: regexp_extract(x, '([a-zA-Z0-9-]+\\.[a-zA-Z]{2,4})', 1)), lambda x: x <> '' AND x NOT LIKE '-%') AS a FROM kd""",
    "s": f"""SELECT event_id, text, list_filter({padded('a')}, lambda x: {unsafe_case('lower(x)', lambda c, k: '1')} IS NULL) AS d FROM m""",
    **ranked_steps("s", "event_id", "text"),
    "o": "SELECT entry_id, array_to_string(list(domain ORDER BY confidence_milli DESC, pos), '|') AS domains, max(confidence_milli)::BIGINT AS best FROM rk GROUP BY entry_id",
}
add("response_status", f"""SELECT g.event_id, CASE gate WHEN 'pass' THEN CASE WHEN o.entry_id IS NULL THEN 'blocked' ELSE 'success' END ELSE gate END AS status,
  CASE gate WHEN 'error' THEN {q(V.MSG_REQUIRED)} WHEN 'blocked' THEN {q(V.MSG_BLOCKED)} WHEN 'filtered' THEN {q(V.MSG_FILTERED)}
    ELSE CASE WHEN o.entry_id IS NULL THEN {q(V.MSG_NO_SAFE)} ELSE '' END END AS message,
  CASE gate WHEN 'error' THEN 500 ELSE 200 END::BIGINT AS http_code,
  CASE gate WHEN 'pass' THEN coalesce(o.domains, '') ELSE '' END AS domains,
  CASE gate WHEN 'pass' THEN o.best END AS best_milli
FROM g LEFT JOIN o ON g.event_id = o.entry_id""", **_STATUS_STEPS)
ORACLES["stream_score"] = ORACLES["response_status"]

add("output_status", f"""SELECT model_version, status, message, count(*) AS n, sum(CASE WHEN status = 'success' THEN len(target_domains) ELSE 0 END)::BIGINT AS n_suggestions
FROM (SELECT *, CASE WHEN {trim('business_description')} = '' THEN 'error' WHEN len(target_domains) = 0 THEN 'filtered'
   WHEN target_domains IN (['NSFW_CONTENT_DETECTED'], ['SAFE_DOMAINS_UNAVAILABLE']) THEN 'blocked' ELSE 'success' END AS status,
  CASE WHEN {trim('business_description')} = '' THEN {q(V.MSG_REQUIRED)} WHEN len(target_domains) = 0 THEN {q(V.MSG_FILTERED)}
   WHEN target_domains = ['NSFW_CONTENT_DETECTED'] THEN {q(V.MSG_BLOCKED)} WHEN target_domains = ['SAFE_DOMAINS_UNAVAILABLE'] THEN {q(V.MSG_NO_SAFE)} ELSE '' END AS message
  FROM v_outputs) GROUP BY ALL""")

add("document_gate", f"""SELECT CASE WHEN {trim('text')} = '' THEN 'error'
  WHEN length({trim('text')}) >= 3 AND {unsafe_case(_LOW, lambda c, k: '1')} IS NOT NULL THEN 'blocked'
  WHEN {score_sql('text')} > 7 THEN 'filtered' ELSE 'pass' END AS gate, count(*) AS n FROM v_unsafe GROUP BY 1""")

add("request_intake", """SELECT event_id, CASE WHEN event_id % 6 = 5 THEN '' ELSE coalesce(business_description, '') END AS from_body,
  coalesce(business_description, '') AS from_query, event_id % 6 <> 5 AND business_description IS NOT NULL AS is_request FROM v_requests""")
add("request_failures", f"""SELECT a.event_id, CASE WHEN event_id % 9 = 0 THEN status ELSE 'error' END AS status,
  CASE event_id % 9 WHEN 0 THEN message WHEN 6 THEN {q(V.MSG_REQUIRED)} WHEN 2 THEN {q(V.MSG_BAD_JSON)} WHEN 4 THEN {q(V.MSG_BAD_JSON)}
    WHEN 7 THEN {q(V.MSG_BAD_JSON)} ELSE {q(V.MSG_REQUEST_FAILED)} END AS message,
  CASE WHEN event_id % 9 = 0 THEN http_code WHEN event_id % 9 IN (2, 4, 7) THEN 400 ELSE 500 END::BIGINT AS http_code
FROM ({ORACLES['response_status']}) a""")

# --- evaluation ----------------------------------------------------------------------------

add("truth_table", "SELECT truth_category, count(*) AS n FROM v_truth GROUP BY 1")
add("gt_lookup", "SELECT model_version, entry_id, category FROM v_categorised")
add("positional_category", f"SELECT d.doc_id, {_PLACE} AS category FROM documents d")
add("model_correct", "SELECT model_version, category, model_correct, count(*) AS n FROM v_rows GROUP BY ALL")
add("evaluation_rows", f"""SELECT model_version, entry_id, substr(business_description, 1, 60) AS preview, {joined('target_domains')} AS generated_domains,
  category, classification, model_correct, agrees_with_dataset, domain_quality_score, parse_ok FROM v_rows""")
add("eval_summary", "SELECT * FROM v_summary")
add("model_comparison", "SELECT * FROM v_comparison")


def pct(expr: str) -> str:
    return f"printf('%.1f%%', round({expr} * 100, 1))"


add("summary_table", f"""SELECT model_version AS model, {pct('overall_accuracy')} AS overall_acc, {pct('legit_accuracy')} AS legit_acc,
  {pct('gibberish_accuracy')} AS gibberish_acc, {pct('nsfw_accuracy')} AS nsfw_acc, domain_quality AS quality_score,
  legit_blocked AS false_positives, {pct('agreement')} AS agreement FROM v_comparison""")
add("chart_series", " UNION ALL ".join(
    f"SELECT model_version AS model, '{n}' AS metric, ({e})::DOUBLE AS value FROM v_comparison" for n, e in [
        ("overall_pct", "overall_accuracy * 100"), ("legit_pct", "legit_accuracy * 100"),
        ("gibberish_pct", "gibberish_accuracy * 100"), ("nsfw_pct", "nsfw_accuracy * 100"),
        ("domains_scored", "domains_scored"), ("complexity", "complexity"), ("domain_quality", "domain_quality"),
    ]))
add("versions_side_by_side", "SELECT " + ", ".join(
    f"max(overall_accuracy) FILTER (model_version = '{v}') AS {v}" for v in V.CAPABILITIES) + " FROM v_comparison")
add("success_rate", """SELECT model_version, count(*) AS total, count(*) FILTER (len(target_domains) > 0) AS successful,
  count(*) FILTER (len(target_domains) > 0)::DOUBLE / count(*) * 100 AS success_rate FROM v_outputs GROUP BY 1""")
add("generation_stats", """SELECT model_version, count(*) AS processed, count(*) FILTER (len(target_domains) > 0) AS legitimate,
  count(*) FILTER (len(target_domains) = 0) AS gibberish,
  count(*) FILTER (len(target_domains) > 0)::DOUBLE / count(*) * 100 AS legitimate_pct,
  count(*) FILTER (len(target_domains) = 0)::DOUBLE / count(*) * 100 AS gibberish_pct,
  count(*) FILTER (len(target_domains) > 0) AS with_domains FROM v_outputs GROUP BY 1""")
add("source_breakdown", """SELECT coalesce(source, 'unknown') AS source, count(*) AS n,
  count(*)::DOUBLE / (SELECT count(*) FROM documents) * 100 AS share_pct FROM documents GROUP BY 1""")
add("report_scan", "SELECT *, 'evaluated_names_' || model_version || '.json' AS report FROM v_summary")

# --- verdicts ------------------------------------------------------------------------------

add("verdict_parse", "SELECT doc_id, parse_ok, classification, agrees_with_dataset, n_scores::BIGINT AS n_scores FROM v_read")
add("quality_rollup", "SELECT doc_id, domain_quality_score FROM v_read")


def rated(value: str) -> str:
    """Is every number of a rating there and between 0 and 1?"""
    paths = ["$.score", *(f"$.reasons.{c}" for c in V.CRITERIA)]
    return "(" + " AND ".join(f"coalesce({numeric(value, p)} BETWEEN 0 AND 1, false)" for p in paths) + ")"


_RATING_STEPS = {
    "u": f"SELECT entry_id, description, domains, {unfenced('rating_text')} AS t, {unfenced('list_text')} AS lt FROM v_ratings",
    "w": """SELECT *, CASE WHEN json_valid(t) THEN t::JSON END AS v,
      CASE WHEN starts_with(lt, '[') AND json_valid(lt) THEN json_extract(lt::JSON, '$[*]') END AS es FROM u""",
    "ok": f"""SELECT *, v IS NOT NULL AND {rated('v')} AS valid,
      es IS NOT NULL AND len(list_filter(es, lambda e: NOT {rated('e')})) = 0 AS list_valid FROM w""",
}
add("verdict_validate", f"""SELECT entry_id, valid, CASE WHEN valid THEN {numeric('v', '$.score')} ELSE 0 END::DOUBLE AS score,
  CASE WHEN valid THEN {numeric('v', '$.reasons.clarity')} ELSE 0 END::DOUBLE AS clarity FROM ok""", **_RATING_STEPS)
add("verdict_list", f"""SELECT entry_id, true AS valid, json_extract_string(e, '$.domain') AS domain, {numeric('e', '$.score')} AS score
FROM (SELECT entry_id, unnest(es) AS e FROM ok WHERE list_valid)
UNION ALL SELECT entry_id, false, NULL, NULL FROM ok WHERE NOT list_valid""", **_RATING_STEPS)


def fill(template: str, **values: str) -> str:
    """The template as SQL: nested replace() over one literal."""
    sql = q(template)
    for name, value in values.items():
        sql = f"replace({sql}, '{{{name}}}', {value})"
    return sql


add("verdict_requeue", f"""SELECT entry_id, domain, md5({fill(V.SINGLE_JUDGE_PROMPT, domain='domain', text='description')}) AS prompt_md5
FROM (SELECT entry_id, description, unnest(domains) AS domain FROM ok WHERE NOT list_valid)""", **_RATING_STEPS)

_AGAIN = {
    **_RATING_STEPS,
    "pd": f"""SELECT entry_id, domain, md5({fill(V.SINGLE_JUDGE_PROMPT, domain='domain', text='description')}) AS h
      FROM (SELECT entry_id, description, unnest(domains) AS domain FROM ok WHERE NOT list_valid)""",
    "pf": """SELECT *, ('0x' || substr(h, 1, 1))::BIGINT % 4 AS fails FROM pd""",
}
add("verdict_answers", """SELECT entry_id, domain, fails < 3 AS valid, least(fails + 1, 3) AS attempts,
  CASE WHEN fails < 3 THEN ('0x' || substr(h, 2, 1))::BIGINT % 10 / 10.0 ELSE 0 END::DOUBLE AS score FROM pf""", **_AGAIN)
add("verdict_calls", """SELECT least(fails + 1, 3) AS attempts, fails < 3 AS valid, count(*) AS prompts, CAST(sum(least(fails + 1, 3)) AS BIGINT) AS calls,
  (SELECT count(*) FROM pf) AS prompts_wanted FROM (SELECT DISTINCT h, fails FROM pf) GROUP BY 1, 2""", **_AGAIN)

# --- deduplication -------------------------------------------------------------------------

_KEY = f"lower({trim('text')})"
add("first_occurrence", f"""SELECT doc_id, lang, n_chars FROM documents
WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY {_KEY})""")
_NEW = f"""SELECT doc_id, text FROM (SELECT doc_id, text, {_KEY} AS k, row_number() OVER (PARTITION BY {_KEY} ORDER BY doc_id) AS rn FROM documents WHERE source >= 'src4')
WHERE rn = 1 AND k NOT IN (SELECT {_KEY} FROM documents WHERE source < 'src4')"""
add("dedup_append", "SELECT doc_id, md5(text) AS text_md5, length(text) AS text_chars FROM n", n=_NEW)
add("append_counts", """SELECT (SELECT count(*) FROM n) AS added, (SELECT count(*) FROM documents WHERE source >= 'src4') - (SELECT count(*) FROM n) AS skipped""", n=_NEW)
add("append_round_trip", "SELECT md5(text) AS text_md5 FROM n UNION ALL SELECT md5(text) FROM documents WHERE source < 'src4'", n=_NEW)

# --- prompts -------------------------------------------------------------------------------


def digest(table: str, keys: str, prompt: str) -> str:
    return f"SELECT {keys}, md5(p) AS prompt_md5, length(p) AS prompt_chars FROM (SELECT {keys}, {prompt} AS p FROM {table})"


# A text may itself hold {text}-like marks, so it is filled in last.
add("prompt_instruction", f"SELECT entry_id, {fill(V.INSTRUCTION_PROMPT, n=q('3'), text='description')} AS prompt FROM v_candidates")
add("prompt_chat", digest("documents", "doc_id", fill(V.CHAT_PROMPT, text="text")))
_TRAIN_PROMPT = fill(V.TRAINING_PROMPT, domains="coalesce(array_to_string(target_domains, ', '), '')", text="business_description")
add("prompt_train", digest("v_training", "doc_id", _TRAIN_PROMPT))
_SHOWN = "'[' || coalesce(array_to_string(list_transform(target_domains, lambda x: '''' || x || ''''), ', '), '') || ']'"
add("prompt_judge", digest("v_outputs", "model_version, entry_id", fill(
    V.JUDGE_PROMPT, domains=_SHOWN, category="positional_category", text="business_description")))
add("prompt_judge_single", f"SELECT entry_id, {fill(V.SINGLE_JUDGE_PROMPT, domain='domain', text='description')} AS prompt FROM v_candidates")
_BULLETS = "array_to_string(list_transform(domains, lambda x: '- ' || x), chr(10))"
add("prompt_judge_list", f"SELECT entry_id, {fill(V.LIST_JUDGE_PROMPT, domains=_BULLETS, text='description')} AS prompt FROM v_ratings")

# --- training data -------------------------------------------------------------------------

add("label_map", "SELECT source, label::BIGINT AS label, count(*) AS n FROM v_labelled GROUP BY ALL")
add("class_balance", """SELECT count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives,
  avg(label::DOUBLE) * 100 AS positive_pct FROM v_labelled""")


def hashed(expr: str) -> str:
    return f"md5({expr}::VARCHAR || '|42')"


VIEWS["v_balanced"] = f"""
SELECT doc_id, label FROM (
  SELECT b.*, target, CASE WHEN back > 50 THEN row_number() OVER (PARTITION BY label, back > 50 ORDER BY {hashed('doc_id')}, doc_id) END AS rest_rank
  FROM (SELECT doc_id, label, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY doc_id DESC) AS back,
          row_number() OVER (PARTITION BY label ORDER BY {hashed('doc_id')}, doc_id) AS any_rank FROM v_labelled) AS b,
       (SELECT least(count(*) FILTER (label = 1), count(*) FILTER (label = 0)) AS target FROM v_labelled) AS c)
WHERE CASE WHEN label = 0 THEN n <= target OR any_rank <= target
  WHEN n <= target THEN true WHEN target > 50 THEN back <= 50 OR rest_rank <= target - 50
  ELSE back <= 50 AND back > least(50, n) - target END"""
add("balance_classes", "SELECT doc_id, label::BIGINT AS label FROM v_balanced")
add("class_balance_after", """SELECT count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives,
  avg(label::DOUBLE) * 100 AS positive_pct FROM v_balanced""")
add("stratified_split", f"""SELECT doc_id, CASE WHEN ('0x' || substr({hashed('doc_id')}, 1, 8))::BIGINT / 4294967296.0 < 0.2 THEN 'test' ELSE 'train' END AS split FROM v_labelled""")
def exact_split(table: str) -> dict[str, str]:
    """Steps that end in sp(doc_id, label, split)."""
    return {
        "c0": f"SELECT count(*) AS n, count(*) FILTER (label = 1) AS p, ceil(count(*) * 0.2)::BIGINT AS wanted FROM {table}",
        "c": """SELECT wanted, (wanted * p) // n + CASE WHEN (wanted * p) % n > (wanted * (n - p)) % n
          THEN wanted - (wanted * p) // n - (wanted * (n - p)) // n ELSE 0 END AS t1 FROM c0""",
        "k": f"SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY {hashed('doc_id')}, doc_id) AS r FROM {table}",
        "sp": "SELECT doc_id, label, CASE WHEN r <= CASE label WHEN 1 THEN t1 ELSE wanted - t1 END THEN 'test' ELSE 'train' END AS split FROM k, c",
    }


add("stratified_split_exact", "SELECT doc_id, split FROM sp", **exact_split("v_labelled"))
add("classifier_predict", """SELECT doc_id, label::BIGINT AS label, true AS sums_to_one, true AS confidence_is_larger, true AS label_agrees,
  true AS likelier_wins FROM sp WHERE split = 'test'""", **exact_split("v_balanced"))
add("random_sample", f"""SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY {hashed('doc_id')}, doc_id) AS r, count(*) OVER () AS n FROM documents)
WHERE r <= n // 10""")
add("shuffled_order", f"SELECT doc_id, lang FROM documents ORDER BY {hashed('doc_id')}, doc_id")
_OVERALL = "SELECT count(*) AS rows, count(DISTINCT label) AS labels FROM v_labelled"
add("class_weights", """SELECT label::BIGINT AS label, count(*) AS n, (SELECT rows FROM o)::DOUBLE / ((SELECT labels FROM o) * count(*)) AS weight
FROM v_labelled GROUP BY 1""", o=_OVERALL)
add("class_weight_column", """SELECT doc_id, (SELECT rows FROM o)::DOUBLE / ((SELECT labels FROM o) * count(*) OVER (PARTITION BY label)) AS weight FROM v_labelled""", o=_OVERALL)

_PRED = {"pr": f"""SELECT l.quality AS label, CASE WHEN {score_sql('text')} > 7 THEN 0 ELSE 1 END AS prediction
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""}
add("confusion_counts", "SELECT label::BIGINT AS label, prediction::BIGINT AS prediction, count(*) AS n FROM pr GROUP BY ALL", **_PRED)
add("confusion_matrix", """SELECT label::BIGINT AS label, count(*) FILTER (prediction = 0) AS predicted_gibberish,
  count(*) FILTER (prediction = 1) AS predicted_legitimate FROM pr GROUP BY 1""", **_PRED)


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN ({a})::DOUBLE / ({b}) ELSE 0 END"


def f1(p: str, r: str) -> str:
    return f"CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0 END"


add("classification_metrics", """SELECT accuracy, pg AS precision_gibberish, rg AS recall_gibberish, pl AS precision_legitimate, rl AS recall_legitimate,
  fg AS f1_gibberish, fl AS f1_legitimate, (fg + fl) / 2 AS f1_macro, (pg + pl) / 2 AS precision_macro, (rg + rl) / 2 AS recall_macro,
  (fg * n0 + fl * n1) / (n0 + n1) AS f1_weighted FROM f""", **_PRED,
    c="""SELECT count(*) FILTER (label = 0 AND prediction = 0) AS a, count(*) FILTER (label = 0 AND prediction = 1) AS b,
      count(*) FILTER (label = 1 AND prediction = 0) AS c, count(*) FILTER (label = 1 AND prediction = 1) AS d FROM pr""",
    m=f"""SELECT a + b AS n0, c + d AS n1, {ratio('a + d', 'a + b + c + d')} AS accuracy, {ratio('a', 'a + c')} AS pg, {ratio('a', 'a + b')} AS rg,
      {ratio('d', 'd + b')} AS pl, {ratio('d', 'd + c')} AS rl FROM c""",
    f=f"SELECT *, {f1('pg', 'rg')} AS fg, {f1('pl', 'rl')} AS fl FROM m")


def ids(text: str, n: int) -> str:
    return f"""list_transform(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+')[1:{n}], lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % 30000)"""


_TOK = {"tk": f"SELECT doc_id, {ids(_TRAIN_PROMPT, 200)} AS t FROM v_training"}
add("token_prepare", "SELECT doc_id, array_to_string(t, ',') AS input_ids, len(t) AS mask_size, true AS labels_match FROM tk", **_TOK)
add("token_truncate_classifier", f"SELECT doc_id, md5(coalesce(array_to_string({ids('text', 128)}, ','), '')) AS ids_md5 FROM documents")
add("token_profile", "SELECT count(*) AS n_rows, " + ", ".join(
    f"min(len(t)) AS {c}_min, max(len(t)) AS {c}_max, avg(len(t)) AS {c}_avg" for c in ("input_ids", "attention_mask", "labels")
) + " FROM tk", **_TOK)
add("pad_bucket", """SELECT doc_id, b AS bucket, b AS n_ids, n AS n_real, b - n AS n_ignored
FROM (SELECT doc_id, len(t) AS n, (len(t) + 7) // 8 * 8 AS b FROM tk)""", **_TOK)
add("token_batches", """SELECT b AS bucket, slot, (rn - 1) // r AS batch, CAST(sum(n) AS BIGINT) AS n_tokens, count(*) AS n_rows, count(*) * b AS n_padded,
  true AS one_width, string_agg(doc_id, ',' ORDER BY doc_id) AS ids
FROM (SELECT *, row_number() OVER (PARTITION BY b, slot ORDER BY doc_id) AS rn, greatest(1, 2048 // greatest(b, 1)) AS r
  FROM (SELECT doc_id, len(t) AS n, (len(t) + 7) // 8 * 8 AS b,
    CAST(floor(('0x' || substr(md5(doc_id || '|slot'), 1, 8))::BIGINT / 4294967296.0 * greatest(1, ceil((SELECT count(*) FROM tk) / 100))) AS BIGINT) AS slot FROM tk))
GROUP BY b, slot, r, (rn - 1) // r""", **_TOK)
add("eval_subset", "SELECT doc_id, source FROM v_training ORDER BY doc_id LIMIT 50")
add("eval_subset_disjoint", """SELECT doc_id, source, CASE WHEN row_number() OVER (ORDER BY doc_id) <= 50 THEN 'eval' ELSE 'train' END AS split
FROM v_training""")
add("head_projection", f"""SELECT doc_id, md5(business_description) AS text_md5, length(business_description) AS text_chars, {joined('target_domains')} AS target_domains, source
FROM v_training ORDER BY doc_id LIMIT 10""")
add("dataset_metadata", "SELECT count(*) AS total_examples, 200::BIGINT AS max_seq_length, 'hashed-words' AS model_name FROM v_labelled")
add("tokens_round_trip", "SELECT doc_id, len(t) AS n_ids, (SELECT count(*) FROM tk) AS total_examples FROM tk", **_TOK)

# --- inference -----------------------------------------------------------------------------


def stub(text: str, endings) -> str:
    key = f"translate(substr(md5({text}), 1, 12), '0123456789', 'ghijklmnop')"
    return "[" + ", ".join(f"{key} || {q(e)}" for e in endings) + "]"


add("model_inference", f"""SELECT entry_id, CASE WHEN contains(description, 'widget') THEN 'no answer' ELSE '' END AS error,
  CASE WHEN contains(description, 'widget') THEN {joined('d')} ELSE {joined('list_concat(' + stub('description', ['.com', '.io']) + ", ['domain3.com'])")} END AS domains
FROM kd""", **keyword_steps("v_candidates", "entry_id", "description", 3))
add("batch_generation", f"""SELECT event_id, gate, CASE WHEN gate = 'pass' AND len(safe) = 0 THEN 'blocked' WHEN gate = 'pass' THEN 'success' ELSE gate END AS status,
  CASE gate WHEN 'blocked' THEN 'NSFW_CONTENT_DETECTED' WHEN 'pass' THEN CASE WHEN len(safe) = 0 THEN 'SAFE_DOMAINS_UNAVAILABLE' ELSE {joined('safe')} END ELSE '' END AS domains,
  CASE gate WHEN 'error' THEN 500 ELSE 200 END::BIGINT AS http_code
FROM (SELECT event_id, gate, list_filter({stub(fill(V.CHAT_PROMPT, text='text'), ['.com', '.io', '.ai'])}, lambda x: {unsafe_case('lower(x)', lambda c, k: '1')} IS NULL) AS safe FROM g)""", **_GATE)

# --- sources and sinks ---------------------------------------------------------------------

_LINE = "CASE WHEN doc_id % 2 = 0 THEN '  ' || text ELSE text END"
add("scan_jsonl", f"SELECT md5({trim('text')}) AS text_md5, length({trim('text')}) AS text_chars FROM documents WHERE {trim('text')} <> ''")
add("scan_jsonl_quarantine", """SELECT CASE doc_id % 6 WHEN 0 THEN '{"business_description": "' || replace(text, chr(10), ' ') ELSE 'not json' END AS line, count(*) AS n
FROM documents WHERE doc_id % 6 IN (0, 5) GROUP BY 1""")
_BLANK_LINES = "SELECT ' ' || chr(9) || ' ' AS t FROM documents WHERE doc_id % 6 = 3"
_RAW = {"lines": f"SELECT {_LINE} AS t FROM documents UNION ALL {_BLANK_LINES}"}
_ALIASED = {"lines": f"{_RAW['lines']} UNION ALL SELECT text FROM documents WHERE doc_id % 6 = 4"}
for _name, _steps in [("scan_jsonl_alias", _ALIASED), ("scan_jsonl_strict", _RAW)]:
    add(_name, "SELECT md5(t) AS text_md5, length(t) AS text_chars FROM lines", **_steps)
add("scan_versions", f"""SELECT model_version, md5(business_description) AS text_md5,
  CASE WHEN entry_id % 9 > 0 THEN {joined('target_domains')} ELSE '' END AS domains FROM v_outputs""")
add("scan_training", """SELECT source, count(*) AS n_rows, count(*) FILTER (source IN ('original', 'paraphrase', 'gibberish')) AS n_labelled
FROM (SELECT CASE WHEN doc_id % 11 > 0 THEN source ELSE 'unknown' END AS source FROM v_training) GROUP BY 1""")
add("line_positions", "SELECT row_number() OVER (ORDER BY doc_id) AS position, doc_id || ':' || md5(text) AS line FROM documents")
add("results_round_trip", f"SELECT md5(business_description) AS text_md5, {joined('target_domains')} AS domains FROM v_outputs")

# --- streams -------------------------------------------------------------------------------

add("stream_dedup", f"SELECT DISTINCT sha256({_KEY}) AS text_key FROM documents")
add("stream_dedup_watermark", f"SELECT DISTINCT sha256(lower({trim("coalesce(business_description, '')")})) AS text_key FROM v_requests")

_KIND = f"CASE WHEN text IS NULL THEN 'keyless' WHEN {trim('text')} = '' THEN 'empty' ELSE 'good' END"
add("scan_jsonl_counts", """SELECT folder, """ + ", ".join(f"CAST(count(*) FILTER (kind = '{k}') AS BIGINT) AS {k}" for k in ("blank", "malformed", "keyless", "empty", "good"))
    + """, (SELECT count(*) FROM k WHERE kind = 'good') AS good_everywhere FROM k GROUP BY folder""",
    k=f"""SELECT doc_id % 4 AS folder, {_KIND} AS kind FROM documents UNION ALL
SELECT doc_id % 4, CASE doc_id % 6 WHEN 1 THEN 'blank' WHEN 2 THEN 'keyless' WHEN 3 THEN 'empty' WHEN 4 THEN 'keyless' ELSE 'malformed' END FROM documents""")
_LATE_KEY = f"sha256(lower({trim("coalesce(p || business_description, '')")}))"
add("stream_dedup_late", f"""SELECT DISTINCT {_LATE_KEY} AS text_key, p = 'late ' AS late FROM v_requests, (SELECT unnest(['', 'late ', 'in time ']) AS p)
WHERE p = '' OR business_description IS NOT NULL""")
_ASKED = f"md5({fill(V.CHAT_PROMPT, text='text')})"
add("stream_answers", f"""SELECT event_id, CASE WHEN event_id % 9 NOT IN (0, 6) THEN 'quarantine' WHEN event_id % 9 = 0 AND gate = 'pass' AND {_ASKED} LIKE '0%' THEN 'failures' ELSE 'answers' END AS route,
  CASE WHEN event_id % 9 IN (2, 4, 7) THEN 400 WHEN event_id % 9 > 0 OR gate = 'error' OR (gate = 'pass' AND {_ASKED} LIKE '0%') THEN 500 ELSE 200 END::BIGINT AS http_code
FROM g""", **_GATE)
