"""Merkle manifest, line removal and phrase mining: direct versions, odd rows, hot keys."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from brandsieve.llm import line_dedup, merkle, phrases

SF = "/root/testdata/sf0.001"
LONG = "word " * 100_000 + "\n" + "line\n" * 500
ROWS = [
    (1, "plain text of a few words\nsecond line", "en", "a", 25),
    (1, "plain text of a few words\nsecond line", "en", "a", 25),
    (2, "", "en", "a", 0),
    (3, None, None, None, None),
    (None, "no id\n\n Second LINE\t", "en", None, 28),
    (4, LONG, "en", "b", len(LONG)),
    (5, " \t\n ", "de", "b", 4),
    (6, "Ünïcödé 中文   text\nSECOND line", "de", "\U0001f600", 18),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("row", "position", "h1", "h2", "slot", "keep", "low", "line", "tree", "node", "rank", "size", "place", "part",
            "leaf", "steps", "block", "offered", "phrase", "words", "n", "f", "key", "doc")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(f"x{c}") for c in CLASHING})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- Merkle manifest ---


def slow_levels(nodes):
    """All levels of a tree, from the leaves to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def slow_proof(levels, at):
    steps = []
    for nodes in levels[:-1]:
        first = at - at % 3
        steps.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + 3])))
        at //= 3
    return steps


@pytest.mark.parametrize("n", [1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 82, 200])
def test_appended_witnesses(n):
    nodes = [sha(str(i)) for i in range(n)]
    levels = slow_levels(nodes)
    tree = merkle.Appender()
    steps = [tree.append(node) for node in nodes]
    assert tree.close() == levels[-1][0]
    assert steps == [slow_proof(levels, i) for i in range(n)]
    assert all(merkle.folded(node, own) == levels[-1][0] for node, own in zip(nodes, steps))


def slow_leaf(doc_id, source, lang, n_chars, text):
    values = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
    return sha("".join(values))


def slow_manifest(rows):
    """Sorted result rows, and the rows' leaves in order."""
    by_source = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        leaf = slow_leaf(doc_id, source, lang, n_chars, text)
        offered = leaf
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
            offered = slow_leaf(doc_id, source, lang, n_chars, text and text.replace("\n", ""))
        by_source[source].append((doc_id is not None, doc_id or 0, leaf, offered, doc_id))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = [slow_levels([x[2] for x in sorted(by_source[s])]) for s in order]
    top = slow_levels([t[-1][0] for t in trees])
    out = []
    for k, (source, tree) in enumerate(zip(order, trees)):
        for at, (_, _, leaf, offered, doc_id) in enumerate(sorted(by_source[source])):
            steps = slow_proof(tree, at) + slow_proof(top, k)
            root = merkle.folded(offered, steps)
            proof = sha("".join(a + b for a, b in steps))
            out.append((doc_id, leaf, tree[-1][0], top[-1][0], proof, root, root == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("levels", [1, 2, merkle.BLOCK_LEVELS])
def test_manifest(spark, docs, levels):
    report = merkle.manifest_report(docs, levels=levels)
    got = sorted(map(tuple, report.collect()), key=repr)
    assert got == slow_manifest(ROWS) and len(got) == len(ROWS)
    assert not all(r[-1] for r in got) and any(r[-1] for r in got)
    assert merkle.manifest_report(docs.limit(0)).count() == 0


def test_manifest_over_blocks(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    hot = table.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")))
    rows = [tuple(r) for r in hot.collect()]
    got = sorted(map(tuple, merkle.manifest_report(hot, levels=2).collect()), key=repr)
    assert got == slow_manifest(rows)


def test_inclusion_proofs(docs):
    rows = merkle.inclusion_proofs(docs, levels=1).collect()
    assert len(rows) == len(ROWS)
    for row in rows:
        assert merkle.folded(row["leaf"], [(s["left"], s["right"]) for s in row["steps"]]) == row["root"]


# --- lines ---


def slow_lines(texts, min_docs, keep_first=False):
    """(n_lines, n_dropped, kept text) of each text."""
    def key(line):
        stripped = line.strip(" \t\n\x0b\x0c\r")
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in stripped)

    split = [(t or "").split("\n") for t in texts]
    found = Counter(k for lines in split for k in {key(x) for x in lines} if k)
    seen, out = set(), []
    for lines in split:
        kept = []
        for line in lines:
            k = key(line)
            first = keep_first and k not in seen
            seen.add(k)
            if found[k] < min_docs or first:
                kept.append(line)
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_line_report(docs):
    for least in (2, 3, 4, 9):
        wanted = sorted((r[0] or 0, n, d, sha(t)) for r, (n, d, t) in zip(ROWS, slow_lines([r[1] for r in ROWS], least)))
        got = sorted((r[0] or 0, *r[1:]) for r in line_dedup.line_report(docs, least).collect())
        assert got == wanted
    assert line_dedup.line_report(docs.limit(0)).count() == 0
    assert line_dedup.keep_bitmaps(docs.limit(0)).count() == 0


@pytest.mark.parametrize("keep_first", [False, True])
def test_lines_of_hot_keys_and_long_runs(spark, tmp_path, monkeypatch, keep_first):
    monkeypatch.setattr(line_dedup, "_SAMPLE", 1.0)  # small tables: look at all lines for hot ones
    rng = random.Random(3)
    texts = []
    for _ in range(400):
        lines = [rng.choice(["hot", " HOT\t", "warm", f"own {rng.random()}", "", "É", "é"]) for _ in range(rng.randint(0, 30))]
        texts.append("\n".join(lines) if rng.random() < 0.95 else None)
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "docs"))
    table = spark.read.parquet(str(tmp_path / "docs"))
    bitmaps = line_dedup.keep_bitmaps(table, 10, keep_first)
    got = {r["doc_id"]: r["text"] for r in line_dedup.without_lines(table, bitmaps).collect()}
    for (i, text), (_, dropped, kept) in zip(rows, slow_lines(texts, 10, keep_first)):
        assert got[i] == (kept if dropped else text)


def test_lines_move_without_text_and_meet_in_ranges(spark):
    found = line_dedup.lines(spark.read.parquet(f"{SF}/documents.parquet")).checkpoint()
    plan = line_dedup.dropped_lines(found)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and "Exchange hashpartitioning" not in plan
    assert "Python" not in plan and "text" not in plan


# --- phrases ---


def slow_phrases(rows, least, top=2000):
    totals, f = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            f.update((lang, *words[i : i + n]) for n in range(1, 6) for i in range(len(words) - n + 1))
    frequent = {p: n for p, n in f.items() if n >= least}
    inside = set()
    for p, n in frequent.items():
        lang, *words = p
        for i in range(len(words)):
            for j in range(i + 2, len(words) + 1):
                part = (lang, *words[i:j])
                if j - i < len(words) and frequent[part] <= n:
                    inside.add(part)
    out = defaultdict(list)
    for p, a in frequent.items():
        lang, *words = p
        if len(words) < 2 or p in inside:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = f[(lang, *words[:k])], f[(lang, *words[k:])]
            cuts.append((1000 * a * totals[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out[lang].append((-score, -a, " ".join(words).encode(), left, right))
    result = []
    for lang, found in out.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            result.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(result)


def some_texts(n, seed):
    """Texts of few words with fixed runs among them, so that long phrases are frequent too."""
    rng = random.Random(seed)
    words = ["a", "b", "c", "d", "E", "éÉ", "x y", "w" * 50]
    runs = ["a b c d E", "c d E a b c d", "x y b. a b", "éÉ  \t b c\nb c d", "a a a a a a"]
    for _ in range(n):
        text = " ".join(rng.choice(words if rng.random() < 0.6 else runs) + rng.choice(["", "", ",", "!", " "]) for _ in range(rng.randint(0, 40)))
        yield rng.choice(["en", "en", "en", "de", None, "und"]), text if rng.random() < 0.95 else None


@pytest.mark.parametrize(("sample", "chunk"), [(1 / 8, 8 << 20), (0.0, 300), (1.0, 2000), (0.02, 64)])
def test_phrases(spark, monkeypatch, sample, chunk):
    """Whatever the sample proposes, nothing (then each pass fails) or all, the counts are the same."""
    monkeypatch.setattr(phrases, "_CHUNK", chunk)
    rows = list(some_texts(400, 8))
    table = spark.createDataFrame(rows, "lang string, text string")
    got = sorted(map(tuple, phrases.collocations(table, min_count=20, top=30, sample=sample, bits=1 << 15).collect()))
    assert got == slow_phrases(rows, 20, 30) and len(got) > 20


def test_phrases_with_a_filter_that_is_nearly_full(spark):
    rows = list(some_texts(300, 9))
    table = spark.createDataFrame(rows, "lang string, text string")
    got = sorted(map(tuple, phrases.collocations(table, min_count=5, bits=64).collect()))
    assert got == slow_phrases(rows, 5)


def test_phrases_of_odd_rows(docs):
    found = {(r["lang"], r["phrase"]): r["f"] for r in phrases.frequent_phrases(docs, 3).collect()}
    assert found["en", "word word word word word"] == 100_000 - 4 and found["en", ""] == 100_000 + 500 + 16 + 4
    assert found["und", ""] == 0 and found["de", ""] == 5
    assert found["en", "second line"] == 3 and ("en", "few words") not in found
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_exact_beyond_64_bits(spark, monkeypatch):
    big = 3_000_000_000_000
    counts = [("en", 0, "", 5 * big), ("en", 1, "x", big), ("en", 1, "y", big - 7), ("en", 2, "x y", big - 9)]
    table = spark.createDataFrame(counts, "lang string, words byte, phrase string, f long")
    monkeypatch.setattr(phrases, "frequent_phrases", lambda *_, **__: table)
    row = phrases.collocations(table).first()
    assert row["score"] == 1000 * (big - 9) * 5 * big // (big * (big - 7))


def test_filter():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 1 << 64, 5000, np.uint64)
    bits = np.zeros(1 << 13, np.uint8)
    for at in phrases._places(hashes[:1000], 8 * len(bits)):
        np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(int), (1 << (at & np.uint64(7))).astype(np.uint8))
    held = phrases._holds(bits, hashes)
    assert held[:1000].all() and held[1000:].mean() < 0.02


def test_a_hot_lang_is_cut_slot_by_slot_before_it_meets(spark):
    plan = phrases.collocations(spark.createDataFrame([("en", "a b")], "lang string, text string"))
    plan = plan._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [row_number()") == 2 and "hashpartitioning(lang#" in plan and ", slot#" in plan
