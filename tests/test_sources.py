import json
import random

import pytest
from pyspark.sql import functions as F

from brandsieve.operators import dedup, row_marks
from brandsieve.session import shared_folder
from brandsieve.sources import digest_index, json_lines, requests, sinks
from brandsieve.streaming.dedup import distinct_texts, first_and_late
from brandsieve.streaming.requests import append_to, read_request_stream


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_descriptions(spark, tmp_path):
    path = write(
        tmp_path / "d.jsonl", '{"business_description": " a "}', "", "broken", '{"business_description": "x"', '{"description": "b"}',
        '{"business_description": null}', '{"business_description": "  "}', "[1]", '{"business_description": "c"} tail',
    )
    texts = lambda df: [r[0] for r in df.collect()]
    assert texts(json_lines.read_descriptions(spark, path)) == ["a"]
    assert texts(json_lines.read_descriptions_or_alias(spark, path)) == [" a ", "b", "  "]
    assert texts(json_lines.read_descriptions_strict(spark, path)) == [" a ", "  "]
    lines = json_lines.read_lines(spark, path, json_lines.DESCRIPTION)
    bad = json_lines.quarantined(lines)
    assert bad.count() == 4 and json_lines.readable(lines).count() == 4
    assert {r["line"] for r in bad.collect()} == {"broken", '{"business_description": "x"', "[1]", '{"business_description": "c"} tail'}


def test_outputs_keep_good_lines_of_a_bad_file(spark, tmp_path):
    path = write(tmp_path / "o.jsonl", '{"business_description": "a", "target_domains": ["x.com"], "error": "e"}', "oops", "{}")
    got = json_lines.read_outputs(spark, path).collect()
    assert [(r[0], r[1]) for r in got] == [("a", ["x.com"]), ("", [])]


def test_versions(spark, tmp_path):
    path = write(tmp_path / "v0.jsonl", '{"business_description": "a", "target_domains": []}')
    got = json_lines.read_versions(spark, {"v0": path, "v1": str(tmp_path / "absent.jsonl")}).collect()
    assert [r["model_version"] for r in got] == ["v0"]
    with pytest.raises(FileNotFoundError):
        json_lines.read_versions(spark, {"v1": str(tmp_path / "absent.jsonl")})


def test_line_numbers_over_files_and_splits(spark, tmp_path):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for name, start, n in [("a.txt", 0, 5000), ("b.txt", 5000, 20000), ("c.txt", 25000, 10)]:
        write(tmp_path / name, *[f"line {i}" for i in range(start, start + n)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = json_lines.read_numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 25010
    assert all(r["line"] == f"line {r['position'] - 1}" for r in got)


def test_append_adds_each_text_once(spark, tmp_path):
    path = str(tmp_path / "set")
    spark.createDataFrame([("Old one",)], "business_description string").write.json(path)
    batch = spark.createDataFrame([(1, " old ONE"), (2, "New"), (3, "new "), (4, "Other")], "id long, business_description string")
    assert dedup.append_counts(batch, json_lines.read_descriptions(spark, path), "business_description", "id").first() == (2, 2)
    for _ in range(2):
        sinks.append_new(batch, path, "business_description", "id")
        assert sorted(r[0] for r in json_lines.read_descriptions(spark, path).collect()) == ["New", "Old one", "Other"]


def test_hot_text_collapses_before_the_shuffle(spark):
    rows = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, "Same Text").otherwise(F.concat(F.lit("t"), "id")).alias("t"))
    kept = dedup.first_occurrence(rows, "t", "id")
    assert kept.count() == 6001 and kept.where("t = 'Same Text'").first()["id"] == 0
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = dedup.first_occurrence(rows, "t", "id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "LeftAnti" in plan and "Exchange hashpartitioning" not in plan and "Window" not in plan


@pytest.mark.parametrize("group_bytes", [row_marks.GROUP_BYTES, 100])
def test_duplicates_go_without_moving_text(spark, tmp_path, monkeypatch, group_bytes):
    """By bitmaps of places, in one group of files or many; repeated and null ids too."""
    monkeypatch.setattr(row_marks.without_places, "__defaults__", (group_bytes,))
    rows = [(i % 900 if i % 50 else None, f"text {i % 700}" if i % 3 else "Hot") for i in range(2000)]
    table = spark.createDataFrame(rows, "id long, t string").repartition(5)
    table.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    kept = dedup.first_occurrence(docs, "t", "id")
    got = [(r["id"], r["t"].lower()) for r in kept.collect()]
    first = {}
    for i, t in rows:
        if i is not None:
            first[t.lower()] = min(i, first.get(t.lower(), i))
    assert sorted(g for g in got if g[0] is not None) == sorted((i, t) for t, i in first.items())
    assert sum(g[0] is None for g in got) == sum(i is None for i, _ in rows)
    new = dedup.new_rows(docs, spark.createDataFrame([("HOT ",), ("text 1",)], "t string"), "t", "id")
    assert sorted((r["id"], r["t"].lower()) for r in new.where("id IS NOT NULL").collect()) == sorted(
        (i, t) for t, i in first.items() if t not in ("hot", "text 1")
    )
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for df in (kept, new):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_places_of_files_with_many_rows(spark, tmp_path):
    spark.range(100_000).coalesce(1).write.parquet(str(tmp_path / "a"))
    spark.range(100_000, 100_010).coalesce(1).write.mode("append").parquet(str(tmp_path / "a"))
    docs = spark.read.parquet(str(tmp_path / "a"))
    gone = F.col("id").isin([0, 63, 64, 99_999, 100_009]) | ((F.col("id") > 5000) & (F.col("id") < 70_000))
    places = docs.where(gone).select(*row_marks.place_columns())
    left = row_marks.without_places(docs, places.unionByName(places))
    assert left.exceptAll(docs.where(~gone)).isEmpty() and left.count() == docs.where(~gone).count()
    assert row_marks.bitmaps(places).count() == 2
    assert row_marks.without_places(docs, places.limit(0)).count() == 100_010


def test_append_reads_digests_and_not_old_texts(spark, tmp_path):
    path = tmp_path / "set"
    batches = [["Old one", "old ONE ", "B"], ["b", "C"], ["c", "old one", "D"]]
    for n, texts in enumerate(batches):
        batch = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, business_description string")
        sinks.append_new(batch, str(path), "business_description", "id")
        if n == 0:  # from now on, reading the old texts would show
            for old in path.glob("*.json"):
                old.write_text("")
                (path / f".{old.name}.crc").unlink(missing_ok=True)
    texts = lambda: sorted(r[0] for r in json_lines.read_descriptions(spark, str(path)).collect())
    assert texts() == ["C", "D"]
    known = digest_index.known_keys(spark, str(path), "business_description")
    assert known.distinct().count() == 4
    plan = known.distinct()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # bucketed

    digest_index._drop(spark, f"{path}/_digests")  # a lost index is built from the texts that are there
    again = spark.createDataFrame([(1, "c"), (2, "B"), (3, "d")], "id long, business_description string")
    sinks.append_new(again, str(path), "business_description", "id")
    assert texts() == ["B", "C", "D"]
    (next(p for p in path.glob("*.json") if "B" in p.read_text())).unlink()  # so is one that lists a lost file
    sinks.append_new(again, str(path), "business_description", "id")
    assert texts() == ["B", "C", "D"]
    write(path / "more.json", '{"business_description": "E"}')  # files of other writers are taken in
    sinks.append_new(spark.createDataFrame([(1, "e"), (2, "f")], "id long, business_description string"), str(path), "business_description", "id")
    assert texts() == ["B", "C", "D", "E", "f"]


def test_append_creates_a_missing_set_and_skips_broken_lines(spark, tmp_path):
    path = str(tmp_path / "set")
    batch = spark.createDataFrame([(1, "A"), (2, "a "), (3, "")], "id long, business_description string")
    sinks.append_new(batch, path, "business_description", "id")
    assert sorted(r[0] for r in spark.read.json(path).collect()) == ["", "A"]
    other = str(tmp_path / "other")
    spark.createDataFrame([('{"business_description": "A"}',), ("broken",)], "value string").write.text(other)
    sinks.append_new(batch, other, "business_description", "id")
    assert sorted(r[0] for r in json_lines.read_outputs(spark, other).select("business_description").collect()) == ["", "A"]


def test_only_a_missing_path_counts_as_missing(spark, tmp_path):
    assert not json_lines.path_exists(spark, str(tmp_path / "none"))
    with pytest.raises(Exception):
        json_lines.path_exists(spark, "nosuchscheme://x/y")


def test_late_rows_are_dropped_by_bounded_state_only(spark, tmp_path):
    with pytest.raises(ValueError, match="keep_for"):
        distinct_texts(spark.createDataFrame([("a",)], "t string"), "t", time_col="t")
    found = {}
    for name, options in {"bounded": {"time_col": "ts", "keep_for": "1 hour"}, "whole": {}}.items():
        source, out, mark = (str(tmp_path / name / n) for n in ("in", "out", "mark"))
        (tmp_path / name / "in").mkdir(parents=True)
        for number, (text, ts) in enumerate([("new", "2024-01-10T00:00:00"), ("on time", "2024-01-10T00:30:00"), ("late", "2024-01-08T00:00:00")]):
            (tmp_path / name / "in" / f"{number}.json").write_text(json.dumps({"t": text, "ts": ts}))
            arriving = read_request_stream(spark, source, "t string, ts timestamp")
            append_to(distinct_texts(arriving, "t", **options), out, mark, once=True).awaitTermination()
        found[name] = sorted(r["t"] for r in spark.read.parquet(out).collect())
    assert found == {"bounded": ["new", "on time"], "whole": ["late", "new", "on time"]}


def test_request_forms(spark):
    df = spark.createDataFrame(
        [('{"business_description": "a b"}', "http://h/generate?business_description=a%20b+c&x=1"), ("{", "http://h/generate"), ("{}", "no url %")],
        "body string, url string",
    )
    got = df.select(requests.body_text(F.col("body")), requests.body_failure(F.col("body"))["http_code"], requests.query_text(F.col("url"))).collect()
    assert [tuple(r) for r in got] == [("a b", None, "a b c"), ("", 500, ""), ("", 400, "")]


def test_tokens_reload_the_named_or_first_split(spark, tmp_path):
    path = str(tmp_path / "tok")
    tokens = spark.createDataFrame([([1, 2], [1, 1], [1, 2])], "input_ids array<int>, attention_mask array<int>, labels array<int>")
    sinks.write_tokens(tokens, path, split="train", max_seq_length=200)
    tokens.withColumn("split", F.lit("extra")).write.mode("append").partitionBy("split").parquet(f"{path}/data")
    assert sinks.read_tokens(spark, path).count() == 1 and sinks.read_tokens(spark, path, split="train").count() == 1
    assert sinks.read_metadata(spark, path, "total_examples bigint, max_seq_length bigint").first() == (1, 200)


def test_stream_dedup_across_restarts(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for batch in (["A", "a ", "b"], ["B", "c"]):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{batch[0]}.json").write_text("\n".join(json.dumps({"t": t}) for t in batch))
        arriving = read_request_stream(spark, source, "t string")
        append_to(distinct_texts(arriving, "t"), out, mark, once=True).awaitTermination()
    assert sorted(r["t"].strip().lower() for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


class FakeSession:
    def __init__(self, master, folder=None):
        self.conf = {"spark.checkpoint.dir": folder}
        self.sparkContext = type("Context", (), {"master": master, "applicationId": f"{master}-app"})


def test_shared_folder_follows_the_session():
    assert shared_folder(FakeSession("k8s://x", "s3a://bucket/work")) == "s3a://bucket/work"
    local = FakeSession("local[2]")
    assert shared_folder(local) == shared_folder(local)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(FakeSession("k8s://x"))


def test_counted_reads(spark, tmp_path):
    one = write(tmp_path / "a.jsonl", '{"business_description": "a"}', "", "broken", '{"other": 1}', '{"business_description": " "}', "[1]")
    write(tmp_path / "b.jsonl", '{"business_description": null}', '{"business_description": "b"}', "   ")
    lines = json_lines.classified_lines(spark, str(tmp_path), json_lines.DESCRIPTION, "business_description")
    counts = {r["file_path"].rsplit("/")[-1]: tuple(r[k] for k in json_lines.KINDS) for r in json_lines.line_counts(lines).collect()}
    assert counts == {"a.jsonl": (1, 2, 1, 1, 1), "b.jsonl": (1, 0, 1, 0, 1)}
    rows, seen = json_lines.read_counted(spark, str(tmp_path), json_lines.DESCRIPTION, "business_description")
    assert sorted(map(tuple, rows.collect())) == [("a",), ("b",)]
    assert json_lines.warn_of_skipped(seen, one) == {"blank": 2, "malformed": 2, "keyless": 2, "empty": 1, "good": 2}


def test_late_new_texts_are_kept_apart_over_a_restart(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    (tmp_path / "in").mkdir()
    parts = [
        [("old", "2024-01-10T00:00:00", "2024-01-10T00:00:00"), ("Old ", "2024-01-09T23:59:00", "2024-01-10T00:00:01"), ("no time", None, None)],
        [("late new", "2024-01-01T00:00:00", "2024-01-10T00:30:00"), ("OLD", "2024-01-01T00:00:00", "2024-01-10T00:30:00"), ("new", "2024-01-10T00:30:00", "2024-01-10T00:30:00")],
        [("far", "2024-02-01T00:00:00", "2024-02-01T00:00:00")],
        [("old", "2024-01-10T00:00:00", "2024-02-02T00:00:00"), ("far", "2024-02-01T00:00:00", "2024-02-02T00:00:00")],
    ]
    for number, rows in enumerate(parts):
        lines = [json.dumps({"t": t, "ts": ts, "at": at}) for t, ts, at in rows]
        write(tmp_path / "in" / f"{number}.json", *lines)
        arriving = read_request_stream(spark, source, "t string, ts timestamp, at timestamp")
        found = first_and_late(arriving, "t", time_col="ts", arrival_col="at", keep_for_seconds=3 * 86_400)
        append_to(found.select("t", "late"), out, mark, once=True).awaitTermination()
    got = sorted((r["t"], r["late"]) for r in spark.read.parquet(out).collect())
    # "old" was forgotten in the meantime: it comes again, marked
    assert got == [("Old ", False), ("far", False), ("late new", True), ("new", False), ("no time", False), ("old", True)]


def test_texts_share_the_states_of_few_buckets(spark, tmp_path):
    """Days of random texts against a dictionary of texts; a state is that of a bucket, not of a text."""
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    (tmp_path / "in").mkdir()
    rng, last, wanted, states = random.Random(3), {}, [], []
    for day in range(1, 6):
        rows = []
        for _ in range(60):
            age = rng.choice([0, 0, 1, 5, None])
            time = None if age is None else f"2024-01-{10 + day - age:02d}T00:00:{rng.randrange(60):02d}"
            rows.append({"t": rng.choice(["Text ", "text"]) + str(rng.randrange(80)), "ts": time, "at": f"2024-01-{10 + day}T00:00:00"})
        rows += [{"t": None, "ts": None, "at": f"2024-01-{10 + day}T00:00:00"}]
        first = {}
        for number, row in enumerate(rows):
            key = (row["t"] or "").lower()
            late = row["ts"] is not None and row["ts"] < f"2024-01-{9 + day:02d}T00:00:00"
            first[key] = min(first.get(key, (True, "9")), (late, row["ts"] or "9", number, row["t"]))
        for key, (late, time, _, text) in first.items():
            if day - last.get(key, -9) > 2:  # not known: the clock is a day and an hour behind, a text is kept for a day
                wanted.append((day, text or "", time, late))
            last[key] = day
        write(tmp_path / "in" / f"{day}.json", *map(json.dumps, rows))
        arriving = read_request_stream(spark, source, "t string, ts timestamp, at timestamp")
        found = first_and_late(arriving, "t", time_col="ts", arrival_col="at", keep_for_seconds=86_400, buckets=8)
        run = append_to(found.withColumn("day", F.lit(day)), out, mark, once=True)
        run.awaitTermination()
        states += [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]
    got = spark.read.parquet(out).collect()
    assert sorted((r["day"], r["t"] or "", r["ts"].isoformat() if r["ts"] else "9", r["late"]) for r in got) == sorted(wanted)
    assert any(r["late"] for r in got) and len(got) > 100 and 0 < max(states) <= 8
