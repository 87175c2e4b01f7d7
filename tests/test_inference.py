from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from brandsieve.functions.candidates import keyword_fallback
from brandsieve.functions.text import text_key
from brandsieve.operators import answer_table as answer_table_module
from brandsieve.operators.answer_table import answer_table, with_answers
from brandsieve.operators.inference import add_model_output, load_stub, predict_stub
from brandsieve.operators.training import add_tokens
from brandsieve.plans.generation import generate
from brandsieve.streaming.requests import read_request_stream
from brandsieve.streaming.serving import ROUTES, read_routed, serve


def test_failures_stay_in_their_row(spark):
    def predict(model, prompts, *, suffix):
        if "bad" in prompts:
            raise RuntimeError("refused")
        return [p + suffix for p in prompts]

    df = spark.createDataFrame([("a",), ("bad",), (None,), ("b",)], "p string").coalesce(1)
    got = add_model_output(df, "p", load=load_stub, predict=predict, options={"suffix": "!"}).collect()
    assert [(r["response"], r["error"]) for r in got] == [("a!", None), (None, "refused"), (None, None), ("b!", None)]


def test_short_answers_are_errors(spark):
    df = spark.createDataFrame([("a",), ("b",)], "p string").coalesce(1)
    got = add_model_output(df, "p", load=load_stub, predict=lambda m, prompts: [])
    assert {r["error"] for r in got.collect()} == {"0 answers for 1 prompts"}


def test_hook_as_tokenizer(spark):
    df = spark.createDataFrame([("to be",)], "p string")
    ids = add_model_output(df, "p", load=load_stub, predict=lambda m, prompts: [[ord(c) for c in p] for p in prompts], out_col="ids", out_type="array<int>")
    assert add_tokens(ids, F.col("ids"), max_length=3).first()["input_ids"] == [116, 111, 32]


def test_whole_job(spark):
    def predict(model, prompts):
        if any("breaks" in p for p in prompts):
            raise RuntimeError("down")
        return ["1. brew.com\n2. sexbrew.com" for _ in prompts]

    texts = ["Organic coffee shop", "This one breaks it", "adult shop", "{code}", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = generate(df, "t", load=load_stub, predict=predict).orderBy("i").collect()
    assert [r["status"] for r in got] == ["success", "error", "blocked", "filtered", "error"]
    assert got[0]["target_domains"] == ["brew.com", "domain3.com"]
    assert (got[1]["target_domains"], got[1]["message"]) == ([], "Internal server error")
    assert got[1]["error"] == "down" and got[2]["error"] is None


def test_prompts_are_asked_once_and_again_until_valid(spark, tmp_path):
    log = tmp_path / "calls"

    def predict(model, prompts, *, attempt, mark):
        with log.open("a") as f:
            f.writelines(f"{attempt}{p}\n" for p in prompts)
        if "down" in prompts:
            raise RuntimeError("down")
        return [p + mark if attempt >= len(p) else None for p in prompts]

    def check(df):
        return df.withColumn("valid", F.col("answer").endswith("!"))

    rows = [(i, p) for i, p in enumerate(["a", "a", "bb", "cccc", None, "a"])]
    df = spark.createDataFrame(rows, "i int, p string")
    asked = answer_table(df, "p", load=load_stub, predict=predict, check=check, attempts=3, options={"mark": "!"})
    got = {r["i"]: r for r in with_answers(df, "p", asked, spread_by="i").collect()}
    assert len(got) == len(rows) and asked.count() == 3
    assert [(got[i]["answer"], got[i]["valid"], got[i]["attempts"]) for i in (0, 1, 2, 3, 4)] == [
        ("a!", True, 1), ("a!", True, 1), ("bb!", True, 2), (None, False, 3), (None, None, None),
    ]
    calls = log.read_text().split()
    assert calls.count("1a") == 1 and "2a" not in calls and calls.count("3cccc") == 1 and "3bb" not in calls
    down = answer_table(spark.createDataFrame([("down",)], "p string"), "p", load=load_stub, predict=predict, check=check, options={"mark": "!"})
    assert [tuple(r)[1:] for r in down.collect()] == [(None, "down", False, 3)]
    none = answer_table(df.limit(0), "p", load=load_stub, predict=predict, check=check, options={"mark": "!"})
    assert none.count() == 0


def test_long_prompts_are_not_sorted(spark, monkeypatch):
    """Of 30,000 prompts of 2,000 characters, each of them twice, only digests and numbers are grouped."""
    prompt = F.concat(F.repeat(F.lit("p"), 2000), (F.col("id") % 15_000).cast("string"))
    df = spark.range(0, 30_000, 1, 2).select("id", prompt.alias("p"))
    plans, write = [], DataFrameWriter.parquet

    def seen(writer, path, *args, **kwargs):
        plans.append(writer._df._jdf.queryExecution().executedPlan().toString())
        return write(writer, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", seen)

    def check(rows):
        return rows.withColumn("valid", F.col("answer").isNotNull())

    for limit in (answer_table_module.BROADCAST_BYTES, 0):
        monkeypatch.setattr(answer_table_module, "BROADCAST_BYTES", limit)
        asked = answer_table(df, "p", load=load_stub, predict=lambda model, prompts, attempt: prompts, check=check)
        assert asked.count() == 15_000 == asked.where(text_key(F.col("answer")) == F.col("prompt_key")).count()
    assert len(plans) == 4 and not any("Sort" in p for p in plans)
    assert "BroadcastHashJoin" in plans[1] and "ShuffledHashJoin" in plans[3]


def test_failed_generator_can_fall_back(spark):
    df = spark.createDataFrame([("Organic coffee",)], "t string")
    assert df.select(keyword_fallback(F.col("t"))).first()[0] == ["organic.com", "coffee.co", "startup2.com"]
    one, other = predict_stub(None, ["x" * 500 + "a", "x" * 500 + "b"])
    assert one != other and [n.rsplit(".")[-1] for n in one.split("\n")] == ["com", "io", "ai"]


def test_served_batches_run_again_add_nothing(spark, tmp_path):
    def predict(model, prompts):
        if any("breaks" in p for p in prompts):
            raise RuntimeError("down")
        return ["brew.com" for _ in prompts]

    bodies = ['{"business_description": "Organic coffee shop"}', '{"business_description": "This one breaks it"}', "{broken", "{}", None]
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for half in (bodies[:3], bodies[3:]):
        spark.createDataFrame([(b,) for b in half], "body string").write.mode("append").json(source)
        for again in (False, True):
            if again:  # as after a crash between the writes of a batch and its commit
                last = max((tmp_path / "mark" / "commits").glob("[0-9]*"), key=lambda f: int(f.name))
                last.unlink()
                (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
            arriving = read_request_stream(spark, source, "body string")
            serve(arriving, "body", out, mark, load=load_stub, predict=predict, once=True).awaitTermination()
    rows = {route: read_routed(spark, out, route).collect() for route in ROUTES}
    assert {route: len(r) for route, r in rows.items()} == {"answers": 1, "failures": 1, "quarantine": 3}
    assert rows["answers"][0]["status"] == "success" and rows["failures"][0]["error"] == "down"
    assert sorted(r["http_code"] for r in rows["quarantine"]) == [400, 500, 500]
