"""The registered queries. Each reads whole tables (or what Spark derives from them) and returns a DataFrame."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brandsieve import fixed_values as V
from brandsieve.functions import candidates as C
from brandsieve.functions import prompts, verdicts
from brandsieve.functions.confidence import factors, suggestions, tld_score, total, word_sets
from brandsieve.functions.gibberish import add_gibberish_rules, add_gibberish_score, drop_low_quality, is_gibberish, low_quality
from brandsieve.functions.text import preview, trim_ws
from brandsieve.functions.unsafe import add_blocklist_check, add_keyword_check, censored, safe_domains
from brandsieve.operators import dedup, evaluation, sampling, screening, training
from brandsieve.operators.answer_table import answer_table, with_answers
from brandsieve.operators.classifier import add_prediction, train_classifier
from brandsieve.operators.inference import add_model_output, load_stub, predict_stub
from brandsieve.plans import views
from brandsieve.plans.generation import generate
from brandsieve.plans.model_evaluation import evaluate
from brandsieve.plans.views import table
from brandsieve.session import new_path
from brandsieve.sources import json_lines, reports, requests, sinks
from brandsieve.streaming.dedup import distinct_texts, first_and_late
from brandsieve.streaming.requests import append_to, read_request_stream, score_requests
from brandsieve.streaming.serving import serve

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def _joined(names: Column) -> Column:
    return F.array_join(names, "|")


def _digest(text: Column, name: str) -> list[Column]:
    """A long text as its md5 and length."""
    return [F.md5(text).alias(f"{name}_md5"), F.char_length(text).cast("bigint").alias(f"{name}_chars")]


# --- gibberish -----------------------------------------------------------------------------


def _scored(df: DataFrame, key: str, text: str) -> DataFrame:
    scored = add_gibberish_score(df, text)
    return scored.select(
        key,
        F.col("score_tenths").cast("bigint").alias("score_tenths"),
        is_gibberish(F.col("score_tenths")).alias("is_gibberish"),
    )


@query
def gibberish_score(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(table(spark, sf, "documents"), "doc_id", "text")


@query
def gibberish_score_noisy(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(views.noisy(spark, sf), "doc_id", "text")


@query
def gibberish_score_html(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(table(spark, sf, "pages"), "page_id", "html")


@query
def gibberish_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Documents per rule that fires."""
    flagged = add_gibberish_rules(views.noisy(spark, sf), "text")
    names = [c for c in flagged.columns if c.startswith("rule_")]
    return flagged.groupBy("lang").agg(*[F.count_if(F.col(c)).alias(c) for c in names])


@query
def gibberish_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    scored = add_gibberish_score(table(spark, sf, "documents"), "text")
    return scored.groupBy("lang", is_gibberish(F.col("score_tenths")).alias("is_gibberish")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars")
    )


@query
def gibberish_filter(spark: SparkSession, sf: str) -> DataFrame:
    kept = screening.only_legitimate(table(spark, sf, "conversations"), "text")
    return kept.select("conv_id", "turn", *_digest(F.col("text"), "text"))


@query
def low_quality_output(spark: SparkSession, sf: str) -> DataFrame:
    found = views.responses(spark, sf).withColumn("domains", C.extract_v2(F.col("response")))
    return found.select(
        "entry_id",
        low_quality(F.col("domains")).alias("is_low_quality"),
        _joined(drop_low_quality(F.col("domains"))).alias("domains"),
    )


# --- unsafe content ------------------------------------------------------------------------


@query
def nsfw_keyword(spark: SparkSession, sf: str) -> DataFrame:
    checked = add_keyword_check(views.unsafe_texts(spark, sf), "text")
    return checked.select("doc_id", "unsafe.is_unsafe", "unsafe.reason", "unsafe.method", "unsafe.category", "unsafe.detected_keyword")


@query
def nsfw_blocklist(spark: SparkSession, sf: str) -> DataFrame:
    checked = add_blocklist_check(views.unsafe_texts(spark, sf), "text")
    return checked.select("doc_id", "unsafe.is_unsafe", "unsafe.reason", "unsafe.method")


@query
def nsfw_blocklist_table(spark: SparkSession, sf: str) -> DataFrame:
    terms = spark.createDataFrame([(t,) for t in V.BLOCKLIST], "term string")
    found = screening.match_blocklist(views.unsafe_texts(spark, sf), "text", "doc_id", terms)
    return found.select("doc_id", "n_terms", "first_term")


@query
def nsfw_censor(spark: SparkSession, sf: str) -> DataFrame:
    text = censored(trim_ws(F.col("text")))
    return views.unsafe_texts(spark, sf).select("doc_id", *_digest(text, "censored"))


@query
def nsfw_candidate_filter(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("domain")
    offered = F.array(d, F.concat(F.lit("Sex"), d), F.concat(F.lit("adult"), d), F.concat(F.lit("my"), d))
    offered = F.when(F.col("entry_id") % 5 == 0, F.array(F.concat(F.lit("kkk"), d))).otherwise(offered)
    return views.candidates(spark, sf).select("entry_id", _joined(safe_domains(offered)).alias("domains"))


# --- candidates ----------------------------------------------------------------------------


def _extract(version: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        found = views.responses(spark, sf).withColumn("domains", C.EXTRACTORS[version](F.col("response")))
        return found.select(
            "entry_id", _joined(F.col("domains")).alias("domains"), C.shortfall(F.col("domains")).alias("is_short")
        )

    return run


for _version in C.EXTRACTORS:
    QUERIES[f"extract_{_version}"] = _extract(_version)


@query
def domain_valid(spark: SparkSession, sf: str) -> DataFrame:
    host = F.try_parse_url("url", F.lit("HOST"))
    return table(spark, sf, "pages").select(
        "page_id",
        host.alias("host"),
        C.valid_domain(host).alias("host_valid"),
        C.valid_domain(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).alias("site_valid"),
    )


@query
def keyword_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", _joined(C.keyword_fallback(F.col("text"), 5)).alias("domains")
    )


@query
def strip_prompt(spark: SparkSession, sf: str) -> DataFrame:
    prompt = prompts.chat_prompt(F.col("description"))
    echoed = F.concat(prompt, F.lit("\n"), F.col("response"))
    return views.responses(spark, sf).select(
        "entry_id",
        C.strip_prompt(echoed, prompt).alias("answer"),
        C.assistant_section(echoed).alias("section"),
    )


@query
def joined_pieces(spark: SparkSession, sf: str) -> DataFrame:
    pieces = F.split("response", "(?<=o)")
    return views.responses(spark, sf).select("entry_id", C.join_pieces(pieces).alias("answer"))


# --- confidence ----------------------------------------------------------------------------


@query
def confidence_factors(spark: SparkSession, sf: str) -> DataFrame:
    scored = (
        views.candidates(spark, sf)
        .withColumn("sets", word_sets(F.col("description")))
        .withColumn("f", factors(F.col("domain"), F.col("sets")))
    )
    names = list(V.CONFIDENCE_WEIGHTS)
    return scored.select(
        "entry_id",
        *[F.col(f"f.{n}").cast("bigint").alias(n) for n in names],
        total(F.col("f")).cast("bigint").alias("total"),
    )


def _ranked(df: DataFrame) -> DataFrame:
    # The outer form: posexplode alone adds a filter on its input, which would score every row again.
    return df.select("entry_id", F.posexplode_outer("s").alias("p", "s")).where(F.col("p").isNotNull()).select(
        "entry_id",
        (F.col("p") + 1).cast("bigint").alias("rank"),
        F.col("s.domain").alias("domain"),
        F.round(F.col("s.confidence") * 1000).cast("bigint").alias("confidence_milli"),
    )


@query
def confidence_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Suggestions of each answer, best first; ranked inside the row, so no shuffle."""
    found = views.responses(spark, sf).withColumn("domains", C.extract_v4(F.col("response")))
    return _ranked(found.withColumn("s", suggestions(F.col("domains"), F.col("description"))))


@query
def confidence_long_text(spark: SparkSession, sf: str) -> DataFrame:
    """Relevance against whole documents."""
    docs = table(spark, sf, "documents").withColumn("domains", C.keyword_fallback(F.col("text"), 3))
    return _ranked(docs.select(F.col("doc_id").alias("entry_id"), suggestions(F.col("domains"), F.col("text")).alias("s")))


@query
def tld_quality(spark: SparkSession, sf: str) -> DataFrame:
    ending = F.lower(F.substring_index("domain", ".", -1))
    return (
        views.candidates(spark, sf)
        .groupBy(ending.alias("tld"))
        .agg(F.count(F.lit(1)).alias("n"), F.max(tld_score(F.col("domain"))).cast("bigint").alias("score"))
    )


# --- routing -------------------------------------------------------------------------------


def _answer(text: Column) -> Column:
    """A native stand-in for a model's answer."""
    return F.array_join(C.keyword_fallback(F.coalesce(text, F.lit("")), 3), "\n")


def _statuses(df: DataFrame) -> DataFrame:
    return df.select(
        "event_id",
        "status",
        F.coalesce("message", F.lit("")).alias("message"),
        F.col("http_code").cast("bigint").alias("http_code"),
        _joined(F.transform("suggestions", lambda s: s["domain"])).alias("domains"),
        F.round(F.get("suggestions", F.lit(0))["confidence"] * 1000).cast("bigint").alias("best_milli"),
    )


@query
def response_status(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("business_description")
    return _statuses(score_requests(views.requests(spark, sf), "business_description", _answer(text)))


@query
def output_status(spark: SparkSession, sf: str) -> DataFrame:
    """Status of stored outputs."""
    answered = screening.add_response(views.outputs(spark, sf), "business_description")
    return answered.groupBy("model_version", "status", F.coalesce("message", F.lit("")).alias("message")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("suggestions")).alias("n_suggestions")
    )


@query
def document_gate(spark: SparkSession, sf: str) -> DataFrame:
    gated = screening.add_gate(views.unsafe_texts(spark, sf), "text")
    return gated.groupBy("gate").agg(F.count(F.lit(1)).alias("n"))


@query
def request_intake(spark: SparkSession, sf: str) -> DataFrame:
    """The same text by JSON body and by query string, plus bodies that are not requests."""
    text = F.col("business_description")
    body = F.when(F.col("event_id") % 6 == 5, F.lit("{broken")).otherwise(F.to_json(F.struct(text)))
    url = F.concat(
        F.lit("http://host/generate?v=1&business_description="), F.url_encode(F.coalesce(text, F.lit("")))
    )
    return views.requests(spark, sf).select(
        "event_id",
        requests.body_text(body).alias("from_body"),
        requests.query_text(url).alias("from_query"),
        requests.body_failure(body).isNull().alias("is_request"),
    )


@query
def request_failures(spark: SparkSession, sf: str) -> DataFrame:
    """Answers to bodies of all kinds, requests and others."""
    asked = _bodies(spark, sf).withColumn("text", requests.body_text(F.col("body")))
    answered = score_requests(asked, "text", _answer(F.col("text")), invalid=requests.body_failure(F.col("body")))
    return answered.select(
        "event_id", "status", F.coalesce("message", F.lit("")).alias("message"), F.col("http_code").cast("bigint").alias("http_code")
    )


def _bodies(spark: SparkSession, sf: str) -> DataFrame:
    """event_id and body: every request in a form that is one, or in one of eight that are not."""
    text = F.col("business_description")
    whole = F.to_json(F.struct(F.coalesce(text, F.lit("")).alias(requests.FIELD)))
    body = views.by_remainder(
        F.col("event_id"),
        [
            whole, F.concat(F.lit("{broken "), whole), F.lit(" { } "), F.concat(F.lit("["), whole, F.lit("]")), F.lit("null"),
            F.lit(None).cast("string"), F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("other"))), F.lit("0"), F.lit("12"),
        ],
    )
    return views.requests(spark, sf).select("event_id", body.alias("body"))


# --- evaluation ----------------------------------------------------------------------------


def _truth(spark: SparkSession, sf: str) -> DataFrame:
    known = views.entries(spark, sf).where(F.col("gt_category").isNotNull())
    return evaluation.truth_table(known, "business_description", F.col("gt_category"), "entry_id")


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate(views.outputs(spark, sf), _truth(spark, sf), fallback=F.col("positional_category"))


def _compared(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.compare(evaluation.summarize(_rows(spark, sf)))


@query
def truth_table(spark: SparkSession, sf: str) -> DataFrame:
    return _truth(spark, sf).groupBy("truth_category").agg(F.count(F.lit(1)).alias("n"))


@query
def gt_lookup(spark: SparkSession, sf: str) -> DataFrame:
    found = evaluation.add_category(
        views.outputs(spark, sf), _truth(spark, sf), "business_description", "entry_id",
        fallback=F.col("positional_category"),
    )
    return found.select("model_version", "entry_id", "category")


@query
def positional_category(spark: SparkSession, sf: str) -> DataFrame:
    place = F.col("doc_id") % 100 + 1
    return table(spark, sf, "documents").select("doc_id", evaluation.positional_category(place).alias("category"))


@query
def model_correct(spark: SparkSession, sf: str) -> DataFrame:
    rows = evaluation.evaluation_rows(
        evaluation.add_capabilities(
            evaluation.add_category(
                views.outputs(spark, sf), _truth(spark, sf), "business_description", "entry_id",
                fallback=F.col("positional_category"),
            )
        )
    )
    return rows.groupBy("model_version", "category", "model_correct").agg(F.count(F.lit(1)).alias("n"))


@query
def evaluation_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(spark, sf).select(
        "model_version",
        "entry_id",
        preview(F.col("business_description"), 60).alias("preview"),
        _joined(F.col("target_domains")).alias("generated_domains"),
        "category",
        "classification",
        "model_correct",
        "agrees_with_dataset",
        "domain_quality_score",
        "parse_ok",
    )


@query
def eval_summary(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.summarize(_rows(spark, sf))


@query
def model_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return _compared(spark, sf).withColumn("complexity", F.col("complexity").cast("bigint"))


@query
def summary_table(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.display_table(_compared(spark, sf))


@query
def chart_series(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.chart_series(_compared(spark, sf))


@query
def versions_side_by_side(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.side_by_side(_compared(spark, sf), "overall_accuracy", list(V.CAPABILITIES))


@query
def success_rate(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.success_rate(views.outputs(spark, sf), by="model_version")


@query
def generation_stats(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.generation_stats(views.outputs(spark, sf), by="model_version")


@query
def source_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.source_breakdown(table(spark, sf, "documents"))


# --- verdicts ------------------------------------------------------------------------------


@query
def verdict_parse(spark: SparkSession, sf: str) -> DataFrame:
    read = verdicts.add_verdict(views.verdicts(spark, sf), "verdict")
    return read.select(
        "doc_id", "parse_ok", "classification", "agrees_with_dataset",
        F.size("domain_scores").cast("bigint").alias("n_scores"),
    )


@query
def quality_rollup(spark: SparkSession, sf: str) -> DataFrame:
    read = verdicts.add_verdict(views.verdicts(spark, sf), "verdict")
    return read.select("doc_id", "domain_quality_score")


@query
def verdict_validate(spark: SparkSession, sf: str) -> DataFrame:
    read = verdicts.add_single_verdict(views.ratings(spark, sf), "rating_text")
    return read.select("entry_id", "valid", F.col("rating.score").alias("score"), F.col("rating.reasons.clarity").alias("clarity"))


@query
def verdict_list(spark: SparkSession, sf: str) -> DataFrame:
    read = verdicts.add_list_verdict(views.ratings(spark, sf), "list_text")
    return read.select("entry_id", "valid", F.explode_outer("ratings").alias("r")).select(
        "entry_id", "valid", F.col("r.domain").alias("domain"), F.col("r.score").alias("score")
    )


@query
def verdict_requeue(spark: SparkSession, sf: str) -> DataFrame:
    """One single-domain prompt per domain of every list verdict that is not valid."""
    read = verdicts.add_list_verdict(views.ratings(spark, sf), "list_text")
    again = read.where(~F.col("valid")).select("entry_id", "description", F.explode("domains").alias("domain"))
    return again.select(
        "entry_id", "domain", F.md5(prompts.single_judge_prompt(F.col("description"), F.col("domain"))).alias("prompt_md5")
    )


def _judge_stub(model: None, asked: list[str], *, attempt: int) -> list[str]:
    """Fails as often as the last two bits of the prompt's first digit say, then rates."""
    keys = [hashlib.md5(p.encode()).hexdigest() for p in asked]
    reasons = ", ".join(f'"{c}": 0.5' for c in V.CRITERIA)
    return [
        f'{{"domain": "x", "score": 0.{int(k[1], 16) % 10}, "reasons": {{{reasons}}}}}' if attempt > int(k[0], 16) % 4 else "no verdict"
        for k in keys
    ]


def _asked_again(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A prompt for every domain of every invalid list verdict, and the table of answers."""
    read = verdicts.add_list_verdict(views.ratings(spark, sf), "list_text")
    again = read.where(~F.col("valid")).select("entry_id", "description", F.explode("domains").alias("domain"))
    again = again.withColumn("prompt", prompts.single_judge_prompt(F.col("description"), F.col("domain"))).drop("description")
    check = partial(verdicts.add_single_verdict, verdict_col="answer")
    return again, answer_table(again, "prompt", load=load_stub, predict=_judge_stub, check=check)


@query
def verdict_answers(spark: SparkSession, sf: str) -> DataFrame:
    """What the judge says of each domain that is asked again, within three attempts."""
    again, answers = _asked_again(spark, sf)
    rated = verdicts.add_single_verdict(with_answers(again, "prompt", answers, spread_by="entry_id"), "answer")
    return rated.select(
        "entry_id", "domain", "valid", F.col("attempts").cast("bigint").alias("attempts"), F.col("rating.score").alias("score")
    )


@query
def verdict_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Calls of the judge: distinct prompts only, and those without a valid answer again."""
    again, answers = _asked_again(spark, sf)
    wanted = again.agg(F.count("*").alias("n")).scalar()
    return answers.groupBy("attempts", "valid").agg(F.count("*").alias("prompts"), F.sum("attempts").alias("calls")).select(
        F.col("attempts").cast("bigint").alias("attempts"), "valid", "prompts", "calls", wanted.alias("prompts_wanted")
    )


# --- deduplication -------------------------------------------------------------------------


def _old_and_new(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Documents of the sources already held, and those of the sources offered now."""
    docs = table(spark, sf, "documents")
    return docs.where(F.col("source") < "src4"), docs.where(F.col("source") >= "src4")


@query
def first_occurrence(spark: SparkSession, sf: str) -> DataFrame:
    kept = dedup.first_occurrence(table(spark, sf, "documents"), "text", "doc_id")
    return kept.select("doc_id", "lang", "n_chars")


@query
def dedup_append(spark: SparkSession, sf: str) -> DataFrame:
    held, offered = _old_and_new(spark, sf)
    return dedup.new_rows(offered, held, "text", "doc_id").select("doc_id", *_digest(F.col("text"), "text"))


@query
def append_counts(spark: SparkSession, sf: str) -> DataFrame:
    held, offered = _old_and_new(spark, sf)
    return dedup.append_counts(offered, held, "text", "doc_id")


# --- prompts -------------------------------------------------------------------------------


@query
def prompt_instruction(spark: SparkSession, sf: str) -> DataFrame:
    return views.candidates(spark, sf).select(
        "entry_id", prompts.instruction_prompt(F.col("description"), 3).alias("prompt")
    )


@query
def prompt_chat(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", *_digest(prompts.chat_prompt(F.col("text")), "prompt"))


@query
def prompt_train(spark: SparkSession, sf: str) -> DataFrame:
    prompt = prompts.training_prompt(F.col("business_description"), F.col("target_domains"))
    return views.training(spark, sf).select("doc_id", *_digest(prompt, "prompt"))


@query
def prompt_judge(spark: SparkSession, sf: str) -> DataFrame:
    prompt = prompts.judge_prompt(F.col("business_description"), F.col("target_domains"), F.col("positional_category"))
    return views.outputs(spark, sf).select("model_version", "entry_id", *_digest(prompt, "prompt"))


@query
def prompt_judge_single(spark: SparkSession, sf: str) -> DataFrame:
    return views.candidates(spark, sf).select(
        "entry_id", prompts.single_judge_prompt(F.col("description"), F.col("domain")).alias("prompt")
    )


@query
def prompt_judge_list(spark: SparkSession, sf: str) -> DataFrame:
    return views.ratings(spark, sf).select(
        "entry_id", prompts.list_judge_prompt(F.col("description"), F.col("domains")).alias("prompt")
    )


# --- training data -------------------------------------------------------------------------


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return training.labelled(views.training(spark, sf))


@query
def label_map(spark: SparkSession, sf: str) -> DataFrame:
    return _labelled(spark, sf).groupBy("source", F.col("label").cast("bigint").alias("label")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def class_balance(spark: SparkSession, sf: str) -> DataFrame:
    return training.label_counts(_labelled(spark, sf))


@query
def class_balance_after(spark: SparkSession, sf: str) -> DataFrame:
    return training.label_counts(training.balance(_labelled(spark, sf), "doc_id"))


@query
def balance_classes(spark: SparkSession, sf: str) -> DataFrame:
    return training.balance(_labelled(spark, sf), "doc_id").select("doc_id", F.col("label").cast("bigint").alias("label"))


@query
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return training.split_by_hash(_labelled(spark, sf), "doc_id").select("doc_id", "split")


@query
def stratified_split_exact(spark: SparkSession, sf: str) -> DataFrame:
    return training.split_exact(_labelled(spark, sf), "doc_id").select("doc_id", "split")


@query
def random_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A tenth of the documents, of exact size, by seeded hash."""
    docs = table(spark, sf, "documents")
    return sampling.take_sample(docs, "doc_id", docs.count() // 10).select("doc_id", "lang")


@query
def shuffled_order(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.shuffled(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")


@query
def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    return training.class_weights(_labelled(spark, sf)).withColumn("label", F.col("label").cast("bigint"))


@query
def class_weight_column(spark: SparkSession, sf: str) -> DataFrame:
    return training.add_class_weight(_labelled(spark, sf)).select("doc_id", "weight")


def _predicted(spark: SparkSession, sf: str) -> DataFrame:
    """The gibberish rules as a classifier of the quality label."""
    docs = add_gibberish_score(table(spark, sf, "documents"), "text")
    predicted = docs.select("doc_id", F.when(is_gibberish(F.col("score_tenths")), 0).otherwise(1).alias("prediction"))
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return labels.join(predicted, "doc_id").select("label", "prediction")


@query
def confusion_counts(spark: SparkSession, sf: str) -> DataFrame:
    counts = training.confusion(_predicted(spark, sf))
    return counts.select(F.col("label").cast("bigint").alias("label"), F.col("prediction").cast("bigint").alias("prediction"), "n")


@query
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return training.confusion_matrix(_predicted(spark, sf)).withColumn("label", F.col("label").cast("bigint"))


@query
def classification_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return training.classification_metrics(_predicted(spark, sf))


def _tokens(spark: SparkSession, sf: str, max_length: int = 200) -> DataFrame:
    items = views.training(spark, sf)
    prompt = prompts.training_prompt(F.col("business_description"), F.col("target_domains"))
    return training.add_tokens(items, training.token_ids(prompt, max_length), max_length=max_length).select(
        "doc_id", "input_ids", "attention_mask", "labels"
    )


@query
def token_prepare(spark: SparkSession, sf: str) -> DataFrame:
    return _tokens(spark, sf).select(
        "doc_id",
        F.array_join(F.col("input_ids").cast("array<string>"), ",").alias("input_ids"),
        F.size("attention_mask").cast("bigint").alias("mask_size"),
        (F.col("labels") == F.col("input_ids")).alias("labels_match"),
    )


@query
def token_truncate_classifier(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    tokens = training.add_tokens(docs, training.token_ids(F.col("text"), 128), max_length=128)
    return tokens.select("doc_id", F.md5(F.array_join(F.col("input_ids").cast("array<string>"), ",")).alias("ids_md5"))


@query
def token_profile(spark: SparkSession, sf: str) -> DataFrame:
    return training.token_profile(_tokens(spark, sf))


@query
def pad_bucket(spark: SparkSession, sf: str) -> DataFrame:
    padded = training.pad_tokens(_tokens(spark, sf))
    return padded.select(
        "doc_id",
        F.col("bucket").cast("bigint").alias("bucket"),
        F.size("input_ids").cast("bigint").alias("n_ids"),
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("bigint").alias("n_real"),
        F.size(F.filter("labels", lambda x: x == -100)).cast("bigint").alias("n_ignored"),
    )


@query
def token_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Size, padding and members of every padded batch."""
    batches = training.token_batches(_tokens(spark, sf), "doc_id", max_tokens=2048, slot_rows=100)
    widths = F.transform("labels", lambda x: F.size(x))
    return batches.select(
        *[F.col(c).cast("bigint").alias(c) for c in ("bucket", "slot", "batch", "n_tokens")],
        F.size("ids").cast("bigint").alias("n_rows"),
        F.aggregate("input_ids", F.lit(0), lambda a, x: a + F.size(x)).cast("bigint").alias("n_padded"),
        (F.array_min(widths) == F.array_max(widths)).alias("one_width"),
        F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"),
    )


@query
def eval_subset(spark: SparkSession, sf: str) -> DataFrame:
    return training.eval_subset(views.training(spark, sf).select("doc_id", "source"), "doc_id")


@query
def eval_subset_disjoint(spark: SparkSession, sf: str) -> DataFrame:
    return training.eval_subset(views.training(spark, sf).select("doc_id", "source"), "doc_id", disjoint=True)


@query
def head_projection(spark: SparkSession, sf: str) -> DataFrame:
    first = sampling.head(views.training(spark, sf), "doc_id", 10)
    return first.select(
        "doc_id", *_digest(F.col("business_description"), "text"), _joined(F.col("target_domains")).alias("target_domains"), "source"
    )


@query
def dataset_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return training.dataset_metadata(_labelled(spark, sf), max_seq_length=200, model_name="hashed-words").withColumn(
        "max_seq_length", F.col("max_seq_length").cast("bigint")
    )


@query
def classifier_predict(spark: SparkSession, sf: str) -> DataFrame:
    """Balance, split exactly, weigh the train labels, fit, predict the test split.

    Fitted weights can't be reproduced in SQL; the rows, the labels and what must hold of any
    prediction can. How good the fit is, tests/test_classifier.py asserts on unseen texts.
    """
    rows = training.split_exact(training.balance(_labelled(spark, sf), "doc_id"), "doc_id")
    train = training.add_class_weight(rows.where(F.col("split") == "train"))
    model = train_classifier(train, "business_description")
    scored = add_prediction(rows.where(F.col("split") == "test"), model, "business_description")
    gibberish, legitimate = F.col("result.probabilities.gibberish"), F.col("result.probabilities.legitimate")
    return scored.select(
        "doc_id",
        F.col("label").cast("bigint").alias("label"),
        (F.abs(gibberish + legitimate - 1) < 1e-9).alias("sums_to_one"),
        (F.col("result.confidence") == F.greatest(gibberish, legitimate)).alias("confidence_is_larger"),
        ((F.col("result.label") == "legitimate") == F.col("result.is_legitimate")).alias("label_agrees"),
        (F.col("result.is_legitimate") == (legitimate >= gibberish)).alias("likelier_wins"),
    )


# --- inference -----------------------------------------------------------------------------


def _predict_or_fail(model, texts: list[str], **options) -> list[str]:
    if any("widget" in t for t in texts):
        raise ValueError("no answer")
    return predict_stub(model, texts, **options)


@query
def model_inference(spark: SparkSession, sf: str) -> DataFrame:
    """The hook with a stub that fails for some rows; those get the keyword fallback."""
    asked = add_model_output(
        views.candidates(spark, sf), "description", load=load_stub, predict=_predict_or_fail,
        options={"endings": (".com", ".io")},
    )
    named = F.when(F.col("error").isNull(), C.extract_v1(F.col("response"))).otherwise(
        C.keyword_fallback(F.col("description"))
    )
    return asked.select("entry_id", F.coalesce("error", F.lit("")).alias("error"), _joined(named).alias("domains"))


@query
def batch_generation(spark: SparkSession, sf: str) -> DataFrame:
    """Screen, ask the stub, parse and answer, for every request."""
    done = generate(
        views.requests(spark, sf), "business_description", load=load_stub, predict=predict_stub,
    )
    return done.select(
        "event_id", "gate", "status", _joined(F.col("target_domains")).alias("domains"),
        F.col("http_code").cast("bigint").alias("http_code"),
    )


# --- sources and sinks ---------------------------------------------------------------------


def _description_lines(spark: SparkSession, sf: str, folders: int = 0) -> str:
    """Every document as a JSON line, with blank, broken, keyless, aliased and whitespace-only lines between them;
    in folders by id, if wanted."""
    doc_id, text = F.col("doc_id"), F.col("text")
    path = new_path(spark, "descriptions")
    own = F.when(doc_id % 2 == 0, F.concat(F.lit("  "), text)).otherwise(text)
    between = views.by_remainder(
        doc_id,
        [
            F.concat(F.lit('{"business_description": "'), F.replace(text, F.lit("\n"), F.lit(" "))),
            F.lit("   "),
            F.lit('{"other": 1}'),
            F.lit('{"business_description": " \\t "}'),
            F.to_json(F.struct(text.alias("description"))),
            F.lit("not json"),
        ],
    )
    lines = F.array(F.to_json(F.struct(own.alias("business_description"))), between)
    docs = table(spark, sf, "documents")
    if folders:
        docs.select((doc_id % folders).alias("folder"), F.explode(lines)).write.partitionBy("folder").text(path)
    else:
        docs.select(F.explode(lines)).write.text(path)
    return path


@query
def scan_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    rows = json_lines.read_descriptions(spark, _description_lines(spark, sf))
    return rows.select(*_digest(F.col("business_description"), "text"))


@query
def scan_jsonl_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    lines = json_lines.read_lines(spark, _description_lines(spark, sf), json_lines.DESCRIPTION)
    return json_lines.quarantined(lines).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query
def scan_jsonl_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of each kind in each folder, and the good ones that a counted read gives."""
    path = _description_lines(spark, sf, folders=4)
    lines = json_lines.classified_lines(spark, path, json_lines.DESCRIPTION, "business_description")
    counts = json_lines.line_counts(lines).withColumn(
        "folder", F.regexp_extract("file_path", r"folder=(\d+)", 1).cast("bigint")
    )
    rows, seen = json_lines.read_counted(spark, path, json_lines.DESCRIPTION, "business_description")
    rows.write.format("noop").mode("overwrite").save()
    good = json_lines.warn_of_skipped(seen, path)["good"]
    sums = [F.sum(k).alias(k) for k in json_lines.KINDS]
    return counts.groupBy("folder").agg(*sums).withColumn("good_everywhere", F.lit(good).cast("bigint"))


@query
def scan_jsonl_alias(spark: SparkSession, sf: str) -> DataFrame:
    rows = json_lines.read_descriptions_or_alias(spark, _description_lines(spark, sf))
    return rows.select(*_digest(F.col("business_description"), "text"))


@query
def scan_jsonl_strict(spark: SparkSession, sf: str) -> DataFrame:
    rows = json_lines.read_descriptions_strict(spark, _description_lines(spark, sf))
    return rows.select(*_digest(F.col("business_description"), "text"))


def _version_files(spark: SparkSession, sf: str) -> dict[str, str]:
    """One JSON Lines file set per version, and a path that does not exist."""
    root = new_path(spark, "outputs")
    rows = views.outputs(spark, sf).select(
        "model_version",
        "business_description",
        F.when(F.col("entry_id") % 9 > 0, F.col("target_domains")).alias("target_domains"),
    )
    rows.write.partitionBy("model_version").json(root)
    return {v: f"{root}/model_version={v}" for v in [*V.CAPABILITIES, "v9"]}


@query
def scan_versions(spark: SparkSession, sf: str) -> DataFrame:
    rows = json_lines.read_versions(spark, _version_files(spark, sf))
    return rows.select(
        "model_version", F.md5("business_description").alias("text_md5"), _joined(F.col("target_domains")).alias("domains")
    )


@query
def scan_training(spark: SparkSession, sf: str) -> DataFrame:
    """Training lines read twice: with labels, and with the source default for an overview."""
    path = new_path(spark, "training")
    rows = views.training(spark, sf).withColumn("source", F.when(F.col("doc_id") % 11 > 0, F.col("source")))
    sinks.write_results(rows.drop("doc_id"), path)
    known = json_lines.read_labelled(spark, path).groupBy("source").agg(F.count(F.lit(1)).alias("n_labelled"))
    every = json_lines.read_training(spark, path).groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"))
    return every.join(known, "source", "left").select("source", "n_rows", F.coalesce("n_labelled", F.lit(0)).alias("n_labelled"))


@query
def line_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Position of each line in a text written in id order."""
    path = new_path(spark, "lines")
    lines = table(spark, sf, "documents").select("doc_id", F.concat_ws(":", "doc_id", F.md5("text")).alias("line"))
    lines.orderBy("doc_id").select("line").write.text(path)
    return json_lines.read_numbered_lines(spark, path).select("position", "line")


@query
def report_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation reports written as nested documents and read back per version."""
    path = new_path(spark, "report")
    rows = _rows(spark, sf).select(
        "model_version", "entry_id", "target_domains", "category", "model_correct", "agrees_with_dataset", "domain_quality_score"
    )
    # Both parts of the report come from one written table, so the joins run once.
    table_path = f"{path}/evaluated"
    rows.write.parquet(table_path)
    rows = spark.read.parquet(table_path)
    sinks.write_report(rows, evaluation.summarize(rows), path)
    found = reports.read_reports(spark, {v: f"{path}/summary/version={v}" for v in [*V.CAPABILITIES, "v9"]})
    return found.withColumn("report", F.concat(sinks.report_name(F.concat(F.lit("out/names_"), "model_version", F.lit(".jsonl"))), F.lit(".json")))


@query
def results_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "results")
    rows = views.outputs(spark, sf).select("business_description", "target_domains")
    sinks.write_results(rows, path)
    back = json_lines.read_outputs(spark, path)
    return back.select(F.md5("business_description").alias("text_md5"), _joined(F.col("target_domains")).alias("domains"))


@query
def append_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Held documents written, new ones appended in three batches by id, the grown files read back."""
    path = new_path(spark, "append")
    held, offered = _old_and_new(spark, sf)
    sinks.write_results(held.select(F.col("text").alias("business_description")), path)
    last = offered.agg(F.max("doc_id")).first()[0] or 0
    for third in range(3):
        some = offered.where(F.floor(F.col("doc_id") * 3 / (last + 1)) == third)
        batch = some.select("doc_id", F.col("text").alias("business_description"))
        sinks.append_new(batch, path, "business_description", "doc_id")
    return json_lines.read_outputs(spark, path).select(F.md5("business_description").alias("text_md5"))


@query
def tokens_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "tokens")
    sinks.write_tokens(_tokens(spark, sf), path, max_seq_length=200, model_name="hashed-words")
    back = sinks.read_tokens(spark, path)
    meta = sinks.read_metadata(spark, path, "total_examples bigint, max_seq_length bigint, model_name string")
    size = meta.select("total_examples").scalar()
    return back.select("doc_id", F.size("input_ids").cast("bigint").alias("n_ids"), size.alias("total_examples"))


# --- streams -------------------------------------------------------------------------------


@query
def stream_score(spark: SparkSession, sf: str) -> DataFrame:
    """Requests from a stream of JSON files, answered by the batch functions."""
    root = new_path(spark, "stream-score")
    views.requests(spark, sf).write.json(f"{root}/in")
    arriving = read_request_stream(spark, f"{root}/in", "event_id bigint, ts timestamp, business_description string")
    answered = _statuses(score_requests(arriving, "business_description", _answer(F.col("business_description"))))
    append_to(answered, f"{root}/out", f"{root}/checkpoint", once=True).awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct document texts from a stream."""
    root = new_path(spark, "stream-dedup")
    schema = table(spark, sf, "documents").schema.simpleString()[len("struct<") : -1].replace(":", " ")
    arriving = read_request_stream(spark, f"{sf}/documents.parquet*", schema, fmt="parquet")
    distinct = distinct_texts(arriving.select("doc_id", "text"), "text").select("text_key")
    append_to(distinct, f"{root}/out", f"{root}/checkpoint", once=True).awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query
def stream_dedup_watermark(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct request texts of a stream with event times, with bounded state."""
    root = new_path(spark, "stream-watermark")
    views.requests(spark, sf).write.json(f"{root}/in")
    arriving = read_request_stream(spark, f"{root}/in", "event_id bigint, ts timestamp, business_description string")
    distinct = distinct_texts(arriving, "business_description", time_col="ts", keep_for="10000 days").select("text_key")
    append_to(distinct, f"{root}/out", f"{root}/checkpoint", once=True).awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query
def stream_dedup_late(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct request texts of a stream; after a restart come a late copy of an old text, a late
    new text and a new one in time."""
    root = new_path(spark, "stream-late")
    schema = "event_id bigint, ts timestamp, business_description string, arrived timestamp"
    text, ts = F.col("business_description"), F.col("ts")
    first = views.requests(spark, sf).withColumn("arrived", ts)
    early, arrived = ts - F.expr("INTERVAL 30000 DAYS"), ts + F.expr("INTERVAL 400 DAYS")
    again = first.withColumns({"ts": early, "arrived": arrived, "business_description": F.upper(text)})
    late = first.withColumns({"ts": early, "arrived": arrived, "business_description": F.concat(F.lit("late "), text)})
    in_time = first.withColumns({"arrived": arrived, "business_description": F.concat(F.lit("in time "), text)})
    for rows in (first, again.unionByName(late).unionByName(in_time)):
        rows.write.mode("append").json(f"{root}/in")
        arriving = read_request_stream(spark, f"{root}/in", schema)
        distinct = first_and_late(
            arriving, "business_description", time_col="ts", arrival_col="arrived", keep_for_seconds=20_000 * 86_400
        ).select("text_key", "late")
        append_to(distinct, f"{root}/out", f"{root}/checkpoint", once=True).awaitTermination()
    return spark.read.parquet(f"{root}/out")


def _predict_or_break_down(model: None, asked: list[str]) -> list[str]:
    """The stub, which breaks down at a sixteenth of the prompts."""
    if any(hashlib.md5(p.encode()).hexdigest()[0] == "0" for p in asked):
        raise RuntimeError("down")
    return predict_stub(model, asked)


@query
def stream_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies of all kinds from a stream through gates and model to answers, failures and quarantine."""
    root = new_path(spark, "stream-answers")
    _bodies(spark, sf).write.json(f"{root}/in")
    arriving = read_request_stream(spark, f"{root}/in", "event_id bigint, body string")
    serve(arriving, "body", f"{root}/out", f"{root}/checkpoint", load=load_stub, predict=_predict_or_break_down, once=True).awaitTermination()
    return spark.read.parquet(f"{root}/out").select("event_id", "route", F.col("http_code").cast("bigint").alias("http_code"))
