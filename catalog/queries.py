"""One query per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import views as V
from respeval import constants as C
from respeval.functions import flags, tails
from respeval.functions.extraction import extract_response
from respeval.operators import (
    attempts,
    calibration,
    compare,
    matching,
    metrics,
    normalize,
    profile,
    report,
    roc,
    sampling,
)
from respeval.operators import prompts as prompting
from respeval.plans.analysis import analyse, write_report
from respeval.plans.experiment import collect_results, score_results
from respeval.plans.incremental import refresh_cells, report_of_cells
from respeval.session import work_dir
from respeval.sources import packed, questions, responses, results
from respeval.streaming import attempts as attempt_stream
from respeval.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
MODEL_ARM = ("model", "arm")
DIGITS = 9


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show."""
    doubles = {name for name, kind in df.dtypes if kind == "double"}
    return df.select(
        *[F.round(c, digits).alias(c) if c in doubles else F.col(c) for c in df.columns]
    )


# --- extraction and flags ---------------------------------------------------


@query
def response_extract(spark, sf_dir):
    return V.eval_results(spark, sf_dir).select(
        "item_id", "model", "arm", "predicted_index", "predicted_text", "confidence",
        "reasoning", "evidence_quality", "parse_error",
    )


@query
def response_extract_fallback(spark, sf_dir):
    return (
        V.eval_results(spark, sf_dir)
        .where("parse_error")
        .select("item_id", "model", "arm", "confidence")
    )


@query
def phrase_flags(spark, sf_dir):
    text = F.col("text")
    return V.table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        flags.mentions(text, C.ABSTAIN_IN_ANSWER).alias("abstains"),
        flags.mentions(text, ("eau", "tion")).alias("mentions_any"),
    )


@query
def response_flags(spark, sf_dir):
    return V.eval_scored(spark, sf_dir).select(
        "item_id", "model", "arm", "dataset", "confidence_valid", "is_correct", "is_cautious",
        "is_unsafe", "flagged_suspicious",
    )


# --- aggregations -----------------------------------------------------------


@query
def group_metrics(spark, sf_dir):
    return rounded(metrics.group_metrics(V.eval_scored(spark, sf_dir)))


@query
def overall_parse_rate(spark, sf_dir):
    parsed = extract_response(V.eval_responses(spark, sf_dir), only=["parse_error"])
    return rounded(metrics.parse_success(parsed))


@query
def grid_keys(spark, sf_dir):
    return metrics.distinct_keys(V.eval_responses(spark, sf_dir))


# --- two-arm comparison ------------------------------------------------------


def _line_arms(spark, sf_dir) -> DataFrame:
    return compare.arm_summary(
        V.table(spark, sf_dir, "lineitem"),
        ["l_returnflag"],
        {"discounted": F.col("l_discount") >= F.lit(0.05)},
        F.col("l_quantity"),
        arm_col="l_linestatus",
        baseline="O",
        treated="F",
    )


def _event_arms(spark, sf_dir) -> DataFrame:
    return compare.arm_summary(
        V.table(spark, sf_dir, "events").withColumn("hour", F.hour("ts")),
        ["hour"],
        {"large": F.col("value") >= F.lit(50.0)},
        F.col("value"),
        arm_col="event_type",
        baseline="view",
        treated="click",
    )


def _line_test(name: str) -> Column:
    return compare.flag_test("discounted")[name]


@query
def arm_contingency(spark, sf_dir):
    return _line_arms(spark, sf_dir).select(
        "l_returnflag", "n_baseline", "n_treated", "discounted_baseline", "discounted_treated"
    )


@query
def arm_chi2(spark, sf_dir):
    table = _line_arms(spark, sf_dir)
    return rounded(table.select("l_returnflag", _line_test("chi2").alias("chi2")), 6)


@query
def arm_odds_ratio(spark, sf_dir):
    table = _line_arms(spark, sf_dir)
    return rounded(table.select("l_returnflag", _line_test("odds_ratio").alias("odds_ratio")))


@query
def arm_t_test(spark, sf_dir):
    test = compare.measure_test()
    return rounded(
        _event_arms(spark, sf_dir).select("hour", test["t"].alias("t"), test["df"].alias("df")), 6
    )


@query
def arm_effect_size(spark, sf_dir):
    return rounded(
        _event_arms(spark, sf_dir).select(
            "hour",
            "measured_baseline",
            "measured_treated",
            "mean_baseline",
            "mean_treated",
            compare.measure_test()["cohens_d"].alias("cohens_d"),
        ),
        6,
    )


@query
def arm_pvalues(spark, sf_dir):
    test = compare.measure_test()
    return rounded(
        _line_arms(spark, sf_dir).select(
            "l_returnflag",
            tails.chi2_p(_line_test("chi2")).alias("p_chi2"),
            tails.t_p(test["t"], test["df"]).alias("p_t"),
        ),
        6,
    )


@query
def arm_tests(spark, sf_dir):
    tests = compare.arm_tests(V.eval_scored(spark, sf_dir))
    return rounded(tests, 6)


@query
def mcnemar(spark, sf_dir):
    return rounded(compare.mcnemar(V.eval_scored(spark, sf_dir), F.col("is_unsafe")), 6)


@query
def or_ci(spark, sf_dir):
    args = compare.summary_columns("discounted", "n")
    low, high = compare.odds_ratio_bounds(*args)
    return rounded(
        _line_arms(spark, sf_dir).select(
            "l_returnflag",
            compare.odds_ratio(*args).alias("odds_ratio"),
            low.alias("or_low"),
            high.alias("or_high"),
        )
    )


@query
def bonferroni(spark, sf_dir):
    tests = _line_arms(spark, sf_dir).select(
        "l_returnflag", tails.chi2_p(_line_test("chi2")).alias("p")
    )
    return rounded(compare.bonferroni(tests, "p"), 6)


@query
def verdicts(spark, sf_dir):
    return rounded(compare.verdicts(V.eval_scored(spark, sf_dir)))


# --- ROC and calibration ------------------------------------------------------


def _document_scores(spark, sf_dir) -> DataFrame:
    docs, labels = V.table(spark, sf_dir, "documents"), V.table(spark, sf_dir, "labels")
    return roc.score_histogram(
        docs.select("doc_id", "lang", "n_chars").join(labels, "doc_id"),
        ["lang"],
        F.col("quality") == 1,
        F.col("n_chars"),
    )


def _event_scores(spark, sf_dir) -> DataFrame:
    return roc.score_histogram(
        V.table(spark, sf_dir, "events").withColumn("hour", F.hour("ts")),
        ["hour"],
        F.col("event_type") == "purchase",
        F.col("value"),
    )


@query
def auroc(spark, sf_dir):
    histogram = roc.counterfactual_histogram(V.eval_scored(spark, sf_dir))
    return rounded(roc.auroc(histogram, MODEL_ARM))


@query
def roc_points(spark, sf_dir):
    histogram = roc.counterfactual_histogram(V.eval_scored(spark, sf_dir))
    return rounded(roc.roc_points(histogram, MODEL_ARM))


@query
def auroc_documents(spark, sf_dir):
    return rounded(roc.auroc(_document_scores(spark, sf_dir), ["lang"]))


@query
def auroc_events(spark, sf_dir):
    return rounded(roc.auroc(_event_scores(spark, sf_dir), ["hour"]))


@query
def roc_points_events(spark, sf_dir):
    return rounded(roc.roc_points(_event_scores(spark, sf_dir), ["hour"]))


@query
def correctness_auroc(spark, sf_dir):
    histogram = roc.correctness_histogram(V.eval_scored(spark, sf_dir))
    return rounded(roc.auroc(histogram, MODEL_ARM))


@query
def threshold_prf(spark, sf_dir):
    histogram = roc.counterfactual_histogram(V.eval_scored(spark, sf_dir))
    return rounded(roc.threshold_scores(histogram, MODEL_ARM))


@query
def threshold_prf_events(spark, sf_dir):
    return rounded(roc.threshold_scores(_event_scores(spark, sf_dir), ["hour"]))


@query
def risk_coverage(spark, sf_dir):
    histogram = roc.correctness_histogram(V.eval_scored(spark, sf_dir))
    return rounded(roc.risk_coverage(histogram, MODEL_ARM))


@query
def selective_area(spark, sf_dir):
    histogram = roc.correctness_histogram(V.eval_scored(spark, sf_dir))
    return rounded(roc.selective_area(histogram, MODEL_ARM))


@query
def selective_area_events(spark, sf_dir):
    return rounded(roc.selective_area(_event_scores(spark, sf_dir), ["hour"]))


@query
def auroc_bootstrap_events(spark, sf_dir):
    """A thousand replicates over a score of many values."""
    events = V.table(spark, sf_dir, "events").withColumn("day_half", F.floor(F.hour("ts") / 12).cast("int"))
    positive = F.col("event_type") == "purchase"
    return rounded(roc.bootstrap_auroc(events, ["day_half"], positive, F.col("value"), id_col="event_id"))


@query
def auroc_bootstrap_ci(spark, sf_dir):
    scored = V.eval_scored(spark, sf_dir)
    answerable = scored.where("confidence_valid").where(F.col("dataset_type") != C.COUNTERFACTUAL)
    return rounded(
        roc.bootstrap_auroc(
            answerable, MODEL_ARM, F.col("is_correct"), F.col("confidence"), replicates=200
        )
    )


@query
def calibration_error(spark, sf_dir):
    return rounded(calibration.calibration_error(V.eval_scored(spark, sf_dir)))


@query
def brier(spark, sf_dir):
    return rounded(calibration.brier_score(V.eval_scored(spark, sf_dir)))


@query
def score_error_corr(spark, sf_dir):
    return rounded(calibration.uncertainty_error_correlation(V.eval_scored(spark, sf_dir)))


@query
def detection_rate(spark, sf_dir):
    return rounded(metrics.detection_rate(V.eval_scored(spark, sf_dir)))


@query
def refusal_rate(spark, sf_dir):
    return rounded(metrics.refusal_rate(V.eval_scored(spark, sf_dir)))


@query
def perturbation_delta(spark, sf_dir):
    return rounded(metrics.perturbation_delta(V.eval_scored(spark, sf_dir)))


# --- sampling and profiles -----------------------------------------------------


@query
def question_scan(spark, sf_dir):
    table = questions.read_questions(
        spark, f"{sf_dir}/documents.parquet", split="en", split_col="lang"
    )
    return table.select("doc_id", "source", "n_chars")


@query
def fixed_size_sample(spark, sf_dir):
    orders = V.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return sampling.fixed_size_sample(
        orders, strata=["o_orderpriority"], id_cols=["o_orderkey"]
    )


@query
def sample_item_ids(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").select(
        "lang", "doc_id", F.when(F.col("source") != "src0", F.col("doc_id")).alias("item_id")
    )
    sample = sampling.fixed_size_sample(docs, strata=["lang"], id_cols=["doc_id"])
    return sampling.default_item_id(sample)


@query
def sample_manifest(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").select("lang", "doc_id")
    manifest = sampling.sample_manifest(docs, strata=["lang"], id_col="doc_id")
    return manifest.select(
        "lang", F.size("item_ids").alias("n_ids"), F.array_join("item_ids", ",").alias("item_ids")
    )


@query
def manifest_roundtrip(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars")
    path = work_dir(spark, "manifest")
    results.write_manifest(sampling.sample_manifest(docs, strata=["lang"], id_col="doc_id"), path)
    manifest = results.read_manifest(spark, path, ["lang"])
    return sampling.select_by_manifest(docs, manifest, ["lang"], "doc_id")


@query
def split_profile(spark, sf_dir):
    return profile.split_profile(V.table(spark, sf_dir, "documents"), "lang")


@query
def field_profile(spark, sf_dir):
    """Fields of four given tables that share no schema, in one pass over each."""
    names = ("region", "events", "embeddings", "conversations")
    return profile.field_profile({name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in names})


@query
def split_preview(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").select("lang", "doc_id", "source", "text")
    return profile.split_preview(docs, ["doc_id"], "lang")


# --- normalising and rendering ---------------------------------------------------


def _item_rows(items: DataFrame) -> DataFrame:
    """Items with the option map as one text of ``key=value`` parts, in order."""
    parts = F.transform(
        F.map_entries("options"),
        lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("None"))),
    )
    return items.withColumn("options", F.array_join(parts, ";"))


@query
def mcq_normalize(spark, sf_dir):
    return _item_rows(normalize.choice_items(V.choice_table(spark, sf_dir), "documents"))


@query
def option_text_parse(spark, sf_dir):
    return _item_rows(
        normalize.counterfactual_items(V.counterfactual_table(spark, sf_dir), "part")
    ).select("item_id", "options")


@query
def counterfactual_normalize(spark, sf_dir):
    return _item_rows(
        normalize.counterfactual_items(V.counterfactual_table(spark, sf_dir), "part")
    )


@query
def factcheck_normalize(spark, sf_dir):
    return _item_rows(normalize.factcheck_items(V.factcheck_table(spark, sf_dir), "orders"))


@query
def canonical_items(spark, sf_dir):
    return V.question_items(spark, sf_dir).select(
        "item_id", "dataset", "dataset_type", "stem", "correct_index", "correct_text"
    )


@query
def prompt_render(spark, sf_dir):
    return prompting.render_prompts(V.question_items(spark, sf_dir)).select("dataset", "item_id", "user")


@query
def experiment_grid(spark, sf_dir):
    items = V.question_items(spark, sf_dir).select("dataset", "item_id")
    return prompting.experiment_grid(items, V.MODELS, V.ARMS)


@query
def random_baseline(spark, sf_dir):
    return rounded(normalize.random_baseline(V.question_items(spark, sf_dir)))


# --- matching ---------------------------------------------------------------------


@query
def prompt_keys(spark, sf_dir):
    return V.prompts(spark, sf_dir).select("model", "arm", "dataset", "item_id", "cache_key")


@query
def response_lookup(spark, sf_dir):
    prompts = V.prompts(spark, sf_dir).select("model", "arm", "dataset", "item_id", "cache_key")
    matched = matching.match_responses(prompts, V.stored_responses(spark, sf_dir))
    return matched.select(
        "model", "arm", "dataset", "item_id", "cache_key",
        F.md5("raw_response").alias("raw_md5"), "usage.prompt_tokens",
        "usage.completion_tokens", "error",
    )


@query
def pending_prompts(spark, sf_dir):
    # Only the digest is shown, so it is taken before the shuffle and not after.
    prompts = V.prompts(spark, sf_dir).withColumn("user_md5", F.unhex(F.md5("user")))
    stored = V.stored_responses(spark, sf_dir)
    waiting = matching.pending_prompts(prompts, stored, ("model", "system", "user_md5"))
    return waiting.withColumn("user_md5", F.lower(F.hex("user_md5")))


@query
def token_usage(spark, sf_dir):
    prompts = V.prompts(spark, sf_dir).select("model", "arm", "cache_key")
    matched = matching.match_responses(prompts, V.stored_responses(spark, sf_dir))
    return matching.token_usage(matched)


@query
def experiment_results(spark, sf_dir):
    """Questions to metrics: normalise, render, key, match, extract, flag, aggregate."""
    found = collect_results(V.prompts(spark, sf_dir), V.stored_responses(spark, sf_dir))
    return rounded(metrics.group_metrics(score_results(found)))


# --- sinks -------------------------------------------------------------------------


def _records(spark, sf_dir, dealt: bool = False) -> DataFrame:
    """Result records; ``dealt`` by block before the texts are read, so that only these are shuffled."""
    texts = V.eval_responses(spark, sf_dir)
    return extract_response(results.dealt_by_block(texts) if dealt else texts).select(
        "model", "arm", "dataset", "dataset_type", "item_id", "correct_index",
        F.lit("opt").alias("correct_text"), "predicted_index", "predicted_text", "confidence",
        "reasoning", "evidence_quality", "parse_error", "raw_response",
        F.struct(
            F.length("raw_response").cast("long").alias("prompt_tokens"),
            F.lit(1).cast("long").alias("completion_tokens"),
        ).alias("usage"),
    )


def _flat(records: DataFrame) -> DataFrame:
    return records.select(
        "model", "arm", "dataset", "item_id", "correct_index", "predicted_index", "confidence",
        "parse_error", F.md5("reasoning").alias("reasoning_md5"),
        F.col("raw_response").isNull().alias("no_response"), "usage.completion_tokens",
    )


@query
def sink_roundtrip_json(spark, sf_dir):
    path = work_dir(spark, "results-json")
    results.write_results_json(_records(spark, sf_dir), path)
    return _flat(results.read_results_json(spark, path))


@query
def results_array_files(spark, sf_dir):
    """Results from files of one JSON array each, cut into parts wherever Spark likes."""
    path = work_dir(spark, "results-array")
    texts = _records(spark, sf_dir).select(F.to_json(F.struct("*")).alias("value"))
    # A task's first row opens the array; what closes it says nothing about the records.
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    opened = F.concat(F.when(first, "[").otherwise(""), "value")
    texts.select(opened.alias("value")).write.option("lineSep", ",\n").text(path)
    return _flat(results.read_results_json(spark, path, array_file=True))


@query
def results_from_named_arm(spark, sf_dir):
    """Records that call the arm by another name, read back under that name."""
    path = work_dir(spark, "results-named")
    _records(spark, sf_dir).withColumnRenamed("arm", "condition").write.json(path)
    return _flat(results.read_results_json(spark, path, arm_col="condition"))


@query
def results_block_overwrite(spark, sf_dir):
    """Everything is written, then the treated blocks again: no row is lost or doubled."""
    path = work_dir(spark, "results")
    records = _records(spark, sf_dir)
    results.write_results(records, path)
    results.write_results(records.where(F.col("arm") == C.TREATED_ARM), path)
    return _flat(results.read_results(spark, path))


@query
def scored_table_metrics(spark, sf_dir):
    """Flags are stored with the results; the report reads those columns and no text."""
    path = work_dir(spark, "scored")
    results.write_results(score_results(_records(spark, sf_dir)), path)
    return rounded(metrics.group_metrics(results.read_results(spark, path, scored=True)))


@query
def scored_table_detection(spark, sf_dir):
    """Recognised counterfactual items, from a stored table."""
    path = work_dir(spark, "scored")
    results.write_results(score_results(_records(spark, sf_dir)), path)
    return rounded(metrics.detection_rate(results.read_results(spark, path, scored=True)))


@query
def sink_roundtrip_csv(spark, sf_dir):
    path = work_dir(spark, "metrics-csv")
    table = metrics.group_metrics(V.eval_scored(spark, sf_dir))
    results.write_csv(table, path)
    return rounded(spark.read.schema(table.schema).option("header", True).csv(path))


@query
def sink_roundtrip_tests_json(spark, sf_dir):
    path = work_dir(spark, "tests-json")
    table = compare.arm_tests(V.eval_scored(spark, sf_dir))
    results.write_json(results.drop_nan(table), path)
    return rounded(spark.read.schema(table.schema).json(path), 6)


@query
def cache_append_idempotent(spark, sf_dir):
    """The same batch is appended twice; the second time adds nothing."""
    path = work_dir(spark, "responses")
    batch = V.stored_responses(spark, sf_dir)
    responses.append_responses(batch, path)
    responses.append_responses(batch, path, responses.read_responses(spark, path))
    stored = responses.read_responses(spark, path)
    return stored.select("cache_key", "model", F.md5("raw_response").alias("raw_md5"))


def _turns(stored: DataFrame) -> DataFrame:
    return stored.select(
        "cache_key", "model", "raw_response", "usage.prompt_tokens", "usage.completion_tokens"
    )


@query
def response_file_scan(spark, sf_dir):
    """One file per response, found again by its key."""
    folder = work_dir(spark, "response-files")
    responses.write_response_files(V.turn_responses(spark, sf_dir), folder)
    return _turns(responses.read_response_files(spark, folder))


@query
def response_export_twice(spark, sf_dir):
    """The same export is made twice; each key still has one file."""
    folder = work_dir(spark, "response-files")
    for _ in range(2):
        responses.write_response_files(V.turn_responses(spark, sf_dir), folder)
    return _turns(responses.read_response_files(spark, folder))


@query
def response_file_stream(spark, sf_dir):
    """The same files taken in as a stream, in two runs of which the second finds nothing new."""
    folder, path, state = (work_dir(spark, name) for name in ("files", "table", "state"))
    responses.write_response_files(V.turn_responses(spark, sf_dir), folder)
    for _ in range(2):
        files = ingest.stream_response_files(spark, folder)
        ingest.ingest_responses(files, path, state).awaitTermination()
    return _turns(responses.read_responses(spark, path))


@query
def report_files(spark, sf_dir):
    """The whole report is written; the area table is read back."""
    folder = work_dir(spark, "report")
    analysis = analyse(V.eval_scored(spark, sf_dir))
    write_report(analysis, folder)
    analysis.cells.unpersist()
    return rounded(spark.read.schema(analysis.auroc.schema).json(f"{folder}/auroc"))


def _refreshed(spark, sf_dir):
    """Report state after all results came in, then the treated blocks twice over."""
    path, cells = work_dir(spark, "scored"), work_dir(spark, "cells")
    scored = score_results(_records(spark, sf_dir, dealt=True))
    results.write_results(scored, path, dealt=True)
    refresh_cells(spark, path, cells)
    treated = scored.where(F.col("arm") == C.TREATED_ARM)
    for blocks in (treated.withColumn("is_cautious", ~F.col("is_cautious")), treated):
        results.write_results(blocks, path, dealt=True)
        refresh_cells(spark, path, cells)
    return report_of_cells(spark, cells)


@query
def incremental_metrics(spark, sf_dir):
    return rounded(_refreshed(spark, sf_dir).metrics)


@query
def incremental_auroc(spark, sf_dir):
    return rounded(_refreshed(spark, sf_dir).auroc)


@query
def response_packed(spark, sf_dir):
    """Responses come in batches, one of them twice, and are packed between batches."""
    path = work_dir(spark, "packed")
    turns = V.turn_responses(spark, sf_dir).withColumn("part", F.pmod(F.xxhash64("cache_key"), F.lit(4)))
    for part in (0, 1, 1, 2, 3):
        packed.append_packed(turns.where(F.col("part") == part).drop("part"), path, f"part-{part}", 20_000)
        if part == 2:
            packed.pack(spark, path, 20_000)
    packed.append_packed(turns.drop("part"), path, "all again", 20_000)
    return _turns(packed.read_packed(spark, path))


# --- attempts --------------------------------------------------------------------------

LATENESS = 3600


def _call_events(spark, sf_dir):
    """Events as calls: an error fails and a purchase answers after a while, others stay open."""
    events = V.table(spark, sf_dir, "events")
    at = F.col("ts").cast("timestamp")
    end = F.timestamp_micros(F.unix_micros(at) + F.round(F.col("value") * 1e6).cast("long"))
    kind = F.when(F.col("event_type") == "error", attempts.FAILED).when(
        F.col("event_type") == "purchase", attempts.ANSWERED
    )
    calls = F.array(
        F.struct(at.alias("at"), F.lit(attempts.STARTED).alias("kind")), F.struct(end.alias("at"), kind.alias("kind"))
    )
    key = F.sha2(F.concat_ws("|", "user_id", F.date_format(at, "yyyy-MM-dd")), 256)
    return events.select(key.alias("cache_key"), F.col("event_id").cast("string").alias("attempt_id"), F.inline(calls))


@query
def attempt_ledger(spark, sf_dir):
    events = _call_events(spark, sf_dir).where("kind IS NOT NULL")
    latest = events.select((F.floor(F.unix_micros(F.max("at")) / 1000) * 1000 - LATENESS * 1_000_000).alias("t"))
    return attempts.attempt_ledger(events, latest.scalar())


@query
def attempt_ledger_stream(spark, sf_dir):
    """The same ledger from a stream, after the time-outs that the watermark has passed."""
    folder, table, state = (work_dir(spark, name) for name in ("calls", "ledger", "state"))
    events = _call_events(spark, sf_dir).where("kind IS NOT NULL")
    events.write.parquet(folder)
    stream = spark.readStream.schema(events.schema).parquet(folder)
    changes = attempt_stream.ledger_changes(stream, lateness=f"{LATENESS} seconds")
    attempt_stream.keep_ledger(changes, table, state).awaitTermination()
    return attempt_stream.read_ledger(spark, table)


# --- report tables -------------------------------------------------------------------


@query
def metric_pivot(spark, sf_dir):
    table = metrics.group_metrics(V.eval_scored(spark, sf_dir))
    return rounded(report.metric_by_arm(table, "cautiousness_rate"))


@query
def metric_pivot_unsafe(spark, sf_dir):
    table = metrics.group_metrics(V.eval_scored(spark, sf_dir))
    return rounded(report.metric_by_arm(table, "unsafe_rate"))


@query
def metric_pivot_accuracy(spark, sf_dir):
    legitimate = V.eval_scored(spark, sf_dir).where(F.col("dataset_type") == C.LEGITIMATE)
    return rounded(report.metric_by_arm(metrics.group_metrics(legitimate), "accuracy"))


@query
def confidence_histogram(spark, sf_dir):
    return report.confidence_histogram(V.eval_scored(spark, sf_dir))


@query
def confidence_quartiles(spark, sf_dir):
    return rounded(report.confidence_quartiles(V.eval_scored(spark, sf_dir)))


@query
def value_quartiles_events(spark, sf_dir):
    """Quartiles of a score that has a value of its own in nearly every row."""
    histogram = roc.score_histogram(
        V.table(spark, sf_dir, "events").withColumn("hour", F.hour("ts")),
        ["hour"],
        F.lit(True),
        F.col("value"),
    )
    return rounded(roc.quantiles(histogram, ["hour"], {"q1": 0.25, "median": 0.5, "q3": 0.75}))


@query
def report_metrics(spark, sf_dir):
    return report.metric_rows(metrics.group_metrics(V.eval_scored(spark, sf_dir)))


@query
def report_tests(spark, sf_dir):
    return report.test_rows(compare.arm_tests(V.eval_scored(spark, sf_dir)))


@query
def report_auroc(spark, sf_dir):
    histogram = roc.counterfactual_histogram(V.eval_scored(spark, sf_dir))
    return report.auroc_rows(roc.auroc(histogram, MODEL_ARM))


@query
def analysis_metrics(spark, sf_dir):
    """The metric table again, from the pre-aggregated cells of the full analysis."""
    return rounded(analyse(V.eval_scored(spark, sf_dir), keep_cells=False).metrics)


@query
def analysis_tests(spark, sf_dir):
    return rounded(analyse(V.eval_scored(spark, sf_dir), keep_cells=False).tests, 6)


@query
def analysis_auroc(spark, sf_dir):
    return rounded(analyse(V.eval_scored(spark, sf_dir), keep_cells=False).auroc)
