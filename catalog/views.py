"""Evaluation-shaped tables derived from the given parquet tables.

The given data has no question or response tables, so these views build them:
``eval_responses`` turns each document into responses of every text shape, and
``question_items`` / ``prompts`` / ``stored_responses`` turn documents, parts and
orders into questions, prompts and replies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from respeval import constants as C
from respeval.functions.extraction import extract_response
from respeval.functions.flags import add_flags
from respeval.operators.normalize import (
    choice_items,
    counterfactual_items,
    factcheck_items,
    union_items,
)
from respeval.operators.prompts import content_key
from respeval.plans.experiment import build_prompts
from respeval.sources.questions import read_questions

MODELS = ("m0", "m1")
ARMS = {C.BASELINE_ARM: "Answer.", C.TREATED_ARM: "Answer with care."}
KINDS = (C.LEGITIMATE, C.COUNTERFACTUAL, C.FACTCHECK)
REPLY = ("reply_index", "reply_text", "reply_confidence")


SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
    "props string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read with its schema, so that no job runs to infer it."""
    return read_questions(spark, f"{sf_dir}/{name}.parquet", schema=SCHEMAS[name])


def _response_text() -> Column:
    """The response of one model in one arm; nine text shapes, by document."""
    doc, size, text = F.col("doc_id"), F.col("n_chars"), F.col("text")
    index = ((doc + size) % 4).cast("int")
    doubt = F.when((doc % 3 == 1) & (F.col("ai") == 1), 4).otherwise(0)
    confidence = F.greatest(F.lit(1), (1 + (size + 5 * F.col("ai")) % 10 - doubt).cast("int"))
    answer = F.when(F.col("shape") == 7, "Not enough data").otherwise("opt")
    evidence = F.when(F.col("shape") == 7, "suspicious").otherwise("normal")
    return (
        F.when(
            F.col("shape") == 1,
            F.lit(
                '```json\n{"answer_index": 1, "answer_text": "I do not know", "confidence": 2, '
                '"evidence_quality": "implausible"}\n```'
            ),
        )
        .when(
            F.col("shape") == 2,
            F.concat(
                text, F.lit(' Sure: {"answer_index": 2, "answer_text": "opt", "confidence": 9} end')
            ),
        )
        .when(F.col("shape") == 3, F.lit('{"answer_index": 2, "confidence": 9} trailing {x}'))
        .when(F.col("shape") == 4, F.concat(text, F.lit(" My confidence: 10 of 10")))
        .when(F.col("shape") == 5, F.lit(""))
        .when(F.col("shape") == 6, F.lit(None).cast("string"))
        .otherwise(
            F.to_json(
                F.struct(
                    index.alias("answer_index"),
                    answer.alias("answer_text"),
                    confidence.alias("confidence"),
                    evidence.alias("evidence_quality"),
                    text.alias("reasoning"),
                )
            )
        )
    )


def eval_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four responses per document: two models, two arms."""
    cells = [
        F.struct(
            F.lit(mi).alias("mi"),
            F.lit(model).alias("model"),
            F.lit(ai).alias("ai"),
            F.lit(arm).alias("arm"),
        )
        for mi, model in enumerate(MODELS)
        for ai, arm in enumerate(ARMS)
    ]
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("doc_id") % 3 + 1).cast("int"))
    turn = F.floor(F.col("doc_id") / 3) * 7 + F.col("n_chars")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "text")
    docs = docs.select("*", F.inline(F.array(*cells)))
    shaped = docs.withColumn("shape", (turn + 3 * F.col("mi") + F.col("ai")) % 9)
    shaped = shaped.withColumn("raw_response", _response_text())
    return shaped.select(
        F.col("doc_id").cast("string").alias("item_id"),
        "model",
        "arm",
        F.concat(kind, F.lit("_"), F.col("lang")).alias("dataset"),
        kind.alias("dataset_type"),
        F.when(F.col("doc_id") % 3 == 1, -1)
        .otherwise((F.col("doc_id") % 4).cast("int"))
        .alias("correct_index"),
        "raw_response",
    )


def eval_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_response(eval_responses(spark, sf_dir))


def eval_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_flags(eval_results(spark, sf_dir))


def choice_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as questions with a column per choice; labelled ones have a reply."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "text")
    labels = table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("sent1"),
        F.col("lang").alias("ending0"),
        F.col("n_chars").cast("string").alias("ending1"),
        F.lit("yes").alias("ending2"),
        F.lit("no").alias("ending3"),
        (F.col("doc_id") % 4).cast("int").alias("label"),
        F.col("quality").alias("reply_index"),
        F.when(F.col("toxic") == 1, F.lit("I don't know"))
        .when(F.col("quality").isNotNull(), F.col("lang"))
        .alias("reply_text"),
        F.when(F.col("quality").isNotNull(), (5 + F.col("n_chars") % 6).cast("int")).alias(
            "reply_confidence"
        ),
    )


def counterfactual_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as questions whose options are text: dict literals, JSON and prose."""
    name, brand, size = F.col("p_name"), F.col("p_brand"), F.col("p_size").cast("string")
    style = F.col("p_partkey") % 5
    options = (
        F.when(
            style == 0,
            F.concat(
                F.lit("{'0': '"), name, F.lit("', '1': \""), brand, F.lit("'s\", '2': "), size,
                F.lit(", '5': 'I do not know'}"),
            ),
        )
        .when(
            style == 1,
            F.concat(
                F.lit('{"0": "'), name, F.lit('", "1": "'), F.col("p_type"),
                F.lit('", "5": "I do not know"}'),
            ),
        )
        .when(
            style == 2,
            F.concat(
                F.lit("{'2': 'it\\'s "), name, F.lit("', '0': None, '5': 'I do not know',}")
            ),
        )
        .when(style == 3, F.concat(name, F.lit(" or "), brand))
        .otherwise(
            F.concat(
                F.lit("{0: 'a: {"), name, F.lit("}, None', 1: True, 5: 'I do not know'}")
            )
        )
    )
    replied = F.col("p_size") > 25
    abstains = F.col("p_size") % 4 != 0
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.concat(F.lit("Which label fits part "), F.col("p_partkey"), F.lit("?")).alias("question"),
        options.alias("options"),
        F.when(replied, F.when(abstains, 5).otherwise(0)).alias("reply_index"),
        F.when(replied, F.when(abstains, F.lit("I do not know")).otherwise(name)).alias(
            "reply_text"
        ),
        F.when(replied, 1 + F.col("p_size") % 9).alias("reply_confidence"),
    )


def factcheck_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as questions whose option text also holds the truth."""
    priority = F.col("o_orderpriority")
    replied = F.col("o_orderstatus") == "F"
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(
            F.lit("Which priority did order "), F.col("o_orderkey"), F.lit(" have?")
        ).alias("question"),
        F.concat(
            F.lit(
                "{'0': '1-URGENT', '1': '2-HIGH', '2': '3-MEDIUM', '3': '4-NOT SPECIFIED', "
                "'4': '5-LOW', 'correct answer': '"
            ),
            priority,
            F.lit("'}"),
        ).alias("options"),
        F.col("o_orderstatus").alias("student_answer"),
        (F.substring(priority, 1, 1).cast("int") - 1).alias("correct_index"),
        priority.alias("correct_answer"),
        F.when(replied, (F.col("o_custkey") % 5).cast("int")).alias("reply_index"),
        F.when(replied, priority).alias("reply_text"),
        F.when(replied, (5 + F.col("o_custkey") % 6).cast("int")).alias("reply_confidence"),
    )


def question_items(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return union_items(
        choice_items(choice_table(spark, sf_dir), "documents", keep=keep),
        counterfactual_items(counterfactual_table(spark, sf_dir), "part", keep=keep),
        factcheck_items(factcheck_table(spark, sf_dir), "orders", keep=keep),
    )


def prompts(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return build_prompts(question_items(spark, sf_dir, keep), MODELS, ARMS)


def stored_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies keyed by prompt; copies of a document give several rows per key."""
    confidence = F.greatest(
        F.lit(1),
        F.col("reply_confidence") - F.when(F.col("arm") == C.TREATED_ARM, 3).otherwise(0),
    )
    return (
        prompts(spark, sf_dir, REPLY)
        .where(F.col("reply_index").isNotNull())
        .select(
            "cache_key",
            "model",
            F.to_json(
                F.struct(
                    F.col("reply_index").alias("answer_index"),
                    confidence.alias("confidence"),
                    F.col("reply_text").alias("answer_text"),
                )
            ).alias("raw_response"),
            F.struct(
                F.length("user").cast("long").alias("prompt_tokens"),
                F.length("reply_text").cast("long").alias("completion_tokens"),
            ).alias("usage"),
            F.lit(None).cast("string").alias("error"),
        )
    )


def turn_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn as a stored response."""
    return table(spark, sf_dir, "conversations").select(
        content_key(F.lit("m0"), F.col("role"), F.col("text")).alias("cache_key"),
        F.lit("m0").alias("model"),
        F.col("text").alias("raw_response"),
        F.struct(
            F.length("role").cast("long").alias("prompt_tokens"),
            F.length("text").cast("long").alias("completion_tokens"),
        ).alias("usage"),
        F.lit(None).cast("string").alias("error"),
    )
