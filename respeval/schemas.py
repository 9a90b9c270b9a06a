"""Schemas of the tables that pass between operators."""

from pyspark.sql import types as T

USAGE = T.StructType(
    [
        T.StructField("prompt_tokens", T.LongType()),
        T.StructField("completion_tokens", T.LongType()),
    ]
)

RESPONSE_FILE = T.StructType(
    [
        T.StructField("raw_response", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("usage", USAGE),
    ]
)

RESPONSES = T.StructType(
    [
        T.StructField("cache_key", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("raw_response", T.StringType()),
        T.StructField("usage", USAGE),
        T.StructField("error", T.StringType()),
    ]
)

# What a response text is expected to hold. Numbers are typed, so a quoted
# number reads as NULL instead of silently turning into a confidence.
ANSWER = T.StructType(
    [
        T.StructField("answer_index", T.DoubleType()),
        T.StructField("answer_text", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("reasoning", T.StringType()),
        T.StructField("evidence_quality", T.StringType()),
    ]
)

RESULTS = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("arm", T.StringType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("dataset_type", T.StringType()),
        T.StructField("item_id", T.StringType()),
        T.StructField("correct_index", T.IntegerType()),
        T.StructField("correct_text", T.StringType()),
        T.StructField("predicted_index", T.IntegerType()),
        T.StructField("predicted_text", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("reasoning", T.StringType()),
        T.StructField("evidence_quality", T.StringType()),
        T.StructField("parse_error", T.BooleanType()),
        T.StructField("raw_response", T.StringType()),
        T.StructField("usage", USAGE),
    ]
)

FLAGS = (
    "confidence_valid",
    "is_correct",
    "is_cautious",
    "is_unsafe",
    "flagged_suspicious",
    "abstained",
)

# Results with their flags: reports on such a table never read the response texts again.
SCORED = T.StructType(
    RESULTS.fields + [T.StructField(name, T.BooleanType()) for name in FLAGS]
)

# Question tables as they come: a column per choice, or the options as text.
CHOICE_QUESTIONS = (
    "id string, sent1 string, ending0 string, ending1 string, ending2 string, ending3 string, "
    "label int"
)
COUNTERFACTUAL_QUESTIONS = "id string, question string, options string"
FACTCHECK_QUESTIONS = (
    "id string, question string, options string, student_answer string, correct_index int, "
    "correct_answer string"
)

ITEM_COLUMNS = (
    "item_id",
    "dataset",
    "dataset_type",
    "stem",
    "options",
    "student_answer",
    "correct_index",
    "correct_text",
)
