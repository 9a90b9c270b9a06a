import pytest
from pyspark.sql import functions as F

from respeval.functions.extraction import extract_response, outermost_braces

# text -> (parse_error, confidence)
CASES = {
    '{"answer_index": 1, "confidence": 10}': (False, 10),
    '```json\n{ "confidence": 1 }\n```': (False, 1),
    'Sure: {"confidence": 9} end': (False, 9),
    '{"confidence": 9} tail {x}': (True, 9),
    '{"confidence": 4},{"confidence": 5}': (True, 4),
    "{'confidence': 10}": (True, 1),
    '{"confidence": 9}] and [{"confidence": 2}': (True, 9),
    '{"confidence": 9}, {"x": 1}] and [{}': (True, 9),
    '{"confidence": 6, "_end": true}': (False, 6),
    "My confidence: 10 of 10": (True, 1),
    "confidence 3 ... Confidence 8": (True, 8),
    "confidence 3 ... Confidence none": (True, 3),
    "no braces": (True, -1),
    "": (True, -1),
    '{"a": "x\ny", "confidence": 3}': (True, 3),
    '{"confidence": 9, "confidence": 2}': (False, 2),
    '{"confidence": null}': (False, -1),
    '{"x": 1}': (False, -1),
    '{"confidence": NaN}': (False, -1),
    '{"confidence": "9"}': (False, -1),
    '{"confidence": 3,}': (True, 3),
    '{"confidence": 7': (True, 7),
    "} then {": (True, -1),
    "confidence " + "." * 30 + " 5": (True, -1),
    '{"confidence": 7.5}': (False, 7.5),
    '{"confidence": {"level": 3}}': (False, -1),
}


def read(spark, texts, **kwargs):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw_response string")
    return [r.asDict() for r in extract_response(df, **kwargs).orderBy("i").collect()]


def test_parse_error_and_confidence(spark):
    rows = read(spark, CASES)
    got = {r["raw_response"]: (r["parse_error"], r["confidence"]) for r in rows}
    assert got == CASES


def test_missing_response(spark):
    (row,) = read(spark, [None])
    assert row["parse_error"] and row["confidence"] == -1 and row["predicted_index"] == -1
    assert row["reasoning"] == "API_ERROR" and row["predicted_text"] == ""


def test_fields(spark):
    rows = read(
        spark,
        [
            '{"answer_index": 2, "answer_text": "é \\"q\\"", "confidence": 5, '
            '"reasoning": "r", "evidence_quality": "normal", "more": [1, {"a": 2}]}',
            '{"answer_index": 2.0, "answer_text": {"k": 1}}',
            '{"answer_index": 2.5, "answer_text": null}',
            '{"answer_index": "2"}',
        ],
    )
    first = rows[0]
    assert (first["predicted_index"], first["predicted_text"]) == (2, 'é "q"')
    assert (first["reasoning"], first["evidence_quality"]) == ("r", "normal")
    assert [r["predicted_index"] for r in rows] == [2, 2, -1, -1]
    assert [r["predicted_text"] for r in rows[1:3]] == ['{"k":1}', ""]


def test_whole_number(spark):
    (row,) = read(spark, ["My confidence: 10 of 10"], whole_number=True)
    assert row["confidence"] == 10


@pytest.mark.parametrize(
    "text, span",
    [("a{b}c}d", "{b}c}"), ("}{", ""), ("{", ""), ("x", ""), ("{}", "{}"), ("é{ü}é", "{ü}")],
)
def test_outermost_braces(spark, text, span):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(outermost_braces(F.col("t"))).first()[0] == span


def test_long_text_is_read_whole(spark):
    filler = "x" * 3_000_000
    (row,) = read(spark, [filler + '{"confidence": 6, "reasoning": "' + filler + '"}' + filler])
    assert row["confidence"] == 6 and len(row["reasoning"]) == len(filler)


def test_a_filter_does_not_copy_the_parse(spark):
    df = spark.createDataFrame([("{}",)], "raw_response string")
    asked = extract_response(df).where("confidence > 3 and not parse_error").select("confidence")
    plan = asked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_one_bad_text_does_not_spoil_its_neighbours(spark):
    rows = read(spark, ['{"confidence": 2}', '{"confidence": 3', None, '{"confidence": 4}'])
    assert [r["confidence"] for r in rows] == [2, 3, -1, 4]
