import hashlib

from pyspark.sql import functions as F

from respeval.operators import matching, normalize, prompts
from respeval.plans.experiment import build_prompts, collect_results, score_results
from respeval.schemas import CHOICE_QUESTIONS, COUNTERFACTUAL_QUESTIONS, FACTCHECK_QUESTIONS

ARMS = {"baseline": "sys b", "uncertainty": "sys u"}


def choice_table(spark):
    return spark.createDataFrame(
        [("q1", "Stem é?", "a", "b", "c", "d", 2), ("q2", "Other", "w", "x", "y", "z", 0)],
        CHOICE_QUESTIONS,
    )


def fake_table(spark):
    return spark.createDataFrame(
        [("f1", "Odd?", "{'0': 'a', '5': 'I do not know'}")],
        COUNTERFACTUAL_QUESTIONS,
    )


def fact_table(spark):
    return spark.createDataFrame(
        [("t1", "Which?", "{'0': 'a', '1': \"b's\", 'correct answer': 'a'}", "b's", 0, "a")],
        FACTCHECK_QUESTIONS,
    )


def all_items(spark):
    return normalize.union_items(
        normalize.choice_items(choice_table(spark), "mcq"),
        normalize.counterfactual_items(fake_table(spark), "fake"),
        normalize.factcheck_items(fact_table(spark), "fact"),
    )


USERS = {
    "q1": "Question: Stem é?\n\nOptions:\n  0. a\n  1. b\n  2. c\n  3. d",
    "q2": "Question: Other\n\nOptions:\n  0. w\n  1. x\n  2. y\n  3. z",
    "f1": "Question: Odd?\n\nOptions:\n  0. a\n  5. I do not know",
    "t1": "A student answered the following medical question incorrectly. Identify the CORRECT "
    "answer.\n\nQuestion: Which?\nStudent's (INCORRECT) answer: b's\n\n"
    "Options:\n  0. a\n  1. b's",
}


def test_items(spark):
    rows = {r.item_id: r for r in all_items(spark).collect()}
    assert (rows["q1"].correct_index, rows["q1"].correct_text) == (2, "c")
    assert (rows["f1"].correct_index, rows["f1"].correct_text) == (-1, "I do not know")
    assert (rows["t1"].correct_index, rows["t1"].correct_text) == (0, "a")
    assert {r.item_id: r.dataset_type for r in rows.values()} == {
        "q1": "legitimate", "q2": "legitimate", "f1": "counterfactual", "t1": "factcheck",
    }


def test_rendering(spark):
    rows = prompts.render_prompts(all_items(spark)).collect()
    assert {r.item_id: r.user for r in rows} == USERS


def test_grid_and_keys(spark):
    rows = build_prompts(all_items(spark), ["m1", "m2"], ARMS).collect()
    assert len(rows) == 4 * 2 * 2
    for r in rows:
        text = f"{r.model}|{ARMS[r.arm]}|{USERS[r.item_id]}"
        assert r.cache_key == hashlib.sha256(text.encode()).hexdigest()


def test_grid_needs_no_shuffle(spark):
    plan = build_prompts(all_items(spark), ["m1", "m2"], ARMS)._jdf.queryExecution()
    text = plan.executedPlan().toString()
    assert "Exchange" not in text and "Join" not in text


def test_a_null_part_gives_no_key(spark):
    df = spark.createDataFrame([(None, "s", "u")], "model string, system string, user string")
    assert prompts.add_content_key(df).first().cache_key is None


def stored(spark, rows):
    return spark.createDataFrame(
        rows,
        "cache_key string, model string, raw_response string, "
        "usage struct<prompt_tokens: bigint, completion_tokens: bigint>, error string",
    )


def test_match_pending_and_usage(spark):
    asked = build_prompts(all_items(spark), ["m1"], ARMS)
    asked = asked.unionByName(asked.where("item_id = 'q1'"))  # equal prompts share a key
    keys = {(r.arm, r.item_id): r.cache_key for r in asked.collect()}
    answers = stored(
        spark,
        [
            (keys["baseline", "q1"], "m1", '{"answer_index": 2, "confidence": 9}', (10, 2), None),
            (keys["baseline", "q1"], "m1", '{"answer_index": 3, "confidence": 9}', (10, 2), None),
            (keys["uncertainty", "f1"], "m1", "I don't know", (5, 1), None),
            ("0" * 64, "m1", "unrelated", (1, 1), None),
        ],
    )
    for unique, table in ((False, answers), (True, matching.one_per_key(answers))):
        found = matching.match_responses(asked, table, unique)
        assert found.count() == asked.count() == 10
        by_key = {}
        for r in found.collect():
            by_key.setdefault((r.arm, r.item_id), []).append((r.raw_response, r.error))
        assert by_key["baseline", "q1"] == [('{"answer_index": 2, "confidence": 9}', None)] * 2
        assert by_key["baseline", "q2"] == [(None, "max_retries_exceeded")]
    waiting = matching.pending_prompts(asked, answers).collect()
    assert len(waiting) == len({r.cache_key for r in waiting}) == 8 - 2
    usage = {r.arm: tuple(r)[2:] for r in matching.token_usage(found).collect()}
    assert usage == {"baseline": (5, 20, 4), "uncertainty": (5, 5, 1)}
    results = {
        (r.arm, r.item_id): r for r in score_results(collect_results(asked, answers)).collect()
    }
    assert results["baseline", "q1"].is_correct
    assert results["uncertainty", "f1"].is_cautious and results["uncertainty", "f1"].parse_error
    assert results["baseline", "q2"].reasoning == "API_ERROR"


def test_a_hot_key_is_split(spark, conf):
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="4KB",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="8KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.2",
    )
    n = 120_000
    one_in_three = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string"))
    asked = spark.range(0, n, 1, 16).select("id", F.sha2(one_in_three, 256).alias("cache_key"))
    answers = spark.range(0, n // 2, 1, 8).select(
        F.sha2(F.when(F.col("id") == 0, "hot").otherwise(F.col("id").cast("string")), 256).alias(
            "cache_key"
        ),
        F.lit("m").alias("model"),
        F.concat(F.lit("r"), F.col("id")).alias("raw_response"),
        F.lit(None).cast("struct<prompt_tokens: bigint, completion_tokens: bigint>").alias("usage"),
        F.lit(None).cast("string").alias("error"),
    )
    for unique in (True, False):
        found = matching.match_responses(asked, answers, unique).select(
            "id", "raw_response", "error"
        )
        rows = found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
        assert len(rows) == n
        assert sum(r.raw_response == "r0" for r in rows) == n // 3
        assert sum(r.error is not None for r in rows) == n // 2 - n // 6


def test_random_baseline(spark):
    rows = {r.dataset: r.random_accuracy for r in normalize.random_baseline(all_items(spark)).collect()}
    assert rows == {"mcq": 0.25, "fake": 0.5, "fact": 0.5}
