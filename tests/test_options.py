from pyspark.sql import functions as F

from respeval.functions.options import parse_options, render_options

# text -> options, in order
CASES = {
    """{'0': 'a', '1': "it's b"}""": {"0": "a", "1": "it's b"},
    r"{'0': 'c\'d'}": {"0": "c'd"},
    "{'0': 'x', '2': 'y', '1': 'z'}": {"0": "x", "2": "y", "1": "z"},
    "{'0': None}": {"0": "None"},
    "{'0': 'None, 5: True', '1': True}": {"0": "None, 5: True", "1": "True"},
    "{0: 'a', 1: 2.5}": {"0": "a", "1": "2.5"},
    "{'0': 'a',}": {"0": "a"},
    r"{'0': 'a\xa0b'}": {"0": "a\xa0b"},
    r"{'0': 'a\\x41'}": {"0": r"a\x41"},
    '{"0": "a", "1": null}': {"0": "a", "1": None},
    "plain text": {"0": "plain text"},
    "{'0': 'a'} and more": {"0": "{'0': 'a'} and more"},
    "{'0': undefined}": {"0": "{'0': undefined}"},
    "{'0': 'a'}] [{}": {"0": "{'0': 'a'}] [{}"},
    "{'0': 'a'}, {'1': 'b'}": {"0": "{'0': 'a'}, {'1': 'b'}"},
    "[1, 2]": {"0": "[1, 2]"},
    "": {"0": ""},
    "{}": {},
}


def test_parse(spark):
    df = spark.createDataFrame([(t,) for t in CASES], "t string")
    df = df.select("t", parse_options(F.col("t")).alias("o"))
    rows = df.select("t", F.map_keys("o").alias("k"), F.map_values("o").alias("v")).collect()
    got = {r.t: list(zip(r.k, r.v)) for r in rows}
    assert got == {t: list(o.items()) for t, o in CASES.items()}


def test_long_strings_do_not_overflow(spark):
    long = "it's " * 20_000
    text = "{'0': \"" + long + "\", '1': None, '2': 'a\\'b" + "\\'" * 2000 + "'}"
    df = spark.createDataFrame([(text,)], "t string")
    options = df.select(parse_options(F.col("t"))).first()[0]
    assert options == {"0": long, "1": "None", "2": "a'b" + "'" * 2000}


def test_render(spark):
    df = spark.sql("select map('0', 'a', '2', cast(null as string), '1', 'c') as o")
    text = df.select(render_options(F.col("o"), "  {key}. {value}")).first()[0]
    assert text == "  0. a\n  2. None\n  1. c"
