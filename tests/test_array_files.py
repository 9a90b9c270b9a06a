"""Array files cut anywhere, against the reader that takes a file whole; profiles of unlike tables."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from respeval.operators import profile
from respeval.schemas import RESULTS
from respeval.sources.arrays import array_records, parsed_records
from respeval.sources.results import read_results_json

HARD = ['"', "\\", "}", "{", "]", "[", ",", "\n", " ", "a", "é", "}{", '\\"}', "\\\\"]


def value(rng, depth=0):
    kind = rng.randrange(5 if depth < 3 else 3)
    if kind == 0:
        return rng.randrange(100)
    if kind in (1, 2):
        return "".join(rng.choices(HARD, k=rng.randrange(12)))
    if kind == 3:
        return [value(rng, depth + 1) for _ in range(rng.randrange(3))]
    return {f"k{i}{rng.choice(HARD)}": value(rng, depth + 1) for i in range(rng.randrange(3))}


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("part", ["97", "1000", "128m"])
def test_records_of_cut_files(spark, conf, tmp_path, indent, part):
    rng = random.Random(f"{indent} {part}")
    objects = [{"at": i, "x": value(rng), "y": {"z": value(rng)}} for i in range(150)]
    for name, some in (("a", objects[:90]), ("b", objects[90:]), ("none", []), ("open", [{"at": 150}])):
        (tmp_path / f"{name}.json").write_text(json.dumps(some, indent=indent, ensure_ascii=False))
    (tmp_path / "empty.json").write_text("")
    conf(spark__sql__files__maxPartitionBytes=part, spark__sql__files__openCostInBytes="0")
    records = array_records(spark, str(tmp_path))
    found = sorted((json.loads(r.record) for r in records.collect()), key=lambda x: x["at"])
    assert found == [*objects, {"at": 150}]
    if part != "128m":
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 8


def test_same_rows_as_the_whole_file_reader(spark, conf, tmp_path):
    rng = random.Random(5)
    rows = [
        {"model": "m", "item_id": str(i), "confidence": rng.random(), "reasoning": str(value(rng)), "usage": {"prompt_tokens": i}}
        for i in range(200)
    ]
    path = tmp_path / "all.json"
    path.write_text(json.dumps(rows))
    whole = spark.read.schema(RESULTS).option("multiLine", True).json(str(path))
    conf(spark__sql__files__maxPartitionBytes="500", spark__sql__files__openCostInBytes="0")
    cut = parsed_records(array_records(spark, str(path)), RESULTS)
    key = lambda r: int(r.item_id)
    assert sorted(cut.collect(), key=key) == sorted(whole.collect(), key=key)
    with pytest.raises(ValueError, match="arm"):
        read_results_json(spark, str(path), array_file=True)


def test_profile_of_unlike_tables(spark):
    day = datetime.date(2020, 1, 1)
    one = spark.createDataFrame([(1, "x", None), (2, None, None)], "a int, b string, c string")
    two = spark.createDataFrame(
        [(day, [1.5], {"k": 1}, (1, "s")), (None, [], None, (None, None))],
        "d date, e array<double>, f map<string,int>, g struct<h:long,i:string>",
    )
    empty = one.where("false")
    found = {(r.split, r.field): (r.type, r.n_values) for r in profile.field_profile({"one": one, "two": two, "empty": empty}).collect()}
    assert found[("one", "a")] == ("BIGINT", 2)
    assert found[("one", "b")] == ("STRING", 1)
    assert found[("one", "c")] == ("VOID", 0)
    assert found[("two", "d")] == ("DATE", 1)
    assert found[("two", "e")][0].startswith("ARRAY<") and found[("two", "e")][1] == 2
    assert found[("two", "f")] == ("OBJECT<k: BIGINT>", 1)
    assert found[("two", "g")] == ("OBJECT<h: BIGINT, i: STRING>", 2)
    assert not any(split == "empty" for split, _ in found)
    schemas = {r.split: r.schema for r in profile.merged_schemas({"one": one, "two": two}).collect()}
    assert schemas["one"] == "OBJECT<a: BIGINT, b: STRING, c: VOID>"
