"""Structured fields out of free response text, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respeval import constants as C
from respeval.functions.once import computed_once
from respeval.schemas import ANSWER


_MARKER = "_end"
_FIELDS = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in ANSWER.fields)


def outermost_braces(text: Column) -> Column:
    """From the first ``{`` to the last ``}``; empty when there is no such span.

    Position arithmetic keeps it linear on texts that hold many lone braces.
    """
    first = F.instr(text, "{")
    last = F.length(text) - F.length(F.substring_index(text, "}", -1))
    return F.when((first > 0) & (last >= first), text.substr(first, last - first + 1)).otherwise(
        F.when(text.isNotNull(), F.lit(""))
    )


def marked_objects(json_text: Column) -> Column:
    """The text parsed as the first element of an array that ends in a marker.

    ``from_json`` ignores whatever follows the first value. Here trailing text breaks the
    array (NULL), a second object moves the marker, and a bracket that closes the array
    early loses it; ``is_single_object`` tells. Empty text is not parsed at all.
    """
    text = F.nullif(json_text, F.lit(""))
    return F.from_json(
        F.concat(F.lit("["), text, F.lit(f',{{"{_MARKER}": true}}]')),
        f"array<struct<{_FIELDS}, {_MARKER}: boolean>>",
        {"allowSingleQuotes": "false"},
    )


def is_single_object(objects: Column) -> Column:
    """Whether the text behind ``marked_objects`` was one JSON object and nothing else."""
    ended = F.get(objects, F.lit(1)).getField(_MARKER)
    return F.coalesce((F.size(objects) == 2) & ended, F.lit(False))


def digit_after(text: Column, word: str, reach: int, whole_number: bool) -> Column:
    """First digit in the ``reach`` characters that begin at the first ``word``."""
    at = F.instr(text, word)
    pattern = "[0-9]+" if whole_number else "[0-9]"
    digits = F.regexp_extract(text.substr(at, F.lit(reach)), pattern, 0)
    return F.when((at > 0) & (digits != ""), digits.try_cast("double"))


def confidence_in_prose(text: Column, whole_number: bool = False) -> Column:
    """Confidence stated in prose; the earlier word in the list takes precedence.

    By default one digit is read, so "10" gives 1, as the protocol's published
    numbers do; ``whole_number=True`` reads the full number.
    """
    return F.coalesce(
        *[digit_after(text, word, C.CONFIDENCE_REACH, whole_number) for word in C.CONFIDENCE_WORDS]
    )


def extract_response(
    df: DataFrame,
    raw_col: str = "raw_response",
    whole_number: bool = False,
    only: Sequence[str] | None = None,
) -> DataFrame:
    """Add the answer fields and ``parse_error`` read from ``raw_col``, or ``only`` some of them.

    A JSON null and a missing field give the same default.

    Each text is parsed once, whatever is later filtered on.
    """
    raw = F.col(raw_col)
    staged = df.withColumn("_objects", marked_objects(outermost_braces(raw)))
    parsed = is_single_object(F.col("_objects"))
    field = F.get("_objects", F.lit(0)).getField
    index = field("answer_index")
    stated = F.nanvl(field("confidence"), F.lit(None).cast("double"))

    def text_field(name: str) -> Column:
        return F.coalesce(F.when(parsed, field(name)), F.lit(""))

    fields = {
        "predicted_index": F.coalesce(
            F.when(parsed & (index == F.floor(index)), index.try_cast("int")),
            F.lit(C.MISSING_INDEX),
        ),
        "predicted_text": text_field("answer_text"),
        "confidence": F.coalesce(
            F.when(parsed, stated).otherwise(confidence_in_prose(raw, whole_number)),
            F.lit(float(C.MISSING_CONFIDENCE)),
        ),
        "reasoning": F.when(raw.isNull(), F.lit(C.NO_RESPONSE_REASONING)).otherwise(
            text_field("reasoning")
        ),
        "evidence_quality": text_field("evidence_quality"),
        "parse_error": ~parsed,
    }
    wanted = {name: value for name, value in fields.items() if only is None or name in only}
    return computed_once(staged, wanted, keep=df.columns)
