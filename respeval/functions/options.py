"""Answer options held as text: a Python dict literal, JSON, or plain prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A quoted string of either kind; possessive, so matching stays linear.
_STRING = r"""'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+\""""
# Punctuation and whole strings that may stand before a bare literal.
_BETWEEN = rf"(?:[\s{{}}\[\]:,]++|{_STRING})*+"
# Bare Python literals are put in quotes, which is how they print in a prompt.
_BARE = rf"(?s)\G({_BETWEEN})(None|True|False|[-+]?\d+(?:\.\d+)?)(?=[\s,:}}\]])"
_MARKER = "_end"
_LENIENT = {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}


def _single_map(text: Column) -> Column:
    """The text as exactly one string map, or NULL if it is anything else.

    As for responses, a marker after the text shows that the reader got to its end.
    """
    maps = F.from_json(
        F.concat(F.lit("["), text, F.lit(f',{{"{_MARKER}": ""}}]')),
        "array<map<string,string>>",
        _LENIENT,
    )
    # Held in an array so that the checks do not parse the text again.
    alone = F.filter(
        F.array(maps),
        lambda m: (F.size(m) == 2) & F.map_contains_key(F.get(m, F.lit(1)), F.lit(_MARKER)),
    )
    return F.get(F.get(alone, F.lit(0)), F.lit(0))


def python_literal_as_json(text: Column) -> Column:
    """Rewrite the parts of a dict literal that a lenient JSON reader rejects."""
    text = F.regexp_replace(text, r"(?<!\\)((?:\\\\)*+)\\x([0-9a-fA-F]{2})", r"$1\\u00$2")
    text = F.regexp_replace(text, r",\s*\}\s*$", "}")
    return F.regexp_replace(text, _BARE, r'$1"$2"')


def parse_options(text: Column) -> Column:
    """Ordered option map: dict literal, else JSON after ``'`` -> ``"``, else the text itself.

    Most literals already read as lenient JSON, so the rewrite runs only on the rest. A
    hex escape is the one case where that first reading would succeed with a wrong text.
    """
    return F.coalesce(
        F.when(~F.contains(text, F.lit("\\x")), _single_map(text)),
        _single_map(python_literal_as_json(text)),
        _single_map(F.replace(text, F.lit("'"), F.lit('"'))),
        F.create_map(F.lit("0"), text),
    )


def render_options(options: Column, option_format: str) -> Column:
    """One line per option, in map order."""
    before, rest = option_format.split("{key}")
    between, after = rest.split("{value}")
    return F.array_join(
        F.transform(
            F.map_entries(options),
            lambda e: F.concat(
                F.lit(before),
                e["key"],
                F.lit(between),
                F.coalesce(e["value"], F.lit("None")),
                F.lit(after),
            ),
        ),
        "\n",
    )
