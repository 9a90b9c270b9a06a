"""Personal data by patterns, and terms that reveal it by information theory.

Base spans come from four patterns (email, ip, card, phone), leftmost and non-overlapping
per kind; matches that fail a kind's rule are dropped. A term discloses a kind of entity when
the corpus shows that the two occur together. Besides the four kinds, secrets (long runs of
letters and digits mixed) are entities that terms may disclose; they have no spans of their own.

A context is what stands within ``REACH`` code points of an entity on its line, without the
entities themselves and without words that the border cuts. With ``p(c)`` the share of all words
that stand in contexts of kind ``c``, ``PMI(t; c) = log2 p(c | t) / p(c)`` is compared with the
kind's information ``IC(c) = -log2 p(c)``. Terms whose ratio PMI / IC reaches ``REMOVE`` are
removed, those that reach ``GENERALISE`` are replaced by the kind they hint at. A term is a word
of one letter or more, or two characters of scripts that write no blanks. Term spans are added to
the base spans and never overlap them; the base spans stay.

Only DataFrame functions are used. Positions are code points, end exclusive. Counts cover every
word of every text and are summed per task before they are shuffled. Terms in at least ``LEAST``
different contexts (entity and words) go on, a fixed support however large the corpus is; copies
of one context count towards the shares, but not towards this support. The disclosing terms stay
a table, whose size has no bound: the distinct terms of each text are joined with it, over
``SALTS`` keys per term, and what is found is joined back to the texts by 128 bits of hash of the
text, so that repeated rows and rows without an id need no key.

Null texts count as empty; they and empty texts have no span. Repeated rows are texts of
their own. The noncharacters U+FDD0 to U+FDD9 mark places inside the job, and a text that holds
them is read as if they were U+FDDF. Other columns are kept, with any name.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respeval.functions.once import computed_once
from respeval.llm.tables import stored, text_or_empty

REMOVE = 0.9
GENERALISE = 0.6
LEAST = 8
#: Code points on either side of an entity that are its context.
REACH = 40
SALTS = 16
_OPEN, _CLOSE, _OTHER = "\ufdd0", "\ufdd1", "\ufddf"
#: Stand for the labels of removed entities until the end.
_LABELS = "\ufdd2\ufdd3\ufdd4\ufdd5\ufdd6"
_MARKS = "".join(chr(c) for c in range(0xFDD0, 0xFDDA))
_STEP = 256

#: Fixed patterns by kind. They find what the plain patterns of the docstring's kinds find,
#: but cannot backtrack: a match starts only where a run of its characters begins (or the
#: last match ended), and quantifiers are possessive. Card runs of other than 16 to 19
#: digits would be dropped, and so are not matched.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a kind to occur in it.
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
KINDS = tuple(PATTERNS)
#: Kinds that terms may disclose.
PROTECTED = {**PATTERNS, "secret": r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{32,}+"}
_UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}"
_TERM = rf"[{_UNSPACED}]{{1,2}}+|[\p{{L}}&&[^{_UNSPACED}]]++"


def _luhn(digits: Column) -> Column:
    def value(i):
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    places = F.sequence(F.lit(0), F.length(digits) - 1)
    return F.aggregate(places, F.lit(0), lambda total, i: total + value(i)) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        small = lambda p: F.length(F.regexp_replace(p, "^0+(?=.)", "")) <= 3
        fits = lambda p: small(p) & (F.substring(F.concat(F.lit("000"), p), -3, 3).cast("int") <= 255)
        return F.forall(F.split(match, r"\."), fits)
    if kind == "card":
        return _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _plain(text: Column) -> Column:
    return F.translate(text, _MARKS, _OTHER * len(_MARKS))


def _parts(text: Column, pattern: str) -> Column:
    """What precedes the first match, then each match, a close mark and what follows it."""
    return F.split(F.regexp_replace(text, pattern, f"{_OPEN}$0{_CLOSE}"), _OPEN)


def _match(part: Column) -> Column:
    return F.substring_index(part, _CLOSE, 1)


_SPANS = "array<struct<start:int,end:int>>"


_ACTED = "array<struct<start:int,end:int,action:string>>"


def _spans(parts: Column, valid, action=None) -> Column:
    """Spans of the valid matches; taken ``_STEP`` at a time, so that lists stay short."""

    def add(state, part):
        end = state["pos"] + F.length(_match(part))
        more = [action(_match(part)).alias("action")] if action else []
        span = F.struct(state["pos"].alias("start"), end.alias("end"), *more)
        found = F.when(valid(_match(part)), F.concat(state["spans"], F.array(span)))
        return F.struct(
            (state["pos"] + F.length(part) - 1).alias("pos"), found.otherwise(state["spans"]).alias("spans")
        )

    def state(pos, spans):
        return F.struct(pos.alias("pos"), spans.alias("spans"))

    empty = F.array().cast(_ACTED if action else _SPANS)

    def add_many(total, at):
        few = F.aggregate(F.slice(parts, at, F.lit(_STEP)), state(total["pos"], empty), add)
        # The state of the inner fold is needed twice, so it is carried on as a whole.
        return F.aggregate(
            F.array(few),
            state(total["pos"], total["spans"]),
            lambda _, x: state(x["pos"], F.concat(total["spans"], x["spans"])),
        )

    folded = F.aggregate(
        F.sequence(F.lit(2), F.size(parts), F.lit(_STEP)), state(F.length(parts[0]), empty), add_many
    )
    return F.when(F.size(parts) > 1, folded["spans"]).otherwise(empty)


def base_spans(text: Column, kind: str) -> Column:
    """Spans of one kind in a text."""
    needs = _NEEDS[kind]
    found = _spans(_parts(text, PATTERNS[kind]), lambda m: _valid(kind, m))
    some = F.contains(text, F.lit(needs)) if needs else F.lit(True)
    return F.when(some & text.rlike(PATTERNS[kind]), found).otherwise(F.array().cast(_SPANS))


def with_base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus ``_text_`` and one list of spans per kind, named ``_email_`` and so on."""
    plain = docs.withColumn("_text_", _plain(text_or_empty(text)))
    return plain.select("*", *[base_spans(F.col("_text_"), k).alias(f"_{k}_") for k in KINDS])


def _without(text: Column, kinds) -> Column:
    for kind in kinds:
        text = F.regexp_replace(text, PROTECTED[kind], " ")
    return text


def _terms(text: Column) -> Column:
    """All terms in order, repeated ones as often as they occur."""
    return F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0))


def _contexts(lines: DataFrame, kind: str, reach: int) -> DataFrame:
    """``kind``, ``entity`` and ``near`` for every entity of a kind; no word is in two of them.

    What stands between two entities belongs to the first where both reach all of it.
    """
    parts = computed_once(lines, {"parts": _parts(F.col("line"), PROTECTED[kind])}, keep=[])
    valid = F.transform("parts", lambda p, i: F.when(i > 0, _valid(kind, _match(p))).otherwise(False))
    gaps = F.transform("parts", lambda p: F.substring_index(p, _CLOSE, -1))
    parts = computed_once(parts, {"valid": valid, "gaps": gaps})
    short = lambda gap, by: F.length(gap) <= by

    def before(i):
        gap = F.get("gaps", i - 1)
        taken = F.get("valid", i - 1) & short(gap, 2 * reach)
        cut = F.regexp_replace(F.right(gap, F.lit(reach + 1)), r"^\p{L}+", "")
        return F.when(taken, "").when(short(gap, reach), gap).otherwise(cut)

    def after(i):
        gap = F.get("gaps", i)
        both = F.coalesce(F.get("valid", i + 1), F.lit(False)) & short(gap, 2 * reach)
        cut = F.regexp_replace(F.left(gap, F.lit(reach + 1)), r"\p{L}+$", "")
        return F.when(both | short(gap, reach), gap).otherwise(cut)

    found = F.filter(F.sequence(F.lit(1), F.size("parts") - 1), lambda i: F.get("valid", i))
    one = lambda i: F.struct(
        _match(F.get("parts", i)).alias("entity"), F.concat(before(i), F.lit(" "), after(i)).alias("near")
    )
    each = parts.where(F.size("parts") > 1).select(F.inline(F.transform(found, one)))
    return each.select(F.lit(kind).alias("kind"), "entity", _without(F.col("near"), PROTECTED).alias("near"))


def disclosing_terms(
    docs: DataFrame,
    text: str = "text",
    least: int = LEAST,
    generalise: float = GENERALISE,
    reach: int = REACH,
) -> DataFrame:
    """``term``, ``kind`` and ``ratio`` of the terms whose PMI / IC reaches ``generalise``."""
    lines = docs.select(F.explode(F.split(_plain(text_or_empty(text)), "\n")).alias("line"))
    sensitive = stored(lines.where(F.col("line").rlike("|".join(f"(?:{p})" for p in PROTECTED.values()))), "sensitive-lines")
    found = reduce(DataFrame.unionAll, [_contexts(sensitive, kind, reach) for kind in PROTECTED])
    # Copies of a context are merged first, so that none is gathered anywhere.
    merged = found.groupBy("kind", "entity", "near").agg(F.count(F.lit(1)).alias("copies"))
    words = merged.select("kind", "copies", _terms(F.col("near")).alias("terms"))
    words = words.select("kind", "copies", "terms", F.posexplode("terms").alias("at", "term"))
    first = F.array_position("terms", F.col("term")) == F.col("at") + 1
    near = stored(
        words.groupBy("kind", "term").agg(F.sum("copies").alias("near"), F.count(F.when(first, 1)).alias("contexts")),
        "terms-near",
    )
    of_kind = near.groupBy("kind").agg(F.sum("near").alias("kind_words"))
    joint = stored(near.where(F.col("contexts") >= least).join(of_kind, "kind"), "joint-terms")
    if joint.isEmpty():
        return joint.select("term", "kind", F.lit(0.0).alias("ratio")).where("false")
    # Letters inside entities are no terms: addresses and secrets are the kinds that have any.
    holds = F.contains("line", F.lit("@")) | F.col("line").rlike("(?<![A-Za-z0-9])[A-Za-z0-9]{32}")
    outside = F.when(holds, _without(F.col("line"), ("email", "secret"))).otherwise(F.col("line"))
    everywhere = lines.select(F.explode(_terms(outside)).alias("term"))
    counts = stored(everywhere.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "term-counts")
    total = counts.agg(F.sum("n")).head()[0]
    scored = joint.join(counts, "term")
    p_kind = F.col("kind_words") / F.lit(total)
    pmi = F.log2(F.col("near") / F.col("n") / p_kind)
    # Where every word is near the kind, that says nothing and no term discloses it.
    ratio = F.when(p_kind < 1, pmi / -F.log2(p_kind)).otherwise(0.0)
    return scored.select("term", "kind", ratio.alias("ratio")).where(F.col("ratio") >= generalise)


def action_table(terms: DataFrame, remove: float = REMOVE) -> DataFrame:
    """``term`` and ``action``, what to do with it: its strongest kind, or ``remove``."""
    best = terms.groupBy("term").agg(F.max(F.struct("ratio", "kind")).alias("best"))
    action = F.when(F.col("best.ratio") >= remove, F.lit("remove")).otherwise(F.col("best.kind"))
    return best.select("term", action.alias("action"))


def term_actions(terms: DataFrame, remove: float = REMOVE) -> dict[str, str]:
    """``action_table`` as a mapping, for lists that are known to be short."""
    return {r["term"]: r["action"] for r in action_table(terms, remove).collect()}


def _as_table(docs: DataFrame, actions: Mapping[str, str] | DataFrame) -> DataFrame:
    if isinstance(actions, DataFrame):
        return actions
    return docs.sparkSession.createDataFrame(list(actions.items()), "term string, action string")


def _mark(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b"))


def _known_terms(docs: DataFrame, table: DataFrame, text: str) -> DataFrame:
    """``_mark_`` of each text that holds terms of ``table``, and these with their actions."""
    texts = docs.select(_plain(text_or_empty(text)).alias("text"))
    own = F.array_distinct(_terms(F.col("text")))
    present = texts.select(_mark(F.col("text")).alias("_mark_"), F.explode(own).alias("term"))
    present = present.withColumn("salt", F.pmod(F.col("_mark_.a"), F.lit(SALTS)).cast("int"))
    spread = table.select("term", "action", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    known = present.join(spread, ["term", "salt"]).groupBy("_mark_")
    known = known.agg(F.collect_set(F.struct("term", "action")).alias("pairs"))
    # Stored, so that both sides of the next join come from a shuffle and can be split there.
    return stored(known.select("_mark_", F.map_from_entries("pairs").alias("_actions_")), "texts-with-terms")


def _with_actions(docs: DataFrame, actions: Mapping[str, str] | DataFrame, text: str) -> DataFrame:
    """``docs`` plus ``_actions_``: a text's disclosing terms, null where it has none."""
    known = _known_terms(docs, _as_table(docs, actions), text)
    marked = docs.withColumn("_mark_", _mark(_plain(text_or_empty(text))))
    return marked.join(known, "_mark_", "left").select(*docs.columns, "_actions_")


def _replaced(text: Column, pattern: str, new) -> Column:
    """A text with ``new`` of each match in its place."""
    rest = lambda p: F.substring_index(p, _CLOSE, -1)
    # The parts are named once, as the text may itself be a long expression.
    changed = F.transform(_parts(text, pattern), lambda p, i: F.when(i > 0, F.concat(new(_match(p)), rest(p))).otherwise(p))
    return F.array_join(changed, "")


def _valid_replaced(text: Column, new) -> Column:
    """A text with ``new`` (of kind and match) for every valid match of a base kind."""
    for kind in KINDS:
        text = _replaced(text, PATTERNS[kind], lambda m, k=kind: F.when(_valid(k, m), new(k, m)).otherwise(m))
    return text


def with_all_spans(
    docs: DataFrame, actions: Mapping[str, str] | DataFrame, text: str = "text"
) -> DataFrame:
    """``with_base_spans`` plus ``_term_``: spans of disclosing terms, with their ``action``.

    ``actions`` is a table as ``action_table`` gives it, of any size, or a mapping.
    """
    based = with_base_spans(_with_actions(docs, actions, text), text)
    # Entities are blanked out in their own length, so that terms lie outside of them.
    masked = _valid_replaced(F.col("_text_"), lambda _, m: F.repeat(F.lit(" "), F.length(m)))
    parts = F.when(F.col("_actions_").isNotNull(), _parts(masked, _TERM))
    based = computed_once(based, {"_parts_": parts})
    action = lambda m: F.try_element_at("_actions_", F.lower(m))
    found = _spans(F.col("_parts_"), lambda m: action(m).isNotNull(), action)
    spans = F.when(F.col("_actions_").isNotNull(), found).otherwise(F.array().cast(_ACTED))
    return based.withColumn("_term_", spans).drop("_actions_", "_parts_")


def joined_actions() -> Column:
    """``action:start:end`` of the term spans, joined by commas."""
    return F.array_join(
        F.transform("_term_", lambda s: F.concat_ws(":", s["action"], s["start"], s["end"])), ","
    )


def joined_spans(kinds) -> Column:
    """``kind:start:end`` by kind as listed, then start, joined by commas."""


    def named(kind: str) -> Column:
        return F.transform(
            f"_{kind}_", lambda s: F.concat(F.lit(f"{kind}:"), s["start"], F.lit(":"), s["end"])
        )

    return F.array_join(F.concat(*[named(k) for k in kinds]), ",")


def sanitised(docs: DataFrame, actions: Mapping[str, str] | DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data as ``[kind]``, and terms removed or generalised.

    Where spans of two kinds overlap, the first kind listed is replaced. A label is one
    character until all is replaced, so that neither patterns nor terms see its letters.
    """
    label = dict(zip(PROTECTED, _LABELS))
    result = _with_actions(docs, actions, text)
    plain = _plain(F.col(text).cast("string"))
    result = result.withColumn("_text_", _valid_replaced(plain, lambda kind, _: F.lit(label[kind])))
    action = lambda m: F.try_element_at("_actions_", F.lower(m))
    new = lambda m: reduce(
        lambda made, kind: made.when(action(m) == kind, F.lit(label[kind])), label, F.when(action(m) == "remove", "")
    ).otherwise(m)
    replaced = F.when(F.col("_actions_").isNotNull(), _replaced(F.col("_text_"), _TERM, new))
    cleaned = F.coalesce(replaced, "_text_")
    for kind, mark in label.items():
        cleaned = F.replace(cleaned, F.lit(mark), F.lit(f"[{kind}]"))
    return result.withColumn(text, cleaned).select(*docs.columns)
