"""Mixing documents to target weights with soft domain membership.

A classifier fitted on a labelled table predicts for every document how likely each domain
is. Every document then gets a nonnegative rate, such that the expected tokens of each
domain, summed over rate x tokens x posterior, match the target weights in the least
squares sense. The rates are found by projected gradient descent over the whole table: each
step is one aggregation that returns one sum per domain, and the rate of a document after
any number of steps is an expression of its posteriors alone. So nothing but the domains'
sums passes the driver, and a step moves no rows.

Only DataFrame functions are used. The classifier is multinomial naive Bayes over hashed
words, counted on labelled rows (an expected ``SAMPLE_ROWS`` of them); its table has
``BUCKETS`` numbers per domain and goes to tasks as a literal. Words of one text are not
independent, so a text counts as at most ``EVIDENCE`` words of evidence.

Null and empty texts have no tokens; their posteriors are the domains' shares of the
labelled rows. Domains without a target have target 0. Repeated rows each have a rate.
Labels for one document that disagree are both learned from. Without labelled rows or
tokens, every rate is 1. Documents may have any other columns.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respeval.functions.once import computed_once
from respeval.llm.tables import stored, text_or_empty, uniform

BUCKETS = 4096
EVIDENCE = 30
SAMPLE_ROWS = 20_000
STEPS = 40
TOLERANCE = 1e-4


@dataclass(frozen=True)
class Classifier:
    """Log probabilities of hashed words, and of the domains themselves."""

    domains: tuple[str, ...]
    priors: tuple[float, ...]
    words: tuple[tuple[float, ...], ...]


def _buckets(buckets: int) -> Column:
    words = F.array_remove(F.split(F.lower(text_or_empty()), r"[\x20\x09-\x0D]+"), "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))


def train(
    docs: DataFrame,
    domains: DataFrame,
    sample_rows: int = SAMPLE_ROWS,
    buckets: int = BUCKETS,
) -> Classifier | None:
    """Fit on the documents that ``domains`` (``doc_id``, ``domain``) labels."""
    labelled = domains.where(F.col("domain").isNotNull()).select("doc_id", "domain").distinct()
    total = labelled.count()
    texts = docs.select("doc_id", "text")
    if total > sample_rows:
        drawn = uniform(F.col("doc_id"), 2) < sample_rows / total
        labelled, texts = labelled.where(drawn), texts.where(drawn)
    rows = texts.join(labelled, "doc_id").select("domain", _buckets(buckets).alias("bucket"))
    rows = rows.select("domain", F.explode_outer("bucket").alias("bucket"), F.col("bucket").isNull().alias("_"))
    counts = rows.groupBy("domain", "bucket").agg(F.count(F.lit(1)).alias("n")).collect()
    shares = texts.join(labelled, "doc_id").groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()
    if not shares:
        return None
    names = sorted(r["domain"] for r in shares)
    size = {r["domain"]: r["n"] for r in shares}
    seen = {name: [1.0] * buckets for name in names}
    for row in counts:
        if row["bucket"] is not None:
            seen[row["domain"]][row["bucket"]] += row["n"]
    logs = []
    for name in names:
        whole = sum(seen[name])
        logs.append(tuple(math.log(c / whole) for c in seen[name]))
    return Classifier(
        tuple(names),
        tuple(math.log(size[name] / sum(size.values())) for name in names),
        tuple(logs),
    )


def _numbers(values: Sequence[float]) -> Column:
    """A literal array; one text constant, however long."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def with_posteriors(docs: DataFrame, model: Classifier, evidence: int = EVIDENCE) -> DataFrame:
    """``docs`` plus ``_tokens_`` and ``_posteriors_``, one number per domain."""
    held = docs.withColumn("_words_", _buckets(len(model.words[0])))

    def evidence_for(table) -> Column:
        logs = _numbers(table)
        return F.aggregate("_words_", F.lit(0.0), lambda total, w: total + F.get(logs, w))

    sums = [evidence_for(table) for table in model.words]
    scored = held.select(
        *docs.columns, F.size("_words_").cast("long").alias("_tokens_"), F.array(*sums).alias("_sums_")
    )
    weight = F.lit(float(evidence)) / F.greatest(F.col("_tokens_"), F.lit(evidence))
    logits = F.zip_with("_sums_", _numbers(model.priors), lambda s, prior: s * weight + prior)
    scored = scored.withColumn("_sums_", logits)
    odds = F.transform("_sums_", lambda x: F.exp(x - F.array_max("_sums_")))
    scored = scored.withColumn("_sums_", odds)
    whole = F.aggregate("_sums_", F.lit(0.0), lambda total, x: total + x)
    return scored.select(
        *docs.columns, "_tokens_", F.transform("_sums_", lambda x: x / whole).alias("_posteriors_")
    )


def fit_rates(
    scored: DataFrame,
    model: Classifier,
    targets: Mapping[str, float],
    steps: int = STEPS,
    tolerance: float = TOLERANCE,
) -> tuple[Column, list[float]]:
    """The rate of a document as an expression of its ``_posteriors_``; the shares reached.

    ``scored`` needs ``_tokens_`` and ``_posteriors_``; it is read once per step, so it
    should be a stored table. Shares are tokens of a domain over all tokens of the input.
    """
    n = len(model.domains)
    whole = sum(max(targets.get(d, 0.0), 0.0) for d in model.domains)
    goal = [max(targets.get(d, 0.0), 0.0) / whole if whole else 1 / n for d in model.domains]
    share = [F.col("_posteriors_")[d] for d in range(n)]
    tokens = F.col("_tokens_").cast("double")
    first = scored.agg(
        F.sum(tokens).alias("tokens"),
        *[F.sum(tokens * share[d]).alias(f"mass_{d}") for d in range(n)],
        *[
            F.sum(tokens * share[i] * share[j]).alias(f"moment_{i}_{j}")
            for i in range(n)
            for j in range(n)
        ],
    ).first()
    total = first["tokens"] or 0.0
    if total <= 0:
        return F.lit(1.0), goal
    # Rare domains weigh as much as common ones; the step is one over a bound of the
    # largest eigenvalue (the largest row sum) of the weighted second moments.
    weights = [total / max(first[f"mass_{d}"], total * 1e-6) for d in range(n)]
    largest = max(
        sum(abs(first[f"moment_{i}_{j}"]) for j in range(n)) / total * weights[i] for i in range(n)
    )
    rate, reached = F.lit(1.0), [first[f"mass_{d}"] / total for d in range(n)]
    for _ in range(steps):
        gaps = [reached[d] - goal[d] for d in range(n)]
        if max(abs(g) for g in gaps) <= tolerance:
            break
        move = sum(F.lit(weights[d] * gaps[d] / largest) * share[d] for d in range(n))
        rate = F.greatest(F.lit(0.0), rate - move)
        sums = scored.agg(*[F.sum(rate * tokens * share[d]).alias(f"mass_{d}") for d in range(n)]).first()
        before, reached = reached, [sums[f"mass_{d}"] / total for d in range(n)]
        if max(abs(a - b) for a, b in zip(before, reached)) <= tolerance / 100:
            break
    return rate, reached


def mixed(
    docs: DataFrame,
    domains: DataFrame,
    targets: Mapping[str, float],
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """The documents with a rate above zero, with that ``rate``; the others have no share.

    A column of that name is replaced.
    """
    model = train(docs, domains, sample_rows)
    if model is None:
        return docs.withColumn("rate", F.lit(1.0))
    scored = with_posteriors(docs, model)
    rate, _ = fit_rates(stored(scored.select("_tokens_", "_posteriors_"), "posteriors"), model, targets)
    columns = [c for c in docs.columns if c != "rate"]
    # The rate reads the posteriors very often; a filter on it must not copy what makes them.
    return computed_once(scored, {"rate": rate}, columns).where("rate > 0")


def document_rates(
    docs: DataFrame, domains: DataFrame, targets: Mapping[str, float], sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``posteriors`` by domain name, and ``rate``."""
    model = train(docs, domains, sample_rows)
    names = list(model.domains) if model else []
    if model is None:
        none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
        tokens = F.size(_buckets(BUCKETS)).cast("long")
        return docs.select("doc_id", tokens.alias("n_tokens"), none.alias("posteriors"), F.lit(1.0).alias("rate"))
    scored = stored(with_posteriors(docs.select("doc_id", "text"), model).drop("text"), "posteriors")
    rate, _ = fit_rates(scored, model, targets)
    named = F.map_from_arrays(F.array(*[F.lit(x) for x in names]), "_posteriors_")
    return scored.select(
        "doc_id", F.col("_tokens_").alias("n_tokens"), named.alias("posteriors"), rate.alias("rate")
    )


#: Domains of the labelled table, and the share of all tokens each should have.
TARGETS = {"good": 0.87, "poor": 0.1, "toxic": 0.03}


def labelled_domains(labels: DataFrame) -> DataFrame:
    """``doc_id`` and ``domain``: toxic, good or poor; null labels give no domain."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good")
    return labels.select("doc_id", domain.when(F.col("quality") == 0, "poor").alias("domain"))
