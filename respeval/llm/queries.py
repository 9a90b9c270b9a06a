"""One query per operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from respeval.llm import alignment, collocations, decontam, langid, licenses, linededup, minhash, mixing, pii, prefixtree, quality, substrings, toxicity
from respeval.llm.tables import held_out, read, stored


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    cleaned = linededup.without_boilerplate(docs, counts=True)
    return cleaned.select(
        "doc_id",
        F.col("_lines_").alias("n_lines"),
        F.col("_dropped_").alias("n_dropped"),
        F.length("text").cast("long").alias("kept_chars"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    rates = mixing.document_rates(docs, mixing.labelled_domains(labels), mixing.TARGETS)
    shares = [F.col("posteriors")[name].alias(f"p_{name}") for name in sorted(mixing.TARGETS)]
    return rates.select("doc_id", "n_tokens", *shares, "rate")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), words=2)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    profiles = langid.train(docs.where(~held_out(F.col("doc_id"))))
    named = langid.predict(docs, profiles)
    return named.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    terms = stored(pii.action_table(pii.disclosing_terms(docs)), "disclosing-terms")
    spans = pii.with_all_spans(docs, terms)
    return spans.select(
        "doc_id",
        *[F.size(f"_{kind}_").cast("long").alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(pii.joined_spans(pii.KINDS), 256).alias("base_sha256"),
        pii.joined_spans([*pii.KINDS, "term"]).alias("spans"),
        F.size("_term_").cast("long").alias("n_term"),
        sum((F.size(f"_{kind}_") for kind in (*pii.KINDS, "term")), F.lit(0)).cast("long").alias("n_spans"),
        pii.joined_actions().alias("term_actions"),
    )


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(read(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.document_licenses(read(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    return decontam.find_items(docs, items)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(read(spark, sf_dir, "documents"))


def op11_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtree.similar_documents(read(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(read(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_mixing": op2_mixing,
    "op3_minhash": op3_minhash,
    "op4_toxicity": op4_toxicity,
    "op5_language_id": op5_language_id,
    "op6_pii": op6_pii,
    "op7_suffix_array": op7_suffix_array,
    "op8_licenses": op8_licenses,
    "op9_decontamination": op9_decontamination,
    "op10_quality_rules": op10_quality_rules,
    "op11_prefix_tree_join": op11_prefix_tree_join,
    "op12_token_alignment": op12_token_alignment,
    "op13_collocations": op13_collocations,
}


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query of this subpackage, by name."""
    import corpus_pipeline

    return QUERIES | {"pipeline": corpus_pipeline.run}
