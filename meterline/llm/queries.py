"""The registered queries of this package, with their production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.llm.decontam import contamination
from meterline.llm.ledger import BASE, POLICY, ablation, ledger, mask, passes
from meterline.llm.lines import repeated_lines
from meterline.llm.neardup import near_duplicates
from meterline.llm.notices import license_notices
from meterline.llm.pieces import encoded
from meterline.llm.prefix_tree import prefix_tree, turn_lists, with_openings
from meterline.llm.pu_quality import quality_scores
from meterline.llm.ranked import length_index, ranked
from meterline.llm.redirects import page_verdicts
from meterline.llm.scratch import Scratch
from meterline.llm.surrogates import pseudonymised
from meterline.llm.token_files import token_digests, token_lists, write_token_files
from meterline.llm.toxicity import toxicity_scores
from meterline.session import scratch_dir

MODEL = os.environ.get("METERLINE_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
TOKENIZER = os.environ.get("METERLINE_TOKENIZER", "/opt/tokenizers/word_bpe_49k.json")
#: The tokenizer parts letters from these marks wherever they stand.
MARKS = ".,;:!?()-"
KEY = os.environ.get("METERLINE_KEY", "a key for tests")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = ledger(table(spark, sf_dir, "documents"))
    base = F.col("failed").bitwiseAND(F.lit(mask(BASE))) != 0
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & passes(POLICY)).alias("kept"), "n_lines", "n_capitals", "failed",
    )


def rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ablation(ledger(table(spark, sf_dir, "documents")), POLICY)


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(table(spark, sf_dir, "documents"), Scratch(spark, "op2"), key=KEY)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), MODEL)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark, "op4"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "op5"), k=4)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    removed = repeated_lines(docs, Scratch(spark, "op7"), least=1)
    lines = docs.select("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines"))
    return lines.join(removed, "doc_id", "left").select(
        "doc_id",
        "n_lines",
        F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed")).cast("long").alias("n_removed"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
    )


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_verdicts(table(spark, sf_dir, "pages"), Scratch(spark, "op8"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_notices(table(spark, sf_dir, "documents"))


def op11_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = with_openings(turn_lists(table(spark, sf_dir, "conversations")))
    return prefix_tree(lists, Scratch(spark, "op11"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op12")
    return ranked(length_index(table(spark, sf_dir, "documents"), scratch), table(spark, sf_dir, "benchmark"), scratch)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "op13")
    write_token_files(table(spark, sf_dir, "documents"), path, TOKENIZER, by_word=True, marks=MARKS)
    return token_digests(token_lists(spark, path))


QUERIES = {
    query.__name__: query
    for query in (
        op1_quality_rules, op2_pii_surrogates, op3_sentencepiece, op4_decontamination, op5_near_duplicates,
        op6_quality_classifier, op7_line_dedup, op8_url_filter, op9_toxicity, op10_license_notices,
        op11_prefix_tree, op12_ranked_search, op13_token_files, rule_ablation,
    )
}
