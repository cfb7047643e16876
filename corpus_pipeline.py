"""The corpus pipeline: stages over ``documents``, each written and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.llm.decontam import contamination
from meterline.llm.lines import repeated_lines, without_lines
from meterline.llm.neardup import near_duplicates
from meterline.llm.pieces import encoded
from meterline.llm.pu_quality import good_rows
from meterline.llm.queries import MODEL, table
from meterline.llm.scratch import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are scored as empty; repeated rows score alike and null ids like
    any. Without enough labels for a model all rows stay. Further columns stay as they are.
    """
    return good_rows(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; so do documents of which no word is left. ``n_chars`` follows the text.

    Rows of a null id or text keep all lines, and a document that had no word to begin with
    stays. Rows of one id are one document, so each row loses the same line numbers.
    """
    removed = repeated_lines(docs, Scratch(spark, "lines"), least=1)
    changed = without_lines(docs.withColumn(_BEFORE, F.length("text")), removed)
    blank = F.btrim("text", F.lit(" \t\n\u000b\f\r")) == ""
    kept = changed.where(F.coalesce(~blank | (F.col(_BEFORE) == F.length("text")), F.lit(True))).drop(_BEFORE)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


_BEFORE = "_characters_before_line_dedup"


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, 0.8) stays.

    Of rows with equal id and text one stays as well. Wordless documents and rows of a null
    id are linked with nothing and stay, equal or not; rows of one id with different texts
    are one document.
    """
    gone = near_duplicates(docs, Scratch(spark, "near")).where("not kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    # Few ids have several rows; only those are shuffled with their texts.
    several = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    once = left.join(several, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return left.join(several, "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark items go.

    Null and empty texts hold no item and stay, as do rows of a null id. Of rows with one
    id all go if one of them is contaminated.
    """
    found = contamination(docs, table(spark, sf_dir, "benchmark"), Scratch(spark, "bench"))
    gone = found.where("contaminated").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document left, with a check that they decode to its text.

    Null and empty texts have no ids; there is one row for each row left.
    """
    return encoded(docs, MODEL)


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pieces", pieces),
]

#: A trained classifier and its threshold have no SQL form; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.table(docs)
    return docs
