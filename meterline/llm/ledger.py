"""Quality rules as a ledger: every rule once, failure bits and measurements, then policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.functions.once import once

SPACE = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Each rule's failure as SQL over the measurements; its place here is its bit.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "2 * n_symbols > n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 15 * n_words",
    "shouting": "2 * n_capitals > word_chars",
}
BASE = ("few_words", "repeated_words")

#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "2024-1": BASE,
    "2024-2": (*BASE, "symbols", "repeated_lines"),
    "2025-1": tuple(RULES),
}
POLICY = "2025-1"


def mask(rules) -> int:
    """The bits of the named rules."""
    places = list(RULES)
    return sum(1 << places.index(name) for name in set(rules))


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the measurements of each text, by built-in expressions in one pass.

    Repeated three-word windows are found by sorting the windows' hashes with their
    places, so a text costs n log n at any length, and no row leaves its task.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    body = F.btrim(text, F.lit(SPACE))
    words = F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, r"[\x20\x09-\x0D]+"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("_text"), once(words, "_words"))
    lines = F.filter(F.split("_text", "\n", -1), lambda line: F.btrim(line, F.lit(SPACE)) != "")
    rows = rows.select("doc_id", "_text", "_words", once(lines, "_lines"))
    own = F.col("_words")
    windows = F.transform(own, lambda w, i: F.struct(F.xxhash64(w, F.get(own, i + 1), F.get(own, i + 2)).alias("h"), i.alias("p")))
    windows = F.sort_array(F.slice(windows, F.lit(1), F.greatest(F.size(own) - 2, F.lit(0))))
    size = F.length("_text")
    rows = rows.select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (size - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (size - F.length(F.translate("_text", CAPITALS, ""))).cast("long").alias("n_capitals"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        once(windows, "_windows"),
    )
    all_of = F.col("_windows")
    again = F.filter(all_of, lambda x, i: (x["h"] == F.get(all_of, i - 1)["h"]) | (x["h"] == F.get(all_of, i + 1)["h"]))
    rows = rows.withColumn("_again", F.sort_array(F.transform(again, lambda x: x["p"]))).drop("_windows")
    rows = rows.select("*", once(F.col("_again"), "_places")).drop("_again")
    places = F.col("_places")
    fresh = F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3))).cast("long"))
    return rows.withColumn("n_repeat_words", F.aggregate(fresh, F.lit(0).cast("long"), lambda a, x: a + x)).drop("_places")


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements of every row of ``docs`` (doc_id, text) and ``failed``, a bit for each failed rule.

    Words are runs of non-space characters. word_chars counts the characters in words,
    n_symbols those of ``SYMBOLS``, n_dup_lines the lines (with a word) equal to an
    earlier one, n_repeat_words the words in three-word windows that occur twice or
    more. A null text is empty: no words, which fails ``few_words`` alone. Rows stay as
    they are, equal or not. Further columns are ignored.
    """
    bits = sum((F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())), F.lit(0))
    return measured(docs).withColumn("failed", bits.cast("long"))


def passes(policy: str, failed: str = "failed") -> Column:
    """Whether a ledger row passes a policy: no measurement is taken again."""
    return F.col(failed).bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablation(book: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: rows that fail it, and rows that only it rejects.

    Rows are first counted by their failure bits, at most one sum per pattern of bits;
    the rest reads those few sums.
    """
    names = [name for name in RULES if name in POLICIES[policy]]
    patterns = book.groupBy(F.col("failed").bitwiseAND(F.lit(mask(names))).alias("bits")).agg(F.count("*").alias("n"))
    each = F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(mask([name])).alias("bit")) for name in names))
    flat = patterns.select("bits", "n", F.explode(each).alias("r")).select("bits", "n", "r.rule", "r.bit")
    total = lambda keep: F.coalesce(F.sum(F.when(keep, F.col("n"))), F.lit(0)).cast("long")
    return flat.groupBy("rule").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(F.col("bits") == F.col("bit")).alias("n_only"),
        total(F.col("bits") == 0).alias("n_kept"),
        total((F.col("bits") == 0) | (F.col("bits") == F.col("bit"))).alias("n_kept_without"),
    )
