"""Quality rules: a threshold table compiled into one projection.

Counts and verdict are Spark expressions over the row's own text; nothing is
shuffled and no user function runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FUNCTION_WORDS, packed_rows, unpacked_rows, words

@dataclass(frozen=True)
class Rule:
    """A document passes if ``lo <= metric <= hi`` (a missing bound is open)."""

    metric: str
    lo: float | None = None
    hi: float | None = None


RULES = (
    Rule("mean_word_chars", 2.0, 15.0),
    Rule("symbol_ratio", hi=0.10),
    Rule("stop_ratio", lo=0.015),
    Rule("dup_line_ratio", hi=0.50),
    Rule("repeat_ratio", hi=0.50),
)
MIN_WORDS = 50


def _repeat_words(hashes: Column) -> Column:
    """Words inside a 3-word window that occurs twice or more.

    Windows are compared by their 64-bit hash within one document. Sorting
    (hash, position) puts equal windows side by side in n log n steps.
    """
    keyed = F.sort_array(F.transform(hashes, lambda h, i: F.concat(F.lpad(F.hex(h), 16, "0"), F.lpad(i.cast("string"), 10, "0"))))

    def twice(xs: Column) -> Column:
        same = lambda x, i: F.substring(x, 1, 16) == F.substring(F.get(xs, i), 1, 16)
        return F.filter(xs, lambda x, i: F.coalesce(same(x, i - 1), F.lit(False)) | F.coalesce(same(x, i + 1), F.lit(False)))

    # A one-element array holds the sorted keys, so that they are computed once and not for each element.
    marked = F.flatten(F.transform(F.array(keyed), twice))
    places = F.sort_array(F.transform(marked, lambda x: F.substring(x, 17, 10).cast("int")))
    state = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    count = F.aggregate(
        places, state,
        lambda s, p: F.struct((s["n"] + p + 3 - F.greatest(p, s["end"])).alias("n"), (p + 3).alias("end")),
        lambda s: s["n"],
    )
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), count).otherwise(F.lit(0)).cast("long")


def rule_counts(df: DataFrame) -> DataFrame:
    """``df`` (text and columns that do not begin with _) with a struct column ``_rules`` of the counts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    step = df.withColumn("_w", words(F.col("text")))
    tokens = F.col("_w")
    windows = F.when(
        F.size(tokens) > 2,
        F.transform(F.slice(tokens, 1, F.greatest(F.size(tokens) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(tokens, i + 1), F.get(tokens, i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    step = step.withColumn("_h", windows)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    step = step.withColumn("_l", lines)
    counts = F.struct(
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_h")).alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        F.size(F.filter("_w", lambda w: F.lower(w).isin(FUNCTION_WORDS))).cast("long").alias("n_stop_words"),
    )
    # Exploding a one-element array keeps a later filter on the counts from pulling them apart and recomputing them.
    return step.withColumn("_rules", F.explode(F.array(counts))).drop("_w", "_h", "_l")


def metrics(counts: Column) -> dict[str, Column]:
    per_word = lambda c: F.when(counts["n_words"] > 0, counts[c] / counts["n_words"]).otherwise(F.lit(0.0))
    return {
        "mean_word_chars": per_word("word_chars"),
        "symbol_ratio": per_word("n_symbols"),
        "stop_ratio": per_word("n_stop_words"),
        "repeat_ratio": per_word("n_repeat_words"),
        "dup_line_ratio": F.when(counts["n_lines"] > 0, counts["n_dup_lines"] / counts["n_lines"]).otherwise(F.lit(0.0)),
    }


def verdict(counts: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    known, passed = metrics(counts), F.lit(True)
    for rule in rules:
        if rule.lo is not None:
            passed = passed & (known[rule.metric] >= rule.lo)
        if rule.hi is not None:
            passed = passed & (known[rule.metric] <= rule.hi)
    return passed


def base_failed(counts: Column) -> Column:
    return (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])


def apply_rules(df: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed and kept for every row.

    A null or empty text has no words and fails the base rule. Repeated rows are judged
    one by one; an empty table gives no rows; other columns are not read.
    """
    own = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counts = F.col("_rules")
    return rule_counts(own).select(
        "doc_id", "_rules.n_words", "_rules.word_chars", "_rules.n_symbols", "_rules.n_dup_lines", "_rules.n_repeat_words",
        base_failed(counts).alias("base_failed"),
        (~base_failed(counts) & verdict(counts, rules)).alias("kept"),
    )


def keep_good(df: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that pass, with their own columns, whatever these are called.

    Null and empty texts have no words, so they go. Each of several equal rows passes or goes like the others. An empty table gives no rows.
    """
    counts = F.col("_rules")
    found = rule_counts(packed_rows(df, text=F.col(text_col)))
    return unpacked_rows(found.where(~base_failed(counts) & verdict(counts, rules)), df.columns)


ORACLE = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) > 2),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM p),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g WHERE c > 1) GROUP BY doc_id),
c AS (
  SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         len(l) AS n_lines, len(list_filter(w, lambda x: lower(x) IN (STOPS))) AS n_stop
  FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 2.0 AND 15.0 AND n_symbols / n_words <= 0.10
         AND n_stop / n_words >= 0.015 AND (CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END) <= 0.50
         AND n_repeat_words / n_words <= 0.50 AS kept
FROM b
""".replace("STOPS", ", ".join(f"'{w}'" for w in FUNCTION_WORDS))
