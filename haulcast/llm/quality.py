"""Operator 3: quality rules judged per host, in DataFrame expressions only.

Every document is measured (words, symbols, repeated lines, words in repeated
windows of eight). A rule fails a document by a fixed ratio of these figures.
For each host and rule, failures are counted over all its documents and the
rate is shrunk towards the mean of all hosts: a beta prior is fitted to the
hosts' rates by moments, so that a host of three documents is not judged by
them alone. A host whose shrunk rate passes ``HOST_LIMIT`` for any rule is
refused, and its verdict is joined back to its documents.

A document is kept if it fails neither a base rule (too short, too repetitive)
nor the symbol rule, and its host is not refused.

Defined cases: a null text has no words and fails the base rules; a null host
is a host of its own; repeated rows are measured and counted as they come; an
empty table gives no rows. Documents stay whole: no prefix, no cap on words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulcast.llm.tables import col
from haulcast.staging import stage_table

# Word class and symbols.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT = 30  # percent of words
MAX_SYMBOLS = 25  # per 100 words
MAX_DUP_LINES = 50  # percent of lines with a word

#: Documents that the prior weighs as much as, at least: so many must speak for a host against all others.
PRIOR_WEIGHT = 10.0
#: Shrunk share of failing documents beyond which a host is refused.
HOST_LIMIT = 0.5

RULES = ("short", "repeats", "symbols", "dup_lines")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the columns of MEASURES, ``n_lines`` (lines with a word) and one boolean per rule.

    Arrays stand in columns of their own before lambdas read them, so that
    each is made once; documents without a repeated window skip the sorting.
    """
    kept = df.drop(*MEASURES, "n_lines", *RULES)
    whole = F.coalesce(col(kept, text), F.lit(""))
    out = kept.withColumn("__words", F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: F.length(_without(x, BLANKS)) > 0)
    places = F.sequence(F.lit(1), F.size("__words") - (WINDOW - 1))
    windows = F.when(
        F.size("__words") >= WINDOW, F.transform(places, lambda i: F.xxhash64(F.slice("__words", i, WINDOW)))
    )
    out = out.withColumns(
        {
            "__lines": lines,
            "__windows": windows,
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(_without(whole, BLANKS)).cast("long"),
            "n_symbols": (F.length(whole) - F.length(_without(whole, SYMBOLS))).cast("long"),
        }
    ).drop("__words")
    again = F.size("__windows") > F.size(F.array_distinct("__windows"))
    by_hash = F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumns(
        {
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__by_hash": F.when(again, by_hash),
        }
    ).drop("__lines", "__windows")
    # Neighbours in the order of hashes that share a hash mark both their places.
    s = F.col("__by_hash")
    same = F.transform(
        s,
        lambda x, i: F.when(
            (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]), x["i"]
        ),
    )
    out = out.withColumn("__places", F.sort_array(F.array_compact(same))).drop("__by_hash")
    p = F.col("__places")
    covered = F.aggregate(
        F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0),
        lambda total, x: total + x,
    )
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__places")
    return out.withColumns(
        {
            "short": F.col("n_words") < MIN_WORDS,
            "repeats": 100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"),
            "symbols": 100 * F.col("n_symbols") > MAX_SYMBOLS * F.col("n_words"),
            "dup_lines": 100 * F.col("n_dup_lines") > MAX_DUP_LINES * F.col("n_lines"),
        }
    )


def host_rates(measured: DataFrame, host: str = "source") -> DataFrame:
    """(host, rule, n, failed, rate): failures of each rule per host, the rate shrunk by the fitted beta prior."""
    failed = [F.sum(F.col(r).cast("long")).alias(r) for r in RULES]
    counts = measured.groupBy(col(measured, host).alias("host")).agg(F.count("*").alias("n"), *failed)
    by_rule = counts.unpivot(["host", "n"], list(RULES), "rule", "failed")
    raw = F.col("failed") / F.col("n")
    prior = by_rule.groupBy("rule").agg(F.avg(raw).alias("m"), F.var_pop(raw).alias("v"))
    # Moments of a beta distribution; its weight is without bound where all hosts agree.
    weight = F.when(F.col("v") > 0, F.greatest(F.col("m") * (1 - F.col("m")) / F.col("v") - 1, F.lit(PRIOR_WEIGHT)))
    shrunk = F.when(weight.isNull(), F.col("m")).otherwise(
        (F.col("failed") + F.col("m") * weight) / (F.col("n") + weight)
    )
    return by_rule.join(prior, "rule").select("host", "rule", "n", "failed", shrunk.alias("rate"))


def judge(measured: DataFrame, host: str = "source") -> DataFrame:
    """``measured`` with ``base_failed``, ``host_failed`` and ``kept``. Measures are written once, then read twice."""
    staged = stage_table(measured.drop("base_failed", "host_failed", "kept"), "quality")
    rates = host_rates(staged, host)
    worst = rates.groupBy("host").agg((F.max("rate") > HOST_LIMIT).alias("host_failed"))
    worst = stage_table(worst, "quality-hosts").withColumnRenamed("host", "__host")
    base_failed = F.col("short") | F.col("repeats")
    return (
        staged.join(worst, col(staged, host).eqNullSafe(F.col("__host")))
        .drop("__host")
        .withColumn("base_failed", base_failed)
        .withColumn("kept", ~(F.col("base_failed") | F.col("symbols") | F.col("host_failed")))
    )
