"""Quality rules and a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Method: words and pairs of neighbouring words are hashed into 2^16 buckets.
The raw corpus is one multinomial over the buckets, counted over all texts;
the trusted target is another, counted over labelled documents of good quality
that are not toxic. A text's score is the mean over its features of
log p_trusted - log p_raw, so length cancels out. A bucket's trusted share is
drawn to the corpus's by PRIOR features, so that what is seen seldom, as in
the trusted documents alone, counts for little. A document is kept if no base
rule rejects it and its score is at least MIN_SCORE, a constant.

Sizes: the trusted ids are a bounded sample of labelled rows (TRUSTED_ROWS,
smallest hash of doc_id first), so they can be broadcast; everything else reads
all rows. Feature counts are summed in 2^16 groups before they are shuffled,
and the ratios reach the scoring scan as one array of fixed size. Scoring
shuffles nothing: texts stay where they are read, and a window of words is
compared by its 64-bit hash within its text.

Cases: a null text has no words and fails the base rules; a text without
features scores 0; without trusted rows all scores are 0; a null doc_id is
kept with its row; repeated rows are counted and returned as often as they
come; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
TRUSTED_ROWS = 50_000
PRIOR = 30
MIN_SCORE = -0.08
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
SPACE = "[ \\t-\\r]+"
SYMBOLS = "[#*$%&|<>]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def _bucket(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(BUCKETS)).cast("int")


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def features(h: Column) -> Column:
    """Buckets of the words and word pairs of an array of word hashes."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(h) - 1), lambda i: _bucket(F.get(h, i - 1), F.get(h, i)))
    return F.when(F.size(h) > 1, F.concat(F.transform(h, lambda x: _bucket(x)), pairs)).otherwise(F.transform(h, lambda x: _bucket(x)))


def _covered(windows: Column, width: int) -> Column:
    """Words in windows whose hash occurs twice or more."""

    def count(marked: Column) -> Column:
        last = F.size(marked) - 1
        same = lambda x, k: F.when(k >= 0, F.get(marked, k)["h"] == x["h"]).otherwise(False)
        flagged = F.filter(F.transform(marked, lambda x, k: F.when(same(x, k - 1) | F.when(k < last, same(x, k + 1)).otherwise(False), x["i"])), lambda i: i.isNotNull())
        gaps = lambda p: F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), F.lit(width), lambda n, k: n + F.least(F.lit(width), F.get(p, k) - F.get(p, k - 1)))
        return _let(F.array_sort(flagged), gaps)

    marked = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_let(marked, count))


def repeat_words(h: Column, width: int = WINDOW) -> Column:
    window = lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(width)))
    windows = F.transform(F.sequence(F.lit(0), F.size(h) - width), window)
    return F.when(F.size(h) > width, _let(windows, lambda w: _covered(w, width))).otherwise(0).cast("long")


def trusted_ids(labels: DataFrame, rows: int = TRUSTED_ROWS) -> DataFrame:
    """At most this many doc_ids of good quality that are not toxic."""
    good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def log_ratios(docs: DataFrame, labels: DataFrame, rows: int = TRUSTED_ROWS) -> Column:
    """An array constant: for each bucket log p_trusted - log p_raw, to four places.

    Its 2^16 numbers pass through the driver, whatever the input, and stand in
    the plan as one literal, so that no row carries them.
    """
    trusted = F.broadcast(trusted_ids(labels, rows).select(F.col("doc_id").alias("_trusted"), F.lit(1).alias("t")))
    hashed = _let(F.transform(words(F.col("text")), lambda w: F.xxhash64(w)), features)
    each = docs.select("doc_id", "text").join(trusted, F.col("doc_id") == F.col("_trusted"), "left").select(F.explode(hashed).alias("b"), F.coalesce("t", F.lit(0)).alias("t"))
    counts = each.groupBy("b").agg(F.count("*").alias("raw"), F.sum("t").alias("target"))
    found = {r["b"]: (r["raw"], r["target"]) for r in counts.collect()}
    n_raw, n_target = (sum(x[k] for x in found.values()) for k in (0, 1))
    if not n_target:
        return F.split(F.lit(",".join(["0"] * BUCKETS)), ",").cast("array<double>")
    share = n_target / n_raw
    every = (found.get(b, (0, 0)) for b in range(BUCKETS))
    ratios = (math.log((target + PRIOR * share) / ((raw + PRIOR) * share)) for raw, target in every)
    return F.split(F.lit(",".join(f"{x:.4f}" for x in ratios)), ",").cast("array<double>")


def _metrics(labels: DataFrame, docs: DataFrame) -> Column:
    """For a row with text: its words, repeated words and score, as one struct."""
    ratios = log_ratios(docs, labels)
    hashes = F.transform(words(F.col("text")), lambda w: F.xxhash64(w))

    def score(found: Column) -> Column:
        return F.aggregate(found, F.lit(0.0), lambda s, b: s + F.get(ratios, b)) / F.size(found)

    def of(h: Column) -> Column:
        scored = F.when(F.size(h) > 0, _let(features(h), score)).otherwise(0.0)
        return F.struct(F.size(h).cast("long").alias("n_words"), repeat_words(h).alias("n_repeat_words"), scored.alias("score"))

    return _let(hashes, of)


_FAILED = f"w.n_words < {MIN_WORDS} OR 100 * w.n_repeat_words > {MAX_REPEAT_PERCENT} * w.n_words"


def score_documents(docs: DataFrame, labels: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    out = docs.select(
        "doc_id",
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _metrics(labels, docs).alias("w"),
    )
    kept = ~F.col("base_failed") & (F.col("w.score") >= min_score)
    out = out.withColumn("base_failed", F.expr(_FAILED)).withColumn("kept", kept)
    return out.select("doc_id", "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words", "base_failed", "kept", "w.score")


def keep_good(docs: DataFrame, labels: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of docs that are kept, with all their columns; nothing is joined or shuffled."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), _metrics(labels, docs).alias("w"))
    return rows.where(f"NOT ({_FAILED}) AND w.score >= {min_score}").select("_row.*")
