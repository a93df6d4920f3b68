"""Quality rules: hashed n-gram log-likelihood ratio, with DataFrame operations only.

Words and word pairs are hashed into a fixed number of bins.  Two multinomials over the
bins are counted, one on trusted documents and one on the whole corpus; a document's score
is the sum of log(p_trusted / p_corpus) over its n-grams, divided by their number.  Every
document is held against one threshold, a low percentile of the trusted documents' own
scores.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage_table

SPACE = r"[\x20\x09-\x0D]"
N_BINS = 10_000
#: Trusted ids that are broadcast at most, and scores that come to the driver for a percentile.
BROADCAST_IDS = 1_000_000
BRACKET_ROWS = 10_000


def word_columns(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds words (of the whole text) and word_hashes; a null text has none."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")
    return docs.withColumn("words", words).withColumn("word_hashes", F.transform("words", lambda w: F.xxhash64(w)))


def ngram_bins(n_bins: int) -> Column:
    """Bins of all words and word pairs; needs word_hashes."""
    h = F.col("word_hashes")
    pairs = F.when(
        F.size(h) > 1,
        F.transform(F.sequence(F.lit(0), F.size(h) - 2), lambda i: F.pmod(F.xxhash64(F.get(h, i), F.get(h, i + 1)), F.lit(n_bins)).cast("int")),
    ).otherwise(F.array().cast("array<int>"))
    return F.concat(F.transform(h, lambda x: F.pmod(x, F.lit(n_bins)).cast("int")), pairs)


def add_base_columns(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the base rules' columns; needs words and word_hashes.

    For the words in repeated three-word windows, only texts that repeat a window sort
    theirs: by hash, equal windows stand side by side; by place, each repeated one adds
    the words up to the start of the next, three at most.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    h, hashes, order, places = F.col("word_hashes"), F.col("_windows"), F.col("_order"), F.col("_places")
    windows = F.when(F.size(h) > 2, F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2))))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    return (
        docs.withColumn("n_words", F.size("words").cast("long"))
        .withColumn("word_chars", F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.length(w)))
        .withColumn("n_symbols", F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"))
        .withColumn("_lines", lines)
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("_windows", windows)
        .withColumn("_order", F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
        .withColumn("_places", F.filter(order, lambda w, k: w["h"].eqNullSafe(F.get(order, k - 1)["h"]) | w["h"].eqNullSafe(F.get(order, k + 1)["h"])))
        .withColumn("_places", F.sort_array(F.transform(places, lambda w: w["i"])))
        .withColumn("_gaps", F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - p, F.lit(3)))))
        .withColumn("n_repeat_words", F.coalesce(F.aggregate("_gaps", F.lit(0).cast("long"), lambda n, x: n + x), F.lit(0).cast("long")))
        .withColumn("base_failed", (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))
        .drop("_lines", "_windows", "_order", "_places", "_gaps")
    )


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of all trusted documents, each once."""
    return labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()


def _bin_counts(docs: DataFrame, n_bins: int) -> np.ndarray:
    """How often each bin occurs in the texts of ``docs``; only these n_bins numbers reach the driver."""
    rows = word_columns(docs).select(F.explode(ngram_bins(n_bins)).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = np.zeros(n_bins)
    counts[[r["bin"] for r in rows]] = [r["n"] for r in rows]
    return counts


def fit_log_ratios(docs: DataFrame, trusted: DataFrame, n_bins: int = N_BINS, smoothing: float = 1.0) -> np.ndarray:
    """log(p_trusted / p_corpus) of every bin; the corpus is all of ``docs`` (doc_id, text), duplicates included.

    ``trusted`` has unique ids.  The corpus is counted without a join.  Trusted rows are
    picked by a semi-join: up to BROADCAST_IDS ids are counted and broadcast, so that no
    text is shuffled; more are left to Spark, which filters by them before it shuffles.
    """
    if trusted.count() <= BROADCAST_IDS:
        trusted = F.broadcast(trusted)
    corpus = _bin_counts(docs, n_bins) + smoothing
    target = _bin_counts(docs.where("doc_id is not null").join(trusted, "doc_id", "left_semi"), n_bins) + smoothing
    return np.log(target / target.sum()) - np.log(corpus / corpus.sum())


def exact_percentile(scores: DataFrame, p: float) -> float | None:
    """The interpolated percentile of the column score, nulls left out; None without any.

    Approximate percentiles bracket the place, again within each bracket, or else its
    middle halves it, until at most BRACKET_ROWS rows or one value are left in it; only
    those reach the driver.
    """
    scores = scores.where("score is not null")
    n, low, high = scores.agg(F.count("score"), F.min("score"), F.max("score")).first()
    if not n:
        return None
    at = p * (n - 1)
    places = int(at), min(int(at) + 1, n - 1)
    below, held = 0, n
    while held > BRACKET_ROWS and low < high:
        here = scores.where(F.col("score").between(low, high))
        share, width = (places[0] - below) / held, max(2e-4, BRACKET_ROWS / 4 / held)
        ends = [F.percentile_approx("score", F.lit(q), F.lit(10_000)) for q in (max(0.0, share - width), min(1.0, share + width))]
        for a, b in (here.agg(*ends).first(), (low, low + (high - low) / 2), (math.nextafter(low + (high - low) / 2, math.inf), high)):
            under, inside = here.agg(F.sum((F.col("score") < a).cast("long")), F.sum(F.col("score").between(a, b).cast("long"))).first()
            if below + under <= places[0] and places[1] < below + under + inside and inside < held:
                below, held, low, high = below + under, inside, a, b
                break
        else:
            break  # the two places lie on either side of the middle, or all values are equal
    inside = scores.where(F.col("score").between(low, high)).groupBy("score").count()
    if held > BRACKET_ROWS and low < high:
        # The values next to the middle are all that matter.
        middle = low + (high - low) / 2
        ends = scores.where(F.col("score").between(low, high)).agg(F.max(F.when(F.col("score") <= middle, F.col("score"))), F.min(F.when(F.col("score") > middle, F.col("score")))).first()
        return ends[0] + (ends[1] - ends[0]) * (at - places[0])
    found = sorted((r["score"], r["count"]) for r in inside.collect())
    upto = below + np.cumsum([k for _, k in found])
    least, most = (found[int(np.searchsorted(upto, k, side="right"))][0] for k in places)
    return least + (most - least) * (at - places[0])


def add_score(docs: DataFrame, log_ratios: np.ndarray) -> DataFrame:
    """Adds score: the mean log ratio of the document's n-grams, null if it has none."""
    table = F.lit(log_ratios)
    total = F.aggregate("_bins", F.lit(0.0), lambda s, b: s + F.get(table, b))
    return docs.withColumn("_bins", ngram_bins(len(log_ratios))).withColumn("score", F.when(F.size("_bins") > 0, total / F.size("_bins"))).drop("_bins")


def judge_quality(
    docs: DataFrame,
    labels: DataFrame,
    n_bins: int = N_BINS,
    percentile: float = 0.005,
    slack: float = 0.05,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Judge every row of ``docs`` (doc_id, text), trusted ones named by ``labels`` (doc_id, quality 0 or 1).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, score, kept, and the columns named in ``keep``.  kept is false if the base
    rules fail, else whether score >= threshold; the threshold is ``percentile`` of the
    scores of all trusted documents that pass the base rules, less ``slack``.  Corpus
    counts cover all documents, target counts all trusted ones.  Scores are written before
    the threshold is taken, so each text is scored once.  Columns named in ``keep`` must
    not have the names of the columns above, else ValueError is raised.

    Null and empty texts have no words and fail the base rules.  Rows are judged on their
    own, so equal texts get equal verdicts and repeated or null ids pass through.  Without
    trusted documents every row that passes the base rules is kept.  Other columns of
    ``docs`` are ignored unless kept.
    """
    if clash := {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept", "words", "word_hashes"} & set(keep):
        raise ValueError(f"columns that the result has already: {sorted(clash)}")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(c) for c in keep if c not in ("doc_id", "text")])
    trusted = trusted_ids(labels)
    ratios = fit_log_ratios(rows.select("doc_id", "text"), trusted, n_bins)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", *[c for c in keep if c != "doc_id"]]
    judged = stage_table(add_score(add_base_columns(word_columns(rows)), ratios).select(*columns), "quality-scores")
    known = judged.where(~F.col("base_failed")).select("doc_id", "score").join(trusted, "doc_id", "left_semi")
    least = exact_percentile(stage_table(known.select("score"), "quality-trusted"), percentile)
    verdict = ~F.col("base_failed") & (F.lit(True) if least is None else F.col("score") >= F.lit(least - slack))
    return judged.withColumn("kept", F.coalesce(verdict, F.lit(False))).select(*columns[:8], "kept", *columns[8:])
