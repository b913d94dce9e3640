"""Quality rules: hashed n-gram log-likelihood ratio between a trusted and the raw corpus.

Word unigrams and bigrams of every text are hashed into a fixed number of buckets. Two
multinomials are counted over all rows: one over the trusted documents, one over the whole
corpus. A document's score is the sum of its n-grams' log ratios divided by their number;
documents below a fixed threshold are rejected, each by its own text alone.

All of it is DataFrame expressions: no Python runs on the executors. The only data that
leaves them is the ratio table, whose size is the number of buckets.

Null and empty texts have no words: base_failed, score 0. Repeated rows are judged each;
their trusted mark is the id's. Very long texts are arrays of their words in one row. A score
on the threshold is kept. Without trusted documents all ratios are 0 and only the base rules
reject. Empty tables give no rows. Columns of the input never clash: they travel in a struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of the hashed feature space: the bound of what is collected and sent to executors.
BUCKETS = 65536
#: Trusted ids up to this number are broadcast (8 bytes each); beyond, the join shuffles.
BROADCAST_IDS = 1_000_000
#: Pseudo-count of the raw corpus's own proportions in each bucket: rare n-grams say little.
PRIOR = 64
#: Lowest mean log ratio of a kept document, in millionths.
THRESHOLD = -80_000

SPACE = r"[\x20\x09-\x0D]+"
SCALE = 1_000_000


def with_words(docs: DataFrame, text: str = "_text") -> DataFrame:
    """Adds _words and _w1, the hash of each word. Trimming first leaves no empty word inside."""
    blank = F.lit(" \t\n\x0b\x0c\r")
    trimmed = F.btrim(F.coalesce(F.col(text), F.lit("")), blank)
    docs = docs.withColumn("_trim", trimmed)
    docs = docs.withColumn("_words", F.when(F.col("_trim") != "", F.split("_trim", SPACE)).otherwise(F.array().cast("array<string>")))
    return docs.withColumn("_w1", F.transform("_words", lambda w: F.xxhash64(w)))


def _bucket(hashed: Column, buckets: int) -> Column:
    """A power of two of buckets: the low bits."""
    return hashed.bitwiseAND(F.lit(buckets - 1)).cast("int")


def _next(array: str, i: Column, skip: int) -> Column:
    return F.get(F.col(array), i + skip)


def _repeated(grams: Column) -> Column:
    """Positions of 5-word windows that occur twice or more, from sorted (hash, position)."""
    near = F.filter(
        grams,
        lambda x, i: (F.get(grams, i - 1)["h"] == x["h"]) | (F.get(grams, i + 1)["h"] == x["h"]),
    )
    return F.sort_array(F.transform(near, lambda x: x["p"]))


def base_measures(docs: DataFrame, text: str = "_text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    windows = F.transform(
        F.slice("_w1", F.lit(1), F.greatest(F.size("_w1") - 4, F.lit(0))),
        lambda h, i: F.xxhash64(h, *[_next("_w1", i, k) for k in range(1, 5)]),
    )
    docs = docs.withColumn("_w5", windows)
    docs = docs.withColumn("_lines", F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    docs = docs.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct("_w5")) < F.size("_w5"),
            F.sort_array(F.transform("_w5", lambda h, i: F.struct(h.alias("h"), i.alias("p")))),
        ),
    )
    docs = docs.withColumn("_at", F.when(F.col("_sorted").isNotNull(), _repeated(F.col("_sorted"))))
    spread = F.transform("_at", lambda p, i: F.least(F.lit(5), F.coalesce(F.get(F.col("_at"), i + 1) - p, F.lit(5))))
    docs = docs.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.concat_ws("", "_words")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(F.aggregate(spread, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"),
        }
    )
    return docs.withColumn(
        "base_failed", (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    )


def ratio_table(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Log ratio of trusted to raw probability, in millionths, by bucket (smoothed by PRIOR).

    ``docs`` has _id and _text, ``trusted`` a column _id. Counts cover all rows.
    """
    marks = trusted.where(F.col("_id").isNotNull()).select("_id").distinct().withColumn("_mark", F.lit(1))
    small = marks.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    marks = F.broadcast(marks) if small else marks.hint("shuffle_hash")
    seen = with_words(docs.join(marks, "_id", "left").select("_text", "_mark")).select("_w1", "_mark")
    at = seen.select("_mark", "_w1", F.posexplode("_w1").alias("p", "h"))
    both = F.array(_bucket(F.col("h"), buckets), _bucket(F.xxhash64("h", _next("_w1", F.col("p"), 1)), buckets))
    last = F.col("p") == F.size("_w1") - 1
    grams = at.select("_mark", F.explode(F.when(last, F.slice(both, 1, 1)).otherwise(both)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("raw"), F.count("_mark").alias("good")
    )
    from math import log

    found = {r.bucket: (r.raw, r.good) for r in counts.collect()}
    raw, good = sum(x for x, _ in found.values()), sum(x for _, x in found.values())
    if not good:
        return [0] * buckets
    share = good / raw
    ratios = ((g + PRIOR * share) / (r + PRIOR) / share for r, g in (found.get(b, (0, 0)) for b in range(buckets)))
    return [round(SCALE * log(x)) for x in ratios]


def quality_rules(
    docs: DataFrame,
    trusted: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    trusted_id_col: str = "doc_id",
    buckets: int = BUCKETS,
    threshold: int = THRESHOLD,
) -> DataFrame:
    """One row per input row: _row (all its columns), the measures, kept and score."""
    base = docs.select(
        F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.struct("*").alias("_row")
    )
    ratios = ratio_table(base.select("_id", "_text"), trusted.select(F.col(trusted_id_col).alias("_id")), buckets)
    table = F.expr(f"cast(split('{','.join(map(str, ratios))}', ',') as array<bigint>)")
    out = base_measures(with_words(base))
    of = lambda h: F.get(table, _bucket(h, buckets))
    last = F.size("_w1") - 1
    at = F.transform(
        "_w1", lambda h, i: of(h) + F.when(i < last, of(F.xxhash64(h, _next("_w1", i, 1)))).otherwise(F.lit(0))
    )
    out = out.withColumn("_sum", F.aggregate(at, F.lit(0).cast("long"), lambda a, x: a + x))
    out = out.withColumn("_n", F.greatest(2 * F.size("_w1") - 1, F.lit(0)).cast("long"))
    return out.select(
        "_row",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.col("_sum") >= F.col("_n") * threshold)).alias("kept"),
        F.when(F.col("_n") > 0, F.col("_sum") / F.col("_n") / SCALE).otherwise(F.lit(0.0)).alias("score"),
    )


def trusted_labels(labels: DataFrame) -> DataFrame:
    """Ids of documents whose label says good quality."""
    return labels.where(F.col("quality") == 1).select("doc_id")
