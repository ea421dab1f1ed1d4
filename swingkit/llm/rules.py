"""Quality rules: base counts of a text, and a hashed n-gram likelihood ratio of trusted against raw text.

Words, pairs of words and runs of marks fall into ``buckets`` hashed cells. Two multinomials over the cells are counted, one over every document (raw) and one over every trusted
document (target). A document's score is the mean of ``ln(target / raw)`` over its n-grams; it stays if the base rules
hold and the score reaches ``threshold``. All of it is built of SQL expressions: the weights are one array of
``buckets`` doubles, whatever the input.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swingkit.llm.common import SPACES, bounded, table, words

BUCKETS = 1 << 15
#: Mean log-likelihood ratio in nats below which a text counts as unlike the trusted ones.
THRESHOLD = -0.2
#: Weights are whole numbers of this part of a nat.
UNIT = 1 << 20
#: Up to so many trusted ids are broadcast; more are joined by a shuffle.
MOST_IDS = 2_000_000
SYMBOLS = "[#*$%&|<>]"
SPAN, MIN_WORDS, MOST_REPEATED = 8, 20, 30


_PAIRS = "if(size({a}) <= {n}, cast(array() as array<bigint>), zip_with(slice({a}, 1, size({a}) - {n}), slice({a}, {n} + 1, size({a})), (x, y) -> xxhash64(x, y)))"


def hashed_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus ``_words`` and the hashes of the words (``_one``), of pairs of words (``_two``) and of runs of marks (``_marks``)."""
    marks = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\p{L}\p{N}\s]+"), F.lit(0))
    out = docs.withColumns({"_words": words(F.col(text)), "_marks": F.transform(marks, lambda m: F.xxhash64(F.lit("mark"), m))})
    return out.withColumn("_one", F.transform("_words", lambda w: F.xxhash64(w))).withColumn("_two", F.expr(_PAIRS.format(a="_one", n=1)))


def base_counts(hashed: DataFrame, text: str = "text") -> DataFrame:
    """What :func:`hashed_words` gives plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed.

    A null or empty text has no words and fails. Columns of these names are replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    out = hashed.withColumns(
        {
            "_lines": F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""),
            "_four": F.expr(_PAIRS.format(a="_two", n=2)),
            "n_symbols": F.regexp_count(body, F.lit(SYMBOLS)).cast("long"),
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        }
    )
    # An equal pair of spans of 8 words holds five equal pairs of 4, so most texts need no hashes of 8.
    out = out.withColumns(
        {
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_spans": F.expr(f"if(size(_four) - size(array_distinct(_four)) < {SPAN // 2 + 1}, cast(array() as array<bigint>), {_PAIRS.format(a='_four', n=4)})"),
        }
    )
    # Only texts with an equal pair of spans are sorted; a span is repeated if a neighbour in hash order is equal.
    out = out.withColumn("_order", F.expr("if(size(array_distinct(_spans)) = size(_spans), array(), array_sort(transform(_spans, (h, i) -> struct(h, i))))"))
    out = out.withColumn(
        "_starts",
        F.expr("array_sort(transform(filter(_order, (x, k) -> x.h <=> get(_order, k - 1).h or x.h <=> get(_order, k + 1).h), x -> x.i))"),
    )
    covered = f"aggregate(_starts, struct(0L as n, 0L as upto), (a, s) -> struct(a.n + s + {SPAN} - greatest(a.upto, cast(s as bigint)) as n, cast(s + {SPAN} as bigint) as upto), a -> a.n)"
    out = out.withColumn("n_repeat_words", F.expr(covered))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("_words", "_lines", "_four", "_spans", "_order", "_starts")


def ratio_weights(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """ln(target / raw) of every cell in UNITs, with one count added to each.

    Every row of ``docs`` is raw text; those whose key is in ``trusted`` (distinct, not null) are the target too.
    """
    spark = docs.sparkSession
    marked = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(
        bounded(trusted.select(F.col(key).alias("_key"), F.lit(1).alias("_good")), MOST_IDS), "_key", "left"
    )
    counts = (
        hashed_words(marked, "_text")
        .select("_good", F.explode_outer(F.concat("_one", "_two", "_marks")).alias("h"))
        .filter("h is not null")
        .groupBy(F.pmod("h", F.lit(buckets)).cast("int").alias("cell"))
        .agg(F.count("*").alias("raw"), F.count("_good").alias("target"))
    )
    cells = spark.range(buckets).select(F.col("id").cast("int").alias("cell")).join(counts, "cell", "left").fillna(0).orderBy("cell")
    raw, target = np.array(cells.select("raw", "target").collect(), np.int64).T + 1  # `buckets` rows
    if (target == 1).all():
        return np.zeros(buckets, np.int64)
    return np.rint((np.log(target / target.sum()) - np.log(raw / raw.sum())) * UNIT).astype(np.int64)


def ratio_scores(hashed: DataFrame, weights: np.ndarray, name: str = "llr") -> DataFrame:
    """What :func:`hashed_words` gives plus the mean weight of each text's n-grams, null without one.

    Sums of whole numbers: the same whatever the order. Spark folds the weights into one constant.
    """
    known = F.split(F.lit(",".join(map(str, weights.tolist()))), ",").cast("array<bigint>")
    grams = F.concat("_one", "_two", "_marks")
    total = F.aggregate(grams, F.lit(0).cast("long"), lambda s, h: s + F.get(known, F.pmod(h, F.lit(len(weights))).cast("int")))
    return hashed.withColumn(name, total / F.nullif(F.size("_one") + F.size("_two") + F.size("_marks"), F.lit(0)) / UNIT).drop("_one", "_two", "_marks")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The distinct ids that the labels call good."""
    return labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct()


def apply_rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` plus the base counts, ``llr`` and ``kept``; a text without an n-gram has a null ``llr`` and goes.

    Without any trusted document all weights are 0 and the base rules decide. Columns of these names are replaced.
    """
    weights = ratio_weights(docs, trusted_ids(labels), key, text)
    out = ratio_scores(base_counts(hashed_words(docs, text), text), weights)
    # Row numbers are never negative: they only keep Spark from copying all these nested expressions into a filter on the verdict.
    return out.withColumn("kept", (F.monotonically_increasing_id() >= 0) & ~F.col("base_failed") & F.coalesce(F.col("llr") >= threshold, F.lit(False)))


def op8_ngram_ratio_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document; labelled good documents are the trusted target."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = apply_rules(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("llr", 6).alias("llr"))
