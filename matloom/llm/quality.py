"""Document quality: base rules, then a hashed n-gram likelihood ratio.

Word unigrams and bigrams are hashed into buckets.  Two multinomials over the
buckets, one of trusted target documents and one of the whole corpus, give every
bucket a log ratio; a document's score is the mean over its n-grams.  A document
stays when it passes the base rules and its score reaches a fixed threshold.
Everything is built-in Spark functions.

The trusted documents are a sample bounded by ``TRUSTED`` (the labelled good ones
with the smallest id hashes); the corpus counts cover all documents.

Defined results: a null text has no words, symbols or lines and fails the base
rules; without trusted documents the ratio is zero everywhere and the base rules
decide; repeated rows are judged one by one; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matloom.llm.common import documents, let, words_of
from matloom.llm.registry import query
from matloom.llm.tables import literal_table

BUCKETS = 1 << 13
#: Most trusted documents of the target model.
TRUSTED = 20_000
#: Added to each bucket's count.
SMOOTHING = 1.0
#: Mean log ratio per n-gram that a document must reach.
THRESHOLD = -0.1
#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20


# -- base rules ---------------------------------------------------------------


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of five words found at least twice."""

    def covered(hashes: Column) -> Column:
        tagged = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda x, k: F.get(s, k)["h"].eqNullSafe(x["h"])
            again = F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))
            return F.sort_array(F.transform(again, lambda x: x["i"]))

        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            let(tagged, starts),
            zero,
            lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n"), (p + WINDOW).alias("end")),
            lambda a: a["n"],
        )

    def count(hashes: Column) -> Column:
        # Most texts repeat no window, which a set of hashes tells cheaply.
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(covered(hashes))

    def all_windows(w: Column) -> Column:
        spots = F.sequence(F.lit(1), F.size(w) - WINDOW + 1)
        return let(F.transform(spots, lambda i: F.xxhash64(F.slice(w, i, WINDOW))), count)

    return let(words, lambda w: F.when(F.size(w) <= WINDOW, 0).otherwise(all_windows(w)))


def base_rules(docs: DataFrame) -> DataFrame:
    """``doc_id`` with the counts of the base rules and the ``words``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = docs.select("doc_id", text.alias("text"), words_of(text).alias("words"))
    return split.select(
        "doc_id",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )


# -- likelihood ratio ---------------------------------------------------------


def grams(words: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of the unigrams and bigrams of an array of words."""
    place = lambda *w: F.pmod(F.xxhash64(*w), F.lit(buckets)).cast("int")
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), place(a, b)))
    return F.concat(F.transform(words, lambda w: place(w)), F.filter(pairs, lambda x: x.isNotNull()))


def learn_ratio(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, trusted: int = TRUSTED, smoothing: float = SMOOTHING) -> list[float]:
    """Log ratio of trusted to corpus probability for each bucket."""
    good = labels.where("quality = 1 AND toxic = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_good")).distinct()
    sample = good.orderBy(F.xxhash64("_good"), "_good").limit(trusted)
    marked = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_good"), "left")
    flat = marked.select(F.col("_good").isNotNull().cast("int").alias("good"), F.explode(grams(words_of(F.col("text")), buckets)).alias("b"))
    target, corpus = [0] * buckets, [0] * buckets
    for r in flat.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("g")).collect():
        target[r["b"]], corpus[r["b"]] = r["g"], r["n"]
    if not any(target):
        return [0.0] * buckets
    total_t, total_c = sum(target) + smoothing * buckets, sum(corpus) + smoothing * buckets
    return [math.log((t + smoothing) / total_t) - math.log((c + smoothing) / total_c) for t, c in zip(target, corpus)]


def score(words: Column, ratio: list[float]) -> Column:
    """Mean log ratio of the n-grams; zero without words."""
    table = literal_table(ratio)
    total = lambda g: F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get(table, b)) / F.size(g)
    return F.when(F.size(words) > 0, let(grams(words, len(ratio)), total)).otherwise(0.0)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **model) -> DataFrame:
    """Counts, score and verdict of every document."""
    ratio = learn_ratio(docs, labels, **model)
    scored = base_rules(docs).withColumn("llr", score(F.col("words"), ratio)).drop("words")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    judged = scored.withColumn("base_failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


@query("op10_quality")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = judge(documents(spark, sf_dir), labels)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
