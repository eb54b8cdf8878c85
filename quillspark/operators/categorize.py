"""Three tiers of categories for merchants: rules, a table of known keys, a classifier.

Categories are decided once for each distinct key and joined back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import known_category, normalized_merchant, rule_category
from ..schema import CATEGORIES, FALLBACK

Classifier = Callable[[DataFrame], DataFrame]


def decided_keys(txns: DataFrame, known: DataFrame, classify: Classifier | None = None) -> DataFrame:
    """(merchant_key, category, tier, fell_back) of each distinct key; tier is rule, cache or model.

    ``known`` has merchant_key and category. ``classify`` turns a table of keys
    into one of (merchant_key, category); without it, and where it gives no
    known category, the fallback is taken and counted.
    """
    keys = txns.select(normalized_merchant(F.col("merchant")).alias("merchant_key")).where(F.col("merchant_key").isNotNull()).distinct()
    stored = known.where(known_category(F.col("category"))).groupBy("merchant_key").agg(F.max("category").alias("stored"))
    tiered = keys.withColumn("ruled", rule_category(F.col("merchant_key"))).join(stored, "merchant_key", "left")
    open_keys = tiered.where(F.col("ruled").isNull() & F.col("stored").isNull()).select("merchant_key")
    if classify is None:
        answered = tiered.withColumn("answer", F.lit(None).cast("string"))
    else:
        answers = classify(open_keys).where(known_category(F.col("category"))).groupBy("merchant_key").agg(F.max("category").alias("answer"))
        answered = tiered.join(answers, "merchant_key", "left")
    tier = F.when(F.col("ruled").isNotNull(), "rule").when(F.col("stored").isNotNull(), "cache").otherwise("model")
    return answered.select(
        "merchant_key", F.coalesce("ruled", "stored", "answer", F.lit(FALLBACK)).alias("category"), tier.alias("tier"),
        ((tier == "model") & F.col("answer").isNull()).alias("fell_back"),
    )


def categorized(txns: DataFrame, decided: DataFrame) -> DataFrame:
    """The transactions with the category of their key."""
    keyed = txns.drop("category").withColumn("merchant_key", normalized_merchant(F.col("merchant")))
    return keyed.join(decided.select("merchant_key", "category"), "merchant_key", "left")


def tier_stats(decided: DataFrame) -> DataFrame:
    """Merchants by tier; the hit rate leaves rules out and is 0 where nothing was looked up."""
    count = lambda tier: F.count(F.when(F.col("tier") == tier, 1))
    asked = count("cache") + count("model")
    return decided.agg(
        F.count("*").alias("merchants"), count("rule").alias("by_rule"), count("cache").alias("by_cache"), count("model").alias("by_model"),
        F.count(F.when(F.col("fell_back"), 1)).alias("fallback"), F.when(asked > 0, F.round(count("cache") / asked, 6)).otherwise(F.lit(0.0)).alias("cache_hit_rate"),
    )


def per_class(tagged: DataFrame, truth: DataFrame, classes: list[str] = CATEGORIES) -> DataFrame:
    """(category, hits, predicted, support, precision, recall) of each class that occurs; 0 over nothing."""
    spark = tagged.sparkSession
    joined = tagged.select("txn_id", F.col("category").alias("got")).join(truth.select("txn_id", F.col("category").alias("want")), "txn_id", "left")
    both = joined.select(F.explode(F.array(F.struct(F.col("got").alias("category"), F.lit(1).alias("p"), F.lit(0).alias("s")), F.struct(F.col("want").alias("category"), F.lit(0).alias("p"), F.lit(1).alias("s")))).alias("c"), (F.col("got") == F.col("want")).alias("hit"))
    counted = both.groupBy("c.category").agg(F.sum("c.p").alias("predicted"), F.sum("c.s").alias("support"), F.sum(F.when(F.col("hit"), F.col("c.p")).otherwise(0)).alias("hits"))
    listed = spark.createDataFrame([(c,) for c in classes], "category string")
    share = lambda whole: F.when(F.col(whole) > 0, F.round(F.col("hits") / F.when(F.col(whole) > 0, F.col(whole)), 6)).otherwise(F.lit(0.0))
    return counted.join(F.broadcast(listed), "category").select("category", "hits", "predicted", "support", share("predicted").alias("precision"), share("support").alias("recall"))


def accuracy(tagged: DataFrame, truth: DataFrame) -> DataFrame:
    """(correct, total, accuracy) over all rows; a row without a true category is right only if it has none."""
    joined = tagged.select("txn_id", F.col("category").alias("got")).join(truth.select("txn_id", F.col("category").alias("want")), "txn_id", "left")
    right = F.count(F.when(F.col("got").eqNullSafe(F.col("want")), 1))
    return joined.agg(right.alias("correct"), F.count("*").alias("total"), F.when(F.count("*") > 0, F.round(right / F.count("*"), 6)).alias("accuracy"))


def top_misclassified(tagged: DataFrame, truth: DataFrame, limit: int = 10) -> DataFrame:
    joined = tagged.join(truth.select("txn_id", F.col("category").alias("want")), "txn_id", "left").where(~F.col("category").eqNullSafe(F.col("want")))
    return joined.groupBy("merchant").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "merchant").limit(limit)


def updated_cache(known: DataFrame, decided: DataFrame) -> DataFrame:
    """The table of known keys with those that the classifier decided, fallbacks included; one row for each key."""
    fresh = decided.where(F.col("tier") == "model").select("merchant_key", "category")
    kept = known.join(fresh.select("merchant_key"), "merchant_key", "left_anti").groupBy("merchant_key").agg(F.max("category").alias("category"))
    return kept.unionByName(fresh)
