"""What a bill was made to contain, found again in its rows alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import p95
from .sequences import cumulative

# How often and how small a forgotten subscription is, how much a price rose, how far an outlier lies above the 95th
# percentile of its category, how far apart the amounts of an ambiguous merchant are.
REGULAR, SMALL, RISE, FAR, SPREAD = 12, 15, 1.2, 3, 10


def halves(rows: DataFrame) -> DataFrame:
    """(merchant, n, most, least, early, late): mean amounts of the first n // 2 rows and of the rest, in order of date and seq.

    Places are counted over rows dealt by range, so no task needs all rows of a merchant.
    """
    placed = rows.withColumn("place", F.struct("date", "seq"))
    ranked = cumulative(placed, "merchant", "place").select("merchant", "place", (F.col("upto") <= F.floor(F.col("total") / 2)).alias("first"))
    each = placed.select("merchant", "place", "amount").join(ranked, ["merchant", "place"])
    return each.groupBy("merchant").agg(
        F.count("*").alias("n"), F.max("amount").alias("most"), F.min("amount").alias("least"), F.avg(F.when(F.col("first"), F.col("amount"))).alias("early"), F.avg(F.when(~F.col("first"), F.col("amount"))).alias("late")
    )


def trap_check(rows: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """One row: doubled_days, refunds, small_regular, risen, far_outliers, wide_spread.

    Days on which a merchant charged an amount twice, refunds, merchants with
    many small charges only, those whose later mean is above the earlier one,
    categories with an amount far above their 95th percentile, merchants whose
    amounts lie far apart. ``labels`` has the true (txn_id, category); without
    it the rows' own categories count. Rows need a date and seq of their own.
    """
    days = rows.groupBy("merchant", "date", "amount").agg(F.count("*").alias("n"), F.count(F.when(F.col("amount") < 0, 1)).alias("refunds"))
    totals = days.agg(F.count(F.when(F.col("n") >= 2, 1)).alias("doubled_days"), F.coalesce(F.sum("refunds"), F.lit(0)).alias("refunds"), F.lit(1).alias("one"))
    counted = lambda condition: F.count(F.when(condition, 1))
    merchants = halves(rows).agg(
        counted((F.col("n") >= REGULAR) & (F.col("most") <= SMALL)).alias("small_regular"), counted((F.col("early") > 0) & (F.col("late") > F.lit(RISE) * F.col("early"))).alias("risen"),
        counted((F.col("least") > 0) & (F.col("most") >= F.col("least") * SPREAD)).alias("wide_spread"), F.lit(1).alias("one"),
    )
    labelled = rows if labels is None else rows.drop("category").join(labels.select("txn_id", "category"), "txn_id")
    known = labelled.where(F.col("category").isNotNull() & F.col("amount").isNotNull())
    tops = known.groupBy("category").agg(F.max("amount").alias("top")).join(p95(known, "category", "amount"), "category")
    far = tops.agg(counted((F.col("p95") > 0) & (F.col("top") > F.col("p95") * FAR)).alias("far_outliers"), F.lit(1).alias("one"))
    return totals.join(merchants, "one").join(far, "one").drop("one")
