"""A synthetic bill for fixtures: fixed and random charges, with traps that detectors must find.

Every charge depends on its day and merchant only, so a longer bill begins with
the shorter one.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import MONEY

# merchant, category, first price, price from the seventh charge on, day of the month
FIXED = [("PACIFIC PROPERTY MGMT", "房租", "2400.00", "2400.00", 1), ("NETFLIX.COM", "订阅", "15.49", "19.36", 5), ("READLY GHOST", "订阅", "9.99", "9.99", 9), ("VERIZON WIRELESS", "通讯", "65.00", "65.00", 12)]
# merchant, category, least and greatest amount, charges in a hundred days
RANDOM = [("STARBUCKS #1234", "咖啡", 4, 9, 40), ("SAFEWAY #0987", "超市", 30, 180, 25), ("UBER *TRIP", "交通", 8, 45, 20), ("AMZN MKTP US*2H4KJ", "购物", 10, 200, 12)]
# merchant, category, amount, day: a charge twice in a day, a single large one, a refund
SINGLE = [("TARGET T-1234", "购物", "188.40", 100), ("TARGET T-1234", "购物", "188.40", 100), ("APPLE STORE", "购物", "3800.00", 150), ("AMZN MKTP US*2H4KJ", "购物", "-139.99", 170)]


def synthetic_bill(spark: SparkSession, start: date, end: date, seed: int = 20250901) -> DataFrame:
    """Transactions from ``start`` to ``end`` with their true categories, numbered in order of date."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("date")).withColumn("n", F.datediff("date", F.lit(start)))
    rows = None

    def add(more: DataFrame) -> None:
        nonlocal rows
        rows = more if rows is None else rows.unionByName(more)

    def charge(frame: DataFrame, merchant: str, category: str, amount) -> DataFrame:
        return frame.select("date", F.lit(merchant).alias("merchant"), F.lit(category).alias("category"), amount.cast(MONEY).alias("amount"))

    for merchant, category, was, now, day in FIXED:
        months = (F.year("date") - start.year) * 12 + F.month("date") - start.month
        add(charge(days.where(F.dayofmonth("date") == day), merchant, category, F.when(months >= 6, F.lit(now)).otherwise(F.lit(was))))
    for merchant, category, low, high, rate in RANDOM:
        dice = lambda salt, m=merchant: F.pmod(F.xxhash64("n", F.lit(f"{m}{salt}{seed}")), F.lit(10_000))
        add(charge(days.where(dice("day") < rate * 100), merchant, category, F.lit(low) + (high - low) * dice("price") / 10_000))
    for merchant, category, amount, day in SINGLE:
        add(charge(days.where(F.col("n") == day), merchant, category, F.lit(amount)))
    place = F.row_number().over(Window.orderBy("date", "merchant", "amount"))  # a fixture's few thousand rows
    return rows.withColumn("seq", place.cast("long")).select(F.format_string("T%06d", "seq").alias("txn_id"), "date", "merchant", "amount", F.lit("card").alias("account"), "category", "seq")

