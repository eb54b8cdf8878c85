"""Duplicate charges, recurring charges, price rises and outliers.

Rows of a key are first counted by date (or by amount), with a map-side part.
Windows then run over distinct dates, of which a key has few thousands at most
however many rows it has, so a hot merchant is no hot task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.columns import as_money, cents, half_up, labelled
from ..schema import MONEY
from ..session import cut
from .query import require_categories

# When charges count as recurring, and the defaults of the detectors.
MIN_OCCURRENCES, MAX_AMOUNTS, MIN_GAP_DAYS = 4, 3, 20
WINDOW_DAYS, FENCE, MIN_GROUP = 3, 3, 4
MIN_RISE_PERCENT = 5


def islands(txns: DataFrame, keys: list[str], window_days: int) -> DataFrame:
    """(keys, date, island, charges): dates chained while neighbours are within the window."""
    dates = txns.groupBy(*keys, "date").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*keys).orderBy("date")
    starts = F.coalesce((F.datediff("date", F.lag("date").over(order)) > window_days).cast("int"), F.lit(0))
    numbered = dates.withColumn("starts", starts).withColumn("island", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(*keys, "island")
    return numbered.withColumn("charges", F.sum("n").over(whole)).select(*keys, "date", "island", "charges")


def duplicate_members(txns: DataFrame, window_days: int = WINDOW_DAYS, keys: tuple[str, ...] = ("merchant", "amount"), tie: str = "seq") -> DataFrame:
    """(keys, island, date, tie, txn_id): the charges of each cluster of two or more, one row each, whatever the size of a cluster.

    Charges chain while neighbours are at most ``window_days`` apart. Null keys
    form keys of their own; rows without a date are left out.
    """
    keys = list(keys)
    rows = txns.where(F.col("date").isNotNull())
    clusters = islands(rows, keys, window_days).where("charges >= 2")
    own = clusters.select(*(F.col(k).alias(f"__{k}") for k in [*keys, "date"]), "island")
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return rows.join(own, [F.col("date") == F.col("__date"), *same]).select(*keys, "island", "date", F.col(tie).alias("tie"), "txn_id")


def duplicate_charges(txns: DataFrame, window_days: int = WINDOW_DAYS, keys: tuple[str, ...] = ("merchant", "amount"), tie: str = "seq") -> DataFrame:
    """Clusters as they are shown: (keys, times, txn_ids, dates), ids in order of date. A cluster is one row here; ``duplicate_members`` is for clusters of any size."""
    keys = list(keys)
    grouped = duplicate_members(txns, window_days, tuple(keys), tie).groupBy(*keys, "island").agg(F.array_sort(F.collect_list(F.struct("date", "tie", "txn_id"))).alias("c"))
    return grouped.select(*keys, F.size("c").alias("times"), F.col("c.txn_id").alias("txn_ids"), F.col("c.date").alias("dates"))


def account_duplicates(txns: DataFrame, window_days: int = WINDOW_DAYS) -> DataFrame:
    """Duplicates of each account by normalized merchant, charges only; ties in order of txn_id."""
    return duplicate_charges(txns.where(F.col("amount") > 0), window_days, ("account", "merchant_key", "amount"), "txn_id")


def recurring(txns: DataFrame, min_occurrences: int = MIN_OCCURRENCES, max_amounts: int = MAX_AMOUNTS) -> DataFrame:
    """One row for each merchant with regular charges of few amounts: the only definition of what recurs.

    Columns: merchant, occurrences, median_gap, first/last date and amount.
    Regular: median gap of 20 days or more, and a coefficient of variation of
    the gaps up to 1/4, decided in integers: 16 n (n S2 - S1^2) <= (n-1) S1^2.
    """
    rows = txns.where(F.col("date").isNotNull())
    place = F.struct("date", "seq")
    merchants = rows.groupBy("merchant").agg(
        F.count("*").alias("occurrences"), F.count_distinct("amount").alias("amounts"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.min_by("amount", place).alias("first_amount"), F.max_by("amount", place).alias("last_amount"),
    ).where((F.col("occurrences") >= min_occurrences) & (F.col("amounts") <= max_amounts))
    order = Window.partitionBy("merchant").orderBy("date")
    dates = rows.groupBy("merchant", "date").agg(F.count("*").alias("n"))
    steps = dates.withColumn("gap", F.datediff("date", F.lag("date").over(order)))
    # Charges of one day are gaps of 0 between them.
    gaps = steps.select("merchant", F.inline(F.array(F.struct(F.col("gap").cast("long").alias("gap"), F.lit(1).cast("long").alias("times")), F.struct(F.lit(0).cast("long").alias("gap"), (F.col("n") - 1).alias("times"))))).where(
        F.col("gap").isNotNull() & (F.col("times") > 0)
    )
    measured = gaps.groupBy("merchant").agg(
        F.sum("times").alias("k"), F.sum(F.col("gap") * F.col("times")).alias("s1"), F.sum(F.col("gap") * F.col("gap") * F.col("times")).alias("s2"),
        F.percentile("gap", F.lit(0.5), F.col("times")).alias("median_gap"),
    )
    steady = (F.col("k") == 1) | (16 * F.col("k") * (F.col("k") * F.col("s2") - F.col("s1") * F.col("s1")) <= (F.col("k") - 1) * F.col("s1") * F.col("s1"))
    regular = measured.where((F.col("median_gap") >= MIN_GAP_DAYS) & (F.col("s1") > 0) & steady)
    return merchants.join(regular.select("merchant", "median_gap"), "merchant")


def months_between(first: Column, last: Column) -> Column:
    return (F.year(last) - F.year(first)) * 12 + F.month(last) - F.month(first)


def subscriptions(txns: DataFrame) -> DataFrame:
    """Recurring charges at their current price: by month, and by year in falling order."""
    months = F.greatest(months_between(F.col("first_date"), F.col("last_date")) + 1, F.lit(1)).cast("long")
    monthly = half_up(cents(F.col("last_amount")) * F.col("occurrences"), months)
    return recurring(txns).select(
        "merchant", F.col("last_amount").alias("amount"), "occurrences", as_money(monthly).alias("monthly"), as_money(monthly * 12).alias("yearly"),
        F.col("first_date").alias("first_seen"), F.col("last_date").alias("last_seen"),
    ).orderBy(F.desc("yearly"), "merchant")


def subscription_total(txns: DataFrame) -> DataFrame:
    return subscriptions(txns).agg(F.count("*").alias("subscriptions"), F.coalesce(F.sum("yearly"), F.lit(0)).cast(MONEY).alias("yearly"))


def price_increases(txns: DataFrame, min_rise_percent: int = MIN_RISE_PERCENT) -> DataFrame:
    """Recurring charges whose last price exceeds the first by more than the given share, by falling ratio."""
    was, now = F.col("first_amount"), F.col("last_amount")
    risen = recurring(txns).where((was > 0) & (now * 100 > was * (100 + min_rise_percent)))
    since = txns.join(risen.select("merchant", "last_amount"), "merchant").where(F.col("amount") == F.col("last_amount")).groupBy("merchant").agg(F.min("date").alias("since"))
    return risen.join(since, "merchant").select(
        "merchant", was.alias("was"), now.alias("now"), "since", "occurrences", as_money(half_up(cents(now) * 100, cents(was))).alias("ratio"),
        ((now - was) * 12).cast(MONEY).alias("yearly_extra"),
    ).orderBy(F.desc("ratio"), "merchant")


def cumulative(values: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, upto, total): rows up to and with each distinct value of a group, exact at any size.

    Distinct values are dealt by range, so a group may span tasks; each task
    counts its own part, and the parts' sums are added up over the tasks.
    """
    counted = values.groupBy(group, value).agg(F.count("*").alias("n"))
    dealt = cut(counted.repartitionByRange(group, value).withColumn("part", F.spark_partition_id()))
    parts = dealt.groupBy(group, "part").agg(F.sum("n").alias("size"))
    across = Window.partitionBy(group).orderBy("part")
    before = parts.select(
        group, "part", (F.sum("size").over(across.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("before"), F.sum("size").over(Window.partitionBy(group)).alias("total")
    )
    inside = Window.partitionBy(group, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.withColumn("within", F.sum("n").over(inside)).join(before, [group, "part"]).select(group, value, "n", (F.col("before") + F.col("within")).alias("upto"), "total")


def quartiles(txns: DataFrame, group: str) -> DataFrame:
    """(group, n, q1, q3) with hundredfold quartiles in cents, interpolated as in the inclusive method; exact."""
    ranked = cumulative(txns.select(group, cents(F.col("amount")).alias("cents")), group, "cents")

    def at(percent: int, step: int) -> Column:
        place = F.floor(F.lit(percent) * (F.col("total") - 1) / 100).cast("long") + step  # from 0
        place = F.least(place, F.col("total") - 1)
        return F.max(F.when((F.col("upto") - F.col("n") <= place) & (place < F.col("upto")), F.col("cents")))

    picked = ranked.groupBy(group).agg(F.max("total").alias("n"), at(25, 0).alias("a25"), at(25, 1).alias("b25"), at(75, 0).alias("a75"), at(75, 1).alias("b75"))
    rest = lambda p: (F.lit(p) * (F.col("n") - 1)) % 100
    quartile = lambda p: F.col(f"a{p}") * (100 - rest(p)) + F.col(f"b{p}") * rest(p)
    return picked.select(group, "n", quartile(25).alias("q1"), quartile(75).alias("q3"))


def outliers(txns: DataFrame, group_by: str = "category", k: int = FENCE) -> DataFrame:
    """Amounts above Q3 + k (Q3 - Q1) of their group: txn_id, merchant, amount, group, threshold, ratio.

    Groups of fewer than four rows have no fence. Raises where categories are
    asked for and no row has one.
    """
    if group_by not in ("category", "merchant", "none"):
        raise QueryError(f"unknown grouping {group_by!r}; known are category, merchant, none")
    if group_by == "category":
        require_categories(txns)
    name = {"category": labelled(F.nullif("category", F.lit(""))), "merchant": F.col("merchant"), "none": F.lit("全部")}[group_by]
    rows = txns.where(F.col("amount").isNotNull()).withColumn("group", name)
    fences = quartiles(rows, "group").where(F.col("n") >= MIN_GROUP).select("group", (F.col("q3") * (1 + k) - F.col("q1") * k).alias("fence"))
    above = rows.join(fences, "group").where(cents(F.col("amount")) * 100 > F.col("fence"))
    ratio = F.when(F.col("fence") > 0, half_up(cents(F.col("amount")) * 10_000, F.when(F.col("fence") > 0, F.col("fence")).otherwise(1))).otherwise(0)
    return above.select("txn_id", "merchant", "amount", "group", as_money(half_up(F.col("fence"), F.lit(100).cast("long"))).alias("threshold"), as_money(ratio).alias("ratio"))
