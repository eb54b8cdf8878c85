"""Coverage, run-rate projection and upcoming charges. ``today`` is always a parameter."""

from __future__ import annotations

import calendar
from dataclasses import dataclass
from datetime import date
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.columns import as_money, cents, half_up, year_month
from ..schema import MONEY
from .sequences import months_between, recurring

# Days looked ahead, and the most cycles an old charge is carried forward.
HORIZON_DAYS, MOST_CYCLES = 30, 240


def coverage(txns: DataFrame, today: date) -> DataFrame:
    """(year_month, first, last, count, lag_days) of each month; ``lag_days`` is that of the whole ledger."""
    months = txns.where(F.col("date").isNotNull()).groupBy(year_month(F.col("date")).alias("year_month")).agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("count"))
    latest = F.max("last").over(Window.partitionBy(F.lit(0)))  # over one row for each month
    return months.select("year_month", "first", "last", "count", F.datediff(F.lit(today), latest).alias("lag_days")).orderBy("year_month")


def month_bounds(year_and_month: str) -> tuple[date, date]:
    try:
        year, month = map(int, year_and_month.split("-"))
        return date(year, month, 1), date(year, month, calendar.monthrange(year, month)[1])
    except ValueError as wrong:
        raise QueryError(f"a month is written YYYY-MM, not {year_and_month!r}") from wrong


@dataclass(frozen=True)
class Projection:
    """A period's spending so far, carried on at its rate, with everything it was computed from."""

    period_start: date
    period_end: date
    observed_through: date
    today: date
    observed: Decimal
    count: int
    observed_days: int
    total_days: int
    projected: Decimal

    @property
    def daily_rate(self) -> Decimal:
        return (self.observed / self.observed_days).quantize(Decimal("0.01"), ROUND_HALF_UP)

    @property
    def is_partial(self) -> bool:
        """Whether the period was still running today."""
        return self.period_end >= self.today

    @property
    def is_complete(self) -> bool:
        """Whether the data reach the period's end."""
        return self.observed_through >= self.period_end


def projected(txns: DataFrame, start: date, end: date, today: date) -> DataFrame:
    """One row with the projection of a period; no row where it can't be made (see project_period)."""
    if end < start:
        raise QueryError(f"the period is reversed: {start} to {end}")
    inside = (F.col("date") >= F.lit(start)) & (F.col("date") <= F.least(F.lit(today), F.lit(end)))
    one = txns.agg(
        F.min("date").alias("first"), F.max("date").alias("last"),
        F.coalesce(F.sum(F.when(inside, F.col("amount"))), F.lit(0)).cast(MONEY).alias("observed"), F.count(F.when(inside, 1)).alias("count"),
    )
    through = F.least(F.lit(today), F.col("last"), F.lit(end))
    days = lambda a, b: (F.datediff(b, a) + 1).cast("long")
    made = one.withColumn("observed_through", through).where((F.col("first") <= F.lit(start)) & (F.col("observed_through") >= F.lit(start)) & (F.lit(start) <= F.lit(today)))
    sized = made.withColumn("observed_days", days(F.lit(start), F.col("observed_through"))).withColumn("total_days", days(F.lit(start), F.lit(end)))
    return sized.select(
        F.lit(start).alias("period_start"), F.lit(end).alias("period_end"), "observed_through", "observed", "count", "observed_days", "total_days",
        as_money(half_up(cents(F.col("observed")) * F.col("total_days"), F.col("observed_days"))).alias("projected"),
        as_money(half_up(cents(F.col("observed")), F.col("observed_days"))).alias("daily_rate"),
        (F.lit(end) >= F.lit(today)).alias("is_partial"), (F.col("observed_through") >= F.lit(end)).alias("is_complete"),
    )


def project_period(txns: DataFrame, start: date, end: date, today: date) -> Projection:
    """The projection as a value; refuses reversed and future periods and such that the data don't reach."""
    if end < start:
        raise QueryError(f"the period is reversed: {start} to {end}")
    if start > today:
        raise QueryError(f"{start} is after today, {today}: there is no rate to carry on")
    bounds = txns.agg(F.min("date").alias("first"), F.max("date").alias("last")).first()
    if bounds["first"] is None:
        raise QueryError("the ledger is empty")
    if start < bounds["first"]:
        raise QueryError(f"the ledger begins on {bounds['first']}, after {start}")
    if min(today, bounds["last"], end) < start:
        raise QueryError(f"the ledger ends on {bounds['last']}: it has no day of {start} to {end}")
    row = projected(txns, start, end, today).first()
    return Projection(start, end, row["observed_through"], today, row["observed"], row["count"], row["observed_days"], row["total_days"], row["projected"])


def upcoming_charges(txns: DataFrame, today: date, horizon_days: int = HORIZON_DAYS) -> DataFrame:
    """The next date of each recurring charge within the horizon: merchant, amount, next_date, interval_days, occurrences.

    Charges at least a month apart move by calendar months from the last one's
    day, clamped to the month's end; others by the median gap in days.
    """
    if horizon_days <= 0:
        raise QueryError(f"the horizon must be positive, not {horizon_days}")
    charges = recurring(txns).withColumn("interval_days", F.bround("median_gap").cast("int"))
    span = months_between(F.col("first_date"), F.col("last_date"))
    months = F.when(span > 0, F.bround(span.cast("double") / (F.col("occurrences") - 1)).cast("int")).otherwise(0)
    each = charges.where("interval_days > 0").withColumn("months", months).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(MOST_CYCLES))))
    when = F.when(F.col("months") > 0, F.add_months("last_date", F.col("months") * F.col("n"))).otherwise(F.date_add("last_date", F.col("interval_days") * F.col("n")))
    due = each.withColumn("when", when).where(F.col("when") >= F.lit(today))
    first = due.groupBy("merchant", "last_amount", "interval_days", "occurrences").agg(F.min("when").alias("next_date"))
    return first.where(F.col("next_date") <= F.date_add(F.lit(today), horizon_days)).select(
        "merchant", F.col("last_amount").alias("amount"), "next_date", "interval_days", "occurrences"
    ).orderBy("next_date", "merchant")
