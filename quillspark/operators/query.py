"""Filtered and grouped spending questions over transactions."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.columns import average, labelled, year_month
from ..schema import AGGREGATES, CATEGORIES, GROUPINGS, MONEY, UNCATEGORIZED


@dataclass(frozen=True)
class Filters:
    """What a question is about. Empty values don't filter; dates are closed ends."""

    date_from: date | None = None
    date_to: date | None = None
    categories: tuple[str, ...] = ()
    merchant_contains: str = ""
    account: str = ""
    #: Categories that may be asked for.
    allowed: tuple[str, ...] = field(default=(*CATEGORIES, UNCATEGORIZED), repr=False)

    def __post_init__(self) -> None:
        if self.date_from and self.date_to and self.date_from > self.date_to:
            raise QueryError(f"the range is reversed: {self.date_from} to {self.date_to}")
        unknown = [c for c in self.categories if c not in self.allowed]
        if unknown:
            raise QueryError(f"unknown categories {unknown}; known are {list(self.allowed)}")

    def condition(self) -> Column:
        kept = F.lit(True)
        if self.date_from:
            kept &= F.col("date") >= F.lit(self.date_from)
        if self.date_to:
            kept &= F.col("date") <= F.lit(self.date_to)
        if self.account:
            kept &= F.col("account") == self.account
        if self.categories:
            kept &= labelled(F.col("category")).isin(*self.categories)
        if self.merchant_contains:
            kept &= F.contains(F.lower("merchant"), F.lower(F.lit(self.merchant_contains)))
        return kept

    def describe(self) -> str:
        said = []
        if self.date_from or self.date_to:
            said.append(f"date {self.date_from or '...'} to {self.date_to or '...'}")
        said += [f"category in {', '.join(self.categories)}"] * bool(self.categories)
        said += [f"merchant contains {self.merchant_contains!r}"] * bool(self.merchant_contains)
        said += [f"account {self.account}"] * bool(self.account)
        return "; ".join(said) or "all transactions"


def checked(what: str, value: str, known: tuple[str, ...]) -> str:
    if value not in known:
        raise QueryError(f"unknown {what} {value!r}; known are {list(known)}")
    return value


def aggregate(agg: str) -> Column:
    """The value of an aggregate as money; 0 over no rows."""
    made = {
        "sum": lambda: F.sum("amount"), "count": lambda: F.count("*"), "avg": lambda: average(F.sum("amount"), F.count("*")),
        "max": lambda: F.max("amount"), "min": lambda: F.min("amount"),
    }[checked("aggregate", agg, AGGREGATES)]()
    return F.coalesce(made.cast(MONEY), F.lit(0).cast(MONEY))


def group_key(group_by: str) -> Column:
    return {"category": labelled(F.col("category")), "month": year_month(F.col("date")), "merchant": F.col("merchant"), "none": F.lit("all")}[checked("grouping", group_by, GROUPINGS)]


@dataclass(frozen=True)
class QueryResult:
    """``headline``: one row (matched, value) over all matched rows. ``groups``: (key, count, value) in order, or None."""

    headline: DataFrame
    groups: DataFrame | None
    filters: Filters


def headline(txns: DataFrame, filters: Filters = Filters(), agg: str = "sum") -> DataFrame:
    return txns.where(filters.condition()).agg(F.count("*").alias("matched"), aggregate(agg).alias("value"))


def groups(txns: DataFrame, filters: Filters = Filters(), agg: str = "sum", group_by: str = "category") -> DataFrame:
    """Months in order of time; others by falling value, ties in order of first appearance."""
    made = txns.where(filters.condition()).groupBy(group_key(group_by).alias("key")).agg(F.count("*").alias("count"), aggregate(agg).alias("value"), F.min("seq").alias("__first"))
    order = [F.asc("key")] if group_by == "month" else [F.desc("value"), F.asc("__first"), F.asc("key")]
    return made.orderBy(*order).drop("__first")


def query(txns: DataFrame, filters: Filters = Filters(), agg: str = "sum", group_by: str = "none") -> QueryResult:
    checked("grouping", group_by, GROUPINGS)
    return QueryResult(headline(txns, filters, agg), None if group_by == "none" else groups(txns, filters, agg, group_by), filters)


def headline_and_groups(txns: DataFrame, filters: Filters = Filters(), agg: str = "sum", group_by: str = "category") -> DataFrame:
    """Groups and, with a null key, the headline over all rows, in one pass by grouping sets."""
    keyed = txns.where(filters.condition()).withColumn("key", group_key(group_by))
    return keyed.rollup("key").agg(F.count("*").alias("count"), aggregate(agg).alias("value"))


def describe(txns: DataFrame) -> DataFrame:
    """One row: rows, first and last date, number of accounts (``accounts()`` lists them), rows with a category."""
    return txns.agg(
        F.count("*").alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.count_distinct("account").alias("accounts"), F.count("category").alias("categorized"),
    )


def require_categories(txns: DataFrame) -> None:
    """Raise where no row has a category: a question by category would then be about nothing."""
    if txns.where(F.col("category").isNotNull() & (F.col("category") != "")).limit(1).count() == 0:
        raise QueryError("no transaction has a category yet; categorize first, or group by merchant")


def uncategorized(txns: DataFrame) -> DataFrame:
    return txns.where(F.col("category").isNull() | (F.col("category") == ""))


def accounts(txns: DataFrame) -> DataFrame:
    return txns.groupBy("account").agg(F.count("*").alias("count"), F.min("seq").alias("__first")).orderBy(F.desc("count"), "__first").drop("__first")


def merchants(txns: DataFrame, limit: int = 200) -> DataFrame:
    """The merchants with most transactions, at most 200."""
    if not 1 <= limit <= 200:
        raise QueryError(f"limit must be 1 to 200, not {limit}")
    return txns.groupBy("merchant").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "merchant").limit(limit)


def fetch(txns: DataFrame, filters: Filters = Filters(), limit: int = 50) -> tuple[DataFrame, int]:
    """The first rows that match, and how many do."""
    if not 1 <= limit <= 200:
        raise QueryError(f"limit must be 1 to 200, not {limit}")
    matched = txns.where(filters.condition())
    return matched.orderBy("date", "seq").limit(limit), matched.count()


def after_cursor(events: DataFrame, session_id: str, after: int, limit: int = 500) -> DataFrame:
    """The next events of a session beyond a sequence number, in order."""
    return events.where((F.col("session_id") == session_id) & (F.col("seq") > after)).orderBy("seq").limit(limit)
