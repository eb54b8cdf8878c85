"""What a caller can ask: one method for each tool, over a ledger and a text index.

Arguments are plain values, as a tool call has them; results are DataFrames or
small values. Unknown values are errors, never empty answers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import QueryError
from .operators import forecast, query, retrieval, sequences
from .operators.ledger import Correction, ImportResult, LedgerStore
from .operators.query import Filters, QueryResult
from .streaming.projections import Projection

#: Items that a report shows.
SHOWN_GROUPS, SHOWN_ANOMALIES, SHOWN_ROWS = 40, 20, 50


def day(text: str) -> date | None:
    if not text:
        return None
    try:
        return date.fromisoformat(text)
    except ValueError as wrong:
        raise QueryError(f"a date is written YYYY-MM-DD, not {text!r}") from wrong


@dataclass
class FinanceTools:
    """``bill`` gives the current transactions, so that corrections are seen by the next question."""

    bill: Callable[[], DataFrame]
    index: retrieval.TextIndex | None = None
    #: Child vectors of the index (``retrieval.dense_index``) and what embeds a question; without them search is lexical.
    dense: DataFrame | None = None
    embedder: retrieval.Embedder | None = None
    ledger: LedgerStore | None = None
    projections: dict[str, Projection] | None = None
    today: Callable[[], date] = date.today

    def describe_data(self) -> DataFrame:
        return query.describe(self.bill())

    def query_transactions(
        self, date_from: str = "", date_to: str = "", categories: list[str] | None = None, merchant_contains: str = "", account: str = "", agg: str = "sum", group_by: str = "none"
    ) -> QueryResult:
        txns = self.bill()
        if categories or group_by == "category":
            query.require_categories(txns)
        filters = Filters(day(date_from), day(date_to), tuple(categories or ()), merchant_contains, account)
        found = query.query(txns, filters, agg, group_by)
        return found if found.groups is None else QueryResult(found.headline, found.groups.limit(SHOWN_GROUPS), filters)

    def find_anomalies(self, kind: str = "all", group_by: str = "merchant") -> dict[str, DataFrame]:
        txns = self.bill()
        makers: dict[str, Callable[[], DataFrame]] = {
            "duplicates": lambda: sequences.duplicate_charges(txns).orderBy(F.element_at("dates", 1), "merchant"),
            "price_increase": lambda: sequences.price_increases(txns),
            "outlier": lambda: sequences.outliers(txns, group_by).orderBy(F.desc("ratio"), "txn_id"),
        }
        if kind != "all" and kind not in makers:
            raise QueryError(f"unknown kind {kind!r}; known are all, {', '.join(makers)}")
        return {name: make().limit(SHOWN_ANOMALIES) for name, make in makers.items() if kind in ("all", name)}

    def list_subscriptions(self) -> tuple[DataFrame, Any]:
        """The recurring charges, and what they cost in a year."""
        txns = self.bill()
        return sequences.subscriptions(txns), sequences.subscription_total(txns).first()["yearly"]

    def project_spending(self, month: str = "") -> forecast.Projection:
        today = self.today()
        start, end = forecast.month_bounds(month or today.strftime("%Y-%m"))
        return forecast.project_period(self.bill(), start, end, today)

    def upcoming_charges(self, days: int = forecast.HORIZON_DAYS) -> DataFrame:
        return forecast.upcoming_charges(self.bill(), self.today(), days)

    def search_knowledge(self, question: str) -> DataFrame:
        if self.index is None:
            raise QueryError("there is no index of texts")
        semantic = None
        if self.dense is not None and self.embedder is not None and question.strip():
            semantic = retrieval.dense_ranks(self.dense, self.embedder([question])[0])
        return retrieval.search(self.index, question, retrieval.TOP, semantic=semantic)

    def correct_category(self, merchant: str, category: str, expected_version: int | None = None, request_id: str | None = None) -> Correction:
        if self.ledger is None:
            raise QueryError("corrections need a stored ledger")
        return self.ledger.correct_category(merchant, category, expected_version, request_id)

    def import_ledger(self, rows: DataFrame, source_name: str, data: bytes, tagged: DataFrame | None = None) -> ImportResult:
        """Import the rows read from a file, or the same rows with categories."""
        if self.ledger is None:
            raise QueryError("imports need a stored ledger")
        return self.ledger.import_file(rows, source_name, data, tagged)

    def list_accounts(self) -> DataFrame:
        return query.accounts(self.bill())

    def list_merchants(self, limit: int = 200) -> DataFrame:
        return query.merchants(self.bill(), limit)

    def fetch_transactions(self, date_from: str = "", date_to: str = "", account: str = "", limit: int = SHOWN_ROWS) -> tuple[DataFrame, int]:
        return query.fetch(self.bill(), Filters(day(date_from), day(date_to), (), "", account), limit)

    def finance_summary(self, account: str = "") -> DataFrame:
        return self._projected("summary", account).orderBy("account", "month")

    def finance_anomalies(self, account: str = "") -> DataFrame:
        return self._projected("anomalies", account).orderBy("account", F.element_at("dates", 1), "merchant_key")

    def _projected(self, consumer: str, account: str) -> DataFrame:
        if not self.projections or consumer not in self.projections:
            raise QueryError(f"there is no projection {consumer}")
        rows = self.projections[consumer].result()
        return rows.where(F.col("account") == account) if account else rows

    def events_status(self) -> dict[str, int]:
        """Events applied by each consumer."""
        return {name: p.applied().count() for name, p in (self.projections or {}).items()}
