from __future__ import annotations

from datetime import date
from decimal import Decimal as D

import pytest

from quillspark.errors import QueryError
from quillspark.operators import forecast as P

from conftest import months


def test_projection(charges):
    txns = charges(("X", [(date(2026, 9, 1), 100), (date(2026, 9, 11), 100)]))
    p = P.project_period(txns, date(2026, 9, 1), date(2026, 9, 30), date(2026, 9, 11))
    assert (p.observed, p.observed_days, p.total_days, p.projected, p.daily_rate, p.is_partial, p.is_complete) == (D("200.00"), 11, 30, D("545.45"), D("18.18"), True, False)


def test_complete_month(charges):
    txns = charges(("X", [(date(2026, 8, 1), 100), (date(2026, 8, 31), 200)]))
    p = P.project_period(txns, *P.month_bounds("2026-08"), date(2026, 9, 22))
    assert (p.projected, p.is_partial, p.is_complete) == (D("300.00"), False, True)


@pytest.mark.parametrize("start,end,today", [("2026-10-01", "2026-10-31", "2026-10-05"), ("2026-07-01", "2026-07-31", "2026-09-30"), ("2026-12-01", "2026-12-31", "2026-09-30"), ("2026-09-30", "2026-09-01", "2026-09-30")])
def test_refusals(charges, start, end, today):
    txns = charges(("X", [(date(2026, 8, 1), 100), (date(2026, 9, 11), 100)]))
    with pytest.raises(QueryError):
        P.project_period(txns, *map(date.fromisoformat, (start, end, today)))


def test_empty_ledger_and_bad_month(charges):
    with pytest.raises(QueryError):
        P.project_period(charges(("X", [(date(2026, 1, 1), 1)])).limit(0), date(2026, 1, 1), date(2026, 1, 31), date(2026, 1, 5))
    for wrong in ("2026-13", "x"):
        with pytest.raises(QueryError):
            P.month_bounds(wrong)


def upcoming(charges, days, amounts, today, horizon=30):
    rows = P.upcoming_charges(charges(("M", list(zip(days, amounts)))), date.fromisoformat(today), horizon).collect()
    return [(r["next_date"].isoformat(), str(r["amount"])) for r in rows]


def test_monthly_quarterly_and_month_ends(charges):
    prices = [15.49, 15.49, 19.36, 19.36, 19.36]
    assert upcoming(charges, months(2026, 5, 5, 5), prices, "2026-09-10", 40) == [("2026-10-05", "19.36")]
    assert upcoming(charges, months(2025, 1, 15, 4, 3), [50] * 4, "2025-11-01", 120) == [("2026-01-15", "50.00")]
    rent = [date(2025, 10, 31), date(2025, 11, 30), date(2025, 12, 31), date(2026, 1, 31)]
    assert upcoming(charges, rent, [9] * 4, "2026-02-01") == [("2026-02-28", "9.00")]
    assert upcoming(charges, rent, [9] * 4, "2026-03-01") == [("2026-03-31", "9.00")]
    assert upcoming(charges, months(2026, 5, 5, 5), prices, "2026-09-10", 5) == []
    with pytest.raises(QueryError):
        upcoming(charges, rent, [9] * 4, "2026-03-01", 0)


def test_coverage(golden):
    rows = P.coverage(golden, date(2026, 4, 10)).collect()
    assert [(r["year_month"], r["first"].day, r["last"].day, r["count"], r["lag_days"]) for r in rows] == [("2026-01", 5, 20, 2, 10), ("2026-02", 3, 28, 3, 10), ("2026-03", 1, 31, 3, 10)]
    assert P.coverage(golden.limit(0), date(2026, 4, 10)).count() == 0
