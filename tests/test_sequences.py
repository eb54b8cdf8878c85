from __future__ import annotations

import statistics
from datetime import date, timedelta
from decimal import Decimal as D

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quillspark.errors import QueryError
from quillspark.operators import sequences as W

from conftest import months


def test_duplicates(charges, bill):
    day = date(2026, 3, 14)
    found = W.duplicate_charges(bill([("A", day, "T", "188.40", "a", None), ("B", day, "T", "188.40", "b", None), ("C", day, "T", "12.80", "a", None)])).collect()
    assert [(r["merchant"], r["txn_ids"], r["dates"]) for r in found] == [("T", ["A", "B"], [day, day])]
    apart = charges(("X", [(date(2026, 3, 1), 10), (date(2026, 3, 20), 10)]))
    assert W.duplicate_charges(apart).count() == 0 and W.duplicate_charges(apart, 30).count() == 1


def test_duplicates_chain_and_keep_null_keys(bill):
    days = [date(2026, 1, d) for d in (1, 4, 7, 20)]
    rows = bill([(str(i), d, None, "-1.00", "a", None) for i, d in enumerate(days)] + [("n", None, None, "-1.00", "a", None)])
    found = W.duplicate_charges(rows).collect()
    assert [(r["merchant"], r["txn_ids"]) for r in found] == [(None, ["0", "1", "2"])]


def test_account_duplicates(spark):
    rows = [("1", "card", "2026-10-01", "target", "10.00"), ("5", "card", "2026-10-03", "target", "10.00"), ("7", "other", "2026-10-02", "target", "10.00"), ("8", "card", "2026-10-02", "target", "-10.00"), ("9", "card", "2026-10-02", "target", "-10.00")]
    txns = spark.createDataFrame(rows, "txn_id string, account string, day string, merchant_key string, money string").selectExpr("*", "cast(day as date) as date", "cast(money as decimal(20,2)) as amount")
    assert [r["txn_ids"] for r in W.account_duplicates(txns).collect()] == [["1", "5"]]


def netflix():
    return [(d, 15.49) for d in months(2026, 1, 5, 6)] + [(d, 19.36) for d in months(2026, 7, 5, 6)]


def test_price_rise(charges):
    rise = W.price_increases(charges(("NETFLIX", netflix()))).first()
    assert (rise["was"], rise["now"], rise["since"], rise["occurrences"], rise["yearly_extra"]) == (D("15.49"), D("19.36"), date(2026, 7, 5), 12, D("46.44"))


@pytest.mark.parametrize("first,then,percent,found", [(11.99, 9.99, 5, 0), (10.00, 10.30, 5, 0), (10.00, 10.30, 1, 1), (10.00, 10.50, 5, 0)])
def test_other_prices(charges, first, then, percent, found):
    days = months(2026, 1, 5, 12)
    assert W.price_increases(charges(("S", [(d, first if i < 6 else then) for i, d in enumerate(days)])), percent).count() == found


def test_what_recurs(charges):
    txns = charges(
        ("MONTHLY", [(d, 10) for d in months(2026, 1, 5, 6)]),
        ("VARIED", [(d, 10 + i) for i, d in enumerate(months(2026, 1, 5, 6))]),
        ("CAFE", [(date(2026, 1, 3), 5), (date(2026, 1, 9), 5), (date(2026, 5, 2), 5), (date(2026, 11, 20), 5)]),
        ("DAILY", [(date(2026, 1, d), 3) for d in range(1, 11)]),
        ("FEW", [(d, 10) for d in months(2026, 1, 5, 3)]),
    )
    found = W.subscriptions(txns).collect()
    assert [(r["merchant"], r["monthly"], r["yearly"], r["first_seen"], r["last_seen"]) for r in found] == [("MONTHLY", D("10.00"), D("120.00"), date(2026, 1, 5), date(2026, 6, 5))]
    assert W.subscription_total(txns).first()["yearly"] == D("120.00")
    assert W.subscriptions(txns.limit(0)).count() == 0


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(0, 45), min_size=3, max_size=9), min_size=1, max_size=12))
def test_regularity_equals_the_statistics_module(charges, gap_lists):
    series = []
    for i, gaps in enumerate(gap_lists):
        days = [date(2024, 1, 1)]
        for g in gaps:
            days.append(days[-1] + timedelta(days=g))
        series.append((f"M{i}", [(d, 9) for d in days]))
    found = {r["merchant"] for r in W.recurring(charges(*series)).collect()}
    expected = {
        f"M{i}" for i, gaps in enumerate(gap_lists) if statistics.median(gaps) >= 20 and statistics.mean(gaps) > 0 and D(str(statistics.stdev(gaps) / statistics.mean(gaps))) <= D("0.25")
    }
    assert found == expected


def test_outliers(bill, charges):
    rows = [(f"c{i}", date(2026, 1, 1), "C", "5.00", "a", "咖啡") for i in range(9)] + [("big", date(2026, 1, 2), "C", "3800.00", "a", "咖啡")]
    rows += [(f"s{i}", date(2026, 1, 1), "S", "200.00", "a", "购物") for i in range(9)] + [("t1", date(2026, 1, 1), "T", "1.00", "a", "旅行"), ("t2", date(2026, 1, 1), "T", "900.00", "a", "旅行")]
    found = W.outliers(bill(rows)).collect()
    assert [(r["txn_id"], r["group"], r["threshold"], r["ratio"]) for r in found] == [("big", "咖啡", D("5.00"), D("760.00"))]
    with pytest.raises(QueryError):
        W.outliers(charges(("X", [(date(2026, 1, 1), 1)] * 5)))
    with pytest.raises(QueryError):
        W.outliers(bill(rows), "week")


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-500, 5000), min_size=2, max_size=40))
def test_quartiles_equal_the_statistics_module(bill, cents):
    values = [D(c) / 100 for c in cents]
    row = W.quartiles(bill([(str(i), date(2026, 1, 1), "M", str(v), "a", None) for i, v in enumerate(values)]), "merchant").first()
    cut = statistics.quantiles(sorted(values), n=100, method="inclusive")
    assert (D(row["q1"]) / 10_000, D(row["q3"]) / 10_000) == (cut[24], cut[74])
