from __future__ import annotations

from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from quillspark.api import FinanceTools
from quillspark.errors import IngestError, QueryError
from quillspark.operators import categorize, metrics, query, retrieval, sequences
from quillspark.operators import chunks as C
from quillspark.operators.ledger import LedgerStore
from quillspark.sources import documents as S
from quillspark.sources.ledger import read_labels, write_labels
from quillspark.sources.synthetic import synthetic_bill


@pytest.fixture(scope="module")
def year(spark):
    return synthetic_bill(spark, date(2025, 9, 1), date(2026, 8, 31)).cache()


def test_the_bill_only_grows(spark, year):
    short = synthetic_bill(spark, date(2025, 9, 1), date(2026, 3, 31))
    assert short.exceptAll(year).count() == 0 and short.count() < year.count()


def test_detectors_find_the_traps(year):
    tools = FinanceTools(lambda: year, today=lambda: date(2026, 8, 20))
    assert [r["txn_ids"] for r in tools.find_anomalies("duplicates")["duplicates"].where("merchant = 'TARGET T-1234'").collect()] != []
    rise = tools.find_anomalies("price_increase")["price_increase"].first()
    assert (rise["merchant"], rise["was"], rise["now"]) == ("NETFLIX.COM", D("15.49"), D("19.36"))
    assert "APPLE STORE" in {r["merchant"] for r in sequences.outliers(year).collect()}
    subscriptions, yearly = tools.list_subscriptions()
    assert {"READLY GHOST", "NETFLIX.COM"} <= {r["merchant"] for r in subscriptions.collect()} and yearly > 0
    assert tools.query_transactions(agg="min").headline.first()["value"] == D("-139.99")


def test_tools(spark, year, tmp_path):
    tools = FinanceTools(lambda: year, today=lambda: date(2026, 8, 20))
    assert tools.describe_data().first()["accounts"] == 1
    assert tools.query_transactions(categories=["订阅"], group_by="month").groups.count() == 12
    assert tools.project_spending().is_partial and not tools.project_spending("2026-07").is_partial
    assert {r["merchant"] for r in tools.upcoming_charges(30).collect()} >= {"NETFLIX.COM", "PACIFIC PROPERTY MGMT"}
    assert tools.list_accounts().count() == 1 and tools.list_merchants(3).count() == 3 and tools.fetch_transactions(limit=5)[0].count() == 5
    for wrong in (lambda: tools.find_anomalies("x"), lambda: tools.query_transactions(date_from="1/2/2026"), lambda: tools.search_knowledge("q"), lambda: tools.finance_summary(), lambda: tools.correct_category("a", "b", 0, "r")):
        with pytest.raises(QueryError):
            wrong()
    tools.ledger = LedgerStore(spark, str(tmp_path))
    tools.ledger.import_rows(year.limit(20).withColumn("category", F.lit(None).cast("string")), "x.csv")
    assert tools.correct_category("starbucks", "咖啡", 0, "r1").version == 1
    docs = spark.createDataFrame([(1, "t", "税费 预算")], "doc_id long, title string, text string")
    tools.index = retrieval.build_index(docs, {"title": "title", "body": "text"})
    assert tools.search_knowledge("预算").first()["doc_id"] == 1 and tools.events_status() == {}
    chunks = spark.createDataFrame([(1, "s", "b", "税费 预算"), (2, "s", "b", "rent")], "doc_id long, source string, breadcrumb string, text string")
    tools.embedder = lambda texts: [[float("rent" in t or "Miete" in t), 0.5] for t in texts]
    tools.dense = retrieval.dense_index(chunks, tools.embedder, retrieval.VectorStore(spark, str(tmp_path / "dense")), spark.createDataFrame([], "hash string, vector array<double>"), "m")
    assert [(r["doc_id"], r["channels"]) for r in tools.search_knowledge("Miete").collect()][0] == (2, ["semantic"])


def test_extraction_is_cached_by_content(spark):
    files = spark.createDataFrame([("a.md", b"text", "md"), ("copy.md", b"text", "md"), ("b.pdf", b"x", "pdf"), ("c.bin", b"y", "bin")], "path string, content binary, suffix string")
    cache = spark.createDataFrame([], f"key string, parts {S.PARTS}")
    found = {r["path"]: r for r in S.extracted(files, cache, {"md": S.plain_text}).collect()}
    assert found["a.md"]["parts"][0]["text"] == found["copy.md"]["parts"][0]["text"] == "text" and "no extractor" in found["c.bin"]["error"]
    stored = spark.createDataFrame([(found["a.md"]["key"], [("kept", "", "native", None, None)])], f"key string, parts {S.PARTS}")

    def never(_):
        raise AssertionError

    again = {r["path"]: r for r in S.extracted(files, stored, {"md": never}).collect()}
    assert again["copy.md"]["parts"][0]["text"] == "kept" and "md" in S.available()


def test_rate_windows_equal_a_walk(spark):
    seconds = [0, 10, 59, 60, 61, 119, 120, 121, 300]
    rows = spark.createDataFrame([("k", s) for s in seconds] + [("o", 5)], "k string, s long").withColumn("at", F.timestamp_seconds("s"))
    got = {(r["k"], r["s"]): r["recent"] for r in metrics.rate_windows(rows, "k", "at", 60, 3).collect()}
    assert got == {**{("k", s): sum(s - 60 <= t <= s for t in seconds) for s in seconds}, ("o", 5): 1}


def test_corpus_of_files(spark):
    body = "正文内容" * 20
    files = spark.createDataFrame([("/k/a.md", f"# 预算\n{body}".encode(), "md"), ("/k/n/a.md", f"# 预算\n{body}".encode(), "md"), ("/k/b.txt", ("x" * 1000).encode(), "txt"), ("/k/short.txt", b"short", "txt"), ("/k/c.pdf", b"", "pdf")], "path string, content binary, suffix string")
    parts = S.extracted(files, spark.createDataFrame([], f"key string, parts {S.PARTS}"), {"md": S.plain_text, "txt": S.plain_text}).withColumn("suffix", F.regexp_extract("path", r"\.(\w+)$", 1))
    rows = {(r["breadcrumb"], len(r["text"])) for r in C.load_corpus(parts, "/k/").collect()}
    assert rows == {("a.md > 预算", 80), ("n/a.md > 预算", 80), ("b.txt", 900), ("b.txt （续）", 100), ("short.txt", 5)}


def test_pages_slides_and_pictures_are_recognized():
    from types import SimpleNamespace as N

    seen = S.Reading(lambda raw: raw.decode())
    page = lambda text, images, picture: N(get_text=lambda *_, **__: text, get_images=lambda: images, rect=N(width=10, height=10), get_pixmap=lambda **_: N(tobytes=lambda _: picture))
    pages = [page("plain", [], b"never"), page("", [], b"scanned"), page("a b\nc", [1], b"ab\nd"), page("", [], b" ")]
    assert list(S.page_parts(pages, seen)) == [("plain", "第1页", "native", 1, None), ("scanned", "第2页", "ocr", 2, None), ("a b\nc\nd", "第3页", "native+ocr", 3, None)]
    with pytest.raises(IngestError):
        list(S.page_parts([page("", [], b"x")], S.Reading(mode="off")))
    cells = [N(cells=[N(text="x"), N(text="1")]), N(cells=[N(text="y"), N(text="2")])]
    inner = [N(has_text_frame=True, has_table=False, text=" 预算 "), N(has_text_frame=False, has_table=True, table=N(rows=cells)), N(has_text_frame=False, has_table=False, image=N(blob=b"chart"))]

    class Shapes(list):
        title = N(text="题")

    slide = N(shapes=Shapes([N(shapes=inner)]), has_notes_slide=True, notes_slide=N(notes_text_frame=N(text="note")))
    assert [p[:3] for p in S.slide_parts([slide], seen)] == [
        ("预算", "幻灯片1：题", "native"), ("x\t1\ny\t2", "幻灯片1：题 > 表格", "table"), ("chart", "幻灯片1：题 > 图片", "ocr"), ("note", "幻灯片1：题 > 备注", "notes")
    ]
    assert list(S.frame_parts([(1, 1, b"one"), (1, 1, b" ")], seen)) == [("one", "图片第1页", "ocr", 1, None)]
    with pytest.raises(IngestError):
        list(S.frame_parts([(10_000, 10_000, b"")], seen))


def test_small_helpers(spark, tmp_path, year):
    events = spark.createDataFrame([("s", i) for i in range(6)] + [("o", 9)], "session_id string, seq int")
    assert [r["seq"] for r in query.after_cursor(events, "s", 3).collect()] == [4, 5]
    known = spark.createDataFrame([("a", "咖啡"), ("b", "购物")], "merchant_key string, category string")
    decided = spark.createDataFrame([("b", "旅行", "model"), ("c", "其他", "model"), ("a", "咖啡", "cache")], "merchant_key string, category string, tier string")
    assert {tuple(r) for r in categorize.updated_cache(known, decided).collect()} == {("a", "咖啡"), ("b", "旅行"), ("c", "其他")}
    write_labels(year, str(tmp_path / "labels"))
    assert read_labels(spark, str(tmp_path / "labels")).count() == year.count()
