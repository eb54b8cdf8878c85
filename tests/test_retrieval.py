from __future__ import annotations

import math
import os
from collections import Counter

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quillspark.errors import QueryError
from quillspark.functions.text import tokens
from quillspark.operators import chunks as C
from quillspark.operators import retrieval as R
from quillspark.storage import write_mark

TEXTS = {1: "税费 与 LPR 利率", 2: "费用 利率 利率", 3: "", 4: None, 5: "LPR lpr Rate", 6: "怎么 的"}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, t) for i, t in TEXTS.items()], "doc_id long, title string, text string")


def split(spark, text, drop=True):
    return spark.createDataFrame([(text,)], "t string").select(tokens(F.col("t"), drop)).first()[0]


def test_tokens(spark):
    assert sorted(split(spark, "税费")) == ["税", "税费", "费"]
    assert split(spark, "LPR 利率") == ["lpr", "利", "率", "利率"]
    assert split(spark, "的了的") == [] and split(spark, "的了的", False) != []
    assert split(spark, "A税x9") == ["a税x9"] and split(spark, None) == []


def test_bm25_equals_the_formula(docs, spark):
    index = R.build_index(docs, {"title": "title", "body": "text"})
    got = {r["doc_id"]: r["score"] for r in R.bm25(index, "body", "利率 LPR").collect()}
    counts = {i: Counter(split(spark, t)) for i, t in TEXTS.items()}
    average = sum(sum(c.values()) for c in counts.values()) / len(counts)
    expected = {}
    for token in set(split(spark, "利率 LPR")):
        df = sum(token in c for c in counts.values())
        for i, c in counts.items():
            if token in c:
                idf = math.log(1 + (len(counts) - df + 0.5) / (df + 0.5))
                expected[i] = expected.get(i, 0) + idf * c[token] * 2.5 / (c[token] + 1.5 * (0.25 + 0.75 * sum(c.values()) / average))
    assert got == pytest.approx(expected)
    assert R.bm25(index, "body", "怎么").count() == 0  # filtered from the index too
    assert R.bm25(R.build_index(docs.limit(0), {"body": "text"}), "body", "利率").count() == 0


def test_fusion(docs):
    index = R.build_index(docs, {"title": "title", "body": "text"})
    best = R.search(index, "费用").first()
    assert best["doc_id"] == 2 and best["score"] == pytest.approx(2 / 61) and best["channels"] == ["body", "title"]
    assert R.search(index, "  ").count() == 0


def test_index_is_reused_until_the_texts_change(docs, spark, tmp_path):
    fields, folder = {"title": "title", "body": "text"}, str(tmp_path / "index")
    docs.write.parquet(str(tmp_path / "docs"))
    stored = spark.read.parquet(str(tmp_path / "docs"))
    R.load_or_build(stored, fields, folder)
    before = (tmp_path / "index" / "mark").read_text()
    for file in (tmp_path / "docs").glob("*.parquet"):  # the texts themselves are not read again
        held = file.stat()
        file.write_bytes(b"x" * held.st_size)
        os.utime(file, ns=(held.st_atime_ns, held.st_mtime_ns))
    assert R.bm25(R.load_or_build(stored, fields, folder), "body", "利率").count() == 2
    assert (tmp_path / "index" / "mark").read_text() == before
    # Without files the texts decide, in any order.
    R.load_or_build(docs, fields, folder)
    before = (tmp_path / "index" / "mark").read_text()
    R.load_or_build(docs.orderBy(F.desc("doc_id")), fields, folder)
    assert (tmp_path / "index" / "mark").read_text() == before
    assert R.load_or_build(docs.where("doc_id <> 1"), fields, folder).totals.first()["docs"] == 5
    write_mark(spark, f"{folder}/mark", "gone x")
    with pytest.raises(AnalysisException):  # a damaged index is an error, not a reason to overwrite it
        R.load_or_build(docs, fields, folder)
    assert R.load_index(spark, str(tmp_path / "none")) is None


def test_postings_carry_lengths(docs):
    index = R.build_index(docs, {"body": "text"})
    rows = {(r["token"], r["doc_id"]): (r["tf"], r["length"]) for r in index.postings.collect()}
    assert rows["利率", 2] == (2, 9) and rows["rate", 5] == (1, 3)
    assert {r["token"]: r["df"] for r in index.terms.collect()}["利率"] == 2


def test_nearest_and_parents(spark, monkeypatch):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, [2.0, 0.0]), (5, None)], "vec_id long, embedding array<double>")
    asked = [(7, [1.0, 0.0]), (8, [0.0, 3.0])]
    expected = [(7, 1, 0.0), (7, 4, 0.0), (8, 2, 0.0), (8, 1, 1.0)]
    found = lambda rows: [(r["query_id"], r["id"], round(r["distance"], 9)) for r in rows.orderBy("query_id", "rank").collect()]
    assert found(R.nearest(vectors, asked, 2)) == expected
    table = spark.createDataFrame(asked, "query_id long, vector array<double>")
    assert found(R.nearest_all(vectors, table, 2)) == expected and R.nearest_all(vectors.limit(0), table, 2).count() == 0
    monkeypatch.setattr(R, "MOST_ROWS", 1)
    monkeypatch.setattr(R, "MOST_QUERIES", 1)
    assert found(R.nearest_all(vectors, table, 2)) == expected  # a grid of many cells
    monkeypatch.undo()
    owners = spark.createDataFrame([(1, 10), (4, 10), (2, 20)], "id long, parent_id long")
    assert [r["parent_id"] for r in R.parents(R.nearest(vectors, [(7, [1.0, 0.1])], 4), owners).orderBy("rank").collect()] == [10, 20]
    assert R.nearest(vectors, [], 2).count() == 0


def test_dense_index_is_reused_and_searched(spark, tmp_path):
    rows = [(1, "a.md", "x", "税费"), (2, "a.md", "y", "b" * 250), (3, "a.md", None, None)]
    chunks = spark.createDataFrame(rows, "doc_id long, source string, breadcrumb string, text string")
    store, cache = R.VectorStore(spark, str(tmp_path)), spark.createDataFrame([], "hash string, vector array<double>")
    with pytest.raises(QueryError):
        store.vectors()
    embedder = lambda batch: [[float(t.count("b")), 1.0] for t in batch]
    children = R.dense_index(chunks, embedder, store, cache, "m")
    assert {(r["parent_id"], tuple(r["vector"])) for r in children.collect()} == {(1, (0.0, 1.0)), (2, (200.0, 1.0)), (2, (50.0, 1.0))}
    mark = (tmp_path / "mark").read_text()
    R.dense_index(chunks, embedder, store, cache, "m")
    assert (tmp_path / "mark").read_text() == mark
    R.dense_index(chunks.where("doc_id < 2"), embedder, store, cache, "m")
    assert store.vectors().count() == 1
    R.dense_index(chunks, embedder, store, cache, "other")
    children = store.vectors()
    for way in (False, True):
        assert [(r["doc_id"], r["rank"]) for r in R.dense_ranks(children, [1.0, 0.0], 30, way).orderBy("rank").collect()] == [(2, 1), (1, 2)]
    assert R.dense_ranks(children, [1.0, 0.0], 2).count() == 1 and R.dense_ranks(children, [1.0, 0.0], 2, True).count() == 2
    index = R.build_index(chunks.withColumnRenamed("breadcrumb", "title"), {"title": "title", "body": "text"})
    fused = {r["doc_id"]: r["channels"] for r in R.search(index, "税费", semantic=R.dense_ranks(children, [1.0, 0.0])).collect()}
    assert fused == {1: ["body", "semantic"], 2: ["semantic"]}


def test_rerank(spark):
    hits = spark.createDataFrame([(1, "long text", 0.5, ["a"]), (2, "x", 0.4, ["a"]), (3, "skip", 0.9, ["a"])], "doc_id long, text string, score double, channels array<string>")

    def scorer(_, text):
        return pd.Series([None if t == "skip" else -float(len(t)) for t in text])

    assert [r["doc_id"] for r in R.rerank("q", hits, scorer).collect()] == [2, 1, 3]

    def broken(*_):
        raise RuntimeError

    assert [r["doc_id"] for r in R.rerank("q", hits, broken).collect()] == [3, 1, 2]


def test_rerank_is_all_or_nothing_and_cached(spark):
    hits = spark.createDataFrame([(i, "t" * i, 1.0 / i, ["a"]) for i in range(1, 9)], "doc_id long, text string, score double, channels array<string>").repartition(4)

    def once(_, text):
        if len(text) < 8:
            raise RuntimeError("the pool was torn")
        return text.str.len().astype("float64")

    assert [r["doc_id"] for r in R.rerank("q", hits, once).collect()] == [8, 7, 6, 5, 4, 3, 2, 1]
    store = spark.createDataFrame([], "hash string, score double")
    first, fresh = R.rerank_cached("q", hits, once, store, "m")
    again, none = R.rerank_cached("q", hits, lambda *_: 1 / 0, fresh, "m")
    assert [r["doc_id"] for r in first.collect()] == [r["doc_id"] for r in again.collect()] and none.count() == 0 and fresh.count() == 8


def test_embedding_cache(spark):
    texts = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "text string")
    store = spark.createDataFrame([("a", [9.0])], "t string, vector array<double>").select(F.sha1("t").alias("hash"), "vector")
    rows = R.embed(texts, store, lambda batch: [[float(len(t))] for t in batch]).collect()
    assert sorted(r["vector"] for r in rows) == [[1.0], [9.0]]


def test_grep(docs):
    assert [(r["doc_id"], r["hits"]) for r in R.grep(docs, "利率 税费").collect()] == [(1, 2), (2, 1)]


def test_sections():
    body = "正文" * 20
    text = f"# 个税基础\n{body}\n## 专项附加扣除\nshort\n### 住房贷款利息 ##\n{body}\n# 二\n" + "段落" * 300 + "\n\n" + "字" * 2000
    found = C.sections(text, "个税基础.md")
    assert [b for b, _ in found][:2] == ["个税基础.md > 个税基础", "个税基础.md > 个税基础 > 专项附加扣除 > 住房贷款利息"]
    assert all(len(t) <= 900 for _, t in found) and found[3][0] == "个税基础.md > 二 （续）"
    assert C.sections("", "x") == [] and C.sections("#" * 7 + " x", "x") == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab \n", min_size=1, max_size=9), max_size=12), st.integers(5, 20))
def test_long_parts_lose_nothing_but_white_space(paragraphs, most):
    text = "\n\n".join(paragraphs).strip()
    parts = C.long_parts(text, most)
    assert "".join("".join(parts).split()) == "".join(text.split())
    assert all(len(p) <= most for p in parts) or len(text) <= most
    words = C.long_parts("\n\n".join("".join(p.split()) or "x" for p in paragraphs), most)
    # No part could have taken the next one whole.
    assert all(len(f"{a}\n\n{b}") > most for a, b in zip(words, words[1:]))


def test_headings():
    found = {"# a": (1, "a"), "## a ##": (2, "a"), "###### a # #": (6, "a #"), "# ##": (1, "#"), "#a": None, "# ": None, "a # b": None, "####### a": None}
    assert {line: C.heading(line) for line in found} == found


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab。；，\n ", max_size=900))
def test_children_join_to_the_text(text):
    parts = C.pieces(text)
    assert "".join(parts) == text and all(len(p) <= 200 for p in parts)


def test_chunk_frames(spark):
    docs = spark.createDataFrame([(1, "s", "x" * 450), (2, "s", None), (3, None, "  ")], "doc_id long, source string, text string")
    assert C.split_children(docs).groupBy("doc_id").count().collect()[0]["count"] == 3
    assert C.split_long(docs).count() == 2 and C.chunk_markdown(docs).count() == 1


def test_source_files_and_merge(spark, tmp_path):
    for name in ("a.md", "b/c.PDF", "b/a.md", ".hidden/d.md", "e.txt", "f.tif"):
        path = tmp_path / ".kept" / name
        path.parent.mkdir(exist_ok=True, parents=True)
        path.write_text("x")
    assert sorted(r["source"] for r in C.source_files(spark, f"{tmp_path}/.kept").collect()) == ["a.md", "b/a.md", "b/c.PDF", "f.tif"]
    row = spark.createDataFrame([("a b\nc", "ab\nd\n ")], "n string, r string").select(C.merged_text("n", "r")).first()
    assert row[0] == "a b\nc\nd"
