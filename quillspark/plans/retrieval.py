"""Queries of the retrieval operators: tokens, BM25, vectors, fusion, chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import cosine_distance
from ..functions.text import CJK, STOPWORDS, tokens
from ..operators import chunks, retrieval
from ..session import checkpoint_root
from ..storage import fingerprint_of
from ..sources.tables import table
from .registry import Registry

registry = Registry()
add = registry.add

QUESTION = "订阅 budget 提醒"


def docs(spark: SparkSession, folder: str) -> DataFrame:
    """The sections of the knowledge base with their breadcrumb as title."""
    return table(spark, folder, "knowledge_chunks").select(F.col("chunk_id").alias("doc_id"), "source", "text", F.col("breadcrumb").alias("title"))


_CHARS = f"[{CJK}]"
_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"
_SINGLE = "[" + ", ".join(f"'{w}'" for w in STOPWORDS if len(w) == 1) + "]"


def _tokens(text: str) -> str:
    """A list of tokens in SQL, without stop words."""
    runs = f"regexp_extract_all(coalesce({text}, ''), '({_CHARS}+|[\\p{{L}}\\p{{N}}]+)', 1)"
    of = (
        f"CASE WHEN regexp_matches(r, '^{_CHARS}') THEN list_concat(list_transform(range(1, length(r) + 1), lambda i: substring(r, i, 1)), "
        "list_transform(range(1, length(r)), lambda i: substring(r, i, 2))) ELSE [lower(r)] END"
    )
    stop = f"list_contains({_STOP}, t) OR (length(t) = 2 AND list_contains({_SINGLE}, substring(t, 1, 1)) AND list_contains({_SINGLE}, substring(t, 2, 1)))"
    return f"list_filter(flatten(list_transform({runs}, lambda r: {of})), lambda t: NOT ({stop}))"


_DOCS = "(SELECT chunk_id AS doc_id, source, text, breadcrumb AS title FROM knowledge_chunks)"


@add("tokenize_docs", f"SELECT doc_id, t AS token, count(*) AS tf FROM (SELECT doc_id, unnest({_tokens('text')}) AS t FROM documents) GROUP BY 1, 2")
def tokenize_docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.explode(tokens(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("tf"))


def _bm25(field: str, docs: str = _DOCS, question: str = QUESTION) -> str:
    return f"""WITH d AS (SELECT doc_id, {_tokens(field)} AS tokens FROM {docs} x), l AS (SELECT doc_id, len(tokens) AS length FROM d), n AS (SELECT count(*) AS docs, avg(length) AS average FROM l),
q AS (SELECT DISTINCT unnest({_tokens(f"'{question}'")}) AS token), p AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS token FROM d) JOIN q USING (token) GROUP BY 1, 2),
f AS (SELECT token, count(*) AS df FROM p GROUP BY token)
SELECT p.doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / average))), 6) AS score FROM p JOIN f USING (token) JOIN l USING (doc_id), n GROUP BY p.doc_id"""


def _index(spark: SparkSession, folder: str) -> retrieval.TextIndex:
    """The stored index of the knowledge base, built by the first query that needs it."""
    return _stored(docs(spark, folder), {"title": "title", "body": "text"})


def _stored(texts: DataFrame, fields: dict[str, str]) -> retrieval.TextIndex:
    spark = texts.sparkSession
    return retrieval.load_or_build(texts, fields, f"{checkpoint_root(spark)}/index-{fingerprint_of(texts, *fields)}")


@add("bm25_body", _bm25("text", "documents"))
def bm25_body(spark: SparkSession, folder: str) -> DataFrame:
    index = _stored(table(spark, folder, "documents").select("doc_id", "text"), {"body": "text"})
    return retrieval.bm25(index, "body", QUESTION).select("doc_id", F.round("score", 6).alias("score"))


@add("bm25_title", _bm25("title"))
def bm25_title(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.bm25(_index(spark, folder), "title", QUESTION).select("doc_id", F.round("score", 6).alias("score"))


@add("index_totals", f"SELECT 'body' AS field, count(*) AS docs, round(avg(len({_tokens('text')})), 6) AS average FROM {_DOCS} x UNION ALL SELECT 'title', count(*), round(avg(len({_tokens('title')})), 6) FROM {_DOCS} x")
def index_totals(spark: SparkSession, folder: str) -> DataFrame:
    return _index(spark, folder).totals.select("field", "docs", F.round("average", 6).alias("average"))


def _channel(field: str, name: str, question: str = QUESTION) -> str:
    return f"SELECT doc_id, '{name}' AS channel, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM ({_bm25(field, question=question)}) s ORDER BY rank LIMIT 30"


_RRF = f"SELECT doc_id, round(sum(1.0 / (60 + rank)), 9) AS score, string_agg(channel, ',' ORDER BY channel) AS channels FROM (SELECT * FROM ({_channel('title', 'title')}) UNION ALL SELECT * FROM ({_channel('text', 'body')})) GROUP BY doc_id"


def _fused(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.round("score", 9).alias("score"), F.array_join("channels", ",").alias("channels"))


@add("rrf_fuse", _RRF)
def rrf_fuse(spark: SparkSession, folder: str) -> DataFrame:
    index = _index(spark, folder)
    return _fused(retrieval.fuse([retrieval.ranked(retrieval.bm25(index, f, QUESTION), f) for f in ("title", "body")]))


@add("search_top", f"SELECT * FROM ({_RRF}) r ORDER BY score DESC, length(channels) - length(replace(channels, ',', '')) DESC, doc_id LIMIT 4")
def search_top(spark: SparkSession, folder: str) -> DataFrame:
    return _fused(retrieval.search(_index(spark, folder), QUESTION))


ASKED = ("订阅 涨价", "budget rent", "保险费 年缴")
_MORE = " UNION ALL ".join(f"SELECT * FROM ({_channel('text', f'q{i}', q)})" for i, q in enumerate(ASKED))
_ORDER = "score DESC, length(channels) - length(replace(channels, ',', '')) DESC, doc_id"


@add("rrf_multi_query", f"SELECT * FROM (SELECT doc_id, round(sum(1.0 / (60 + rank)), 9) AS score, string_agg(channel, ',' ORDER BY channel) AS channels FROM ({_MORE}) GROUP BY doc_id) ORDER BY {_ORDER} LIMIT 20")
def rrf_multi_query(spark: SparkSession, folder: str) -> DataFrame:
    index = _index(spark, folder)
    channels = [retrieval.ranked(retrieval.bm25(index, "body", q), f"q{i}") for i, q in enumerate(ASKED)]
    return _fused(retrieval.fuse(channels, 20))


@add("rerank_stub", f"SELECT r.doc_id, CAST(-length(d.text) AS DOUBLE) AS rerank_score, score FROM (SELECT * FROM ({_RRF}) ORDER BY {_ORDER} LIMIT 20) r JOIN {_DOCS} d ON d.doc_id = r.doc_id")
def rerank_stub(spark: SparkSession, folder: str) -> DataFrame:
    """Search, then reorder the pool by a scorer that prefers short texts."""
    texts = docs(spark, folder)
    hits = retrieval.search(_index(spark, folder), QUESTION, top_k=20).join(texts.select("doc_id", "text"), "doc_id")

    def shorter(_: pd.Series, text: pd.Series) -> pd.Series:
        return -text.str.len().astype("float64")

    return retrieval.rerank(QUESTION, hits, shorter).select("doc_id", "rerank_score", F.round("score", 9).alias("score"))


_VECTORS = "(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_NEAREST = f"""SELECT q.vec_id AS query_id, e.vec_id AS id, 1 - list_dot_product(q.v, e.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v))) AS distance FROM {_VECTORS} q, {_VECTORS} e WHERE q.vec_id % 100 = 0"""
_RANKED = f"SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), id) AS INTEGER) AS rank FROM ({_NEAREST})"


def _nearest(spark: SparkSession, folder: str, k: int) -> DataFrame:
    """The stated query set, vectors whose id is divisible by 100, against all vectors."""
    vectors = table(spark, folder, "embeddings")
    return retrieval.nearest_all(vectors, vectors.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), k)


@add("knn_cosine", f"SELECT query_id, id, round(distance, 6) + CAST(0 AS DOUBLE) AS distance, rank FROM ({_RANKED}) WHERE rank <= 10")
def knn_cosine(spark: SparkSession, folder: str) -> DataFrame:
    return _nearest(spark, folder, 10).select("query_id", "id", (F.round("distance", 6) + F.lit(0.0)).alias("distance"), "rank")  # no -0.0


@add("child_to_parent", f"WITH p AS (SELECT query_id, id // 5 AS parent_id, min(rank) AS r FROM ({_RANKED}) WHERE rank <= 30 AND id % 7 <> 0 GROUP BY 1, 2) SELECT query_id, parent_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY r, parent_id) AS INTEGER) AS rank FROM p")
def child_to_parent(spark: SparkSession, folder: str) -> DataFrame:
    """Five vectors make a parent; those divisible by 7 have lost theirs."""
    owners = table(spark, folder, "embeddings").where(F.col("vec_id") % 7 != 0).select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 5).alias("parent_id"))
    return retrieval.parents(_nearest(spark, folder, 30), owners)


_ASKED = f"""SELECT e.vec_id AS id, e.vec_id // 5 AS parent_id, round(1 - list_dot_product(q.v, e.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v))), 9) AS distance FROM {_VECTORS} e, (SELECT v FROM {_VECTORS} ORDER BY vec_id LIMIT 1) q"""


def _dense(spark: SparkSession, folder: str, exhaustive: bool) -> DataFrame:
    """The parents nearest to the first vector; five vectors make a parent."""
    vectors = table(spark, folder, "embeddings")
    first = vectors.orderBy("vec_id").select("embedding").first()
    children = vectors.select(F.col("vec_id").alias("child_id"), F.floor(F.col("vec_id") / 5).alias("parent_id"), F.col("embedding").alias("vector"))
    return retrieval.dense_ranks(children, list(first["embedding"]) if first else [], exhaustive=exhaustive).select(F.col("doc_id"), "channel", "rank")


@add("dense_rank", f"SELECT parent_id AS doc_id, 'semantic' AS channel, CAST(row_number() OVER (ORDER BY min(place), parent_id) AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (ORDER BY distance, id) AS place FROM ({_ASKED})) WHERE place <= 30 GROUP BY parent_id")
def dense_rank(spark: SparkSession, folder: str) -> DataFrame:
    return _dense(spark, folder, False)


@add("exhaustive_rank", f"SELECT * FROM (SELECT parent_id AS doc_id, 'semantic' AS channel, CAST(row_number() OVER (ORDER BY min(distance), parent_id) AS INTEGER) AS rank FROM ({_ASKED}) GROUP BY parent_id) WHERE rank <= 30")
def exhaustive_rank(spark: SparkSession, folder: str) -> DataFrame:
    return _dense(spark, folder, True)


@add("cosine_pairs", f"SELECT a.vec_id, round(1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS distance FROM {_VECTORS} a JOIN {_VECTORS} b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    following = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(following, "vec_id").select("vec_id", F.round(cosine_distance(F.col("embedding"), F.col("other")), 6).alias("distance"))


_TERMS = "订阅 提醒 订阅 budget 预算"


def _grep() -> str:
    terms = ["订阅", "提醒", "budget"]
    return "SELECT * FROM (SELECT doc_id, " + " + ".join(f"CAST(coalesce(contains(text, '{t}'), FALSE) AS INTEGER)" for t in terms) + " AS hits FROM documents) WHERE hits > 0"


@add("grep_baseline", _grep())
def grep_baseline(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.grep(table(spark, folder, "documents"), QUESTION)


@add("cache_misses", "WITH h AS (SELECT DISTINCT sha1(text) AS hash FROM documents WHERE text IS NOT NULL), s AS (SELECT DISTINCT sha1(text) AS hash FROM documents WHERE doc_kind = 'note' AND text IS NOT NULL) SELECT h.hash, s.hash IS NOT NULL AS cached FROM h LEFT JOIN s ON s.hash = h.hash")
def cache_misses(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").where(F.col("text").isNotNull()).withColumn("hash", F.sha1("text"))
    hits, misses = retrieval.cached(d.select("hash").distinct(), d.where(F.col("doc_kind") == "note").select("hash").distinct())
    return hits.select("hash", F.lit(True).alias("cached")).unionByName(misses.select("hash", F.lit(False).alias("cached")))


@add("text_hashes", "SELECT doc_id, sha1(text) AS sha1, sha256(concat_ws('|', doc_id, lang, n_chars)) AS sha256 FROM documents")
def text_hashes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.sha1("text").alias("sha1"), F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "lang", F.col("n_chars").cast("string")), 256).alias("sha256"))


def _part(at: int) -> str:
    return f"sum(CAST(CAST('0x' || substr(sha256(concat_ws('|', doc_id, coalesce(text, chr(1)))), {at}, 15) AS BIGINT) AS DECIMAL(38,0)))"


@add("corpus_fingerprint", f"SELECT count(*) AS docs, {_part(1)} AS high, {_part(16)} AS low FROM documents")
def corpus_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.fingerprints(table(spark, folder, "documents"), ["text"])


@add("chunk_markdown")
def chunk_markdown(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.chunk_markdown(table(spark, folder, "documents").select("source", "text"))


@add("split_long", None)
def split_long(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.split_long(table(spark, folder, "documents"))


@add("children_split", "SELECT doc_id FROM documents WHERE trim(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(32) || chr(133) || chr(160) || chr(12288) || chr(8232) || chr(8233)) <> ''")
def children_split(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that have children."""
    return chunks.split_children(table(spark, folder, "documents")).select("doc_id").distinct()


@add("children_rows")
def children_rows(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.split_children(table(spark, folder, "documents"))


# White space as Unicode has it, for either engine.
_SPACE = "[\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def _rejoined(pieces: DataFrame, number: str, most: int) -> DataFrame:
    """Of each document the letters of its pieces in order, how long the longest is, and whether numbers run from 0."""
    bare = F.regexp_replace("text", _SPACE, "")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(number, bare.alias("t")))), lambda x: x["t"]), "")  # bounded by a text's length
    return pieces.groupBy("doc_id").agg(F.md5(joined).alias("letters"), (F.max(F.char_length("text")) <= most).alias("fits"), (F.min(number) == 0).alias("whole"))


@add("children_joined", f"SELECT doc_id, md5(regexp_replace(text, '{_SPACE}', '', 'g')) AS letters, TRUE AS fits, TRUE AS whole FROM documents WHERE regexp_replace(text, '{_SPACE}', '', 'g') <> ''")
def children_joined(spark: SparkSession, folder: str) -> DataFrame:
    return _rejoined(chunks.split_children(table(spark, folder, "documents")), "child_no", chunks.CHILD)


@add("long_joined", f"SELECT doc_id, md5(regexp_replace(text, '{_SPACE}', '', 'g')) AS letters, TRUE AS fits, TRUE AS whole FROM documents WHERE text IS NOT NULL")
def long_joined(spark: SparkSession, folder: str) -> DataFrame:
    return _rejoined(chunks.split_long(table(spark, folder, "documents")), "part_no", chunks.MOST)


@add("merge_native_ocr", "SELECT part_id, text || chr(10) || 'seen once' AS merged FROM document_parts")
def merge_native_ocr(spark: SparkSession, folder: str) -> DataFrame:
    """Recognized lines that the native text holds already, and one that it doesn't."""
    parts = table(spark, folder, "document_parts").withColumn("seen", F.concat(F.col("text"), F.lit("\nseen once")))
    return parts.select("part_id", chunks.merged_text("text", "seen").alias("merged"))
