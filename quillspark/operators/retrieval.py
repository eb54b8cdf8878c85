"""Lexical and vector retrieval: inverted index, BM25, nearest neighbours, rank fusion, reranking.

An index is tables laid out by field and token: postings (with the length of
their document, so that a score needs nothing else) and terms (with the number
of documents).  A query reads the row groups of its tokens only.  A stored index
is known by the files it was built from, so texts are read when they changed.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..functions.text import tokens
from ..session import written
from ..storage import fingerprint_of, read_mark, write_mark
from .chunks import split_children

# Parameters of BM25 and of rank fusion, and how many results each stage keeps.
K1, B = 1.5, 0.75
FUSION, PER_CHANNEL, TOP, POOL = 60, 30, 4, 20


@dataclass
class TextIndex:
    """Postings (field, token, doc_id, tf, length), terms (field, token, df), totals (field, docs, average)."""

    postings: DataFrame
    terms: DataFrame
    totals: DataFrame

    def save(self, folder: str, fingerprint: str) -> None:
        """Write the tables into a folder of their own, then the mark that makes them current.

        Postings are dealt by ranges of token and document: a token that a third
        of all texts have is spread over as many tasks and files as it needs.
        """
        name = uuid.uuid4().hex
        self.postings.repartitionByRange("field", "token", "doc_id").sortWithinPartitions("field", "token", "doc_id").write.parquet(f"{folder}/{name}/postings")
        stored = self.totals.sparkSession.read.parquet(f"{folder}/{name}/postings")
        terms = stored.groupBy("field", "token").agg(F.count("*").alias("df"))
        terms.repartitionByRange("field", "token").sortWithinPartitions("field", "token").write.parquet(f"{folder}/{name}/terms")
        self.totals.write.parquet(f"{folder}/{name}/totals")
        write_mark(self.totals.sparkSession, f"{folder}/mark", f"{name} {fingerprint}")


def build_index(docs: DataFrame, fields: dict[str, str]) -> TextIndex:
    """Index the columns of ``fields`` (field name to column) of a table with ``doc_id``."""
    named = F.explode(F.array(*(F.struct(F.lit(name).alias("field"), tokens(F.col(column)).alias("tokens")) for name, column in fields.items())))
    # Texts are read into tokens once; everything else is counted from those.
    split = written(docs.select("doc_id", named.alias("f")).select("doc_id", "f.field", "f.tokens", F.size("f.tokens").alias("length")))
    one = split.select("field", "doc_id", "length", F.explode("tokens").alias("token"))
    postings = one.groupBy("field", "token", "doc_id").agg(F.count("*").alias("tf"), F.first("length").alias("length"))
    terms = postings.groupBy("field", "token").agg(F.count("*").alias("df"))
    totals = split.groupBy("field").agg(F.count("*").alias("docs"), F.avg("length").alias("average"))
    return TextIndex(postings, terms, totals)


def load_index(spark: SparkSession, folder: str) -> tuple[TextIndex, str] | None:
    """The stored index and its fingerprint; None where none was ever stored. A damaged one is an error."""
    mark = read_mark(spark, f"{folder}/mark")
    if mark is None:
        return None
    name, fingerprint = mark.split(" ", 1)
    return TextIndex(*(spark.read.parquet(f"{folder}/{name}/{table}") for table in ("postings", "terms", "totals"))), fingerprint


def load_or_build(docs: DataFrame, fields: dict[str, str], folder: str) -> TextIndex:
    """The stored index where it was built from the same texts, else a new one, stored.

    Texts are the same if their files are (path, length and time); where they
    aren't read from files, if their hashes are.
    """
    if not fields:
        raise QueryError("an index needs a field")
    spark = docs.sparkSession
    current = fingerprint_of(docs, repr(sorted(fields.items())), str(docs.dtypes)) or fingerprint(docs, fields)
    stored = load_index(spark, folder)
    if stored and stored[1] == current:
        return stored[0]
    build_index(docs, fields).save(folder, current)
    return load_index(spark, folder)[0]


def fingerprints(docs: DataFrame, columns: list[str]) -> DataFrame:
    """One row (docs, high, low): the number of texts and two sums over their hashes, whatever their order."""
    row = F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), *(F.coalesce(F.col(c), F.lit("\x01")) for c in columns)), 256)
    part = lambda i: F.sum(F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)"))
    return docs.agg(F.count("*").alias("docs"), part(0).alias("high"), part(1).alias("low"))


def fingerprint(docs: DataFrame, fields: dict[str, str]) -> str:
    return "-".join([*map(str, fingerprints(docs, list(fields.values())).first()), *fields])


def query_tokens(spark: SparkSession, query: str) -> list[str]:
    """The distinct tokens of a query; with stop words where nothing else is left."""
    row = spark.range(1).select(F.array_distinct(tokens(F.lit(query))).alias("kept"), F.array_distinct(tokens(F.lit(query), False)).alias("all")).first()
    return list(row["kept"] or row["all"])


def bm25(index: TextIndex, field: str, query: str) -> DataFrame:
    """(doc_id, score) of the documents with a token of the query: one scan of their postings and one aggregation."""
    spark = index.postings.sparkSession
    totals = index.totals.where(F.col("field") == field).first()
    wanted = query_tokens(spark, query)
    here = lambda rows: rows.where((F.col("field") == field) & F.col("token").isin(wanted))
    frequent = {r["token"]: r["df"] for r in here(index.terms).collect()} if totals and totals["average"] and wanted else {}  # a row for each token of the query
    if not frequent:
        return index.postings.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    weight = F.lit(0.0)
    for token, df in sorted(frequent.items()):
        weight = F.when(F.col("token") == token, F.lit(math.log(1 + (totals["docs"] - df + 0.5) / (df + 0.5)))).otherwise(weight)
    norm = 1 - B + B * F.col("length") / F.lit(totals["average"])
    part = weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * norm)
    return here(index.postings).groupBy("doc_id").agg(F.sum(part).alias("score"))


def ranked(scored: DataFrame, channel: str, per_channel: int = PER_CHANNEL) -> DataFrame:
    """(doc_id, channel, rank) of the best; ties by doc_id."""
    best = scored.withColumn("__score", F.round("score", 9)).orderBy(F.desc("__score"), "doc_id").limit(per_channel)
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("__score"), "doc_id")  # over per_channel rows
    return best.select("doc_id", F.lit(channel).alias("channel"), F.row_number().over(order).alias("rank"))


def fuse(channels: list[DataFrame], top_k: int | None = None) -> DataFrame:
    """(doc_id, score, channels): the sum of 1 / (60 + rank) over channels; ties by more channels, then doc_id."""
    together = channels[0]
    for more in channels[1:]:
        together = together.unionByName(more)
    fused = together.groupBy("doc_id").agg(F.sum(1 / (F.lit(FUSION) + F.col("rank"))).alias("score"), F.array_sort(F.collect_set("channel")).alias("channels"))
    ordered = fused.orderBy(F.desc(F.round("score", 12)), F.desc(F.size("channels")), "doc_id")
    return ordered.limit(top_k) if top_k else ordered


def search(index: TextIndex, query: str, top_k: int = TOP, per_channel: int = PER_CHANNEL, semantic: DataFrame | None = None) -> DataFrame:
    """Fused title and body ranks, and the semantic one (doc_id, channel, rank) where given; no rows for a blank query."""
    channels = [ranked(bm25(index, field, query), field, per_channel) for field in ("title", "body")]
    if semantic is not None:
        channels.append(semantic)
    return fuse(channels, top_k) if query.strip() else fuse(channels).limit(0)


#: Query vectors that go to the tasks with a function, and that a task holds at once; rows that a task holds at once.
MOST_QUERIES, MOST_ROWS = 4096, 50_000


def best_rows(names: np.ndarray, rows: np.ndarray, ids: np.ndarray, matrix: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest rows of each query, exact, ties by name."""
    scale = np.linalg.norm(rows, axis=1)[:, None] * np.linalg.norm(matrix, axis=1)[None, :]
    distance = np.where(scale > 0, 1 - rows @ matrix.T / np.where(scale > 0, scale, 1), 1.0)
    compared = np.round(distance, 9)
    reach = np.partition(compared, k - 1, axis=0)[k - 1] if len(names) > k else np.full(len(ids), np.inf)
    found = []
    for j in range(len(ids)):
        near = np.flatnonzero(compared[:, j] <= reach[j])  # k rows and their ties
        near = near[np.lexsort((names[near], compared[near, j]))[:k]]
        found.append((np.full(len(near), ids[j]), names[near], distance[near, j]))
    parts = [np.concatenate(x) for x in zip(*found)]
    return pd.DataFrame(dict(zip(("query_id", "id", "distance"), parts)))


def _top(kept: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.round("distance", 9), "id")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _as_matrix(vectors: pd.Series, width: int) -> np.ndarray:
    return np.array(vectors.tolist(), np.float64).reshape(len(vectors), width)


def nearest(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, id, distance, rank): the k nearest of each of a few queries by cosine distance, exact, ties by id.

    Every batch keeps its own k best of each query, so k rows a batch and query
    are shuffled. The queries are a parameter, at most MOST_QUERIES; a table of
    queries goes to ``nearest_all``.
    """
    return _top(_candidates(vectors, queries, k, key, vector), k)


def _candidates(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int | None, key: str, vector: str) -> DataFrame:
    """(query_id, id, distance): of every batch the k nearest of each query, or all."""
    if len(queries) > MOST_QUERIES:
        raise QueryError(f"at most {MOST_QUERIES} queries at once; give them as a table")
    ids = np.array([q for q, _ in queries], np.int64)
    matrix = np.array([v for _, v in queries], np.float64).reshape(len(queries), len(queries[0][1]) if queries else 0)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch) and len(ids):
                yield best_rows(batch[key].to_numpy(), _as_matrix(batch[vector], matrix.shape[1]), ids, matrix, k or len(batch))

    kind = dict(vectors.dtypes)[key]
    return vectors.where(F.col(vector).isNotNull()).select(key, vector).mapInPandas(best, f"query_id bigint, id {kind}, distance double")


def nearest_all(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, id, distance, rank): the k nearest of every row of a table of queries (query_id, vector), exact, ties by id.

    Rows and queries are dealt to a grid of blocks, of about MOST_ROWS rows and
    MOST_QUERIES queries; each cell is one task's matrix product, so no task and
    no driver holds all of either.
    """
    there = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("v"))
    asked = queries.where(F.col("vector").isNotNull()).select("query_id", F.col("vector").alias("v"))
    height, width = (max(1, -(-rows.count() // most)) for rows, most in ((there, MOST_ROWS), (asked, MOST_QUERIES)))
    block = lambda name, parts: F.pmod(F.xxhash64(name), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = there.withColumn("row", block("id", height)).withColumn("col", every(width))
    right = asked.withColumn("col", block("query_id", width)).withColumn("row", every(height))

    def cell(rows: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(some):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "id": pd.Series(dtype=rows["id"].dtype), "distance": pd.Series(dtype="float64")})
        wide = len(some["v"].iloc[0])
        return best_rows(rows["id"].to_numpy(), _as_matrix(rows["v"], wide), some["query_id"].to_numpy(), _as_matrix(some["v"], wide), k)

    kind = dict(vectors.dtypes)[key]
    kept = left.groupBy("row", "col").cogroup(right.groupBy("row", "col")).applyInPandas(cell, f"query_id {dict(asked.dtypes)['query_id']}, id {kind}, distance double")
    return _top(kept, k)


@dataclass
class VectorStore:
    """Vectors of one build in a folder, with the stamp of what they were made from; a store never mixes two builds."""

    spark: SparkSession
    folder: str

    def _mark(self) -> list[str] | None:
        mark = read_mark(self.spark, f"{self.folder}/mark")
        return mark.split(" ", 1) if mark else None

    def stamp(self) -> str | None:
        mark = self._mark()
        return mark[1] if mark else None

    def reset(self, vectors: DataFrame, stamp: str) -> None:
        name = uuid.uuid4().hex
        vectors.write.parquet(f"{self.folder}/{name}")
        write_mark(self.spark, f"{self.folder}/mark", f"{name} {stamp}")

    def vectors(self) -> DataFrame:
        mark = self._mark()
        if mark is None:
            raise QueryError(f"there are no vectors in {self.folder}")
        return self.spark.read.parquet(f"{self.folder}/{mark[0]}")


Embedder = Callable[[list[str]], list[list[float]]]


def dense_children(chunks: DataFrame) -> DataFrame:
    """(child_id, parent_id, text): the children of chunks (doc_id, source, breadcrumb, text), named by their parent and place."""
    parent = F.sha1(F.concat_ws("\x1f", *(F.coalesce(c, F.lit("")) for c in ("source", "breadcrumb", "text"))))
    cut = split_children(chunks.where(F.col("text").isNotNull()).select("doc_id", "text"))
    return cut.join(chunks.select("doc_id", parent.alias("parent")), "doc_id").select(F.concat_ws("#", "parent", "child_no").alias("child_id"), F.col("doc_id").alias("parent_id"), "text")


def dense_index(chunks: DataFrame, embedder: Embedder, store: VectorStore, cache: DataFrame, model: str) -> DataFrame:
    """(child_id, parent_id, vector): the stored vectors if they were made from these chunks by this model, else new ones, stored.

    Children and parents are stored together, so that a reused store knows its parents too.
    """
    children = dense_children(chunks)
    stamp = fingerprint(children.select(F.col("child_id").alias("doc_id"), F.col("parent_id").cast("string").alias("text")), {model: "text"})
    if store.stamp() != stamp:
        vectors = embed(children, cache, embedder)
        store.reset(children.withColumn("hash", F.sha1("text")).join(vectors, "hash").select("child_id", "parent_id", "vector"), stamp)
    return store.vectors()


def dense_ranks(children: DataFrame, question: list[float], per_channel: int = PER_CHANNEL, exhaustive: bool = False) -> DataFrame:
    """(doc_id, channel, rank): parents by their nearest child.

    The nearest ``per_channel`` children are led to their parents, so several of
    one parent take each other's places; ``exhaustive`` compares every child and
    gives the nearest ``per_channel`` parents.
    """
    if exhaustive:
        distances = _candidates(children, [(0, question)], None, "child_id", "vector")
        best = distances.join(children.select(F.col("child_id").alias("id"), "parent_id"), "id").groupBy("parent_id").agg(F.min("distance").alias("distance"))
        return ranked(best.select(F.col("parent_id").alias("doc_id"), (-F.col("distance")).alias("score")), "semantic", per_channel)
    near = nearest(children, [(0, question)], per_channel, "child_id", "vector")
    found = parents(near, children.select(F.col("child_id").alias("id"), "parent_id"))
    return found.select(F.col("parent_id").alias("doc_id"), F.lit("semantic").alias("channel"), "rank")


def parents(children: DataFrame, owners: DataFrame) -> DataFrame:
    """(query_id, parent_id, rank): children's parents, each at its first place; children without parent go."""
    first = children.join(owners, "id").groupBy("query_id", "parent_id").agg(F.min("rank").alias("child_rank"))
    order = Window.partitionBy("query_id").orderBy("child_rank", "parent_id")
    return first.select("query_id", "parent_id", F.row_number().over(order).alias("rank"))


Scorer = Callable[[pd.Series, pd.Series], pd.Series]


def pooled(hits: DataFrame, pool: int = POOL) -> DataFrame:
    """The first hits, which a scorer sees together."""
    return hits.orderBy(F.desc("score"), F.desc(F.size("channels")), "doc_id").limit(pool).coalesce(1)


def by_score(scored: DataFrame) -> DataFrame:
    return scored.orderBy(F.desc_nulls_last("rerank_score"), F.desc("score"), F.desc(F.size("channels")), "doc_id")


def rerank(query: str, hits: DataFrame, score: Scorer, pool: int = POOL) -> DataFrame:
    """The first ``pool`` hits (doc_id, text, score, channels) reordered by a scorer of (query, text).

    A null score comes last; ties by fused score, more channels, doc_id. If the
    scorer fails, the order stays as it was, for all of the pool.
    """
    kept = pooled(hits, pool)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [f for f in frames if len(f)]
        if not held:
            return
        whole = pd.concat(held, ignore_index=True)
        try:
            scores = pd.Series(score(pd.Series([query] * len(whole)), whole["text"]), dtype="float64")
        except Exception:
            scores = pd.Series([None] * len(whole), dtype="float64")
        yield whole.assign(rerank_score=scores.to_numpy())

    scored = kept.mapInPandas(run, T.StructType([*kept.schema.fields, T.StructField("rerank_score", T.DoubleType())]))
    return by_score(scored.withColumn("rerank_score", F.nullif("rerank_score", F.lit(float("nan")))))


def rerank_cached(query: str, hits: DataFrame, score: Scorer, store: DataFrame, model: str, pool: int = POOL) -> tuple[DataFrame, DataFrame]:
    """(reordered hits, new scores (hash, score) to be stored): only texts that the store lacks for this model and query are scored."""
    keyed = pooled(hits, pool).withColumn("hash", F.sha1(F.concat_ws("\x1f", F.lit(model), F.lit(query), "text")))
    known, missing = cached(keyed, store.select("hash", F.col("score").alias("rerank_score")))
    fresh = rerank(query, missing, score, pool)
    return by_score(known.unionByName(fresh.select(*known.columns))), fresh.where(F.col("rerank_score").isNotNull()).select("hash", F.col("rerank_score").alias("score"))


def grep(docs: DataFrame, question: str, limit: int | None = None) -> DataFrame:
    """(doc_id, hits): how many of the question's tokens of two characters or more a text contains."""
    terms = [t for t in query_tokens(docs.sparkSession, question) if len(t) >= 2]
    hits = F.lit(0)
    for term in terms:
        hits += F.coalesce(F.contains("text", F.lit(term)).cast("int"), F.lit(0))
    found = docs.select("doc_id", hits.alias("hits")).where("hits > 0").orderBy(F.desc("hits"), "doc_id")
    return found.limit(limit) if limit else found


def cached(keys: DataFrame, store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of keys with a ``hash`` against a store by hash."""
    return keys.join(store, "hash", "inner"), keys.join(store, "hash", "left_anti")


def embed(texts: DataFrame, store: DataFrame, embedder: Embedder, batch: int = 10) -> DataFrame:
    """(hash, vector) of every text: stored ones as they are, the rest embedded in batches, once for equal texts."""
    hashed = texts.where(F.col("text").isNotNull()).select(F.sha1("text").alias("hash"), "text").dropDuplicates(["hash"])
    hits, misses = cached(hashed, store)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                yield pd.DataFrame({"hash": part["hash"], "vector": [list(map(float, v)) for v in embedder(part["text"].tolist())]})

    return hits.select("hash", "vector").unionByName(misses.mapInPandas(run, "hash string, vector array<double>"))
