"""Long exact spans shared between records.

Rabin-Karp hashes are taken of every window of ``GRAM`` code points of every
text, as differences of prefix sums in 64-bit arithmetic.  Of each run of hashes
that a span of the least length holds, the smallest is kept (winnowing), so two
texts with a common span always keep a common hash, and one hash in about forty
is counted in Spark instead of all.  Kept hashes that occur in one text only go.
The rest get the text around them, which decides exactly: two contexts of the
same hash share a span if what they have in common to the left and to the right
adds up to the least length.  The common parts are the intervals, merged to
maximal ones per text.

Exact copies of a text are one class from the start.  Equal contexts of a hash
are one row.  A hash with more than ``PAIRED`` different contexts is not paired:
all its windows of the least length are grouped by content instead, which is
exact too.  Pairs are made only where pairs are asked for; what a record shares,
its intervals and its group come from the groups alone.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, written
from .components import components

LEAST = 160
GRAM = 64
#: Contexts of one hash that are compared pair by pair; beyond it the windows are grouped.
PAIRED = 64
#: Code points handled at once in a worker.
CHUNK = 1 << 20

BASE = 0x9E3779B97F4A7C15
U = np.uint64


@lru_cache(maxsize=1)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    both = []
    for factor in (BASE, pow(BASE, -1, 1 << 64)):
        row = np.full(size, factor, U)
        row[0] = 1
        both.append(np.cumprod(row))
    return both[0], both[1]


def mixed(x: np.ndarray, factor: int) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(factor)
    return x ^ (x >> U(29))


def window_hashes(points: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of ``width`` code points."""
    size = 1 << max(CHUNK.bit_length(), int(len(points)).bit_length())
    up, down = powers(size)
    terms = mixed(points.astype(U) + U(1), 0xBF58476D1CE4E5B9) * up[: len(points)]
    total = np.concatenate([np.zeros(1, U), np.cumsum(terms)])
    return mixed((total[width:] - total[:-width]) * down[: len(points) - width + 1], 0xD6E8FEB86659FD93)


def sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """Minimum or maximum (``best``) of each run of ``width`` values, by prefixes and suffixes of blocks."""
    count = len(values) - width + 1
    blocks = -(-len(values) // width)
    edge = values.max() if best is np.minimum else values.min()
    rows = np.concatenate([values, np.full(blocks * width - len(values), edge, values.dtype)]).reshape(blocks, width)
    left = best.accumulate(rows, axis=1).ravel()
    right = best.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(right[:count], left[width - 1 : width - 1 + count])


def anchors(texts: list[str], least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position, hash) of the kept hashes of each text of at least ``least`` code points."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    joined = "".join(texts)
    if len(joined) < least:
        return none
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    hashes = window_hashes(points, gram)
    run = least - gram + 1
    smallest = sliding(hashes, run, np.minimum)
    # A run counts only if its span lies within one text.
    starts = np.arange(len(smallest))
    text_of = np.searchsorted(ends, starts, "right")
    smallest[starts + least > ends[text_of]] = 0
    reach = sliding(np.concatenate([np.zeros(run - 1, U), smallest, np.zeros(run - 1, U)]), run, np.maximum)
    kept = np.flatnonzero((hashes == reach) & (reach > 0))
    owner = np.searchsorted(ends, kept, "right")
    return owner, kept - (ends - sizes)[owner], hashes[kept].view(np.int64)


def anchor_rows(texts: DataFrame, least: int, gram: int) -> DataFrame:
    """(hash, doc, pos) of the kept windows; ``texts`` has (doc, text)."""
    schema = T.StructType([T.StructField("hash", T.LongType()), T.StructField("doc", T.LongType()), T.StructField("pos", T.IntegerType())])

    def run(batches):
        def rows(docs, some):
            owner, pos, found = anchors(some, least, gram)
            return pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.array(docs, np.int64)[owner]), pa.array(pos, pa.int32())], names=schema.names)

        for batch in batches:
            docs, some, size = [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if some and size + len(text) > CHUNK:
                    yield rows(docs, some)
                    docs, some, size = [], [], 0
                docs.append(doc)
                some.append(text)
                size += len(text)
            if some:
                yield rows(docs, some)

    return texts.mapInArrow(run, schema)


@F.pandas_udf(T.IntegerType())
def common_prefix(a: pd.Series, b: pd.Series) -> pd.Series:
    """Code points that two strings have in common at their start."""

    def one(x: str, y: str) -> int:
        if x.startswith(y) or y.startswith(x):
            return min(len(x), len(y))
        low, high = 0, min(len(x), len(y))
        while low < high:
            half = (low + high + 1) // 2
            if x[:half] == y[:half]:
                low = half
            else:
                high = half - 1
        return low

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="int32")


#: Hashes of two texts that may be met, so few are expected among 10^10 texts; beyond it something else is wrong.
COLLISIONS = 10_000


def text_classes(texts: DataFrame, text: str = "text"):
    """A long for each different text, as a column. Texts that agree in it but not in a second hash are told apart by a third."""
    first = F.xxhash64(text)
    met = texts.where(F.col(text).isNotNull()).select(first.alias("h"), F.unhex(F.md5(text)).alias("m")).groupBy("h").agg((F.min("m") != F.max("m")).alias("met")).where("met")
    found = [r["h"] for r in met.select("h").limit(COLLISIONS + 1).collect()]
    if len(found) > COLLISIONS:
        raise ValueError(f"more than {COLLISIONS} hashes stand for different texts")
    return F.when(first.isin(found), F.xxhash64(F.lit("third"), text, F.md5(text))).otherwise(first) if found else first


class SharedSpans:
    """The shared spans of a table: contexts of repeated windows and what they share.

    ``docs`` has ``key`` (long) and ``text``.  Rows with a null key or text have
    no spans.  Texts are compared as they are, by code point, whole.  A key with
    several rows counts as one record with all its texts.
    """

    def __init__(self, docs: DataFrame, key: str, text: str, least: int = LEAST, gram: int = GRAM) -> None:
        self.least, self.gram = least, gram
        self.around = least - gram
        named = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull())
        named = named.withColumn("doc", text_classes(named))
        #: (id, doc, n_chars) of every record; ``doc`` is the class of equal texts.
        self.every = named.select("id", F.when(F.col("text").isNotNull(), F.col("doc")).alias("doc"), F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"))
        #: (id, text, doc) of the records of the least length or more.
        self.long = named.where(F.char_length("text") >= least)
        self.members = self.long.select("id", "doc").distinct()
        rows = anchor_rows(self.long.select("doc", "text"), least, gram)
        # Copies of a text agree in doc, so a hash counts as repeated only in different texts.
        counted = rows.groupBy("hash").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
        repeated = counted.where(F.col("low") != F.col("high")).select("hash")
        places = rows.join(repeated, "hash", "left_semi").distinct()
        per_doc = places.groupBy("doc").agg(F.collect_list(F.struct("hash", "pos")).alias("places"))  # bounded by a text's length
        one = self.long.groupBy("doc").agg(F.min("id").alias("id"))
        wanted = per_doc.join(one, "doc").select("id", F.col("doc").alias("class"), "places")
        located = self.long.join(wanted, (self.long["id"] == wanted["id"]) & (self.long["doc"] == wanted["class"])).select("doc", "text", "places")

        def context(place):
            begin = F.greatest(place["pos"] - self.around, F.lit(0))
            return F.struct(
                place["hash"].alias("hash"),
                place["pos"].alias("pos"),
                F.reverse(F.substring("text", begin + 1, place["pos"] - begin)).alias("before"),
                F.substring("text", place["pos"] + 1, F.lit(self.gram + self.around)).alias("after"),
            )

        spread = located.select("doc", F.transform("places", context).alias("c")).select("doc", F.explode("c").alias("c")).select("doc", "c.*")
        #: (hash, pos, doc, context, before, after) of every repeated window, used several times;
        #: a row more for each row that repeats a record, which changes no result.
        self.contexts = written(spread.withColumn("context", F.struct(F.xxhash64("before", "after").alias("x"), F.xxhash64("after", "before").alias("y"))))
        self.kinds = self.contexts.groupBy("hash", "context").agg(
            F.first("before").alias("before"), F.first("after").alias("after"), F.min("doc").alias("low"), F.max("doc").alias("high")
        )
        numbers = self.kinds.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
        self.many = self.kinds.join(numbers, "hash")
        self.near = cut(self._near())

    def _near(self) -> DataFrame:
        """(hash, a, b, low_a, low_b, left, right): contexts that share a span, at most PAIRED for each, with how far it reaches on either side.

        Two contexts of one and the same text are no link: what a text repeats only within itself isn't shared.
        A context of several texts is linked with itself.
        """
        full = F.char_length("before") + F.char_length("after")
        own = self.kinds.where((F.col("low") != F.col("high")) & (full >= self.least)).select(
            "hash", F.col("context").alias("a"), F.col("context").alias("b"), F.col("low").alias("low_a"), F.col("low").alias("low_b"),
            F.char_length("before").alias("left"), F.char_length("after").alias("right"),
        )

        def side(rows, name):
            return rows.select("hash", F.col("context").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("before", "after", "low", "high")))

        several = F.least("a_low", "b_low") != F.greatest("a_high", "b_high")
        few = self.many.where(F.col("n") <= PAIRED)
        left, right = common_prefix("a_before", "b_before"), common_prefix("a_after", "b_after")
        paired = (
            side(few, "a").join(side(few, "b"), "hash").where("a < b").where(several)
            .select("hash", "a", "b", F.col("a_low").alias("low_a"), F.col("b_low").alias("low_b"), left.alias("left"), right.alias("right"))
            .where((F.col("right") >= self.gram) & (F.col("left") + F.col("right") >= self.least))
        )
        return own.unionByName(paired)

    def _pieces(self) -> DataFrame:
        """(hash, left, piece, context, low, high): the windows of the least length around the hashes with many contexts; equal ones are shared spans."""
        windows = self.many.where(F.col("n") > PAIRED).select("hash", "context", F.explode(F.sequence(F.lit(0), F.lit(self.around))).alias("left"), "before", "after", "low", "high")
        return windows.where((F.char_length("before") >= F.col("left")) & (F.char_length("after") >= self.least - F.col("left"))).select(
            "hash", "left", F.unhex(F.md5(F.concat(F.expr("substring(before, 1, left)"), F.lit("\x00"), F.expr(f"substring(after, 1, {self.least} - left)")))).alias("piece"), "context", "low", "high",
        )

    def class_pairs(self) -> DataFrame:
        """(low, high): different texts that share a span, by their class."""
        pieces = self._pieces()
        a, b = (pieces.select("hash", "left", "piece", *(F.col(c).alias(n) for c, n in (("context", name), ("low", f"{name}_low"), ("high", f"{name}_high")))) for name in "ab")
        several = F.least("a_low", "b_low") != F.greatest("a_high", "b_high")
        grouped = a.join(b, ["hash", "left", "piece"]).where("a < b").where(several).select("hash", "a", "b").distinct()
        both = self.near.select("hash", "a", "b").unionByName(grouped)
        place = self.contexts.select("hash", "context", "doc").distinct()
        first = both.join(place.withColumnsRenamed({"context": "a", "doc": "x"}), ["hash", "a"])
        second = first.join(place.withColumnsRenamed({"context": "b", "doc": "y"}), ["hash", "b"]).where(F.col("x") != F.col("y"))
        return second.select(F.least("x", "y").alias("low"), F.greatest("x", "y").alias("high")).distinct()

    def pairs(self) -> DataFrame:
        """(doc_a, doc_b), doc_a < doc_b: records whose texts share a span, copies included."""
        linked = (
            self.class_pairs()
            .join(self.members.withColumnsRenamed({"id": "x", "doc": "low"}), "low")
            .join(self.members.withColumnsRenamed({"id": "y", "doc": "high"}), "high")
            .select("x", "y")
        )
        copied = self.members.withColumnRenamed("id", "x").join(self.members.withColumnRenamed("id", "y"), "doc").select("x", "y")
        return (
            linked.unionByName(copied).where(F.col("x") != F.col("y"))
            .select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).distinct()
        )

    def _grouped(self) -> tuple[DataFrame, DataFrame]:
        """Of the contexts that share a span with another text: (hash, context, left, right), how far at most, and (a, b), texts that belong together.

        Every hash and every group of equal windows gives its contexts a row each, whatever their number.
        """
        ends = [("a", "low_a"), ("b", "low_b")]
        sides = [self.near.select("hash", F.col(c).alias("context"), F.col(low).alias("low"), "left", "right") for c, low in ends]
        pieces = self._pieces()
        common = pieces.groupBy("hash", "left", "piece").agg(F.min("low").alias("first"), F.max("high").alias("last")).where(F.col("first") != F.col("last"))
        held = pieces.join(common, ["hash", "left", "piece"]).select("hash", "context", "low", "first", "left", (F.lit(self.least) - F.col("left")).cast("int").alias("right"))
        every = sides[0].unionByName(sides[1]).unionByName(held.select("hash", "context", "low", "left", "right"))
        reach = every.groupBy("hash", "context", "low").agg(F.max("left").alias("left"), F.max("right").alias("right"))
        together = self.near.select(F.col("low_a").alias("a"), F.col("low_b").alias("b")).unionByName(held.select(F.col("low").alias("a"), F.col("first").alias("b")))
        return reach, together.where("a <> b").distinct()

    def _reached(self) -> tuple[DataFrame, DataFrame]:
        """(doc, begin, end, low) of every place that another text holds too, and which texts belong together."""
        reach, together = self._grouped()
        spans = self.contexts.join(reach, ["hash", "context"]).select("doc", (F.col("pos") - F.col("left")).alias("begin"), (F.col("pos") + F.col("right")).alias("end"), "low")
        return spans, together

    def _merged(self, spans: DataFrame) -> DataFrame:
        """(doc, begin, end): places that overlap or touch become one."""
        order = Window.partitionBy("doc").orderBy("begin", "end")  # bounded by a text's length
        before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
        fresh = (before.isNull() | (F.col("begin") > before)).cast("int")
        numbered = spans.select("doc", "begin", "end").distinct().withColumn("fresh", fresh).withColumn("no", F.sum("fresh").over(order))
        return numbered.groupBy("doc", "no").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("no")

    def _classes(self) -> DataFrame:
        return self.every.where(F.col("doc").isNotNull()).groupBy("doc").agg(F.min("id").alias("class_id"), (F.min("id") != F.max("id")).alias("copied"), F.max("n_chars").alias("n"))

    def intervals(self) -> DataFrame:
        """(doc_id, begin, end): the maximal intervals of each record that other records hold too, as places of code points from 0, ``end`` excluded.

        A record with a copy is one interval.  These are what a removal of repeated text takes out.
        """
        spans, _ = self._reached()
        copies = self._classes().where("copied").where(F.col("n") >= self.least).select("doc", F.lit(0).alias("begin"), F.col("n").cast("int").alias("end"))
        merged = self._merged(spans.select("doc", "begin", "end").unionByName(copies))
        return merged.join(self.members, "doc").select(F.col("id").alias("doc_id"), F.col("begin").cast("int").alias("begin"), F.col("end").cast("int").alias("end"))

    def shared(self) -> DataFrame:
        """(doc_id, class_id, n_chars, shared_chars, group_id): one row for each record and text.

        ``class_id`` is the smallest key with the same text (the own one for null),
        ``shared_chars`` the number of code points in spans that another record
        holds too, ``group_id`` the smallest key of the records that are linked,
        directly or over others, by spans they share.
        """
        spans, together = self._reached()
        spans = cut(spans)
        covered = self._merged(spans).groupBy("doc").agg(F.sum(F.col("end") - F.col("begin")).alias("covered"))
        edges = together.unionByName(spans.where("doc <> low").select(F.col("doc").alias("a"), F.col("low").alias("b")).distinct())
        groups = components(edges).withColumnsRenamed({"node": "doc"})
        per_class = self._classes().join(covered, "doc", "left").join(groups, "doc", "left").withColumn("root", F.coalesce("root", "doc"))
        least = per_class.groupBy("root").agg(F.min("class_id").alias("group_id"))
        copied = F.col("copied") & (F.col("n_chars") >= self.least)
        return self.every.distinct().join(per_class.join(least, "root"), "doc", "left").select(
            F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"), "n_chars",
            F.when(copied, F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0))).alias("shared_chars"), F.coalesce("group_id", "id").alias("group_id"),
        )
