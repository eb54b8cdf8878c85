"""Packing of documents into containers of a fixed number of tokens.

The sum-of-squares rule: N(h) counts the open containers filled to level h; an
item of size s goes to the level h (0: a new container) that makes the sum of
N(h)^2 least afterwards.  N is a level array of the capacity's length, so each
item costs one vector operation, and the open containers of a level are a stack.

Items are dealt to buckets by a hash of their key, each packed on its own in key
order by a streaming pass; a bucket wastes at most its last open containers, and
the number of buckets follows the number of items, so waste does not grow.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .encode import DEFAULT_VOCABULARY, count_tokens

CAPACITY = 2048
#: Items of a bucket on average: enough that a bucket's last open containers are under 1 % of all.
ITEMS_PER_BUCKET = 20_000


class SumOfSquares:
    """The online packer of one bucket."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.made = capacity, 0
        self.level = np.zeros(capacity + 1, np.int64)  # level[capacity] stays 0: full containers are closed
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, size: int) -> tuple[int, int]:
        """(container, fill before) for an item of 1 to capacity tokens; ties go to the fullest level."""
        room = self.capacity - size
        cost = 2 * (self.level[size:] - self.level[: room + 1]) + 2
        cost[1:][self.level[1 : room + 1] == 0] = np.iinfo(np.int64).max  # no such container
        cost[0] -= 1  # a new one leaves no level
        cost[room] -= 1  # a full one enters no level
        at = room - int(cost[::-1].argmin())
        if at:
            box = self.open[at].pop()
            self.level[at] -= 1
        else:
            box = self.whole()
        if at + size < self.capacity:
            self.open[at + size].append(box)
            self.level[at + size] += 1
        return box, at

    def whole(self) -> int:
        """A new container."""
        self.made += 1
        return self.made - 1


def buckets_for(items: int) -> int:
    return max(1, math.ceil(items / ITEMS_PER_BUCKET))


def pack(items: DataFrame, key: str, size: str, buckets: int, capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, container, at, first, n_tokens): where each piece of each item lies.

    ``at`` is the piece's place in the container, ``first`` its first token in
    the item.  Only an item above the capacity is cut: into full pieces that
    each fill a container, and a rest that is packed like any item.  Items of
    null or no size are left out; a null key is a key like others; repeated
    rows are items of their own.  Container numbers are unique over all buckets.
    """
    sized = items.select(F.col(key), F.col(size).cast("long").alias("n_tokens")).where(F.col("n_tokens") > 0)
    dealt = sized.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("long"))
    ordered = dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket", key, "n_tokens")
    kind = items.schema[key].dataType
    schema = T.StructType(
        [T.StructField(key, kind), *(T.StructField(c, T.LongType()) for c in ("piece", "container", "at", "first", "n_tokens"))]
    )

    def run(batches):
        bucket, packer = None, None
        for batch in batches:
            rows, out = [], [[] for _ in range(5)]
            for i, (n, b) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                if b != bucket:
                    bucket, packer = b, SumOfSquares(capacity)
                base = b << 32
                full, rest = divmod(n, capacity)
                placed = [(p, base + packer.whole(), 0, p * capacity, capacity) for p in range(full)]
                if rest:
                    box, at = packer.place(rest)
                    placed.append((full, base + box, at, full * capacity, rest))
                rows.extend([i] * len(placed))
                for column, values in zip(out, zip(*placed)):
                    column.extend(values)
            keys = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, pa.int64()) for c in out)], names=schema.names)

    return ordered.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, key: str, text: str, capacity: int = CAPACITY, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Containers for the non-empty texts, measured in tokens of the vocabulary.

    The number of buckets follows the number of rows, which a Parquet table
    has in its footers, so nothing is encoded twice to count it.
    """
    sizes = count_tokens(docs.where(F.col(text) != ""), key, text, vocabulary)
    return pack(sizes, key, "n_tokens", buckets_for(docs.count()), capacity)
