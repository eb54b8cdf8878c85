"""Deduplicating new batches against all accepted history.

``LinkageStore`` keeps the history as a blocking-key table in the shared folder:
normalised records laid out by account and amount, on which all that is compared
must agree, in buckets of their hash.  A batch reads the buckets that its own
accounts and amounts fall into, passes their rows through a bit filter of fixed
size, and gives the few that stay finer keys:

* ``whole`` keys hold the full identifier,
* ``part`` keys an identifier with a few neighbouring characters masked, so that
  one with a wrong character, or two swapped ones, agrees in the key where these
  are masked; and the last characters, for identifiers that lost their beginning.
  Running numbers (T and a number) have none, they are never damaged,
* ``plain`` keys the day, for records without identifier,
* ``file`` keys the file, for batches whose content hash was seen before,
* ``block`` keys nothing more: one record of the block, in one block of EXAMPLES,
  as an example of two records that agree by chance.

Each key is one row for each content and day, so a key held by many records is
few rows.  Candidates are compared field by field (identifier, date, merchant,
way of writing the account, file), and the fields' weights are learned by
expectation maximisation from the counts of the agreement patterns.  A candidate
is a link if its total weight reaches the threshold and no rule forbids it; of
several that a record without identifier fits, the one of most weight is taken.
Links close to clusters by a union-find mapping of representatives; only
clusters that the batch touches are read and updated.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
import uuid
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_root, cut, written
from ..storage import fingerprint_of, read_mark, write_mark
from .components import components
from .names import read_name, sound, swap_distance

#: Days by which the date of a record may be written differently.
DAYS = 3
#: Last characters kept when an identifier loses its beginning: of 14 digits and of 12 hexadecimal digits.
TAILS = {"long": 7, "hex": 8}
#: Neighbouring characters masked at once in a part key; each mask overlaps the one before by a character, so that it holds every swap.
MASK = 5
#: Bits of the filter that history passes before anything is shuffled; its size does not depend on the data.
FILTER_BITS = 1 << 23
#: One block in so many gives examples of records that agree by chance, for the weights to be learned from.
EXAMPLES = 16
#: Folders that a store's tables are laid out in; fixed when a store is made.
BUCKETS = 32
# What stands for a missing identifier, and words before one.
PLACEHOLDERS = ["", "-", "--", "N/A", "NA", "NONE", "NULL", "?", "0"]
LABELS = r"^(REF|TXN|ID|NO|TRANSACTION)[\s:.#]+|^#|^0X"


def identifier_fields(rows: DataFrame, raw: str) -> DataFrame:
    """Rows with ``kind`` (``number``, ``long``, ``hex`` or ``other``) and ``value`` of an identifier; both null where there is none."""
    # Step by step, so that each expression is evaluated once.
    text = rows.withColumn("__text", F.upper(F.btrim(F.col(raw), F.lit(" \t\r\n　"))))
    bared = text.withColumn("__bare", F.regexp_replace(F.regexp_replace("__text", LABELS, ""), r"[^\p{L}\p{Nd}]", ""))
    bare = F.col("__bare")
    digits = F.when(bare.startswith("FT"), F.substring(bare, 3, 1_000_000)).otherwise(bare)
    # A tail of a long identifier is written with its mark between three digits and four.
    tail = F.col("__text").rlike(r"^\d{3}[^\p{L}\p{Nd}]\d{4}$")
    kind = (
        F.when(F.col("__text").isNull() | F.col("__text").isin(PLACEHOLDERS) | (bare == ""), None)
        .when(bare.rlike(r"^FT\d+$|^\d{14}$"), "long")
        .when(tail, "long")
        .when(bare.rlike(r"^T\d+$|^\d{1,7}$"), "number")
        .when(bare.rlike(r"^(?:[0-9A-F]{8}|[0-9A-F]{12})$"), "hex")
        .otherwise("other")
    )
    kinds = bared.withColumn("kind", kind)
    value = F.when(F.col("kind") == "long", digits).when(F.col("kind") == "number", F.regexp_replace(bare, "^T?0*", "")).when(F.col("kind").isNotNull(), bare)
    return kinds.withColumn("value", value).drop("__text", "__bare")


def date_value(rows: DataFrame, name: str) -> Column:
    """The day of a column of dates, or of texts in one of the accepted forms."""
    if dict(rows.dtypes)[name] == "date":
        return F.col(name)
    text = F.btrim(F.col(name).cast("string"), F.lit(" \t\r\n　"))
    # The shape chooses the form, since a form that doesn't fit is found out by an exception.
    made = F.lit(None).cast("date")
    for shape, form in ((r"^\d+/\d+/\d{3,}$", "M/d/y"), (r"^\d{3,}/\d+/\d+$", "y/M/d"), (r"^\d+-\d+-\d+$", "y-M-d")):
        made = F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(form)).cast("date")).otherwise(made)
    return made


def amount_cents(rows: DataFrame, name: str) -> Column:
    """The cents of a column of decimals, or of texts."""
    if dict(rows.dtypes)[name].startswith("decimal"):
        return (F.col(name).cast("decimal(20,2)") * 100).cast("long")
    text = F.regexp_replace(F.btrim(F.col(name).cast("string"), F.lit(" \t\r\n　")), r"^\+|,", "")
    return (text.try_cast("decimal(20,2)") * 100).cast("long")


def normalised(rows: DataFrame) -> DataFrame:
    """The RECORD fields of records in either table's form.

    Records whose account has no digits, or whose amount or date can't be read,
    are left out: they agree with no other record.
    """
    account = F.regexp_replace("account", r"\P{Nd}", "")
    day = F.datediff(date_value(rows, "date"), F.lit("1970-01-01").cast("date"))
    named = rows.select(
        F.col("id").cast("long").alias("id"), account.alias("account"), amount_cents(rows, "amount").alias("cents"), day.alias("day"), "txn_id",
        F.coalesce("merchant", F.lit("")).alias("merchant"), F.hash(F.regexp_replace(F.lower(F.btrim("account")), r"\p{Nd}+", "9")).alias("style"), F.col("batch_id").cast("string").alias("batch"),
    )
    readable = named.where(F.col("id").isNotNull() & (F.col("account") != "") & F.col("cents").isNotNull() & F.col("day").isNotNull())
    return identifier_fields(readable, "txn_id").select(*COLUMNS)


RECORD = "id long, account string, cents long, day int, kind string, value string, merchant string, style int, batch string"
COLUMNS = [f.split()[0] for f in RECORD.split(", ")]
FIELDS = ["account", "cents", "day", "kind", "value", "merchant", "style", "file", "resent"]
BLOCK = ["account", "cents"]
#: Changes whenever records would be normalised otherwise, so that no store made before is used.
FORMAT = "2"
MAPPING = "node long, root long, named boolean, generation int"


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*BLOCK), F.lit(buckets)).cast("int")


def masks(length: int) -> list[tuple[int, int]]:
    """(begin, end) of the masks of an identifier: every two neighbours are in one of them."""
    return [(at, min(at + MASK, length)) for at in range(0, max(length - 1, 1), MASK - 1)]


#: Lengths of the identifiers that have part keys.
LENGTHS = (7, 8, 12, 14)


def slim(records: DataFrame) -> DataFrame:
    """What keys are made of: account, amount and merchant as hashes. A collision only adds a candidate; they are compared as they are later."""
    name = F.regexp_replace(F.lower("merchant"), r"[^\p{L}\p{Nd}]", "")
    return records.select("id", F.xxhash64(*BLOCK).alias("block"), "day", "kind", "value", F.xxhash64(name).alias("name"), F.when(F.col("value").isNull(), F.xxhash64("file")).alias("file"), "resent", "fresh")


def keys(records: DataFrame, probing: bool) -> DataFrame:
    """The finer keys of each record (``slim``, with what is known of its block): (key, table, content, id, day, reach).

    ``content`` is a hash of what a judge looks at, so that repeats of it need
    one row.  In the ``plain`` table every record is entered for those without
    identifier to find, and those without once more for all others to find.
    ``reach`` is the number of days by which a partner may be off.  What is
    known of the block (``blocks``) tells which tables can lead to anything in it.
    """
    named, nameless = F.col("value").isNotNull(), F.col("value").isNull()
    entry = lambda table, text, reach: F.struct(F.lit(table).alias("table"), text.alias("text"), F.lit(reach).alias("reach"))
    size = F.char_length("value")
    masked = F.lit(None)
    for length in LENGTHS:
        texts = [F.concat(F.lit(f"mask{begin}|"), F.substring("value", 1, begin), F.lit("*"), F.expr(f"substring(value, {end + 1})")) for begin, end in masks(length)]
        masked = F.when(size == length, F.array(*(entry("part", t, DAYS) for t in texts))).otherwise(masked)
    least = F.when(F.col("kind") == "long", TAILS["long"]).otherwise(TAILS["hex"])
    tail = F.when(F.col("kind") == "long", F.expr(f"right(value, {TAILS['long']})")).otherwise(F.expr(f"right(value, {TAILS['hex']})"))
    # A whole identifier looks for tails, a tail for whole ones.
    own, sought = F.when(size > least, "whole|").otherwise("tail|"), F.when(size > least, "tail|").otherwise("whole|")
    damageable = F.col("kind").isin(*TAILS)
    parts = F.when(F.col("varied") & damageable & masked.isNotNull(), F.concat(masked, F.array(entry("part", F.concat(sought if probing else own, tail), DAYS))))
    none = F.array().cast("array<struct<table:string,text:string,reach:int>>")
    whole = F.when(named, F.array(entry("whole", F.concat_ws("|", "kind", "value"), DAYS)))
    plain = {who: F.array(entry("plain", F.lit(who), 0)) for who in ("any", "none")}
    dated = F.when(nameless, plain["any"]).otherwise(plain["none"]) if probing else F.when(nameless, F.concat(*plain.values())).otherwise(plain["any"])
    # Lines with an identifier are led to their file's first copy by that.
    shared = F.col("file").isNotNull() & F.col("resent") if probing else F.col("file").isNotNull()
    file = F.when(shared, F.array(entry("file", F.col("file").cast("string"), 0)))
    block = F.when(F.pmod("block", F.lit(EXAMPLES)) == 0, F.array(entry("block", F.lit(""), 0)))
    rows = records.withColumn("k", F.explode(F.concat(*(F.coalesce(x, none) for x in (whole, parts, file, F.when(F.col("some_nameless"), dated), block)))))
    content = F.when(F.col("k.table").isin("whole", "block"), F.lit(0)).when(F.col("k.table") == "part", F.xxhash64("kind", "value")).otherwise(F.col("name"))
    return rows.select(F.xxhash64("k.table", "block", "k.text").alias("key"), F.col("k.table").alias("table"), content.alias("content"), "id", "day", F.col("k.reach").alias("reach"))


def blocks(records: DataFrame) -> DataFrame:
    """(block, varied, some_nameless) of the blocks with two records or more.

    ``varied`` says that there are different identifiers, ``some_nameless`` that some record has none.
    """
    known = F.when(F.col("value").isNotNull(), F.xxhash64("kind", "value"))
    counted = records.groupBy("block").agg(
        (F.min("id") != F.max("id")).alias("several"), F.coalesce(F.min(known) != F.max(known), F.lit(False)).alias("varied"), F.max(F.col("value").isNull()).alias("some_nameless"),
    )
    return counted.where("several").drop("several")


def index(records: DataFrame) -> DataFrame:
    """(key, day, first): the smallest record of each key, content and day; of a block any one record."""
    keyed = keys(records, probing=False)
    block = F.col("table") == "block"
    picked = F.when(block, F.xxhash64("id")).otherwise(F.col("id"))
    return keyed.groupBy("key", "content", F.when(block, F.lit(None)).otherwise(F.col("day")).alias("day")).agg(F.min_by("id", picked).alias("first")).drop("content")


@F.pandas_udf(T.StringType())
def id_level(kind_a: pd.Series, a: pd.Series, kind_b: pd.Series, b: pd.Series) -> pd.Series:
    """How two identifiers agree: same, tail, damaged, missing or other."""

    def one(ka, x, kb, y):
        if x is None or y is None or x != x or y != y:
            return "missing"
        if ka == kb and x == y:
            return "same"
        if ka != kb or ka not in TAILS:
            return "other"
        short, full = sorted((x, y), key=len)
        if len(short) == TAILS[ka] and len(full) > len(short):
            return "tail" if full.endswith(short) else "other"
        return "damaged" if len(x) == len(y) and swap_distance(x, y, 1) <= 1 else "other"

    return pd.Series([one(*row) for row in zip(kind_a, a, kind_b, b)])


def name_level(a: str, b: str) -> str:
    """How two merchants as written agree: same, similar or other."""
    x, y = letters(a), letters(b)
    if x == y:
        return "same"
    short, full = sorted((x, y), key=len)
    if len(short) >= 5 and full.startswith(short):
        return "similar"
    (line_a, words_a), (line_b, words_b) = read_name(core(a)), read_name(core(b))
    left, right = sound(sorted(words_a)), sound(sorted(words_b))
    if line_a and line_b and line_a != line_b and "person" not in (line_a, line_b):
        return "other"
    most = 2 if min(len(left), len(right)) >= 8 else 1
    if swap_distance(left, right, most) <= most:
        return "similar"
    shorter, longer = sorted((left, right), key=len)
    return "similar" if len(shorter) >= 5 and longer.startswith(shorter) else "other"


def letters(name: str) -> str:
    """The letters and digits of a name, without accents, case and processor words."""
    text = unicodedata.normalize("NFKD", name.casefold())
    text = "".join(c for c in text if not unicodedata.combining(c))
    text = re.sub(r"^(?:(?:purchase|pos|sq|tst|qr|pp)\b[\s*]*)+", "", text.strip())
    return re.sub(r"[\W_]|\bno\b", "", text)


def core(name: str) -> str:
    """A name without store numbers and what follows them."""
    text = re.sub(r"^(?:purchase)\s+", "", name.strip(), flags=re.I)
    return re.split(r"\s(?:#|no\.? ?\d|\d)", text.replace("*", " "), maxsplit=1, flags=re.I)[0]


@F.pandas_udf(T.StringType())
def merchant_level(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([name_level(x, y) for x, y in zip(a, b)])


PATTERN = ["id_level", "date_level", "merchant_level", "account_level", "file_level"]
#: What is taken for granted before any pair is seen, as numbers of pairs that are the same and of pairs that are not.
SAME = {
    "id_level": {"same": 30, "tail": 6, "damaged": 6, "missing": 7, "other": 1}, "date_level": {"same": 35, "near": 14, "far": 1}, "merchant_level": {"same": 35, "similar": 12, "other": 3},
    "account_level": {"same": 30, "written": 20}, "file_level": {"copied": 10, "apart": 40},
}
OTHER = {
    "id_level": {"same": 0.2, "tail": 0.3, "damaged": 1.5, "missing": 5, "other": 43}, "date_level": {"same": 4, "near": 6, "far": 40}, "merchant_level": {"same": 10, "similar": 5, "other": 35},
    "account_level": {"same": 30, "written": 20}, "file_level": {"copied": 0.5, "apart": 49.5},
}
#: Share of pairs that are the same, before any pair is seen.
PRIOR = 0.5


@dataclass(frozen=True)
class Weights:
    """log2(m/u) of each field's levels, and of the odds that a candidate is the same record at all."""

    levels: dict[str, dict[str, float]]
    odds: float

    def total(self) -> Column:
        score = F.lit(float(self.odds))
        for name in PATTERN:
            known = self.levels.get(name, {})
            part = F.lit(0.0)
            for level, weight in known.items():
                part = F.when(F.col(name) == level, F.lit(float(weight))).otherwise(part)
            score = score + part
        return score


def learn(counts: pd.DataFrame, rounds: int = 50) -> Weights:
    """The weights of the counted agreement patterns (columns PATTERN and n), by expectation maximisation.

    SAME and OTHER stand for a hundred pairs seen before, so that few patterns
    don't give wild weights and an empty table gives those of the hundred.
    """
    def tables(same, other):
        made = {}
        for name in PATTERN:
            m = {v: SAME[name][v] + same[counts[name] == v].sum() for v in SAME[name]}
            u = {v: OTHER[name][v] + other[counts[name] == v].sum() for v in OTHER[name]}
            made[name] = {v: math.log2((m[v] / sum(m.values())) / (u[v] / sum(u.values()))) for v in m}
        held = 50 * PRIOR * 2
        share = (held + same.sum()) / (100 + same.sum() + other.sum())
        return Weights(made, math.log2(share / (1 - share)))

    n = counts["n"].astype(float)
    weights = tables(n * 0, n * 0)
    for _ in range(rounds if len(counts) else 0):
        odds = sum((counts[name].map(weights.levels[name]) for name in PATTERN), start=n * 0) + weights.odds
        chance = 1 / (1 + 2.0 ** -odds.clip(-60, 60))
        weights = tables(n * chance, n * (1 - chance))
    return weights


def candidates(records: DataFrame) -> DataFrame:
    """(id, other, PATTERN, nameless, other_nameless): each new (``fresh``) record with the earlier ones that its keys lead to."""
    thin = slim(records)
    known = thin.join(blocks(thin), "block")
    asked = keys(known.where("fresh"), probing=True).select("key", "id", "day", "reach")
    near = F.col("i.day").isNull() | (F.abs(F.col("i.day") - F.col("p.day")) <= F.col("p.reach"))
    met = index(known).alias("i").join(asked.alias("p"), F.col("i.key") == F.col("p.key")).where((F.col("i.first") < F.col("p.id")) & near)
    pairs = met.select(F.col("p.id").alias("id"), F.col("i.first").alias("other")).distinct()
    side = lambda rows, key, name: rows.select(F.col("id").alias(key), F.struct(*FIELDS).alias(name))
    both = pairs.join(side(records, "other", "b"), "other").join(side(records.where("fresh"), "id", "a"), "id")
    both = both.where((F.col("a.account") == F.col("b.account")) & (F.col("a.cents") == F.col("b.cents")))
    a, b = F.col("a.value"), F.col("b.value")
    longer, shorter = F.greatest(F.char_length(a), F.char_length(b)), F.least(F.char_length(a), F.char_length(b))
    tail = F.when(F.col("a.kind") == "long", TAILS["long"]).otherwise(TAILS["hex"])
    by_id = (
        F.when(a.isNull() | b.isNull(), "missing").when((F.col("a.kind") == F.col("b.kind")) & (a == b), "same")
        .when((F.col("a.kind") != F.col("b.kind")) | ~F.col("a.kind").isin(*TAILS), "other")
        .when((shorter == tail) & (longer > shorter), F.when(a.endswith(b) | b.endswith(a), "tail").otherwise("other"))
        .when(longer != shorter, "other")
    )
    plain = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{Nd}]", "")
    by_name = F.when(plain("a.merchant") == plain("b.merchant"), "same")
    gap = F.abs(F.col("a.day") - F.col("b.day"))
    judged = both.select(
        "id", "other", by_id.alias("id_level"), by_name.alias("merchant_level"),
        F.when(gap == 0, "same").when(gap <= DAYS, "near").otherwise("far").alias("date_level"),
        F.when(F.col("a.style") == F.col("b.style"), "same").otherwise("written").alias("account_level"),
        F.when(F.col("a.resent") & (F.col("a.file") == F.col("b.file")), "copied").otherwise("apart").alias("file_level"),
        a.isNull().alias("nameless"), b.isNull().alias("other_nameless"),
        F.when(by_id.isNull() | by_name.isNull(), F.struct("a.kind", F.col("a.value").alias("x"), F.col("b.value").alias("y"), F.col("a.merchant").alias("m"), F.col("b.merchant").alias("n"))).alias("open"),
    )
    # Only the pairs that plain comparisons leave open go through Python.
    judged = written(judged)
    kept = ["id", "other", *PATTERN, "nameless", "other_nameless"]
    asked = judged.where(F.col("open").isNotNull()).withColumns(
        {
            "id_level": F.coalesce("id_level", id_level("open.kind", "open.x", "open.kind", "open.y")),
            "merchant_level": F.coalesce("merchant_level", merchant_level("open.m", "open.n")),
        }
    )
    return judged.where(F.col("open").isNull()).select(*kept).unionByName(cut(asked.select(*kept)))


def forbidden() -> Column:
    """What no weight may overrule: other identifiers are other transactions, a far date is another one, and without an identifier date and merchant must agree."""
    agree = (F.col("date_level") == "same") & (F.col("merchant_level") != "other")
    return (F.col("id_level") == "other") | (F.col("date_level") == "far") | ((F.col("id_level") == "missing") & ~agree)


#: Total weight, in bits, from which a candidate is a link: more likely the same record than not.
THRESHOLD = 0.0


@dataclass
class Linked:
    """What a batch adds: its repeats, the representatives that changed, its records and what was learned."""

    repeats: DataFrame
    representatives: DataFrame
    records: DataFrame
    weights: Weights


class LinkageStore:
    """Accepted history in a folder that all executors share, as tables by blocking key.

    ``records`` holds the normalised records and ``representatives`` the
    union-find mapping (node, root), both in folders by bucket.  A mark names the
    folders that count, so a build or batch that was broken off leaves nothing
    behind.  There is one writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        mark = read_mark(spark, f"{self.folder}/mark")
        self.state = json.loads(mark) if mark else None

    @classmethod
    def of(cls, history: DataFrame, folder: str, buckets: int = BUCKETS) -> LinkageStore:
        """The store in a folder; made from ``history`` where there is none yet. History is read only then."""
        store = cls(history.sparkSession, folder)
        if store.state is None:
            store.state = {"buckets": buckets, "records": [], "mapping": [], "weights": None}
            store._add("records", normalised(history))
            store._save()
        return store

    def _save(self) -> None:
        write_mark(self.spark, f"{self.folder}/mark", json.dumps(self.state))

    def _add(self, table: str, rows: DataFrame) -> None:
        """Write rows by bucket. Large buckets are split over tasks by size, small ones put together, both at run time."""
        name = f"{table}-{uuid.uuid4().hex}"
        laid = rows.withColumn("bucket", bucket_of(self.state["buckets"])).hint("rebalance", "bucket")
        laid.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.folder}/{name}")
        self.state[table].append(name)

    def _read(self, table: str, schema: str, buckets: list[int]) -> DataFrame:
        rows = self.spark.createDataFrame([], schema + ", bucket int")
        for name in self.state[table]:
            part = self.spark.read.schema(schema + ", bucket int").parquet(f"{self.folder}/{name}")
            rows = part if name == self.state[table][0] else rows.unionByName(part)
        return rows.where(F.col("bucket").isin(buckets))

    def touched(self, new: DataFrame) -> list[int]:
        """The buckets of a batch, at most as many as the store has."""
        return sorted(r[0] for r in new.select(bucket_of(self.state["buckets"])).distinct().collect())

    def related(self, new: DataFrame) -> DataFrame:
        """The stored records that agree with one of the batch in account and amount, with their representative."""
        buckets = self.touched(new)
        blocks = new.select(*BLOCK).distinct()
        spot = F.pmod(F.xxhash64(*BLOCK), F.lit(FILTER_BITS)).cast("int")
        # FILTER_BITS / 64 rows at most, whatever the batch.
        words = blocks.groupBy(F.shiftright(spot, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(account, cents), {FILTER_BITS}) % 64 as int))")).alias("bits"))
        read = self._read("records", RECORD, buckets).drop("bucket").withColumn("spot", spot).withColumn("word", F.shiftright("spot", 6))
        kept = read.join(F.broadcast(words), "word").where(F.getbit("bits", F.col("spot") % 64) == 1).select(*COLUMNS)
        # An inner join on distinct keys; the planner would move a semi join before the filter.
        exact = kept.join(blocks, BLOCK)
        if not self.state["mapping"]:
            return exact.withColumn("root", F.col("id")).withColumn("named", F.col("value").isNotNull())
        mapped = self._read("mapping", f"account string, cents long, {MAPPING}", buckets).join(blocks, BLOCK, "left_semi")
        latest = mapped.groupBy(F.col("node").alias("id")).agg(F.max_by(F.struct("root", "named"), "generation").alias("m"))
        return exact.join(latest, "id", "left").withColumn("root", F.coalesce("m.root", "id")).withColumn("named", F.coalesce("m.named", F.col("value").isNotNull())).drop("m")

    def link(self, batch: DataFrame, files: DataFrame | None = None, weights: Weights | None = None, threshold: float = THRESHOLD) -> Linked:
        """Find the repeats of a batch (``incoming_transactions``); nothing is stored yet.

        ``files`` has (id, content_hash, created_at) of the batches known so far:
        lines of a file whose content was imported before look at that file first.
        Records that are stored already are found as they were.  Nulls and
        placeholders are no identifiers.  Rows that repeat an ``id`` count once.
        Empty tables give an empty result; other columns are ignored.

        Records with identifiers close to clusters by their links.  A record
        without one joins the earlier record it fits best (of equal ones the
        smallest), so it can't tie two transactions together.  A record with
        identifier that follows no other with one joins the smallest earlier
        record without identifier that it fits, if that belongs to no other
        transaction.  So batches one after another give what all at once give.
        """
        lines = normalised(batch)
        repeated = not batch.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 and id is not null").isEmpty()
        lines = written(lines.dropDuplicates(["id"]) if repeated else lines)
        related = self.related(lines)
        both = [rows.withColumn("fresh", F.lit(fresh)) for rows, fresh in ((related, False), (lines.withColumn("root", F.col("id")).withColumn("named", F.col("value").isNotNull()), True))]
        records = both[0].unionByName(both[1])
        records = written(self._filed(records, files))
        stored = records.where("not fresh")
        known = stored.join(lines.select("id"), "id", "left_semi").select("id", "root")
        new, held = records.where("fresh"), records
        if not known.isEmpty():  # a batch that was stored before, or part of one
            new = new.join(stored.select("id"), "id", "left_anti")
            held = stored.unionByName(new)
        known = known.where("root <> id").select(F.col("root").alias("original_id"), F.col("id").alias("duplicate_id"))
        pairs = candidates(held)
        if weights is None:
            weights = self.weights()
        if weights is None:
            weights = learn(pairs.groupBy(*PATTERN).agg(F.count("*").alias("n")).toPandas())  # at most 5 x 3 x 3 x 2 x 2 patterns
        links = pairs.withColumn("weight", weights.total()).where((F.col("weight") >= threshold) & ~forbidden())
        clusters = cut(self._clusters(links, held))
        ids = new.select(F.col("id").alias("node"))
        found = clusters.where("node <> root").join(ids, "node", "left_semi").select(F.col("root").alias("original_id"), F.col("node").alias("duplicate_id"))
        return Linked(found.unionByName(known), self._changed(clusters, held), new.select(*COLUMNS), weights)

    def _filed(self, records: DataFrame, files: DataFrame | None) -> DataFrame:
        """Records with ``file``, the first batch with the same content hash where there are several, and whether theirs is a later one."""
        if files is None:
            return records.withColumn("file", F.lit(None).cast("string")).withColumn("resent", F.lit(False))
        known = files.where(F.col("content_hash").isNotNull() & F.col("id").isNotNull()).select(F.col("id").alias("batch"), "content_hash", "created_at")
        first = known.groupBy("content_hash").agg(F.min_by("batch", F.struct("created_at", "batch")).alias("file"), (F.min("batch") != F.max("batch")).alias("several")).where("several")
        shared = known.join(first, "content_hash").groupBy("batch").agg(F.min("file").alias("file"))
        return records.join(shared, "batch", "left").withColumn("resent", F.coalesce(F.col("file") != F.col("batch"), F.lit(False)))

    def _clusters(self, links: DataFrame, held: DataFrame) -> DataFrame:
        """(node, root) of every record and representative that a link ties."""
        roots = held.where("not fresh").select(F.col("id").alias("other"), F.col("root").alias("own"))
        rooted = links.join(roots, "other", "left").withColumn("head", F.coalesce("own", "other"))
        rooted = cut(rooted.select("id", "other", "head", "weight", "nameless", "other_nameless"))
        strong = rooted.where("not nameless and not other_nameless")
        weak = rooted.where("nameless").groupBy("id").agg(F.max_by("head", F.struct("weight", -F.col("other"))).alias("head"), F.max_by("other_nameless", F.struct("weight", -F.col("other"))).alias("chained"))
        edges = strong.select("id", "head").unionByName(weak.select("id", "head"))
        # A record with identifier that follows none, and earlier records without one that it fits.
        leading = rooted.where("not nameless and other_nameless").join(strong.select("id").distinct(), "id", "left_anti").select("id", "head")
        if leading.isEmpty():
            return components(edges, "id", "head")
        chains = components(weak.where("chained").select("id", "head"), "id", "head").withColumnsRenamed({"node": "head", "root": "top"})
        taken = weak.where("not chained").select(F.col("id").alias("top")).unionByName(held.where("named").select(F.col("root").alias("top"))).distinct()
        open_ = cut(leading.join(chains, "head", "left").select("id", F.coalesce("top", "head").alias("top")).join(taken, "top", "left_anti").distinct())
        claims = []
        while not open_.isEmpty():  # nearly always once
            first = open_.groupBy("top").agg(F.min("id").alias("id"))
            claim = cut(first.groupBy("id").agg(F.min("top").alias("head")))
            claims.append(claim)
            open_ = cut(open_.join(claim.select("id"), "id", "left_anti").join(claim.select(F.col("head").alias("top")), "top", "left_anti"))
        for claim in claims:
            edges = edges.unionByName(claim)
        return components(edges, "id", "head")

    def _changed(self, clusters: DataFrame, held: DataFrame) -> DataFrame:
        """(account, cents, node, root, named) of the records whose representative is new, members of merged clusters included."""
        of = clusters.withColumnsRenamed({"node": "before", "root": "after"})
        now = held.withColumnRenamed("root", "before").join(of, "before").select(*BLOCK, F.col("id").alias("node"), "before", F.col("after").alias("root"), "named", "fresh")
        flags = now.groupBy("root").agg(F.max("named").alias("named"))
        # Members of an old cluster need a row only where its representative or what it is known by changed.
        return now.withColumnRenamed("named", "was").join(flags, "root").where("fresh or before <> root or was <> named").select(*BLOCK, "node", "root", "named")

    def weights(self) -> Weights | None:
        """The weights learned from the first batch that was accepted; they stay, so that later batches are judged alike."""
        known = self.state["weights"]
        return Weights(known["levels"], known["odds"]) if known else None

    def accept(self, linked: Linked) -> None:
        """Store a batch: its records, its representatives and the weights it was judged by."""
        generation = len(self.state["mapping"]) + 1
        changed = cut(linked.representatives)
        self._add("records", linked.records)
        self._add("mapping", changed.withColumn("generation", F.lit(generation)))
        self.state["weights"] = {"levels": linked.weights.levels, "odds": linked.weights.odds}
        self._save()

    def representatives(self) -> DataFrame:
        """(node, root) of every record that is or has a repeat."""
        mapped = self._read("mapping", f"account string, cents long, {MAPPING}", list(range(self.state["buckets"])))
        return mapped.groupBy("node").agg(F.max_by("root", "generation").alias("root"))


def store_of(history: DataFrame) -> LinkageStore:
    """The store of a history below ``spark.checkpoint.dir``, made once for the same files; a table that isn't read from files gets a new one."""
    spark = history.sparkSession
    return LinkageStore.of(history, f"{checkpoint_root(spark)}/linkage-{fingerprint_of(history, RECORD, FORMAT) or uuid.uuid4().hex}")


def duplicates(history: DataFrame, incoming: DataFrame, files: DataFrame | None = None, weights: Weights | None = None) -> DataFrame:
    """(original_id, duplicate_id): the incoming records that repeat an earlier one, with the smallest of its transaction."""
    return store_of(history).link(incoming, files, weights).repeats
