"""Evaluation analytics: retrieval metrics, experiment summaries, routing, reviews, data checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import QueryError
from .sequences import cumulative

METRICS = ("hit_1", "hit_3", "hit_5", "mrr_10", "candidate_recall_20", "evidence_recall_5")


def six(x: Column) -> Column:
    return F.round(x, 6)


def evidence_matches(hits: DataFrame, evidence: DataFrame) -> DataFrame:
    """(case_id, evidence_id, rank) of hits that hold an evidence: same source and heading, and its quote.

    ``hits``: case_id, rank, source, heading, text. ``evidence``: case_id, evidence_id, source, heading, quote.
    """
    return hits.join(evidence, ["case_id", "source", "heading"]).where(F.contains("text", F.col("quote"))).select("case_id", "evidence_id", "rank")


def retrieval_metrics(evidence: DataFrame, matched: DataFrame) -> DataFrame:
    """One row for each case with evidence: hit@1/3/5, MRR@10, candidate recall@20, evidence recall@5."""
    best = matched.groupBy("case_id", "evidence_id").agg(F.min("rank").alias("rank"))
    all_of = evidence.select("case_id", "evidence_id").distinct().join(best, ["case_id", "evidence_id"], "left")
    within = lambda k: F.count(F.when(F.col("rank") <= k, 1))
    first = F.min(F.when(F.col("rank") <= 10, F.col("rank")))
    return all_of.groupBy("case_id").agg(
        *((within(k) > 0).cast("double").alias(f"hit_{k}") for k in (1, 3, 5)), six(F.coalesce(1 / first, F.lit(0.0))).alias("mrr_10"),
        six(within(20) / F.count("*")).alias("candidate_recall_20"), six(within(5) / F.count("*")).alias("evidence_recall_5"),
    )


def percentiles(rows: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(group, one column for each share): percentiles with linear interpolation, exact, null values left out.

    Distinct values are counted where they are and dealt by range, so a group
    may have any number of them.
    """
    ranked = cumulative(rows.where(F.col(value).isNotNull()).select(group, value), group, value)
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col(value)))
    picked, made = [], []
    for name, share in shares.items():
        place = F.lit(share) * (F.col("total") - 1)
        picked += [at(F.floor(place)).alias(f"{name}_low"), at(F.ceil(place)).alias(f"{name}_high")]
        rest = F.lit(share) * (F.col("__total") - 1)
        made.append((F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * (rest - F.floor(rest))).alias(name))
    return ranked.groupBy(group).agg(F.max("total").alias("__total"), *picked).select(group, *made)


def experiment_summary(runs: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """By mode and group: planned, succeeded, failed, latencies, and each metric's mean over successes and with failures as 0.

    ``runs``: mode, run_group, ok, eligible, latency_ms and the metrics (null where not scored).
    """
    ok = F.col("ok")
    columns = [F.count("*").alias("planned"), F.count(F.when(ok, 1)).alias("succeeded"), F.count(F.when(~ok, 1)).alias("failed"), F.count(F.when(F.col("eligible"), 1)).alias("metric_planned")]
    for m in metrics:
        scored = F.when(ok, F.col(m))
        columns += [six(F.avg(scored)).alias(m), six(F.sum(scored) / F.nullif(F.count(F.when(F.col("eligible"), 1)), F.lit(0))).alias(f"{m}_failure_as_zero")]
    keyed = runs.withColumn("__group", F.struct("mode", "run_group"))
    # All runs and the successful ones in one pass.
    both = keyed.select(F.explode(F.array(F.struct("__group", F.lit(False).alias("only_ok")), F.when(ok, F.struct("__group", F.lit(True).alias("only_ok"))))).alias("of"), "latency_ms").where(F.col("of").isNotNull())
    halves = percentiles(both, "of", "latency_ms", {"p50": 0.5, "p95": 0.95})
    latencies = halves.groupBy("of.__group").agg(
        *(six(F.max(F.when(F.col("of.only_ok") == only, F.col(p)))).alias(f"{name}_{p}") for name, only in (("latency", False), ("successful", True)) for p in ("p50", "p95"))
    )
    return keyed.groupBy("__group").agg(*columns).join(latencies, "__group", "left").select("__group.*", "*").drop("__group")


def rank_summary(cases: DataFrame) -> DataFrame:
    """(case_group, cases, found, file_1, heading_1, heading_3, mean_rank): shares over all cases, the mean over those found.

    ``cases``: case_group, file_rank and heading_rank, null where it wasn't found.
    """
    within = lambda rank, k: six(F.avg((F.coalesce(F.col(rank), F.lit(k + 1)) <= k).cast("double")))
    return cases.groupBy("case_group").agg(
        F.count("*").alias("cases"), F.count("heading_rank").alias("found"), within("file_rank", 1).alias("file_1"), within("heading_rank", 1).alias("heading_1"), within("heading_rank", 3).alias("heading_3"),
        six(F.avg("heading_rank")).alias("mean_rank"),
    )


# Fixed value: the least mean length of a passage by which answers can be judged.
LEAST_CONTEXT = 80


def context_gate(passages: DataFrame, group: str, text: str) -> DataFrame:
    """(group, passages, mean_length, problem): groups whose passages are missing or too short on average to hold an answer.

    The mean is over single passages, so many short ones don't add up to enough.
    """
    mean = F.avg(F.char_length(text))
    problem = F.when(F.count(text) == 0, "none").when(mean < LEAST_CONTEXT, "short")
    return passages.groupBy(group).agg(F.count(text).alias("passages"), six(mean).alias("mean_length"), problem.alias("problem"))


def repeated_cases(cases: DataFrame, *columns: str) -> DataFrame:
    """(column, value, count) of values that must be unique and aren't, such as identifiers and questions."""
    named = cases.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("c")).select("c.*")
    return named.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("count")).where(F.col("count") > 1)


def context_accounting(steps: DataFrame) -> DataFrame:
    """(task_id, steps, context_chars, returned_chars, saved_chars): what a delegated task read, what it gave back, and the difference, which may be negative.

    ``steps``: task_id, content, is_call (a tool was called) and is_answer (given back).
    """
    length = F.coalesce(F.char_length("content"), F.lit(0)).cast("long")
    total = lambda which: F.coalesce(F.sum(F.when(which, length)), F.lit(0))
    counted = steps.groupBy("task_id").agg(F.count(F.when(F.col("is_call"), 1)).alias("steps"), total(F.lit(True)).alias("context_chars"), total(F.col("is_answer")).alias("returned_chars"))
    return counted.withColumn("saved_chars", F.col("context_chars") - F.col("returned_chars"))


def route_metrics(cases: DataFrame) -> DataFrame:
    """(case_id, required_recall, successful_recall, route_correct, forbidden_called).

    ``cases``: case_id, case_group, slots (array of arrays), called, succeeded, forbidden (arrays). Unanswerable cases have no recall.
    """
    share = lambda used: F.size(F.filter("slots", lambda slot: F.arrays_overlap(slot, F.col(used))))
    graded = F.col("case_group") != "unanswerable"
    total, banned = F.size("slots"), F.arrays_overlap("called", "forbidden")
    return cases.select(
        "case_id", F.when(graded, six(share("called") / total)).alias("required_recall"), F.when(graded, six(share("succeeded") / total)).alias("successful_recall"),
        F.when(graded, ((share("called") == total) & ~banned).cast("double")).alias("route_correct"), banned.alias("forbidden_called"),
    )


def review_summary(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """By group: planned, and for each score its mean, reviewed and pending. Raises for a repeated (id, trial) or a score out of 0..1."""
    if rows.groupBy("id", "trial").count().where("count > 1").limit(1).count():
        raise QueryError("a review record is repeated")
    bad = F.lit(False)
    for f in fields:
        bad |= F.coalesce((F.col(f) < 0) | (F.col(f) > 1) | F.isnan(F.col(f).cast("double")), F.lit(False))
    if rows.where(bad).limit(1).count():
        raise QueryError("scores must be 0 to 1 or null")
    columns = [F.count("*").alias("planned")]
    for f in fields:
        columns += [six(F.avg(f)).alias(f"{f}_mean"), F.count(f).alias(f"{f}_reviewed"), (F.count("*") - F.count(f)).alias(f"{f}_pending")]
    return rows.groupBy("review_group").agg(*columns)


def mean_by(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, mean, valid, total) over finite values."""
    finite = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), F.col(value))
    return rows.groupBy(key).agg(six(F.avg(finite)).alias("mean"), F.count(finite).alias("valid"), F.count("*").alias("total"))


def bad_vectors(vectors: DataFrame, dimension: int, vector: str = "embedding") -> DataFrame:
    """The rows whose vector has another dimension, a value that is no finite number, or only zeros."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(v.isNull() | (F.size(v) != dimension) | ~finite | ~F.exists(v, lambda x: x != 0))


def leaking_families(cases: DataFrame) -> DataFrame:
    """(family, splits) of the families that stand in more than one split."""
    return cases.groupBy("family").agg(F.count_distinct("split").alias("splits")).where("splits > 1")


def first_position(items: Column, wanted: Column) -> Column:
    return F.nullif(F.array_position(items, wanted), F.lit(0).cast("long"))


def p95(values: DataFrame, group: str, value: str) -> DataFrame:
    """(group, p95): the value at place min(floor(0.95 n), n - 1) from 0 in each group."""
    ranked = cumulative(values, group, value)
    place = F.least(F.floor(F.col("total") * 95 / 100).cast("long"), F.col("total") - 1)
    return ranked.where((F.col("upto") - F.col("n") <= place) & (place < F.col("upto"))).select(group, F.col(value).alias("p95"))


def rate_windows(hits: DataFrame, key: str, stamp: str, seconds: int, most: int) -> DataFrame:
    """Hits with ``recent``: how many of the key's hits lie in the seconds up to each, and ``limited`` beyond ``most``.

    A hit can see back into the stretch of ``seconds`` before its own, so each
    is also sent to the next stretch; no task needs all hits of a key.
    """
    second = F.floor(F.unix_micros(F.col(stamp).cast("timestamp")) / 1_000_000)
    timed = hits.withColumn("__second", second).withColumn("__own", F.explode(F.array(F.lit(True), F.lit(False))))
    dealt = timed.withColumn("__stretch", F.floor(F.col("__second") / seconds) + F.when(F.col("__own"), 0).otherwise(1))
    order = Window.partitionBy(key, "__stretch").orderBy("__second").rangeBetween(-seconds, 0)
    counted = dealt.withColumn("recent", F.count("*").over(order)).where("__own").drop("__second", "__own", "__stretch")
    return counted.withColumn("limited", F.col("recent") > most)


def status_counts(events: DataFrame, status: str, known: list[str]) -> DataFrame:
    """(status, count) of all known statuses, 0 where none has it."""
    listed = events.sparkSession.createDataFrame([(s,) for s in known], "status string")
    counted = events.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))
    return listed.join(counted, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("count"))


def inventory(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(source, chunks) of each file, null where it has none in the index."""
    return files.select("source").distinct().join(chunks.groupBy("source").agg(F.count("*").alias("chunks")), "source", "left")


def agent_summary(runs: DataFrame) -> DataFrame:
    """By group: planned, succeeded, graded, latencies, and route metrics with a failed run as 0.

    ``runs``: case_group, ok, latency_ms, required_recall, successful_recall, route_correct (null where not graded).
    """
    graded = F.col("route_correct").isNotNull()
    columns = [F.count("*").alias("planned"), F.count(F.when(F.col("ok"), 1)).alias("succeeded"), F.count(F.when(graded, 1)).alias("graded")]
    for m in ("required_recall", "successful_recall", "route_correct"):
        columns.append(six(F.avg(F.when(graded, F.when(F.col("ok"), F.col(m)).otherwise(0.0)))).alias(m))
    latencies = percentiles(runs, "case_group", "latency_ms", {"p50": 0.5, "p95": 0.95}).select("case_group", six(F.col("p50")).alias("latency_p50"), six(F.col("p95")).alias("latency_p95"))
    return runs.groupBy("case_group").agg(*columns).join(latencies, "case_group", "left")


def routing_by_group(samples: DataFrame) -> DataFrame:
    """By group: cases, those that searched, and those that found every expected source.

    ``samples``: case_group, searches (array), found (array of sources), expected (array).
    """
    searched = F.size("searches") > 0
    every = F.forall("expected", lambda s: F.array_contains("found", s))
    return samples.groupBy("case_group").agg(F.count("*").alias("cases"), F.count(F.when(searched, 1)).alias("searched"), F.count(F.when(searched & every, 1)).alias("found_all"))


def cache_counters(lookups: DataFrame, ttl_seconds: int) -> DataFrame:
    """(cache, hits, misses): lookups with their entry's age in seconds, null where there was none; older ones miss."""
    fresh = F.coalesce(F.col("age") <= ttl_seconds, F.lit(False))
    return lookups.groupBy("cache").agg(F.count(F.when(fresh, 1)).alias("hits"), F.count(F.when(~fresh, 1)).alias("misses"))
