"""Queries of the evaluation analytics, scalar functions and event checks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import CORRECTION, MEMORY_LINE, ONE_OFF, PREFERENCE, as_money, half_up, json_object, memory_kind, money, shortened, shown_money, shown_number, shown_value, worth_remembering
from ..operators import metrics, query, traps
from ..session import checkpoint_root, forget
from ..sources.ledger import lineitem_ledger, orders_ledger
from ..sources.tables import table
from ..streaming.projections import CONSUMERS, Projection, event_of, run_projection, validated
from . import sql as S
from .ledger import duplicates_sql, planted
from .registry import Registry

registry = Registry()
add = registry.add

# case, evidence, source, heading, quote
EVIDENCE = "(1, 1, 'a.md', '退款', 'refund'), (1, 2, 'a.md', '预算', 'budget'), (2, 1, 'b.md', '保险', 'yearly'), (3, 1, 'c.md', 'Rent', 'missing')"
# case, rank, source, heading, text
HITS = "(1, 1, 'a.md', '退款', 'no quote'), (1, 3, 'a.md', '退款', 'a refund came'), (1, 12, 'a.md', '预算', 'the budget'), (2, 10, 'b.md', '保险', 'paid yearly'), (2, 2, 'b.md', '其他', 'paid yearly'), (3, 1, 'c.md', 'Rent', 'rent')"
_E = f"(SELECT * FROM (VALUES {EVIDENCE}) AS e(case_id, evidence_id, source, heading, quote))"
_H = f"(SELECT * FROM (VALUES {HITS}) AS h(case_id, rank, source, heading, text))"
_MATCHED = f"SELECT e.case_id, e.evidence_id, h.rank FROM {_E} e JOIN {_H} h ON h.case_id = e.case_id AND h.source = e.source AND h.heading = e.heading WHERE contains(h.text, e.quote)"


def _matched(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    evidence = spark.sql(f"SELECT * FROM {_E}")
    return evidence, metrics.evidence_matches(spark.sql(f"SELECT * FROM {_H}"), evidence)


@add("evidence_match", _MATCHED)
def evidence_match(spark: SparkSession, _: str) -> DataFrame:
    return _matched(spark)[1]


@add(
    "retrieval_metrics",
    f"WITH m AS (SELECT e.case_id, e.evidence_id, min(rank) AS rank FROM {_E} e LEFT JOIN ({_MATCHED}) x ON x.case_id = e.case_id AND x.evidence_id = e.evidence_id GROUP BY 1, 2) SELECT case_id, "
    + ", ".join(f"CAST(count(*) FILTER (rank <= {k}) > 0 AS DOUBLE) AS hit_{k}" for k in (1, 3, 5))
    + ", round(coalesce(1.0 / min(rank) FILTER (rank <= 10), 0), 6) AS mrr_10, round(count(*) FILTER (rank <= 20) / count(*), 6) AS candidate_recall_20, "
    "round(count(*) FILTER (rank <= 5) / count(*), 6) AS evidence_recall_5 FROM m GROUP BY case_id",
)
def retrieval_metrics(spark: SparkSession, _: str) -> DataFrame:
    return metrics.retrieval_metrics(*_matched(spark))


_RUNS = (
    "SELECT CAST(user_id % 3 AS {s}) AS mode, event_type AS run_group, event_id % 11 <> 0 AS ok, event_id % 5 <> 0 AS eligible, value AS latency_ms, "
    "CASE WHEN event_id % 5 <> 0 THEN CAST(event_id % 2 AS DOUBLE) END AS hit, CASE WHEN event_id % 5 <> 0 THEN 1.0 / (1 + event_id % 4) END AS mrr FROM events"
)


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    table(spark, folder, "events").createOrReplaceTempView("events_of_runs")
    return spark.sql(_RUNS.format(s="STRING").replace("FROM events", "FROM events_of_runs")).withColumn("mrr", F.col("mrr").cast("double"))


_EXPERIMENT = (
    "SELECT mode, run_group, count(*) AS planned, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (eligible) AS metric_planned, "
    "round(quantile_cont(latency_ms, 0.5), 6) AS latency_p50, round(quantile_cont(latency_ms, 0.95), 6) AS latency_p95, round(quantile_cont(latency_ms, 0.5) FILTER (ok), 6) AS successful_p50, "
    "round(quantile_cont(latency_ms, 0.95) FILTER (ok), 6) AS successful_p95, "
    + ", ".join(f"round(avg({m}) FILTER (ok), 6) AS {m}, round(sum({m}) FILTER (ok) / nullif(count(*) FILTER (eligible), 0), 6) AS {m}_failure_as_zero" for m in ("hit", "mrr"))
    + f" FROM (SELECT * REPLACE (CAST(mrr AS DOUBLE) AS mrr) FROM ({_RUNS.format(s='VARCHAR')})) GROUP BY 1, 2"
)


@add("experiment_summary", _EXPERIMENT)
def experiment_summary(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.experiment_summary(_runs(spark, folder), ("hit", "mrr"))


@add("latency_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(stddev_samp(value), 6) AS spread, round(median(value), 6) AS middle FROM events GROUP BY 1")
def latency_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    six = lambda x: F.round(x, 6)
    found = metrics.percentiles(e, "event_type", "value", {"p50": 0.5, "p95": 0.95, "middle": 0.5})
    spread = e.groupBy("event_type").agg(six(F.stddev_samp("value")).alias("spread"))
    return spread.join(found, "event_type", "left").select("event_type", six(F.col("p50")).alias("p50"), six(F.col("p95")).alias("p95"), "spread", six(F.col("middle")).alias("middle"))


@add(
    "rank_summary",
    "SELECT event_type AS case_group, count(*) AS cases, count(h) AS found, round(avg(CAST(coalesce(f, 99) <= 1 AS DOUBLE)), 6) AS file_1, round(avg(CAST(coalesce(h, 99) <= 1 AS DOUBLE)), 6) AS heading_1, "
    "round(avg(CAST(coalesce(h, 99) <= 3 AS DOUBLE)), 6) AS heading_3, round(avg(h), 6) AS mean_rank FROM (SELECT event_type, nullif(event_id % 5, 0) AS f, nullif(event_id % 9, 0) AS h FROM events) GROUP BY 1",
)
def rank_summary(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    zero = F.lit(0).cast("long")
    return metrics.rank_summary(e.select(F.col("event_type").alias("case_group"), F.nullif(F.col("event_id") % 5, zero).alias("file_rank"), F.nullif(F.col("event_id") % 9, zero).alias("heading_rank")))


@add("context_gate", "SELECT source, count(text) AS passages, round(avg(length(text)), 6) AS mean_length, CASE WHEN count(text) = 0 THEN 'none' WHEN avg(length(text)) < 80 THEN 'short' END AS problem FROM knowledge_chunks GROUP BY 1")
def context_gate(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.context_gate(table(spark, folder, "knowledge_chunks"), "source", "text")


@add("repeated_cases", "SELECT 'content_hash' AS \"column\", content_hash AS value, count(*) AS count FROM import_batches WHERE content_hash IS NOT NULL GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'id', id, count(*) FROM import_batches WHERE id IS NOT NULL GROUP BY 2 HAVING count(*) > 1")
def repeated_cases(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.repeated_cases(table(spark, folder, "import_batches"), "id", "content_hash")


_IS = "coalesce(contains(payload, '\"type\": \"{t}\"') OR contains(payload, '\"type\":\"{t}\"'), FALSE)"
_CALL, _ANSWER = _IS.format(t="tool_call"), _IS.format(t="answer")


@add(
    "context_accounting",
    f"SELECT session_id AS task_id, count(*) FILTER ({_CALL}) AS steps, CAST(coalesce(sum(length(payload)), 0) AS BIGINT) AS context_chars, CAST(coalesce(sum(length(payload)) FILTER ({_ANSWER}), 0) AS BIGINT) AS returned_chars, "
    f"CAST(coalesce(sum(length(payload)), 0) - coalesce(sum(length(payload)) FILTER ({_ANSWER}), 0) AS BIGINT) AS saved_chars FROM session_events GROUP BY 1",
)
def context_accounting(spark: SparkSession, folder: str) -> DataFrame:
    """Each session as a delegated task: its tool calls, what it read, and its answers."""
    rows = table(spark, folder, "session_events")
    return metrics.context_accounting(rows.select(F.col("session_id").alias("task_id"), F.col("payload").alias("content"), F.expr(_CALL).alias("is_call"), F.expr(_ANSWER).alias("is_answer")))


_LONG = "repeat(text, 3)"


@add("shorten_texts", f"SELECT doc_id, CASE WHEN length({_LONG}) > 20000 THEN substring({_LONG}, 1, 20000) || chr(10) || '…[已截断，原文共 ' || length({_LONG}) || ' 字符]' ELSE {_LONG} END AS shown FROM documents")
def shorten_texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", shortened(F.expr(_LONG)).alias("shown"))


@add("shown_values", "SELECT id, format('{:,.2f}', amount) AS money, format('{:,}', CAST(id * 37 AS BIGINT)) || ' 笔' AS counted FROM ledger_transactions")
def shown_values(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "ledger_transactions").select("id", shown_money(F.col("amount")).alias("money"), shown_value(F.col("id") * 37, "count").alias("counted"))


CASES = "(1, 'routing', 'a,b;c', 'a,c', 'a', 'x'), (2, 'routing', 'a;b', 'a,x', 'a', 'x'), (3, 'unanswerable', 'a', '', '', ''), (4, 'routing', 'a', 'b', '', 'c')"
_OVERLAP = "len(list_intersect(string_split(slot, ','), list_filter(string_split({u}, ','), lambda z: z <> ''))) > 0"


def _share(used: str) -> str:
    return f"CASE WHEN case_group <> 'unanswerable' THEN round(len(list_filter(string_split(slots, ';'), lambda slot: {_OVERLAP.format(u=used)})) / len(string_split(slots, ';')), 6) END"


_BANNED = "len(list_intersect(list_filter(string_split(called, ','), lambda z: z <> ''), list_filter(string_split(forbidden, ','), lambda z: z <> ''))) > 0"


@add(
    "route_metrics",
    f"SELECT case_id, {_share('called')} AS required_recall, {_share('succeeded')} AS successful_recall, CASE WHEN case_group <> 'unanswerable' THEN CAST(({_share('called')}) = 1 AND NOT ({_BANNED}) AS DOUBLE) END AS route_correct, "
    f"{_BANNED} AS forbidden_called FROM (VALUES {CASES}) AS t(case_id, case_group, slots, called, succeeded, forbidden)",
)
def route_metrics(spark: SparkSession, _: str) -> DataFrame:
    cases = spark.sql(f"SELECT * FROM (VALUES {CASES}) AS t(case_id, case_group, slots, called, succeeded, forbidden)")
    listed = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    return metrics.route_metrics(cases.select("case_id", "case_group", F.transform(F.split("slots", ";"), lambda s: F.split(s, ",")).alias("slots"), *(listed(c).alias(c) for c in ("called", "succeeded", "forbidden"))))


REVIEWS = "('q1', 1, 'literal', 1.0, 0.5), ('q2', 1, 'literal', NULL, 0.25), ('q3', 1, 'paraphrased', 0.75, NULL), ('q3', 2, 'paraphrased', 0.5, NULL)"


@add(
    "review_summary",
    "SELECT review_group, count(*) AS planned, " + ", ".join(f"round(avg({f}), 6) AS {f}_mean, count({f}) AS {f}_reviewed, count(*) - count({f}) AS {f}_pending" for f in ("answer", "grounding"))
    + f" FROM (SELECT id, trial, review_group, CAST(answer AS DOUBLE) AS answer, CAST(grounding AS DOUBLE) AS grounding FROM (VALUES {REVIEWS}) AS t(id, trial, review_group, answer, grounding)) GROUP BY 1",
)
def review_summary(spark: SparkSession, _: str) -> DataFrame:
    rows = spark.sql(f"SELECT id, trial, review_group, CAST(answer AS DOUBLE) AS answer, CAST(grounding AS DOUBLE) AS grounding FROM (VALUES {REVIEWS}) AS t(id, trial, review_group, answer, grounding)")
    return metrics.review_summary(rows, ("answer", "grounding"))


@add("per_source_mean", "SELECT source, round(avg(v), 6) AS mean, count(v) AS valid, count(*) AS total FROM (SELECT source, CASE WHEN n_chars > 0 THEN ln(n_chars) END AS v FROM documents) GROUP BY 1")
def per_source_mean(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").withColumn("v", F.when(F.col("n_chars") > 0, F.log(F.col("n_chars").cast("double"))).otherwise(F.lit(float("nan"))))
    return metrics.mean_by(d, "source", "v")


@add("vector_quality", "SELECT vec_id FROM (SELECT vec_id, CASE WHEN vec_id % 50 = 0 THEN embedding[1:3] WHEN vec_id % 77 = 0 THEN list_transform(embedding, lambda x: CAST(0 AS FLOAT)) ELSE embedding END AS e, len(embedding) AS n FROM embeddings) WHERE len(e) <> n OR len(list_filter(e, lambda x: x <> 0)) = 0")
def vector_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of which some were cut short and some set to zero."""
    e = table(spark, folder, "embeddings")
    damaged = e.withColumn("whole", F.size("embedding")).withColumn(
        "embedding", F.when(F.col("vec_id") % 50 == 0, F.slice("embedding", 1, 3)).when(F.col("vec_id") % 77 == 0, F.transform("embedding", lambda x: F.lit(0).cast("float"))).otherwise(F.col("embedding"))
    )
    size = e.select(F.max(F.size("embedding"))).first()[0] or 0
    return metrics.bad_vectors(damaged, size).select("vec_id")


@add("split_leak_check", "SELECT source AS family, count(DISTINCT coalesce(lang, 'none')) AS splits FROM documents GROUP BY 1 HAVING count(DISTINCT coalesce(lang, 'none')) > 1")
def split_leak_check(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.leaking_families(table(spark, folder, "documents").select(F.col("source").alias("family"), F.coalesce("lang", F.lit("none")).alias("split")))


@add("first_position", "SELECT doc_id, CAST(nullif(coalesce(list_position(string_split(text, ' '), 'rent'), 0), 0) AS BIGINT) AS place FROM documents WHERE text IS NOT NULL")
def first_position(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where(F.col("text").isNotNull()).select("doc_id", metrics.first_position(F.split("text", " "), F.lit("rent")).alias("place"))


@add("p95_by_category", f"WITH r AS (SELECT category, amount, row_number() OVER (PARTITION BY category ORDER BY amount) - 1 AS i, count(*) OVER (PARTITION BY category) AS n FROM {S.LINES} t) SELECT category, max(amount) AS p95 FROM r WHERE i = least((n * 95) // 100, n - 1) GROUP BY category")
def p95_by_category(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.p95(lineitem_ledger(spark, folder), "category", "amount")


def _traps_sql(source: str) -> str:
    return f"""WITH h AS (SELECT *, row_number() OVER (PARTITION BY merchant ORDER BY date, seq) <= count(*) OVER (PARTITION BY merchant) // 2 AS first FROM {source} t),
m AS (SELECT merchant, count(*) AS n, max(amount) AS most, min(amount) AS least, avg(amount) FILTER (first) AS early, avg(amount) FILTER (NOT first) AS late FROM h GROUP BY merchant),
c AS (SELECT category, amount, row_number() OVER (PARTITION BY category ORDER BY amount) - 1 AS i, count(*) OVER (PARTITION BY category) AS n FROM {source} t WHERE category IS NOT NULL),
k AS (SELECT category, max(amount) AS top, max(amount) FILTER (i = least((n * 95) // 100, n - 1)) AS p FROM c GROUP BY category)
SELECT (SELECT count(*) FROM (SELECT 1 FROM {source} t GROUP BY merchant, date, amount HAVING count(*) >= 2)) AS doubled_days, (SELECT count(*) FROM {source} t WHERE amount < 0) AS refunds,
(SELECT count(*) FROM m WHERE n >= 12 AND most <= 15) AS small_regular, (SELECT count(*) FROM m WHERE early > 0 AND late > 1.2 * early) AS risen,
(SELECT count(*) FROM k WHERE p > 0 AND top > 3 * p) AS far_outliers, (SELECT count(*) FROM m WHERE least > 0 AND most >= 10 * least) AS wide_spread"""


@add("trap_check", _traps_sql(S.SERIES))
def trap_check(spark: SparkSession, _: str) -> DataFrame:
    return traps.trap_check(spark.sql(S.SPARK_SERIES))


@add("trap_check_lines", _traps_sql(S.LINES))
def trap_check_lines(spark: SparkSession, folder: str) -> DataFrame:
    return traps.trap_check(lineitem_ledger(spark, folder))


@add("trap_check_planted", _traps_sql(S.PLANTED))
def trap_check_planted(spark: SparkSession, folder: str) -> DataFrame:
    return traps.trap_check(planted(spark, folder))


@add("rate_limit_window", "SELECT event_id, recent, recent > 3 AS limited FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS recent FROM (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS epoch FROM events))")
def rate_limit_window(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.rate_windows(table(spark, folder, "events"), "user_id", "ts", 86_400, 3).select("event_id", "recent", "limited")


@add("status_counts", "SELECT status, count(e.event_id) AS count FROM (VALUES ('click'), ('view'), ('purchase'), ('signup'), ('error'), ('refund')) s(status) LEFT JOIN events e ON e.event_type = s.status GROUP BY 1")
def status_counts(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.status_counts(table(spark, folder, "events"), "event_type", ["click", "view", "purchase", "signup", "error", "refund"])


@add("consumer_counts", "SELECT consumer, count(*) AS count, max(processed_at) AS last_processed FROM processed_finance_events GROUP BY 1")
def consumer_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "processed_finance_events").groupBy("consumer").agg(F.count("*").alias("count"), F.max("processed_at").alias("last_processed"))


@add("inventory_counts", "SELECT s.source, c.n AS chunks FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN (SELECT source, count(*) AS n FROM knowledge_chunks GROUP BY 1) c ON c.source = s.source")
def inventory_counts(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.inventory(table(spark, folder, "documents"), table(spark, folder, "knowledge_chunks"))


_SCALARS = f"""SELECT seq, {S.money(S.half_up("(" + S.cents("amount") + " * 7)", "3"))} AS thirds, strftime(date, '%Y-%m') AS month, CAST(last_day(date) AS DATE) AS month_end,
CAST(date + to_months(1) AS DATE) AS next_month, regexp_matches(account, '^[A-Z]{{2}}$') AS is_state_like, sha1(txn_id) AS key, length(merchant) AS merchant_length FROM {S.ORDERS} t"""


@add("scalar_functions", _SCALARS)
def scalar_functions(spark: SparkSession, folder: str) -> DataFrame:
    o = orders_ledger(spark, folder)
    return o.select(
        "seq", as_money(half_up((F.col("amount") * 100).cast("long") * 7, F.lit(3).cast("long"))).alias("thirds"), F.date_format("date", "yyyy-MM").alias("month"), F.last_day("date").alias("month_end"),
        F.add_months("date", 1).alias("next_month"), F.col("account").rlike("^[A-Z]{2}$").alias("is_state_like"), F.sha1("txn_id").alias("key"), F.char_length("merchant").cast("long").alias("merchant_length"),
    )


_TEXTS = "('1.005', '- 2026-01-05 [偏好] 我不要咖啡 ', 'x {\"a\": 1} y'), ('2.675', '-[事实] no date', '{}'), ('-2.675', 'free text', 'none'), (' 7 ', '- 2026-02-30 [纠正] bad day', '{\"b\": {\"c\": 2}} z')"


@add(
    "scalar_texts",
    f"SELECT n, TRY_CAST(trim(n) AS DECIMAL(20,2)) AS amount, regexp_extract(trim(m), '^-\\s*(?:(\\d{{4}}-\\d{{2}}-\\d{{2}})\\s*)?\\[([^\\]]+)\\]\\s*(.+?)\\s*$', 2) AS kind, "
    f"regexp_extract(trim(m), '^-\\s*(?:(\\d{{4}}-\\d{{2}}-\\d{{2}})\\s*)?\\[([^\\]]+)\\]\\s*(.+?)\\s*$', 3) AS said, regexp_extract(j, '\\{{.*\\}}') AS object FROM (VALUES {_TEXTS}) t(n, m, j)",
)
def scalar_texts(spark: SparkSession, _: str) -> DataFrame:
    rows = spark.createDataFrame([("1.005", "- 2026-01-05 [偏好] 我不要咖啡 ", 'x {"a": 1} y'), ("2.675", "-[事实] no date", "{}"), ("-2.675", "free text", "none"), (" 7 ", "- 2026-02-30 [纠正] bad day", '{"b": {"c": 2}} z')], "n string, m string, j string")
    line = MEMORY_LINE
    return rows.select("n", money(F.col("n")).alias("amount"), F.regexp_extract(F.trim("m"), line, 2).alias("kind"), F.regexp_extract(F.trim("m"), line, 3).alias("said"), F.regexp_extract(shortened(F.col("j")), r"\{.*\}", 0).alias("object"))


_SAID = "('我住上海', '12,057.34', 'x {\"a\": 1}'), ('这次帮我看看三月', '308 笔', 'none'), ('咖啡应该归到餐饮', 'abc', '{}'), ('短', '-1,5', '{\"b\": 2} and {\"c\": 3} end'), ('不要再算房租 ', '7.', '')"
_HAS = lambda words: "(" + " OR ".join(f"contains(said, '{w}')" for w in words) + ")"


@add(
    "scalar_memory",
    f"SELECT said, length(trim(said)) >= 4 AND NOT {_HAS(ONE_OFF)} AS kept, "
    f"CASE WHEN {_HAS(CORRECTION)} THEN '纠正' WHEN {_HAS(PREFERENCE)} THEN '偏好' ELSE '事实' END AS kind, "
    "CASE WHEN regexp_matches(trim(regexp_replace(trim(n), '笔$', '')), '^-?[0-9,]+([.][0-9]+)?$') THEN TRY_CAST(replace(trim(regexp_replace(trim(n), '笔$', '')), ',', '') AS DOUBLE) END AS number, "
    f"coalesce(nullif(regexp_extract(answer, '\\{{.*\\}}'), ''), '{{}}') AS object FROM (VALUES {_SAID}) t(said, n, answer)",
)
def scalar_memory(spark: SparkSession, _: str) -> DataFrame:
    rows = spark.createDataFrame(
        [("我住上海", "12,057.34", 'x {"a": 1}'), ("这次帮我看看三月", "308 笔", "none"), ("咖啡应该归到餐饮", "abc", "{}"), ("短", "-1,5", '{"b": 2} and {"c": 3} end'), ("不要再算房租 ", "7.", "")], "said string, n string, answer string"
    )
    said = F.col("said")
    return rows.select("said", worth_remembering(said).alias("kept"), memory_kind(said).alias("kind"), shown_number(F.col("n")).alias("number"), json_object(F.col("answer")).alias("object"))


_AGENT = "SELECT event_type AS case_group, event_id % 11 <> 0 AS ok, value AS latency_ms, CASE WHEN event_type <> 'view' THEN (event_id % 4) / 4.0 END AS required_recall, CASE WHEN event_type <> 'view' THEN (event_id % 2) / 2.0 END AS successful_recall, CASE WHEN event_type <> 'view' THEN CAST(event_id % 2 AS DOUBLE) END AS route_correct FROM events"


@add(
    "agent_summary",
    "SELECT case_group, count(*) AS planned, count(*) FILTER (ok) AS succeeded, count(route_correct) AS graded, round(quantile_cont(latency_ms, 0.5), 6) AS latency_p50, round(quantile_cont(latency_ms, 0.95), 6) AS latency_p95, "
    + ", ".join(f"round(avg(CASE WHEN route_correct IS NOT NULL THEN CASE WHEN ok THEN CAST({m} AS DOUBLE) ELSE 0 END END), 6) AS {m}" for m in ("required_recall", "successful_recall", "route_correct"))
    + f" FROM ({_AGENT}) GROUP BY 1",
)
def agent_summary(spark: SparkSession, folder: str) -> DataFrame:
    table(spark, folder, "events").createOrReplaceTempView("events_of_agents")
    rows = spark.sql(_AGENT.replace("FROM events", "FROM events_of_agents"))
    return metrics.agent_summary(rows.select("case_group", "ok", "latency_ms", *(F.col(c).cast("double").alias(c) for c in ("required_recall", "successful_recall", "route_correct"))))


SAMPLES = "('literal', 'q', 'a.md,b.md', 'a.md'), ('literal', '', '', 'a.md'), ('paraphrased', 'q,r', 'c.md', 'a.md,c.md'), ('paraphrased', 'q', 'c.md', 'c.md')"


@add(
    "routing_by_group",
    "SELECT case_group, count(*) AS cases, count(*) FILTER (searches <> '') AS searched, count(*) FILTER (searches <> '' AND list_has_all(string_split(found, ','), string_split(expected, ','))) AS found_all "
    f"FROM (VALUES {SAMPLES}) t(case_group, searches, found, expected) GROUP BY 1",
)
def routing_by_group(spark: SparkSession, _: str) -> DataFrame:
    rows = spark.sql(f"SELECT * FROM (VALUES {SAMPLES}) AS t(case_group, searches, found, expected)")
    listed = lambda c: F.filter(F.split(c, ","), lambda x: x != "").alias(c)
    return metrics.routing_by_group(rows.select("case_group", listed("searches"), listed("found"), listed("expected")))


@add("cache_counters", "SELECT event_type AS cache, count(*) FILTER (event_id % 10 <= 7) AS hits, count(*) FILTER (event_id % 10 > 7) AS misses FROM events GROUP BY 1")
def cache_counters(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of nine ages, and none for every tenth lookup; seven days are fresh."""
    day = F.col("event_id") % 10
    return metrics.cache_counters(table(spark, folder, "events").select(F.col("event_type").alias("cache"), F.when(day != 9, day * 86_400).alias("age")), 7 * 86_400)


@add("session_cursor", "SELECT seq, payload FROM session_events WHERE session_id = (SELECT min(session_id) FROM session_events) AND seq > 3 ORDER BY seq LIMIT 500")
def session_cursor(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "session_events")
    first = events.agg(F.min("session_id")).first()[0]
    return query.after_cursor(events, first, 3).select("seq", "payload")


# --- events and streams -----------------------------------------------------------------------------------------------


@add("event_validate", "SELECT id AS ledger_id, CASE WHEN id % 97 = 0 THEN 'transaction.date' WHEN id % 89 = 0 THEN 'transaction.amount' WHEN id % 83 = 0 THEN 'event_type' END AS error FROM ledger_transactions")
def event_validate(spark: SparkSession, folder: str) -> DataFrame:
    """Events of the whole ledger, some of them damaged, and what is found wrong with them."""
    stored = table(spark, folder, "ledger_transactions")
    value = (
        F.when(F.col("ledger") % 97 == 0, F.regexp_replace("value", r'"date":"(\d{4})-', '"date":"$1/')).when(F.col("ledger") % 89 == 0, F.regexp_replace("value", r'"amount":"([^"]*)"', '"amount":"$15"'))
        .when(F.col("ledger") % 83 == 0, F.regexp_replace("value", "transaction_imported", "transaction_changed")).otherwise(F.col("value"))
    )
    events = event_of(stored).withColumn("ledger", F.get_json_object("value", "$.transaction.id").cast("long"))
    return validated(events.withColumn("value", value)).select("ledger_id", "error")


def _streamed(spark: SparkSession, folder: str, consumer: str) -> DataFrame:
    """The projection of the whole stored ledger, its events streamed in micro-batches and then delivered a second time."""
    root = f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"
    forget(spark, root)
    # Small row groups, so that several tasks can read a file; rows are dealt before they are events, which are longer.
    small = {"parquet.block.size": 8 << 20}
    event_of(table(spark, folder, "ledger_transactions").repartition(6)).select("value").write.options(**small).parquet(f"{root}/events/first")
    projection = Projection(spark, f"{root}/state", consumer)
    messages = spark.readStream.schema("value string").option("maxFilesPerTrigger", 2).option("recursiveFileLookup", True).parquet(f"{root}/events")
    run_projection(messages, projection, f"{root}/checkpoint").awaitTermination()
    spark.read.parquet(f"{root}/events/first").coalesce(6).write.options(**small).parquet(f"{root}/events/again")  # in as many files as the first time
    run_projection(messages, projection, f"{root}/checkpoint").awaitTermination()
    return projection.result()


@add(
    "stream_summary",
    "SELECT account, strftime(date, '%Y-%m') AS month, CAST(sum(greatest(amount, 0.00)) AS DECIMAL(20,2)) AS gross_expense, CAST(sum(greatest(-amount, 0.00)) AS DECIMAL(20,2)) AS credits, "
    "CAST(sum(amount) AS DECIMAL(20,2)) AS net_expense, count(*) AS transaction_count FROM ledger_transactions GROUP BY 1, 2",
)
def stream_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _streamed(spark, folder, CONSUMERS[0])


@add("stream_duplicates", duplicates_sql(f"(SELECT * FROM {S.LEDGER} x WHERE amount > 0)", "account, merchant_key, amount", "txn_id"))
def stream_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    found = _streamed(spark, folder, CONSUMERS[1])
    return found.select("account", "merchant_key", "amount", "times", F.array_join("txn_ids", ",").alias("txn_ids"), F.array_join(F.col("dates").cast("array<string>"), ",").alias("dates"))
