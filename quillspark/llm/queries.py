"""Queries of the training-data operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import Registry
from ..sources.tables import table
from .conversations import conversations, judged, sessionized
from .encode import count_tokens, encode_documents
from .linkage import duplicates
from .names import NameGroups
from .ocr import ScannedPages
from .packing import CAPACITY, pack_documents
from .spans import SharedSpans
from .splitting import split_texts

registry = Registry()


@registry.add("p1_found")
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return duplicates(table(spark, folder, "ledger_transactions"), table(spark, folder, "incoming_transactions"), table(spark, folder, "import_batches"))


@registry.add("p2_found")
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return NameGroups(table(spark, folder, "ledger_transactions"), "merchant_key").pairs()


@registry.add("p2_groups")
def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    return NameGroups(table(spark, folder, "ledger_transactions"), "merchant_key").groups()


@registry.add(
    "p3_found",
    "SELECT DISTINCT chunk_id FROM knowledge_chunks WHERE length(trim(text, chr(32) || chr(9) || chr(13) || chr(10) || chr(12288))) > 900",
)
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_pieces(spark, folder).where("n_pieces > 1").select("chunk_id").distinct()


@registry.add("p3_pieces")
def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_texts(table(spark, folder, "knowledge_chunks"), "chunk_id", "text")


@registry.add("p5_found")
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return ScannedPages(table(spark, folder, "document_parts")).found()


@registry.add("p5_paragraphs")
def p5_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return ScannedPages(table(spark, folder, "document_parts")).paragraphs()


_SEEN = "coalesce(regexp_matches(text, '[^\\s\\p{Z}\\p{Cc}\\p{Cf}]'), FALSE)"
# Every event of a session, one row for each number: what it is, and whether its copies differ.
_NUMBERED = """WITH p AS (SELECT session_id, seq, CASE WHEN NOT json_valid(payload) THEN NULL WHEN json_type(payload) = 'VARCHAR' THEN json_extract_string(payload, '$') ELSE payload END AS doc FROM session_events WHERE session_id IS NOT NULL),
o AS (SELECT session_id, seq, CASE WHEN json_valid(doc) THEN CASE WHEN json_type(doc) = 'OBJECT' THEN CAST(doc AS JSON) END END AS doc FROM p),
e AS (SELECT session_id, coalesce(seq, TRY_CAST(json_extract_string(doc, '$.seq') AS BIGINT)) AS seq, json_extract_string(doc, '$.type') AS kind, json_extract_string(doc, '$.text') AS text,
  array_to_string(list_sort(list_transform(json_keys(doc), lambda k: k || '=' || coalesce(CAST(json_extract(doc, '$."' || k || '"') AS VARCHAR), ''))), '|') AS value FROM o),
m AS (SELECT session_id, seq, min(value) <> max(value) AS clash, bool_or(kind IS NULL OR seq IS NULL) AS unreadable, max(kind) AS kind, max(CASE WHEN kind IN ('turn_start', 'answer') THEN text END) AS text FROM e GROUP BY 1, 2)"""
_JUDGED = f"""{_NUMBERED}, t AS (SELECT session_id, seq, kind, lead(kind) OVER (PARTITION BY session_id ORDER BY seq) AS following FROM m WHERE kind = 'turn_start' OR (kind = 'answer' AND {_SEEN})),
u AS (SELECT session_id, bool_or(kind = 'turn_start' AND coalesce(following, 'turn_start') = 'turn_start') AS unanswered FROM t GROUP BY 1),
j AS (SELECT m.session_id, bool_or(unreadable) OR bool_or(coalesce(clash, FALSE)) OR max(seq) IS NULL OR count(*) FILTER (seq >= 1) <> max(seq) OR count(*) FILTER (kind = 'turn_start') = 0
  OR count(*) FILTER (kind = 'turn_start' AND NOT {_SEEN}) > 0 OR coalesce(min(seq) FILTER (kind = 'answer') < min(seq) FILTER (kind = 'turn_start'), FALSE) OR coalesce(bool_or(unanswered), TRUE) AS dropped
  FROM m LEFT JOIN u ON u.session_id = m.session_id GROUP BY 1)"""


@registry.add("p6_found", f"{_JUDGED} SELECT session_id FROM j WHERE dropped")
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return judged(table(spark, folder, "session_events")).where("dropped").select("session_id")


@registry.add(
    "p6_conversations",
    f"{_JUDGED} SELECT m.session_id, row_number() OVER (PARTITION BY m.session_id ORDER BY seq) AS message_no, seq, CASE WHEN kind = 'turn_start' THEN 'user' ELSE 'assistant' END AS role, text "
    f"FROM m JOIN j ON j.session_id = m.session_id AND NOT dropped WHERE kind = 'turn_start' OR (kind = 'answer' AND {_SEEN})",
)
def p6_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return conversations(table(spark, folder, "session_events"))


_EVENTS = "SELECT DISTINCT user_id AS channel, ts AS \"at\", coalesce(event_type, '') AS speaker, props AS text FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND regexp_matches(props, '[^\\s]')"
_SESSIONS = f"""WITH r AS ({_EVENTS}), o AS (SELECT *, epoch_us("at") - lag(epoch_us("at")) OVER w AS gap FROM r WINDOW w AS (PARTITION BY channel ORDER BY "at", speaker, text)),
n AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 14400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY "at", speaker, text ROWS UNBOUNDED PRECEDING) AS session_no FROM o),
m AS (SELECT *, row_number() OVER w AS message_no, first_value(speaker) OVER w AS opener, last_value(speaker) OVER (PARTITION BY channel, session_no ORDER BY "at", speaker, text ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS closer
FROM n WINDOW w AS (PARTITION BY channel, session_no ORDER BY "at", speaker, text ROWS UNBOUNDED PRECEDING))
SELECT channel, CAST(session_no AS BIGINT) AS session_no, message_no, "at", CASE WHEN speaker = opener THEN 'user' ELSE 'assistant' END AS role, text FROM m WHERE opener <> closer"""


@registry.add("p6_sessions", _SESSIONS)
def p6_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """The events of each user as messages, cut where four hours pass without one."""
    return sessionized(table(spark, folder, "events"), "user_id", "ts", "event_type", "props", gap=4 * 3600e6)


@registry.add("p6_sessions_calibrated")
def p6_sessions_calibrated(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the gap that the events themselves give."""
    return sessionized(table(spark, folder, "events"), "user_id", "ts", "event_type", "props")


@registry.add("p7_ids")
def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_documents(table(spark, folder, "documents"), "doc_id", "text")


@registry.add("p7_counts")
def p7_counts(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(table(spark, folder, "documents"), "doc_id", "text")


@registry.add("p8_packed")
def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"), "doc_id", "text")


@registry.add("p8_fill")
def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers are, against the least number that could hold all tokens."""
    boxes = p8_packed(spark, folder).groupBy("container").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("pieces"))
    return boxes.agg(
        F.count("*").alias("containers"),
        F.ceil(F.sum("used") / CAPACITY).alias("least"),
        F.sum("used").alias("tokens"),
        F.sum("pieces").alias("pieces"),
        F.max("used").alias("fullest"),
    )


@registry.add("p9_found")
def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return SharedSpans(table(spark, folder, "documents"), "doc_id", "text").pairs()


@registry.add("p9_shared")
def p9_shared(spark: SparkSession, folder: str) -> DataFrame:
    return SharedSpans(table(spark, folder, "documents"), "doc_id", "text").shared()


@registry.add("p9_intervals")
def p9_intervals(spark: SparkSession, folder: str) -> DataFrame:
    return SharedSpans(table(spark, folder, "documents"), "doc_id", "text").intervals()
