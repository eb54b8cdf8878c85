"""Queries of problem 4: messages delivered more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.messages import conflicting_deliveries, deliver_once, repeated_deliveries
from ..sources.tables import table
from .registry import Registry

registry = Registry()



def _object(doc: str, fields: list[str]) -> str:
    """The canonical JSON of an object with these fields, in order; a field that is absent is left out."""
    parts = ", ".join(f"""CASE WHEN json_exists({doc}, '$.{f}') THEN '"{f}":' || {_BODY if f == "transaction" else f"CAST(json_extract({doc}, '$.{f}') AS VARCHAR)"} END""" for f in fields)
    return f"'{{' || concat_ws(',', {parts}) || '}}'"


_BODY = "''"
_BODY = _object("json_extract(doc, '$.transaction')", ["amount", "batch_id", "category", "date", "id", "merchant", "merchant_key", "txn_id"])
_WHOLE = _object("doc", ["account", "event_id", "event_type", "occurred_at", "schema_version", "transaction"])
_DIGITS = "regexp_replace(regexp_replace(lower(trim({x})), '^(urn:)?uuid:|^0x', ''), '[\\s{{}}()\\[\\]:._-]', '', 'g')"


def _identifier(x: str) -> str:
    bare = _DIGITS.format(x=x)
    return f"CASE WHEN regexp_full_match({bare}, '[0-9a-f]{{1,32}}') THEN lpad({bare}, 32, '0') ELSE nullif(trim({x}), '') END"


_VERDICT = f"""WITH d AS (SELECT delivery_id, event_id, ledger_id, payload_hash, CASE WHEN payload IS NULL OR NOT json_valid(payload) THEN NULL WHEN json_type(payload) = 'VARCHAR' THEN CAST(json_extract_string(payload, '$') AS JSON) ELSE CAST(payload AS JSON) END AS doc FROM event_deliveries),
k AS (SELECT delivery_id, coalesce({_identifier("event_id")}, {_identifier("json_extract_string(doc, '$.event_id')")}) AS event, coalesce(lower(payload_hash), sha256({_WHOLE})) AS content,
  coalesce(ledger_id, CAST(json_extract(doc, '$.transaction.id') AS BIGINT)) AS ledger, CASE WHEN doc IS NOT NULL THEN {_BODY} END AS body FROM d),
g AS (SELECT delivery_id, coalesce(event, 'none ' || content) AS event, content, ledger, body FROM k WHERE content IS NOT NULL),
c AS (SELECT event, content, min(delivery_id) AS first, max(body) AS body, max(ledger) AS ledger FROM g GROUP BY 1, 2),
r AS (SELECT DISTINCT {_identifier("event_id")} AS event, lower(payload_hash) AS content FROM processed_finance_events WHERE event_id IS NOT NULL AND payload_hash IS NOT NULL),
n AS (SELECT event, arg_min(content, (first, content)) AS content FROM (SELECT event, content, first FROM c UNION ALL SELECT event, content, -1 FROM r) GROUP BY event),
s AS (SELECT c.*, r.event IS NOT NULL AS receipted FROM c JOIN n ON n.event = c.event LEFT JOIN r ON r.event = c.event AND r.content = c.content WHERE c.content = n.content OR r.event IS NOT NULL),
o AS (SELECT ledger, arg_min(event, (first, event)) AS owner, min(first) AS since, arg_min(coalesce(body, ''), (first, event)) AS body FROM s WHERE ledger IS NOT NULL GROUP BY ledger),
v AS (SELECT s.event, s.content, s.first, s.receipted, coalesce(o.owner <> s.event AND o.since < s.first, FALSE) AS other, coalesce(s.body = nullif(o.body, ''), FALSE) AS same, coalesce(s.body <> nullif(o.body, ''), FALSE) AS differs FROM s LEFT JOIN o ON o.ledger = s.ledger),
w AS (SELECT event, content, first, receipted OR (other AND same) AS all_copies FROM v WHERE receipted OR NOT (other AND differs)),
x AS (SELECT DISTINCT delivery_id FROM g JOIN w ON w.event = g.event AND w.content = g.content WHERE all_copies OR delivery_id > first)"""


@registry.add("p4_found", f"{_VERDICT} SELECT delivery_id FROM x")
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_deliveries(table(spark, folder, "event_deliveries"), table(spark, folder, "processed_finance_events"))


@registry.add("p4_kept", f"{_VERDICT} SELECT delivery_id, event_id, account, ledger_id, received_at FROM event_deliveries WHERE delivery_id NOT IN (SELECT delivery_id FROM x)")
def p4_kept(spark: SparkSession, folder: str) -> DataFrame:
    kept = deliver_once(table(spark, folder, "event_deliveries"), table(spark, folder, "processed_finance_events"))
    return kept.select("delivery_id", "event_id", "account", "ledger_id", "received_at")


@registry.add("p4_conflicts", f"{_VERDICT} SELECT DISTINCT g.delivery_id FROM g LEFT JOIN w ON w.event = g.event AND w.content = g.content WHERE w.event IS NULL")
def p4_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    return conflicting_deliveries(table(spark, folder, "event_deliveries"), table(spark, folder, "processed_finance_events"))
