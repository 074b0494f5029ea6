"""SQL for each registered query, written from the definitions and not from the Spark plans.

The statements run in DuckDB on the given tables. They use plain windows over whole keys,
correlated ranges and recursion where the Spark side slices, pre-aggregates or carries state.
"""

from __future__ import annotations

LABELS = "['GROWING_LAG','STALLED_CONSUMER','SINGLE_PARTITION_STALL','THUNDERING_HERD','CATCHUP_IN_PROGRESS']"
T0 = "TIMESTAMP '2024-01-01'"
TOPIC = "event_type || '-' || (user_id // 64)"

CTES: dict[str, str] = {}
ORACLE: dict[str, str] = {}


def _needs(sql: str, seen: list[str]) -> None:
    import re

    for name, body in CTES.items():
        if name not in seen and re.search(rf"\b{name}\b", sql):
            _needs(body, seen)
            if name not in seen:
                seen.append(name)


def sql(text: str) -> str:
    """A statement with the common table expressions it uses in front."""
    used: list[str] = []
    _needs(text, used)
    ordered = [n for n in CTES if n in used]
    if not ordered:
        return text
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in ordered) + "\n" + text


# ---------------------------------------------------------------- derived tables

CTES["x_span"] = """
SELECT date_trunc('hour', min(ts))::TIMESTAMP AS t0, datediff('hour', date_trunc('hour', min(ts)), max(ts)) AS last FROM events"""
CTES["x_hourly"] = f"""
SELECT {TOPIC} AS topic, (user_id % 8)::INT AS part,
       (epoch_us(ts) - epoch_us((SELECT t0 FROM x_span))) // 3600000000 AS h, sum(1 + floor(value * 200))::BIGINT AS m
FROM events WHERE ts IS NOT NULL GROUP BY ALL"""
CTES["x_grid"] = """
SELECT k.topic, k.part, g.h FROM (SELECT DISTINCT topic, part FROM x_hourly) k, (SELECT unnest(range(last + 1)) AS h FROM x_span) g"""
CTES["x_end"] = """
SELECT g.topic, g.part, g.h,
       sum(coalesce(m, 0)) OVER (PARTITION BY g.topic, g.part ORDER BY g.h)::BIGINT AS le
FROM x_grid g LEFT JOIN x_hourly x ON x.topic = g.topic AND x.part = g.part AND x.h = g.h"""
CTES["x_eff"] = """
SELECT 'g0' AS group_id, *, h AS e FROM x_end
UNION ALL SELECT 'g1', *, greatest(h - 3, 0) FROM x_end
UNION ALL SELECT 'g2', *, CASE WHEN h % 48 >= 36 THEN h - h % 48 + 35 ELSE h END FROM x_end
UNION ALL SELECT 'g3', *, CASE WHEN part = 0 AND h >= 240 THEN 240 ELSE h - 1 END FROM x_end"""
CTES["x_snap"] = """
SELECT s.group_id, s.topic, s.part, coalesce(c.le, 0)::BIGINT AS co, s.le AS le, s.h, s.e,
       (SELECT t0 FROM x_span) + s.e * INTERVAL 1 HOUR AS last_commit_at, (SELECT t0 FROM x_span) + s.h * INTERVAL 1 HOUR AS snapshotted_at
FROM x_eff s LEFT JOIN x_end c ON c.topic = s.topic AND c.part = s.part AND c.h = s.e"""
CTES["x_lag"] = """
SELECT *, greatest(le - co, 0) AS lag, le - co AS lag_raw, (h - e) > 6 AS is_stalled FROM x_snap"""
CTES["x_topic"] = """
SELECT snapshotted_at, h, group_id, topic, sum(lag)::BIGINT AS total_lag, sum(lag_raw)::BIGINT AS total_lag_raw,
       count(*) AS partition_rows, count(*) FILTER (lag > 0) AS lagging_partitions,
       count(*) FILTER (is_stalled) AS stalled_count, max(lag) AS max_lag,
       sum(co)::BIGINT AS committed_total, sum(le)::BIGINT AS log_end_total
FROM x_lag GROUP BY snapshotted_at, h, group_id, topic"""
CTES["x_vel"] = """
SELECT *, CASE WHEN total_lag > 0 AND hist_rows >= 2
               THEN (total_lag - old_raw) / ((h - old_h) * 60.0)::DOUBLE ELSE 0.0::DOUBLE END AS v
FROM (SELECT *, sum(partition_rows) OVER w AS hist_rows, first(total_lag_raw) OVER w AS old_raw,
             first(h) OVER w AS old_h
      FROM x_topic
      WINDOW w AS (PARTITION BY group_id, topic ORDER BY h RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING))"""
CTES["x_class"] = """
SELECT *, CASE
  WHEN total_lag = 0 THEN 'HEALTHY'
  WHEN stalled_count = partition_rows THEN 'STALLED_CONSUMER'
  WHEN stalled_count > 0 THEN 'SINGLE_PARTITION_STALL'
  WHEN max_lag > total_lag::DOUBLE / lagging_partitions * 5 AND lagging_partitions < partition_rows THEN 'SINGLE_PARTITION_STALL'
  WHEN v < -100 THEN 'CATCHUP_IN_PROGRESS'
  WHEN v > 500 THEN 'GROWING_LAG'
  WHEN total_lag > 50000 AND abs(v) < 50 THEN 'THUNDERING_HERD'
  WHEN v > 0 THEN 'GROWING_LAG'
  ELSE 'CATCHUP_IN_PROGRESS' END AS cls
FROM x_vel"""
CTES["x_score"] = """
SELECT *, CASE WHEN total_lag = 0 THEN 0.0::DOUBLE ELSE least(greatest(log10(total_lag::DOUBLE) / 6.0::DOUBLE *
  CASE cls WHEN 'GROWING_LAG' THEN 1.5 WHEN 'STALLED_CONSUMER' THEN 2.0 WHEN 'SINGLE_PARTITION_STALL' THEN 1.8
           WHEN 'THUNDERING_HERD' THEN 1.2 WHEN 'CATCHUP_IN_PROGRESS' THEN 0.5 ELSE 0.0 END::DOUBLE, 0.0), 1.0) END AS score
FROM x_class"""


def label(score: str) -> str:
    return (
        f"CASE WHEN {score} >= 0.7 THEN 'CRITICAL' WHEN {score} >= 0.4 THEN 'HIGH' "
        f"WHEN {score} >= 0.2 THEN 'MEDIUM' ELSE 'LOW' END"
    )


CTES["x_group"] = """
SELECT snapshotted_at, group_id, max(score) AS score, count(*) AS topic_count, sum(total_lag)::BIGINT AS total_lag,
       count(*) FILTER (total_lag > 0) AS lagging_topics
FROM x_score GROUP BY snapshotted_at, group_id"""
CTES["x_worst"] = """
SELECT * FROM (
  SELECT s.*, row_number() OVER (PARTITION BY s.snapshotted_at ORDER BY g.score DESC, s.group_id, s.score DESC, s.topic) AS rn
  FROM x_score s JOIN x_group g ON g.snapshotted_at = s.snapshotted_at AND g.group_id = s.group_id
  WHERE g.score >= 0.4)
WHERE rn = 1"""

CTES["x_meta"] = f"""
SELECT {T0} + s * INTERVAL 24 HOUR AS scan_at, topic, part,
       CASE WHEN gone THEN -1 WHEN s % 4 = 3 THEN ((home + part % 3) % 5)::INT ELSE home END AS leader,
       [home, ((home + 1) % 5)::INT, ((home + 2) % 5)::INT] AS replicas,
       CASE WHEN short THEN [home, ((home + 1) % 5)::INT] ELSE [home, ((home + 1) % 5)::INT, ((home + 2) % 5)::INT] END AS isrs
FROM (SELECT s, CASE c_mktsegment WHEN 'MACHINERY' THEN '__MACHINERY' ELSE c_mktsegment END AS topic,
             c_custkey::INT AS part,
             (CASE WHEN c_custkey % 10 < 6 THEN 0 ELSE c_nationkey % 5 END)::INT AS home,
             c_acctbal < -900 AND (s + length(c_mktsegment)) % 7 >= 3 AS gone,
             c_acctbal < 0 AND (s + length(c_mktsegment)) % 6 >= 2 AS short
      FROM customer, (SELECT unnest(range(30)) AS s))"""
CTES["x_seen"] = """
SELECT *, leader = -1 AS off, leader <> -1 AND len(isrs) < len(replicas) AS short
FROM x_meta WHERE NOT starts_with(topic, '__')"""
CTES["x_health"] = """
SELECT scan_at, count(*) AS total_partitions, count(*) FILTER (off) AS offline, count(*) FILTER (short) AS under_replicated
FROM x_seen GROUP BY scan_at"""
CTES["x_leaders"] = "SELECT scan_at, leader AS broker_id, count(*) AS leader_count FROM x_seen WHERE NOT off GROUP BY ALL"
CTES["x_imbalance"] = """
SELECT h.scan_at, coalesce(max(leader_count) / sum(leader_count), 0)::DOUBLE AS share
FROM x_health h LEFT JOIN x_leaders l ON l.scan_at = h.scan_at GROUP BY h.scan_at"""
CTES["x_brokers"] = f"""
SELECT {T0} + s * INTERVAL 24 HOUR AS scan_at, s_suppkey::INT AS broker_id
FROM supplier, (SELECT unnest(range(30)) AS s) WHERE (s_suppkey + s) % 4 <> 0"""
CTES["x_cycle"] = """
SELECT c.snapshotted_at, c.high_groups, c.max_score, coalesce(h.total_partitions, 0) AS total_partitions,
       coalesce(h.offline, 0) AS offline, coalesce(h.under_replicated, 0) AS under_replicated,
       coalesce(i.share, 0)::DOUBLE AS leader_imbalance
FROM (SELECT snapshotted_at, count(*) FILTER (score >= 0.4) AS high_groups,
             coalesce(max(score) FILTER (score >= 0.4), 0.0)::DOUBLE AS max_score
      FROM x_group GROUP BY snapshotted_at) c
LEFT JOIN x_health h ON h.scan_at = c.snapshotted_at LEFT JOIN x_imbalance i ON i.scan_at = c.snapshotted_at"""
CTES["x_act"] = f"""
SELECT *, CASE WHEN offline > 0 OR under_replicated > 0 THEN 'CRITICAL' ELSE {label('max_score')} END AS severity
FROM x_cycle WHERE high_groups > 0 OR offline > 0 OR under_replicated > 0"""
CTES["x_high"] = """
SELECT s.*, g.score AS group_score FROM x_score s JOIN x_group g
  ON g.snapshotted_at = s.snapshotted_at AND g.group_id = s.group_id AND g.score >= 0.4
WHERE s.total_lag > 0 AND s.snapshotted_at IN (SELECT snapshotted_at FROM x_act)"""
CTES["x_hits"] = """
SELECT group_id, cls, topic, h, min(h) OVER (PARTITION BY group_id, cls, topic) AS h0 FROM x_worst"""

CTES["x_rates"] = """
SELECT snapshotted_at, topic, part, CASE WHEN le < pe THEN le ELSE le - pe END AS inc
FROM (SELECT *, lag(le) OVER (PARTITION BY topic, part ORDER BY h) AS pe FROM x_snap WHERE group_id = 'g0')
WHERE pe IS NOT NULL"""
CTES["x_share"] = """
SELECT *, sum(inc) OVER w AS tot, count(*) OVER w AS n FROM x_rates WINDOW w AS (PARTITION BY snapshotted_at, topic)"""
CTES["x_hot"] = """
SELECT *, inc * n / tot::DOUBLE AS skew FROM x_share WHERE n >= 2 AND tot > 0 AND inc * n / tot::DOUBLE > 3"""

CTES["x_conf"] = """
SELECT snapshot_at, (3 + month(snapshot_at) % 2)::BIGINT AS broker_count, 'topic-' || t AS topic, n AS pc, (1 + n % 3)::INT AS rf
FROM (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS snapshot_at, o_custkey // 50 AS t, count(*) AS n FROM orders GROUP BY ALL)"""
CTES["x_pair"] = """
SELECT *, lag(snapshot_at) OVER (ORDER BY snapshot_at) AS prev_at, lag(broker_count) OVER (ORDER BY snapshot_at) AS prev_brokers
FROM (SELECT snapshot_at, max(broker_count) AS broker_count, count(*) AS topic_count FROM x_conf GROUP BY snapshot_at)"""
CTES["x_delta"] = """
SELECT * FROM (
  SELECT coalesce(a.snapshot_at, b.snapshot_at) AS snapshot_at, coalesce(a.topic, b.topic) AS topic,
         CASE WHEN b.topic IS NULL THEN 'NEW' WHEN a.topic IS NULL THEN 'REMOVED'
              WHEN a.pc <> b.pc OR a.rf <> b.rf THEN 'CHANGED' END AS change,
         b.pc AS pb, a.pc AS pa, b.rf AS rb, a.rf AS ra
  FROM (SELECT c.* FROM x_conf c JOIN x_pair p ON p.snapshot_at = c.snapshot_at WHERE p.prev_at IS NOT NULL) a
  FULL OUTER JOIN (SELECT p.snapshot_at, c.topic, c.pc, c.rf FROM x_pair p JOIN x_conf c ON c.snapshot_at = p.prev_at) b
  ON a.snapshot_at = b.snapshot_at AND a.topic = b.topic)
WHERE change IS NOT NULL"""
CTES["x_summary"] = """
SELECT p.snapshot_at, p.broker_count, p.topic_count,
       CASE WHEN j = '' THEN NULL ELSE '{' || j || '}' END AS change_delta
FROM (SELECT p.*, concat_ws(',',
        CASE WHEN prev_brokers <> broker_count THEN '"broker_count":{"before":' || prev_brokers || ',"after":' || broker_count || '}' END,
        '"changed_topics":[' || d.chg || ']', '"new_topics":[' || d.new || ']', '"removed_topics":[' || d.rem || ']') AS j
      FROM x_pair p LEFT JOIN (
        SELECT snapshot_at,
          string_agg('{"topic":"' || topic || '","before":{"name":"' || topic || '","partition_count":' || pb || ',"replication_factor":' || rb ||
                     '},"after":{"name":"' || topic || '","partition_count":' || pa || ',"replication_factor":' || ra || '}}', ',' ORDER BY topic)
            FILTER (change = 'CHANGED') AS chg,
          string_agg('"' || topic || '"', ',' ORDER BY topic) FILTER (change = 'NEW') AS new,
          string_agg('"' || topic || '"', ',' ORDER BY topic) FILTER (change = 'REMOVED') AS rem
        FROM x_delta GROUP BY snapshot_at) d ON d.snapshot_at = p.snapshot_at) p"""

CTES["x_analyses"] = """
SELECT o_orderkey::VARCHAR AS analysis_id,
       CASE o_orderstatus WHEN 'F' THEN 'THRESHOLD_BREACH' WHEN 'P' THEN 'ANOMALY_DETECTED' ELSE 'SCHEDULED_POLL' END AS triggered_by,
       o_orderdate::TIMESTAMP AS analyzed_at,
       CASE o_orderpriority[1] WHEN '1' THEN 'CRITICAL' WHEN '2' THEN 'HIGH' WHEN '3' THEN 'MEDIUM' ELSE 'LOW' END AS severity,
       least(floor(o_totalprice) / 500000, 1.0)::DOUBLE AS overall_confidence, 'customer ' || o_custkey AS llm_root_cause_summary
FROM orders"""
CTES["x_recs"] = """
SELECT l_orderkey::VARCHAR AS analysis_id, l_linenumber AS ordinal,
       concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS recommendation_id,
       (['CONSUMER_RESTART','CONSUMER_SCALE_OUT','PARTITION_REBALANCE','TOPIC_PARTITION_INCREASE','BROKER_SCALE','MESSAGE_SKIP',
         'CONFIG_CHANGE','PREFERRED_REPLICA_ELECTION','BROKER_HEALTH_CHECK'])[l_partkey % 9 + 1] AS recommendation_type,
       (['IMMEDIATE','WITHIN_15MIN','WITHIN_1HOUR','ADVISORY'])[l_linenumber % 4 + 1] AS priority,
       'part ' || l_partkey AS rationale, (['LOW','MEDIUM','HIGH','CRITICAL'])[l_suppkey % 4 + 1] AS risk_level,
       (['RUNBOOK','HISTORICAL_INCIDENT','HEURISTIC_ONLY'])[(l_linenumber + 1) % 3 + 1] AS grounding,
       'g' || (l_suppkey % 4) AS consumer_group, 'topic-' || l_partkey AS topic,
       (l_linenumber * 5)::INT AS estimated_resolution_minutes, l_returnflag = 'R' AS applied
FROM lineitem"""

CTES["x_msg0"] = """
SELECT event_id, user_id, value, ts,
  CASE event_type WHEN 'purchase' THEN 'orders' WHEN 'error' THEN 'payments' WHEN 'signup' THEN 'inventory'
                  WHEN 'view' THEN 'user-events' ELSE 'notifications' END AS topic,
  round(value * 100)::BIGINT AS cents
FROM events"""
CTES["x_msg1"] = """
SELECT *, '{"event_id": "' || event_id || '", "timestamp": "' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '", "source": "' || topic || '"' AS head,
  (cents // 100) || '.' || lpad((cents % 100)::VARCHAR, 2, '0') AS amount
FROM x_msg0"""
CTES["x_msg2"] = """
SELECT *, CASE topic
  WHEN 'orders' THEN ', "order_id": "ORD-' || event_id || '", "customer_id": "CUST-' || user_id || '", "status": "PLACED", "total_amount": ' || amount || ', "items": ' || (1 + event_id % 8) || '}'
  WHEN 'payments' THEN ', "payment_id": "PAY-' || event_id || '", "currency": "USD", "method": "card", "status": "FAILED", "amount": ' || amount || '}'
  WHEN 'inventory' THEN ', "product_id": "PROD-' || user_id || '", "warehouse": "EU-CENTRAL", "quantity_delta": ' || (event_id % 61 - 10) || '}'
  WHEN 'user-events' THEN ', "user_id": "USR-' || user_id || '", "action": "login", "session_id": "S-' || event_id || '"}'
  ELSE ', "notification_id": "N-' || event_id || '", "type": "SHIPPING_UPDATE", "channel": "push"}' END AS body
FROM x_msg1"""
CTES["x_msg"] = """
SELECT topic, (user_id % 8)::INT AS part, event_id AS off, 'USR-' || user_id AS key, ts,
  CASE WHEN event_id % 211 = 5 THEN NULL WHEN event_id % 97 = 0 THEN substring(head || body, 1, 60)
       WHEN event_id % 307 = 7 THEN head || ', "pad": "' || repeat('x', 2000) || '"' || body ELSE head || body END AS value
FROM x_msg2"""

CTES["x_inc"] = f"""
SELECT vec_id AS id, 'INC-' || (vec_id // 3) AS incident_id, ({LABELS})[label % 5 + 1] AS cls, 'g' || (vec_id % 4) AS consumer_group,
       'topic-' || label AS topic, (5 + vec_id % 50)::INT AS minutes, 'summary ' || vec_id AS summary, embedding::DOUBLE[] AS e
FROM embeddings"""
CTES["x_rb"] = f"""
SELECT vec_id AS id, 'RB-' || (vec_id // 4) AS runbook_id, 'Runbook ' || (vec_id // 4) AS title, 'section ' || (vec_id % 4) AS section,
       'text ' || vec_id AS content, [({LABELS})[label % 5 + 1], ({LABELS})[(label + vec_id % 2) % 5 + 1]] AS tags, embedding::DOUBLE[] AS e
FROM embeddings"""
_ENTRIES = "SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings"
CTES["x_query"] = f"""
SELECT 'Q-' || label || '-' || kind AS query_id, ({LABELS})[label % 5 + 1] AS cls, list(m ORDER BY pos) AS e
FROM (SELECT label, vec_id % 3 AS kind, pos, avg(x) AS m FROM ({_ENTRIES}) GROUP BY ALL) GROUP BY label, kind"""
CTES["x_cquery"] = f"""
SELECT ({LABELS})[k + 1] AS query_id, ({LABELS})[k + 1] AS cls, list(m ORDER BY pos) AS e
FROM (SELECT label % 5 AS k, pos, avg(x) AS m FROM ({_ENTRIES}) GROUP BY ALL) GROUP BY k"""
COS = "list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)))"


def _top(queries: str, corpus: str, k: int, extra: str = "TRUE") -> str:
    return f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS pos
  FROM (SELECT a.query_id, b.* EXCLUDE (e), {COS} AS score FROM {queries} a, {corpus} b WHERE {extra})
  WHERE score >= 0.1) WHERE pos <= {k}"""


def _incidents(hits: str) -> str:
    return f"""
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, incident_id ORDER BY round(score, 9) DESC, id) AS rn FROM {hits})
WHERE rn = 1 QUALIFY rank <= 5"""


CTES["x_top"] = _top("x_query", "x_inc", 20)
CTES["x_similar"] = _incidents("x_top")
CTES["x_rbtop"] = _top("x_query", "x_rb", 3, "list_contains(b.tags, a.cls)")
CTES["x_ctop"] = _top("x_cquery", "x_inc", 20)
CTES["x_csimilar"] = _incidents("x_ctop")
CTES["x_crbtop"] = _top("x_cquery", "x_rb", 3, "list_contains(b.tags, a.cls)")

CTES["x_incident"] = f"""
SELECT 'INC-' || conv_id || '-' || turn AS incident_id, 'g' || (conv_id % 4) AS consumer_group, 'topic-' || (conv_id % 10) AS topic,
  ({LABELS})[(conv_id + turn) % 5 + 1] AS cls, CASE WHEN turn % 2 = 0 THEN 'HIGH' ELSE 'CRITICAL' END AS severity,
  CASE WHEN turn % 3 = 0 THEN 'CONSUMER_RESTART' ELSE 'CONSUMER_SCALE_OUT' END AS resolution_type, text AS notes,
  CASE WHEN (conv_id + turn) % 5 = 0 THEN ' ' ELSE text END AS symptoms, 'summary of ' || conv_id AS summary,
  (3 + (conv_id * 7 + turn) % 120)::INT AS minutes, '{{"turn": ' || turn || '}}' AS state
FROM conversations"""
CTES["x_doc"] = """
SELECT 'doc-' || doc_id AS runbook_id, text, string_split(text, chr(10)) AS parts,
       ltrim(trim(string_split(text, chr(10))[1], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '# ') AS title
FROM documents"""

CTES["x_out0"] = """
SELECT concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS analysis_id, l_partkey AS p, l_linenumber AS n FROM lineitem"""
CTES["x_out"] = """
SELECT analysis_id, p, n, 0::INT AS item_no, CASE WHEN p % 11 = 0 THEN 'REBOOT_EVERYTHING' ELSE 'CONSUMER_RESTART' END AS recommendation_type,
  CASE WHEN p % 13 = 0 THEN 'SOON' ELSE 'IMMEDIATE' END AS priority, 'part ' || p AS rationale, 'LOW' AS risk_level, 'RUNBOOK' AS grounding,
  't' || (p % 7) AS topic, n::INT AS estimated_resolution_minutes FROM x_out0 WHERE p % 17 <> 0
UNION ALL
SELECT analysis_id, p, n, 1::INT, 'CONFIG_CHANGE', 'ADVISORY', 'defaults only', 'MEDIUM', 'HEURISTIC_ONLY', NULL, 15::INT
FROM x_out0 WHERE p % 17 <> 0 AND n % 2 = 0"""

CTES["x_topicrec"] = """
SELECT snapshotted_at, 1 AS stage, CASE cls WHEN 'STALLED_CONSUMER' THEN 'CONSUMER_RESTART' ELSE 'CONSUMER_SCALE_OUT' END AS recommendation_type,
  CASE cls WHEN 'STALLED_CONSUMER' THEN 'IMMEDIATE' ELSE 'WITHIN_15MIN' END AS priority,
  CASE cls WHEN 'STALLED_CONSUMER' THEN 'Consumer group ' || group_id || ' has stalled on ' || topic || '.'
       ELSE 'Growing lag on ' || topic || '; increase consumer instances.' END AS rationale,
  CASE cls WHEN 'STALLED_CONSUMER' THEN 'LOW' ELSE 'MEDIUM' END AS risk_level, 'HEURISTIC_ONLY' AS grounding,
  group_id AS consumer_group, topic, CASE cls WHEN 'STALLED_CONSUMER' THEN 5 ELSE 15 END::INT AS estimated_resolution_minutes
FROM {source} WHERE cls IN ('STALLED_CONSUMER', 'GROWING_LAG')"""
_TOPIC_REC = CTES.pop("x_topicrec")
_CLUSTER_REC = """
SELECT {ts} AS snapshotted_at, 0 AS stage, 'BROKER_HEALTH_CHECK' AS recommendation_type, 'IMMEDIATE' AS priority,
  under_replicated || ' under-replicated partitions; check broker disk/network.' AS rationale, 'CRITICAL' AS risk_level,
  'HEURISTIC_ONLY' AS grounding, NULL::VARCHAR AS consumer_group, NULL::VARCHAR AS topic, 30::INT AS estimated_resolution_minutes
FROM {source} WHERE under_replicated > 0
UNION ALL
SELECT {ts}, 2, 'PREFERRED_REPLICA_ELECTION', 'WITHIN_1HOUR', 'Leader imbalance exceeds 40%; trigger preferred replica election.', 'LOW',
  'HEURISTIC_ONLY', NULL, NULL, 5::INT
FROM {source} WHERE leader_imbalance > 0.4"""
CTES["x_trec_high"] = _TOPIC_REC.format(source="x_high")
CTES["x_crec_act"] = _CLUSTER_REC.format(ts="snapshotted_at", source="x_act")
CTES["x_rank"] = """
SELECT snapshotted_at,
  row_number() OVER (PARTITION BY snapshotted_at ORDER BY stage, coalesce(consumer_group, ''), coalesce(topic, '')) AS ordinal,
  row_number() OVER (PARTITION BY snapshotted_at ORDER BY
    CASE priority WHEN 'IMMEDIATE' THEN 0 WHEN 'WITHIN_15MIN' THEN 1 WHEN 'WITHIN_1HOUR' THEN 2 ELSE 3 END,
    stage, coalesce(consumer_group, ''), coalesce(topic, '')) AS position,
  recommendation_type, priority, rationale, risk_level, grounding, consumer_group, topic, estimated_resolution_minutes
FROM (SELECT * FROM x_trec_high UNION ALL SELECT * FROM x_crec_act)"""
CTES["x_scan"] = """
SELECT h.*, i.share AS leader_imbalance FROM x_health h JOIN x_imbalance i ON i.scan_at = h.scan_at"""

# De-duplication by recursion: from each hit that passes to the first one at least 6 hours on.
CTES["x_pass0"] = "SELECT group_id, cls, topic, min(h) AS h FROM x_worst GROUP BY ALL"


def with_recursive(text: str) -> str:
    """A statement that may use ``x_pass``, the hits that pass de-duplication."""
    base = sql("SELECT * FROM x_pass0, x_worst " + text)
    head = base[: base.rindex("\nSELECT * FROM x_pass0, x_worst ")]
    step = """x_pass AS (
SELECT group_id, cls, topic, h FROM x_pass0
UNION
SELECT p.group_id, p.cls, p.topic, (SELECT min(w.h) FROM x_worst w
   WHERE w.group_id = p.group_id AND w.cls = p.cls AND w.topic = p.topic AND w.h >= p.h + 6)
FROM x_pass p WHERE EXISTS (SELECT 1 FROM x_worst w
   WHERE w.group_id = p.group_id AND w.cls = p.cls AND w.topic = p.topic AND w.h >= p.h + 6))"""
    return head.replace("WITH ", "WITH RECURSIVE ", 1) + ",\n" + step + "\n" + text


UUID_OF = (
    "(SELECT concat_ws('-', m[1:8], m[9:12], m[13:16], m[17:20], m[21:32]) "
    "FROM (SELECT md5('SCHEDULED_POLL:' || epoch_us({ts})) AS m))"
)
ISO = "CASE WHEN epoch_us({0}) % 1000000 = 0 THEN strftime({0}, '%Y-%m-%dT%H:%M:%S') ELSE strftime({0}, '%Y-%m-%dT%H:%M:%S.%f') END"

# ---------------------------------------------------------------- statements

_plain: dict[str, str] = {}

_plain["offset_snapshots"] = """
SELECT group_id, topic, part AS "partition", co AS committed_offset, le AS log_end_offset, last_commit_at, snapshotted_at FROM x_snap"""
_plain["partition_metadata"] = """
SELECT scan_at, topic, part AS "partition", leader, array_to_string(replicas, ',') AS replicas, array_to_string(isrs, ',') AS isrs FROM x_meta"""
_plain["recent_lag_history"] = """
SELECT group_id, topic, part AS "partition", lag_raw AS lag, snapshotted_at FROM x_lag
WHERE snapshotted_at > (SELECT max(snapshotted_at) FROM x_lag) - INTERVAL 24 HOUR"""
_plain["analysis_insert_ignore"] = "SELECT * FROM x_analyses WHERE triggered_by <> 'THRESHOLD_BREACH'"
_plain["audit_rows"] = """
SELECT 'LAG_ANALYSIS_COMPLETED' AS event_type, NULL::VARCHAR AS consumer_group, NULL::VARCHAR AS topic,
  '{"analysis_id":"' || a.analysis_id || '","severity":"' || severity || '","recommendation_count":' || coalesce(n, 0) ||
  ',"confidence":' || overall_confidence || '}' AS payload, analyzed_at AS logged_at
FROM x_analyses a LEFT JOIN (SELECT analysis_id, count(*) AS n FROM x_recs GROUP BY 1) r ON r.analysis_id = a.analysis_id"""
_plain["publish_routes"] = """
SELECT unnest(CASE WHEN r.l IS NULL THEN ['kafka.ops.analysis.completed'] ELSE ['kafka.ops.analysis.completed', 'kafka.ops.scaling.recommended'] END) AS topic,
  a.analysis_id AS key,
  '{"analysis_id":"' || a.analysis_id || '","severity":"' || severity || '","recommendations":[' || coalesce(r.l, '') || ']}' AS value
FROM x_analyses a LEFT JOIN (SELECT analysis_id, string_agg('"' || recommendation_id || '"', ',' ORDER BY recommendation_id) AS l FROM x_recs GROUP BY 1) r
ON r.analysis_id = a.analysis_id"""
_plain["json_dead_letter"] = """
SELECT topic, part AS "partition", off AS "offset", key, value, CASE WHEN value IS NULL THEN 'missing value' ELSE 'malformed JSON' END AS error
FROM x_msg WHERE value IS NULL OR NOT json_valid(value)"""
_plain["business_events"] = """
SELECT topic, part AS "partition", off AS "offset", json_extract_string(value, '$.event_id') AS event_id,
  json_extract_string(value, '$.timestamp') AS event_time, json_extract_string(value, '$.source') AS source
FROM (SELECT * FROM x_msg WHERE value IS NOT NULL AND json_valid(value))"""
_FIELDS = {
    "orders": [("order_id", "VARCHAR"), ("customer_id", "VARCHAR"), ("status", "VARCHAR"), ("total_amount", "DOUBLE"), ("items", "INT")],
    "payments": [("payment_id", "VARCHAR"), ("currency", "VARCHAR"), ("method", "VARCHAR"), ("status", "VARCHAR"), ("amount", "DOUBLE")],
    "inventory": [("product_id", "VARCHAR"), ("warehouse", "VARCHAR"), ("quantity_delta", "INT")],
    "user-events": [("user_id", "VARCHAR"), ("action", "VARCHAR"), ("session_id", "VARCHAR")],
    "notifications": [("notification_id", "VARCHAR"), ("type", "VARCHAR"), ("channel", "VARCHAR")],
}
for _t, _f in _FIELDS.items():
    _cols = ", ".join(f"json_extract_string(value, '$.{n}')::{k} AS \"{n}\"" for n, k in _f)
    _plain["business_events_" + _t.replace("-", "_")] = f"""
SELECT part AS "partition", off AS "offset", key, json_extract_string(value, '$.event_id') AS event_id,
  json_extract_string(value, '$.timestamp') AS event_time, json_extract_string(value, '$.source') AS source, {_cols}
FROM (SELECT * FROM x_msg WHERE topic = '{_t}' AND value IS NOT NULL AND json_valid(value))"""
_plain["vector_upsert"] = """
SELECT id, label, version FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC, fresh DESC) AS rn FROM (
  SELECT vec_id AS id, label, vec_id % 3 AS version, 0 AS fresh FROM embeddings
  UNION ALL SELECT vec_id * 2, label + 100, 1, 1 FROM embeddings)) WHERE rn = 1"""

_plain["active_groups"] = """
SELECT * FROM (SELECT s_name AS group_id, (['Stable', 'Empty', 'Dead', 'PreparingRebalance'])[s_nationkey % 4 + 1] AS state FROM supplier)
WHERE state <> 'Dead'"""
_plain["lag_by_partition"] = """
SELECT group_id, topic, part AS "partition", co AS committed_offset, le AS log_end_offset, lag, lag_raw, last_commit_at, is_stalled, snapshotted_at FROM x_lag"""
_plain["topics_with_lag"] = "SELECT snapshotted_at, group_id, topic, max(lag) AS max_lag FROM x_lag GROUP BY ALL HAVING max(lag) > 0"
_GROUP_COLS = "snapshotted_at, group_id, round(score, 6) AS severity_score, topic_count, total_lag, lagging_topics"
_plain["high_severity_groups"] = f"SELECT {_GROUP_COLS} FROM x_group WHERE score >= 0.4"
_CYCLE_COLS = """snapshotted_at, high_groups, round(max_score, 6) AS max_score, total_partitions, offline, under_replicated,
  round(leader_imbalance, 6) AS leader_imbalance"""
_plain["actionable_cycles"] = f"SELECT {_CYCLE_COLS} FROM x_act"
_plain["severity_label"] = f"SELECT snapshotted_at, group_id, {label('score')} AS severity, count(*) AS topics FROM x_score GROUP BY ALL"
_plain["cycle_severity"] = f"""
SELECT snapshotted_at, round(max_score, 6) AS max_score,
  CASE WHEN offline > 0 OR under_replicated > 0 THEN 'CRITICAL' ELSE {label('max_score')} END AS severity FROM x_cycle"""
_plain["stalled_partitions"] = """
SELECT snapshotted_at, group_id, topic, part AS "partition", co AS committed_offset, lag, last_commit_at FROM x_lag WHERE is_stalled"""

_plain["topic_total_lag"] = """
SELECT snapshotted_at, group_id, topic, total_lag, total_lag_raw, partition_rows, lagging_partitions, stalled_count, max_lag,
  committed_total, log_end_total FROM x_topic"""
_plain["lag_velocity"] = "SELECT snapshotted_at, group_id, topic, total_lag, round(v, 6) AS lag_velocity_per_min FROM x_vel"
_plain["lag_classification"] = """
SELECT group_id, topic, cls AS lag_classification, count(*) AS snapshots, sum(total_lag)::BIGINT AS lag_sum FROM x_class GROUP BY ALL"""
_plain["lag_severity"] = f"""
SELECT snapshotted_at, group_id, topic, total_lag, round(v, 6) AS lag_velocity_per_min, cls AS lag_classification,
  round(score, 6) AS severity_score, {label('score')} AS severity FROM x_score"""
_PROBLEM = """
SELECT snapshotted_at, group_id, topic, part, lag, avg_lag FROM (
  SELECT *, sum(lag) OVER w / (count(*) OVER w)::DOUBLE AS avg_lag FROM x_lag WINDOW w AS (PARTITION BY snapshotted_at, group_id, topic))
WHERE lag > avg_lag * 3"""
CTES["x_problem"] = _PROBLEM
_plain["problematic_partitions"] = """
SELECT snapshotted_at, group_id, topic, part AS "partition", lag, round(avg_lag, 6) AS average_lag FROM x_problem"""
_plain["topic_details"] = """
SELECT s.snapshotted_at, s.group_id, s.topic, s.cls AS lag_classification, s.partition_rows::INT AS partition_entries,
  s.total_lag AS partition_lag, coalesce(p.l, '') AS problematic
FROM x_score s LEFT JOIN (SELECT snapshotted_at, group_id, topic, string_agg(part::VARCHAR, ',' ORDER BY part) AS l FROM x_problem GROUP BY ALL) p
ON p.snapshotted_at = s.snapshotted_at AND p.group_id = s.group_id AND p.topic = s.topic"""
_plain["group_severity"] = f"SELECT {_GROUP_COLS} FROM x_group"
_plain["worst_group_topic"] = """
SELECT snapshotted_at, group_id, topic, cls AS lag_classification, total_lag, round(v, 6) AS lag_velocity_per_min, round(score, 6) AS severity_score FROM x_worst"""
_plain["groups_monitored"] = "SELECT snapshotted_at, count(DISTINCT group_id) AS groups_monitored FROM x_snap GROUP BY 1"
_plain["last_commit_at"] = """
SELECT group_id, topic, part AS "partition", snapshotted_at,
  max(CASE WHEN co <> pc THEN snapshotted_at END) OVER (PARTITION BY group_id, topic, part ORDER BY h) AS last_commit_at
FROM (SELECT *, lag(co) OVER (PARTITION BY group_id, topic, part ORDER BY h) AS pc FROM x_snap)"""
_plain["lag_acceleration"] = """
SELECT snapshotted_at, group_id, topic, round(v, 6) AS lag_velocity_per_min, round(pv, 6) AS previous_velocity, round(v - pv, 6) AS acceleration,
  CASE WHEN pv IS NULL THEN 'UNKNOWN' WHEN v <= 0 THEN 'NOT_GROWING' WHEN v >= pv THEN 'ACCELERATING' ELSE 'DECELERATING' END AS trend
FROM (SELECT *, lag(v) OVER (PARTITION BY group_id, topic ORDER BY h) AS pv FROM x_vel)"""
_plain["lag_trend"] = """
SELECT snapshotted_at, group_id, topic, total_lag, round(s, 6) AS lag_slope_per_min, n AS trend_points, round(ps, 6) AS previous_slope,
  round(s - ps, 6) AS slope_change
FROM (SELECT *, lag(s) OVER (PARTITION BY group_id, topic ORDER BY h) AS ps FROM (
  SELECT *, CASE WHEN count(*) OVER w >= 2 THEN regr_slope(total_lag, h * 60.0) OVER w END AS s, count(*) OVER w AS n FROM x_topic
  WINDOW w AS (PARTITION BY group_id, topic ORDER BY h RANGE BETWEEN 6 PRECEDING AND CURRENT ROW)))"""
_plain["simultaneous_lag"] = """
SELECT snapshotted_at, count(DISTINCT group_id) AS rising_groups, count(DISTINCT topic) AS rising_topics, sum(total_lag)::BIGINT AS rising_lag
FROM x_vel WHERE v > 0 GROUP BY 1 HAVING count(DISTINCT group_id) >= 2 AND count(DISTINCT topic) >= 2"""
_plain["catch_up_minutes"] = """
SELECT snapshotted_at, group_id, topic, total_lag, round(c, 6) AS consume_rate, round(p, 6) AS produce_rate,
  round(CASE WHEN c - p > 0 THEN total_lag / (c - p) END, 6) AS catch_up_minutes
FROM (SELECT *, (committed_total - lag(committed_total) OVER w) / 60.0::DOUBLE AS c, (log_end_total - lag(log_end_total) OVER w) / 60.0::DOUBLE AS p
      FROM x_topic WINDOW w AS (PARTITION BY group_id, topic ORDER BY h)) WHERE c IS NOT NULL"""


def _alert(source: str, condition: str, labels: str, t: str) -> str:
    part = f"PARTITION BY {labels} " if labels else ""
    return f"""
SELECT *, CASE WHEN active THEN min({t}) OVER ({part + ', ' if part else 'PARTITION BY '}island) END AS since FROM (
  SELECT *, sum(CASE WHEN active AND coalesce(was, FALSE) THEN 0 ELSE 1 END) OVER ({part}ORDER BY {t}) AS island
  FROM (SELECT *, lag(active) OVER ({part}ORDER BY {t}) AS was FROM (SELECT *, {condition} AS active FROM {source})))"""


CTES["x_escal"] = _alert("x_vel", "total_lag > 50000 AND v > 0", "group_id, topic", "snapshotted_at")
_plain["lag_escalations"] = """
SELECT snapshotted_at, group_id, topic, total_lag, round(v, 6) AS lag_velocity_per_min, since AS active_since
FROM x_escal WHERE active AND snapshotted_at - since >= INTERVAL 4 HOUR"""
_plain["partition_increase_plan"] = f"""
SELECT topic, n AS partition_count, c AS consumers, k AS key_count, greatest(n - c, 0) AS consumers_to_add, w AS new_partition_count,
  c >= n AND k > w AS increase_advised
FROM (SELECT *, (ceil(n * 2 / 3) * 3)::BIGINT AS w FROM (
  SELECT {TOPIC} AS topic, count(DISTINCT user_id % 8) AS n, max(user_id) % 11 AS c, count(DISTINCT user_id) AS k FROM events GROUP BY 1))"""
_plain["reset_impact"] = """
SELECT s.group_id, s.topic, s.part AS "partition", t.target_at, s.co AS committed_offset, e.le AS target_offset, e.le - s.co AS skipped_offsets
FROM (SELECT * FROM x_snap QUALIFY row_number() OVER (PARTITION BY group_id, topic, part ORDER BY h DESC) = 1) s
JOIN (SELECT group_id, max(snapshotted_at) - INTERVAL 100 HOUR AS target_at FROM x_snap GROUP BY 1
      UNION ALL SELECT DISTINCT group_id, NULL FROM x_snap) t ON t.group_id = s.group_id
JOIN x_snap e ON e.group_id = s.group_id AND e.topic = s.topic AND e.part = s.part AND e.snapshotted_at = coalesce(t.target_at, s.snapshotted_at)"""

_plain["partition_health"] = "SELECT * FROM x_health"
_plain["broker_leader_counts"] = "SELECT * FROM x_leaders"
_plain["leader_imbalance"] = "SELECT scan_at, round(share, 6) AS leader_imbalance, share > 0.4 AS is_imbalanced FROM x_imbalance"
_plain["health_summary"] = """
SELECT h.*, round(i.share, 6) AS leader_imbalance, l.m AS broker_partition_counts FROM x_health h JOIN x_imbalance i ON i.scan_at = h.scan_at
LEFT JOIN (SELECT scan_at, string_agg(broker_id || ':' || leader_count, ',' ORDER BY broker_id) AS m FROM x_leaders GROUP BY 1) l ON l.scan_at = h.scan_at"""
_plain["cycle_health"] = f"SELECT {_CYCLE_COLS} FROM x_cycle"
_plain["partition_hotspots"] = """
SELECT snapshotted_at, topic, part AS "partition", round(inc / 60.0::DOUBLE, 6) AS message_rate, round(skew, 6) AS skew_factor FROM x_hot"""
_plain["hotspot_cleared"] = """
SELECT h.topic, h.part AS "partition", h.last_hot_at, n.snapshotted_at AS checked_at, n.inc * n.n <= n.tot * 2 AS is_cleared
FROM (SELECT topic, part, max(snapshotted_at) AS last_hot_at FROM x_hot GROUP BY ALL) h
JOIN (SELECT * FROM x_share QUALIFY row_number() OVER (PARTITION BY topic, part ORDER BY snapshotted_at DESC) = 1) n
ON n.topic = h.topic AND n.part = h.part"""
_plain["hot_keys"] = f"""
SELECT topic, part AS "partition", key, messages, pos::INT AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY topic, part ORDER BY messages DESC, key) AS pos FROM (
    SELECT {TOPIC} AS topic, (user_id % 8)::INT AS part, user_id AS key, count(*) AS messages FROM events GROUP BY ALL) c
  WHERE EXISTS (SELECT 1 FROM x_hot h WHERE h.topic = c.topic AND h.part = c.part)) WHERE pos <= 10"""
_plain["lagging_brokers"] = """
SELECT scan_at, b AS broker_id, count(*) AS out_of_sync_partitions
FROM (SELECT scan_at, isrs, unnest(replicas) AS b FROM x_seen) WHERE NOT list_contains(isrs, b) GROUP BY ALL"""
_plain["leader_fair_share"] = """
SELECT b.scan_at, b.broker_id, coalesce(l.leader_count, 0) AS leader_count, round(t.fair, 6) AS fair_share,
  coalesce(l.leader_count, 0) > t.fair * 1.1::DOUBLE AS above_fair_share, coalesce(l.leader_count / t.leaders > 0.4::DOUBLE, FALSE) AS above_imbalance_share
FROM (SELECT DISTINCT scan_at, broker_id FROM (SELECT scan_at, unnest(replicas) AS broker_id FROM x_seen UNION ALL SELECT scan_at, leader FROM x_seen) WHERE broker_id >= 0) b
LEFT JOIN x_leaders l ON l.scan_at = b.scan_at AND l.broker_id = b.broker_id
JOIN (SELECT scan_at, count(*) FILTER (NOT off) AS leaders, count(*) FILTER (NOT off)::DOUBLE /
        (SELECT count(DISTINCT x) FROM (SELECT unnest(replicas) AS x FROM x_seen r WHERE r.scan_at = s.scan_at UNION ALL
                                         SELECT leader FROM x_seen r WHERE r.scan_at = s.scan_at AND NOT off)) AS fair
      FROM x_seen s GROUP BY scan_at) t ON t.scan_at = b.scan_at"""
_plain["non_preferred_leaders"] = """
SELECT scan_at, topic, part AS "partition", leader, replicas[1] AS preferred_leader FROM x_seen WHERE NOT off AND leader <> replicas[1]"""

_plain["config_snapshot"] = """
SELECT m.scan_at AS snapshot_at, b.n AS broker_count, m.topic, count(*) AS partition_count, 3::INT AS replication_factor
FROM x_seen m JOIN (SELECT scan_at, count(DISTINCT broker_id) AS n FROM x_brokers GROUP BY 1) b ON b.scan_at = m.scan_at GROUP BY ALL"""
_plain["config_delta_topics"] = """
SELECT snapshot_at, topic, change, pb AS partition_count_before, pa AS partition_count_after, rb AS replication_factor_before, ra AS replication_factor_after FROM x_delta"""
_plain["config_delta_brokers"] = """
SELECT snapshot_at, prev_brokers AS brokers_before, broker_count AS brokers_after FROM x_pair WHERE prev_brokers <> broker_count"""
_plain["config_delta_summary"] = "SELECT snapshot_at, broker_count, topic_count, change_delta IS NOT NULL AS has_delta, change_delta FROM x_summary"
_plain["config_snapshot_ids"] = """
SELECT snapshot_at, count(*) AS topics, (('0x' || md5(strftime(snapshot_at, '%Y-%m-%dT%H:%M:%S'))[1:16])::UBIGINT % 9223372036854775808::UBIGINT)::BIGINT AS id
FROM x_conf GROUP BY snapshot_at"""

_plain["section_chunks"] = """
SELECT runbook_id, ('0x' || md5(runbook_id || '_' || no)[1:15])::BIGINT AS id, no::INT AS section_no, title,
  CASE WHEN no = 0 THEN 'overview' ELSE trim(p, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) END AS section,
  CASE WHEN no = 0 THEN p ELSE title || chr(10) || p END AS content,
  substring(CASE WHEN no = 0 THEN p ELSE title || chr(10) || p END, 1, 1200) AS content_prefix
FROM (SELECT runbook_id, title, unnest(parts) AS p, unnest(range(len(parts))) AS no FROM x_doc)"""


def _tag(k: str) -> str:
    lower = k.lower().replace("_", " ")
    return f"CASE WHEN contains(lower(text), '{lower}') OR contains(text, '{k}') THEN '{k}' END"


_plain["keyword_tags"] = f"""
SELECT 'doc-' || doc_id AS runbook_id, coalesce(nullif(concat_ws(',', {', '.join(_tag(k) for k in ("THE", "UND", "QUE", "OF_THE", "DE_LA", "Error"))}), ''), 'GROWING_LAG') AS tags
FROM documents"""
_plain["incident_chunks"] = """
SELECT ('0x' || md5(incident_id || '_' || kind)[1:15])::BIGINT AS id, incident_id, kind AS chunk_type, consumer_group, topic, cls AS lag_classification,
  resolution_type, minutes AS time_to_resolution_minutes, severity, summary, body AS content, substring(body, 1, 1200) AS content_prefix
FROM (SELECT *, 'cluster_state' AS kind, 'Cluster state: ' || state AS body FROM x_incident
      UNION ALL SELECT *, 'symptoms', symptoms FROM x_incident
      UNION ALL SELECT *, 'resolution', 'Resolution: ' || resolution_type || '. ' || notes FROM x_incident) WHERE trim(body) <> ''"""
_plain["chunk_ids"] = """
SELECT runbook_id, no::INT AS section_no, ('0x' || md5(runbook_id || '_' || no)[1:15])::BIGINT AS id
FROM (SELECT runbook_id, unnest(range(len(parts))) AS no FROM x_doc)"""
_plain["incident_coverage"] = """
SELECT cls AS lag_classification, count(DISTINCT incident_id) AS incidents, string_agg(DISTINCT resolution_type, ',' ORDER BY resolution_type) AS resolution_types,
  min(minutes) AS fastest_minutes, max(minutes) AS slowest_minutes FROM x_incident GROUP BY 1"""

_plain["cosine_scores"] = f"""
SELECT a.incident_id, a.id, round({COS}, 6) AS score FROM x_inc a
JOIN (SELECT * FROM x_inc QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY id) = 1) b ON b.incident_id = a.incident_id"""
_plain["vector_topk"] = "SELECT query_id, id, round(score, 6) AS score, pos::INT AS position FROM x_top"
_plain["vector_topk_ivf"] = _plain["vector_topk"]  # the index is completed to the exact neighbours
CTES["x_cfg"] = "SELECT 'CFG-' || vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings"
CTES["x_cfgtop"] = _top("x_cquery", "x_cfg", 5)
_plain["config_similarity"] = "SELECT query_id, id, round(score, 6) AS score, pos::INT AS position FROM x_cfgtop"
_SIDE = """CASE WHEN list_dot_product(e, list_transform(range(1, len(e) + 1), lambda d:
  ((d * d * 17 + d * ((k * k * 40503 + k * 9973 + 12345) % 65521) + k * 31) % 65521) / 65521.0::DOUBLE - 0.5::DOUBLE)) >= 0 THEN 1 << ((k - 1) % 8) ELSE 0 END"""
_BUCKETS = "SELECT {key}, (k - 1) // 8 AS t, sum({side}) AS bucket FROM {table}, (SELECT unnest(range(1, 65)) AS k) GROUP BY {key}, (k - 1) // 8"
_plain["vector_topk_lsh"] = f"""
SELECT query_id, id, round(score, 6) AS score, pos::INT AS position FROM (
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS pos FROM (
    SELECT a.query_id, b.id, {COS} AS score FROM x_query a, x_inc b
    WHERE (a.query_id, b.id) IN (SELECT q.query_id, c.id FROM ({_BUCKETS.format(key="query_id", side=_SIDE, table="x_query")}) q
      JOIN ({_BUCKETS.format(key="id", side=_SIDE, table="x_inc")}) c ON c.t = q.t AND c.bucket = q.bucket))
  WHERE score >= 0.1) WHERE pos <= 20"""
_plain["similar_incidents"] = """
SELECT query_id, rank::INT AS position, incident_id, round(score, 6) AS similarity_score, cls AS lag_classification, consumer_group, topic,
  'CONSUMER_RESTART' AS resolution_type, minutes AS time_to_resolution_minutes, summary FROM x_similar"""
_plain["runbook_search"] = """
SELECT query_id, pos::INT AS position, runbook_id, title, section, content, round(score, 6) AS relevance_score FROM x_rbtop"""
_plain["retrieval_query_text"] = """
SELECT snapshotted_at, cls || ' consumer group ' || group_id || ' topic ' || topic || ' lag=' || total_lag || ' velocity=' ||
  CASE WHEN v < 0 AND round_even(v, 0) = 0 THEN '-0' ELSE round_even(v, 0)::BIGINT::VARCHAR END || '/min' AS incident_query,
  cls || ' kafka consumer group runbook topic=' || topic AS runbook_query FROM x_worst"""

_plain["heuristic_topic_recs"] = "SELECT * EXCLUDE (stage) FROM (" + _TOPIC_REC.format(source="x_score") + ")"
_plain["heuristic_cluster_recs"] = (
    "SELECT *, CASE stage WHEN 2 THEN 'kafka-leader-election --bootstrap-server localhost:9092 --election-type PREFERRED --all-topic-partitions' "
    "ELSE '' END AS cli_commands FROM (" + _CLUSTER_REC.format(ts="scan_at", source="x_scan") + ")"
)
_plain["ranked_recs"] = "SELECT * FROM x_rank"
_OK = "recommendation_type <> 'REBOOT_EVERYTHING' AND priority <> 'SOON'"
_plain["validated_recs"] = f"""
SELECT analysis_id, item_no, 0.5::DOUBLE AS confidence, recommendation_type, priority, rationale, risk_level, grounding, NULL::VARCHAR AS consumer_group,
  topic, estimated_resolution_minutes, 0::INT AS cli_commands FROM x_out WHERE {_OK}"""
_plain["rejected_recs"] = f"""
SELECT analysis_id, item_no, CASE WHEN recommendation_type = 'REBOOT_EVERYTHING' THEN 'recommendation_type' ELSE 'priority' END AS rejected_for
FROM x_out WHERE NOT ({_OK})
UNION ALL SELECT analysis_id, NULL, 'output' FROM x_out0 WHERE p % 17 = 0"""

_plain["list_analyses"] = f"""
SELECT analysis_id, triggered_by, {ISO.format('analyzed_at')} AS analyzed_at, severity, overall_confidence AS confidence, llm_root_cause_summary AS summary
FROM (SELECT * FROM x_analyses WHERE severity = 'CRITICAL' ORDER BY analyzed_at DESC, analysis_id LIMIT 20)"""
_plain["get_analysis"] = "SELECT * FROM x_analyses WHERE analysis_id = '77'"
_plain["consumer_group_lag"] = f"""
SELECT group_id, topic, part AS "partition", lag_raw AS lag, {ISO.format('snapshotted_at')} AS snapshotted_at
FROM (SELECT * FROM x_lag WHERE group_id = 'g1' ORDER BY snapshotted_at DESC, group_id, topic, part LIMIT 100)"""
_plain["list_recommendations"] = """
SELECT r.*, a.severity, a.analyzed_at FROM x_recs r JOIN x_analyses a ON a.analysis_id = r.analysis_id WHERE r.applied
ORDER BY a.analyzed_at DESC, r.analysis_id, r.ordinal, r.recommendation_id LIMIT 50"""
_plain["list_cluster_configs"] = f"""
SELECT {ISO.format('snapshot_at')} AS snapshot_at, broker_count, topic_count::INT AS topic_count, change_delta IS NOT NULL AS has_changes, change_delta
FROM (SELECT * FROM x_summary ORDER BY snapshot_at DESC LIMIT 10)"""
_plain["audit_log"] = f"""
SELECT upper(event_type) AS event_type, 'g' || (user_id % 4) AS consumer_group, {TOPIC} AS topic, props AS payload, {ISO.format('ts')} AS logged_at
FROM (SELECT * FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id LIMIT 100)"""
_plain["top_lag"] = """
SELECT snapshotted_at, group_id, topic, part AS "partition", lag FROM x_lag ORDER BY lag DESC, snapshotted_at DESC, group_id, topic, part LIMIT 20"""

_plain["lag_sum_series"] = "SELECT snapshotted_at AS ts, group_id, topic, total_lag AS value FROM x_topic"
_plain["lag_partition_series"] = 'SELECT snapshotted_at AS ts, group_id, topic, part AS "partition", lag AS value FROM x_lag'
_plain["health_panel"] = """
SELECT h.scan_at, under_replicated, CASE WHEN under_replicated >= 1 THEN 'red' ELSE 'green' END AS under_replicated_colour, offline,
  CASE WHEN offline >= 1 THEN 'red' ELSE 'green' END AS offline_colour, coalesce(b.n, 0) AS brokers
FROM x_health h LEFT JOIN (SELECT scan_at, count(DISTINCT broker_id) AS n FROM x_brokers GROUP BY 1) b ON b.scan_at = h.scan_at"""
_plain["produce_rate"] = """
SELECT snapshotted_at AS ts, topic, part AS "partition", round(inc / 3600.0::DOUBLE, 6) AS value FROM x_rates"""
_plain["analyses_total"] = """
SELECT severity, analyzed_at, n AS increments, sum(n) OVER (PARTITION BY severity ORDER BY analyzed_at)::BIGINT AS total
FROM (SELECT severity, analyzed_at, count(*) AS n FROM x_analyses GROUP BY ALL)"""
_plain["recommendations_total"] = "SELECT recommendation_type, priority, count(*) AS total FROM x_recs GROUP BY ALL"
_plain["unhealthy_partitions"] = """
SELECT k.kind, CASE k.kind WHEN 'offline' THEN offline ELSE under_replicated END AS value, scan_at AS updated_at
FROM (SELECT * FROM x_health ORDER BY scan_at DESC LIMIT 1), (SELECT unnest(['under_replicated', 'offline']) AS kind) k"""
_SERIES = "(SELECT snapshotted_at AS ts, group_id, topic, total_lag AS value FROM x_topic)"
CTES["x_a1"] = _alert(_SERIES, "value > 10000", "group_id, topic", "ts")
CTES["x_a2"] = _alert(_SERIES, "value > 100000", "group_id, topic", "ts")
CTES["x_a3"] = _alert(
    "(SELECT scan_at AS ts, topic, count(*) FILTER (short) AS value FROM x_seen GROUP BY ALL)", "value > 0", "topic", "ts"
)
CTES["x_a4"] = _alert("(SELECT scan_at AS ts, offline AS value FROM x_health)", "value > 0", "", "ts")
_plain["alert_states"] = """
SELECT ts, group_id, topic, value, since AS active_since, CASE WHEN NOT active THEN 'inactive' WHEN ts - since >= INTERVAL 5 HOUR THEN 'firing' ELSE 'pending' END AS state FROM x_a1"""
_plain["alert_lag_high"] = """
SELECT ts, group_id, topic, value, since AS active_since, 'firing' AS state, 'KafkaConsumerLagHigh' AS alert, 'warning' AS severity,
  'Consumer group ' || group_id || ' lag is high on ' || topic AS summary, 'Lag of ' || value || ' messages on topic ' || topic AS description
FROM x_a1 WHERE active AND ts - since >= INTERVAL 5 HOUR"""
_plain["alert_lag_critical"] = """
SELECT ts, group_id, topic, value, since AS active_since, 'firing' AS state, 'KafkaConsumerLagCritical' AS alert, 'critical' AS severity,
  'CRITICAL: Consumer group ' || group_id || ' lag on ' || topic AS summary, 'Lag of ' || value || ' messages — immediate action required' AS description
FROM x_a2 WHERE active AND ts - since >= INTERVAL 2 HOUR"""
_plain["alert_under_replicated"] = """
SELECT ts, topic, value, since AS active_since, 'firing' AS state, 'KafkaUnderReplicatedPartitions' AS alert, 'critical' AS severity,
  'Under-replicated partitions detected on ' || topic AS summary FROM x_a3 WHERE active AND ts - since >= INTERVAL 24 HOUR"""
_plain["alert_offline"] = """
SELECT ts, value, since AS active_since, 'firing' AS state, 'KafkaOfflinePartitions' AS alert, 'critical' AS severity,
  'Offline Kafka partitions detected' AS summary FROM x_a4 WHERE active AND ts - since >= INTERVAL 24 HOUR"""

_plain["messages_per_minute"] = "SELECT date_trunc('minute', ts) AS window_start, topic, count(*) AS messages FROM x_msg GROUP BY ALL"
_plain["messages_sliding"] = """
SELECT w AS window_start, topic, count(*) AS messages
FROM (SELECT topic, unnest([time_bucket(INTERVAL 5 MINUTE, ts), time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 5 MINUTE]) AS w FROM x_msg) GROUP BY ALL"""
_plain["poison_messages"] = """
SELECT * FROM (SELECT 'g' || (off % 4) AS group_id, topic, part AS "partition", off AS "offset", key,
  CASE WHEN value IS NULL THEN 'missing value' WHEN NOT json_valid(value) THEN 'malformed JSON' WHEN strlen(value) > 1000 THEN 'oversized' END AS reason
FROM x_msg) WHERE reason IS NOT NULL"""

for _name, _text in _plain.items():
    ORACLE[_name] = sql(_text.strip())

ORACLE["ttl_dedup"] = with_recursive(
    f"SELECT group_id, cls AS lag_classification, topic, {T0} + h * INTERVAL 1 HOUR AS snapshotted_at FROM x_pass"
)

# ---------------------------------------------------------------- events and texts

_FRESH = """
(SELECT w.snapshotted_at, w.cls FROM x_worst w JOIN x_pass p
   ON p.group_id = w.group_id AND p.cls = w.cls AND p.topic = w.topic AND p.h = w.h)"""
_UUID = UUID_OF.format(ts="a.snapshotted_at")
ORACLE["analysis_event"] = with_recursive(f"""SELECT {_UUID} AS analysis_id, 0::INT AS part, a.snapshotted_at AS analyzed_at, a.severity,
  coalesce(t.g, 0)::INT AS groups, coalesce(t.n, 0)::INT AS topics, coalesce(r.n, 0)::INT AS recommendations,
  coalesce(i.n, 0)::INT AS incidents, coalesce(b.n, 0)::INT AS runbooks, a.offline
FROM x_act a
LEFT JOIN (SELECT snapshotted_at, count(DISTINCT group_id) AS g, count(*) AS n FROM x_high GROUP BY 1) t ON t.snapshotted_at = a.snapshotted_at
LEFT JOIN (SELECT snapshotted_at, count(*) AS n FROM x_rank GROUP BY 1) r ON r.snapshotted_at = a.snapshotted_at
LEFT JOIN {_FRESH} f ON f.snapshotted_at = a.snapshotted_at
LEFT JOIN (SELECT query_id, count(*) AS n FROM x_csimilar GROUP BY 1) i ON i.query_id = f.cls
LEFT JOIN (SELECT query_id, count(*) AS n FROM x_crbtop GROUP BY 1) b ON b.query_id = f.cls""")
ORACLE["event_from_model"] = sql(f"""SELECT {_UUID} AS analysis_id, a.snapshotted_at AS analyzed_at,
  CASE WHEN k % 3 = 0 THEN 'cause ' || k ELSE '' END AS llm_root_cause_summary, CASE WHEN k % 3 = 0 THEN 0.75 ELSE 0 END::DOUBLE AS overall_confidence,
  CASE WHEN k % 3 = 0 THEN '1:CONFIG_CHANGE' ELSE coalesce(r.l, '') END AS recommendations
FROM (SELECT *, epoch_us(snapshotted_at) // 3600000000 AS k FROM x_act) a
LEFT JOIN (SELECT snapshotted_at, string_agg(ordinal || ':' || recommendation_type, ',' ORDER BY ordinal) AS l FROM x_rank GROUP BY 1) r
  ON r.snapshotted_at = a.snapshotted_at""")
ORACLE["recommendation_rows"] = sql(
    f"SELECT {_UUID} AS analysis_id, a.* EXCLUDE (snapshotted_at, position), FALSE AS applied, a.snapshotted_at AS created_at FROM x_rank a"
)
ORACLE["reference_ids"] = with_recursive(f"""SELECT {_UUID} AS analysis_id, 0::INT AS part, coalesce(i.l, '') AS similar_incidents, coalesce(b.l, '') AS runbook_references
FROM x_act a LEFT JOIN {_FRESH} f ON f.snapshotted_at = a.snapshotted_at
LEFT JOIN (SELECT query_id, string_agg(incident_id, ',' ORDER BY rank) AS l FROM x_csimilar GROUP BY 1) i ON i.query_id = f.cls
LEFT JOIN (SELECT query_id, string_agg(runbook_id, ',' ORDER BY pos) AS l FROM x_crbtop GROUP BY 1) b ON b.query_id = f.cls""")
ORACLE["analysis_context"] = with_recursive(f"""SELECT a.snapshotted_at, 0::INT AS part,
  '## Consumer Group Lag Analysis' || coalesce(chr(10) || g.l, '') || chr(10) || chr(10) || '## Partition Health' || chr(10) ||
  '  total=' || a.total_partitions || chr(10) || '  under_replicated=' || a.under_replicated || chr(10) || '  offline=' || a.offline || chr(10) ||
  '  leader_imbalance=' || printf('%.1f', a.leader_imbalance * 100) || '%' || chr(10) || chr(10) ||
  CASE WHEN i.l IS NULL THEN '## Similar Historical Incidents: none found' ELSE '## Similar Historical Incidents (RAG)' || chr(10) || i.l END ||
  CASE WHEN b.l IS NULL THEN '' ELSE chr(10) || chr(10) || '## Relevant Runbook Sections' || chr(10) || b.l END AS context
FROM x_act a
LEFT JOIN (SELECT snapshotted_at, string_agg(chr(10) || '### Group: ' || group_id || ' (severity=' || printf('%.2f', s) || ')' || chr(10) || l, chr(10) ORDER BY group_id) AS l
  FROM (SELECT h.snapshotted_at, h.group_id, max(group_score) AS s, string_agg('  - topic=' || h.topic || ' lag=' || format('{{:,}}', total_lag) || ' velocity=' ||
      CASE WHEN v < 0 AND round_even(v, 0) = 0 THEN '-0' ELSE printf('%+d', round_even(v, 0)::BIGINT) END || '/min classification=' || cls ||
      CASE WHEN p.l IS NULL THEN '' ELSE chr(10) || '    problematic partitions: [' || p.l || ']' END, chr(10) ORDER BY h.topic) AS l
    FROM x_high h LEFT JOIN (SELECT snapshotted_at, group_id, topic, string_agg(part::VARCHAR, ', ' ORDER BY part) AS l FROM x_problem GROUP BY ALL) p
      ON p.snapshotted_at = h.snapshotted_at AND p.group_id = h.group_id AND p.topic = h.topic
    GROUP BY h.snapshotted_at, h.group_id) GROUP BY snapshotted_at) g ON g.snapshotted_at = a.snapshotted_at
LEFT JOIN {_FRESH} f ON f.snapshotted_at = a.snapshotted_at
LEFT JOIN (SELECT query_id, string_agg('  - [' || incident_id || '] ' || cls || ' resolved_by=CONSUMER_RESTART in ' || minutes || 'min (similarity=' ||
    printf('%.2f', score) || ')' || chr(10) || '    summary: ' || summary, chr(10) ORDER BY rank) AS l FROM x_csimilar GROUP BY 1) i ON i.query_id = f.cls
LEFT JOIN (SELECT query_id, string_agg(chr(10) || '### ' || title || ' — ' || section || chr(10) || substring(content, 1, 800), chr(10) ORDER BY pos) AS l
  FROM x_crbtop GROUP BY 1) b ON b.query_id = f.cls""")

# A stream gives the rows of the batch operator.
ORACLE["stream_lag_totals"] = ORACLE["topic_total_lag"]
ORACLE["stream_velocity"] = ORACLE["lag_velocity"]
ORACLE["stream_alert_states"] = ORACLE["alert_states"]
ORACLE["stream_ttl_dedup"] = ORACLE["ttl_dedup"]
ORACLE["stream_messages_per_minute"] = ORACLE["messages_per_minute"]
ORACLE["stream_analysis_sinks"] = ORACLE["recommendation_rows"]
ORACLE["stream_config_changes"] = ORACLE["config_delta_topics"]
