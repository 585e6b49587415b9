"""Streaming queries run to their end over the tables, so that their results can be compared with batch SQL."""

from __future__ import annotations

from ..streaming import events, ingest
from .base import query

WINDOWS_SQL = "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


@query("event_tumbling", WINDOWS_SQL)
def event_tumbling(spark, sf):
    return events.tumbling(spark, sf)


#: Where the watermark stands at the end: two hours behind the last event, in whole milliseconds.
MARK_SQL = "w AS (SELECT make_timestamp((max(epoch_us(ts)) // 1000 - 7200000) * 1000) AS mark FROM events)"


@query(
    "event_sessions",
    """WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL '30 minutes', true) AS new_ FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(new_::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, count(*) AS events FROM s GROUP BY user_id, n""",
)
def event_sessions(spark, sf):
    """All sessions: those that the watermark has closed, then those that the input's end closes."""
    return events.final_sessions(spark, sf)


@query(
    "event_sliding",
    f"""WITH {MARK_SQL}, e AS (SELECT time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes' * k AS window_start, event_type, value FROM events, range(4) r(k)),
    g AS (SELECT window_start, event_type, count(*) AS events, max(value) AS most FROM e GROUP BY 1, 2) SELECT g.* FROM g, w WHERE window_start + INTERVAL '2 hours' <= mark""",
)
def event_sliding(spark, sf):
    return events.final_sliding(spark, sf)


@query("event_firsts", "SELECT DISTINCT user_id, sha256(event_type || '|' || props) AS content_hash FROM events")
def event_firsts(spark, sf):
    """The watermark is longer than the input, so each content comes once."""
    return events.final_firsts(spark, sf)


@query("stream_versions", "SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def stream_versions(spark, sf):
    return ingest.versions(spark, sf)


@query(
    "lease_stream",
    """WITH RECURSIVE r AS (SELECT user_id, epoch_us(ts) // 1000 AS t, event_id, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS i FROM events),
    f AS (SELECT user_id, event_id, i, t, t + 3600000 AS lease, 1 AS attempt, 'ACQUIRED' AS outcome FROM r WHERE i = 1
      UNION ALL SELECT r.user_id, r.event_id, r.i, r.t, CASE WHEN f.lease > r.t THEN f.lease ELSE r.t + 3600000 END, CASE WHEN f.lease > r.t THEN attempt WHEN r.t < f.lease + 86400000 THEN attempt + 1 ELSE 1 END,
        CASE WHEN f.lease > r.t THEN 'BUSY' WHEN r.t < f.lease + 86400000 THEN 'TAKEN_OVER' ELSE 'ACQUIRED' END FROM f JOIN r ON r.user_id = f.user_id AND r.i = f.i + 1),
    e AS (SELECT user_id, lease, attempt, max(i) AS i FROM f GROUP BY ALL)
    SELECT user_id, event_id, t AS ms, outcome, attempt::BIGINT AS attempt FROM f
    UNION ALL SELECT e.user_id, NULL, lease, 'EXPIRED', attempt FROM e WHERE lease <= (SELECT max(t) - 7200000 FROM r) OR EXISTS (SELECT 1 FROM r WHERE r.user_id = e.user_id AND r.i > e.i)""",
)
def lease_stream(spark, sf):
    return events.final_leases(spark, sf)
