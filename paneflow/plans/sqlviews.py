"""SQL texts of the derived fixture views (FIXTURES.md §3) for the DuckDB oracle.

These are the oracle-side definitions; the Spark side builds the same streams with
the DataFrame API in :mod:`paneflow.sources.fixtures`.  The texts run unchanged in
DuckDB and Spark SQL.
"""

from __future__ import annotations

# Fixed view definitions from FIXTURES.md §3 (values must match for right results).
VIEWS = {
    "ad_events": """
SELECT event_id, ts, user_id, event_id % 100 AS page_id, (event_id * 7919) % 1100 AS ad_id,
       CASE event_id % 5 WHEN 0 THEN 'banner' WHEN 1 THEN 'modal' WHEN 2 THEN 'sponsored-search'
            WHEN 3 THEN 'mail' ELSE 'mobile' END AS ad_type,
       event_type, event_id % 65536 AS ip
FROM events""",
    "campaigns": """
SELECT ad_id, CAST(floor(ad_id / CAST(10 AS DOUBLE)) AS BIGINT) AS campaign_id
FROM (SELECT DISTINCT event_id % 1000 AS ad_id FROM events) d""",
    "position_reports": """
SELECT r_type, r_time, vid, speed, xway, lane, 0 AS dir,
       CAST(floor(pos / CAST(5280 AS DOUBLE)) AS BIGINT) AS seg, pos
FROM (
  SELECT CASE WHEN event_id % 97 = 0 THEN 2 ELSE 0 END AS r_type, 30 * k + vid % 30 AS r_time, vid,
         CASE WHEN stopped = 1 THEN 0 ELSE 20 + (event_id * 31) % 60 END AS speed, g % 2 AS xway,
         CASE WHEN stopped = 1 THEN 2 ELSE event_id % 3 END AS lane,
         CASE WHEN stopped = 1
              THEN ((g * 20 + CAST(floor(k / CAST(40 AS DOUBLE)) AS BIGINT) * 3) * 5280) % 528000 + 1000
              ELSE (g * 20 * 5280 + k * 1320 + vid * 7) % 528000 END AS pos
  FROM (
    SELECT event_id, vid, k, CAST(floor(vid / CAST(10 AS DOUBLE)) AS BIGINT) AS g,
           CASE WHEN vid % 10 IN (3, 4) AND k % 40 BETWEEN 12 AND 19 THEN 1 ELSE 0 END AS stopped
    FROM (SELECT event_id, event_id % 50 AS vid,
                 CAST(floor(event_id / CAST(50 AS DOUBLE)) AS BIGINT) AS k FROM events) a
  ) b
) c""",
    "trips": """
SELECT l_orderkey AS trip_id, l_linenumber AS leg, l_shipdate AS pickup_ts,
       CASE l_returnflag WHEN 'R' THEN 'CMT' ELSE 'VTS' END AS vendor_id,
       l_quantity / CAST(4 AS DOUBLE) AS trip_distance,
       CAST(-74 AS DOUBLE) + (l_partkey % 1000) / CAST(10000 AS DOUBLE) AS pickup_long,
       CAST(40 AS DOUBLE) + (l_suppkey % 1000) / CAST(10000 AS DOUBLE) AS pickup_lat
FROM lineitem""",
    "pings": """
SELECT event_id, ts, user_id * 1000 + event_id % 7 AS ip_pair, CAST(floor(value * 100) AS BIGINT) AS rtt
FROM events""",
    "cluster_events": """
SELECT l_orderkey AS job_id, l_linenumber AS task_id, l_shipdate AS ts, l_linenumber % 9 AS event_type,
       l_discount AS cpu, l_tax AS ram, l_quantity / CAST(50 AS DOUBLE) AS disk
FROM lineitem""",
}


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with ``WITH`` clauses for the named derived views."""
    if not names:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]}\n)" for n in names)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
