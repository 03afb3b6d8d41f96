"""Adapter views: deterministic projections of the star-schema tables into detection, crop, bead and label tables.

The same text runs in Spark SQL and DuckDB; {table} is where a source table goes.
"""

CANVAS_W, CANVAS_H = 640, 360

ADAPTERS = {
    "detections": """SELECT l_orderkey % 3 AS video, CAST(floor(l_orderkey / 12.0) AS BIGINT) AS frame,
  CAST(row_number() OVER (PARTITION BY l_orderkey % 3, CAST(floor(l_orderkey / 12.0) AS BIGINT)
    ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS BIGINT) AS det_idx,
  CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 0 END AS cls,
  CAST((l_partkey * 37) % 480 AS DOUBLE) AS x1,
  CAST((l_suppkey * 53) % 270 AS DOUBLE) AS y1,
  CAST((l_partkey * 37) % 480 AS DOUBLE) + CASE WHEN l_linenumber % 2 = 0 THEN 20 + l_quantity ELSE 80 + 2 * l_quantity END AS x2,
  CAST((l_suppkey * 53) % 270 AS DOUBLE) + CASE WHEN l_linenumber % 2 = 0 THEN 20 + l_partkey % 40 ELSE 80 + l_partkey % 90 END AS y2,
  0.25 + l_discount * 7 AS conf
FROM {lineitem}""",
    "crops": """SELECT CAST(row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS BIGINT) AS crop_id,
  l_orderkey % 3 AS video, CAST(floor(l_orderkey / 12.0) AS BIGINT) AS frame,
  l_linenumber AS tag_idx, 0.25 + l_discount * 7 AS score,
  (l_partkey * 2654435761) % 1048576 AS hash, CAST(l_suppkey % 10 AS VARCHAR(2)) AS digit
FROM {lineitem}""",
    "beads": """SELECT l_orderkey AS tag_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS BIGINT) AS bead_idx,
  CAST((l_partkey * 31) % 101 - 50 AS DOUBLE) AS cx, CAST((l_suppkey * 17) % 97 - 48 AS DOUBLE) AS cy,
  5 + l_quantity / 10 AS radius,
  CAST((l_orderkey * 13) % 41 - 20 AS DOUBLE) AS ref_dx, CAST((l_orderkey * 29) % 43 - 21 AS DOUBLE) AS ref_dy
FROM {lineitem}""",
    "tag_reads": """SELECT user_id AS track_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS seq,
  CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS BIGINT) AS frame,
  CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS code
FROM {events}""",
    "track_points": """SELECT user_id AS track_id, CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS BIGINT) AS frame,
  CAST(sum((event_id * 7919) % 41 - 20) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cx,
  CAST(sum((event_id * 104729) % 37 - 18) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cy,
  value / 1000 AS dt
FROM {events}""",
    "manual_log": """SELECT event_id AS log_pos, (event_id * 37) % 4000 AS crop_id,
  CASE WHEN CAST(floor(value) AS BIGINT) % 11 = 10 THEN '' ELSE CAST(CAST(floor(value) AS BIGINT) % 11 AS VARCHAR(2)) END AS digit,
  CAST((event_id * 10) % 360 AS INT) AS rotation_deg
FROM {events} WHERE event_type IN ('click', 'view', 'purchase')""",
    "auto_preds": """SELECT event_id AS pos, (event_id * 53) % 4000 AS crop_id,
  CASE WHEN event_id % 7 = 0 THEN 'O' WHEN event_id % 7 = 1 THEN '12' ELSE CAST(CAST(floor(value) AS BIGINT) % 10 AS VARCHAR(2)) END AS pred_text,
  CAST(CAST(floor(value * 100) AS BIGINT) % 1000 AS DOUBLE) / 1000 AS score
FROM {events} WHERE event_type = 'signup'""",
    "synthetic": """SELECT 100000 + event_id AS crop_id, (event_id * 91) % 4500 AS source_crop_id,
  CAST(CAST(floor(value) AS BIGINT) % 9 AS VARCHAR(2)) AS digit, CAST((event_id * 7) % 3600 AS DOUBLE) / 10 AS rotation_deg
FROM {events} WHERE event_type = 'error'""",
    "images": """SELECT o_orderkey AS image_id, concat('frame_', CAST(o_orderkey AS VARCHAR(12)), '.jpg') AS file_name, 640 AS width, 360 AS height,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey * 10 END AS remote_id
FROM {orders}""",
    "features": """SELECT vec_id AS crop_id, CAST(label AS VARCHAR(2)) AS digit, embedding FROM {embeddings}""",
}
