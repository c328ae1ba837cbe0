"""SQL text of the standard views, used only by the SQL counterparts of the queries."""

PRED = """v_pred AS (SELECT l_orderkey AS sample_id, l_partkey AS image_id, l_returnflag AS model, l_linestatus AS site,
  l_shipdate AS ts, l_quantity / 6.25::DOUBLE AS h_true,
  l_quantity / 6.25::DOUBLE + (l_tax - 0.04::DOUBLE) * 10 AS h_pred,
  (l_linenumber % 3)::BIGINT AS d_true,
  ((l_linenumber + CASE WHEN l_discount > 0.08::DOUBLE THEN 1 ELSE 0 END) % 3)::BIGINT AS d_pred,
  l_suppkey % 3 AS b_true, (l_suppkey + CASE WHEN l_tax > 0.06::DOUBLE THEN 1 ELSE 0 END) % 3 AS b_pred,
  0.8::DOUBLE AS conf_h, 1 - l_discount * 3 AS conf_d, 1 - l_tax * 5 AS conf_b FROM lineitem)"""

LAB = """v_lab AS (SELECT l_orderkey AS sample_id, l_partkey AS seed, l_quantity / 6.25::DOUBLE AS height_meters,
  l_quantity / 6.25::DOUBLE * 3.28084::DOUBLE
    + CASE WHEN l_tax > 0.07::DOUBLE THEN 1 ELSE 0 END * 0.5::DOUBLE AS height_feet,
  1 - l_discount AS height_confidence, 1 - l_discount * 3 AS direction_confidence,
  1.1::DOUBLE - l_tax * 5 AS breaking_confidence,
  CASE WHEN l_discount >= 0.1::DOUBLE THEN 'UNKNOWN' WHEN l_linenumber % 3 = 0 THEN 'LEFT'
       WHEN l_linenumber % 3 = 1 THEN 'RIGHT' ELSE 'STRAIGHT' END AS direction,
  CASE l_suppkey % 3 WHEN 0 THEN 'SPILLING' WHEN 1 THEN 'PLUNGING' ELSE 'SURGING' END AS breaking_type,
  l_quantity > 40 AS extreme_conditions, l_discount * 10 AS wind_strength, l_tax * 2.5::DOUBLE AS wave_steepness,
  l_partkey % 10 AS weather_id FROM lineitem)"""

TEL = """v_tel AS (SELECT event_id, ts, epoch_us(ts) / 1000000::DOUBLE AS secs, 'c' || (user_id % 10)::VARCHAR AS component, event_type AS operation,
  value AS duration_ms, event_type = 'error' AS error_occurred,
  json_extract_string(props, '$.k')::DOUBLE AS memory_mb FROM events)"""

FEAT = """v_feat AS (SELECT CASE WHEN l_shipdate < TIMESTAMP '1998-06-01' THEN 'baseline' ELSE 'current' END AS dataset,
  f.feature, f.value FROM lineitem, LATERAL (VALUES ('l_quantity', l_quantity), ('l_extendedprice', l_extendedprice),
  ('l_discount', l_discount), ('l_tax', l_tax)) AS f(feature, value))"""

FILE = """v_file AS (SELECT d.doc_id, d.source || '/' || d.doc_id::VARCHAR || '.' || d.lang AS path, d.source AS folder,
  d.lang AS ext, d.n_chars AS length, md5(d.text) AS content_hash, coalesce(l.quality, 0) = 1 AS valid,
  d.n_chars % 900 + 200 AS width, d.n_chars % 700 + 150 AS height,
  TIMESTAMP '2024-01-01' + to_hours((d.doc_id % 5000)::INTEGER) AS modified
  FROM documents d LEFT JOIN labels l USING (doc_id))"""

IMG = """v_img AS (SELECT p_partkey AS image_id, p_brand AS camera,
  ['JPEG','PNG','WEBP','GIF','BMP'][(p_partkey % 5 + 1)::INTEGER] AS format,
  (p_size * 90)::BIGINT AS width, (p_size * 60 + 100)::BIGINT AS height, p_partkey % 4 + 1 AS channels,
  (p_partkey * 7919) % 60000000 AS file_bytes, p_size / 100::DOUBLE AS contrast, p_size * 5::DOUBLE AS brightness_std,
  (p_partkey % 1000)::DOUBLE AS sharpness, (p_partkey % 97) / 97::DOUBLE AS ocean_coverage,
  (p_partkey % 89) / 89::DOUBLE AS quality_score, (p_partkey % 53) / 53::DOUBLE AS edge_preservation,
  p_partkey % 100 = 0 AS is_corrupted FROM part)"""

# pixel table (id, y, x, v) of the depth maps
PIX = """v_raw AS (SELECT vec_id, i - 1 AS i, embedding[i]::DOUBLE AS raw FROM embeddings, unnest(range(1, 65)) AS t(i)),
v_ext AS (SELECT vec_id, min(raw) AS lo, max(raw) AS hi FROM v_raw GROUP BY vec_id),
v_pix AS (SELECT vec_id, CAST(floor(i / 8) AS BIGINT) AS y, CAST(i % 8 AS BIGINT) AS x,
  CASE WHEN hi > lo THEN (raw - lo) / (hi - lo) ELSE 0 END AS v FROM v_raw JOIN v_ext USING (vec_id))"""

# colour pixels (id, y, x, r, g, b)
RGB = PIX + """,
v_lev AS (SELECT vec_id, y * 8 + x AS i, floor(v * 255)::DOUBLE AS v FROM v_pix),
v_rgb AS (SELECT a.vec_id, CAST(floor(a.i / 8) AS BIGINT) AS y, CAST(a.i % 8 AS BIGINT) AS x, a.v AS r, b.v AS g, c.v AS b
  FROM v_lev a JOIN v_lev b ON a.vec_id = b.vec_id AND b.i = (a.i + 16) % 64
  JOIN v_lev c ON a.vec_id = c.vec_id AND c.i = (a.i + 32) % 64)"""


def with_views(*views: str) -> str:
    """``WITH`` clause opening the given views; further CTEs follow after a comma."""
    return "WITH " + ",\n".join(views)
