"""SQL equivalents, where SQL can express the whole operator on whole tables."""

SQL = {
    "p3_found": """WITH b AS (SELECT match_id, camera, fid, max(t) t FROM boxes GROUP BY ALL HAVING max(t) IS NOT NULL),
d AS (SELECT match_id, camera, frame, max(t) t FROM detections GROUP BY ALL HAVING max(t) IS NOT NULL)
SELECT match_id, camera, fid, frame FROM (
  SELECT b.match_id, b.camera, b.fid, d.frame,
    row_number() OVER (PARTITION BY b.match_id, b.camera, b.fid ORDER BY abs(b.t - d.t), d.t, d.frame) r
  FROM b JOIN d ON b.match_id = d.match_id AND b.camera = d.camera AND abs(b.t - d.t) <= 0.05)
WHERE r = 1""",
}
