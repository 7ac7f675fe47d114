"""The catalogue's queries as SQL for DuckDB."""

from __future__ import annotations

from camtrail.operators import summary, views
from camtrail.sources import reference_data

_PREDICTIONS = """
predictions AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY media_id, frame_time ORDER BY event_id) - 1 AS INTEGER) AS det_index
  FROM (
    SELECT event_id, 'm' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS media_id,
      CASE WHEN user_id % 3 = 0 THEN 'video' ELSE 'image' END AS media_type,
      CASE WHEN user_id % 3 = 0 THEN round(CAST(event_id % 2250 AS DOUBLE) / 25, 2) ELSE CAST(0 AS DOUBLE) END AS frame_time,
      CAST((event_id * 37) % 101 AS DOUBLE) / 100 AS det_conf, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS cls_conf,
      CAST((event_id * 13) % 2000 - 40 AS INTEGER) AS x, CAST((event_id * 7) % 1140 - 30 AS INTEGER) AS y,
      CAST(40 + event_id % 400 AS INTEGER) AS width, CAST(40 + event_id % 300 AS INTEGER) AS height,
      CASE event_id % 20 WHEN 0 THEN 'person' WHEN 1 THEN 'vehicle' ELSE 'animal' END AS detected_type,
      CASE event_type WHEN 'click' THEN 'Tapirus' WHEN 'view' THEN 'Mazama' WHEN 'purchase' THEN 'Canis lupus' WHEN 'error' THEN '未知动物' WHEN 'signup' THEN '未分类动物' END AS raw_label,
      CASE WHEN user_id % 3 = 0 THEN 'm' || lpad(CAST(user_id AS VARCHAR), 6, '0') || '.mp4' ELSE
        CASE user_id % 8 WHEN 0 THEN 'demo-deer.jpg' WHEN 1 THEN 'demo-BOAR.JPG' WHEN 2 THEN 'demo-fox.jpg' WHEN 3 THEN 'demo-wolf.jpg'
          WHEN 4 THEN 'demo-empty-scene.jpg' WHEN 5 THEN 'firefox-board.png' WHEN 6 THEN 'IMG_0001.JPG' ELSE '' END END AS source_name,
      ts AS saved_at
    FROM events)
), labelled AS (
  SELECT *, CASE WHEN contains(lower(source_name), 'empty') THEN 'empty' WHEN contains(lower(source_name), 'deer') THEN '梅花鹿'
    WHEN contains(lower(source_name), 'boar') THEN '野猪' WHEN contains(lower(source_name), 'fox') THEN '狐狸' WHEN contains(lower(source_name), 'wolf') THEN '狼' END AS demo_label
  FROM predictions
), media AS (
  SELECT media_id, min(media_type) AS media_type, min(source_name) AS source_name, max(saved_at) AS saved_at, min(demo_label) AS demo_label FROM labelled GROUP BY media_id
), seen AS (
  SELECT * FROM labelled WHERE demo_label IS NULL OR demo_label <> 'empty'
), named AS (
  SELECT *, coalesce(demo_label, raw_label) AS species_label, CASE WHEN demo_label IS NULL THEN cls_conf ELSE CAST(0.92 AS DOUBLE) END AS cls FROM seen
), combined AS (
  SELECT *, round_even(least(det_conf, cls), 3) AS confidence FROM named
), kept AS (
  SELECT * FROM combined WHERE det_conf >= CAST(0.35 AS DOUBLE) AND confidence >= CAST(0.35 AS DOUBLE)
)"""
_MESSAGES = f""", counted AS (
  SELECT media_id, count(*) AS n, bool_and(species_label IN ('梅花鹿', '野猪', '狐狸', '狼')) AS all_demo FROM kept GROUP BY media_id
), records AS (
  SELECT m.media_id, m.media_type, m.source_name, m.saved_at, coalesce(n, 0) AS n_detections,
    CASE WHEN n IS NULL THEN '{summary.NOTHING_FOUND}' WHEN all_demo THEN '{summary.DEMO_ONLY}' ELSE '{summary.NO_CLASSIFIER}' END AS message
  FROM media m LEFT JOIN counted c ON m.media_id = c.media_id
), listed AS (SELECT * FROM records ORDER BY saved_at DESC, media_id LIMIT 25), placed AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY media_id ORDER BY frame_time, det_index) - 1 AS INTEGER) AS position FROM kept
)"""
_KEY = """CASE WHEN contains({0}, '梅花鹿') THEN '梅花鹿' WHEN contains({0}, '野猪') THEN '野猪' WHEN contains({0}, '狐狸') THEN '狐狸' WHEN contains({0}, '狼') THEN '狼'
  WHEN contains({0}, 'Tapirus') THEN 'Tapirus' WHEN contains({0}, 'Mazama') THEN 'Mazama' WHEN contains({0}, 'Canis') THEN 'Canis' ELSE 'Unknown' END"""
_LEVEL = "CASE WHEN {0} >= CAST(0.8 AS DOUBLE) THEN '可直接展示' WHEN {0} >= CAST(0.55 AS DOUBLE) THEN '建议复核' ELSE '保守显示' END"
_CLASS = "CASE WHEN {0} >= CAST(0.8 AS DOUBLE) THEN 'good' WHEN {0} >= CAST(0.55 AS DOUBLE) THEN 'warn' ELSE 'low' END"
_PERCENT = "CAST(CAST(floor({0} * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%'"
_CROP = f"""'{views.API_BASE}/media/crops/' || p.media_id || '_' || lpad(CAST(CAST(trunc(frame_time * 1000) AS BIGINT) AS VARCHAR), 8, '0') || '_' || det_index || '.jpg'"""
_HINTS = """SELECT coalesce('最新媒体类型：' || media_type, '{}') AS type_hint, coalesce('最新目标数：' || n_detections, '{}') AS target_hint, coalesce('最新结果：' || message, '{}') AS message_hint,
  coalesce('{}' || message, '{}') AS note FROM (SELECT 1) LEFT JOIN (SELECT * FROM records WHERE {{}} ORDER BY saved_at DESC, media_id LIMIT 1) ON TRUE""".format(*views.NO_RECORD, views.LATEST, views.NO_HISTORY)
#: The scaled value, and what it lost, by halves of its digits.
_ROUNDED = """(SELECT (floor(p) + CASE WHEN p - floor(p) > 0.5 OR p - floor(p) = 0.5 AND (e > 0 OR e = 0 AND floor(p) % 2 = 1) THEN 1 ELSE 0 END) / CAST({1} AS DOUBLE)
  FROM (SELECT p, (h * {1} - p) + (v - h) * {1} AS e FROM (SELECT v, v * CAST({1} AS DOUBLE) AS p, v * CAST(134217729 AS DOUBLE) - (v * CAST(134217729 AS DOUBLE) - v) AS h FROM (SELECT {0} AS v))))"""
_VIDEOS = """
videos AS (
  SELECT 'v' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS media_id,
    CAST(CASE o_orderkey % 5 WHEN 1 THEN 29.97 WHEN 2 THEN 30 WHEN 3 THEN 50 ELSE 25 END AS DOUBLE) AS fps, CAST(floor(o_totalprice / 100) AS BIGINT) AS n,
    CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 0.1 WHEN '2-HIGH' THEN 0.5 WHEN '3-MEDIUM' THEN 1 WHEN '4-NOT SPECIFIED' THEN 2 WHEN '5-LOW' THEN 5 END AS DOUBLE) AS pause
  FROM orders
), stepped AS (SELECT *, greatest(1, CAST(trunc(fps * greatest(CAST(0.2 AS DOUBLE), pause)) AS BIGINT)) AS step FROM videos)"""


def _texts(rows) -> str:
    return ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else f"'{v}'" for v in row) + ")" for row in rows)


def _over(query: str, more: str = "") -> str:
    return f"WITH {_PREDICTIONS.strip()}{more}\n{query}"


_FIRST = "records r LEFT JOIN placed p ON r.media_id = p.media_id AND p.position = 0"
_ANIMALS = _texts((a[0], a[1], a[2]) for a in reference_data.ANIMALS)

#: What the fallback models make of an image by its number: half the image each way, 0.88; the classifier 0.5, or a demo label.
_IMAGES = """, images AS (
  SELECT media_id, source_name, demo_label, CAST(substr(media_id, 2) AS BIGINT) AS k FROM media WHERE media_type = 'image'
), analysed AS (
  SELECT *, CASE WHEN demo_label = 'empty' THEN 'empty scene' WHEN k % 11 = 0 THEN 'not opened' ELSE 'opened' END AS status,
    400 + k % 300 AS w, 300 + k % 200 AS h, CASE WHEN demo_label IS NULL THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.88 AS DOUBLE) END AS confidence, coalesce(demo_label, '未知动物') AS label FROM images
)"""
_HISTORY = f""", stored AS (
  SELECT media_id, media_type, n_detections, message, epoch_us(saved_at) AS saved FROM records
), versions AS (
  SELECT * FROM stored UNION ALL SELECT media_id, media_type, n_detections, 'again', saved + 86400000000 FROM stored WHERE media_type = 'image'
  UNION ALL SELECT media_id, media_type, n_detections, 'between', saved + 43200000000 FROM stored WHERE CAST(substr(media_id, 2) AS BIGINT) % 5 = 0
), live AS (SELECT media_id, media_type, n_detections, message, saved AS saved_at FROM versions QUALIFY row_number() OVER (PARTITION BY media_id ORDER BY saved DESC) = 1)"""
_SUFFIX = "coalesce(nullif(lower(regexp_extract(coalesce(source_name, ''), '[^/.][^/]*?([.][^./]+)$', 1)), ''), '.bin')"

ORACLE_SQL = {
    "uploads_named": _over(f"SELECT media_id, media_id || {_SUFFIX} AS saved_name, {_SUFFIX} AS suffix FROM media WHERE media_type = 'image'"),
    "image_inference": _over(f"""SELECT media_id, status, CASE WHEN status = 'opened' THEN 1 ELSE 0 END AS n_detections, CASE WHEN status = 'opened' THEN label END AS label, CASE WHEN status = 'opened' THEN confidence END AS confidence,
  CASE WHEN status = 'opened' THEN (w // 4) || ',' || (h // 4) || ',' || (w // 2) || 'x' || (h // 2) END AS box,
  CASE WHEN status <> 'opened' THEN '{summary.NOTHING_FOUND}' WHEN demo_label IS NULL THEN '{summary.NO_CLASSIFIER}' ELSE '{summary.DEMO_ONLY}' END AS message FROM analysed""", _IMAGES),
    "image_files": _over("""SELECT media_id || '_annotated.jpg' AS name, CASE WHEN status = 'opened' AND demo_label IS NOT NULL THEN label || ' 88%' ELSE '-' END AS content FROM analysed WHERE k % 11 <> 0
UNION ALL SELECT media_id || '_00000000_0.jpg', (w // 2) || 'x' || (h // 2) FROM analysed WHERE status = 'opened' AND demo_label IS NOT NULL""", _IMAGES),
    "video_inference": f"""WITH {_VIDEOS.strip()}, numbered AS (
  SELECT *, CAST(substr(media_id, 2) AS BIGINT) AS k, CAST(trunc(fps) AS BIGINT) AS every FROM videos
), frames AS (
  SELECT media_id, k, fps, u.i FROM numbered, unnest(range(0, least(n, every * 90), every)) AS u(i) WHERE k % 11 <> 0
), ends AS (
  SELECT media_id, min(i) AS ended_at FROM frames WHERE k % 3 = 0 AND i > k % 500 GROUP BY media_id
), good AS (
  SELECT f.media_id, count(*) AS n, max(i) AS last, max(fps) AS fps FROM frames f LEFT JOIN ends e ON f.media_id = e.media_id WHERE ended_at IS NULL OR i < ended_at GROUP BY f.media_id
)
SELECT v.media_id, CASE WHEN k % 11 = 0 THEN 'not opened' WHEN ended_at IS NOT NULL THEN 'ended early' ELSE 'opened' END AS status, ended_at, coalesce(g.n, 0) AS n_detections,
  '/media/crops/' || v.media_id || '_' || lpad(CAST(CAST(trunc(round(CAST(last AS DOUBLE) / g.fps, 2) * 1000) AS BIGINT) AS VARCHAR), 8, '0') || '_0.jpg' AS last_crop
FROM numbered v LEFT JOIN ends e ON v.media_id = e.media_id LEFT JOIN good g ON v.media_id = g.media_id""",
    "image_headers": _over("""SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'png' ELSE 'jpeg' END AS image_format,
  CAST(CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 1 ELSE 1 + event_id % 8 END AS INTEGER) AS orientation, CASE WHEN event_id % 13 = 0 THEN 'broken' ELSE 'read' END AS header_status,
  CASE WHEN event_id % 13 <> 0 THEN greatest(0, x) END AS x1, CASE WHEN event_id % 13 <> 0 THEN greatest(0, y) END AS y1,
  CAST(CASE WHEN event_id % 13 <> 0 THEN least(CASE WHEN turned THEN h ELSE w END, x + width) END AS INTEGER) AS x2, CAST(CASE WHEN event_id % 13 <> 0 THEN least(CASE WHEN turned THEN w ELSE h END, y + height) END AS INTEGER) AS y2
FROM (SELECT *, 100 + event_id % 1500 AS w, 80 + event_id % 900 AS h, event_id % 2 = 1 AND event_id % 8 >= 4 AS turned FROM predictions)"""),
    "video_headers": f"""WITH {_VIDEOS.strip()} SELECT media_id, CAST(step AS INTEGER) AS step, least(90, CAST(ceil(CAST(n AS DOUBLE) / step) AS BIGINT)) AS n_frames, ceil(CAST(n AS DOUBLE) / step) > 90 AS capped FROM stepped""",
    "json_round_trip": _over("""SELECT r.media_id, r.media_type, CASE WHEN r.media_type = 'image' THEN '/media/uploads/' || r.media_id || '_annotated.jpg' END AS preview_url, r.n_detections, coalesce(n_species, 0) AS n_species, r.message
FROM records r LEFT JOIN (SELECT media_id, count(DISTINCT species_label) AS n_species FROM kept GROUP BY media_id) d ON r.media_id = d.media_id
WHERE CAST(substr(r.media_id, 2) AS BIGINT) % 7 <> 0 AND CAST(substr(r.media_id, 2) AS BIGINT) % 5 <> 0""", _MESSAGES),
    "history_live": _over("SELECT media_id, media_type, n_detections, message, saved_at FROM live", _MESSAGES + _HISTORY),
    "history_recent": _over("SELECT media_id, message, saved_at FROM live ORDER BY saved_at DESC, media_id LIMIT 25", _MESSAGES + _HISTORY),
    "point_read": _over("SELECT media_id, message FROM live WHERE media_id = (SELECT media_id FROM stored ORDER BY saved, media_id LIMIT 1)", _MESSAGES + _HISTORY),
    "engine_status": _over("""SELECT media_type, count(*) AS n, 'ok' AS status,
  '{"classifier": "fallback-classifier", "classifier_detail": "no model is configured", "detector": "fallback-detector", "detector_detail": "no model is configured"}' AS models FROM media GROUP BY media_type"""),
    "detector_gate": _over("SELECT event_id, media_id, det_index, det_conf FROM seen WHERE det_conf >= CAST(0.35 AS DOUBLE)"),
    "combined_gate": _over("SELECT event_id, media_id, species_label, confidence FROM kept"),
    "combined_gate_include_low": _over("SELECT event_id, media_id, species_label, confidence FROM combined"),
    "threshold_sweep": _over("""SELECT CAST(t.i * 5 AS DOUBLE) / 100 AS threshold, CAST(count(*) AS BIGINT) AS n_kept FROM combined, range(20) AS t(i)
WHERE det_conf >= CAST(t.i * 5 AS DOUBLE) / 100 AND confidence >= CAST(t.i * 5 AS DOUBLE) / 100 GROUP BY t.i"""),
    "empty_scene_skip": _over("SELECT media_id, count(*) AS n_predictions FROM seen GROUP BY media_id"),
    "demo_label_lookup": _over("SELECT media_id, source_name, demo_label FROM media"),
    "demo_override": _over("SELECT event_id, species_label, cls AS cls_conf FROM named"),
    "detection_rows": _over("""SELECT media_id, frame_time, det_index, x, y, width, height, detected_type, species_label, confidence,
  '/media/crops/' || media_id || '_' || lpad(CAST(CAST(trunc(frame_time * 1000) AS BIGINT) AS VARCHAR), 8, '0') || '_' || det_index || '.jpg' AS preview_crop_path FROM kept"""),
    "clip_bbox": _over("SELECT event_id, greatest(0, x) AS x1, greatest(0, y) AS y1, least(1920, x + width) AS x2, least(1080, y + height) AS y2 FROM predictions"),
    "annotation_text": _over("""SELECT event_id, species_label || ' ' || CAST(CAST(round_even(confidence * 100, 0) AS BIGINT) AS VARCHAR) || '%' AS label,
  x AS x1, y AS y1, x + width AS x2, y + height AS y2, greatest(0, y - 24) AS label_y, '/media/uploads/' || media_id || '_annotated.jpg' AS path FROM kept WHERE media_type = 'image'"""),
    "crop_names": _over("SELECT event_id, media_id || '_' || lpad(CAST(CAST(trunc(frame_time * 1000) AS BIGINT) AS VARCHAR), 8, '0') || '_' || det_index || '.jpg' AS crop_name FROM kept"),
    "upload_suffixes": _over("""SELECT suffix, count(*) AS n FROM (
  SELECT CASE WHEN s = '' THEN '.bin' ELSE s END AS suffix FROM (
    SELECT lower(regexp_extract(name, '[^/.][^/]*?([.][^./]+)$', 1)) AS s FROM (SELECT url AS name FROM pages UNION ALL SELECT source_name FROM media))) GROUP BY suffix"""),
    "species_summary": _over("SELECT media_id, species_label, count(*) AS n FROM kept GROUP BY media_id, species_label"),
    "species_summary_map": _over("""SELECT media_id, string_agg(species_label || '=' || n, ',' ORDER BY species_label) AS species_summary
FROM (SELECT media_id, species_label, count(*) AS n FROM kept GROUP BY media_id, species_label) GROUP BY media_id"""),
    "analysis_message": _over("SELECT media_id, n_detections, message FROM records", _MESSAGES),
    "analysis_response": _over("""SELECT r.media_id, r.media_type, CASE WHEN r.media_type = 'image' THEN '/media/uploads/' || r.media_id || '_annotated.jpg' END AS preview_url, r.n_detections,
  coalesce(d.detections, '') AS detections, coalesce(d.n_species, 0) AS n_species, r.message
FROM records r LEFT JOIN (
  SELECT media_id, string_agg(species_label || '@' || printf('%.2f', frame_time) || ':' || printf('%.3f', confidence), ',' ORDER BY position) AS detections, count(DISTINCT species_label) AS n_species FROM placed GROUP BY media_id
) d ON r.media_id = d.media_id""", _MESSAGES),
    "frame_sampling": f"WITH {_VIDEOS.strip()} SELECT media_id, CAST(u.i AS INTEGER) AS frame_index, round(CAST(u.i AS DOUBLE) / fps, 2) AS frame_time FROM stepped, unnest(range(0, least(n, step * 90), step)) AS u(i)",
    "frame_cap": f"""WITH {_VIDEOS.strip()} SELECT media_id, CAST(step AS INTEGER) AS step, least(90, CAST(ceil(CAST(n AS DOUBLE) / step) AS BIGINT)) AS n_frames, ceil(CAST(n AS DOUBLE) / step) > 90 AS capped FROM stepped""",
    "knowledge_lookup": _over(f"""SELECT a.media_id, a.key, k.latin, k.title
FROM (SELECT r.media_id, {_KEY.format("coalesce(p.species_label, 'Unknown')")} AS key FROM {_FIRST}) a JOIN (VALUES {_ANIMALS}) AS k(key, title, latin) ON a.key = k.key""", _MESSAGES),
    "knowledge_labels": _over(f"SELECT {_KEY.format('species_label')} AS key, count(*) AS n FROM kept GROUP BY 1"),
    "review_level": _over(f"SELECT {_LEVEL.format('confidence')} AS label, {_CLASS.format('confidence')} AS class_name, count(*) AS n FROM kept GROUP BY 1, 2"),
    "headline_insight": _over(f"""SELECT r.media_id, coalesce(p.species_label, '{views.NOT_STARTED}') AS label, coalesce(p.confidence, CAST(0 AS DOUBLE)) AS confidence, r.n_detections,
  {_LEVEL.format("coalesce(p.confidence, CAST(0 AS DOUBLE))")} AS level, {_PERCENT.format("coalesce(p.confidence, CAST(0 AS DOUBLE))")} AS percent,
  CASE WHEN r.n_detections > 0 THEN {_PERCENT.format("p.confidence")} || '{views.CONFIDENCE}' ELSE '{views.NO_CONFIDENCE}' END AS shown,
  {_KEY.format("coalesce(p.species_label, 'Unknown')")} AS knowledge_key FROM {_FIRST}""", _MESSAGES),
    "result_table": _over(f"""SELECT media_id, position, species_label, detected_type, printf('%.2fs', frame_time) AS seconds, {_PERCENT.format("confidence")} AS percent,
  x || ',' || y || ',' || width || 'x' || height AS box, {_CROP} AS crop FROM placed p""", _MESSAGES),
    "result_table_outer": _over(f"""SELECT r.media_id, p.position, p.species_label, {_CROP} AS crop, CASE WHEN p.media_id IS NULL THEN '{views.NOTHING_KEPT}' END AS placeholder
FROM records r LEFT JOIN placed p ON r.media_id = p.media_id""", _MESSAGES),
    "media_type_route": _over("SELECT media_id, CASE WHEN media_type = 'video' THEN 'video' ELSE 'image' END AS route FROM media"),
    "record_counts": _over("SELECT count(*) AS total, count(*) FILTER (media_type = 'image') AS images, count(*) FILTER (media_type = 'video') AS videos FROM listed", _MESSAGES),
    "record_rows": _over(f"SELECT media_id, CASE WHEN media_type = 'video' THEN '{views.VIDEO_TITLE}' ELSE '{views.IMAGE_TITLE}' END AS title, message, n_detections || ' 个目标' AS targets FROM listed", _MESSAGES),
    "recent_results": _over("SELECT media_id, row_number() OVER (ORDER BY saved_at DESC, media_id) AS place, n_detections, message FROM listed", _MESSAGES),
    "latest_record": _over(_HINTS.format("TRUE"), _MESSAGES),
    "latest_record_of_none": _over(_HINTS.format("media_type = 'audio'"), _MESSAGES),
    "exact_rounding": f"""SELECT l_orderkey, l_linenumber, {_ROUNDED.format("value", 1000)} AS three, {_ROUNDED.format("value / 3", 100)} AS two
FROM (SELECT l_orderkey, l_linenumber, CAST(l_partkey * 5 % 20000 AS DOUBLE) / 10000 AS value FROM lineitem)""",
    "history_upsert": _over("""SELECT media_id, media_type FROM (
  SELECT media_id, media_type, CASE WHEN media_id = (SELECT media_id FROM records WHERE media_type = 'image' ORDER BY saved_at, media_id LIMIT 1) THEN 1 ELSE 0 END AS again, saved_at FROM records)
ORDER BY again DESC, saved_at DESC, media_id LIMIT 25""", _MESSAGES),
    "preview_source": _over(f"SELECT media_id, CASE WHEN media_type = 'image' THEN '{views.API_BASE}/media/uploads/' || media_id || '_annotated.jpg' ELSE 'local:' || source_name END AS preview FROM media"),
    "session_summary": _over(f"SELECT media_id, source_name AS input, CAST(n_detections AS VARCHAR) AS targets, 'fallback-detector' AS detector, '{views.NOT_ANALYSED}' AS classifier FROM records", _MESSAGES),
    "json_props_parse": """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, '{"k":' || json_extract_string(props, '$.k') || '}' AS props FROM events""",
    "origin_list_split": r"""SELECT doc_id, CAST(len(parts) AS BIGINT) AS n_parts, md5(array_to_string(parts, '|')) AS parts_md5 FROM (
  SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), ','), lambda x: regexp_replace(x, '^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$', '', 'g')), lambda x: x <> '') AS parts FROM documents)""",
    "plant_library": f"""SELECT t.priority, title, latin, tags, count(*) AS n_parts
FROM part JOIN (SELECT CAST(priority AS INTEGER) AS priority, title, latin, tags FROM (VALUES {_texts((i, p[0], p[1], '/'.join(p[2])) for i, p in enumerate(reference_data.PLANTS))}) AS v(priority, title, latin, tags)) t
  ON p_partkey % {len(reference_data.PLANTS)} = t.priority GROUP BY ALL""",
    "demo_media": _over(f"""SELECT t.file_name, priority, title, label, count(*) AS n_media
FROM media JOIN (SELECT CAST(priority AS INTEGER) AS priority, title, label, file_name FROM (VALUES {_texts((i, m[0], m[1], m[4]) for i, m in enumerate(reference_data.DEMO_MEDIA))}) AS v(priority, title, label, file_name)) t
  ON lower(source_name) = t.file_name GROUP BY ALL"""),
}
