"""The registered queries in plain SQL, for checking on another engine.

Written against the tables alone. Common parts are named subqueries that are
put in front of a query when it mentions them.
"""

from __future__ import annotations

import re

from docflow import constants as C
from docflow.plans import inputs as I
from docflow.plans import queries as Q
from docflow.plans import waves as W

TAG = C.REF_PATTERN
EOS = C.EOS_TOKEN

COMMON = {
    "docs": f"""
SELECT doc_id AS document_index, source || '/' || lang || '/doc_' || doc_id || '.pdf' AS document_path,
  CAST(ceil(n_chars / {I.PAGE_CHARS}.0) AS BIGINT) AS page_count,
  ((doc_id * 17) % 1000) / 1000 AS render_s, text
FROM documents""",
    "pg": f"""
SELECT document_index, document_path, page_count, page_index,
  400 + (document_index * 131 + page_index * 17) % 2600 AS width,
  500 + (document_index * 71 + page_index * 29) % 3000 AS height,
  substring(text, page_index * {I.PAGE_CHARS} + 1, {I.PAGE_CHARS}) AS chunk
FROM (SELECT *, unnest(range(0, page_count)) AS page_index FROM docs WHERE page_count > 0)""",
    "ratios": """
SELECT i, j FROM (SELECT unnest(range(1, 7)) AS i), (SELECT unnest(range(1, 7)) AS j) WHERE i * j BETWEEN 2 AND 6""",
    "near": """
SELECT document_index, page_index, width, height, i, j,
  abs(width / height - i / j) AS d,
  min(abs(width / height - i / j)) OVER (PARTITION BY document_index, page_index) AS least
FROM pg CROSS JOIN ratios""",
    "tiles": """
SELECT document_index, page_index, width, height,
  CASE WHEN width <= 768 AND height <= 768 THEN 1
    ELSE coalesce(arg_max(i, i * j) FILTER (width * height > 0.5 * 768 * 768 * i * j), arg_min(i, i * j)) END AS tiles_w,
  CASE WHEN width <= 768 AND height <= 768 THEN 1
    ELSE coalesce(arg_max(j, i * j) FILTER (width * height > 0.5 * 768 * 768 * i * j), arg_min(j, i * j)) END AS tiles_h
FROM near WHERE d = least GROUP BY document_index, page_index, width, height""",
    "ocr": f"""
SELECT *, len(string_split(raw_text, ' ')) AS output_tokens FROM (
SELECT document_index, document_path, page_count, page_index, width, height, chunk,
  '<|ref|>' || CASE (document_index + page_index) % 4 WHEN 0 THEN 'title' WHEN 1 THEN 'text' WHEN 2 THEN 'image' ELSE 'table' END
  || '<|/ref|><|det|>' || CASE WHEN document_index % 29 = 7 THEN '[[1, 2' ELSE
    '[[' || x || ', ' || y || ', ' || (x + 100 + document_index % 500) || ', ' || (y + 50 + page_index % 300) || ']]' END
  || '<|/det|>' || chr(10) || chunk || repeat(chr(10), 4)
  || CASE WHEN page_index % 2 = 0 THEN '<|ref|>image<|/ref|><|det|>[[10, 20, 500, 400], [0, 0, 999, 999]]<|/det|>' ELSE '' END
  || CASE WHEN (document_index * 7 + page_index) % 10 <> 0 THEN '{EOS}' ELSE '' END AS raw_text
FROM (SELECT *, (document_index * 37 + page_index * 11) % 400 AS x, (document_index * 53 + page_index * 7) % 400 AS y FROM pg))""",
    "cost": """
SELECT o.document_index, o.page_index, o.page_count, output_tokens,
  257 + CASE WHEN tiles_w * tiles_h > 1 THEN 144 * tiles_w * tiles_h ELSE 0 END AS input_tokens
FROM ocr o JOIN tiles t USING (document_index, page_index)""",
    "placed": f"""
SELECT document_index, page_index,
  (row_number() OVER (ORDER BY document_index, page_index) - 1) // {I.BATCH_PAGES} AS batch_id FROM pg""",
    "outcome": """
SELECT document_index, page_index, page_count, batch_id, input_tokens, output_tokens,
  CASE WHEN batch_id % 17 = 3 THEN 'fail batch ' || batch_id END AS error,
  (batch_id * 13) % 700 / 1000 AS preprocess_s, (batch_id * 97) % 5000 / 1000 AS generate_s,
  (document_index * 13 + page_index * 7) % 300 AS queue_wait_ms, (batch_id * 97) % 5000 AS gpu_ms, (batch_id * 31) % 50 AS post_ms
FROM cost JOIN placed USING (document_index, page_index)""",
    "status": f"""
SELECT document_index, document_path, page_count, render_s, first_failed_batch,
  CASE WHEN page_count = 0 THEN '{C.ZERO_PAGES_ERROR}' WHEN first_failed_batch IS NOT NULL THEN 'fail batch ' || first_failed_batch END AS error,
  CASE WHEN page_count = 0 OR first_failed_batch IS NOT NULL THEN 'failed' ELSE 'ok' END AS status
FROM docs LEFT JOIN (SELECT document_index, min(batch_id) AS first_failed_batch FROM placed WHERE batch_id % 17 = 3 GROUP BY 1)
  USING (document_index)""",
    "gapped": f"""
SELECT * REPLACE (CASE WHEN gap THEN 0 ELSE page_count END AS page_count,
  CASE WHEN gap THEN '{C.ZERO_PAGES_ERROR}' ELSE error END AS error, CASE WHEN gap THEN 'failed' ELSE status END AS status)
FROM (SELECT *, document_index % 50 = 49 AS gap FROM status)""",
    "done": """
SELECT o.* FROM outcome o JOIN status s USING (document_index)
WHERE o.error IS NULL AND (first_failed_batch IS NULL OR o.batch_id < first_failed_batch)""",
    "tags": f"""
SELECT document_index, page_index, width, height, raw_text,
  unnest(range(len(regexp_extract_all(raw_text, '{TAG}', 0)))) AS ref_index,
  unnest(regexp_extract_all(raw_text, '{TAG}', 1)) AS label,
  unnest(regexp_extract_all(raw_text, '{TAG}', 2)) AS coords
FROM ocr""",
    "boxes": """
SELECT document_index, page_index, width, height, ref_index, label, box_index,
  b[1] AS x1_norm, b[2] AS y1_norm, b[3] AS x2_norm, b[4] AS y2_norm,
  CAST(trunc(b[1] / 999 * width) AS BIGINT) AS x1, CAST(trunc(b[2] / 999 * height) AS BIGINT) AS y1,
  CAST(trunc(b[3] / 999 * width) AS BIGINT) AS x2, CAST(trunc(b[4] / 999 * height) AS BIGINT) AS y2
FROM (SELECT *, unnest(bb) AS b, unnest(range(len(bb))) AS box_index
  FROM (SELECT *, try_cast(coords AS DOUBLE[][]) AS bb FROM tags))""",
    "kept": f"""
SELECT *, row_number() OVER (PARTITION BY document_index ORDER BY page_index) - 1 AS kept_index
FROM ocr WHERE contains(raw_text, '{EOS}')""",
    "cleaned": f"""
SELECT document_index, page_index, regexp_replace(regexp_replace(replace(replace(
    regexp_replace(replace(raw_text, '{EOS}', ''), '{TAG}', '', 'g'), '\\coloneqq', ':='), '\\eqqcolon', '=:'),
    '\\n{{3,}}', chr(10) || chr(10), 'g'), '\\A\\s+|\\s+\\z', '', 'g') AS clean_text
FROM ocr""",
    "linked": f"""
SELECT document_index, page_index, kept_index,
  CASE WHEN len(o) > 0 THEN replace(replace(replace(replace(replace(t, o[1], ''), '\\coloneqq', ':='), '\\eqqcolon', '=:'),
    repeat(chr(10), 4), repeat(chr(10), 2)), repeat(chr(10), 3), repeat(chr(10), 2)) ELSE t END AS linked
FROM (SELECT *,
  CASE WHEN len(m) > 1 THEN replace(t1, m[2], '![](images/' || kept_index || '_1.jpg)' || chr(10)) ELSE t1 END AS t
  FROM (SELECT *, CASE WHEN len(m) > 0 THEN replace(body, m[1], '![](images/' || kept_index || '_0.jpg)' || chr(10)) ELSE body END AS t1
    FROM (SELECT *, replace(raw_text, '{EOS}', '') AS body,
      list_filter(regexp_extract_all(raw_text, '{TAG}', 0), lambda x: contains(x, '<|ref|>image<|/ref|>')) AS m,
      list_filter(regexp_extract_all(raw_text, '{TAG}', 0), lambda x: NOT contains(x, '<|ref|>image<|/ref|>')) AS o
      FROM kept)))""",
    "formula": """
SELECT document_index, page_index,
  '\\[ x_' || document_index || ' \\coloneqq y \\quad (' || page_index || ') \\]' || chr(10) || raw_text AS raw_text,
  '\\[x_' || document_index || ' \\coloneqq y\\]' || chr(10) || raw_text AS tidy
FROM ocr""",
    "paths": """
SELECT page_id, url || CASE page_id % 8 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PNG' WHEN 2 THEN '.Jpeg' WHEN 3 THEN '.txt'
  WHEN 4 THEN '.tiff' WHEN 5 THEN '/.png' WHEN 6 THEN '.pdf.bak' ELSE '' END AS path FROM pages""",
    "wanted": """
SELECT * FROM paths WHERE regexp_matches(lower(path), '[^/]\\.(pdf|png|jpg|jpeg|tif|tiff|bmp|webp)$')""",
    "arrived": """
SELECT event_id, user_id, epoch_us(ts) AS queued_us FROM events""",
    "totals": """
SELECT count(*) AS documents, count(*) FILTER (status = 'ok') AS succeeded, count(*) FILTER (status <> 'ok') AS failed,
  coalesce(sum(page_count) FILTER (status = 'ok'), 0) AS pages,
  (SELECT coalesce(sum(input_tokens), 0) FROM cost JOIN status USING (document_index) WHERE status = 'ok') AS input_tokens,
  0 AS cached_tokens,
  (SELECT coalesce(sum(output_tokens), 0) FROM cost JOIN status USING (document_index) WHERE status = 'ok') AS output_tokens
FROM status""",
    "generated": """
SELECT count(*) AS generated_pages, sum(input_tokens) AS generated_input_tokens, 0 AS generated_cached_tokens,
  sum(output_tokens) AS generated_output_tokens, sum(input_tokens + output_tokens) AS generated_total_tokens FROM done""",
    "stages": """
SELECT round((SELECT sum(render_s) FROM docs), 6) AS render_s, round(sum(p), 6) AS preprocess_s,
  round(sum(g), 6) AS generate_s, round(sum(p + g), 6) AS inference_s
FROM (SELECT batch_id, max(preprocess_s) AS p, max(generate_s) AS g FROM done GROUP BY 1)""",
    "corpus": """
SELECT *, pages / elapsed_s AS pages_per_second, total_tokens / elapsed_s AS tokens_per_second,
  generated_pages / elapsed_s AS generated_pages_per_second, generated_total_tokens / elapsed_s AS generated_tokens_per_second
FROM (SELECT t.*, input_tokens + output_tokens AS total_tokens, g.*, s.*, round(render_s + inference_s, 6) AS elapsed_s
  FROM totals t, generated g, stages s)""",
    "users": f"""
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY queued_us, event_id) - 1 AS n,
  count(*) OVER (PARTITION BY user_id ORDER BY queued_us RANGE BETWEEN UNBOUNDED PRECEDING AND {Q.WAIT_US - 1} FOLLOWING) AS timeout
FROM arrived""",
    "user_batches": f"""
SELECT user_id, event_id, queued_us, batch_id, min(queued_us) OVER (PARTITION BY batch_id) AS opened_at,
  first_value(event_id) OVER (PARTITION BY batch_id ORDER BY n) AS opened_by
FROM (SELECT u.*, sum(CASE WHEN o.n IS NULL THEN 0 ELSE 1 END) OVER (ORDER BY u.user_id, u.n) - 1 AS batch_id
  FROM users u LEFT JOIN opening o ON u.user_id = o.user_id AND u.n = o.n)""",
    "line": f"""
SELECT *, row_number() OVER (ORDER BY queued_us, event_id) - 1 AS n,
  count(*) OVER (ORDER BY queued_us RANGE BETWEEN UNBOUNDED PRECEDING AND {Q.SHARED_WAIT_US - 1} FOLLOWING) AS timeout
FROM arrived""",
    "shared": """
SELECT user_id, event_id, queued_us, batch_id, min(queued_us) OVER (PARTITION BY batch_id) AS opened_at
FROM (SELECT l.*, sum(CASE WHEN o.n IS NULL THEN 0 ELSE 1 END) OVER (ORDER BY l.n) - 1 AS batch_id
  FROM line l LEFT JOIN shared_opening o ON l.n = o.n)""",
    "bodies": """
SELECT document_index AS request_id, page_count, document_index % 23 = 11 AS broken,
  document_index % 19 = 5 AS bad_image,
  CASE document_index % 3 WHEN 0 THEN '<image>' || chr(10) || 'Free OCR.' ELSE '<image>' || chr(10) || '<|grounding|>Convert the document to markdown.' END AS prompt
FROM docs""",
    "shots": f"""
SELECT document_index, page_index, chunk, unnest(range(0, CAST(ceil(length(chunk) / {I.SNAPSHOT_CHARS}.0) AS BIGINT))) AS snapshot
FROM pg WHERE length(chunk) > 0""",
    "grams": """
SELECT document_index, page_index, ids, s, ids[s + 1 : s + 3] AS gram
FROM (SELECT *, unnest(range(0, len(ids) - 2)) AS s
  FROM (SELECT document_index, page_index, list_transform(string_split(chunk, ' '), lambda w: length(w)) AS ids FROM pg)
  WHERE len(ids) >= 3)""",
    "step_sums": """
SELECT user_id AS request_id, CASE event_type WHEN 'click' THEN 'gpu_generate' WHEN 'view' THEN 'cpu_preprocess' ELSE event_type END AS step,
  sum(greatest(CAST(round(value * 100) AS BIGINT) - 2000, 0)) AS h FROM events GROUP BY ALL""",
    "request_sums": """
SELECT request_id, sum(h) AS spent, sum(h) + request_id % 3 * 30 AS total FROM step_sums GROUP BY request_id""",
    "page_json": """
SELECT c.document_index, c.page_index, {
    'raw_text': raw_text, 'clean_text': clean_text,
    'detections': coalesce(found, []), 'has_eos': contains(raw_text, '<｜end▁of▁sentence｜>'),
    'image_size': {'width': width, 'height': height}} AS result
FROM cleaned c JOIN ocr USING (document_index, page_index)
LEFT JOIN (SELECT document_index, page_index, list({'label': label, 'bbox_norm': [x1_norm, y1_norm, x2_norm, y2_norm],
    'bbox': [x1, y1, x2, y2]} ORDER BY ref_index, box_index) AS found FROM boxes GROUP BY ALL) USING (document_index, page_index)""",
    "page_lists": """
SELECT document_index, list(result ORDER BY page_index) AS results FROM page_json GROUP BY document_index""",
    "results": """
SELECT s.document_index, s.document_path, s.status, s.error, s.page_count,
  count(p.page_index) AS n_results, coalesce(string_agg(p.clean_text, '|' ORDER BY p.page_index), '') AS texts,
  coalesce(sum(p.n), 0) AS n_detections, coalesce(sum(p.input_tokens), 0) AS input_tokens, coalesce(sum(p.output_tokens), 0) AS output_tokens
FROM status s LEFT JOIN (
  SELECT c.document_index, c.page_index, clean_text, input_tokens, output_tokens, coalesce(n, 0) AS n
  FROM cleaned c JOIN cost USING (document_index, page_index)
  LEFT JOIN (SELECT document_index, page_index, count(*) AS n FROM boxes GROUP BY ALL) USING (document_index, page_index)) p
  ON s.document_index = p.document_index AND s.status = 'ok'
GROUP BY ALL""",
}

# Chains of openings; each needs the row that would open the next batch.
RECURSIVE = {
    "opening": f"""
SELECT user_id, 0::BIGINT AS n FROM (SELECT DISTINCT user_id FROM arrived)
UNION ALL
SELECT u.user_id, greatest(u.n + 1, least(u.n + {Q.QUEUE_ROWS}, u.timeout))
FROM opening o JOIN users u ON u.user_id = o.user_id AND u.n = o.n""",
    "shared_opening": f"""
SELECT 0::BIGINT AS n
UNION ALL
SELECT greatest(l.n + 1, least(l.n + {Q.SHARED_ROWS}, l.timeout)) FROM shared_opening o JOIN line l ON l.n = o.n""",
}

_BIG = "CAST({0} AS BIGINT) AS {0}"


def _big(*names: str) -> str:
    return ", ".join(_BIG.format(name) for name in names)


QUERIES = {
    "ext_filter": "SELECT page_id, path FROM wanted",
    "document_index": """SELECT page_id, path, row_number() OVER (ORDER BY string_split(path, '/'), page_id) - 1 AS document_index FROM paths""",
    "limit_docs": "SELECT page_id, path FROM wanted ORDER BY string_split(path, '/'), path LIMIT 20",
    "decode_batch_requests": """SELECT request_id, page_index, prompt, chunk AS payload
FROM bodies JOIN pg ON request_id = document_index WHERE NOT broken AND NOT bad_image""",
    "rejected_requests": f"""SELECT request_id, CASE WHEN broken THEN '{C.INVALID_JSON_ERROR}'
  WHEN no_pages AND NOT bad_image THEN '{C.NO_IMAGES_ERROR}' ELSE 'image is not base64' END AS error
FROM (SELECT *, page_count = 0 OR request_id % 50 = 49 AS no_pages FROM bodies) WHERE broken OR bad_image OR no_pages""",
    "image_sizes": """SELECT document_index, page_index, CASE WHEN page_index % 6 <> 2 THEN width END AS width,
  CASE WHEN page_index % 6 <> 2 THEN height END AS height,
  CASE WHEN page_index % 6 = 2 THEN 'cannot identify image file' END AS error FROM pg""",
    "markdown_sink": f"""SELECT document_index, document_path, replace(string_split(document_path, '/')[-1], 'pdf', 'mmd') AS out_name, 0::BIGINT AS part_index,
  string_agg(linked || chr(10) || '{C.PAGE_SPLIT.replace(chr(10), "' || chr(10) || '")}' || chr(10), '' ORDER BY page_index) AS markdown
FROM linked JOIN docs USING (document_index) GROUP BY document_index, document_path""",
    "output_names": """SELECT document_index, replace(name, '.pdf', '_det.mmd') AS tagged, replace(name, 'pdf', 'mmd') AS markdown,
  replace(name, '.pdf', '_layouts.pdf') AS layout, replace(name, '.pdf', '.md') AS image
FROM (SELECT document_index, string_split(document_path, '/')[-1] AS name FROM docs)""",
    "page_explode": "SELECT document_index, page_index FROM pg",
    "zero_page_docs": f"""SELECT document_index, document_path, 0::BIGINT AS page_count, 'failed' AS status, '{C.ZERO_PAGES_ERROR}' AS error
FROM docs WHERE document_index % 50 = 49 OR page_count = 0""",
    "prompt_check": """SELECT document_index, prompt, len(string_split(prompt, '<image>')) = 2 AS prompt_ok FROM (
  SELECT document_index, CASE document_index % 5 WHEN 1 THEN '<image>' || chr(10) || 'Free OCR.' WHEN 2 THEN 'Free OCR.'
    WHEN 3 THEN '<image><image>' ELSE '<image>' || chr(10) || '<|grounding|>Convert the document to markdown.' END AS prompt FROM docs)""",
    "page_pixels": """SELECT document_index, page_index, CAST(ceil(width / 3 * 200 / 72 - 0.001) AS BIGINT) AS width,
  CAST(ceil(height / 4 * 200 / 72 - 0.001) AS BIGINT) AS height FROM pg""",
    "eos_flag": f"SELECT document_index, page_index, contains(raw_text, '{EOS}') AS has_eos FROM ocr",
    "drop_no_eos": f"SELECT document_index, page_index FROM ocr WHERE contains(raw_text, '{EOS}')",
    "kept_page_index": "SELECT document_index, page_index, kept_index FROM kept",
    "over_budget_pages": f"""SELECT document_index, page_index, {_big("input_tokens", "output_tokens")}
FROM cost WHERE input_tokens + output_tokens > {Q.CONTEXT}""",
    "tile_plan": """SELECT document_index, page_index, width, height, CAST(tiles_w AS INTEGER) AS tiles_w, CAST(tiles_h AS INTEGER) AS tiles_h FROM tiles""",
    "tile_ratios": """SELECT CAST(i AS INTEGER) AS tiles_w, CAST(j AS INTEGER) AS tiles_h, count(document_index) AS pages
FROM ratios LEFT JOIN tiles ON tiles_w = i AND tiles_h = j GROUP BY ALL""",
    "tile_boxes": """SELECT document_index, page_index, k AS tile_index, k % tiles_w * 768 AS left, k // tiles_w * 768 AS top,
  (k % tiles_w + 1) * 768 AS right, (k // tiles_w + 1) * 768 AS bottom
FROM (SELECT *, unnest(range(0, tiles_w * tiles_h)) AS k FROM tiles)""",
    "image_tokens": """SELECT document_index, page_index,
  CAST(257 + CASE WHEN tiles_w * tiles_h > 1 THEN 144 * tiles_w * tiles_h ELSE 0 END AS BIGINT) AS image_tokens,
  257::BIGINT AS uncropped_tokens FROM tiles""",
    "ref_tags": "SELECT document_index, page_index, ref_index, label, coords, label = 'image' AS is_image FROM tags",
    "detections": "SELECT * EXCLUDE (width, height) FROM boxes",
    "wrong_detections": """SELECT document_index, page_index, ref_index, label, regexp_replace(coords, ', \\d+\\]\\]$', ']]') AS coords
FROM tags WHERE document_index % 7 = 3 AND document_index % 29 <> 7
UNION ALL SELECT document_index, page_index, ref_index, label, regexp_replace(coords, ', \\d+\\]\\]$', ']]')
FROM tags WHERE document_index % 7 = 3 AND document_index % 29 = 7 AND coords <> '[[1, 2'""",
    "clean_text": "SELECT * FROM cleaned",
    "markdown_with_tags": f"""SELECT document_index, page_index // 1024 AS part_index,
  string_agg(replace(raw_text, '{EOS}', '') || chr(10) || chr(10) || '<--- Page Split --->' || chr(10), '' ORDER BY page_index) AS markdown
FROM kept GROUP BY ALL""",
    "markdown_pages": """SELECT document_index, page_index // 1024 AS part_index,
  string_agg(linked || chr(10) || chr(10) || '<--- Page Split --->' || chr(10), '' ORDER BY page_index) AS markdown
FROM linked GROUP BY ALL""",
    "image_markdown": f"""SELECT document_index, page_index,
  CASE WHEN len(o) > 0 THEN replace(replace(replace(t, o[1], ''), '\\coloneqq', ':='), '\\eqqcolon', '=:') ELSE t END AS markdown
FROM (SELECT *, CASE WHEN len(m) > 1 THEN replace(t1, m[2], '![](images/1.jpg)' || chr(10)) ELSE t1 END AS t
  FROM (SELECT *, CASE WHEN len(m) > 0 THEN replace(raw_text, m[1], '![](images/0.jpg)' || chr(10)) ELSE raw_text END AS t1
    FROM (SELECT *,
      list_filter(regexp_extract_all(raw_text, '{TAG}', 0), lambda x: contains(x, '<|ref|>image<|/ref|>')) AS m,
      list_filter(regexp_extract_all(raw_text, '{TAG}', 0), lambda x: NOT contains(x, '<|ref|>image<|/ref|>')) AS o
      FROM formula)))""",
    "formula_tidy": "SELECT document_index, page_index, tidy AS raw_text FROM formula",
    "eval_markdown": f"""SELECT document_index, page_index, CASE WHEN len(m) > 1 THEN
    replace(replace(replace(t1, m[2], ''), repeat(chr(10), 4), repeat(chr(10), 2)), repeat(chr(10), 3), repeat(chr(10), 2)) ELSE t1 END AS markdown
FROM (SELECT *, CASE WHEN len(m) > 0 THEN
    replace(replace(replace(tidy, m[1], ''), repeat(chr(10), 4), repeat(chr(10), 2)), repeat(chr(10), 3), repeat(chr(10), 2)) ELSE tidy END AS t1
  FROM (SELECT *, regexp_extract_all(tidy, '{TAG}', 0) AS m FROM formula))""",
    "crop_manifest": """SELECT b.document_index, b.page_index, x1, y1, x2, y2,
  kept_index || '_' || (row_number() OVER (PARTITION BY b.document_index, b.page_index ORDER BY ref_index, box_index) - 1) || '.jpg' AS crop_name
FROM boxes b JOIN kept k USING (document_index, page_index) WHERE label = 'image'""",
    "layout_manifest": """SELECT b.document_index, b.page_index, kept_index, ref_index, box_index, label, x1, y1, x2, y2,
  CASE WHEN label = 'title' THEN 4 ELSE 2 END AS line_width, x1 AS label_x, greatest(0, y1 - 15) AS label_y
FROM boxes b JOIN kept k USING (document_index, page_index)""",
    "geometry_lines": """SELECT document_index, page_index, 0::BIGINT AS line_index, '--' AS line_type, document_index::DOUBLE AS x1,
  page_index::DOUBLE AS y1, 3.5::DOUBLE AS x2, -4::DOUBLE AS y2 FROM pg
UNION ALL SELECT document_index, page_index, 1, '-', 0, 1, page_count, width FROM pg""",
    "geometry_endpoints": """SELECT document_index, page_index, 0::BIGINT AS point_index, 'A' AS label, document_index::DOUBLE AS x, page_index::DOUBLE AS y FROM pg
UNION ALL SELECT document_index, page_index, 1, 'B', 3.5, -4 FROM pg""",
    "geometry_circles": """SELECT document_index, page_index, 0::BIGINT AS circle_index, 'O' AS label, width::DOUBLE AS x, height::DOUBLE AS y,
  document_index + 0.5::DOUBLE AS radius FROM pg""",
    "repeated_ngrams": f"""SELECT document_index, page_index, s + 2 AS position, before AS earlier_start
FROM (SELECT *, lag(s) OVER (PARTITION BY document_index, page_index, gram ORDER BY s) AS before FROM grams)
WHERE s - before <= {Q.REPEAT_WINDOW - Q.REPEAT_N + 1} AND gram[3] <> {Q.REPEAT_WHITELIST[0]}""",
    "snapshot_deltas": f"""SELECT document_index, page_index, snapshot, substring(chunk, snapshot * {I.SNAPSHOT_CHARS} + 1, {I.SNAPSHOT_CHARS}) AS delta FROM shots""",
    "page_batches": "SELECT * FROM placed",
    "score_batches": f"""SELECT document_index, page_index, batch_id, CASE WHEN error IS NULL THEN raw_text END AS raw_text,
  CASE WHEN error IS NULL THEN CAST(o.output_tokens AS BIGINT) END AS output_tokens, error
FROM outcome JOIN ocr o USING (document_index, page_index)""",
    "score_stream_of_pages": f"""SELECT document_index, page_index, raw_text, {_big("output_tokens")}, NULL::VARCHAR AS error FROM ocr""",
    "output_count_mismatch": """SELECT document_index, page_index, batch_id,
  CASE WHEN batch_id % 5 <> 2 THEN CAST(output_tokens AS BIGINT) END AS output_tokens,
  CASE WHEN batch_id % 5 = 2 THEN 'Model returned ' || (rows - 1) || ' outputs for ' || rows || ' inputs.' END AS error
FROM (SELECT *, count(*) OVER (PARTITION BY batch_id) AS rows FROM placed) JOIN ocr USING (document_index, page_index)""",
    "document_status": "SELECT document_index, status, error, page_count, first_failed_batch FROM gapped",
    "missing_page_status": f"""SELECT document_index, CASE WHEN e IS NULL THEN 'ok' ELSE 'failed' END AS status, e AS error
FROM (SELECT document_index, CASE WHEN page_count = 0 THEN '{C.ZERO_PAGES_ERROR}' WHEN b IS NOT NULL THEN 'fail batch ' || b
  WHEN coalesce(n, 0) < page_count THEN coalesce(n, 0) || ' of ' || page_count || ' pages' END AS e
  FROM docs LEFT JOIN (SELECT document_index, min(batch_id) FILTER (error IS NOT NULL) AS b, count(*) FILTER (error IS NULL) AS n
    FROM outcome WHERE (document_index + page_index) % 31 <> 4 GROUP BY 1) USING (document_index))""",
    "generated_pages": "SELECT document_index, page_index, batch_id FROM done",
    "active_pages": "SELECT document_index, page_index FROM pg JOIN status USING (document_index) WHERE status = 'ok'",
    "dropped_pages": "SELECT document_index, page_index FROM pg JOIN status USING (document_index) WHERE status = 'failed'",
    "failed_documents": "SELECT DISTINCT document_index FROM outcome WHERE error IS NOT NULL ORDER BY 1",
    "attach_outputs": "SELECT document_index, page_index, width, height, raw_text FROM ocr",
    "unmatched_outputs": """SELECT document_index, page_index, 'output' AS missing FROM pg WHERE page_index % 13 = 5
UNION ALL SELECT document_index, page_index + 100000, 'page' FROM pg WHERE page_index % 13 = 5""",
    "bounded_batches": f"SELECT user_id, queued_us, event_id, {_big('batch_id')}, opened_at FROM user_batches",
    "shared_batches": f"SELECT user_id, queued_us, event_id, {_big('batch_id')}, opened_at FROM shared",
    "batch_wait_stats": f"""SELECT {_big('batch_id')}, rows, requests, list_sort(list_transform(times, lambda t: closed - t))[rows // 2 + 1] AS wait_p50,
  closed - opened_at AS wait_max
FROM (SELECT batch_id, opened_at, count(*) AS rows, count(DISTINCT user_id) AS requests, list(queued_us) AS times,
  CASE WHEN count(*) >= {Q.SHARED_ROWS} THEN max(queued_us) ELSE opened_at + {Q.SHARED_WAIT_US} END AS closed
  FROM shared GROUP BY batch_id, opened_at)""",
    "document_results": f"""SELECT document_index, document_path, status, error, page_count, 0::BIGINT AS part_index, 1::BIGINT AS part_count,
  n_results, texts, {_big("n_detections", "input_tokens")}, 0::BIGINT AS cached_tokens, {_big("output_tokens")},
  CAST(input_tokens + output_tokens AS BIGINT) AS total_tokens, CAST(input_tokens AS BIGINT) AS prompt_tokens,
  CAST(output_tokens AS BIGINT) AS completion_tokens FROM results""",
    "document_parts": """SELECT document_index, p AS part_index, n AS part_count,
  CASE WHEN status = 'ok' THEN least(2, page_count - 2 * p) ELSE 0 END AS n_results
FROM (SELECT *, unnest(range(n)) AS p FROM (SELECT document_index, page_count, status,
  CASE WHEN status = 'ok' THEN greatest(page_count - 1, 0) // 2 + 1 ELSE 1 END AS n FROM status))""",
    "incomplete_documents": """SELECT document_index, any_value(s.page_count) AS page_count,
  count(*) FILTER (error IS NULL AND (document_index + page_index) % 31 <> 4) AS pages_done
FROM (SELECT * EXCLUDE (error) FROM status) s JOIN (SELECT document_index, page_index, error FROM outcome) USING (document_index)
WHERE status = 'ok' GROUP BY document_index
HAVING count(*) FILTER (error IS NULL AND (document_index + page_index) % 31 <> 4) < any_value(s.page_count)""",
    "page_usage": """SELECT document_index, page_index, CAST(p AS BIGINT) AS input_tokens, 0::BIGINT AS cached_tokens,
  CAST(n AS BIGINT) AS output_tokens, CAST(p + n AS BIGINT) AS total_tokens
FROM (SELECT document_index, page_index, n, CASE WHEN page_index % 4 = 3 THEN 0 ELSE least(n, 3) END AS p
  FROM (SELECT *, len(string_split(chunk, ' ')) AS n FROM pg))""",
    "document_usage": """SELECT document_index, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, 0::BIGINT AS cached_tokens,
  CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens,
  CAST(sum(input_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(output_tokens) AS BIGINT) AS completion_tokens
FROM cost GROUP BY 1""",
    "corpus_totals": f"""SELECT documents, succeeded, failed, {_big("pages", "input_tokens", "cached_tokens", "output_tokens")},
  CAST(input_tokens + output_tokens AS BIGINT) AS total_tokens FROM totals""",
    "generated_totals": "SELECT " + _big(
        "generated_pages", "generated_input_tokens", "generated_cached_tokens", "generated_output_tokens", "generated_total_tokens"
    ) + " FROM generated",
    "throughput": """SELECT elapsed_s, pages_per_second, tokens_per_second, generated_pages_per_second, generated_tokens_per_second FROM corpus""",
    "batch_metrics": """SELECT batch_id, count(*) AS pages, count(DISTINCT document_index) AS documents, max(preprocess_s) AS preprocess_s,
  max(generate_s) AS generate_s, round(max(preprocess_s) + max(generate_s), 6) AS total_s,
  CASE WHEN max(preprocess_s) + max(generate_s) > 0 THEN count(*) / (max(preprocess_s) + max(generate_s)) ELSE 0 END AS pages_per_second
FROM done GROUP BY batch_id""",
    "failures": "SELECT document_index, document_path, error FROM gapped WHERE status = 'failed' ORDER BY document_index",
    "stage_totals": "SELECT * FROM stages",
    "inference_stats": """SELECT pages, prompt_tokens, output_tokens, generate_s, prompt_tokens / generate_s AS prompt_tokens_per_second,
  output_tokens / generate_s AS output_tokens_per_second
FROM (SELECT CAST(sum(n) AS BIGINT) AS pages, CAST(sum(i) AS BIGINT) AS prompt_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, round(sum(g), 6) AS generate_s
  FROM (SELECT batch_id, count(*) AS n, sum(input_tokens) AS i, sum(output_tokens) AS o, max(generate_s) AS g FROM done GROUP BY 1))""",
    "request_timing": f"""SELECT request_id, CAST(round_even(total / 100, 0) AS BIGINT) AS total_ms, step, CAST(round_even(h / 100, 0) AS BIGINT) AS ms
FROM (SELECT request_id, step, h FROM step_sums
  UNION ALL SELECT request_id, step, 0 FROM request_sums, (SELECT unnest({list(C.TIMING_STEPS)}) AS step)
    WHERE step NOT IN ('gpu_generate', 'cpu_preprocess') OR (request_id, step) NOT IN (SELECT (request_id, step) FROM step_sums)
  UNION ALL SELECT request_id, '{C.UNACCOUNTED_STEP}', total - spent FROM request_sums WHERE total - spent >= 50)
JOIN request_sums USING (request_id)""",
    "request_batch_timing": """SELECT document_index, nullif(max(w), 0) AS gpu_queue_wait, CAST(sum(g) AS BIGINT) AS gpu_generate,
  CAST(sum(p) AS BIGINT) AS postprocess_cpu, count(*) AS gpu_batches
FROM (SELECT document_index, batch_id, max(queue_wait_ms) AS w, arg_min(gpu_ms, page_index) AS g, arg_min(post_ms, page_index) AS p
  FROM outcome GROUP BY ALL) GROUP BY 1""",
    "stream_bounded_batches": "SELECT user_id, queued_us, event_id, opened_at, opened_by FROM user_batches",
    "stream_usage_by_window": """SELECT epoch_us(date_trunc('hour', ts)) AS window_start_us, event_type, count(*) AS pages,
  CAST(sum(257 + event_id % 865) AS BIGINT) AS input_tokens, CAST(sum(event_id % 400) AS BIGINT) AS output_tokens,
  CAST(sum(257 + event_id % 865 + event_id % 400) AS BIGINT) AS total_tokens
FROM events
GROUP BY date_trunc('hour', ts), event_type""",
}
def _usage_json(given: str, made: str) -> str:
    """Usage object from an input and an output token count."""
    return (
        f"{{'input_tokens': {given}, 'cached_tokens': 0, 'output_tokens': {made}, 'total_tokens': {given} + {made},"
        f" 'prompt_tokens': {given}, 'completion_tokens': {made}, 'input_tokens_details': {{'cached_tokens': 0}}}}"
    )


_SPENT = {"gpu_queue_wait": "w", "gpu_generate": "g", "postprocess_cpu": "p"}
_STEPS = ", ".join(f"'{step}': {_SPENT.get(step, 0)}" for step in C.TIMING_STEPS)
_HEAD = "'document_index': document_index, 'document_path': document_path, 'status': status"
QUERIES["results_jsonl"] = f"""SELECT document_index, CASE WHEN status = 'failed'
  THEN CAST(to_json({{{_HEAD}, 'error': error, 'page_count': page_count, 'part_index': 0, 'part_count': 1, 'results': CAST([] AS VARCHAR[]),
    'usage': {_usage_json("0", "0")}}}) AS VARCHAR)
  ELSE CAST(to_json({{{_HEAD}, 'page_count': page_count, 'part_index': 0, 'part_count': 1, 'results': page_lists.results,
    'usage': {_usage_json("CAST(input_tokens AS BIGINT)", "CAST(output_tokens AS BIGINT)")}}}) AS VARCHAR) END AS value
FROM results LEFT JOIN page_lists USING (document_index)"""
QUERIES["one_line_results"] = f"""SELECT replace(value, '"part_index":0,"part_count":1,', '') AS value FROM ({QUERIES["results_jsonl"]})"""
QUERIES["named_markdown_files"] = f"""SELECT replace(document_path, '.pdf', '_det.mmd') AS file, string_agg(markdown, '' ORDER BY part_index) AS markdown
FROM ({QUERIES["markdown_with_tags"]}) JOIN docs USING (document_index) GROUP BY 1"""
QUERIES["request_responses"] = f"""SELECT document_index AS request_id, 0::BIGINT AS part_index,
  CASE WHEN status = 'failed' THEN 500 ELSE 200 END AS status_code,
  CASE WHEN status = 'failed' THEN CAST(to_json({{'detail': error}}) AS VARCHAR)
  ELSE CAST(to_json({{'page_count': page_count, 'results': page_lists.results,
    'usage': {_usage_json("CAST(input_tokens AS BIGINT)", "CAST(output_tokens AS BIGINT)")}}}) AS VARCHAR) END AS body,
  CAST(to_json({{'total_ms': w + g + p, 'steps': {{{_STEPS}}}}}) AS VARCHAR) AS timing
FROM results LEFT JOIN page_lists USING (document_index) LEFT JOIN (
  SELECT document_index, max(w) AS w, CAST(sum(g) AS BIGINT) AS g, CAST(sum(p) AS BIGINT) AS p
  FROM (SELECT document_index, batch_id, max(queue_wait_ms) AS w, arg_min(gpu_ms, page_index) AS g, arg_min(post_ms, page_index) AS p
    FROM outcome GROUP BY ALL) GROUP BY 1) USING (document_index)"""
QUERIES["metrics_json"] = """SELECT CAST(to_json({'cached_tokens': 0, 'documents': documents, 'elapsed_s': elapsed_s, 'failed': failed,
  'generate_s': generate_s, 'generated_cached_tokens': 0, 'generated_input_tokens': CAST(generated_input_tokens AS BIGINT),
  'generated_output_tokens': CAST(generated_output_tokens AS BIGINT), 'generated_pages': generated_pages,
  'generated_pages_per_second': generated_pages_per_second, 'generated_tokens_per_second': generated_tokens_per_second,
  'generated_total_tokens': CAST(generated_total_tokens AS BIGINT), 'inference_s': inference_s,
  'input_tokens': CAST(input_tokens AS BIGINT), 'output_tokens': CAST(output_tokens AS BIGINT), 'pages': CAST(pages AS BIGINT),
  'pages_per_second': pages_per_second, 'preprocess_s': preprocess_s, 'render_s': render_s, 'succeeded': succeeded,
  'tokens_per_second': tokens_per_second, 'total_tokens': CAST(total_tokens AS BIGINT)}) AS VARCHAR) AS value FROM corpus"""
QUERIES["facts_batch_metrics"] = QUERIES["batch_metrics"]
_DONE = "FILTER (error IS NULL)"
_DONE_USAGE = f"""CAST(count(*) {_DONE} AS BIGINT) AS pages_done, CAST(coalesce(sum(input_tokens) {_DONE}, 0) AS BIGINT) AS input_tokens,
  0::BIGINT AS cached_tokens, CAST(coalesce(sum(output_tokens) {_DONE}, 0) AS BIGINT) AS output_tokens,
  CAST(coalesce(sum(input_tokens + output_tokens) {_DONE}, 0) AS BIGINT) AS total_tokens"""
QUERIES["page_facts"] = f"""SELECT document_index, batch_id, count(*) AS pages, {_DONE_USAGE},
  max(preprocess_s) AS preprocess_s, max(generate_s) AS generate_s, any_value(error) AS error
FROM outcome GROUP BY document_index, batch_id"""
QUERIES["facts_document_status"] = f"""SELECT document_index, status, s.error, first_failed_batch, coalesce(pages_done, 0) AS pages_done,
  {", ".join(f"CASE WHEN status = 'ok' THEN coalesce({name}, 0) ELSE 0 END AS {name}" for name in ("input_tokens", "cached_tokens", "output_tokens", "total_tokens"))}
FROM status s LEFT JOIN (SELECT document_index, {_DONE_USAGE} FROM outcome GROUP BY 1) u USING (document_index)"""
QUERIES["stream_snapshot_deltas"] = QUERIES["snapshot_deltas"]
QUERIES["stream_scored_pages"] = """SELECT request_id, page_index, chunk AS raw_text,
  CAST(len(string_split(chunk, ' ')) AS BIGINT) AS output_tokens, NULL::VARCHAR AS error
FROM bodies JOIN pg ON request_id = document_index WHERE NOT broken AND NOT bad_image"""
QUERIES["raw_requests"] = f"""SELECT document_index AS request_id, kind,
  CASE WHEN document_index % 5 = 3 THEN '<image>' || chr(10) || 'Free OCR.'
    ELSE '<image>' || chr(10) || '<|grounding|>Convert the document to markdown.' END AS prompt,
  CASE WHEN document_index % 13 IN (2, 5) THEN CASE kind WHEN 'pdf' THEN '{C.EMPTY_PDF_ERROR}' ELSE '{C.EMPTY_IMAGE_ERROR}' END END AS error
FROM (SELECT *, CASE WHEN document_index % 2 = 0 THEN 'pdf' ELSE 'image' END AS kind FROM docs)"""
# What a wave leaves ahead depends on the wave before it; every 97th batch fails.
COMMON["doc_span"] = """
SELECT document_index, sum(page_count) OVER (ORDER BY document_index) - page_count AS s,
  sum(page_count) OVER (ORDER BY document_index) AS e FROM docs WHERE page_count > 0"""
RECURSIVE["wave_plan"] = f"""
SELECT 0::BIGINT AS wave, 0::BIGINT AS begins, 0::BIGINT AS b, {W.FIRST_WAVE}::BIGINT AS size
UNION ALL
SELECT wave + 1, begins_next, b + size,
  CASE WHEN (b + (least(stop, total) - begins - 1) // {I.BATCH_PAGES} + 94) // 97 > (b + 93) // 97
    THEN greatest({W.FIRST_WAVE}, size // 2) ELSE size * 2 END
FROM (SELECT w.*, CAST(CASE WHEN e > stop AND (b + size - 1 + 94) // 97 > (b + (greatest(s, begins) - begins) // {I.BATCH_PAGES} + 93) // 97
    THEN e ELSE stop END AS BIGINT) AS begins_next
  FROM (SELECT *, begins + size * {I.BATCH_PAGES} AS stop, (SELECT max(e) FROM doc_span) AS total FROM wave_plan) w
  JOIN doc_span d ON d.s < least(stop, total) AND d.e >= least(stop, total))
WHERE begins_next < total"""
QUERIES["wave_scoring"] = f"""SELECT document_index, page_index, wave, batch_id,
  CASE WHEN batch_id % 97 <> 3 THEN output_tokens END AS output_tokens,
  CASE WHEN batch_id % 97 = 3 THEN 'fail batch ' || batch_id END AS error
FROM (SELECT document_index, page_index, wave, b + CAST(s + page_index - begins AS BIGINT) // {I.BATCH_PAGES} AS batch_id, output_tokens
  FROM ocr JOIN doc_span USING (document_index) JOIN wave_plan
    ON s + page_index >= begins AND s + page_index < begins + size * {I.BATCH_PAGES})"""
COMMON["closed"] = f"""
SELECT *, CASE WHEN rows = {Q.QUEUE_ROWS} THEN 'full' WHEN later IS NULL THEN 'idle' ELSE 'next' END AS reason,
  CASE WHEN rows = {Q.QUEUE_ROWS} THEN latest ELSE opened_at + {Q.WAIT_US} END AS closed_at
FROM (SELECT user_id, batch_id, opened_at, opened_by, count(*) AS rows, max(queued_us) AS latest, list(queued_us) AS times,
    count(DISTINCT event_type) AS requests, lead(opened_at) OVER (PARTITION BY user_id ORDER BY batch_id) AS later
  FROM user_batches JOIN (SELECT event_id, event_type FROM events) USING (event_id) GROUP BY user_id, batch_id, opened_at, opened_by)"""
QUERIES["stream_closed_batches"] = """SELECT user_id, opened_at, opened_by, closed_at, reason, rows, requests,
  list_sort(list_transform(times, lambda t: closed_at - t))[rows // 2 + 1] AS wait_p50, closed_at - opened_at AS wait_max FROM closed"""
QUERIES["stream_microbatches"] = """SELECT user_id, event_id, event_type AS request, opened_at, opened_by, rows AS batch_rows,
  closed_at - queued_us AS wait,
  CASE WHEN user_id % 7 <> 3 THEN event_type || ' ' || event_id END AS raw_text,
  CASE WHEN user_id % 7 <> 3 THEN CAST(2 AS BIGINT) END AS output_tokens,
  CASE WHEN user_id % 7 = 3 THEN 'model down' END AS error
FROM user_batches JOIN (SELECT event_id, event_type FROM events) USING (event_id) JOIN closed USING (user_id, batch_id, opened_at, opened_by)"""
QUERIES["stream_completed_documents"] = """SELECT document_index, status, error, page_count,
  CASE status WHEN 'ok' THEN i ELSE 0 END AS input_tokens, CAST(0 AS BIGINT) AS cached_tokens,
  CASE status WHEN 'ok' THEN o ELSE 0 END AS output_tokens, CASE status WHEN 'ok' THEN i + o ELSE 0 END AS total_tokens
FROM status JOIN (SELECT document_index, CAST(sum(input_tokens) AS BIGINT) AS i, CAST(sum(output_tokens) AS BIGINT) AS o FROM cost GROUP BY 1)
  USING (document_index)"""
QUERIES["stream_documents_in_order"] = """SELECT document_index, document_path, status, error, document_index AS sequence FROM gapped"""
QUERIES["stream_request_timing"] = QUERIES["request_timing"]
QUERIES["stream_repeated_ngrams"] = QUERIES["repeated_ngrams"]
QUERIES["stream_pages"] = QUERIES["decode_batch_requests"]


def _mentioned(sql: str, names: list[str]) -> set[str]:
    return {name for name in names if re.search(rf"\b{name}\b", sql)}


def oracle_sql() -> dict[str, str]:
    """Complete SQL text of every query that SQL can express."""
    parts = {**COMMON, **RECURSIVE}
    order = [*COMMON, *RECURSIVE]
    texts = {}
    for name, sql in QUERIES.items():
        needed: set[str] = set()
        fresh = _mentioned(sql, order)
        while fresh:
            needed |= fresh
            fresh = set().union(*[_mentioned(parts[part], order) for part in fresh]) - needed
        # A part stands before those that use it; chains may use later parts.
        ordered: list[str] = []

        def place(part: str) -> None:
            if part in ordered:
                return
            for used in sorted(_mentioned(parts[part], order) - {part}):
                place(used)
            ordered.append(part)

        for part in sorted(needed):
            place(part)
        clauses = ",\n".join(f"{part} AS ({parts[part]})" for part in ordered)
        recursive = "RECURSIVE " if needed & set(RECURSIVE) else ""
        texts[name] = f"WITH {recursive}{clauses}\n{sql}" if clauses else sql
    return texts
