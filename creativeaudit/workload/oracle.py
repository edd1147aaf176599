"""SQL for DuckDB that computes what the queries must return.

Written from the rules, not from the Spark plans, and over the same tables.
"""

from __future__ import annotations

VIEWS = {
    "v_tags": """
  SELECT * FROM (VALUES
   ('alcohol','Alcoholic content','Drinks and bars','active',1), ('gambling','Gambling and betting','','active',2),
   ('vaping','Vaping products','','active',3), ('junk_food','Junk food','Fast food','active',4),
   ('dog','dog','','active',5), ('saloon','Saloon and barber','','retired',6)) t(slug,label,description,status,sort_order)""",
    "v_thresholds": """
  SELECT * FROM (VALUES
   ('alcohol',true,'v2',0.69::DOUBLE,0.93::DOUBLE), ('gambling',true,'v1',0.80,0.90),
   ('vaping',true,NULL,0.75,0.60), ('junk_food',false,'v2',NULL,NULL))
   t(slug,calibrated,packs_version_seen,"precision",recall)""",
    "v_raw": """
  SELECT creative_id, frame_index, tag, role,
         CASE WHEN m < 2 THEN true WHEN m < 4 THEN NULL ELSE false END AS present, sc AS score
  FROM (SELECT c.conv_id AS creative_id, c.turn AS frame_index, t.tag, c.role,
               (length(c.text) + t.ord*5 + c.turn) % 10 AS m,
               CAST((c.conv_id*31 + c.turn*17 + t.ord*11) % 20 AS DOUBLE) / 20 AS sc
        FROM conversations c
        CROSS JOIN (VALUES (0,'alcohol'),(1,'gambling'),(2,'vaping'),(3,'junk_food')) t(ord,tag)) x""",
    "v_decided": """
  SELECT r.*, CASE WHEN present IS NULL THEN 'low' WHEN score >= 0.85 THEN 'high' WHEN score >= 0.60 THEN 'medium' ELSE 'low' END AS confidence,
         CASE WHEN present IS NULL THEN 'uncertain' WHEN present THEN 'present' ELSE 'absent' END AS band,
         CASE tag WHEN 'alcohol' THEN true WHEN 'vaping' THEN true ELSE false END AS calibrated_effective
  FROM v_raw r""",
    "v_collapsed": """
  SELECT * FROM (
    SELECT d.*, row_number() OVER (PARTITION BY creative_id, tag ORDER BY
             CASE band WHEN 'present' THEN 2 WHEN 'uncertain' THEN 1 ELSE 0 END DESC, score DESC, frame_index) AS rn
    FROM v_decided d) WHERE rn = 1""",
    "v_requests": """
  SELECT event_id AS request_id, user_id AS api_key_id, ts AS created_at,
         CAST(floor(value) AS INT) % 50 AS creative_id,
         CASE event_type WHEN 'click' THEN 'alcohol,vaping' WHEN 'view' THEN 'vaping,alcohol'
              WHEN 'purchase' THEN 'gambling' WHEN 'signup' THEN 'alcohol,alcohool' ELSE 'junk_food' END AS tags,
         CASE event_type WHEN 'click' THEN 'alcohol,vaping' WHEN 'view' THEN 'alcohol,vaping'
              WHEN 'purchase' THEN 'gambling' WHEN 'signup' THEN 'alcohol,alcohool' ELSE 'junk_food' END AS sorted_tags,
         CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 'v1' ELSE 'v2' END AS packs_version,
         CAST(floor(value*10) AS INT) AS latency_ms, CAST(1 + event_id % 6 AS INT) AS frames,
         event_type IN ('click','view') AS cached
  FROM events""",
    "v_keys": """
  SELECT c_custkey AS id, c_name AS name, md5(c_name) AS key_prefix, CAST(1 + c_custkey % 3 AS INT) AS rate_limit_per_min,
         CASE WHEN c_acctbal < 500 THEN TIMESTAMP '2024-01-10 00:00:00' END AS revoked_at,
         TIMESTAMP '2023-01-01 00:00:00' + to_days(c_nationkey) AS created_at
  FROM customer""",
    "v_catalog": """
  SELECT replace(p_name,' ','_') || '_' || p_partkey AS slug,
         p_name || CASE WHEN p_type = 'PROMO' THEN ' ' || p_brand ELSE '' END AS label,
         CASE WHEN p_size < 10 THEN '' ELSE p_type END AS description,
         CASE WHEN p_size > 40 THEN 'retired' ELSE 'active' END AS status, p_size AS sort_order
  FROM part""",
    "v_part_thresholds": """
  SELECT replace(p_name,' ','_') || '_' || p_partkey AS slug, p_size % 2 = 0 AS calibrated,
         CASE WHEN p_size < 15 THEN 'v2' WHEN p_size < 30 THEN 'v1' END AS packs_version_seen,
         p_size / 100.0::DOUBLE AS "precision", CASE WHEN p_size <= 40 THEN (100 - p_size) / 100.0::DOUBLE END AS recall
  FROM part WHERE p_type <> 'SMALL'""",
    "v_order_catalogs": """
  SELECT l_orderkey AS catalog_id, 'tag_' || l_partkey AS slug, any_value(p_name) AS label,
         CASE WHEN max(l_returnflag) = 'R' THEN 'retired' ELSE 'active' END AS status,
         CAST(min(l_linenumber) AS INT) AS sort_order
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, l_partkey""",
    "v_eval": """
  SELECT a.arm, d.doc_id AS item, o.owner, o.is_positive, t.tag, d.source AS evidence, d.n_chars AS latency_ms,
         CASE WHEN (d.n_chars + t.ord*a.step) % a.modulus < 2 THEN 'present'
              WHEN (d.n_chars + t.ord*a.step) % a.modulus = 2 THEN 'uncertain' ELSE 'absent' END AS band
  FROM documents d
  JOIN (SELECT doc_id, quality = 1 AS is_positive,
               CASE doc_id % 5 WHEN 0 THEN 'alcohol' WHEN 1 THEN 'gambling' WHEN 2 THEN 'vaping'
                               WHEN 3 THEN 'junk_food' ELSE 'education' END AS owner
        FROM labels) o ON o.doc_id = d.doc_id
  CROSS JOIN (VALUES (0,'alcohol'),(1,'gambling'),(2,'vaping'),(3,'junk_food'),(4,'dog')) t(ord,tag)
  CROSS JOIN (VALUES ('baseline',3,7),('candidate',5,9)) a(arm,step,modulus)""",
    "v_recall": """
  SELECT arm, tag, CAST(sum(CASE WHEN is_positive AND tag = owner THEN 1 ELSE 0 END) AS BIGINT) AS positives,
         CAST(sum(CASE WHEN is_positive AND tag = owner AND band = 'present' THEN 1 ELSE 0 END) AS BIGINT) AS tp,
         CAST(sum(CASE WHEN is_positive AND tag = owner AND band = 'uncertain' THEN 1 ELSE 0 END) AS BIGINT) AS unsure
  FROM v_eval GROUP BY arm, tag HAVING count(*) FILTER (WHERE tag = owner) > 0""",
    "v_fire": """
  SELECT arm, tag, count(*) AS false_blocks FROM v_eval WHERE band = 'present' AND tag <> owner GROUP BY arm, tag""",
    "v_items": "SELECT DISTINCT arm, item, owner, is_positive, latency_ms FROM v_eval",
    "v_ranked": """
  SELECT arm, latency_ms, row_number() OVER (PARTITION BY arm ORDER BY latency_ms) - 1 AS i, count(*) OVER (PARTITION BY arm) AS n
  FROM v_items WHERE latency_ms <> 0""",
    "v_report": """
  SELECT a.arm, a.images, CAST(5 AS BIGINT) AS tags,
         coalesce((SELECT CAST(sum(false_blocks) AS BIGINT) FROM v_fire f WHERE f.arm = a.arm), 0) AS cross_tag_false_blocks,
         (SELECT CAST(format('{:.4f}', avg(tp / positives)) AS DOUBLE)
          FROM v_recall r WHERE r.arm = a.arm AND positives > 0) AS mean_recall,
         (SELECT CAST(format('{:.3f}', sum(unsure) / a.positives) AS DOUBLE)
          FROM v_recall r WHERE r.arm = a.arm) AS uncertain_positive_rate,
         (SELECT max(latency_ms) FROM v_ranked k WHERE k.arm = a.arm AND i = least(n - 1, CAST(floor(n*0.5) AS BIGINT))) AS p50,
         (SELECT max(latency_ms) FROM v_ranked k WHERE k.arm = a.arm AND i = least(n - 1, CAST(floor(n*0.95) AS BIGINT))) AS p95,
         (SELECT max(latency_ms) FROM v_ranked k WHERE k.arm = a.arm) AS "max"
  FROM (SELECT arm, count(*) AS images, count(*) FILTER (WHERE is_positive) AS positives FROM v_items GROUP BY arm) a""",
    "v_paths": """
  SELECT owner, label, '/data/eval/' || owner || '/' || CASE WHEN label THEN 'pos' ELSE 'neg' END || '/' || doc_id || suffix AS path, suffix
  FROM (SELECT doc_id, quality = 1 AS label,
               CASE doc_id % 5 WHEN 0 THEN 'alcohol' WHEN 1 THEN 'gambling' WHEN 2 THEN 'vaping' WHEN 3 THEN 'junk_food' ELSE 'education' END AS owner,
               CASE doc_id % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.PNG' WHEN 2 THEN '.txt' ELSE '.webp' END AS suffix
        FROM labels)""",
    "v_found": "SELECT owner, label, path FROM v_paths WHERE suffix <> '.txt'",
    "v_media": """
  SELECT 'doc/' || doc_id AS path,
         (CASE lang WHEN 'en' THEN from_hex('FFD8FF') WHEN 'fr' THEN from_hex('89504E470D0A1A0A')
                    WHEN 'de' THEN from_hex('474946383961') ELSE from_hex('') END) || encode(text) AS content,
         'image' AS kind,
         CASE lang WHEN 'en' THEN 'image/jpeg' WHEN 'fr' THEN 'image/png' WHEN 'de' THEN 'image/gif' END AS mime
  FROM documents
  UNION ALL SELECT 'page/' || page_id, from_hex('1A45DFA3') || encode(html), 'video', NULL FROM pages""",
    "v_frames": """
  SELECT creative_id, frame_id, signature, rn, n, (rn - 1) * 0.2::DOUBLE AS timestamp_s FROM (
    SELECT (vec_id - vec_id % 250) + label AS creative_id, vec_id AS frame_id, embedding AS signature,
           row_number() OVER (PARTITION BY (vec_id - vec_id % 250) + label ORDER BY vec_id) AS rn,
           count(*) OVER (PARTITION BY (vec_id - vec_id % 250) + label) AS n
    FROM embeddings)""",
    "v_charges": """
  SELECT request_id, api_key_id, 0 AS part, created_at AS ts, CAST(1 AS BIGINT) AS units FROM v_requests
  UNION ALL
  SELECT request_id, api_key_id, 1, created_at + to_milliseconds(latency_ms), frames - 1 FROM v_requests WHERE NOT cached AND frames > 1""",
    "v_fixed": """
  SELECT request_id, n, lim IS NOT NULL AS limit_known, n <= coalesce(lim, 0) AS admitted, greatest(0, coalesce(lim, 0) - n) AS remaining,
         greatest(1, CAST(ceil((epoch_us(w) + 86400000000 - epoch_us(ts)) / 1000000) AS BIGINT)) AS retry_after_s
  FROM (SELECT event_id AS request_id, ts, date_trunc('day', ts)::TIMESTAMP AS w, 1 + c_custkey % 3 AS lim,
               row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS n
        FROM events LEFT JOIN customer ON user_id = c_custkey)""",
    "v_outcome": """
  SELECT q.request_id, q.wanted, c.tag, c.frame_index, c.band, c.score, c.confidence,
         CASE WHEN q.hit THEN 'stored' ELSE c.role || ' turn' END AS top_phrase, c.calibrated_effective, q.hit AS cached
  FROM (SELECT r.request_id, r.creative_id, r.tags, len(string_split(r.tags, ',')) AS wanted, EXISTS (
          SELECT 1 FROM v_requests h WHERE h.creative_id = r.creative_id AND h.sorted_tags = r.sorted_tags AND h.packs_version = 'v2'
            AND h.created_at < TIMESTAMP '2024-01-20' AND h.creative_id % 3 <> 0 AND h.creative_id IN (SELECT conv_id FROM conversations)) AS hit
        FROM v_requests r WHERE r.tags NOT LIKE '%alcohool%') q
  LEFT JOIN v_collapsed c ON c.creative_id = q.creative_id AND list_contains(string_split(q.tags, ','), c.tag)
       AND (q.hit OR (c.creative_id % 11 <> 0 AND NOT (c.creative_id % 7 = 3 AND c.tag = 'vaping' AND EXISTS (
              SELECT 1 FROM conversations v WHERE v.conv_id = c.creative_id AND v.turn % 2 = 1))))""",
    "v_counters": """
  SELECT user_id AS api_key_id, date_trunc('minute', ts)::TIMESTAMP AS window_start, count(*) AS "count" FROM events GROUP BY ALL""",
    "v_cached": """
  SELECT r.request_id, first_value(h.request_id) OVER (PARTITION BY r.request_id ORDER BY h.created_at DESC, h.request_id DESC) AS hit
  FROM v_requests r JOIN v_requests h ON h.creative_id = r.creative_id AND h.sorted_tags = r.sorted_tags
       AND h.packs_version = 'v2' AND h.created_at < TIMESTAMP '2024-01-20'""",
    "v_reply": """
  SELECT conv_id AS creative_id, turn AS frame_index, role, length(text) AS n, conv_id % 13 = 5 AS broken, conv_id % 17 = 4 AS odd FROM conversations""",
    "v_answers": """
  SELECT creative_id, frame_index, role, n, 'alcohol' AS slug,
         CASE WHEN n % 11 IN (0,1) THEN NULL WHEN n % 3 = 0 THEN true WHEN n % 3 = 1 THEN NULL ELSE false END AS present,
         CASE WHEN n % 11 = 0 THEN 'present is not true, false or null' WHEN n % 11 = 1 THEN 'present missing' END AS error
  FROM v_reply WHERE n % 29 <> 0 AND NOT broken
  UNION ALL SELECT creative_id, frame_index, role, n, 'vaping', false, NULL FROM v_reply WHERE n % 29 <> 0 AND n % 13 <> 0 AND NOT broken
  UNION ALL SELECT creative_id, frame_index, role, n, 'surprise', true, NULL FROM v_reply WHERE n % 29 <> 0 AND n % 17 = 0 AND NOT broken
  UNION ALL SELECT creative_id, NULL, NULL, NULL, NULL, NULL, 'reply is not a frame list' FROM v_reply WHERE broken GROUP BY creative_id
  UNION ALL SELECT creative_id, NULL, NULL, NULL, NULL, NULL, 'frame index missing or not an integer' FROM v_reply WHERE odd AND NOT broken GROUP BY creative_id
  UNION ALL SELECT creative_id, NULL, NULL, NULL, NULL, NULL, NULL FROM v_reply WHERE NOT odd AND NOT broken GROUP BY creative_id HAVING bool_and(n % 29 = 0)""",
}


def _needed(sql: str) -> list[str]:
    """The views a text uses, each after the views it uses itself."""
    import re

    order: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in order and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                order.append(name)

    visit(sql)
    return order


def _with(sql: str, recursive: str = "") -> str:
    ctes = [f"{name} AS ({VIEWS[name]})" for name in _needed(sql + recursive)]
    if recursive:
        ctes.append(recursive)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(ctes) + "\n" if ctes else "") + sql


ORACLE: dict[str, str] = {}


def oracle(name: str, sql: str, recursive: str = "") -> None:
    ORACLE[name] = _with(sql.strip(), recursive.strip())


STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"

# ---- verdicts
oracle("collapse_verdicts", """
SELECT creative_id, tag, frame_index, present, score, confidence, band, calibrated_effective FROM v_collapsed""")
oracle("decide", "SELECT creative_id, frame_index, tag, score, confidence, band, 'vlm' AS decided_by FROM v_decided")
oracle("threshold_join", """
SELECT r.creative_id, r.frame_index, r.tag, coalesce(t.calibrated, false) AS calibrated, t.packs_version_seen, t."precision", t.recall
FROM v_raw r LEFT JOIN v_thresholds t ON t.slug = r.tag""")
oracle("effective_calibrated", """
SELECT c.slug, coalesce(t.calibrated, false) AND (t.packs_version_seen IS NULL OR t.packs_version_seen = 'v2') AS calibrated_effective
FROM v_catalog c LEFT JOIN v_part_thresholds t ON t.slug = c.slug""")
oracle("band_counts", """
SELECT creative_id, count(*) FILTER (WHERE band = 'present') AS present, count(*) FILTER (WHERE band = 'uncertain') AS uncertain,
       count(*) FILTER (WHERE band = 'absent') AS absent FROM v_collapsed GROUP BY creative_id""")
oracle("frame_coverage", """
SELECT conv_id AS creative_id, n AS analyzed, greatest(n, c) AS considered, c > n AS partial
FROM (SELECT conv_id, count(DISTINCT turn) AS n, count(*) - 1 + max(length(text)) % 3 AS c FROM conversations GROUP BY conv_id)""")
oracle("uncalibrated_tags", """
SELECT creative_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM v_collapsed WHERE NOT calibrated_effective GROUP BY creative_id""")
oracle("verdict_json", """
SELECT creative_id, '{"results":[' || string_agg('{"tag":"' || tag || '","present":' || coalesce(CAST(present AS VARCHAR), 'null') || ',"score":' || score ||
         ',"confidence":"' || confidence || '","decided_by":"vlm","calibrated":' || calibrated_effective || ',"evidence":{"top_phrase":"' || role ||
         ' turn","crop":null,"sigmoid":null' || CASE WHEN n > 4 THEN ',"frame":{"index":' || frame_index || ',"timestamp_s":' || (frame_index * 0.5::DOUBLE) || '}' ELSE '' END ||
         '}}', ',' ORDER BY tag) || ']' ||
       coalesce(',"uncalibrated_tags":[' || string_agg('"' || tag || '"', ',' ORDER BY tag) FILTER (WHERE NOT calibrated_effective) || ']', '') ||
       CASE WHEN any_value(n) > 4 THEN ',"media":{"kind":"video","duration_s":' || (any_value(n) * 0.5::DOUBLE) || ',"frames_analyzed":' || any_value(n) ||
            ',"frames_considered":' || any_value(n) || '}' ELSE '' END || '}' AS body_json
FROM v_collapsed JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) s ON conv_id = creative_id GROUP BY creative_id""")
oracle("response_json", """
SELECT r.request_id, '{"request_id":' || r.request_id || ',"image_hash":"' || sha256(CAST(r.creative_id AS VARCHAR)) || '","image_bytes":' || (r.creative_id * 1000 + 512) ||
       ',"model":"vlm","packs_version":"' || any_value(r.packs_version) || '","decision_version":' || CASE WHEN any_value(r.packs_version) = 'v2' THEN '"rule-1"' ELSE 'null' END ||
       ',"cached":' || any_value(r.cached) || ',"latency_ms":' || any_value(r.latency_ms) || ',"results":[' ||
       string_agg('{"tag":"' || tag || '","present":' || coalesce(CAST(present AS VARCHAR), 'null') || ',"score":' || score ||
         ',"confidence":"' || confidence || '","decided_by":"vlm","calibrated":' || calibrated_effective || ',"evidence":{"top_phrase":"' || role ||
         ' turn","crop":null,"sigmoid":null}}', ',' ORDER BY tag) || ']' ||
       coalesce(',"uncalibrated_tags":[' || string_agg('"' || tag || '"', ',' ORDER BY tag) FILTER (WHERE NOT calibrated_effective) || ']', '') || '}' AS response_json
FROM v_requests r JOIN v_collapsed c ON c.creative_id = r.creative_id AND list_contains(string_split(r.tags, ','), c.tag)
GROUP BY r.request_id, r.creative_id""")
oracle("decision_version", """
SELECT substr(sha256('rule-1|0.85|0.6|6|0.35|8.0|' || string_agg(b || h, '' ORDER BY b) || '|fallback:=false:~:~:~'), 1, 12) AS decision_version
FROM (SELECT substr(d, 1, 3) AS b, sha256(string_agg(d, '' ORDER BY d)) AS h
      FROM (SELECT sha256('=' || slug || ':=' || calibrated || ':' || coalesce('=' || packs_version_seen, '~') || ':' ||
                          coalesce('=' || CAST("precision" AS VARCHAR), '~') || ':' || coalesce('=' || CAST(recall AS VARCHAR), '~')) AS d
            FROM v_part_thresholds) GROUP BY 1)""")
oracle("verdict_display", """
SELECT creative_id, band, tag, score, CAST(row_number() OVER (PARTITION BY creative_id, band ORDER BY score DESC, tag) AS INT) AS position
FROM v_collapsed""")
oracle("review_queue", """
SELECT creative_id, count(*) FILTER (WHERE band = 'uncertain') AS n_uncertain, count(*) FILTER (WHERE confidence = 'low') AS n_low,
       string_agg(tag, ',' ORDER BY tag) FILTER (WHERE band = 'uncertain') AS tags
FROM v_collapsed GROUP BY creative_id HAVING count(*) FILTER (WHERE band = 'uncertain') > 0""")
oracle("redecide", """
SELECT q.request_id, c.tag, CASE WHEN c.band = 'present' THEN 'present' ELSE 'absent' END AS old_band, c.band AS new_band,
       c.confidence, c.calibrated_effective, c.band = 'uncertain' AS flipped
FROM v_requests q JOIN v_collapsed c ON c.creative_id = q.creative_id
WHERE list_contains(string_split(q.tags, ','), c.tag)""")

# ---- answers
oracle("unknown_tag_gate", """
SELECT request_id, CASE WHEN tags LIKE '%alcohool%' THEN 'alcohool' ELSE '' END AS unknown, tags NOT LIKE '%alcohool%' AS accepted
FROM v_requests""")
oracle("fixture_scorer", """
SELECT s.creative_id, s.frame_index, s.tag, f.present, CASE WHEN f.present IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS score,
       CASE WHEN f.slug IS NULL THEN 'no fixture for this image; answering uncertain'
            ELSE 'fixture says ' || CASE WHEN f.present IS NULL THEN 'None' WHEN f.present THEN 'True' ELSE 'False' END END AS top_phrase,
       'vlm' AS decided_by
FROM (SELECT conv_id AS creative_id, turn AS frame_index, text, unnest(['alcohol','gambling','vaping','junk_food','dog']) AS tag FROM conversations) s
LEFT JOIN (SELECT DISTINCT text, CASE WHEN role = 'user' THEN 'alcohol' ELSE 'vaping' END AS slug,
                  CASE length(text) % 3 WHEN 0 THEN true WHEN 1 THEN false END AS present FROM conversations) f
ON f.text = s.text AND f.slug = s.tag""")
oracle("tristate_strict", """
SELECT creative_id, frame_index, slug, present, round((10 + n % 80) / 100.0::DOUBLE, 2) AS confidence, role AS evidence, error FROM v_answers""")
oracle("reply_completeness", """
SELECT f.creative_id, m.missing = '' AND u.unexpected = '' AND f.sent = f.answered AS complete, m.missing, u.unexpected
FROM (SELECT creative_id, count(*) AS sent,
             count(*) FILTER (WHERE n % 29 <> 0 AND NOT broken) + max(CASE WHEN odd AND NOT broken THEN 1 ELSE 0 END) AS answered FROM v_reply GROUP BY creative_id) f
JOIN (SELECT creative_id, coalesce(string_agg(x, ',' ORDER BY x), '') AS missing FROM (
        SELECT creative_id, CASE WHEN broken OR n % 29 = 0 THEN frame_index || ':alcohol' END AS x FROM v_reply
        UNION ALL SELECT creative_id, CASE WHEN broken OR n % 29 = 0 OR n % 13 = 0 THEN frame_index || ':vaping' END FROM v_reply) GROUP BY creative_id) m
  ON m.creative_id = f.creative_id
JOIN (SELECT creative_id, coalesce(string_agg(CASE WHEN NOT broken AND n % 29 <> 0 AND n % 17 = 0 THEN frame_index || ':surprise' END, ',' ORDER BY frame_index), '') AS unexpected
      FROM v_reply GROUP BY creative_id) u ON u.creative_id = f.creative_id""")
oracle("tag_set_diff", """
SELECT request_id, array_to_string(list_sort(list_filter(w, lambda x: NOT list_contains(s, x))), ',') AS missing,
       array_to_string(list_sort(list_filter(s, lambda x: NOT list_contains(w, x))), ',') AS extra
FROM (SELECT request_id, string_split(tags, ',') AS w, CASE WHEN frames > 3 THEN ['alcohol','dog'] ELSE string_split(tags, ',') END AS s FROM v_requests)""")
oracle("tag_groups", """
SELECT CAST(section_no AS INT) AS section_no, CASE section_no WHEN 0 THEN 'Restricted' WHEN 1 THEN 'Food & drink' WHEN 2 THEN 'Health & lifestyle'
       WHEN 3 THEN 'Commerce & services' ELSE 'Other' END AS section, section_no = 0 AS restricted, count(DISTINCT k) AS n_tags
FROM (SELECT CASE WHEN p_size < 6 THEN 0 WHEN p_size < 10 THEN 1 WHEN p_size < 15 THEN 2 WHEN p_size < 20 THEN 3 ELSE 4 END AS section_no,
             CASE WHEN p_size < 20 THEN p_size ELSE 1000 + p_partkey END AS k FROM part) GROUP BY section_no""")
oracle("score_batch", """
SELECT c.conv_id AS creative_id, CASE WHEN b.conv_id IS NULL THEN c.turn END AS frame_index, CASE WHEN b.conv_id IS NULL THEN t.tag END AS tag,
       CASE WHEN b.conv_id IS NOT NULL OR k = 2 THEN NULL ELSE k = 0 END AS present,
       CASE WHEN b.conv_id IS NULL THEN k / 4.0::DOUBLE END AS score,
       CASE WHEN b.conv_id IS NOT NULL THEN 'ValueError: frame cannot be read' END AS error
FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS first_turn FROM conversations) c
CROSS JOIN LATERAL (SELECT ord, tag, (length(c.text) + ord) % 4 AS k FROM (VALUES (0,'alcohol'),(1,'gambling'),(2,'vaping'),(3,'junk_food')) v(ord,tag)) t
LEFT JOIN (SELECT DISTINCT conv_id FROM conversations WHERE length(text) % 23 = 0) b ON b.conv_id = c.conv_id
WHERE b.conv_id IS NULL OR (c.turn = c.first_turn AND t.ord = 0)""")

# ---- catalog
oracle("slugify", """
SELECT p_partkey, lower(replace(p_name, ' ', '_')) || '_brand_' || replace(p_brand, 'Brand#', '') AS slug, true AS usable FROM part""")
oracle("validate_tags", """
SELECT id, slug, reason IS NULL AS accepted, reason AS reject_reason FROM (
  SELECT p_partkey AS id, s AS slug,
    CASE WHEN p_size % 7 = 0 THEN 'bad slug'
         WHEN p_size % 2 = 0 AND p_size % 5 = 0 THEN CASE WHEN p_size > 40 THEN 'slug retired' ELSE 'slug in use' END
         WHEN p_size % 2 = 0 AND p_partkey % 2 = 1 AND (SELECT count(*) FROM part WHERE p_size <= 40) >= 100 THEN 'catalog full'
         WHEN p_size % 2 = 1 AND p_size % 5 <> 0 THEN 'slug cannot change'
         WHEN p_size % 11 = 0 THEN 'label required' END AS reason
  FROM (SELECT *, CASE WHEN p_size % 7 = 0 THEN '9' || b WHEN p_size % 5 = 0 THEN b ELSE b || '_new' END AS s
        FROM (SELECT *, replace(p_name,' ','_') || '_' || p_partkey AS b FROM part)))""")
oracle("thin_names", """
SELECT slug, label, 'the name is short' AS warning FROM v_catalog WHERE length(label) < 12""")
oracle("catalog_lines", """
SELECT catalog_id, string_agg('- ' || slug || ': ' || label, chr(10) ORDER BY slug) AS lines FROM v_order_catalogs
WHERE status = 'active' GROUP BY catalog_id""")
oracle("packs_version", """
SELECT catalog_id, substr(sha256('model-1|prompt-1|' || string_agg(slug || '=' || label, '|' ORDER BY slug)), 1, 12) AS packs_version
FROM v_order_catalogs WHERE status = 'active' GROUP BY catalog_id""")
oracle("catalog_stats", """
SELECT catalog_id, count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE status = 'retired') AS retired,
       100 - count(*) FILTER (WHERE status = 'active') AS headroom, CAST(max(sort_order) + 1 AS BIGINT) AS next_sort_order
FROM v_order_catalogs GROUP BY catalog_id""")
oracle("catalog_listing", """
SELECT c.slug, c.label, c.description, c.status, c.sort_order,
       coalesce(t.calibrated, false) AND (t.packs_version_seen IS NULL OR t.packs_version_seen = 'v2') AS calibrated
FROM v_catalog c LEFT JOIN v_part_thresholds t ON t.slug = c.slug WHERE c.status = 'active'""")

_LOG = """
log AS (
  SELECT user_id AS catalog_id, event_id AS seq, 'tag_' || CAST(floor(value) AS INT) % 7 AS slug, event_id % 13 = 0 AS blank,
         CASE event_type WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'create' WHEN 'view' THEN 'update' WHEN 'click' THEN 'restore' ELSE 'retire' END AS op,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
cat AS (
  SELECT c_custkey AS catalog_id, CAST(0 AS BIGINT) AS rn, NULL::BIGINT AS seq, NULL::VARCHAR AS op, NULL::VARCHAR AS slug, NULL::VARCHAR AS reason,
         ['tag_0'] AS act, ['tag_0','tag_1'] AS known FROM customer
  UNION ALL
  SELECT catalog_id, rn, seq, op, slug, reason,
         CASE WHEN reason IS NULL AND op IN ('create','restore') THEN list_append(act, slug)
              WHEN reason IS NULL AND op = 'retire' THEN list_filter(act, lambda x: x <> slug) ELSE act END,
         CASE WHEN reason IS NULL AND op = 'create' THEN list_append(known, slug) ELSE known END
  FROM (SELECT l.catalog_id, l.rn, l.seq, l.op, l.slug, s.act, s.known,
         CASE WHEN l.op = 'create' THEN CASE WHEN list_contains(s.act, l.slug) THEN 'slug in use' WHEN list_contains(s.known, l.slug) THEN 'slug retired'
                     WHEN len(s.act) >= 4 THEN 'catalog full' WHEN l.blank THEN 'label required' END
              WHEN NOT list_contains(s.known, l.slug) THEN 'no such tag'
              WHEN l.op = 'update' AND l.blank THEN 'label required'
              WHEN l.op = 'restore' AND list_contains(s.act, l.slug) THEN 'already active'
              WHEN l.op = 'restore' AND len(s.act) >= 4 THEN 'catalog full' END AS reason
        FROM cat s JOIN log l ON l.catalog_id = s.catalog_id AND l.rn = s.rn + 1))"""
oracle("catalog_changes", "SELECT catalog_id, seq, op, slug, reason AS reject_reason FROM cat WHERE reason IS NOT NULL", _LOG)
oracle("catalog_snapshot", """
SELECT f.catalog_id, u.slug, coalesce('Label ' || e.seq, 'Seeded') AS label,
       coalesce(d.event_type, '') AS description,
       CASE WHEN list_contains(f.act, u.slug) THEN 'active' ELSE 'retired' END AS status,
       CAST(list_position(f.known, u.slug) AS BIGINT) AS sort_order,
       CASE WHEN a.seq IS NOT NULL THEN 'admin' END AS updated_by, strftime(w.ts, '%Y-%m-%d %H:%M:%S') AS updated_at
FROM (SELECT *, row_number() OVER (PARTITION BY catalog_id ORDER BY rn DESC) AS back FROM cat) f
CROSS JOIN LATERAL (SELECT unnest(f.known) AS slug) u
LEFT JOIN (SELECT catalog_id, slug, max(seq) AS seq FROM cat WHERE reason IS NULL AND op IN ('create','update') GROUP BY catalog_id, slug) e
  ON e.catalog_id = f.catalog_id AND e.slug = u.slug
LEFT JOIN events d ON d.event_id = e.seq
LEFT JOIN (SELECT catalog_id, slug, max(seq) AS seq FROM cat WHERE reason IS NULL AND op IS NOT NULL GROUP BY catalog_id, slug) a
  ON a.catalog_id = f.catalog_id AND a.slug = u.slug
LEFT JOIN events w ON w.event_id = a.seq
WHERE f.back = 1""", _LOG)

# ---- intake
oracle("media_inventory", """
SELECT path, sha256(content) AS media_hash, octet_length(content) AS n_bytes, kind, mime,
       CASE WHEN kind = 'image' AND octet_length(content) > 20000 THEN 'IMAGE_TOO_LARGE'
            WHEN kind = 'video' AND octet_length(content) > 6000 THEN 'VIDEO_TOO_LARGE'
            WHEN kind = 'image' AND mime IS NULL THEN 'INVALID_IMAGE' END AS reject_code FROM v_media""")
oracle("sniff_media", "SELECT kind, mime, count(*) AS n FROM v_media GROUP BY kind, mime")
oracle("intake_gate", """
SELECT doc_id, CASE WHEN b = 0 THEN 'INVALID_IMAGE' WHEN lang = 'en' THEN CASE WHEN b > 4000 THEN 'IMAGE_TOO_LARGE' END
       WHEN b > 9000 THEN 'VIDEO_TOO_LARGE' WHEN n_chars % 900 > 600 THEN 'VIDEO_TOO_LONG' WHEN n_chars % 4 = 0 THEN 'INVALID_VIDEO' END AS reject_code
FROM (SELECT *, n_chars - n_chars % 10 AS b FROM documents)""")
oracle("content_dedupe", """
SELECT sha256(text) AS media_hash, min(doc_id) AS first_id, count(*) AS n_copies FROM documents GROUP BY text""")
oracle("url_guard", """
SELECT page_id, scheme, host, allowed, CASE WHEN NOT allowed THEN 'INVALID_IMAGE_URL' END AS reject_code FROM (
  SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'ftp' WHEN page_id % 11 = 0 THEN 'http' ELSE split_part(url, ':', 1) END AS scheme,
         CASE WHEN page_id % 9 = 0 THEN 'x.example' WHEN page_id % 11 = 0 THEN '10.1.2.' || page_id % 200
              ELSE lower(regexp_extract(url, '^https?://([^/:?#]*)', 1)) END AS host,
         page_id % 9 <> 0 AND page_id % 11 <> 0 AND page_id % 5 <> 0 AND page_id % 7 <> 0 AND page_id % 13 <> 0 AS allowed FROM pages)""")
oracle("request_intake", """
SELECT doc_id AS request_id, CASE WHEN k = 1 THEN 'alcohol,vaping' WHEN k IN (2,3,4,6) THEN 'dog' ELSE '' END AS tags,
       CASE WHEN k IN (1,2,5) THEN sha256(text) END AS media_hash, CASE WHEN k = 3 THEN 'http://a.example/x' END AS media_url,
       CASE k WHEN 4 THEN 'INVALID_IMAGE' WHEN 5 THEN 'NO_TAGS' WHEN 6 THEN 'NO_IMAGE' WHEN 7 THEN 'BAD_REQUEST' END AS reject_code
FROM (SELECT *, CASE WHEN source < 'src13' THEN 1 WHEN source < 'src16' THEN 2 WHEN source < 'src2' THEN 3 WHEN source < 'src4' THEN 4
                     WHEN source < 'src6' THEN 5 WHEN source < 'src8' THEN 6 ELSE 7 END AS k FROM documents)""")
oracle("normalise_tags", "SELECT request_id, tags, NULL::VARCHAR AS reject_code FROM v_requests")
oracle("client_identity", """
SELECT event_id, '10.0.0.1' AS hops0,
       CASE WHEN event_id % 11 = 0 OR event_id % 7 = 0 THEN '10.0.0.1' ELSE '203.0.113.' || user_id % 7 END AS hops1,
       CASE WHEN event_id % 11 = 0 OR event_id % 7 = 0 THEN '10.0.0.1' ELSE '10.9.9.' || event_id % 9 END AS hops5 FROM events""")
oracle("tag_key", "SELECT sorted_tags AS tag_key, count(*) AS requests FROM v_requests GROUP BY 1")
oracle("rejects", """
SELECT request_id, code, CAST(CASE code WHEN 'INVALID_KEY' THEN 401 WHEN 'RATE_LIMITED' THEN 429 ELSE 400 END AS INT) AS status FROM (
  SELECT r.request_id, CASE WHEN k.id IS NULL THEN 'INVALID_KEY'
           WHEN row_number() OVER (PARTITION BY r.api_key_id, date_trunc('day', r.created_at) ORDER BY r.created_at, r.request_id) > k.rate_limit_per_min THEN 'RATE_LIMITED'
           WHEN r.tags LIKE '%alcohool%' THEN 'UNKNOWN_TAG' END AS code
  FROM v_requests r LEFT JOIN v_keys k ON k.id = r.api_key_id AND k.revoked_at IS NULL) WHERE code IS NOT NULL""")

# ---- frames
oracle("frame_thin", """
SELECT creative_id, frame_id FROM v_frames
WHERE n <= 6 OR list_contains(list_transform(range(6), lambda i: CAST(round_even(i * ((n - 1) / 5.0::DOUBLE), 0) AS BIGINT)), rn - 1)""")
_SELECT = """
sel AS (
  SELECT creative_id, rn, frame_id, true AS kept, NULL::BIGINT AS same_as, timestamp_s AS last_ts,
         [struct_pack(id := frame_id, sig := signature)] AS held FROM v_frames WHERE rn = 1
  UNION ALL
  SELECT creative_id, rn, frame_id, NOT too_close AND hit IS NULL, CASE WHEN NOT too_close THEN hit END,
         CASE WHEN NOT too_close AND hit IS NULL THEN timestamp_s ELSE last_ts END,
         CASE WHEN NOT too_close AND hit IS NULL THEN list_append(held, struct_pack(id := frame_id, sig := signature)) ELSE held END
  FROM (SELECT f.creative_id, f.rn, f.frame_id, f.timestamp_s, f.signature, s.last_ts, s.held, f.timestamp_s - s.last_ts < {gap} - 1e-9 AS too_close,
               list_filter(s.held, lambda h: list_sum(list_transform(list_zip(h.sig, f.signature), lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE))) / len(f.signature) <= 0.13)[1].id AS hit
        FROM sel s JOIN v_frames f ON f.creative_id = s.creative_id AND f.rn = s.rn + 1))"""
oracle("frame_select", """
SELECT creative_id, frame_id, considered, NULL AS reject_code FROM (
  SELECT creative_id, frame_id, row_number() OVER (PARTITION BY creative_id ORDER BY rn) AS i, count(*) OVER (PARTITION BY creative_id) AS considered
  FROM sel WHERE kept)
WHERE considered <= 6 OR list_contains(list_transform(range(6), lambda j: CAST(round_even(j * ((considered - 1) / 5.0::DOUBLE), 0) AS BIGINT)), i - 1)
UNION ALL SELECT -vec_id - 1, NULL, 0, 'INVALID_VIDEO' FROM embeddings WHERE vec_id % 90 = 0""",
       _SELECT.replace("{gap}", "0.35"))
oracle("near_duplicate_frames", """
SELECT s.creative_id, s.same_as, s.frame_id,
       round(list_sum(list_transform(list_zip(a.signature, b.signature), lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE))) / 64, 6) AS mad
FROM sel s JOIN v_frames a ON a.frame_id = s.same_as JOIN v_frames b ON b.frame_id = s.frame_id""", _SELECT.replace("{gap}", "0.0"))
oracle("frame_fallback_merge", """
SELECT creative_id, frame_id FROM (
  SELECT *, count(*) FILTER (WHERE signature[1] > 0.2) OVER (PARTITION BY creative_id) AS k FROM v_frames)
WHERE signature[1] > 0.2 OR (k < 2 AND (n <= 6 OR list_contains(list_transform(range(6), lambda i: CAST(round_even(i * ((n - 1) / 5.0::DOUBLE), 0) AS BIGINT)), rn - 1)))""")
oracle("payload_dedupe", """
SELECT creative_id, frame_id, row_number() OVER (PARTITION BY creative_id ORDER BY frame_id) - 1 AS frame_index
FROM (SELECT conv_id AS creative_id, min(turn) AS frame_id FROM conversations GROUP BY conv_id, role || text)""")

# ---- audit
oracle("cache_lookup", """
SELECT r.request_id, h.hit AS hit_request_id, h.hit IS NOT NULL AS cached
FROM v_requests r LEFT JOIN (SELECT DISTINCT request_id, hit FROM v_cached) h ON h.request_id = r.request_id
WHERE r.created_at >= TIMESTAMP '2024-01-20'""")
oracle("audit_rows", """
SELECT q.request_id, sha256(CAST(q.creative_id AS VARCHAR)) AS image_hash, q.sorted_tags AS tags_requested, CAST(count(r.tag) AS INT) AS n_rows,
       coalesce(string_agg(r.frame_index || ':' || r.tag || ':' || coalesce(CAST(r.present AS VARCHAR), 'null') || ':' || CAST(round(r.score * 20) AS INT) || ':' || r.role || ' turn', '|'
                           ORDER BY r.frame_index, r.tag), '') AS rows, 'v1' AS packs_version, q.latency_ms, q.cached,
       strftime(q.created_at, '%Y-%m-%d') AS created_date
FROM v_requests q JOIN (SELECT DISTINCT creative_id FROM v_raw) has ON has.creative_id = q.creative_id
LEFT JOIN v_raw r ON r.creative_id = q.creative_id AND list_contains(string_split(q.tags, ','), r.tag)
GROUP BY q.request_id, q.creative_id, q.sorted_tags, q.latency_ms, q.cached, q.created_at""")
oracle("audit_by_key", """
SELECT k.id AS key_id, k.name, count(*) AS analyses, count(*) FILTER (WHERE r.cached) AS cache_hits
FROM v_requests r LEFT JOIN v_keys k ON k.id = r.api_key_id AND k.revoked_at IS NULL GROUP BY k.id, k.name""")
oracle("integrity_checks", """
SELECT 'orders' AS table_name, 'unique o_orderkey' AS constraint_name, count(*) AS violations FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)
UNION ALL SELECT 'customer', 'unique c_custkey', count(*) FROM (SELECT 1 FROM customer GROUP BY c_custkey HAVING count(*) > 1)
UNION ALL SELECT 'lineitem', 'unique l_orderkey,l_linenumber', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'labels', 'unique doc_id', count(*) FROM (SELECT 1 FROM labels GROUP BY doc_id HAVING count(*) > 1)
UNION ALL SELECT 'documents', 'unique text', count(*) FROM (SELECT 1 FROM documents GROUP BY text HAVING count(*) > 1)
UNION ALL SELECT 'lineitem', 'not null l_quantity', count(*) FROM lineitem WHERE l_quantity IS NULL
UNION ALL SELECT 'lineitem', 'not null l_shipdate', count(*) FROM lineitem WHERE l_shipdate IS NULL
UNION ALL SELECT 'customer', 'not null c_name', count(*) FROM customer WHERE c_name IS NULL
UNION ALL SELECT 'lineitem', 'foreign l_orderkey -> orders.o_orderkey', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'orders', 'foreign o_custkey -> customer.c_custkey', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'labels', 'foreign doc_id -> documents.doc_id', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'documents', 'foreign doc_id -> labels.doc_id', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'region', 'single row', count(*) - 1 FROM region""")

# ---- usage
oracle("usage_counters", f"""SELECT api_key_id, {STAMP.format('window_start')} AS window_start, "count" FROM v_counters""")
oracle("usage_today", """
SELECT api_key_id, CAST(coalesce(sum("count") FILTER (WHERE window_start >= TIMESTAMP '2024-01-20'), 0) AS BIGINT) AS requests
FROM v_counters GROUP BY api_key_id""")
oracle("analyses_today", """
SELECT api_key_id, count(*) AS analyses, count(*) FILTER (WHERE cached) AS cache_hits, CAST(round(sum(latency_ms) / count(*)) AS BIGINT) AS avg_latency_ms
FROM v_requests WHERE created_at >= TIMESTAMP '2024-01-20' GROUP BY api_key_id""")
_UNITS = """
SELECT api_key_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS window_start, CAST(sum(units) AS BIGINT) AS units
FROM v_charges GROUP BY 1, 2"""
oracle("quota_units", _UNITS)
oracle("quota_ledger", """
SELECT request_id, part, running_units, c_custkey IS NOT NULL AS limit_known, greatest(0, coalesce(1 + c_custkey % 3, 0) - running_units) AS remaining FROM (
  SELECT *, CAST(sum(units) OVER (PARTITION BY api_key_id, date_trunc('day', ts) ORDER BY ts, request_id, part
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running_units FROM v_charges)
LEFT JOIN customer ON api_key_id = c_custkey""")
oracle("rate_limit_fixed", "SELECT * FROM v_fixed")
_HITS = "hits AS (SELECT user_id, event_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)"
_SLIDE = _HITS + """,
adm AS (
  SELECT user_id, event_id, rn, true AS admitted, [ts] AS live FROM hits WHERE rn = 1
  UNION ALL
  SELECT user_id, event_id, rn, len(l) < 2, CASE WHEN len(l) < 2 THEN list_append(l, ts) ELSE l END
  FROM (SELECT h.user_id, h.event_id, h.rn, h.ts, list_filter(a.live, lambda x: h.ts - x <= INTERVAL 10 HOUR) AS l
        FROM adm a JOIN hits h ON h.user_id = a.user_id AND h.rn = a.rn + 1))"""
oracle("sliding_admission", "SELECT user_id AS identity, event_id AS id, admitted FROM adm", _SLIDE)
oracle("login_lockout", "SELECT user_id AS identity, event_id AS id, locked FROM att WHERE rn > 0", _HITS + """,
att AS (
  SELECT DISTINCT user_id, NULL::BIGINT AS event_id, CAST(0 AS BIGINT) AS rn, false AS locked, []::TIMESTAMP[] AS fails FROM events
  UNION ALL
  SELECT user_id, event_id, rn, len(l) >= 4, CASE WHEN len(l) >= 4 THEN l WHEN event_type = 'purchase' THEN [] ELSE list_append(l, ts) END
  FROM (SELECT h.user_id, h.event_id, h.rn, h.ts, h.event_type, list_filter(a.fails, lambda x: h.ts - x <= INTERVAL 72 HOUR) AS l
        FROM att a JOIN hits h ON h.user_id = a.user_id AND h.rn = a.rn + 1))""")
oracle("active_keys", """
SELECT r.request_id, k.id AS key_id, k.name, CASE WHEN k.id IS NULL THEN 'INVALID_KEY' END AS reject_code
FROM v_requests r LEFT JOIN v_keys k ON k.id = r.api_key_id AND k.revoked_at IS NULL""")
oracle("usage_rows_masked", """
SELECT k.id, k.name, 'key_' || substr(key_prefix, 1, 8) || '…' AS masked, rate_limit_per_min,
       (SELECT count(*) FROM events e WHERE e.user_id = k.id AND e.ts >= TIMESTAMP '2024-01-20') AS requests FROM v_keys k""")
oracle("keys_listing", f"""
SELECT id, name, 'key_' || substr(key_prefix, 1, 8) || '…' AS masked, revoked_at IS NOT NULL AS revoked, {STAMP.format('created_at')} AS created_at FROM v_keys""")
oracle("key_revocations", f"""
SELECT k.id, {STAMP.format('coalesce(r.at, k.revoked_at)')} AS revoked_at FROM v_keys k
LEFT JOIN (SELECT api_key_id, max(created_at) AS at FROM v_requests WHERE tags = 'junk_food' AND frames = 6 GROUP BY api_key_id) r ON r.api_key_id = k.id""")
oracle("prune_usage", f"""
SELECT api_key_id, {STAMP.format('window_start')} AS window_start, "count" FROM v_counters WHERE window_start >= TIMESTAMP '2024-01-19 12:00:00'""")
oracle("counters_stored", f"""
SELECT user_id AS api_key_id, {STAMP.format("date_trunc('minute', ts)")} AS window_start, count(*) AS "count" FROM events
WHERE (event_id % 3 <> 0 OR ts >= TIMESTAMP '2024-01-19' AND ts < TIMESTAMP '2024-01-21') AND date_trunc('minute', ts) >= TIMESTAMP '2024-01-19 12:00:00'
GROUP BY 1, 2""")
oracle("prune_usage_deleted", "SELECT count(*) AS n_deleted FROM v_counters WHERE window_start < TIMESTAMP '2024-01-19 12:00:00'")

# ---- evaluation
oracle("eval_discover", "SELECT owner, label, path FROM v_found")
oracle("smoke_limit", "SELECT owner, label, path FROM v_found ORDER BY owner, label DESC, path LIMIT 25")
oracle("banked_scores", """
SELECT arm, 'eval/' || item AS path, owner, is_positive AS label, latency_ms, band AS alcohol_band, evidence AS own_evidence FROM v_eval WHERE tag = 'alcohol'""")
oracle("phrase_stats", """
SELECT 'tag_' || conv_id AS slug, count(*) FILTER (WHERE role = 'user') AS n_positives, count(*) FILTER (WHERE role = 'assistant') AS n_negatives
FROM conversations GROUP BY conv_id""")
oracle("cross_fire", """
SELECT arm, tag, false_blocks FROM v_fire
UNION ALL SELECT arm, '(all)', count(*) FILTER (WHERE band = 'present' AND tag <> owner) FROM v_eval GROUP BY arm""")
oracle("recall_by_tag", """
SELECT arm, tag, positives, tp, unsure, CASE WHEN positives > 0 THEN round(tp / positives, 6) ELSE 0.0::DOUBLE END AS recall FROM v_recall""")
oracle("mean_recall", "SELECT arm, mean_recall FROM v_report")
oracle("uncertain_positive_rate", "SELECT arm, uncertain_positive_rate FROM v_report")
oracle("latency_percentiles", """
SELECT arm, max(n_chars) FILTER (WHERE i = least(n - 1, CAST(floor(n*0.5) AS BIGINT))) AS p50,
       max(n_chars) FILTER (WHERE i = least(n - 1, CAST(floor(n*0.95) AS BIGINT))) AS p95, max(n_chars) AS "max"
FROM (SELECT source AS arm, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY source) AS n
      FROM documents WHERE n_chars <> 0) GROUP BY arm""")
oracle("gate_report", "SELECT * FROM v_report")
_COMPARE = """
SELECT b.metric, b.v AS "before", a.v AS "after", round(a.v - b.v, 4) AS change FROM
(SELECT unnest(['cross_tag_false_blocks','mean_recall','uncertain_positive_rate','p95']) AS metric,
        unnest([cross_tag_false_blocks::DOUBLE, mean_recall, uncertain_positive_rate, p95::DOUBLE]) AS v FROM v_report WHERE arm = 'baseline') b
JOIN (SELECT unnest(['cross_tag_false_blocks','mean_recall','uncertain_positive_rate','p95']) AS metric,
        unnest([cross_tag_false_blocks::DOUBLE, mean_recall, uncertain_positive_rate, p95::DOUBLE]) AS v FROM v_report WHERE arm = 'candidate') a
ON a.metric = b.metric"""
oracle("gate_compare_join", _COMPARE)
oracle("gate_verdict", """
SELECT CASE WHEN fewer AND r1 >= r0 THEN 'PASS' WHEN fewer OR r1 > r0 THEN 'MIXED' ELSE 'FAIL' END AS verdict,
       CASE WHEN fewer AND r1 >= r0 THEN 'fewer false blocks, recall held' WHEN fewer THEN 'fewer false blocks, recall fell'
            WHEN r1 > r0 THEN 'recall rose, false blocks did not fall' ELSE 'no better on either axis' END AS reason
FROM (SELECT a.cross_tag_false_blocks < b.cross_tag_false_blocks AS fewer, b.mean_recall AS r0, a.mean_recall AS r1
      FROM v_report b, v_report a WHERE b.arm = 'baseline' AND a.arm = 'candidate')""")
oracle("gate_report_merge", """
SELECT arm, CASE WHEN arm = 'candidate' THEN images ELSE -1 END AS images, cross_tag_false_blocks FROM v_report""")
oracle("label_disagreements", """
SELECT arm, 'eval/' || item AS path, tag, CASE WHEN is_positive THEN 'labelled POSITIVE, model says absent' ELSE 'labelled NEGATIVE, model says present' END AS problem, evidence
FROM v_eval WHERE tag = owner AND ((is_positive AND band = 'absent') OR (NOT is_positive AND band = 'present'))""")
oracle("eval_coverage", """
SELECT DISTINCT owner AS slug FROM v_found
EXCEPT SELECT owner FROM v_eval WHERE band = 'present' AND tag = owner AND latency_ms > 12000""")
oracle("worst_cross_tags", """
SELECT arm, tag, false_blocks, CAST(row_number() OVER (PARTITION BY arm ORDER BY false_blocks DESC, tag) AS INT) AS position FROM v_fire""")
oracle("tags_without_positives", """
SELECT slug AS tag FROM v_tags WHERE status = 'active' EXCEPT SELECT owner FROM v_eval WHERE is_positive""")
oracle("arms_union", """
SELECT arm, CASE WHEN arm = 'candidate' THEN evidence END AS source, band, count(*) AS n FROM v_eval GROUP BY 1, 2, 3""")
oracle("resume_todo", """
SELECT owner, label, path FROM v_found WHERE NOT ((owner <> 'vaping' OR NOT label) AND owner <> 'alcohol')""")

# ---- streams: the same results as their batch twins
oracle("stream_usage", f"""SELECT api_key_id, {STAMP.format('window_start')} AS window_start, "count" FROM v_counters""")
oracle("stream_late", """
SELECT api_key_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS window_start, CAST(sum(units) AS BIGINT) AS units, late
FROM (SELECT c.*, r.created_at < TIMESTAMP '2024-01-01 06:00:00' AS late FROM v_charges c JOIN v_requests r USING (request_id)) GROUP BY ALL""")
oracle("stream_collapse", "SELECT creative_id, tag, frame_index, present, score, confidence, band, calibrated_effective FROM v_collapsed")
_LATE = "event_id % 97 = 5 AND ts < TIMESTAMP '2024-01-20'"
oracle("stream_admission", f"""
SELECT user_id AS identity, event_id AS id, admitted, NULL::VARCHAR AS reject_code FROM adm
UNION ALL SELECT user_id, event_id, false, 'LATE' FROM events WHERE {_LATE}""", _SLIDE.replace("FROM events)", f"FROM events WHERE NOT ({_LATE}))"))
oracle("stream_cache", "SELECT request_id, cached FROM seen UNION ALL SELECT event_id, false FROM events WHERE event_id % 89 = 7 AND ts < TIMESTAMP '2024-01-20'", """
q AS (SELECT request_id, created_at, creative_id, packs_version, sorted_tags,
             row_number() OVER (PARTITION BY creative_id, packs_version, sorted_tags ORDER BY created_at, request_id) AS rn
      FROM v_requests WHERE NOT (request_id % 89 = 7 AND created_at < TIMESTAMP '2024-01-20')),
seen AS (
  SELECT request_id, creative_id, packs_version, sorted_tags, rn, false AS cached, created_at AS made FROM q WHERE rn = 1
  UNION ALL
  SELECT q.request_id, q.creative_id, q.packs_version, q.sorted_tags, q.rn, q.created_at - s.made <= INTERVAL 72 HOUR,
         CASE WHEN q.created_at - s.made <= INTERVAL 72 HOUR THEN s.made ELSE q.created_at END
  FROM seen s JOIN q ON q.creative_id = s.creative_id AND q.packs_version = s.packs_version AND q.sorted_tags = s.sorted_tags AND q.rn = s.rn + 1)""")
oracle("stream_gate", """
SELECT request_id, CASE WHEN tags LIKE '%alcohool%' THEN 'alcohool' ELSE '' END AS unknown, tags NOT LIKE '%alcohool%' AS accepted FROM v_requests""")

# ---- end to end
oracle("analyze", """
SELECT request_id, tag, frame_index, band, score, confidence, top_phrase, calibrated_effective, cached, NULL AS reject_code
FROM (SELECT *, count(tag) OVER (PARTITION BY request_id) AS n FROM v_outcome) WHERE n = wanted
UNION ALL SELECT DISTINCT request_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'INFERENCE_FAILED'
FROM (SELECT *, count(tag) OVER (PARTITION BY request_id) AS n FROM v_outcome) WHERE n < wanted
UNION ALL SELECT request_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'UNKNOWN_TAG' FROM v_requests WHERE tags LIKE '%alcohool%'""")
