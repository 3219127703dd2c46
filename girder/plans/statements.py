"""The same queries as DuckDB statements over the same tables."""

from __future__ import annotations

from girder.plans.views import LABEL_TEXT

BOXES = """boxes AS (
  SELECT l_orderkey AS image, l_returnflag AS class, l_linestatus AS stratum,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS pos,
    CAST(round_even(l_extendedprice * 100, 0) AS BIGINT) % 1000 AS score,
    CAST(l_partkey * 7 % 12 AS DOUBLE) AS x1, CAST(l_suppkey * 5 % 12 AS DOUBLE) AS y1,
    CAST(l_partkey * 7 % 12 + 8 + CAST(floor(l_quantity) AS BIGINT) % 8 AS DOUBLE) AS x2, CAST(l_suppkey * 5 % 12 + 8 + (l_partkey + l_suppkey) % 8 AS DOUBLE) AS y2
  FROM lineitem),
preds AS (SELECT * FROM boxes WHERE pos % 2 = 0),
refs AS (SELECT * FROM boxes WHERE pos % 2 = 1)"""

SHARED = "greatest(least(p.x2, r.x2) - greatest(p.x1, r.x1), 0) * greatest(least(p.y2, r.y2) - greatest(p.y1, r.y1), 0)"
AREAS = "(p.x2 - p.x1) * (p.y2 - p.y1) + (r.x2 - r.x1) * (r.y2 - r.y1)"


def match(shown: int = 0, overlap: float = 0.5) -> str:
    """CTEs up to ``matches``: a state with the references used so far, one prediction a step."""
    return f"""{BOXES},
p AS (SELECT *, row_number() OVER (PARTITION BY image, class ORDER BY score DESC, pos) AS n FROM preds WHERE score >= {shown}),
c AS (SELECT p.image, p.class, p.n, r.pos AS ref, {SHARED} / ({AREAS} - {SHARED}) AS iou FROM p JOIN refs r ON p.image = r.image AND p.class = r.class),
k AS (
  SELECT p.image, p.class, p.n, p.pos, p.score, coalesce(max(c.iou), 0.0) AS best_iou,
    coalesce(list(c.ref ORDER BY c.iou DESC, c.ref) FILTER (c.iou >= {overlap}), []) AS near, coalesce(list(c.iou ORDER BY c.iou DESC, c.ref) FILTER (c.iou >= {overlap}), []) AS near_iou
  FROM p LEFT JOIN c ON p.image = c.image AND p.class = c.class AND p.n = c.n GROUP BY ALL),
m AS (
  SELECT image, class, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS pred_pos, CAST(NULL AS BIGINT) AS score, CAST(NULL AS BIGINT) AS ref_pos, CAST(NULL AS DOUBLE) AS best_iou, CAST(NULL AS DOUBLE) AS matched_iou
  FROM p WHERE n = 1
  UNION ALL
  SELECT image, class, n, CASE WHEN f IS NULL THEN used ELSE list_append(used, f) END, pos, score, f, best_iou, CASE WHEN f IS NOT NULL THEN near_iou[list_position(near, f)] END
  FROM (SELECT k.*, m.used, list_filter(k.near, lambda x: NOT list_contains(m.used, x))[1] AS f FROM m JOIN k ON m.image = k.image AND m.class = k.class AND k.n = m.n + 1)),
matches AS (
  SELECT image, class, pred_pos, score, ref_pos, CASE WHEN ref_pos IS NOT NULL THEN 'matched' WHEN best_iou >= {overlap} THEN 'duplicate' WHEN best_iou > 0 THEN 'insufficient_overlap' ELSE 'no_overlap' END AS reason, best_iou, matched_iou
  FROM m WHERE n > 0),
counts AS (
  SELECT image, class, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(refs, 0) - coalesce(tp, 0) AS fn
  FROM (SELECT image, class, count(*) FILTER (reason = 'matched') AS tp, count(*) FILTER (reason <> 'matched') AS fp FROM matches GROUP BY ALL)
  FULL JOIN (SELECT image, class, count(*) AS refs FROM refs GROUP BY ALL) USING (image, class))"""


RATIOS = """CAST(tp AS DOUBLE) / nullif(tp + fp, 0) AS precision, CAST(tp AS DOUBLE) / nullif(tp + fn, 0) AS recall,
  CASE WHEN tp + fp > 0 AND tp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) END AS f1"""
SUMS = "CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn"

SWEEP = f"""{match()},
grid AS (SELECT unnest(range(50, 951, 50)) AS threshold),
spots AS (SELECT class, threshold, image, count(*) FILTER (reason = 'matched') AS tp, count(*) FILTER (reason <> 'matched') AS fp FROM matches JOIN grid ON score >= threshold GROUP BY ALL),
one AS (SELECT class, threshold, sum(tp) AS tp, sum(fp) AS fp, count(*) FILTER (fp > 0) AS wrong FROM spots GROUP BY ALL),
had AS (SELECT class, threshold, n FROM (SELECT class, count(*) AS n FROM refs GROUP BY ALL), grid),
swept AS (
  SELECT class, threshold, CAST(coalesce(tp, 0) AS BIGINT) AS tp, CAST(coalesce(fp, 0) AS BIGINT) AS fp, CAST(coalesce(n, 0) - coalesce(tp, 0) AS BIGINT) AS fn, CAST(coalesce(wrong, 0) AS BIGINT) AS images_with_false_proposals
  FROM one FULL JOIN had USING (class, threshold))"""

PHOTOS = """photo AS (
  SELECT d.doc_id AS id, d.lang AS difficulty, d.source, sha256(d.text) AS digest, d.n_chars, quality, toxic,
    list_filter([CASE WHEN quality = 1 THEN 0 END, CASE WHEN toxic = 1 THEN 1 END], lambda x: x IS NOT NULL) AS classes
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

PRINTS = """word AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents),
cell AS (SELECT doc_id, CAST('0x' || substr(sha256(w), 1, 2) AS INTEGER) % 64 AS b, count(*) AS c FROM word GROUP BY ALL),
filled AS (SELECT doc_id, b, coalesce(c, 0) AS c FROM (SELECT doc_id, unnest(range(64)) AS b FROM documents) LEFT JOIN cell USING (doc_id, b)),
grids AS (SELECT doc_id, list(c ORDER BY b) AS grid FROM filled GROUP BY doc_id),
prints AS (
  SELECT doc_id AS id, sha256(text) AS digest, grid, CAST(list_sum(list_transform(range(63), lambda i: CASE WHEN grid[i + 2] > grid[i + 1] THEN CAST(1 AS BIGINT) << CAST(i AS INTEGER) ELSE 0 END)) AS BIGINT) AS hash
  FROM grids JOIN documents USING (doc_id))"""

PAIRS = f"""{PRINTS},
pairs AS (SELECT a.id AS "left", b.id AS "right", CAST(bit_count(xor(a.hash, b.hash)) AS BIGINT) AS distance FROM prints a JOIN prints b ON a.id < b.id AND bit_count(xor(a.hash, b.hash)) <= 8)"""

GROUPS = f"""{PAIRS},
edge AS (SELECT "left" AS a, "right" AS b FROM pairs UNION SELECT "right", "left" FROM pairs),
reach AS (SELECT id AS root, id AS d FROM prints UNION SELECT root, b FROM reach JOIN edge ON d = a),
grp AS (SELECT root AS id, min(d) AS content_group FROM reach GROUP BY root)"""

STRATA = f"""{PHOTOS}, {GROUPS},
rec AS (SELECT photo.*, content_group FROM photo JOIN grp USING (id)),
strata AS (
  SELECT content_group, count(*) AS n,
    '([' || coalesce(array_to_string(list_transform(list_sort(list_distinct(list(difficulty))), lambda x: chr(39) || x || chr(39)), ', '), '') || '], ['
      || coalesce(array_to_string(list_sort(list_distinct(flatten(list(classes)))), ', '), '') || '])' AS stratum
  FROM rec GROUP BY content_group)"""

SPLIT = f"""{STRATA},
turn AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('20260918:' || content_group), content_group) AS nth, count(*) OVER (PARTITION BY stratum) AS many FROM strata),
held AS (SELECT *, CASE WHEN many >= 3 THEN greatest(1, round_even(many * CAST(0.1 AS DOUBLE), 0)) ELSE 0 END AS h FROM turn),
split AS (SELECT id, rec.content_group, CASE WHEN nth <= h THEN 'valid' WHEN nth <= 2 * h THEN 'test' ELSE 'train' END AS split, classes FROM rec JOIN held ON rec.content_group = held.content_group)"""

AUTHOR = "CASE WHEN id % 10 < 8 THEN 'train' WHEN id % 10 = 8 THEN 'valid' ELSE 'test' END"

MEASURES = """plain AS (
  SELECT doc_id AS id, lang AS difficulty, length(regexp_replace(coalesce(text, ''), '[^#*$%&|!]', '', 'g')) AS dark, length(regexp_replace(coalesce(text, ''), '[^A-Z]', '', 'g')) AS bright, greatest(length(coalesce(text, '')), 1) AS pixels
  FROM documents),
measures AS (SELECT *, 1.0 - CAST(dark + bright AS DOUBLE) / pixels AS readable, CAST(pixels % 40 AS DOUBLE) AS sharpness FROM plain),
judged AS (
  SELECT *, CASE WHEN readable < 0.4 THEN 'unusable' WHEN readable < 0.95 OR sharpness < 12 THEN 'partial' ELSE 'usable' END AS verdict,
    list_filter([CASE WHEN readable < 0.95 THEN 'lost_regions' END, CASE WHEN sharpness < 12 THEN 'low_detail' END], lambda x: x IS NOT NULL) AS reasons,
    CASE WHEN CAST(dark AS DOUBLE) / pixels + CAST(bright AS DOUBLE) / pixels >= 0.3 THEN CASE WHEN dark >= bright THEN 'too_dark' ELSE 'too_bright' END END AS lost
  FROM measures)"""

LINES = f"""files AS (SELECT p_partkey AS id, {LABEL_TEXT} AS text FROM part),
cut AS (SELECT id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM files),
fields AS (SELECT id, CAST(line AS BIGINT) AS line, text, string_split(text, ' ') AS f FROM cut WHERE length(text) > 0),
num AS (SELECT *, try_cast(f[1] AS INTEGER) AS class_id, try_cast(f[2] AS DOUBLE) AS cx, try_cast(f[3] AS DOUBLE) AS cy, try_cast(f[4] AS DOUBLE) AS w, try_cast(f[5] AS DOUBLE) AS h FROM fields),
parsed AS (
  SELECT *, CASE WHEN len(f) <> 5 THEN 'unexpected_line' WHEN class_id IS NULL OR cx IS NULL OR cy IS NULL OR w IS NULL OR h IS NULL THEN 'invalid_number'
    WHEN class_id < 0 OR class_id >= 3 THEN 'unknown_class' WHEN least(cx, cy, w, h) < 0 OR greatest(cx, cy, w, h) > 1 THEN 'outside' WHEN w <= 0 OR h <= 0 THEN 'empty_box'
    WHEN cx - w / 2 < -1e-6 OR cy - h / 2 < -1e-6 THEN 'starts_outside' WHEN cx + w / 2 > 1 + 1e-6 OR cy + h / 2 > 1 + 1e-6 THEN 'ends_outside' ELSE 'box' END AS verdict
  FROM num)"""

JOURNAL = """journal AS (
  SELECT user_id AS analysis, row_number() OVER w AS revision, 'r' || CASE WHEN event_id % 97 = 0 THEN event_id - 97 ELSE event_id END AS request_id,
    CASE WHEN kind = 'manual' THEN 1 + count(*) FILTER (kind = 'manual') OVER (w ROWS UNBOUNDED PRECEDING) WHEN event_id % 5 = 4 THEN 2 ELSE event_id // 8 % 2 END AS finding,
    kind, CASE WHEN kind = 'review' THEN decision END AS decision,
    CASE WHEN kind = 'manual' OR (kind = 'review' AND (decision = 'confirmed' OR event_id % 31 = 0) AND (event_id % 5 = 0 OR event_id % 17 = 0)) THEN 'class_' || event_id % 3 END AS class,
    CASE WHEN kind = 'correction' THEN CASE event_id % 3 WHEN 0 THEN 'planned' WHEN 1 THEN 'in_progress' ELSE 'resolved' END END AS status,
    ts AS recorded_at, CASE WHEN event_id % 29 = 0 THEN ts + INTERVAL 1 DAY END AS occurred_at
  FROM (SELECT *, CASE WHEN event_id % 16 = 15 THEN 'manual' WHEN event_id % 4 < 2 THEN 'review' WHEN event_id % 4 = 2 THEN 'correction' ELSE 'note' END AS kind,
    CASE WHEN event_id // 4 % 3 < 2 THEN 'confirmed' WHEN event_id // 12 % 2 = 0 THEN 'rejected' ELSE 'indeterminate' END AS decision FROM events)
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
automatic AS (SELECT DISTINCT user_id AS analysis, g AS finding, 'class_' || user_id % 3 AS own, 0 AS since FROM events, (SELECT unnest([0, 1]) AS g)),
known AS (SELECT * FROM automatic UNION ALL SELECT analysis, finding, class, revision FROM journal WHERE kind = 'manual')"""

ANALYSES = """analyses AS (
  SELECT user_id AS analysis, min(ts) + CASE WHEN user_id % 9 = 0 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END AS analysed_at, sha256(CAST(user_id AS VARCHAR)) AS photo_sha256, 40 + user_id % 3 * 10 AS width, 40 + user_id % 5 * 10 AS height
  FROM events GROUP BY user_id)"""

#: Requests as rows of events, and the first rule each breaks, as the rules stand in the survey (EV-01).
REQUESTS = """asked AS (
  SELECT user_id AS analysis, ts AS recorded_at, CASE WHEN event_id % 53 = 0 THEN '' ELSE 'r' || event_id END AS request_id, kind,
    CASE WHEN kind = 'manual' AND event_id % 44 <> 0 THEN NULL WHEN event_id % 41 = 0 THEN 'x' ELSE md5(CAST(user_id AS VARCHAR)) END AS finding,
    CASE WHEN event_id % 61 = 0 THEN ' padded ' ELSE 'user ' || user_id END AS actor,
    CASE WHEN kind = 'review' THEN CASE WHEN event_id % 37 = 0 THEN 'maybe' WHEN event_id // 4 % 3 < 2 THEN 'confirmed' ELSE 'rejected' END END AS decision,
    CASE WHEN kind = 'manual' OR (kind = 'review' AND event_id % 7 < 2) OR event_id % 89 = 0 THEN list_extract(['crack', 'surface_loss', 'peeling_paint', 'moisture_trace', 'mold_suspected', 'rust'], event_id % 6 + 1) END AS class,
    CASE WHEN kind = 'review' AND event_id % 11 = 0 THEN 'task' END AS task, CASE WHEN kind = 'review' AND event_id % 23 = 0 THEN 'high' END AS severity,
    CASE WHEN kind = 'correction' THEN CASE WHEN event_id % 43 = 0 THEN 'done' WHEN event_id % 3 = 0 THEN 'planned' WHEN event_id % 3 = 1 THEN 'resolved' ELSE 'not_required' END END AS status,
    CASE WHEN kind = 'correction' AND event_id % 67 <> 0 THEN CASE WHEN event_id % 5 = 0 THEN 'none' WHEN event_id % 13 = 0 THEN 'twice' WHEN event_id % 19 = 0 THEN 'short' ELSE 'one' END END AS proofs,
    event_id % 50 AS x1, event_id % 40 AS y1, event_id % 50 + 10 AS x2, event_id % 40 + 10 - event_id % 20 AS y2,
    event_id % 71 <> 0 AS noted, event_id % 59 <> 0 AS zoned, CASE WHEN event_id % 59 <> 0 AND event_id % 3 = 0 THEN strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S') || '.000000Z' END AS occurred_at
  FROM (SELECT *, CASE WHEN event_id % 97 = 0 THEN 'remark' WHEN event_id % 4 = 0 THEN 'manual' WHEN event_id % 4 = 1 THEN 'review' WHEN event_id % 4 = 2 THEN 'correction' ELSE 'note' END AS kind FROM events)),
checked AS (
  SELECT *, CASE WHEN kind = 'remark' THEN 'unknown_kind' WHEN class IS NOT NULL AND kind NOT IN ('manual', 'review') THEN 'unknown_field'
    WHEN kind = 'manual' AND finding IS NOT NULL THEN 'finding_given' WHEN kind <> 'manual' AND NOT regexp_full_match(finding, '[0-9a-f]{32}') THEN 'bad_finding'
    WHEN class = 'rust' AND (kind = 'manual' OR decision <> 'maybe') THEN 'unknown_class' WHEN decision = 'maybe' THEN 'unknown_decision'
    WHEN decision <> 'confirmed' AND (class IS NOT NULL OR task IS NOT NULL OR severity IS NOT NULL) THEN 'needs_confirmation'
    WHEN status = 'done' THEN 'unknown_status' WHEN kind = 'correction' AND (proofs IS NULL OR proofs = 'short') THEN 'bad_evidence' WHEN proofs = 'twice' THEN 'repeated_evidence'
    WHEN status = 'resolved' AND proofs = 'none' THEN 'needs_evidence' WHEN NOT noted THEN 'bad_note' WHEN request_id = '' THEN 'bad_request_id' WHEN actor = ' padded ' THEN 'bad_actor' WHEN NOT zoned THEN 'bad_time' END AS problem
  FROM asked)"""

ADDED = REQUESTS + ", " + ANALYSES + """, added AS (
  SELECT checked.*, photo_sha256, width, height, CASE WHEN x1 >= x2 OR y1 >= y2 THEN 'empty_box' WHEN least(x1, y1, x2, y2) < 0 OR x2 > width OR y2 > height THEN 'outside_photo' END AS refused
  FROM checked JOIN analyses USING (analysis) WHERE kind = 'manual' AND problem IS NULL)"""

DETECTIONS = f"""{BOXES},
det AS (
  SELECT image AS analysis, pos AS idx, class, score / 1000.0 AS score, floor(x1 / 8) * 8 AS a, floor(y1 / 8) * 8 AS b, floor(x2 / 8) * 8 + 8 AS c, floor(y2 / 8) * 8 + 8 AS d FROM boxes),
asked AS (
  SELECT *, CASE WHEN class NOT IN ('A', 'N') THEN 'class_not_enabled' WHEN score <= 0.3 THEN 'below_or_equal_threshold'
    WHEN analysis % 5 = 0 AND a >= 0 AND b >= 0 AND c <= 16 AND d <= 24 THEN 'unreadable_region' END AS reason FROM det),
rival AS (
  SELECT *, row_number() OVER (PARTITION BY analysis, class, a, b, c, d, reason IS NULL ORDER BY score DESC, idx) AS nth, min(idx) OVER (PARTITION BY analysis, class, a, b, c, d, reason IS NULL) AS slot FROM asked)"""


def ap(overlap: float) -> str:
    """AP and recall of each class at one overlap, from a matching of its own: 101 recalls, precision from the right."""
    return f"""SELECT class, CAST({overlap} AS DOUBLE) AS threshold, round(coalesce(sum(best), 0) / 101, 6) AS ap, round(coalesce(max(reached), 0), 9) AS recall FROM (
  SELECT f.class, i, (SELECT max(q.tp) FROM curve q WHERE q.class = f.class) / f.n AS reached, (SELECT max(q.precision) FROM curve q WHERE q.class = f.class AND q.tp / f.n >= i / CAST(100 AS DOUBLE)) AS best
  FROM (SELECT class, CAST(count(*) AS DOUBLE) AS n FROM refs GROUP BY ALL) f, (SELECT unnest(range(101)) AS i)) GROUP BY class"""


def ap_ctes(overlap: float) -> str:
    # The protocol prefers the later of references that overlap equally.
    steps = match(0, overlap).replace("ORDER BY c.iou DESC, c.ref)", "ORDER BY c.iou DESC, c.ref DESC)")
    return f"""{steps},
run AS (SELECT class, score, image, pred_pos, CAST(sum(CASE WHEN reason = 'matched' THEN 1 ELSE 0 END) OVER w AS DOUBLE) AS tp, count(*) OVER w AS n FROM matches WINDOW w AS (PARTITION BY class ORDER BY score DESC, image, pred_pos ROWS UNBOUNDED PRECEDING)),
curve AS (SELECT class, tp, max(tp / n) AS precision FROM run GROUP BY ALL)"""


MERGE = f"""{BOXES},
p AS (SELECT *, row_number() OVER (PARTITION BY image, class ORDER BY score DESC, pos) AS n FROM preds),
m AS (
  SELECT image, class, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(score BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, merged_from BIGINT)[]) AS kept FROM p WHERE n = 1
  UNION ALL
  SELECT image, class, n, CASE WHEN j IS NULL THEN list_append(kept, struct_pack(score := score, x1 := x1, y1 := y1, x2 := x2, y2 := y2, merged_from := CAST(1 AS BIGINT)))
    ELSE list_transform(kept, lambda e, i: CASE WHEN i = j THEN struct_pack(score := e.score, x1 := least(e.x1, x1), y1 := least(e.y1, y1), x2 := greatest(e.x2, x2), y2 := greatest(e.y2, y2), merged_from := e.merged_from + 1) ELSE e END) END
  FROM (SELECT p.*, m.kept, list_position(list_transform(m.kept, lambda e: greatest(least(e.x2, p.x2) - greatest(e.x1, p.x1), 0) * greatest(least(e.y2, p.y2) - greatest(e.y1, p.y1), 0) / least((e.x2 - e.x1) * (e.y2 - e.y1), (p.x2 - p.x1) * (p.y2 - p.y1)) >= 0.3), true) AS j
    FROM m JOIN p ON m.image = p.image AND m.class = p.class AND p.n = m.n + 1)),
ends AS (SELECT * FROM m QUALIFY n = max(n) OVER (PARTITION BY image, class))"""

BUDGET = f"""{STRATA},
turn AS (SELECT content_group, n, stratum, row_number() OVER (PARTITION BY stratum ORDER BY sha256('42:' || content_group), content_group) AS turn FROM strata WHERE n <= 60),
line AS (SELECT *, row_number() OVER (ORDER BY turn, stratum) AS k FROM turn),
fold AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS total, CAST(NULL AS BIGINT) AS content_group, CAST(NULL AS BIGINT) AS n, false AS taken
  UNION ALL
  SELECT line.k, CASE WHEN total + line.n <= 60 THEN total + line.n ELSE total END, line.content_group, line.n, total + line.n <= 60 FROM fold JOIN line ON line.k = fold.k + 1)"""

DIHEDRAL = """CASE v WHEN 0 THEN r * 8 + c WHEN 1 THEN r * 8 + 7 - c WHEN 2 THEN (7 - r) * 8 + c WHEN 3 THEN (7 - r) * 8 + 7 - c
    WHEN 4 THEN c * 8 + r WHEN 5 THEN c * 8 + 7 - r WHEN 6 THEN (7 - c) * 8 + r ELSE (7 - c) * 8 + 7 - r END"""

SIMILAR = f"""{PRINTS},
spot AS (SELECT v, list({DIHEDRAL} ORDER BY r * 8 + c) AS place FROM (SELECT unnest(range(8)) AS v), (SELECT unnest(range(8)) AS r), (SELECT unnest(range(8)) AS c) GROUP BY v),
laid AS (SELECT id, digest, v, list_transform(place, lambda i: grid[i + 1]) AS g FROM prints, spot),
seen AS (SELECT id, digest, v, g, CAST(list_sum(list_transform(range(63), lambda i: CASE WHEN g[i + 2] > g[i + 1] THEN CAST(1 AS BIGINT) << CAST(i AS INTEGER) ELSE 0 END)) AS BIGINT) AS hash FROM laid),
near AS (
  SELECT a.id AS l, b.id AS r, b.v, bit_count(xor(a.hash, b.hash)) AS distance, CAST(list_sum(list_transform(range(64), lambda i: abs(a.g[i + 1] - b.g[i + 1]))) AS DOUBLE) / 64 AS error
  FROM seen a JOIN seen b ON a.v = 0 AND a.id < b.id AND a.digest <> b.digest AND bit_count(xor(a.hash, b.hash)) <= 6),
best AS (SELECT * FROM near WHERE error <= 1.0 QUALIFY row_number() OVER (PARTITION BY l, r ORDER BY error, distance, v) = 1)"""


def with_(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{select}"


IMAGES = "(SELECT count(DISTINCT l_orderkey) FROM lineitem)"

ORIGINS = """ranked AS (SELECT photo, row_number() OVER (ORDER BY sha256('7:' || photo), photo) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey AS photo FROM orders)),
uses AS (SELECT photo, CASE WHEN k <= greatest(1, least(n - 1, round_even(n * 0.5, 0))) THEN 'train' ELSE 'reserved' END AS use FROM ranked)"""

REVIEW_AUDIT = """WITH s AS (SELECT doc_id AS id, unnest([0, 1, 2]) AS source_index FROM documents),
r AS (SELECT doc_id AS id, unnest([0, 1]) AS review_index FROM documents),
l AS (SELECT id, review_index, CASE WHEN id % 3 = 0 THEN review_index + 1 ELSE 9 END AS x2, unnest(list_distinct(CASE WHEN id % 5 = 0 THEN [0, review_index] ELSE [review_index] END)) AS source_index FROM r),
g AS (SELECT id, source_index, string_agg(review_index, ',' ORDER BY review_index) AS targets, count(*) AS n, min(x2) AS x2 FROM l GROUP BY ALL)
SELECT s.id, CAST(s.source_index AS BIGINT) AS source_index, coalesce(targets, '') AS targets,
  CASE WHEN s.source_index = 2 AND s.id % 7 <> 0 THEN CASE WHEN targets IS NULL THEN 'removed' ELSE 'unresolved' END WHEN n = 1 AND x2 = s.source_index + 1 THEN 'kept' WHEN n IS NOT NULL THEN 'revised' ELSE 'unresolved' END AS outcome
FROM s LEFT JOIN g ON s.id = g.id AND s.source_index = g.source_index"""

CELLS = """
  SELECT DISTINCT image, class, x * 32 + y AS cell
  FROM (SELECT *, unnest(range(CAST(y1 AS BIGINT), CAST(y2 AS BIGINT))) AS y FROM (SELECT *, unnest(range(CAST(x1 AS BIGINT), CAST(x2 AS BIGINT))) AS x FROM {table}))"""

MASK_UNION = f"""
WITH {BOXES},
cells AS ({CELLS.format(table="boxes")}),
islands AS (SELECT *, cell - row_number() OVER (PARTITION BY image, class ORDER BY cell) AS island FROM cells)
SELECT image, class, min(cell) AS start, max(cell) + 1 AS stop FROM islands GROUP BY image, class, island
"""

MASK_COVERAGE = f"""
WITH {BOXES},
r AS ({CELLS.format(table="refs")}),
p AS ({CELLS.format(table="(SELECT * FROM preds WHERE score >= 300)")})
SELECT image, class, count(r.cell) AS reference_pixels, count(p.cell) AS proposal_pixels, count(CASE WHEN r.cell = p.cell THEN 1 END) AS shared_pixels,
  count(r.cell) > 0 AS expected, count(p.cell) > 0 AS signalled
FROM r FULL JOIN p USING (image, class, cell) GROUP BY image, class
"""

STATEMENTS: dict[str, str] = {
    "box_meetings": f"""
WITH {BOXES}
SELECT p.image, p.class, p.pos AS pred_pos, r.pos AS ref_pos, {SHARED} / ({AREAS} - {SHARED}) AS iou
FROM preds p JOIN refs r ON p.image = r.image AND p.class = r.class AND p.x1 < r.x2 AND r.x1 < p.x2 AND p.y1 < r.y2 AND r.y1 < p.y2""",
    "match_in_rounds": with_(match(), "SELECT * FROM matches"),
    "evidence_proofs": with_(REQUESTS, """SELECT analysis, count(*) FILTER (kind = 'correction' AND proofs = 'one') AS n_proofs, count(*) FILTER (kind = 'manual') AS n_human_reports
FROM checked WHERE problem IS NULL GROUP BY analysis"""),
    "source_means": "SELECT lang, avg(n_chars) AS mean_n_chars, avg(length(source)) AS mean_name, count(DISTINCT source) AS groups FROM documents GROUP BY lang",
    "changed_ranges": """SELECT doc_id // 100 AS "range", count(*) AS n_one, count(*) FILTER (doc_id % 97 <> 0) AS n_two
FROM documents GROUP BY doc_id // 100 HAVING count(*) FILTER (doc_id % 97 = 0 OR doc_id % 89 = 0) > 0""",
    "close_link_counts": with_(PAIRS + """, ends AS (SELECT "left" AS id FROM pairs UNION ALL SELECT "right" FROM pairs), n AS (SELECT id, count(*) AS n FROM ends GROUP BY id)""", """SELECT id, min(id) OVER (PARTITION BY hash) AS "of", coalesce(n, 0) AS n_links FROM prints LEFT JOIN n USING (id)"""),
    "candidate_members": with_(GROUPS, "SELECT content_group, n, id FROM (SELECT *, count(*) OVER (PARTITION BY content_group) AS n FROM grp) WHERE n > 1"),
    "duplicate_members": "SELECT digest, n, id FROM (SELECT sha256(text) AS digest, doc_id AS id, count(*) OVER (PARTITION BY sha256(text)) AS n FROM documents) WHERE n > 1",
    "box_review_audit": f"""
WITH {BOXES},
s AS (SELECT image AS id, pos, pos % 7 <> 0 AND image % 13 <> 0 AS linked, pos % 7 = 0 OR image % 11 = 0 AS gone, image % 9 <> 0 AND x1 % 2 = 0 AS same FROM refs)
SELECT id, pos AS source_index, CASE WHEN gone AND linked THEN 'unresolved' WHEN gone THEN 'removed' WHEN linked AND same THEN 'kept' WHEN linked THEN 'revised' ELSE 'unresolved' END AS outcome,
  CASE WHEN linked THEN CAST(pos AS VARCHAR) ELSE '' END AS targets FROM s""",
    "mask_union": MASK_UNION,
    "mask_coverage": MASK_COVERAGE,
    "windowed_coverage": MASK_COVERAGE,
    "match_confusion": with_(match(300), f"SELECT *, {RATIOS}, tp + fn AS reference_instances, CAST(fp AS DOUBLE) / {IMAGES} AS false_proposals_per_image FROM (SELECT class, {SUMS} FROM counts GROUP BY class)"),
    "match_table": with_(match(), "SELECT * FROM matches"),
    "match_error_reasons": with_(match(300), "SELECT class, reason, count(*) AS n FROM matches WHERE reason <> 'matched' GROUP BY ALL"),
    "confusion_by_stratum": with_(match(300) + ", spots AS (SELECT image, min(stratum) AS stratum FROM boxes GROUP BY image)", f"SELECT *, {RATIOS} FROM (SELECT class, coalesce(stratum, 'overall') AS stratum, {SUMS} FROM counts JOIN spots USING (image) GROUP BY GROUPING SETS ((class, stratum), (class)))"),
    "threshold_sweep": with_(SWEEP, f"SELECT *, {RATIOS} FROM swept"),
    "best_f1_thresholds": with_(SWEEP, f"SELECT class, threshold, f1 FROM (SELECT class, threshold, {RATIOS} FROM swept) WHERE f1 IS NOT NULL QUALIFY rank() OVER (PARTITION BY class ORDER BY f1 DESC) = 1"),
    "threshold_changes": with_(match(), "SELECT image, class, pred_pos, reason, 'removed' AS change FROM matches WHERE score >= 300 AND score < 500"),
    "target_study": with_(
        match() + f""",
g AS (SELECT unnest(range(50, 1000, 50)) AS threshold), own AS (SELECT * FROM matches WHERE class = 'A'), has AS (SELECT image, count(*) AS refs FROM refs WHERE class = 'A' GROUP BY image),
one AS (SELECT threshold, image, count(*) FILTER (reason = 'matched') AS tp, count(*) FILTER (reason <> 'matched') AS fp, count(*) FILTER (reason = 'duplicate') AS duplicate, count(*) FILTER (reason = 'insufficient_overlap') AS insufficient_overlap, count(*) FILTER (reason = 'no_overlap') AS no_overlap
  FROM own JOIN g ON score >= threshold GROUP BY ALL),
s AS (SELECT threshold, CAST(coalesce(sum(tp), 0) AS BIGINT) AS tp, CAST(coalesce(sum(fp), 0) AS BIGINT) AS fp, CAST(coalesce(sum(duplicate), 0) AS BIGINT) AS duplicate, CAST(coalesce(sum(insufficient_overlap), 0) AS BIGINT) AS insufficient_overlap, CAST(coalesce(sum(no_overlap), 0) AS BIGINT) AS no_overlap,
    count(*) FILTER (fp > 0) AS images_with_false_proposals, CAST(coalesce(sum(fp) FILTER (refs IS NULL), 0) AS BIGINT) AS false_without_target FROM g LEFT JOIN one USING (threshold) LEFT JOIN has USING (image) GROUP BY threshold),
moved AS (SELECT threshold, count(DISTINCT image) AS changed_images FROM own, g WHERE (score >= threshold) <> (score >= 300) GROUP BY threshold),
t AS (SELECT s.*, CAST((SELECT sum(refs) FROM has) AS BIGINT) - tp AS fn, {IMAGES} - (SELECT count(*) FROM has) AS images_without_target, coalesce(changed_images, 0) AS changed_images FROM s LEFT JOIN moved USING (threshold))""",
        f"SELECT threshold, tp, fp, fn, f1, duplicate, insufficient_overlap, no_overlap, images_with_false_proposals, images_without_target, false_without_target, changed_images FROM (SELECT *, {RATIOS} FROM t)",
    ),
    "selection_summary": with_(
        PHOTOS + ", t AS (SELECT id, CASE WHEN id % 10 < 8 THEN 'train' WHEN id % 10 = 8 THEN 'valid' ELSE 'test' END AS split, len(list_filter(classes, lambda c: c = 0)) AS n, len(list_filter(classes, lambda c: c <> 0)) AS other FROM photo)",
        """SELECT split, count(*) AS images, CAST(sum(n) AS BIGINT) AS annotations, CAST(sum(other) AS BIGINT) AS excluded_annotations, count(*) FILTER (n = 0) AS images_without_target,
  array_to_string(list_sort(list(id) FILTER (n = 0))[1:3], ',') AS first_without_target FROM t GROUP BY split""",
    ),
    "origin_split": with_(ORIGINS, "SELECT photo, use FROM uses"),
    "balanced_negatives": with_(
        ORIGINS + """, own AS (SELECT o_orderkey AS patch, photo FROM orders JOIN uses ON photo = o_custkey WHERE use = 'train'),
nth AS (SELECT *, row_number() OVER (PARTITION BY photo ORDER BY sha256('7:' || patch), patch) AS k FROM own)""",
        "SELECT patch, photo FROM nth WHERE k <= greatest(1, 400 // (SELECT count(DISTINCT photo) FROM own)) ORDER BY patch LIMIT 400",
    ),
    "manifest_violations": """WITH r AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 29 = 0 THEN 'easy_0003' WHEN p_partkey % 17 = 0 THEN 'x' || lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') ELSE list_extract(['easy', 'medium', 'hard'], p_partkey % 3 + 1) || '_' || lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') END AS id FROM part),
u AS (SELECT *, count(*) OVER (PARTITION BY id) AS uses FROM r)
SELECT * FROM (SELECT id, CASE WHEN id LIKE 'x%' THEN 'bad_id' WHEN uses > 1 THEN 'repeated_id' WHEN k % 19 = 0 OR (k % 29 = 0 AND (k % 3 <> 0 OR k % 10000 <> 3)) THEN 'identity_differs' WHEN k % 23 = 0 THEN 'already_grouped_or_split' END AS problem FROM u) WHERE problem IS NOT NULL""",
    "collection_violations": """WITH r AS (SELECT c_custkey AS k, c_nationkey AS n, CASE WHEN c_custkey % 29 = 0 THEN 'Photo 1' WHEN c_custkey % 13 = 0 THEN 'twin_' || c_custkey // 26 ELSE 'photo_' || c_custkey END AS id FROM customer),
u AS (SELECT *, count(*) OVER (PARTITION BY id) AS uses FROM r)
SELECT * FROM (SELECT id, CASE WHEN id = 'Photo 1' THEN 'bad_id' WHEN uses > 1 THEN 'repeated_id' WHEN n >= 22 THEN 'unknown_source' WHEN k % 11 = 0 THEN 'reserved_split' WHEN k % 47 = 0 THEN 'bad_asset' WHEN k % 53 = 0 THEN 'unknown_policy'
  WHEN k % 43 = 0 THEN 'no_attribution' WHEN k % 31 = 0 OR k % 37 = 0 OR k % 41 = 0 THEN 'bad_link' WHEN k % 59 = 0 THEN 'decided_too_early' WHEN k % 61 = 0 THEN 'no_note' END AS problem FROM u) WHERE problem IS NOT NULL""",
    "missed_references": with_(match(300), "SELECT image, class, pos FROM refs WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.image = refs.image AND m.class = refs.class AND m.ref_pos = refs.pos)"),
    "eval_compare": with_(
        match() + """,
had AS (SELECT image, class, count(*) AS refs FROM refs GROUP BY ALL),
hit AS (SELECT image, class, count(*) FILTER (reason = 'matched' AND score >= 300) AS t, count(*) FILTER (reason <> 'matched' AND score >= 300) AS f, count(*) FILTER (reason = 'matched' AND score >= 500) AS u, count(*) FILTER (reason <> 'matched' AND score >= 500) AS g FROM matches WHERE score >= 300 GROUP BY ALL),
b AS (SELECT image, class, coalesce(t, 0) AS tp_before, coalesce(f, 0) AS fp_before, coalesce(refs, 0) - coalesce(t, 0) AS fn_before, coalesce(u, 0) AS tp_after, coalesce(g, 0) AS fp_after, coalesce(refs, 0) - coalesce(u, 0) AS fn_after FROM hit FULL JOIN had USING (image, class))""",
        "SELECT *, tp_after - tp_before AS tp_delta, fp_after - fp_before AS fp_delta, fn_after - fn_before AS fn_delta FROM b",
    ),
    "error_rates": with_(match(300), "SELECT image, tp, fp, CAST(fp AS DOUBLE) / nullif(tp + fp, 0) AS false_share FROM (SELECT image, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp FROM counts GROUP BY image)"),
    "box_geometry": with_(BOXES, f"""SELECT p.image, p.pos AS pred_pos, r.pos AS ref_pos, {SHARED} / ({AREAS} - {SHARED}) AS iou,
  {SHARED} / least((p.x2 - p.x1) * (p.y2 - p.y1), (r.x2 - r.x1) * (r.y2 - r.y1)) AS smaller_overlap, {SHARED} > 0 AS meets,
  (greatest(p.x2, r.x2) - least(p.x1, r.x1)) * (greatest(p.y2, r.y2) - least(p.y1, r.y1)) AS union_box_area,
  CASE WHEN p.x2 > 24 OR p.y2 > 24 THEN 'clipped' ELSE 'kept' END AS clip_status, (least(p.x2, 24) - p.x1) * (least(p.y2, 24) - p.y1) AS mask_pixels, p.x2 / 24 - p.x1 / 24 AS normal_width
FROM preds p JOIN refs r ON p.image = r.image AND p.class = r.class"""),
    "negative_crop_conflicts": with_(BOXES, f"SELECT DISTINCT p.image, p.pos FROM preds p JOIN refs r ON p.image = r.image WHERE {SHARED} > 0"),
    "window_grid": """WITH i AS (SELECT p_partkey AS image, p_size * 40 AS w, CAST(floor(p_retailprice) AS BIGINT) % 1500 + 1 AS h FROM part),
x AS (SELECT DISTINCT image, w, h, unnest(list_append(range(0, greatest(w - 640, 0) + 1, 512), greatest(w - 640, 0))) AS x FROM i),
y AS (SELECT DISTINCT image, unnest(list_append(range(0, greatest(h - 640, 0) + 1, 512), greatest(h - 640, 0))) AS y FROM i)
SELECT image, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(least(x + 640, w) - x AS BIGINT) AS width, CAST(least(y + 640, h) - y AS BIGINT) AS height FROM x JOIN y USING (image)""",
    "merge_proposals": with_(MERGE, "SELECT image, class, e.score, e.x1, e.y1, e.x2, e.y2, e.merged_from FROM (SELECT image, class, unnest(kept) AS e FROM ends)"),
    "zone_coverage": with_(
        BOXES + """,
a AS (SELECT DISTINCT image, class, x, unnest(range(CAST(y1 AS BIGINT), CAST(y2 AS BIGINT))) AS y FROM (SELECT *, unnest(range(CAST(x1 AS BIGINT), CAST(x2 AS BIGINT))) AS x FROM refs)),
b AS (SELECT DISTINCT image, class, x, unnest(range(CAST(y1 AS BIGINT), CAST(y2 AS BIGINT))) AS y FROM (SELECT *, unnest(range(CAST(x1 AS BIGINT), CAST(x2 AS BIGINT))) AS x FROM preds WHERE score >= 300)),
c AS (SELECT image, class, count(r) AS rp, count(p) AS pp, count(*) FILTER (r IS NOT NULL AND p IS NOT NULL) AS sp FROM (SELECT *, 1 AS r FROM a) FULL JOIN (SELECT *, 1 AS p FROM b) USING (image, class, x, y) GROUP BY ALL),
t AS (SELECT class, count(*) FILTER (rp > 0) AS expected, count(*) FILTER (rp > 0 AND pp > 0) AS found, count(*) FILTER (pp > 0) AS signalled, count(*) FILTER (pp > 0 AND rp = 0) AS without_reference,
  CAST(sum(rp) AS BIGINT) AS reference_pixels, CAST(sum(pp) AS BIGINT) AS proposal_pixels, CAST(sum(sp) AS BIGINT) AS shared_pixels FROM c GROUP BY class)""",
        f"""SELECT *, CAST({IMAGES} AS BIGINT) AS photos, CAST(found AS DOUBLE) / nullif(expected, 0) AS photo_recall, CAST(found AS DOUBLE) / nullif(signalled, 0) AS photo_precision,
  CAST(shared_pixels AS DOUBLE) / nullif(reference_pixels, 0) AS zone_recall, CAST(shared_pixels AS DOUBLE) / nullif(proposal_pixels, 0) AS zone_precision FROM t""",
    ),
    "hash_bits": with_(PRINTS, "SELECT id, hash FROM prints"),
    "close_pairs": with_(PAIRS, "SELECT * FROM pairs"),
    "similar_pairs": with_(SIMILAR, """SELECT l AS "left", r AS "right", 'similar' AS kind, v AS "view", CAST(distance AS BIGINT) AS distance, error FROM best
UNION ALL SELECT a.id, b.id, 'identical', 0, 0, 0.0 FROM prints a JOIN prints b ON a.digest = b.digest AND a.id < b.id"""),
    "content_groups": with_(GROUPS, "SELECT * FROM grp"),
    "candidate_groups": with_(GROUPS, "SELECT content_group, string_agg(id, ',' ORDER BY id) AS members, count(*) AS n FROM grp GROUP BY content_group HAVING count(*) > 1"),
    "scene_groups": with_(GROUPS, "SELECT content_group, count(*) AS n FROM grp GROUP BY content_group"),
    "quarantine_propagation": with_(
        PHOTOS + ", " + GROUPS + ", bad AS (SELECT grp.id, content_group, quality, bool_or(coalesce(quality = 0, false)) OVER (PARTITION BY content_group) AS quarantined FROM grp JOIN photo USING (id))",
        "SELECT id, content_group, quarantined, CASE WHEN quarantined THEN CASE WHEN quality = 0 THEN 'low quality' ELSE 'linked to a withheld item' END END AS reason FROM bad",
    ),
    "external_roles": with_(
        GROUPS + ', flag AS (SELECT DISTINCT unnest(["left", "right"]) AS id FROM pairs WHERE distance > 6)',
        "SELECT grp.id, content_group, CASE WHEN bool_or(flag.id IS NOT NULL) OVER (PARTITION BY content_group) THEN 'quarantine' WHEN grp.id = content_group THEN 'candidate' ELSE 'variant' END AS role FROM grp LEFT JOIN flag ON grp.id = flag.id",
    ),
    "grouped_split": with_(SPLIT, "SELECT id, content_group, split FROM split"),
    "split_summary": with_(SPLIT, "SELECT split, count(*) AS images, count(DISTINCT content_group) AS groups, count(*) FILTER (len(classes) = 0) AS images_without_class, count(*) FILTER (list_contains(classes, 0)) AS class_0, count(*) FILTER (list_contains(classes, 1)) AS class_1 FROM split GROUP BY split"),
    "crossing_groups": with_(GROUPS, f"SELECT content_group, array_to_string(list_sort(list(DISTINCT {AUTHOR})), ',') AS splits FROM grp GROUP BY content_group HAVING count(DISTINCT {AUTHOR}) > 1"),
    "shared_digests": with_(PHOTOS, f"SELECT digest, array_to_string(list_sort(list(DISTINCT {AUTHOR})), ',') AS splits, count(*) AS n FROM photo GROUP BY digest HAVING count(DISTINCT {AUTHOR}) > 1"),
    "budget_selection": with_(BUDGET, "SELECT content_group, n FROM fold WHERE taken"),
    "bottom_k_panels": with_(MEASURES, "SELECT id, difficulty, readable, row_number() OVER (PARTITION BY difficulty ORDER BY readable, id) AS place FROM measures QUALIFY place <= 3"),
    "first_seen_dedupe": with_(PHOTOS, "SELECT id, digest, count(*) OVER (PARTITION BY digest) AS copies FROM photo QUALIFY row_number() OVER (PARTITION BY digest ORDER BY id) = 1"),
    "flag_counts": with_(MEASURES, "SELECT flag, count(*) AS n FROM (SELECT unnest(reasons) AS flag FROM judged) GROUP BY flag"),
    "photo_verdicts": with_(MEASURES, "SELECT id, verdict, array_to_string(reasons, ',') AS reasons, lost FROM judged"),
    "yolo_parse": with_(LINES, "SELECT id, line, CAST(class_id AS BIGINT) AS class_id, cx, cy, w AS width, h AS height FROM parsed WHERE verdict = 'box'"),
    "yolo_rejects": with_(LINES, "SELECT id, line, verdict AS reason, text FROM parsed WHERE verdict <> 'box'"),
    "yolo_mapped": with_(LINES, """SELECT id, line, CASE class_id WHEN 0 THEN 'coating' ELSE 'mold' END AS class, least(1.0, greatest(0.0, cx - w / 2)) AS x1, least(1.0, greatest(0.0, cy - h / 2)) AS y1, least(1.0, greatest(0.0, cx + w / 2)) AS x2, least(1.0, greatest(0.0, cy + h / 2)) AS y2
FROM num WHERE len(f) = 5 AND regexp_full_match(f[1], '[0-9]+') AND class_id IN (0, 2) AND cx IS NOT NULL AND cy IS NOT NULL AND w > 0 AND h > 0 AND least(cx - w / 2, cy - h / 2) >= -1e-6 AND greatest(cx + w / 2, cy + h / 2) <= 1 + 1e-6"""),
    "coco_export": with_(BOXES, """SELECT row_number() OVER (ORDER BY image, pos) AS annotation_id, dense_rank() OVER (ORDER BY image) AS image_id, CAST(CASE class WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS BIGINT) AS category_id,
  CAST(x1 AS BIGINT) || ',' || CAST(y1 AS BIGINT) || ',' || CAST(x2 - x1 AS BIGINT) || ',' || CAST(y2 - y1 AS BIGINT) AS bbox, (x2 - x1) * (y2 - y1) AS area FROM refs"""),
    "integrity_mismatch": """WITH d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS path, strlen(text) AS size, sha256(text) AS sha FROM documents),
a AS (SELECT * FROM d WHERE doc_id % 17 <> 0),
b AS (SELECT path, CASE WHEN doc_id % 23 = 0 THEN size + 1 ELSE size END AS size, CASE WHEN doc_id % 29 = 0 THEN sha256(path) ELSE sha END AS sha FROM d WHERE doc_id % 19 <> 0),
t AS (SELECT path, CASE WHEN a.sha IS NULL THEN 'missing' WHEN b.sha IS NULL THEN 'unpinned' WHEN a.size <> b.size THEN 'wrong_size' WHEN a.sha <> b.sha THEN 'wrong_digest' END AS problem FROM a FULL JOIN b USING (path))
SELECT * FROM t WHERE problem IS NOT NULL""",
    "companion_orphans": "SELECT doc_id AS stem, 'text' AS role, 't' || doc_id AS name FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'label', 'l' || doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)",
    "label_join_default": "SELECT d.doc_id AS id, count(l.doc_id) AS n_labels, coalesce(string_agg(CAST(quality AS VARCHAR), ',' ORDER BY quality), '') AS labels FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.doc_id",
    "duplicate_groups": "SELECT sha256(text) AS digest, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids FROM documents GROUP BY 1 HAVING count(*) > 1",
    "leaking_groups": """SELECT source || ':' || lang AS content_group, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids FROM documents
GROUP BY 1 HAVING count(*) FILTER (doc_id % 3 = 0) > 0 AND count(*) FILTER (doc_id % 3 <> 0 AND doc_id % 7 <> 0) > 0""",
    "collection_summary": with_(
        PHOTOS,
        """SELECT source, count(*) AS images, count(*) FILTER (len(classes) > 0) AS with_source_boxes, count(*) FILTER (len(classes) = 0) AS to_annotate, count(*) FILTER (quality = 0) AS quarantined,
  count(*) FILTER (id % 8 <> 0) AS turned, count(DISTINCT digest) AS groups, CAST(0 AS BIGINT) AS approved_for_training FROM photo GROUP BY source""",
    ),
    "review_outcomes": f"SELECT outcome, count(*) AS n FROM ({REVIEW_AUDIT}) GROUP BY outcome UNION ALL SELECT 'new', count(*) FROM documents WHERE doc_id % 6 = 0",
    "review_audit": REVIEW_AUDIT,
    "review_coverage": "SELECT id, CASE WHEN r IS NULL THEN 'not_reviewed' ELSE 'unknown_source' END AS side FROM (SELECT doc_id + 1 AS id, 1 AS r FROM labels) FULL JOIN (SELECT doc_id AS id, 1 AS s FROM documents) USING (id) WHERE r IS NULL OR s IS NULL",
    "alert_rates": """WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'clear' ELSE 'cracked' END AS arm, max(length(text) % 4) OVER (PARTITION BY conv_id, turn) AS alerts FROM conversations),
u AS (SELECT DISTINCT * FROM t)
SELECT arm, count(*) AS patches, count(DISTINCT conv_id) AS groups, count(*) FILTER (alerts > 0) AS with_alert, CAST(count(*) FILTER (alerts > 0) AS DOUBLE) / count(*) AS rate FROM u GROUP BY arm""",
    "last_metric_values": "SELECT user_id, arg_max(value, (ts, event_id)) FILTER (event_id % 3 = 0) AS loss, arg_max(value, (ts, event_id)) FILTER (event_id % 5 = 0) AS score FROM events GROUP BY user_id",
    "journal_validation": with_(
        JOURNAL + ", " + ANALYSES + """, t AS (SELECT journal.*, analysed_at, since, row_number() OVER w AS want, lag(recorded_at) OVER w AS before, count(*) OVER (PARTITION BY analysis, request_id) AS uses
  FROM journal JOIN analyses USING (analysis) LEFT JOIN known USING (analysis, finding) WINDOW w AS (PARTITION BY analysis ORDER BY revision, recorded_at)),
u AS (SELECT analysis, revision, CASE WHEN revision <> want THEN 'broken_sequence' WHEN recorded_at < analysed_at THEN 'before_analysis' WHEN recorded_at < before THEN 'time_goes_back' WHEN occurred_at > recorded_at THEN 'observed_after_recording' WHEN uses > 1 THEN 'repeated_request'
  WHEN kind = 'review' AND class IS NOT NULL AND decision <> 'confirmed' THEN 'class_without_confirmation' WHEN since IS NULL OR revision < since THEN 'unknown_finding' END AS problem FROM t)""",
        "SELECT * FROM u WHERE problem IS NOT NULL",
    ),
    "journal_replay": with_(
        JOURNAL + """, e AS (SELECT known.analysis, known.finding, own, revision, kind, decision, status, coalesce(class, own) AS eff, row_number() OVER (PARTITION BY known.analysis, known.finding ORDER BY revision) AS k
  FROM journal JOIN known ON journal.analysis = known.analysis AND journal.finding = known.finding AND revision >= since),
st AS (
  SELECT analysis, finding, CAST(0 AS BIGINT) AS k, 'proposed' AS state, CAST(NULL AS VARCHAR) AS effective_class, 'not_assessed' AS correction, CAST(0 AS BIGINT) AS n_notes, CAST(0 AS BIGINT) AS n_reviews, CAST(0 AS BIGINT) AS refused FROM known
  UNION ALL
  SELECT e.analysis, e.finding, e.k, CASE WHEN e.kind = 'review' THEN e.decision ELSE st.state END, CASE WHEN e.kind = 'review' THEN e.eff ELSE st.effective_class END,
    CASE WHEN e.kind = 'review' AND (e.decision IS DISTINCT FROM st.state OR e.eff IS DISTINCT FROM st.effective_class) THEN 'not_assessed' WHEN e.kind = 'correction' AND st.state = 'confirmed' THEN e.status ELSE st.correction END,
    st.n_notes + CASE WHEN e.kind IN ('note', 'manual') THEN 1 ELSE 0 END, st.n_reviews + CASE WHEN e.kind = 'review' THEN 1 ELSE 0 END, st.refused + CASE WHEN e.kind = 'correction' AND st.state <> 'confirmed' THEN 1 ELSE 0 END
  FROM st JOIN e ON st.analysis = e.analysis AND st.finding = e.finding AND e.k = st.k + 1)""",
        "SELECT analysis, finding, state, effective_class, correction, n_notes, n_reviews, refused FROM st QUALIFY k = max(k) OVER (PARTITION BY analysis, finding)",
    ),
    "journal_append": with_(
        JOURNAL + """, j AS (SELECT analysis, revision, request_id, sha256(concat_ws('|', kind, decision, class, status)) AS digest FROM journal),
l AS (SELECT analysis, max(revision) AS n FROM j GROUP BY ALL),
r AS (SELECT j.analysis, CASE WHEN j.analysis % 4 < 2 THEN request_id ELSE 'new' END AS request_id, CASE WHEN j.analysis % 4 = 1 THEN sha256('x') ELSE digest END AS digest, CASE WHEN j.analysis % 4 = 3 THEN n ELSE 1 END AS expected, n FROM j JOIN l USING (analysis) WHERE revision = 2)""",
        "SELECT r.analysis, r.request_id, CASE WHEN k.digest = r.digest THEN 'no_op' WHEN k.digest IS NOT NULL THEN 'conflict' WHEN expected <> r.n THEN 'stale' ELSE 'append' END AS outcome FROM r LEFT JOIN j k ON k.analysis = r.analysis AND k.request_id = r.request_id",
    ),
    "journal_requests": with_(REQUESTS, "SELECT analysis, recorded_at, request_id, kind, problem, occurred_at, CASE WHEN proofs = 'twice' THEN 2 WHEN proofs IN ('one', 'short') THEN 1 ELSE 0 END AS n_evidence FROM checked"),
    "manual_findings": with_(
        ADDED,
        """SELECT analysis, substr(sha256('["' || analysis || '","' || request_id || '","manual"]'), 1, 32) AS finding, 'human' AS origin, 'proposed' AS state, class,
  CASE WHEN class IN ('surface_loss', 'peeling_paint') THEN 'surface_damage' ELSE class END AS family,
  CASE class WHEN 'crack' THEN 'Fissures' WHEN 'surface_loss' THEN 'Pertes de matière' WHEN 'mold_suspected' THEN 'Moisissures suspectées' WHEN 'moisture_trace' THEN 'Traces compatibles avec l''humidité' ELSE 'Revêtement écaillé ou décollé' END AS label,
  CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2, round(x1 / CAST(width AS DOUBLE), 9) AS nx1, round(y1 / CAST(height AS DOUBLE), 9) AS ny1, round(x2 / CAST(width AS DOUBLE), 9) AS nx2, round(y2 / CAST(height AS DOUBLE), 9) AS ny2,
  photo_sha256, actor, recorded_at FROM added WHERE refused IS NULL""",
    ),
    "manual_refused": with_(ADDED, "SELECT analysis, request_id, refused AS problem FROM added WHERE refused IS NOT NULL"),
    "finding_dedupe": with_(DETECTIONS, "SELECT analysis, slot, idx, class, score FROM rival WHERE reason IS NULL AND nth = 1"),
    "finding_withheld": with_(DETECTIONS, "SELECT analysis, idx, coalesce(reason, 'duplicate_geometry') AS reason FROM rival WHERE reason IS NOT NULL OR nth > 1"),
    "average_precision": " UNION ALL ".join(f"SELECT * FROM (WITH RECURSIVE {ap_ctes(t)} {ap(t)})" for t in (0.5 + 0.05 * k for k in range(10))),
    "import_report": with_(PHOTOS, "SELECT difficulty, count(*) AS n, count(*) FILTER (len(classes) = 0) AS without_class, count(*) FILTER (list_contains(classes, 0)) AS class_0, count(DISTINCT digest) AS digests FROM photo GROUP BY difficulty"),
    "journal_activity": with_(JOURNAL, "SELECT date_trunc('day', recorded_at) AS start, kind, count(*) AS n FROM journal GROUP BY ALL"),
    "evidence_counts": with_(JOURNAL, "SELECT analysis, count(DISTINCT status) AS states, count(*) FILTER (status = 'resolved') AS resolved FROM journal WHERE kind = 'correction' GROUP BY analysis"),
}
