"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .common import ALNUM, LOWER, SPACED, UPPER
from .licenses import PHRASES, TEMPLATES
from .placement import SLOTS, fill

_LOW = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

NEAREST = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND list_bool_and(list_transform(embedding, lambda e: e IS NOT NULL AND isfinite(e)))
    AND list_bool_or(list_transform(embedding, lambda e: e <> 0))),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.x) = len(c.x))
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20
"""

TOOL_CALLS = """
WITH e AS (
  SELECT conv_id AS conv, CAST(turn AS BIGINT) AS turn,
    CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
    CASE role WHEN 'user' THEN conv_id || ':' || turn WHEN 'assistant' THEN conv_id || ':' || (turn - 1) END AS id, role, text
  FROM conversations),
k AS (SELECT *, min(turn) OVER (PARTITION BY conv, kind, id) AS first FROM e),
ends AS (SELECT conv, id, min(turn) FILTER (kind = 'call') AS call, min(turn) FILTER (kind = 'result') AS result FROM e WHERE kind <> 'message' GROUP BY conv, id),
-- a call stands on the reply two turns before it, if there is one; unbroken runs of such calls count up by two
chain AS (
  SELECT a.conv, a.id, a.call, b.result IS NOT NULL AS after, b.call IS NOT NULL AS deep
  FROM ends a LEFT JOIN ends b ON a.conv = b.conv AND b.id = a.conv || ':' || (a.call - 2) WHERE a.call IS NOT NULL),
runs AS (SELECT *, sum(CASE WHEN after AND deep THEN 0 ELSE 1 END) OVER (PARTITION BY conv, call % 2 ORDER BY call) AS run FROM chain),
deep AS (
  SELECT conv, id, 2 * (row_number() OVER (PARTITION BY conv, call % 2, run ORDER BY call) - 1) AS steps, after AND NOT deep AS lone FROM runs),
level AS (SELECT conv, id, CAST(greatest(steps, CASE WHEN lone THEN 1 ELSE 0 END) AS INTEGER) AS level FROM deep),
l AS (
  SELECT k.*, turn = first AS nth, ends.call IS NOT NULL AND ends.result IS NOT NULL AND turn = first AND kind <> 'message' AS linked, level.level AS base
  FROM k LEFT JOIN ends ON k.conv = ends.conv AND k.id = ends.id LEFT JOIN level ON k.conv = level.conv AND k.id = level.id)
SELECT conv, CAST(CASE WHEN kind = 'call' AND nth THEN base WHEN kind = 'result' AND linked THEN base + 1 ELSE 0 END AS INTEGER) AS level, turn, 0::INTEGER AS part, kind, id, coalesce(linked, false) AS linked,
  array_to_string(list_concat(
    CASE WHEN kind = 'message' OR linked THEN []::VARCHAR[] WHEN kind = 'call' THEN ['no result'] ELSE ['no call'] END,
    CASE WHEN kind <> 'message' AND NOT nth THEN ['repeated id'] ELSE []::VARCHAR[] END,
    CASE WHEN kind = 'call' AND text IS NULL THEN ['missing prompt'] WHEN kind = 'call' AND length(text) > 200 THEN ['length prompt'] ELSE []::VARCHAR[] END), ',') AS problems,
  CASE kind
    WHEN 'call' THEN CAST(json_object('arguments', json_object('prompt', text), 'id', id, 'kind', kind, 'name', 'reply', 'turn', turn) AS VARCHAR)
    WHEN 'result' THEN CAST(json_object('content', text, 'id', id, 'kind', kind, 'turn', turn) AS VARCHAR)
    ELSE CAST(json_object('content', text, 'kind', kind, 'name', role, 'turn', turn) AS VARCHAR) END AS json
FROM l
"""

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{ALNUM}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOW}, '{ALNUM}') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
iw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (
  SELECT doc_id, p, size, array_to_string(w[p : p + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, sizes WHERE len(w) >= size)),
hit AS (SELECT doc_id, p, dw.size, item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.size = iw.size),
words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS pos FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

MIXING = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{SPACED}')) AS BIGINT) AS size,
    (CAST('0x' || substr(md5('11:' || coalesce(CAST(doc_id AS VARCHAR), 'text:' || coalesce(text, ''))), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(size) AS DOUBLE) * 2.0 AS cap,
    CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM d GROUP BY source),
l AS (
  SELECT 0 AS round, 0.0::DOUBLE AS level, true AS grew
  UNION ALL
  SELECT round + 1, greatest(level, coalesce(new, level)), coalesce(new, level) > level
  FROM (
    SELECT round, level, (
      SELECT (CAST(sum(source_size) AS DOUBLE) * 1.5 - coalesce(sum(cap) FILTER (weight * level > cap), 0.0)) / nullif(coalesce(sum(weight) FILTER (NOT weight * level > cap), 0.0), 0.0) FROM s) AS new
    FROM l WHERE grew)),
t AS (SELECT source, source_size, least(cap, weight * (SELECT max(level) FROM l)) AS target FROM s),
e AS (SELECT *, coalesce(target / nullif(CAST(source_size AS DOUBLE), 0.0), 0.0) AS each FROM t),
p AS (SELECT *, floor(each) AS whole, each - floor(each) AS p, target - floor(each) * source_size AS rest FROM e),
j AS (
  SELECT d.*, source_size, target, whole, p, rest, CASE WHEN p > 0 AND rest > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS r
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
ties AS (SELECT source, r, rest, sum(size) AS words FROM j WHERE r IS NOT NULL AND size > 0 GROUP BY source, r, rest),
mids AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY r) - words / 2 AS mid, sum(words) OVER (PARTITION BY source) AS every FROM ties),
edge AS (SELECT source, max(r) FILTER (mid <= rest) AS last, bool_and(every <= rest) AS everything FROM mids GROUP BY source)
SELECT doc_id, size, source_size, target,
  CAST((whole + CASE WHEN r IS NOT NULL AND (coalesce(everything, true) OR r <= last) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM j LEFT JOIN edge ON j.source IS NOT DISTINCT FROM edge.source
"""

JACCARD = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_LOW}, '{SPACED}') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[p : p + 3], ' ')) AS t
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM g a JOIN g b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * same >= 85 * (x.n + y.n - same)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d
  UNION
  SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) m USING (doc_id)
"""


def _rows(table: dict[str, str]) -> str:
    return ", ".join(f"('{text}', '{label}')" for text, label in table.items())


LICENSES = f"""
WITH d AS (SELECT doc_id, {_LOW} AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '{ALNUM}') AS w FROM d),
phrases AS (SELECT string_split(text, ' ') AS p, label FROM (VALUES {_rows(PHRASES)}) AS x(text, label)),
raw AS (SELECT row_number() OVER () AS id, string_split(text, ' ') AS all_words, list_distinct(string_split(text, ' ')) AS words, label FROM (VALUES {_rows(TEMPLATES)}) AS x(text, label)),
sized AS (SELECT *, CAST(ceil(len(words) * 4 / 5.0) AS BIGINT) AS need, CAST(ceil(len(all_words) * 5 / 4.0) AS BIGINT) AS width FROM raw),
told AS (SELECT t.id, list_distinct(flatten(list(list_filter(t.words, lambda x: NOT list_contains(u.words, x))))) AS telling FROM sized t JOIN sized u ON t.label <> u.label AND len(list_intersect(t.words, u.words)) >= t.need GROUP BY t.id),
templates AS (SELECT sized.*, coalesce(telling, []::VARCHAR[]) AS telling FROM sized LEFT JOIN told USING (id)),
places AS (
  SELECT doc_id, pos - 1 AS pos, label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM w WHERE len(w) > 0), phrases
  WHERE w[pos] = p[1] AND w[pos : pos + len(p) - 1] = p),
base AS (SELECT doc_id, count(*) AS n, min(pos) AS lo, max(pos) AS hi, list_sort(list_distinct(list(label))) AS labels FROM places GROUP BY doc_id),
able AS (SELECT doc_id, w, id, words, width, need, telling, label FROM w, templates WHERE len(list_intersect(list_distinct(w), words)) >= need),
heads AS (SELECT *, unnest(range(1, len(w) + 1)) AS pos FROM able),
windows AS (
  SELECT doc_id, id, label, pos, width, len(words) AS size, need, telling, list_distinct(list_filter(w[pos : pos + width - 1], lambda x: list_contains(words, x))) AS has FROM heads WHERE list_contains(words, w[pos])),
good AS (SELECT *, len(has) AS n FROM windows WHERE len(has) >= need AND len(list_intersect(has, telling)) = len(telling)),
marked AS (SELECT *, CASE WHEN pos < lag(pos) OVER p + width THEN 0 ELSE 1 END AS fresh FROM good WINDOW p AS (PARTITION BY doc_id, id ORDER BY pos)),
grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, id ORDER BY pos) AS place FROM marked),
spots AS (SELECT doc_id, id, place, label, min(pos) AS start, max(pos) + any_value(width) AS stop, max(n) AS n, max(n) / any_value(size)::DOUBLE AS share FROM grouped GROUP BY doc_id, id, place, label),
found AS (
  SELECT * FROM spots s WHERE NOT EXISTS (SELECT 1 FROM spots o WHERE o.doc_id = s.doc_id AND o.label <> s.label AND o.start < s.stop AND s.start < o.stop AND (o.share > s.share OR o.share = s.share AND o.n > s.n))),
method AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS share FROM found GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(base.n, 0) AS BIGINT) AS n_base, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word,
  coalesce(array_to_string(base.labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []::VARCHAR[]), coalesce(method.labels, []::VARCHAR[])))), ','), '') AS labels,
  CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN method USING (doc_id)
"""

#: The slots as the operator fills them; the rest of the placement is SQL's own.
SHARDING = f"""
WITH t AS (SELECT {fill([f'shard-{i:03d}' for i in range(64)]).tolist()}::INTEGER[] AS shards),
d AS (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 15) AS BIGINT) % {SLOTS} AS slot, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes FROM documents)
SELECT doc_id, slot, shards[slot + 1] AS shard, n_bytes FROM d, t
"""

#: The metrics' formulas, slacks and sides, as rules.METRICS has them.
RULES = f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w FROM documents),
trios AS (SELECT doc_id, p, array_to_string(w[p : p + 2], ' ') AS trio FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) > 2)),
twice AS (SELECT doc_id, p FROM trios QUALIFY count(*) OVER (PARTITION BY doc_id, trio) > 1),
covered AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS pos FROM twice) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{SPACED}') GROUP BY doc_id),
c AS (
  SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(regexp_extract_all(t, '[!?]')) AS BIGINT) AS n_marks,
    CAST(coalesce(lines.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
m AS (
  SELECT doc_id, lang, source, base_failed, unnest([
    {{'metric': 1, 'slack': 200, 'low': true, 'v': 100 * word_chars // greatest(n_words, 1)}}, {{'metric': 2, 'slack': 150, 'low': false, 'v': 1000 * n_symbols // greatest(n_words, 1)}},
    {{'metric': 3, 'slack': 100, 'low': false, 'v': 1000 * n_marks // greatest(n_words, 1)}}, {{'metric': 4, 'slack': 500, 'low': false, 'v': 1000 * n_dup_lines // greatest(n_lines, 1)}},
    {{'metric': 5, 'slack': 450, 'low': false, 'v': 1000 * n_repeat_words // greatest(n_words, 1)}}], recursive := true) FROM f),
-- below 64 each value has a bucket; above, the six leading bits and how many follow
b AS (SELECT lang, source, metric, slack, low, v, greatest(0, length(bin(v)) - 6) AS shift FROM m WHERE NOT base_failed),
e AS (SELECT *, (v >> shift) << shift AS lo, (((v >> shift) + 1) << shift) - 1 AS hi FROM b),
wide AS (SELECT 1 AS level, lang, source, metric, slack, low, lo, hi FROM e UNION ALL SELECT 2, lang, NULL, metric, slack, low, lo, hi FROM e UNION ALL SELECT 3, NULL, NULL, metric, slack, low, lo, hi FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY level, lang, source, metric ORDER BY lo) AS rank, count(*) OVER (PARTITION BY level, lang, source, metric) AS total FROM wide),
q AS (
  SELECT level, lang, source, metric, slack, low, max(total) AS total, min(lo) FILTER (1000 * rank >= 250 * total) AS q1, min(hi) FILTER (1000 * rank >= 750 * total) AS q3
  FROM r GROUP BY ALL),
g AS (SELECT *, q3 + greatest(3 * (q3 - q1), slack) AS top, CASE WHEN low THEN q1 - greatest(3 * (q3 - q1), slack) END AS bottom FROM q),
judged AS (
  SELECT m.doc_id, bool_or(coalesce(v > CASE WHEN own.total >= 100 THEN own.top WHEN tongue.total >= 100 THEN tongue.top ELSE world.top END, false)
    OR coalesce(v < CASE WHEN own.total >= 100 THEN own.bottom WHEN tongue.total >= 100 THEN tongue.bottom ELSE world.bottom END, false)) AS broken
  FROM m LEFT JOIN g own ON own.level = 1 AND own.metric = m.metric AND own.lang IS NOT DISTINCT FROM m.lang AND own.source IS NOT DISTINCT FROM m.source
    LEFT JOIN g tongue ON tongue.level = 2 AND tongue.metric = m.metric AND tongue.lang IS NOT DISTINCT FROM m.lang
    LEFT JOIN g world ON world.level = 3 AND world.metric = m.metric
  WHERE NOT base_failed GROUP BY m.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(broken, false) AS kept
FROM f LEFT JOIN judged USING (doc_id)
"""

#: Two rounds, written out; a distance and its entry are one number, so the least has the lower entry.
VECTOR_CODES = """
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda e: e IS NOT NULL AND isfinite(e)))),
p AS MATERIALIZED (SELECT vec_id, label, part, q[part * (len(q) // 16) + 1 : (part + 1) * (len(q) // 16)] AS x FROM (SELECT *, unnest(range(16)) AS part FROM v)),
book0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM p QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= 64),
near0 AS MATERIALIZED (
  SELECT vec_id, label, p.part, p.x, min(list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i])))::BIGINT * 64 + b.entry) AS best
  FROM p JOIN book0 b USING (part) GROUP BY vec_id, label, p.part, p.x),
sums1 AS (SELECT part, best % 64 AS entry, place, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM (SELECT part, best, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS place FROM near0) GROUP BY ALL),
means1 AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY place) AS x FROM sums1 GROUP BY part, entry),
book1 AS MATERIALIZED (SELECT part, entry, coalesce(m.x, b.x) AS x FROM book0 b LEFT JOIN means1 m USING (part, entry)),
near1 AS MATERIALIZED (
  SELECT vec_id, label, p.part, p.x, min(list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i])))::BIGINT * 64 + b.entry) AS best
  FROM p JOIN book1 b USING (part) GROUP BY vec_id, label, p.part, p.x),
sums2 AS (SELECT part, best % 64 AS entry, place, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM (SELECT part, best, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS place FROM near1) GROUP BY ALL),
means2 AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY place) AS x FROM sums2 GROUP BY part, entry),
book2 AS MATERIALIZED (SELECT part, entry, coalesce(m.x, b.x) AS x FROM book1 b LEFT JOIN means2 m USING (part, entry)),
near2 AS MATERIALIZED (
  SELECT vec_id, label, p.part, p.x, min(list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i])))::BIGINT * 64 + b.entry) AS best
  FROM p JOIN book2 b USING (part) GROUP BY vec_id, label, p.part, p.x),
coded AS (SELECT vec_id, label, string_agg(printf('%02x', best % 64), '' ORDER BY part) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM near2 GROUP BY vec_id, label),
digest AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, digest
"""

ORACLES = {"op13_vector_codes": VECTOR_CODES, "op11_quality_rules": RULES, "op6_sharding": SHARDING, "op2_nearest_neighbours": NEAREST, "op3_tool_calls": TOOL_CALLS, "op5_decontaminate": DECONTAMINATE, "op7_mixing": MIXING, "op8_jaccard_join": JACCARD, "op10_licenses": LICENSES}
