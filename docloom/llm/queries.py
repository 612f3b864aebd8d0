"""The queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from .op1_langid import op1_langid
from .op2_quality import op2_quality
from .op3_html import op3_html
from .op4_jaccard import op4_jaccard
from .op5_mixing import op5_mixing
from .op7_lm import op7_lm
from .op8_packing import op8_packing
from .op9_pii import op9_pii
from .op10_embeddings import op10_embeddings
from .op6_licenses import op6_licenses
from .op11_sharding import op11_sharding
from .op12_vectorcodes import op12_vectorcodes
from .op13_repair import op13_repair

QUERIES = {f.__name__: f for f in (op1_langid, op2_quality, op3_html, op4_jaccard, op5_mixing, op6_licenses, op7_lm, op8_packing, op9_pii, op10_embeddings, op11_sharding, op12_vectorcodes, op13_repair)}



def _codes_sql(rounds: int = 6) -> str:
    """Lloyd rounds over all parts and entries: one pair of steps a round."""
    near = """SELECT r, p, min(struct_pack(d := d, j := j)) AS near FROM (
    SELECT a.r, a.p, c.j, list_sum(list_transform(list_zip(a.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts a JOIN c{k} c USING (p)) GROUP BY r, p"""
    steps = "".join(
        f""",
a{k} AS ({near.format(k=k)}),
m{k} AS (SELECT p, j, list(floored ORDER BY place) AS x FROM (
    SELECT p, j, place, (s - ((s % n) + n) % n) // n AS floored FROM (
      SELECT a.p, a.near.j AS j, place, sum(b.x[place])::BIGINT AS s, count(*) AS n FROM a{k} a JOIN parts b USING (r, p), range(1, 9) t(place) GROUP BY a.p, a.near.j, place)) GROUP BY p, j),
c{k + 1} AS (SELECT c.p, c.j, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN m{k} m USING (p, j))"""
        for k in range(rounds)
    )
    return f"""
WITH v AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS r, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (SELECT r, p, list_slice(e, p * (len(e) // 8) + 1, (p + 1) * (len(e) // 8)) AS x FROM v, range(8) t(p)),
c0 AS (SELECT p, r AS j, x FROM parts WHERE r < 16){steps},
last AS ({near.format(k=rounds)}),
sha AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, j)) AS codebooks_sha256 FROM c{rounds}),
coded AS (SELECT r, string_agg(printf('%02x', near.j), '' ORDER BY p) AS code, sum(near.d)::BIGINT AS error FROM last GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN v USING (r), sha
"""


#: crc32 by bits, and the costs and least letters of what is left from each state, from the last row of a conversation back.
_REPAIR_SQL = r"""
WITH RECURSIVE word AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')) AS key FROM conversations
), faults AS (
  SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(key) + 1), lambda i: list_transform(range(0, 8), lambda b: ((ascii(substr(key, i, 1)) >> b) & 1)::BIGINT)))),
    lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384))) % 20 AS fault FROM word
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM faults, range(2) t(copy) WHERE fault <> 0 AND (copy = 0 OR fault = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS k, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS ink FROM damaged
), marked AS (
  SELECT *, CASE WHEN ink = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN right(ink, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault, left(role, 1) AS initial,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS earlier FROM placed
), sums AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated,
    count_if(earlier IS NOT NULL AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv_id
), best AS (
  SELECT conv_id, n AS k, {c: 0, x: ''} AS nothing, {c: 10, x: 'II'} AS s, {c: 5, x: 'I'} AS u, {c: 0, x: ''} AS a FROM sums
  UNION ALL
  SELECT conv_id, k, least(b0, {c: 5 + least(b2, {c: 5 + b3.c, x: 'I' || b3.x}).c, x: 'I' || least(b2, {c: 5 + b3.c, x: 'I' || b3.x}).x}), least(b1, {c: 5 + least(b2, {c: 5 + b3.c, x: 'I' || b3.x}).c, x: 'I' || least(b2, {c: 5 + b3.c, x: 'I' || b3.x}).x}),
    least(b2, {c: 5 + b3.c, x: 'I' || b3.x}), least(b3, {c: 5 + b2.c, x: 'I' || b2.x})
  FROM (SELECT conv_id, k,
    least({c: 2 + nothing.c, x: 'D' || nothing.x}, {c: kept + CASE WHEN initial = 's' THEN s.c WHEN initial = 'u' THEN u.c ELSE 999999999 END, x: 'K' || CASE WHEN initial = 's' THEN s.x ELSE u.x END}, {c: 1 + kept + u.c, x: 'R' || u.x}) AS b0,
    least({c: 2 + s.c, x: 'D' || s.x}, {c: kept + CASE WHEN initial = 'u' THEN u.c ELSE 999999999 END, x: 'K' || u.x}, {c: 1 + kept + u.c, x: 'R' || u.x}) AS b1,
    least({c: 2 + u.c, x: 'D' || u.x}, {c: kept + CASE WHEN initial = 'a' THEN a.c ELSE 999999999 END, x: 'K' || a.x}, {c: 1 + kept + a.c, x: 'R' || a.x}) AS b2,
    least({c: 2 + a.c, x: 'D' || a.x}, {c: kept + CASE WHEN initial = 'u' THEN u.c ELSE 999999999 END, x: 'K' || u.x}, {c: 1 + kept + u.c, x: 'R' || u.x}) AS b3
    FROM (SELECT b.conv_id, b.k - 1 AS k, nothing, s, u, a, initial, CASE fault WHEN 'blank' THEN 999999999 WHEN 'duplicate' THEN 999999999 WHEN 'truncated' THEN 5 ELSE 0 END AS kept
      FROM best b JOIN marked m ON m.conv_id IS NOT DISTINCT FROM b.conv_id AND m.k = b.k))
), audits AS (SELECT conv_id, nothing.c AS cost, nothing.x AS audit FROM best WHERE k = 0),
letters AS (SELECT conv_id, i, substr(audit, i, 1) AS x, length(replace(left(audit, i), 'I', '')) AS k, i - length(replace(left(audit, i), 'D', '')) AS gone FROM audits, range(1, length(audit) + 1) t(i)),
said AS (
  SELECT l.conv_id, l.i, l.x, m.role, m.text, l.i - l.gone - coalesce(max(CASE WHEN l.x = 'K' AND m.initial = 's' THEN 1 END) OVER (PARTITION BY l.conv_id ORDER BY l.i), 0) AS nth
  FROM letters l LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM l.conv_id AND m.k = l.k AND l.x <> 'I' WHERE l.x <> 'D'
), digests AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN x = 'K' THEN role || ':' || text ELSE CASE WHEN nth % 2 = 1 THEN 'user:' ELSE 'assistant:' END || coalesce(text, '') END, chr(10) ORDER BY i)) AS sha FROM said GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN digests d ON d.conv_id IS NOT DISTINCT FROM c.conv_id
"""

ORACLE_SQL = {
    "op13_repair": _REPAIR_SQL,
    "op12_vectorcodes": _codes_sql(),
    "op4_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), sh AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' ')) END) AS s FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sh),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), both_ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(doc_id, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, p.b FROM reach r JOIN both_ways p ON p.a = r.node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.c AS component_id
FROM sh s JOIN (SELECT doc_id, min(node) AS c FROM reach GROUP BY doc_id) r USING (doc_id)
""",
    "op10_embeddings": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach(vec_id, node) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, p.b FROM reach r JOIN pairs p ON p.a = r.node)
SELECT e.vec_id, CAST((SELECT count(*) FROM pairs p WHERE p.a = e.vec_id) AS BIGINT) AS n_links, c.c AS component_id, e.vec_id = c.c AS kept
FROM embeddings e JOIN (SELECT vec_id, min(node) AS c FROM reach GROUP BY vec_id) c USING (vec_id)
""",
}
