"""SQL for the corpus queries that it can express: the same results by plain joins over all pairs that could matter."""

from __future__ import annotations

from chronofold.llm.lines import MIN_CHARS
from chronofold.llm.near_dedup import PERCENT
from chronofold.llm.substrings import LENGTH

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINES = f"""
WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS number, len(lines) AS n FROM t),
c AS (SELECT line, min(struct_pack(doc_id := doc_id, number := number)) AS first FROM l WHERE length(line) >= {MIN_CHARS} GROUP BY line),
near AS (SELECT DISTINCT b.line FROM c a JOIN c b ON length(a.line) BETWEEN length(b.line) - 1 AND length(b.line) + 1
  AND (substr(a.line, 1, length(b.line) // 2) = substr(b.line, 1, length(b.line) // 2) OR right(a.line, (length(b.line) - 1) // 2) = right(b.line, (length(b.line) - 1) // 2))
  AND a.first < b.first AND levenshtein(a.line, b.line) <= 1),
k AS (SELECT l.*, length(l.line) >= {MIN_CHARS} AND (c.first <> struct_pack(doc_id := l.doc_id, number := l.number) OR near.line IS NOT NULL) AS gone
  FROM l LEFT JOIN c USING (line) LEFT JOIN near USING (line))
SELECT doc_id, max(n) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY number) FILTER (NOT coalesce(gone, false)), '')) AS kept_sha256 FROM k GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, sha256('') FROM documents WHERE text IS NULL
"""

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
s AS (SELECT doc_id, b, octet_length(b) AS n FROM d),
w AS MATERIALIZED (SELECT doc_id, p, md5(hex(b[p + 1 : p + {LENGTH}])) AS h FROM (SELECT doc_id, b, unnest(range(n - {LENGTH - 1})) AS p FROM s WHERE n >= {LENGTH})),
r AS (SELECT doc_id, p FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
i AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (SELECT doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {LENGTH} OR lag(p) OVER (PARTITION BY doc_id ORDER BY p) IS NULL THEN 1 ELSE 0 END AS new FROM r)),
g AS (SELECT doc_id, min(p) AS a, max(p) + {LENGTH} AS e FROM i GROUP BY doc_id, run),
x AS (SELECT doc_id, list(a ORDER BY a) AS a, list(e ORDER BY a) AS e, sum(e - a) AS gone, count(*) AS spans FROM g GROUP BY doc_id)
SELECT s.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(CASE WHEN a IS NULL THEN b ELSE unhex(array_to_string(list_transform(range(1, len(a) + 2), lambda k: hex(b[coalesce(e[k - 1], 0) + 1 : coalesce(a[k], n)])), '')) END) AS kept_sha256
FROM s LEFT JOIN x USING (doc_id)
"""

NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {PERCENT} * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS id, doc_id AS other FROM documents UNION SELECT r.id, l.b FROM reach r JOIN both_ways l ON l.a = r.other)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, m AS component_id, n.doc_id = m AS kept
FROM n JOIN (SELECT id, min(other) AS m FROM reach GROUP BY id) ON id = n.doc_id
"""
