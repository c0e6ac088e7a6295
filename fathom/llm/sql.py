"""SQL twins of queries whose whole result SQL can express."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from fathom.llm import chat

LOW = f"translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}')"

DECONTAMINATE = rf"""WITH d AS (SELECT doc_id, regexp_extract_all({LOW}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({LOW}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, m, array_to_string(w[j : j + m - 1], ' ') AS k FROM (SELECT item_id, w, least(13, len(w)) AS m, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS j FROM i WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM win),
dw AS (SELECT doc_id, m, p, array_to_string(w[p : p + m - 1], ' ') AS k FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, ms WHERE len(w) >= m)),
hit AS (SELECT dw.doc_id, dw.m, dw.p, win.item_id FROM dw JOIN win ON win.m = dw.m AND win.k = dw.k),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM hit) GROUP BY 1),
named AS (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit),
it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM named GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id"""

JACCARD = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[j : j + 2], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS j FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
e AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY 1) c ON c.a = d.doc_id"""

SQL = {"op3_decontaminate": DECONTAMINATE, "op7_jaccard_join": JACCARD, "op8_chat_rotation": chat.SQL}
