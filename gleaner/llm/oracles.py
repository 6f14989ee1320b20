"""SQL of the contracts that SQL can state; DuckDB runs it on the same tables. It is a second statement of the contract, not the method."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str, pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{pattern}')"


BENCH_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PLAIN_WORD = r"[^\x20\x09-\x0D]+"

OP1 = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_words('text', BENCH_WORD)} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, w, least(13, len(w)) AS n FROM (SELECT item_id, {_words('text', BENCH_WORD)} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM i)),
dw AS (SELECT rid, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS k FROM
 (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)),
hit AS (SELECT rid, s, n, item FROM dw JOIN win USING (n, k)),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT rid, s, n FROM hit)) GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)"""

OP5 = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, {_words('text', PLAIN_WORD)} AS w FROM documents),
sh AS (SELECT DISTINCT rid, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]) END) AS g FROM d WHERE len(w) > 0),
n AS (SELECT rid, count(*) AS n FROM sh GROUP BY rid),
pair AS (SELECT a.rid AS x, b.rid AS y, count(*) AS shared FROM sh a JOIN sh b ON a.g = b.g AND a.rid <> b.rid GROUP BY ALL),
link AS (SELECT x, y FROM pair JOIN n nx ON nx.rid = x JOIN n ny ON ny.rid = y WHERE 100 * shared >= 90 * (nx.n + ny.n - shared)),
reach AS (SELECT rid AS x, rid AS y FROM d UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y),
low AS (SELECT reach.x AS rid, min(doc_id) AS component_id FROM reach JOIN d ON d.rid = reach.y GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d LEFT JOIN n USING (rid) JOIN low USING (rid)"""

OP9 = """WITH b AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT rid, doc_id, i, substr(h, CAST(2 * i + 1 AS BIGINT), 100) AS k FROM (SELECT *, unnest(range(0, n - 49)) AS i FROM b WHERE n >= 50)),
m AS (SELECT k, min(doc_id) AS least FROM w GROUP BY k),
dup AS (SELECT rid, i FROM w JOIN m USING (k) WHERE least < doc_id),
mark AS (SELECT rid, i, CASE WHEN i > coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), -100) + 50 THEN 1 ELSE 0 END AS fresh FROM dup),
isle AS (SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS g FROM mark),
run AS (SELECT rid, min(i) AS s, max(i) + 50 AS e FROM isle GROUP BY rid, g),
gap AS (SELECT rid, s, e, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY s), 0) AS before FROM run),
cut AS (SELECT rid, count(*) AS n_spans, sum(e - s) AS gone, max(e) AS last, string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (s - before) AS BIGINT)), '' ORDER BY s) AS kept FROM gap JOIN b USING (rid) GROUP BY rid)
SELECT doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
sha256(unhex(CASE WHEN kept IS NULL AND last IS NULL THEN h ELSE coalesce(kept, '') || substr(h, CAST(2 * last + 1 AS BIGINT)) END)) AS kept_sha256 FROM b LEFT JOIN cut USING (rid)"""
