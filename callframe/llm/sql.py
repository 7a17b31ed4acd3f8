"""SQL of the queries that DuckDB can express on whole tables."""

from __future__ import annotations

_USER_TEXT = "array_to_string(list_transform(list_filter(messages, lambda m: m.role = 'user'), lambda m: m.content), chr(10))"
_SPACE = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _words(text: str) -> str:
    return rf"regexp_extract_all(regexp_replace(lower({text}), '([\x{{4E00}}-\x{{9FFF}}])', ' \1 ', 'g'), '[\p{{L}}\p{{N}}]+')"


_SLOT = "((('0x' || substr(sha256(sample_id), 1, 5))::BIGINT * 654321 + 271828) % 1048576)"

_SHARES = f"""
d AS (SELECT doc_id, {_words('text')} AS w FROM documents),
g AS (SELECT doc_id, len(w) AS n_words, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) AS runs FROM d WHERE len(w) >= 20),
shares AS (SELECT doc_id, n_words, 1 - len(list_distinct(runs)) / len(runs)::DOUBLE AS share FROM g)"""

_RECORDS = f"""
x AS (SELECT sample_id, {_words(_USER_TEXT)} AS w, assistant.tool_calls AS tool_calls FROM canonical_samples QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY line_number) = 1),
k AS (SELECT sample_id, generate_subscripts(tool_calls, 1) AS i, unnest(tool_calls).function AS f FROM x),
n AS (SELECT sample_id, i, f.name AS name, (SELECT string_agg(t.fullkey || ':' || CASE t.type WHEN 'VARCHAR' THEN 's' || array_to_string({_words("(t.atom->>'$')")}, ' ') WHEN 'OBJECT' THEN 'o'
  WHEN 'ARRAY' THEN 'a' WHEN 'BOOLEAN' THEN t.atom::VARCHAR WHEN 'NULL' THEN 'null' ELSE 'n' || (t.atom::VARCHAR::DOUBLE)::VARCHAR END, '|' ORDER BY t.fullkey) FROM json_tree(f.arguments::JSON) t) AS sig FROM k),
j AS (SELECT sample_id, string_agg(coalesce(name, '?') || '(' || coalesce(sig, '') || ')', ';' ORDER BY i) AS calls FROM n GROUP BY 1),
r AS (SELECT x.sample_id, w, coalesce(calls, '') AS calls FROM x LEFT JOIN j USING (sample_id))"""

_SIMILAR = f"""
s AS (SELECT DISTINCT sample_id, list_sort(list_distinct({_words(_USER_TEXT)})) AS w FROM canonical_samples),
f AS (SELECT sample_id, bool_or(split = 'train') AS t, bool_or(split <> 'train') AS e FROM sample_splits WHERE split IS NOT NULL GROUP BY 1),
m AS (SELECT s.sample_id, w, t, e FROM s JOIN f USING (sample_id)),
c AS (SELECT a.w AS aw, b.w AS bw FROM (SELECT DISTINCT w FROM m WHERE t AND len(w) > 0) a, (SELECT DISTINCT w FROM m WHERE e AND len(w) > 0) b
      WHERE 4 * least(len(a.w), len(b.w)) >= 3 * greatest(len(a.w), len(b.w))
        AND 4 * len(list_intersect(a.w, b.w)) >= 3 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))))"""

_LEAKS = f"""d AS (SELECT doc_id, {_words('text')} AS w FROM documents), i AS (SELECT item_id, {_words('text')} AS w FROM eval_items),
dr AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS r FROM d WHERE len(w) >= 12),
ir AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS r FROM i WHERE len(w) >= 12),
leaks AS (SELECT DISTINCT doc_id, item_id FROM dr JOIN ir USING (r))"""

ORACLES = {
    "p3_found": rf"""
WITH s AS (
  SELECT sample_id, trim(regexp_replace(lower({_USER_TEXT}), '{_SPACE}', ' ', 'g')) AS txt,
         list_has_any(list_transform(tools, lambda t: t.function.name), (SELECT list(tool_name) FROM heldout_tools)) AS held
  FROM canonical_samples
), m AS (SELECT sample_id, min(txt) AS txt, bool_or(coalesce(held, false)) AS held FROM s GROUP BY sample_id),
g AS (
  SELECT sample_id, min(sample_id) OVER (PARTITION BY txt) AS group_id, count(*) OVER (PARTITION BY txt) AS n,
         bool_or(held) OVER (PARTITION BY txt) AS unseen FROM m
)
SELECT group_id, sample_id, CASE WHEN unseen THEN 'unseen' ELSE 'seen' END AS pool FROM g WHERE n >= 2 OR unseen
""",
    "p3_split": rf"""
WITH RECURSIVE s AS (
  SELECT sample_id, trim(regexp_replace(lower({_USER_TEXT}), '{_SPACE}', ' ', 'g')) AS txt,
         list_has_any(list_transform(tools, lambda t: t.function.name), (SELECT list(tool_name) FROM heldout_tools)) AS held FROM canonical_samples
), m AS (SELECT sample_id, min(txt) AS txt, bool_or(coalesce(held, false)) AS held FROM s GROUP BY sample_id),
g AS (SELECT min(sample_id) AS group_id, txt, count(*) AS n, bool_or(held) AS unseen FROM m GROUP BY txt),
seen AS (SELECT group_id, n, row_number() OVER (PARTITION BY n ORDER BY sha256(group_id), group_id) AS r FROM g WHERE NOT unseen),
o AS (SELECT n, row_number() OVER (ORDER BY n DESC) AS k FROM seen),
deal(k, n, split, a, b, c) AS (
  SELECT 0::BIGINT, 0::BIGINT, '', 0.90 * t, 0.05 * t, 0.05 * t FROM (SELECT sum(n)::DOUBLE AS t FROM seen)
  UNION ALL
  SELECT x.k, x.n, x.split, x.a - CASE x.split WHEN 'train' THEN x.n ELSE 0 END, x.b - CASE x.split WHEN 'dev_seen' THEN x.n ELSE 0 END, x.c - CASE x.split WHEN 'test_seen' THEN x.n ELSE 0 END
  FROM (SELECT o.k, o.n, CASE WHEN a >= b AND a >= c THEN 'train' WHEN b >= c THEN 'dev_seen' ELSE 'test_seen' END AS split, a, b, c FROM deal d JOIN o ON o.k = d.k + 1) x
), q AS (SELECT n, split, count(*) AS c FROM deal WHERE k > 0 GROUP BY ALL),
u AS (SELECT n, split, sum(c) OVER w - c AS low, sum(c) OVER w AS high FROM q WINDOW w AS (PARTITION BY n ORDER BY CASE split WHEN 'train' THEN 1 WHEN 'dev_seen' THEN 2 ELSE 3 END)),
z AS (SELECT group_id, split FROM seen JOIN u ON u.n = seen.n AND r > low AND r <= high UNION ALL SELECT group_id, 'test_unseen_tools' FROM g WHERE unseen)
SELECT sample_id, z.group_id, split FROM m JOIN g USING (txt) JOIN z ON z.group_id = g.group_id
""",
    "p4_found": f"""
WITH {_RECORDS} SELECT keep_id, sample_id AS copy_id FROM (SELECT sample_id, min(sample_id) OVER (PARTITION BY w, calls) AS keep_id FROM r) WHERE sample_id <> keep_id
""",
    "p4_counts": f"""
WITH {_RECORDS} SELECT min(sample_id) AS keep_id, count(*) AS copies FROM r GROUP BY w, calls
""",
    "p5_sample": f"""
SELECT DISTINCT sample_id, {_SLOT} AS slot FROM canonical_samples WHERE {_SLOT} < 104858
""",
    "p5_growth": f"""
WITH f AS (SELECT sample_id, min(batch_no) AS batch_no FROM canonical_samples WHERE batch_no IS NOT NULL GROUP BY sample_id),
r(rate, cut) AS (VALUES (0.01::DOUBLE, 10486), (0.05::DOUBLE, 52429), (0.10::DOUBLE, 104858)),
a AS (SELECT batch_no, rate, count(*) FILTER ({_SLOT} < cut) AS added FROM f, r GROUP BY ALL)
SELECT batch_no::BIGINT AS batch_no, rate, added, (sum(added) OVER (PARTITION BY rate ORDER BY batch_no))::BIGINT AS members, 0::BIGINT AS lost FROM a
""",
    "p6_found": f"""WITH {_SIMILAR}
SELECT DISTINCT least(x.sample_id, y.sample_id) AS left_id, greatest(x.sample_id, y.sample_id) AS right_id
FROM c JOIN m x ON x.w = c.aw AND x.t JOIN m y ON y.w = c.bw AND y.e
UNION SELECT sample_id, sample_id FROM m WHERE t AND e
""",
    "p6_links": f"""WITH {_SIMILAR}, n AS (SELECT w, min(sample_id) AS id FROM m WHERE len(w) > 0 GROUP BY w)
SELECT x.id AS train_class, y.id AS eval_class FROM c JOIN n x ON x.w = c.aw JOIN n y ON y.w = c.bw UNION ALL SELECT sample_id, sample_id FROM m WHERE t AND e AND len(w) = 0
""",
    "p6_members": f"""WITH {_SIMILAR}
SELECT sample_id, CASE WHEN len(w) = 0 THEN sample_id ELSE min(sample_id) OVER (PARTITION BY w) END AS class_id, t AS in_train, e AS in_eval FROM m
""",
    "p6_report": f"""WITH {_SIMILAR},
pairs AS (SELECT y.sample_id AS id FROM c JOIN m x ON x.w = c.aw AND x.t JOIN m y ON y.w = c.bw AND y.e UNION ALL SELECT sample_id FROM m WHERE t AND e AND len(w) = 0),
src AS (SELECT sample_id, source FROM canonical_samples QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY line_number) = 1),
sp AS (SELECT DISTINCT sample_id, split FROM sample_splits WHERE split <> 'train')
SELECT split, source, count(DISTINCT id) AS leaked, count(*) AS links FROM pairs JOIN sp ON sp.sample_id = id JOIN src ON src.sample_id = id GROUP BY split, source
""",
    "p7_found": f"WITH {_LEAKS} SELECT * FROM leaks",
    "p7_report": f"WITH {_LEAKS} SELECT item_id, source, count(*) AS documents FROM leaks JOIN documents USING (doc_id) GROUP BY ALL",
    "p7_recall": f"WITH {_LEAKS} SELECT count(*) AS pairs, count(*) AS found, 0::BIGINT AS missed FROM leaks",
    "p9_found": f"WITH {_SHARES} SELECT DISTINCT doc_id FROM shares WHERE share >= 0.30 - 1e-12",
    "p9_shares": f"WITH {_SHARES} SELECT doc_id, n_words, round(share, 9) AS share FROM shares WHERE share >= 0.30 - 1e-12",
}
