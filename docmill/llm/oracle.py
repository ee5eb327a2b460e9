"""DuckDB SQL for the llm queries that SQL can express."""

_NORMAL = ("list_filter(string_split_regex(translate(coalesce(text, ''), "
           "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
           r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')")

_OP9 = f"""
WITH d AS (SELECT doc_id, {_NORMAL} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_NORMAL} AS w FROM benchmark),
g AS (SELECT DISTINCT item, len(w[i:i + n - 1]) AS n, array_to_string(w[i:i + n - 1], ' ') AS g
      FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i
            FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM g),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, n WHERE len(w) >= n)),
h AS (SELECT doc_id, item, i, dw.n FROM dw JOIN g USING (n, g)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit
       FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s
       FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id),
hs AS (SELECT doc_id, '[' || string_agg('[' || (a - 1) || ', ' || b || ']', ', ' ORDER BY a) || ']' AS t
       FROM (SELECT doc_id, min(p) AS a, max(p) AS b
             FROM (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS grp
                   FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM h))
             GROUP BY doc_id, grp) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(s, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
       coalesce(t, '[]') AS hit_spans
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id) LEFT JOIN hs USING (doc_id)
"""

_OP2 = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
           FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
r AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM s JOIN r USING (g)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n
         FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d)
         ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

#: Lines and their tokens (of lines over three tokens, fields with a digit, an @ or ://
#: are masked). In a leaf of ten documents a later token is kept if ten have it at its
#: place; lines with 60 % kept are one template per set of kept tokens. Long lines
#: count word for word from two documents on.
_OP3 = r"""
WITH l AS (SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS line
           FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
s AS (SELECT doc_id, pos, regexp_replace(trim(translate(line, chr(9) || chr(11) || chr(12) || chr(13), '    ')), ' +', ' ', 'g') AS x
      FROM l),
t AS (SELECT doc_id, pos, x, string_split(x, ' ') AS w FROM s WHERE x <> ''),
m AS (SELECT doc_id, pos, x, len(w) AS n, CASE WHEN len(w) <= 3 THEN w ELSE
             list_transform(w, lambda y: CASE WHEN regexp_matches(y, '[0-9@]|://') THEN '<*>' ELSE y END) END AS w FROM t),
leaf AS (SELECT *, w[1:3] AS lead FROM m),
hot AS (SELECT n, lead FROM leaf GROUP BY n, lead HAVING count(DISTINCT doc_id) >= 10),
h AS (SELECT leaf.* FROM leaf JOIN hot USING (n, lead)),
e AS (SELECT n, lead, doc_id, pos, unnest(w[4:]) AS token, unnest(range(len(w) - 3)) AS p FROM h WHERE n > 3),
k AS (SELECT n, lead, p, token, true AS kept FROM e GROUP BY n, lead, p, token HAVING count(DISTINCT doc_id) >= 10),
g AS (SELECT n, lead, doc_id, pos, string_agg(CASE WHEN kept THEN p || ':' || token END, ' ' ORDER BY p) AS shape,
             count(kept) AS fixed FROM e LEFT JOIN k USING (n, lead, p, token) GROUP BY n, lead, doc_id, pos),
held AS (SELECT doc_id, pos, n, array_to_string(lead, ' ') AS a, coalesce(shape, '') AS b, 10 AS need FROM g
         WHERE fixed >= (n - 3) * 0.6
         UNION ALL SELECT doc_id, pos, n, x, '', 10 FROM h WHERE n <= 3
         UNION ALL SELECT doc_id, pos, n, x, '', 2 FROM m WHERE n >= 40 OR length(x) >= 240),
r AS (SELECT n, a, b, need, min(doc_id) AS first FROM held GROUP BY n, a, b, need HAVING count(DISTINCT doc_id) >= need),
lost AS (SELECT DISTINCT doc_id, pos FROM held JOIN r USING (n, a, b, need) WHERE doc_id <> first),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS t, count(*) AS k FROM l ANTI JOIN lost USING (doc_id, pos)
         GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(string_split(text, chr(10))), 0) - coalesce(k, 0) AS BIGINT) AS n_dropped,
       CASE WHEN text IS NOT NULL THEN sha256(coalesce(t, '')) END AS text_sha256
FROM documents LEFT JOIN kept USING (doc_id)
"""

_OP12 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_NORMAL} AS w FROM documents),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, unnest({_NORMAL}) AS term FROM benchmark),
p AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf
      FROM (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM d) GROUP BY r, term),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
g AS (SELECT r, doc_id, term, (1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))
             * CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS impact
      FROM p JOIN f USING (term), s),
t AS (SELECT item_id, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM q JOIN g USING (term) GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM t WHERE score > 0)
WHERE rank <= 50
"""

ORACLE_SQL: dict[str, str] = {
    "op3_line_templates": _OP3,
    "op2_rlz": _OP2,
    "op12_max_sketch": _OP12,
    "op9_decontaminate": _OP9,
}
