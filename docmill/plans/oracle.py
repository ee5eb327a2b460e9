"""Independent DuckDB SQL for the registered queries.

Each statement recomputes a query's result from the raw tables (views
``documents``, ``benchmark``, ``pages``, ...) with plain SQL: the chunk rule
in closed form, lexical cosine with GROUP BY, regex-based HTML handling,
decimal money. Fixed values (keywords, templates) are interpolated from
:mod:`docmill.rules` so both sides use the same dictionaries.
"""

from __future__ import annotations

from docmill import rules
from docmill.plans import registry as R

WS_LINE = r"[\t\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WS = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+\\z', '', 'g')"


JS_WS = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _js_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{JS_WS}+|{JS_WS}+\\z', '', 'g')"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def str_list(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]::VARCHAR[]"


NL = "chr(10)"

CHUNKS = r"""
docs_n AS (SELECT doc_id, text, length(text) AS n FROM documents),
ck_a AS (SELECT *, length(regexp_extract(substring(text, 1, 1000), '(?s)^(.*[.\n])', 1)) - 1 AS bp0 FROM docs_n),
ck_b AS (SELECT *, CASE WHEN 1000 < n AND bp0 > 500 THEN bp0 + 1 ELSE 1000 END AS e0 FROM ck_a),
ck_c AS (SELECT *, e0 - 200 AS s1,
                length(regexp_extract(substring(text, e0 - 200 + 1, 1000), '(?s)^(.*[.\n])', 1)) - 1 AS bp1 FROM ck_b),
ck_d AS (SELECT *, CASE WHEN s1 + 1000 < n AND bp1 > s1 + 500 THEN bp1 + 1 ELSE s1 + 1000 END AS e1 FROM ck_c),
ck_e AS (SELECT *, e1 - 200 AS s2,
                CASE WHEN n = 0 THEN 0 WHEN s1 >= n THEN 1 WHEN e1 - 200 >= n THEN 2
                     ELSE 3 + (n - 1 - (e1 - 200)) // 800 END AS cnt FROM ck_d),
ck_f AS (SELECT doc_id, text, s1, e0, e1, s2, unnest(range(CAST(cnt AS BIGINT))) AS chunk_index FROM ck_e),
ck_g AS (SELECT doc_id, text, chunk_index,
                CASE chunk_index WHEN 0 THEN 0 WHEN 1 THEN s1 ELSE s2 + 800 * (chunk_index - 2) END AS start_char,
                CASE chunk_index WHEN 0 THEN e0 WHEN 1 THEN e1 ELSE s2 + 800 * (chunk_index - 2) + 1000 END AS end_char
         FROM ck_f),
chunks AS (SELECT doc_id, 'doc-' || CAST(doc_id AS VARCHAR) || '.txt' AS filename, chunk_index, start_char, end_char,
                  @STRIP(substring(text, start_char + 1, end_char - start_char))@ AS text FROM ck_g)
"""


def _fill(sql: str) -> str:
    # expand @STRIP(x)@ markers
    out, pos = [], 0
    while True:
        a = sql.find("@STRIP(", pos)
        if a < 0:
            out.append(sql[pos:])
            return "".join(out)
        b = sql.find(")@", a)
        out.append(sql[pos:a])
        out.append(strip(sql[a + 7:b]))
        pos = b + 2


CHUNKS_CTE = _fill(CHUNKS)

CHUNK_TERMS = r"""
ct AS (SELECT doc_id, chunk_index, term, count(*) AS tf
       FROM (SELECT doc_id, chunk_index, unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) AS term FROM chunks)
       WHERE term <> '' GROUP BY ALL),
cn AS (SELECT doc_id, chunk_index, sum(tf * tf) AS c2 FROM ct GROUP BY ALL)
"""


def lexical(prefix: str, src: str, key: str, text: str, k: int) -> str:
    """CTEs ``{prefix}top(key, doc_id, chunk_index, distance, rank)``."""
    p = prefix
    return f"""
{p}qt AS (SELECT {key} AS qkey, term, count(*) AS tf
       FROM (SELECT {key}, unnest(regexp_split_to_array(lower({text}), '[^\\p{{L}}]+')) AS term FROM {src}
             WHERE {strip(text)} <> '')
       WHERE term <> '' GROUP BY ALL),
{p}qn AS (SELECT qkey, sum(tf * tf) AS q2 FROM {p}qt GROUP BY ALL),
{p}dp AS (SELECT a.qkey, c.doc_id, c.chunk_index, sum(a.tf * c.tf) AS dot FROM {p}qt a JOIN ct c USING (term) GROUP BY ALL),
{p}sc AS (SELECT d.qkey, d.doc_id, d.chunk_index, 1 - d.dot / (sqrt(n.q2) * sqrt(m.c2)) AS distance
       FROM {p}dp d JOIN {p}qn n USING (qkey) JOIN cn m USING (doc_id, chunk_index)),
{p}top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qkey ORDER BY round(distance, 6), doc_id, chunk_index) AS rank
                       FROM {p}sc) WHERE rank <= {k}),
{p}ctx AS (SELECT t.qkey,
             string_agg('[Source: ' || c.filename || ']' || chr(10) || c.text || chr(10), chr(10) ORDER BY t.rank) AS context,
             list_sort(list_distinct(list(c.filename))) AS chunk_sources
           FROM {p}top t JOIN chunks c USING (doc_id, chunk_index) GROUP BY t.qkey)
"""


def _by_source(ctes: str) -> str:
    """Ties by the source's name instead of doc_id."""
    return ctes.replace("round(distance, 6), doc_id, chunk_index",
                        "round(distance, 6), 'doc-' || CAST(doc_id AS VARCHAR) || '.txt', chunk_index")


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip().rstrip(",") for p in parts)


# ---------------------------------------------------------------------------
# feature detection / templates

def _feature_flags(texts: list[str], keywords) -> list[str]:
    flags = []
    for _, kws in keywords:
        terms = [f"contains(lower({t}), {q(kw.lower())})" for kw in kws for t in texts]
        flags.append("(" + " OR ".join(terms) + ")")
    return flags


def _templates_values(keywords, templates) -> str:
    ford = {name: i for i, (name, _) in enumerate(keywords)}
    counters, rows = {}, []
    for feat, ttype, label, scen, exp, steps in templates:
        n = counters.get((feat, ttype), 0)
        counters[(feat, ttype)] = n + 1
        rows.append(f"({ford[feat]}, {0 if ttype == 'positive' else 1}, {n}, {q(label)}, {q(scen)}, {q(exp)}, "
                    f"{q(ttype)}, {str_list(steps)})")
    return ("tpl(feature_ord, type_ord, tpl_ord, feature, test_scenario, expected_result, test_type, steps) AS "
            "(VALUES " + ", ".join(rows) + ")")


def test_case_ctes(src: str, key: str, text: str, k: int, prefix: str = "t_", keywords=R.CASE_KEYWORDS,
                   templates=R.CASE_TEMPLATES) -> str:
    """CTE ``{prefix}cases(qkey, test_id, feature, test_scenario, expected_result,
    grounded_in, test_type, steps VARCHAR[])`` for queries in ``src``."""
    p = prefix
    flags = _feature_flags(["x.context", "x.query"], keywords)
    flag_cols = ", ".join(f"{f} AS f{i}" for i, f in enumerate(flags))
    on = " OR ".join(f"(tpl.feature_ord = {i} AND f.f{i})" for i in range(len(flags)))
    g, e = rules.GENERIC_CASE, rules.EMPTY_RETRIEVAL_CASE
    return lexical(p, src, key, text, k) + f""",
{p}qc AS (SELECT s.{key} AS qkey, s.{text} AS query, c.context, c.chunk_sources FROM {src} s LEFT JOIN {p}ctx c ON c.qkey = s.{key}),
{p}ff AS (SELECT x.*, {flag_cols} FROM {p}qc x),
{_templates_values(keywords, templates)},
{p}m AS (SELECT f.qkey, tpl.* FROM {p}ff f JOIN tpl ON {on} WHERE f.context IS NOT NULL),
{p}nm AS (SELECT DISTINCT qkey FROM {p}m),
{p}cases AS (
  SELECT m.qkey, printf('TC-%03d', row_number() OVER (PARTITION BY m.qkey ORDER BY feature_ord, type_ord, tpl_ord)) AS test_id,
         m.feature, m.test_scenario, m.expected_result,
         array_to_string(list_sort(list_distinct(regexp_extract_all(f.context, '\\[Source: ([^\\]]+)\\]', 1))), ', ') AS grounded_in,
         m.test_type, m.steps
  FROM {p}m m JOIN {p}ff f USING (qkey)
  UNION ALL
  SELECT qkey, 'TC-001', {q(g['feature'])}, {q(g['scenario_prefix'])} || query, {q(g['expected_result'])},
         array_to_string(chunk_sources, ', '), {q(g['test_type'])}, {str_list(g['steps'])}
  FROM {p}ff WHERE context IS NOT NULL AND qkey NOT IN (SELECT qkey FROM {p}nm)
  UNION ALL
  SELECT qkey, {q(e['test_id'])}, {q(e['feature'])}, {q(e['test_scenario'])}, {q(e['expected_result'])},
         {q(e['grounded_in'])}, {q(e['test_type'])}, NULL::VARCHAR[]
  FROM {p}ff WHERE context IS NULL)
"""


#: The requests: every tenth item is blank, every tenth has no letters.
REQUESTS = """
requests AS (SELECT item_id, CASE item_id % 10 WHEN 3 THEN ' ' || chr(9) || ' ' WHEN 4 THEN CAST(item_id AS VARCHAR)
             ELSE text END AS query FROM benchmark)
"""
DEFAULT_CASES = _with(CHUNKS_CTE, CHUNK_TERMS, test_case_ctes("benchmark", "item_id", "text", R.TEST_K, "t_",
                                                              rules.FEATURE_KEYWORDS, rules.TEST_TEMPLATES))
CASE_CTES = (REQUESTS, CHUNKS_CTE, CHUNK_TERMS, test_case_ctes("requests", "item_id", "query", R.TEST_K))
BENCH_CASES = _with(*CASE_CTES)


def _route(feature: str) -> str:
    arms = []
    for fam, needles in rules.SCRIPT_FAMILIES:
        cond = " OR ".join(f"contains(lower({feature}), {q(n)})" for n in needles)
        arms.append(f"WHEN {cond} THEN {q(fam)}")
    return "CASE " + " ".join(arms) + f" ELSE {q(rules.GENERIC_FAMILY)} END"


# ---------------------------------------------------------------------------
# HTML via regex (valid for the driver pages: no CDATA, known entities only)

def _html_body(col: str) -> str:
    """Drop script/style contents and comments but keep other markup."""
    x = f"regexp_replace({col}, '(<script[^>]*>).*?</script>', '\\1</script>', 'gs')"
    x = f"regexp_replace({x}, '(<style[^>]*>).*?</style>', '\\1</style>', 'gs')"
    return f"regexp_replace({x}, '<!--.*?-->', '', 'gs')"


def _decode(x: str) -> str:
    for ent, ch in [("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"),
                    ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&")]:
        x = f"replace({x}, {q(ent)}, {q(ch)})"
    return x


def _html_text(col: str) -> str:
    # a legacy '&amp' without ';' ends at the next non-alphanumeric character
    x = _html_body(f"regexp_replace({col}, '&amp([^;a-zA-Z0-9])', '&amp;\\1', 'g')")
    x = f"regexp_replace({x}, '<!DOCTYPE[^>]*>', '', 'gi')"
    x = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    return _decode(x)


LINE_BREAKS = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def _tidy(x: str) -> str:
    phrases = (f"flatten(list_transform(regexp_split_to_array({x}, '{LINE_BREAKS}'), "
               f"lambda l: list_transform(string_split({strip('l')}, '  '), lambda ph: {strip('ph')})))")
    return f"array_to_string(list_filter({phrases}, lambda ph: ph <> ''), ' ')"


START_TAG = r"<([a-zA-Z][^\t\n\r\f />]*)"


# ---------------------------------------------------------------------------
# statements

def _corpus_spec_list(feature: str, text: str, spec_rules=R.CORPUS_SPEC_RULES) -> str:
    items = []
    for feat, needles, spec in spec_rules:
        cond = [f"{feature} = {q(feat)}"]
        for needle, cs in needles:
            cond.append(f"contains({text}, {q(needle)})" if cs else f"contains(lower({text}), {q(needle.lower())})")
        items.append(f"CASE WHEN {' AND '.join(cond)} THEN {q(spec)} END")
    return f"list_filter([{', '.join(items)}], lambda s: s IS NOT NULL)"


def _files() -> str:
    return ("files AS (SELECT 'doc-' || CAST(doc_id AS VARCHAR) || '.txt' AS name, 'text/plain' AS content_type, "
            "strlen(text) AS bytes FROM documents UNION ALL "
            "SELECT 'page-' || CAST(page_id AS VARCHAR) || '.html', 'text/html; charset=utf-8', strlen(html) FROM pages)")


def _mixed_files_sql() -> str:
    """CTE mixed(name, kind, code, text): see registry._mixed_files."""
    json_text = ("'{' || chr(10) || '  \"' || json_keys(props)[1] || '\": ' || "
                 "CAST(json_extract(props, '$.\"' || json_keys(props)[1] || '\"') AS VARCHAR) || chr(10) || '}'")
    return f"""
mixed AS (SELECT 'doc-' || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 11 = 0 THEN '.pdf' ELSE '.txt' END AS name,
                 CASE WHEN doc_id % 11 = 0 THEN 'pdf' ELSE 'text' END AS kind,
                 CASE WHEN doc_id % 11 = 0 THEN 'unsupported_pdf' WHEN doc_id % 7 = 0 THEN 'invalid_utf8' END AS code, text
          FROM documents
          UNION ALL SELECT 'page-' || CAST(page_id AS VARCHAR) || '.html', 'html', NULL, {_tidy(_html_text('html'))} FROM pages
          UNION ALL SELECT 'event-' || CAST(event_id AS VARCHAR) || '.json', 'json', NULL, {json_text} FROM events)
"""


def _kind(ctype: str, name: str) -> str:
    ext = f"string_split(lower({name}), '.')[-1]"
    arms = [f"WHEN {ctype} = {q(t)} THEN {q(k)}" for t, k in rules.CONTENT_TYPE_KIND]
    arms += [f"WHEN {ext} = {q(e)} THEN {q(k)}" for e, k in rules.EXTENSION_KIND]
    return "CASE " + " ".join(arms) + f" ELSE {q(rules.DEFAULT_KIND)} END"


CENTROIDS = """
ex AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS v FROM embeddings),
cen AS (SELECT CAST(label AS BIGINT) AS qid, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(CAST(v AS DOUBLE)) AS m FROM ex GROUP BY ALL) GROUP BY label),
vs AS (SELECT vec_id AS cid, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
sc AS (SELECT cen.qid, vs.cid, 1 - list_dot_product(cen.c, vs.e) / (sqrt(list_dot_product(cen.c, cen.c)) * sqrt(list_dot_product(vs.e, vs.e))) AS distance FROM cen, vs)
"""


def _orders_base() -> str:
    return """
li AS (SELECT l.l_orderkey, sum(CAST(p.p_retailprice AS DECIMAL(18,2)) * CAST(l.l_quantity AS DECIMAL(18,2))) AS subtotal,
              count(*) AS n_items
       FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY l.l_orderkey),
oi AS (SELECT o.o_orderkey, o.o_custkey,
              CASE WHEN o_orderpriority = '1-URGENT' THEN ' save15 ' WHEN o_orderpriority = '5-LOW' THEN '' ELSE 'INVALID' END AS code,
              CASE WHEN o_orderstatus = 'O' THEN 'express' ELSE 'standard' END AS method,
              coalesce(li.subtotal, 0) AS subtotal, coalesce(li.n_items, 0) AS n_items
       FROM orders o LEFT JOIN li ON li.l_orderkey = o.o_orderkey),
ot AS (SELECT *, CASE WHEN upper(@STRIP(code)@) = 'SAVE15' THEN 'applied' WHEN coalesce(upper(@STRIP(code)@), '') = '' THEN 'none' ELSE 'invalid' END AS code_status,
              subtotal * CASE WHEN upper(@STRIP(code)@) = 'SAVE15' THEN CAST(0.15 AS DECIMAL(5,4)) ELSE CAST(0 AS DECIMAL(5,4)) END AS disc,
              CASE WHEN method = 'express' THEN CAST(10 AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END AS ship
       FROM oi),
totals AS (SELECT o_orderkey, o_custkey, n_items, code_status, CAST(subtotal AS DOUBLE) AS subtotal,
                  CAST(round(disc, 2) AS DOUBLE) AS discount, CAST(ship AS DOUBLE) AS shipping,
                  CAST(round(subtotal - disc + ship, 2) AS DOUBLE) AS total FROM ot)
"""


def _statements() -> dict[str, str]:
    s: dict[str, str] = {}
    s["chunks"] = _with(CHUNKS_CTE) + " SELECT doc_id, chunk_index, start_char, end_char, text FROM chunks"
    s["document_record"] = _with(CHUNKS_CTE) + " SELECT doc_id, CAST(n AS BIGINT) AS n_chars, CAST(cnt AS BIGINT) AS chunk_count FROM ck_e"
    s["document_summary"] = (_with(CHUNKS_CTE) + " SELECT d.source, count(*) AS docs, CAST(sum(e.cnt) AS BIGINT) AS chunks "
                             "FROM ck_e e JOIN documents d USING (doc_id) GROUP BY d.source")
    s["document_preview"] = ("SELECT doc_id, CASE WHEN length(text) > 500 THEN substring(text, 1, 500) || '...' ELSE text END AS preview "
                             "FROM documents")
    s["format_dispatch"] = _with(_files()) + f" SELECT name, {_kind('content_type', 'name')} AS kind FROM files"
    exts = ", ".join(q(e) for e in rules.DOCUMENT_EXTENSIONS)
    s["ingest_filter"] = (_with(_files()) + f" SELECT name, {_kind('content_type', 'name')} AS kind, CAST(bytes AS BIGINT) AS bytes "
                          f"FROM files WHERE string_split(lower(name), '.')[-1] IN ({exts})")
    mixed = _mixed_files_sql()
    s["ingest_quarantine"] = (_with(mixed) + " SELECT name, kind, code IS NULL AS ok, code AS error_code, "
                              "CASE WHEN code IS NULL THEN CAST(length(text) AS BIGINT) END AS n_chars FROM mixed")
    s["packed_ingest"] = s["ingest_quarantine"]
    sums = ("count(*)", "count(*) FILTER (code IS NULL)", "count(*) FILTER (code = 'unsupported_pdf')", "0",
            "count(*) FILTER (code = 'invalid_utf8')", "sum(length(text)) FILTER (code IS NULL)")
    stored = ("SELECT sum(strlen(text) + CASE WHEN doc_id % 11 = 0 THEN 7 WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END) AS b FROM documents "
              "UNION ALL SELECT sum(strlen(html)) FROM pages UNION ALL SELECT sum(strlen(props)) FROM events")
    s["ingest_metrics"] = _with(mixed) + " " + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, CAST(coalesce(max(v), 0) AS BIGINT) AS value FROM (SELECT {v} AS v FROM mixed)"
        for m, v in zip(("files", "ok", "unsupported_pdf", "too_large", "invalid_utf8", "chars"), sums)) \
        + f" UNION ALL SELECT 'bytes', CAST(sum(b) AS BIGINT) FROM ({stored})"
    s["ingest_chunks"] = (_with(mixed, "documents AS (SELECT name AS doc_id, text FROM mixed WHERE code IS NULL)", CHUNKS_CTE)
                          + " SELECT c.doc_id AS name, m.kind, c.chunk_index, c.start_char, c.end_char, md5(c.text) AS text_md5 "
                            "FROM chunks c JOIN mixed m ON m.name = c.doc_id")
    s["json_normalize"] = ("SELECT event_id, '{' || chr(10) || '  \"' || json_keys(props)[1] || '\": ' || "
                           "CAST(json_extract(props, '$.\"' || json_keys(props)[1] || '\"') AS VARCHAR) || chr(10) || '}' AS text FROM events")
    s["page_text"] = f"SELECT page_id, {_tidy(_html_text('html'))} AS text FROM pages"
    s["assemble_parts"] = "SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id"
    chunk_id = "sha256(filename || chr(1) || CAST(chunk_index AS VARCHAR))"
    s["kb_build"] = (_with(CHUNKS_CTE) + f" SELECT {chunk_id} AS chunk_id, filename AS source, 'text/plain' AS content_type, "
                     "chunk_index, start_char, end_char, md5(text) AS text_md5 FROM chunks")
    s["kb_summary"] = _with(CHUNKS_CTE) + " SELECT filename AS source, count(*) AS chunks FROM chunks GROUP BY filename"
    s["kb_retrieve"] = (_with(REQUESTS, CHUNKS_CTE, CHUNK_TERMS, _by_source(lexical("b_", "requests", "item_id", "query", 5)))
                        + f" SELECT qkey AS item_id, rank, {chunk_id} AS chunk_id, filename AS source, "
                          "round(distance, 6) AS distance, md5(text) AS text_md5 FROM b_top JOIN chunks USING (doc_id, chunk_index)")
    s["kb_sources"] = _with(CHUNKS_CTE) + " SELECT DISTINCT filename AS source FROM chunks"
    s["incremental_ingest"] = s["kb_build"]
    withdrawn = "SELECT doc_id FROM documents WHERE doc_id % 5 = 0"
    for name, sent in (("versioned_ingest", withdrawn),
                       ("kb_upsert", withdrawn + " UNION ALL SELECT doc_id + 1000000000 FROM documents WHERE doc_id % 7 = 0")):
        s[name] = (_with(CHUNKS_CTE, f"sent AS ({sent})",
                            "short AS (SELECT 'doc-' || doc_id || '.txt' AS filename, 0 AS chunk_index, "
                            "'Document ' || doc_id || ' was withdrawn.' AS text FROM sent)",
                            "now AS (SELECT filename, chunk_index, start_char, end_char, text FROM chunks WHERE doc_id % 5 <> 0 "
                            "UNION ALL SELECT filename, chunk_index, 0, 1000, text FROM short)")
                      + f" SELECT {chunk_id} AS chunk_id, filename AS source, 'text/plain' AS content_type, "
                        "CAST(chunk_index AS BIGINT) AS chunk_index, CAST(start_char AS BIGINT) AS start_char, "
                        "CAST(end_char AS BIGINT) AS end_char, md5(text) AS text_md5 FROM now")
    counted = "CAST(count(*) AS BIGINT) AS chunks, CAST(count(DISTINCT filename) AS BIGINT) AS sources FROM chunks"
    s["kb_lifecycle"] = (_with(CHUNKS_CTE) + " SELECT '0 missing' AS step, CAST(0 AS BIGINT) AS chunks, CAST(0 AS BIGINT) AS sources"
                         f" UNION ALL SELECT '1 built', {counted} UNION ALL SELECT '2 replaced', {counted} WHERE doc_id % 2 = 0"
                         f" UNION ALL SELECT '3 cleared', 0, 0 UNION ALL SELECT '4 sent again', {counted} WHERE doc_id % 2 = 0")
    s["retrieve_lexical"] = (_with(CHUNKS_CTE, CHUNK_TERMS, lexical("b_", "benchmark", "item_id", "text", 5)) +
                             " SELECT qkey AS item_id, rank, doc_id, chunk_index, round(distance, 6) AS distance FROM b_top")
    s["retrieve_indexed"] = s["retrieve_lexical"]
    s["keyword_table"] = """
WITH k AS (SELECT DISTINCT keyword FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) AS keyword FROM benchmark)
           WHERE length(keyword) >= 6)
SELECT keyword, count(*) AS docs, min(doc_id) AS first_doc FROM documents JOIN k ON contains(lower(text), keyword) GROUP BY keyword"""
    s["retrieve_dense"] = (_with(CENTROIDS) + " SELECT qid, rank, cid, round(distance, 6) AS distance FROM ("
                           "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(distance, 6), cid) AS rank FROM sc) WHERE rank <= 5")
    def counts(x):
        return "[" + ", ".join(f"2.0 * length({x}) - length(replace({x}, '{c}', '')) - length(replace({x}, '{c.upper()}', ''))"
                               for c in R.LETTERS) + "]"
    s["retrieve_encoded"] = (_with(CHUNKS_CTE, f"ev AS (SELECT doc_id, chunk_index, filename, text, {counts('text')} AS e FROM chunks)",
                                   f"qv AS (SELECT item_id, {counts('text')} AS e FROM benchmark)",
                                   "ed AS (SELECT item_id, doc_id, chunk_index, filename, text, round(1 - list_dot_product(qv.e, ev.e) "
                                   "/ (sqrt(list_dot_product(qv.e, qv.e)) * sqrt(list_dot_product(ev.e, ev.e))), 6) AS distance FROM qv, ev "
                                   "WHERE list_dot_product(ev.e, ev.e) > 0)")
                             + " SELECT item_id, rank, filename AS source, distance, md5(text) AS text_md5 FROM (SELECT *, row_number() OVER "
                               "(PARTITION BY item_id ORDER BY distance, doc_id, chunk_index) AS rank FROM ed) WHERE rank <= 5")
    ann = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
d AS (SELECT a.vec_id AS qid, b.vec_id AS cid, round(1 - list_dot_product(a.e, b.e)
             / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) + 0.0 AS distance
      FROM v a, v b WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, cid) AS rank FROM d)
"""
    s["ann_recall"] = ann + "SELECT qid, cid AS best_cid, abs(distance) AS distance, true AS recall_ok FROM r WHERE rank = 1"
    s["retrieve_ann"] = (ann + "SELECT qid, rank, cid, CAST(label AS BIGINT) AS label, abs(distance) AS distance "
                         "FROM r JOIN embeddings ON vec_id = cid WHERE rank <= 5")
    ctx5 = _with(CHUNKS_CTE, CHUNK_TERMS, lexical("b_", "benchmark", "item_id", "text", 5))
    s["context"] = ctx5 + " SELECT qkey AS item_id, context FROM b_ctx"
    s["cited_sources"] = (ctx5 + " SELECT qkey AS item_id, array_to_string(list_sort(list_distinct("
                          "regexp_extract_all(context, '\\[Source: ([^\\]]+)\\]', 1))), ', ') AS sources FROM b_ctx")
    feats = []
    for i, (name, kws) in enumerate(R.CORPUS_FEATURES):
        cond = " OR ".join(f"contains(lower(text), {q(k.lower())})" for k in kws)
        feats.append(f"SELECT doc_id, CAST({i} AS BIGINT) AS feature_ord, {q(name)} AS feature, text FROM documents WHERE {cond}")
    fd = "fd AS (" + " UNION ALL ".join(feats) + ")"
    s["feature_detect"] = _with(fd) + " SELECT doc_id, feature_ord, feature FROM fd"
    spec = _corpus_spec_list("feature", "text")
    s["spec_rules"] = (_with(fd) + f" SELECT doc_id, feature, array_to_string({spec}, ' | ') AS specs, "
                       f"CAST(len({spec}) AS BIGINT) AS n_specs FROM fd")
    flags = _feature_flags(["c.context", "s.query"], R.CASE_KEYWORDS)
    per = " UNION ALL ".join(
        f"SELECT s.item_id, CAST({i} AS BIGINT) AS feature_ord, {q(name)} AS feature, c.context FROM requests s "
        f"JOIN t_ctx c ON c.qkey = s.item_id WHERE {flag}" for i, ((name, _), flag) in enumerate(zip(R.CASE_KEYWORDS, flags)))
    s["feature_map"] = (_with(*CASE_CTES, f"fm AS ({per})")
                        + " SELECT item_id, feature_ord, feature, array_to_string(list_sort(list_distinct(regexp_extract_all("
                          "context, '\\[Source: ([^\\]]+)\\]', 1))), ', ') AS source_docs, "
                          f"array_to_string({_corpus_spec_list('feature', 'context', R.CASE_SPECS)}, ' | ') AS specifications FROM fm")
    s["test_cases"] = (BENCH_CASES + " SELECT qkey AS item_id, test_id, feature, test_scenario, expected_result, grounded_in, "
                       "test_type, array_to_string(steps, chr(10)) AS steps FROM t_cases")
    s["test_cases_default"] = s["test_cases"].replace(BENCH_CASES, DEFAULT_CASES)
    s["case_lookup"] = s["test_cases"] + " WHERE test_id = 'TC-002'"
    s["case_steps"] = (BENCH_CASES + " SELECT item_id, test_id, step_no, step FROM (SELECT qkey AS item_id, test_id, "
                       "unnest(range(1, len(steps) + 1)) AS step_no, unnest(steps) AS step FROM t_cases WHERE steps IS NOT NULL)")
    s["case_labels"] = BENCH_CASES + " SELECT qkey AS item_id, test_id, test_id || ': ' || test_scenario AS label FROM t_cases"
    s["export_names"] = (BENCH_CASES + " SELECT qkey AS item_id, test_id, 'Test' || replace(test_id, '-', '_') AS class_name, "
                         "'test_' || replace(lower(test_id), '-', '_') || '.py' AS file_name FROM t_cases")
    s["script_route"] = (BENCH_CASES + f" SELECT qkey AS item_id, test_id, {_route('feature')} AS family, "
                         "CASE WHEN coalesce(test_type, 'positive') = 'positive' THEN 'positive' ELSE 'negative' END AS branch FROM t_cases")
    s["coverage_matrix"] = (BENCH_CASES + " SELECT feature, " + ", ".join(
        f"count(*) FILTER (WHERE test_type = {q(t)}) AS {t}" for t in ["positive", "negative", "exploratory", "informational"])
        + " FROM t_cases GROUP BY feature")
    s["grounding_check"] = (_with(*CASE_CTES,
                                  "src AS (SELECT DISTINCT filename FROM chunks)",
                                  "cit AS (SELECT qkey, test_id, unnest(list_filter(string_split(grounded_in, ', '), lambda z: z <> '')) AS cited FROM t_cases)")
                            + " SELECT c.qkey AS item_id, c.test_id, count(x.cited) AS n_cited, "
                              "count(x.cited) FILTER (WHERE x.cited NOT IN (SELECT filename FROM src)) AS n_missing "
                              "FROM t_cases c LEFT JOIN cit x ON x.qkey = c.qkey AND x.test_id = c.test_id GROUP BY ALL")
    s["status_counts"] = (_with(*CASE_CTES)
                            + " SELECT 'documents_uploaded' AS metric, count(*) AS value FROM documents"
                              " UNION ALL SELECT 'kb_ready', CAST(count(*) > 0 AS BIGINT) FROM chunks"
                              " UNION ALL SELECT 'kb_chunks', count(*) FROM chunks"
                              " UNION ALL SELECT 'cases_generated', count(*) FROM t_cases"
                              " UNION ALL SELECT 'html_loaded', count(*) FROM pages")
    prompt_head, rest = rules.TEST_CASE_PROMPT.split("{query}")
    prompt_mid, prompt_tail = rest.split("{context}")
    prompt = f"{q(prompt_head)} || b.text || {q(prompt_mid)} || c.context || {q(prompt_tail)}"
    s["prompts"] = (_with(CHUNKS_CTE, CHUNK_TERMS, lexical("b_", "benchmark", "item_id", "text", R.TEST_K))
                    + f" SELECT b.item_id, md5({prompt}) AS prompt_md5, CAST(length({prompt}) AS BIGINT) AS prompt_chars "
                      "FROM benchmark b JOIN b_ctx c ON c.qkey = b.item_id")
    # model-style responses derived from part (see registry._model_outputs)
    parsed = """
pr AS (SELECT p_partkey AS item_id, p_type AS t, p_partkey % 5 AS r, printf('TC-%03d', p_size) AS test_id, p_brand AS feature,
              p_name AS test_scenario, 'As documented' AS expected_result, p_type AS grounded_in, 'positive' AS test_type FROM part),
pk AS (SELECT *, CASE WHEN t = 'ECONOMY' THEN 'two' WHEN t IN ('SMALL', 'PROMO') THEN 'one' WHEN r = 2 THEN 'empty'
                      WHEN r = 3 THEN 'plain' ELSE 'bad' END AS sort FROM pr),
pa AS (SELECT item_id, unnest(CASE WHEN sort = 'two' THEN [0, 1] WHEN sort IN ('one', 'plain') THEN [0] ELSE [NULL] END) AS pos, sort,
              test_id, feature, test_scenario, expected_result, grounded_in, test_type,
              CASE WHEN sort = 'plain' THEN test_scenario ELSE test_scenario || chr(10) || t END AS steps,
              CASE WHEN sort = 'plain' THEN 1 ELSE 2 END AS n_steps FROM pk)
"""
    cols = ["test_id", "feature", "test_scenario", "expected_result", "grounded_in", "test_type", "steps"]
    s["parse_responses"] = (_with(parsed) + " SELECT item_id, CAST(pos AS BIGINT) AS pos, "
                            + ", ".join(f"CASE WHEN pos IS NOT NULL THEN {c} END AS {c}" for c in cols)
                            + ", CASE WHEN pos IS NOT NULL THEN CAST(n_steps AS BIGINT) END AS n_steps, sort = 'bad' AS bad FROM pa")
    s["response_extras"] = """SELECT p_partkey AS item_id, 0::BIGINT AS pos, 'priority' AS field, p_size::VARCHAR AS value
FROM part WHERE p_partkey % 7 <> 0 UNION ALL
SELECT p_partkey, 1, 'meta', '{"tags":["' || p_brand || '"],"type":"' || p_type || '"}' FROM part WHERE p_partkey % 7 <> 0"""
    rest = ", ".join(cols[:-1])
    s["generator_choice"] = (BENCH_CASES + ", " + parsed.strip() +
                             ", good AS (SELECT * FROM pa WHERE pos IS NOT NULL AND item_id IN (SELECT item_id FROM benchmark))"
                             f" SELECT item_id, 'model' AS origin, {rest}, steps FROM good UNION ALL "
                             f"SELECT qkey AS item_id, 'rules', {rest}, array_to_string(steps, chr(10)) FROM t_cases "
                             "WHERE qkey NOT IN (SELECT item_id FROM good)")
    s["case_context"] = (_with(*CASE_CTES,
                               "cq AS (SELECT qkey AS item_id, test_id, qkey || chr(1) || test_id AS ck, feature || ' ' || test_scenario AS q_text FROM t_cases)",
                               lexical("k_", "cq", "ck", "q_text", 5))
                         + " SELECT cq.item_id, cq.test_id, k.context FROM cq LEFT JOIN k_ctx k ON k.qkey = cq.ck")
    # pages
    body = _html_body("html")
    s["tag_counts"] = (f"SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all({body}, '{START_TAG}', 1)) AS t FROM pages), "
                       "LATERAL (SELECT lower(t) AS tag) GROUP BY tag")
    s["page_elements"] = (f"SELECT page_id, CAST(i - 1 AS BIGINT) AS ord, lower(t) AS tag FROM (SELECT page_id, "
                          f"unnest(range(1, len(regexp_extract_all({body}, '{START_TAG}', 1)) + 1)) AS i, "
                          f"unnest(regexp_extract_all({body}, '{START_TAG}', 1)) AS t FROM pages)")
    slot_sql = []
    for slot, css in R.PAGE_SLOTS:
        pattern = {"title": "<title[\\s>]", "h1": "<h1[\\s>]", ".ad": "<div class=\"ad\"", 'a[href*="/"]': "<a href=\"[^\"]*/",
                   "p": "<p[\\s>]", "footer": "<footer[\\s>]"}[css]
        sel = {"title": "title", "h1": "h1", ".ad": ".ad", 'a[href*="/"]': "a", "p": "p", "footer": "footer"}[css]
        slot_sql.append(f"SELECT page_id, {q(slot)} AS slot, {q(sel)} AS selector FROM pages WHERE regexp_matches({body}, {q(pattern)})")
    s["page_selectors"] = " UNION ALL ".join(slot_sql)
    sec_text = _decode(f"regexp_replace(unnest(regexp_extract_all({body}, '(?s)<div class=\"ad\">(.*?)</div>', 1)), '<[^>]*>', '', 'g')")
    s["page_sections"] = f"SELECT page_id, 'div' AS tag, 'ad' AS classes, substring({strip('x')}, 1, 100) AS text_preview FROM (SELECT page_id, {sec_text} AS x FROM pages)"
    s["page_forms"] = ("SELECT page_id, CAST(len(regexp_extract_all(regexp_extract(" + body + ", '(?s)<nav>(.*?)</nav>', 1), '<a[\\s>]')) AS BIGINT) AS n_fields "
                       f"FROM pages WHERE regexp_matches({body}, '<nav[\\s>]')")
    nav = f"regexp_extract({body}, '(?s)<nav>(.*?)</nav>', 1)"
    # the form pages end in a fixed form; nothing before it has such elements
    pid = "CAST(page_id AS VARCHAR)"
    s["pay_button"] = ("SELECT page_id, slot, selector FROM (SELECT page_id FROM pages), "
                       "(VALUES ('pay_button', '.b'), ('choice', '#s')) v(slot, selector) UNION ALL "
                       f"SELECT page_id, 'form', '#f' || {pid} FROM pages")
    s["page_buttons"] = (f"SELECT page_id, 'Pay now ' || {pid} AS text, NULL AS el_id, 'b ok' AS classes, NULL AS onclick, "
                         "'submit' AS type FROM pages UNION ALL SELECT page_id, 'Stop', 'last', '', 'go()', NULL FROM pages")
    s["page_inputs"] = (f"SELECT page_id, 'text' AS type, 'n' || {pid} AS el_name, NULL AS el_id, NULL AS placeholder FROM pages "
                        "UNION ALL SELECT page_id, NULL, NULL, 's', NULL FROM pages "
                        "UNION ALL SELECT page_id, NULL, NULL, NULL, 'say' FROM pages")
    js = ("'{\"forms\":[{\"id\":\"f' || @ || '\",\"class\":[\"big\",\"x\"],\"action\":\"/go\",\"method\":null,\"inputs\":['"
          " || '{\"type\":\"text\",\"name\":\"n' || @ || '\",\"id\":null,\"placeholder\":null,\"required\":true},'"
          " || '{\"type\":null,\"name\":null,\"id\":\"s\",\"placeholder\":null,\"required\":false}]}],'"
          " || '\"buttons\":[{\"text\":\"Pay now ' || @ || '\",\"id\":null,\"class\":[\"b\",\"ok\"],\"onclick\":null,\"type\":\"submit\"},'"
          " || '{\"text\":\"Stop\",\"id\":\"last\",\"class\":null,\"onclick\":\"go()\",\"type\":null}],'"
          " || '\"inputs\":[{\"type\":\"text\",\"name\":\"n' || @ || '\",\"id\":null,\"placeholder\":null,\"class\":null},'"
          " || '{\"type\":null,\"name\":null,\"id\":\"s\",\"placeholder\":null,\"class\":null},'"
          " || '{\"type\":null,\"name\":null,\"id\":null,\"placeholder\":\"say\",\"class\":null}],'"
          " || '\"interactive_elements\":[],\"key_sections\":[{\"tag\":\"div\",\"id\":null,\"class\":[\"wide\"],\"text_preview\":\"a\"}]}'").replace("@", pid)
    s["page_structure"] = ("SELECT page_id, 1::BIGINT AS n_forms, 2::BIGINT AS n_fields, 2::BIGINT AS n_buttons, 3::BIGINT AS n_inputs, "
                           f"1::BIGINT AS n_sections, {js} AS structure_json FROM pages")
    s["script_prompts"] = _script_prompts_sql(body)
    found = f"found AS ({s['page_selectors']})"
    fam_rows = ", ".join(f"({i}, {q(f)}, {q(sl)}, {q(d)})" for i, (f, sl, d) in enumerate(R.CASE_SLOTS))
    dims = f"dims(o, family, slot, def) AS (VALUES {fam_rows})"
    s["script_plan"] = (_with(found, dims) + " SELECT p.page_id, d.family, d.slot, coalesce(f.selector, d.def) AS selector, "
                        "f.selector IS NOT NULL AS resolved FROM pages p CROSS JOIN dims d "
                        "LEFT JOIN found f ON f.page_id = p.page_id AND f.slot = d.slot")
    only = ", ".join(f"({q(f)}, {q(sl)}, {q(b)})" for f, sl, b in R.CASE_BRANCH_SLOTS)
    s["case_slots"] = (_with(*CASE_CTES, found, dims, f"only_in(family, slot, branch) AS (VALUES {only})",
                             f"rt AS (SELECT qkey AS item_id, test_id, {_route('feature')} AS family, "
                             "CASE WHEN coalesce(test_type, 'positive') = 'positive' THEN 'positive' ELSE 'negative' END AS branch "
                             "FROM t_cases WHERE qkey IN (SELECT page_id FROM pages))",
                             "used AS (SELECT rt.*, d.slot, d.def, row_number() OVER (PARTITION BY item_id, test_id ORDER BY o) AS slot_no "
                             "FROM rt JOIN dims d USING (family) LEFT JOIN only_in x ON x.family = d.family AND x.slot = d.slot "
                             "WHERE x.branch IS NULL OR x.branch = rt.branch)")
                       + " SELECT u.item_id, u.test_id, u.family, u.branch, u.slot_no, u.slot, coalesce(f.selector, u.def) AS selector, "
                         "f.selector IS NOT NULL AS resolved FROM used u LEFT JOIN found f ON f.page_id = u.item_id AND f.slot = u.slot")
    fence = (f"CASE WHEN starts_with(text, '```') THEN regexp_replace(CASE WHEN strpos(text, chr(10)) > 0 "
             f"THEN substring(text, strpos(text, chr(10)) + 1) ELSE '' END, '(^|\\n){WS_LINE}*```{WS_LINE}*\\z', '') ELSE text END")
    cleaned = strip(fence)
    s["clean_fences"] = f"SELECT conv_id, turn, {cleaned} AS text FROM conversations"
    comps = ", ".join(f"CASE WHEN NOT contains(lower(c), {q(x.lower())}) THEN {q(x)} END" for x in rules.REQUIRED_SCRIPT_COMPONENTS)
    made = (f"CASE WHEN conv_id % 3 = 0 THEN {q(R.SCRIPT_HEAD + '  # ')} || replace(text, chr(10), ' ') || {q(R.SCRIPT_TAIL)} "
            f"ELSE {cleaned} END")
    miss = ', '.join(f"CASE WHEN NOT contains(lower(script), {q(x.lower())}) THEN 1 END" for x in rules.REQUIRED_SCRIPT_COMPONENTS)
    s["script_choice"] = (BENCH_CASES + f", ms AS (SELECT conv_id AS item_id, turn, {made} AS script FROM conversations WHERE role = 'assistant'), "
                          f"mv AS (SELECT item_id, count(*) AS v, arg_min(script, turn) AS script FROM ms WHERE length(script) > 0 "
                          f"AND len(list_filter([{miss}], lambda z: z IS NOT NULL)) = 0 GROUP BY item_id) "
                          "SELECT c.qkey AS item_id, c.test_id, CASE WHEN coalesce(mv.v, 0) > 0 THEN 'model' ELSE 'template' END AS origin, "
                          "CAST(coalesce(mv.v, 0) AS BIGINT) AS valid_candidates, mv.script FROM t_cases c LEFT JOIN mv ON mv.item_id = c.qkey")
    s["component_check"] = (f"SELECT conv_id, turn, array_to_string(list_filter([{comps}], lambda z: z IS NOT NULL), ', ') AS missing, "
                            f"len(list_filter([{comps}], lambda z: z IS NOT NULL)) = 0 AS valid FROM (SELECT conv_id, turn, {cleaned} AS c FROM conversations)")
    ob = _fill(_orders_base())
    s["order_totals"] = _with(ob) + " SELECT o_orderkey, CAST(n_items AS BIGINT) AS n_items, code_status, subtotal, discount, shipping, total FROM totals"
    nbsp, bom = "chr(160)", "chr(65279)"
    cust = f"""
cf AS (SELECT c_custkey, CASE WHEN c_custkey % 6 = 3 THEN chr(9) || chr(12288) ELSE c_name END AS name,
              CASE c_custkey % 6 WHEN 0 THEN 'c' || c_custkey || {nbsp} || '@mail.example.com' WHEN 1 THEN 'c' || c_custkey || '@mail'
                   ELSE ' c' || c_custkey || '@mail.example.com' || {bom} END AS email,
              CASE WHEN c_custkey % 6 = 2 THEN {bom} || ' ' || chr(8195) ELSE c_mktsegment END AS address FROM customer),
fl AS (SELECT c_custkey, {_js_strip('name')} <> '' AS name_ok, {_js_strip('address')} <> '' AS address_ok,
              regexp_matches({_js_strip('email')}, {q(rules.EMAIL_PATTERN)}) AS email_ok FROM cf)
"""
    s["order_totals_bucketed"] = s["order_totals"]
    s["order_eligible"] = (_with(ob, cust) + " SELECT t.o_orderkey, CAST(t.n_items AS BIGINT) AS n_items, f.name_ok, f.email_ok, f.address_ok, "
                           "t.n_items > 0 AND coalesce(f.name_ok, false) AND coalesce(f.email_ok, false) AND coalesce(f.address_ok, false) AS eligible "
                           "FROM totals t LEFT JOIN fl f ON f.c_custkey = t.o_custkey")
    s["record_validation"] = ("SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, candidate, "
                              f"coalesce(regexp_matches({_js_strip('candidate')}, {q(rules.EMAIL_PATTERN)}), false) AS email_ok FROM ("
                              f"SELECT doc_id, unnest(range(1, len(regexp_extract_all(text, {q(R.EMAIL_CANDIDATE)})) + 1)) AS i, "
                              f"unnest(regexp_extract_all(text, {q(R.EMAIL_CANDIDATE)})) AS candidate FROM documents)")
    s["amount_parse"] = ("SELECT o_orderkey, 'Total: $' || format('{:,.2f}', o_totalprice) AS amount_text, "
                         "TRY_CAST(replace(replace(format('{:,.2f}', o_totalprice), '$', ''), ',', '') AS DOUBLE) AS amount FROM orders")
    s["discount_reconcile"] = (_with(ob) + " SELECT o_orderkey, CAST(round((CAST(subtotal AS DECIMAL(18,2)) + CAST(shipping AS DECIMAL(18,2))) "
                               "* CAST(0.85 AS DECIMAL(5,4)), 2) AS DOUBLE) AS expected, total AS observed, "
                               "abs(CAST(round((CAST(subtotal AS DECIMAL(18,2)) + CAST(shipping AS DECIMAL(18,2))) * CAST(0.85 AS DECIMAL(5,4)), 2) AS DOUBLE) - total) < 0.01 AS ok "
                               "FROM totals WHERE code_status = 'applied'")
    return s


def _script_prompts_sql(body: str) -> str:
    """Prompt rows for the page-title requests. On the driver pages no
    checkout slot resolves and no form/button/input/section exists, so the
    selector JSON is ``{}`` and the structure JSON lists are empty."""
    import json
    import re
    legacy = "regexp_replace(html, '&amp([^;a-zA-Z0-9])', '&amp;\\1', 'g')"
    title = _decode(f"regexp_extract({legacy}, '(?s)<title[^>]*>(.*?)</title>', 1)")
    titles = f"titles AS (SELECT page_id, {strip(title)} AS query FROM pages WHERE regexp_matches(html, '<title'))"
    structure = json.dumps({"forms": [], "buttons": [], "inputs": [], "interactive_elements": [],
                            "key_sections": []}, indent=2)
    fields = {
        "test_id": "c.test_id", "feature": "c.feature", "test_scenario": "c.test_scenario",
        "expected_result": "c.expected_result", "test_type": "coalesce(c.test_type, 'positive')",
        "steps": "CASE WHEN c.steps IS NULL THEN '[]' ELSE '[' || array_to_string(list_transform(c.steps, "
                 "lambda x: chr(39) || x || chr(39)), ', ') || ']' END",
        "selectors": q("{}"), "structure": q(structure), "context": "coalesce(k.context, '')",
        "class_suffix": "replace(c.test_id, '-', '_')",
    }
    pieces = []
    for lit, name in re.findall(r"([^{]*)(?:\{(\w+)\})?", rules.SCRIPT_PROMPT):
        if lit:
            pieces.append(q(lit))
        if name:
            pieces.append(f"({fields[name]})")
    prompt = " || ".join(pieces)
    return (_with(CHUNKS_CTE, CHUNK_TERMS, titles, test_case_ctes("titles", "page_id", "query", R.TEST_K, "t_", rules.FEATURE_KEYWORDS, rules.TEST_TEMPLATES),
                  "cq AS (SELECT qkey AS page_id, test_id, qkey || chr(1) || test_id AS ck, "
                  "feature || ' ' || test_scenario AS q_text FROM t_cases)",
                  lexical("k_", "cq", "ck", "q_text", 5))
            + f" SELECT c.qkey AS page_id, c.test_id, md5({prompt}) AS prompt_md5, CAST(length({prompt}) AS BIGINT) "
              "AS prompt_chars FROM t_cases c LEFT JOIN k_ctx k ON k.qkey = c.qkey || chr(1) || c.test_id")


ORACLE_SQL: dict[str, str] = _statements()
