"""Context assembly, rule-based feature/spec detection and test-case rows.

All operators are JVM-side expressions. Dictionaries and templates are small
plan-time constants (``docmill.rules``), applied per row as literal arrays, so
detection and expansion are narrow projections: no join, no shuffle, and a
hot query/source cannot skew them. The only grouping is context assembly,
which is bounded by the retrieval depth ``k`` per query.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill import rules


def _lit_str_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


# ---------------------------------------------------------------------------
# D1 / D3 / D11

def source_block(source: Column, text: Column) -> Column:
    """``[Source: {source}]\\n{text}\\n``"""
    return F.concat(F.lit("[Source: "), source, F.lit("]\n"), text, F.lit("\n"))


def assemble_context(retrieved: DataFrame, keys: Sequence[str], rank_col: str = "rank",
                     source_col: str = "source", text_col: str = "text",
                     default_source: str | None = None) -> DataFrame:
    """One context string per query: source blocks in rank order joined by '\\n'.

    ``collect_list`` is bounded by the retrieval depth, so no group grows
    with the corpus. Also returns the distinct retrieved sources (sorted).
    """
    src = F.col(source_col)
    if default_source is not None:
        src = F.coalesce(src, F.lit(default_source))
    parts = retrieved.select(*keys, F.col(rank_col).alias("_rank"), src.alias("_src"),
                             source_block(src, F.col(text_col)).alias("_part"))
    return (parts.groupBy(*keys)
                 .agg(F.sort_array(F.collect_list(F.struct("_rank", "_part"))).alias("_parts"),
                      F.array_sort(F.collect_set("_src")).alias("chunk_sources"))
                 .select(*keys, F.array_join(F.transform("_parts", lambda p: p["_part"]), "\n").alias("context"),
                         "chunk_sources"))


def cited_sources(context: Column) -> Column:
    """Distinct ``[Source: x]`` names found in the context, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(context, F.lit(rules.SOURCE_TAG_PATTERN), 1)))


# ---------------------------------------------------------------------------
# D2 / D4

def _any_contains(lowered: Sequence[Column], keywords: Sequence[str]) -> Column:
    cond = F.lit(False)
    for kw in keywords:
        for text in lowered:
            cond = cond | F.contains(text, F.lit(kw.lower()))
    return cond


def detected_features(texts: Sequence[Column], keywords=rules.FEATURE_KEYWORDS) -> Column:
    """ARRAY<STRUCT<feature_ord INT, feature STRING>> of features present.

    A feature is present when any keyword is a substring of any lower-cased
    text; order follows the dictionary. Texts are lowered once.
    """
    lowered = [F.lower(t) for t in texts]
    items = [F.struct(F.lit(i).alias("feature_ord"), F.lit(name).alias("feature"),
                      _any_contains(lowered, kws).alias("hit"))
             for i, (name, kws) in enumerate(keywords)]
    kept = F.filter(F.array(*items), lambda s: s["hit"])
    return F.transform(kept, lambda s: F.struct(s["feature_ord"].alias("feature_ord"), s["feature"].alias("feature")))


def spec_list(feature: Column, text: Column, spec_rules=rules.SPEC_RULES) -> Column:
    """Ordered specification sentences whose needles all occur in ``text``."""
    lowered = F.lower(text)
    items = []
    for feat, needles, spec in spec_rules:
        cond = feature == F.lit(feat)
        for needle, case_sensitive in needles:
            cond = cond & F.contains(text if case_sensitive else lowered,
                                     F.lit(needle if case_sensitive else needle.lower()))
        items.append(F.when(cond, F.lit(spec)))
    return F.filter(F.array(*items), lambda s: s.isNotNull())


def feature_rows(df: DataFrame, keys: Sequence[str], texts: Sequence[str],
                 keywords=rules.FEATURE_KEYWORDS) -> DataFrame:
    """(keys..., feature_ord, feature) for every detected feature."""
    det = detected_features([F.col(t) for t in texts], keywords)
    return df.select(*keys, F.inline(det))


def feature_map(queries: DataFrame, contexts: DataFrame, keys: Sequence[str], query_col: str = "query",
                keywords=rules.FEATURE_KEYWORDS, spec_rules=rules.SPEC_RULES) -> DataFrame:
    """Per query with a context and detected feature: keys..., feature_ord,
    feature, source_docs (the context's cited sources, sorted) and specifications
    (of that feature, in rule order). Narrow but for the join on the query keys."""
    both = queries.select(*keys, query_col).join(contexts.select(*keys, "context"), list(keys))
    found = both.select(*keys, "context", F.inline(detected_features([F.col("context"), F.col(query_col)], keywords)))
    return found.select(*keys, "feature_ord", "feature", cited_sources(F.col("context")).alias("source_docs"),
                        spec_list(F.col("feature"), F.col("context"), spec_rules).alias("specifications"))


# ---------------------------------------------------------------------------
# D5-D9, D11

def _sql_str(value: str) -> str:
    """Spark SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _sql_case_struct(ford: int, feature: str, scenario_sql: str, expected: str, ttype: str, steps) -> str:
    steps_sql = ("CAST(NULL AS ARRAY<STRING>)" if steps is None
                 else "array(" + ", ".join(_sql_str(x) for x in steps) + ")")
    return (f"named_struct('feature_ord', {ford}, 'feature', {_sql_str(feature)}, 'test_scenario', {scenario_sql}, "
            f"'expected_result', {_sql_str(expected)}, 'test_type', {_sql_str(ttype)}, 'steps', {steps_sql})")


def test_cases(queries: DataFrame, contexts: DataFrame, keys: Sequence[str], query_col: str = "query",
               keywords=rules.FEATURE_KEYWORDS, templates=rules.TEST_TEMPLATES) -> DataFrame:
    """Rule-based test cases per query.

    ``contexts`` is the output of :func:`assemble_context` (one row per query
    with at least one retrieved chunk). Queries without retrieval get the
    informational row; queries whose features match no template get the
    generic exploratory row; otherwise the matched templates numbered
    ``TC-001``... in (feature, positive-before-negative, template) order.

    Texts are lowered once and each feature flag is its own column; the
    matched templates are chosen by plain CASE branches (no lambda that
    reaches back to row columns), so every keyword scan runs once per row.
    The rules are written as SQL expressions, so the plan is built with a
    handful of calls.
    """
    keys = list(keys)
    qk = [f"`{k}`" for k in keys]
    qcol = f"`{query_col}`"
    joined = queries.select(*keys, query_col).join(contexts, keys, "left")
    low = joined.selectExpr(*qk, qcol, "context", "chunk_sources", "lower(context) AS _lc", f"lower({qcol}) AS _lq")
    flags = []
    for i, (_, kws) in enumerate(keywords):
        terms = [f"contains({t}, {_sql_str(kw.lower())})" for kw in kws for t in ("_lc", "_lq")]
        flags.append(f"({' OR '.join(terms) if terms else 'false'}) AS _f{i}")
    flagged = low.selectExpr(*qk, qcol, "context", "chunk_sources", *flags)
    ford = {name: i for i, (name, _) in enumerate(keywords)}
    order = {"positive": 0, "negative": 1}
    keyed, counters = [], {}
    for feat, ttype, label, scenario, expected, steps in templates:
        if feat not in ford:
            continue
        n = counters.get((feat, ttype), 0)
        counters[(feat, ttype)] = n + 1
        keyed.append(((ford[feat], order.get(ttype, 2), n), (label, scenario, expected, ttype, steps)))
    keyed.sort(key=lambda kv: kv[0])
    picks = [f"CASE WHEN _f{k[0]} THEN {_sql_case_struct(k[0], label, _sql_str(scen), exp, tt, st)} END"
             for k, (label, scen, exp, tt, st) in keyed]
    matched = f"filter(array({', '.join(picks)}), t -> t IS NOT NULL)" if picks else "array()"
    with_matched = flagged.selectExpr(*qk, qcol, "context", "chunk_sources", f"{matched} AS _matched")
    g, e = rules.GENERIC_CASE, rules.EMPTY_RETRIEVAL_CASE
    generic = "array(" + _sql_case_struct(-1, g["feature"], f"concat({_sql_str(g['scenario_prefix'])}, {qcol})",
                                          g["expected_result"], g["test_type"], g["steps"]) + ")"
    informational = "array(" + _sql_case_struct(-1, e["feature"], _sql_str(e["test_scenario"]),
                                                e["expected_result"], e["test_type"], None) + ")"
    cited = (f"array_join(array_sort(array_distinct(regexp_extract_all(context, "
             f"{_sql_str(rules.SOURCE_TAG_PATTERN)}, 1))), ', ')")
    cases = (f"CASE WHEN context IS NULL THEN {informational} WHEN size(_matched) > 0 THEN _matched "
             f"ELSE {generic} END")
    grounded = (f"CASE WHEN context IS NULL THEN {_sql_str(e['grounded_in'])} WHEN size(_matched) > 0 THEN {cited} "
                f"ELSE array_join(chunk_sources, ', ') END")
    exploded = with_matched.selectExpr(*qk, f"{grounded} AS grounded_in", f"posexplode({cases}) AS (_pos, _case)")
    return exploded.selectExpr(
        *qk, "format_string('TC-%03d', _pos + 1) AS test_id", "_case.feature AS feature",
        "_case.test_scenario AS test_scenario", "_case.expected_result AS expected_result", "grounded_in",
        "_case.test_type AS test_type", "_case.steps AS steps")


# ---------------------------------------------------------------------------
# D14 / D15 / D17 / D18

def case_steps(cases: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per step, numbered from 1; rows without steps give none."""
    return cases.select(*keys, "test_id", F.posexplode("steps").alias("_p", "step")) \
                .select(*keys, "test_id", (F.col("_p") + 1).alias("step_no"), "step")


def case_labels(cases: DataFrame, keys: Sequence[str]) -> DataFrame:
    return cases.select(*keys, "test_id",
                        F.concat(F.col("test_id"), F.lit(": "), F.col("test_scenario")).alias("label"))


def grounding_check(cases: DataFrame, kb_sources: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per test case: how many cited sources, and how many are not in the KB.

    Cited names are split from ``grounded_in``; the KB source list is
    deduplicated and joined (broadcast when small), unmatched = missing.
    """
    cited = cases.select(*keys, "test_id",
                         F.explode_outer(F.filter(F.split("grounded_in", ", "),
                                                  lambda s: s != F.lit(""))).alias("cited"))
    known = kb_sources.select(F.col("source").alias("cited"), F.lit(True).alias("_known")).distinct()
    marked = cited.join(known, "cited", "left")
    return marked.groupBy(*keys, "test_id").agg(
        F.count("cited").alias("n_cited"),
        F.count(F.when(F.col("cited").isNotNull() & F.col("_known").isNull(), 1)).alias("n_missing"))


COVERAGE_TYPES = ["positive", "negative", "exploratory", "informational"]


def coverage_matrix(cases: DataFrame) -> DataFrame:
    """feature x test_type counts (pivot on a fixed value list: one pass)."""
    return (cases.groupBy("feature").pivot("test_type", COVERAGE_TYPES).count().na.fill(0, COVERAGE_TYPES))


# ---------------------------------------------------------------------------
# D12 / D13 / D10

def test_case_prompt(query: Column, context: Column) -> Column:
    head, rest = rules.TEST_CASE_PROMPT.split("{query}")
    mid, tail = rest.split("{context}")
    return F.concat(F.lit(head), query, F.lit(mid), context, F.lit(tail))


RESPONSE_SCHEMA = ("array<struct<test_id:string,feature:string,test_scenario:string,"
                   "expected_result:string,grounded_in:string,test_type:string,steps:array<string>>>")


def strip_model_fence(text: Column) -> Column:
    """Strip; if it starts with ``` drop backticks at both ends, then the
    first line (a single-line remainder is kept whole)."""
    from docmill.functions.text import py_strip
    s = py_strip(text)
    unticked = F.regexp_replace(s, "^`+|`+$", "")
    nl = F.instr(unticked, "\n")
    dropped = F.when(nl > 0, F.substring(unticked, nl + 1, F.lit(2147483647))).otherwise(unticked)
    return F.when(F.startswith(s, F.lit("```")), dropped).otherwise(s)


CASE_COLUMNS = ["test_id", "feature", "test_scenario", "expected_result", "grounded_in", "test_type", "steps"]


def _one_json_text(text: Column) -> Column:
    """Whether ``text`` is one JSON list or object and nothing else. Strings are
    removed first; the brackets left must close exactly at the end."""
    bare = F.regexp_replace(text, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', "")
    marks = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
    depth = F.aggregate(
        marks, F.struct(F.lit(0).alias("d"), F.lit(0).alias("closed")),
        lambda acc, m: F.struct(
            (acc["d"] + F.when(m.isin("[", "{"), 1).when(m.isin("]", "}"), -1).otherwise(0)).alias("d"),
            (acc["closed"] + F.when(m.isin("]", "}") & (acc["d"] == 1), 1).otherwise(0)).alias("closed")))
    return bare.rlike(r"^\s*[\[{](?s:.*)[\]}]\s*$") & (depth["closed"] == 1) & (depth["d"] == 0)


def _strict_cases(cleaned: Column) -> Column:
    """The cases of one JSON text, ``steps`` as text."""
    strict = {"allowSingleQuotes": "false", "allowUnquotedFieldNames": "false", "allowComments": "false"}
    return F.from_json(cleaned, RESPONSE_SCHEMA.replace("steps:array<string>", "steps:string"), strict)


def parse_responses(responses: DataFrame, keys: Sequence[str], text_col: str = "text") -> DataFrame:
    """Model output -> case rows; an object becomes a one-element list, anything
    that is not one strict JSON text of objects is kept as an error row.

    Output: keys..., pos, the case columns, n_steps, bad, raw. ``steps`` that are
    not a list become a list of that one value.
    """
    cleaned = strip_model_fence(F.col(text_col))
    parsed = responses.select(*keys, F.col(text_col).alias("raw"), F.when(
        F.coalesce(_one_json_text(cleaned), F.lit(False)), _strict_cases(cleaned)).alias("_arr"))
    rows = parsed.select(*keys, "raw", F.col("_arr").isNull().alias("bad"),
                         F.posexplode_outer("_arr").alias("pos", "_c"))
    steps = F.coalesce(F.from_json(F.col("_c.steps"), "array<string>"),
                       F.when(F.col("_c.steps").isNotNull(), F.array("_c.steps")))
    return rows.select(*keys, "pos", *[F.col(f"_c.{c}").alias(c) for c in CASE_COLUMNS[:-1]], steps.alias("steps"),
                       F.size(steps).alias("n_steps"), "bad", "raw")


def extra_fields(responses: DataFrame, keys: Sequence[str], text_col: str = "text") -> DataFrame:
    """What model output holds beyond the case columns, nested values whole.

    Output: keys..., pos (of the case in its output), field, value (JSON text; the
    keys of objects in it sorted). Output that ``parse_responses`` calls bad, or that
    has one key twice in an object, has no rows here, nor have NULL keys. Narrow.
    """
    spark = responses.sparkSession
    known = responses
    for c in keys:
        known = known.where(F.col(c).isNotNull())
    known = known.select(*keys, strip_model_fence(F.col(text_col)).alias("_text"))
    text = F.col("_text")
    listed = F.when(F.startswith(F.ltrim(text), F.lit("[")), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    # an output's good cases are the first ones, as many as were parsed. Bad output has a
    # NULL list here: a filter would be evaluated before the rows are spread over the cores
    read = known.select(*keys, F.size(_strict_cases(text)).alias("_good"), F.when(
        F.coalesce(_one_json_text(text), F.lit(False)), F.try_parse_json(listed)).alias("_list"))
    cases = read.lateralJoin(spark.tvf.variant_explode(F.col("_list").outer())) \
        .where(F.coalesce(F.col("pos") < F.col("_good"), F.lit(False))).select(*keys, "pos", F.col("value").alias("_case"))
    fields = cases.lateralJoin(spark.tvf.variant_explode(F.col("_case").outer()).select(F.col("key").alias("field"), "value"))
    return fields.where(F.col("field").isNotNull() & ~F.col("field").isin(CASE_COLUMNS)) \
        .select(*keys, "pos", "field", F.to_json("value").alias("value"))


def generator_choice(rule_cases: DataFrame, model_cases: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The case rows that count: for a query with at least one good model row its
    model rows, in order; for the others their rule rows. Output: keys..., origin,
    the case columns."""
    good = model_cases.where(~F.col("bad") & F.col("pos").isNotNull())
    model = good.select(*keys, F.lit("model").alias("origin"), *CASE_COLUMNS)
    rule = rule_cases.join(good.select(*keys).distinct(), list(keys), "left_anti") \
        .select(*keys, F.lit("rules").alias("origin"), *CASE_COLUMNS)
    return model.unionByName(rule)


def case_at(cases: DataFrame, keys: Sequence[str], position: int) -> DataFrame:
    """The case at an ordinal (from 0, by test_id) of each query; no row where a
    query has fewer."""
    return cases.where(F.col("test_id") == F.format_string("TC-%03d", F.lit(position + 1)))
