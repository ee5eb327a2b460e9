"""Script-plan operators: per-case context, family routing, slot plans with
family defaults, prompt rows, model-output cleanup and component checks."""

from __future__ import annotations

from collections.abc import Sequence
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill import rules
from docmill.functions.text import PY_LINE_WHITESPACE_CLASS, py_strip
from docmill.operators.generate import assemble_context
from docmill.operators.pages import selector_list, structure_record
from docmill.operators.retrieve import SCRIPT_CONTEXT_K, lexical_topk
from docmill.sources.files import json_normalize


def case_query(cases: DataFrame) -> Column:
    """Retrieval text for a test case: feature + ' ' + scenario."""
    return F.concat(F.col("feature"), F.lit(" "), F.col("test_scenario"))


def case_context(cases: DataFrame, chunks: DataFrame, keys: Sequence[str], k: int = SCRIPT_CONTEXT_K,
                 c_keys: Sequence[str] = ("doc_id", "chunk_index"), source_col: str = "source") -> DataFrame:
    """Context (k chunks) per test case; a missing source reads 'Unknown'."""
    q = cases.select(*keys, "test_id", case_query(cases).alias("q_text"))
    q = q.withColumn("case_key", F.concat_ws("\u0001", *[F.col(c).cast("string") for c in keys], "test_id"))
    top = lexical_topk(q.select("case_key", "q_text"), chunks, k=k, q_keys=["case_key"],
                       c_keys=list(c_keys), q_text="q_text", carry=[source_col, "text"])
    ctx = assemble_context(top, ["case_key"], source_col=source_col, default_source="Unknown")
    return q.join(ctx, "case_key", "left").select(*keys, "test_id", "context")


def route_family(feature: Column, families=rules.SCRIPT_FAMILIES, generic: str = rules.GENERIC_FAMILY) -> Column:
    f = F.lower(feature)
    out = None
    for fam, needles in families:
        cond = F.lit(False)
        for n in needles:
            cond = cond | F.contains(f, F.lit(n))
        out = F.when(cond, F.lit(fam)) if out is None else out.when(cond, F.lit(fam))
    return out.otherwise(F.lit(generic))


def branch(test_type: Column) -> Column:
    """Template branch: test_type defaults to positive; anything else is negative."""
    return F.when(F.coalesce(test_type, F.lit("positive")) == "positive", F.lit("positive")).otherwise(F.lit("negative"))


def script_route(cases: DataFrame, keys: Sequence[str]) -> DataFrame:
    return cases.select(*keys, "test_id", route_family(F.col("feature")).alias("family"),
                        branch(F.col("test_type")).alias("branch"))


def script_plan(page_slots: DataFrame, slot_defaults=rules.FAMILY_SLOT_DEFAULTS) -> DataFrame:
    """(page_id, family, slot, selector, resolved): every family's slots per page.

    ``page_slots`` has page_id and slots, the page's resolved selectors
    (``pages.selector_list``). The (family, slot, default) list is a plan-time
    constant; a slot without a selector takes its default. Narrow.
    """
    wanted = page_slots.select("page_id", "slots", F.inline(_slot_dims(slot_defaults)))
    found = _slot_selector(F.col("slots"), F.col("slot"))
    return wanted.select("page_id", "family", "slot", F.coalesce(found, "default").alias("selector"),
                         found.isNotNull().alias("resolved"))


def _slot_dims(slot_defaults, branch_slots=()) -> Column:
    only = {(f, s): b for f, s, b in branch_slots}
    return F.array(*[F.struct(F.lit(f).alias("family"), F.lit(s).alias("slot"), F.lit(d).alias("default"),
                              F.lit(only.get((f, s))).cast("string").alias("only")) for f, s, d in slot_defaults])


def _slot_selector(slots: Column, slot: Column) -> Column:
    return F.try_element_at(F.filter(slots, lambda x: x["slot"] == slot), F.lit(1))["selector"]


def case_slots(cases: DataFrame, slot_defaults=rules.FAMILY_SLOT_DEFAULTS,
               branch_slots=rules.BRANCH_SLOTS) -> DataFrame:
    """Slot plan per test case: the columns of ``cases`` (with feature, test_type
    and the page's slots) plus family, branch, slot_no (from 1 in rule order),
    slot, selector and resolved, for the slots that the case's family uses in its
    branch. Narrow."""
    routed = cases.withColumn("family", route_family(F.col("feature"))).withColumn("branch", branch(F.col("test_type")))
    used = F.filter(_slot_dims(slot_defaults, branch_slots), lambda d: (d["family"] == F.col("family"))
                    & (d["only"].isNull() | (d["only"] == F.col("branch"))))
    out = routed.select("*", F.posexplode(used).alias("_p", "_d"))
    found = _slot_selector(F.col("slots"), F.col("_d.slot"))
    return out.select(*[c for c in routed.columns if c != "slots"], (F.col("_p") + 1).alias("slot_no"),
                      F.col("_d.slot").alias("slot"), F.coalesce(found, F.col("_d.default")).alias("selector"),
                      found.isNotNull().alias("resolved"))


# ---------------------------------------------------------------------------
# F4 prompt rows

def _list_text(items: Column) -> Column:
    """A string list as Python prints it: quoted with ', or with " if the string
    holds ' but no "."""
    def quoted(x):
        e = x
        for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            e = F.replace(e, F.lit(raw), F.lit(shown))
        double = F.contains(x, F.lit("'")) & ~F.contains(x, F.lit('"'))
        return F.when(double, F.concat(F.lit('"'), e, F.lit('"'))).otherwise(
            F.concat(F.lit("'"), F.replace(e, F.lit("'"), F.lit("\\'")), F.lit("'")))

    return F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(items, F.array()), quoted), ", "), F.lit("]"))


def selectors_json(slots: Column) -> Column:
    """The resolved slots (``pages.selector_list``) as a JSON object in rule order."""
    return F.to_json(F.map_from_entries(F.transform(slots, lambda x: F.struct(x["slot"], x["selector"]))))


def script_prompt(selectors: Column, structure: Column) -> Column:
    """Prompt text of a row with the case columns and context; ``selectors`` and
    ``structure`` are the page's JSON texts, already indented."""
    def text(name):
        return F.coalesce(F.col(name), F.lit("None"))

    fields = {"test_id": text("test_id"), "feature": text("feature"), "test_scenario": text("test_scenario"),
              "expected_result": text("expected_result"),
              "test_type": F.when(F.coalesce("test_type", F.lit("")) == "", F.lit("positive")).otherwise(F.col("test_type")),
              "steps": _list_text(F.col("steps")), "selectors": selectors, "structure": structure,
              "context": F.coalesce("context", F.lit("")),
              "class_suffix": F.replace(F.coalesce("test_id", F.lit("")), F.lit("-"), F.lit("_"))}
    parts = []
    for literal, name, _, _ in Formatter().parse(rules.SCRIPT_PROMPT):
        parts += [F.lit(literal)] * bool(literal) + ([fields[name]] if name else [])
    return F.concat(*parts)


def page_context(parsed: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """(page_id, extra..., selectors_json, structure_json) of parsed pages, each
    JSON text indented once per page. Narrow."""
    els = F.col("els")
    made = parsed.select("page_id", *[c.alias(name) for name, c in (extra or {}).items()],
                         selectors_json(selector_list(els)).alias("selectors_json"),
                         F.to_json(structure_record(els), {"ignoreNullFields": "false"}).alias("structure_json"))
    # both JSON texts are made before the parser sees them (used twice, they are
    # not inlined into its call)
    for c in ("selectors_json", "structure_json"):
        made = made.withColumn(c, F.when(F.col(c).isNotNull(), json_normalize(F.col(c))))
    return made


def script_prompts(cases: DataFrame, pages_ctx: DataFrame) -> DataFrame:
    """``cases`` (page_id, case columns, context) with the prompt text of each
    (test case, page); ``pages_ctx`` is the output of ``page_context``."""
    return cases.join(pages_ctx, "page_id", "left").withColumn("prompt", script_prompt(
        F.coalesce("selectors_json", F.lit("{}")), F.coalesce("structure_json", F.lit("{}"))))


# ---------------------------------------------------------------------------
# F5 / F6

def clean_fences(text: Column) -> Column:
    """If the text starts with ```: drop the first line and a last line that
    is only ``` (surrounding whitespace allowed); then strip."""
    nl = F.instr(text, "\n")
    rest = F.when(nl > 0, F.substring(text, nl + 1, F.lit(2147483647))).otherwise(F.lit(""))
    ws = PY_LINE_WHITESPACE_CLASS
    rest = F.regexp_replace(rest, f"(^|\\n){ws}*```{ws}*\\z", "")
    return py_strip(F.when(F.startswith(text, F.lit("```")), rest).otherwise(text))


def missing_components(text: Column, components: Sequence[str] = rules.REQUIRED_SCRIPT_COMPONENTS) -> Column:
    """Required substrings (case-insensitive) absent from the text, in order."""
    lowered = F.lower(text)
    checks = [F.when(~F.contains(lowered, F.lit(c.lower())), F.lit(c)) for c in components]
    return F.filter(F.array(*checks), lambda c: c.isNotNull())


# ---------------------------------------------------------------------------
# F8

def script_choice(requests: DataFrame, model_texts: DataFrame, keys: Sequence[str],
                  text_col: str = "text", order_col: str | None = None) -> DataFrame:
    """Per request: the model script wins when a cleaned candidate is
    non-empty and has every required component; otherwise the rule plan.

    ``model_texts`` may hold several candidates per request key; the valid one
    of least ``order_col`` (then text) is taken with a partial aggregate, so a
    key with many candidates never lands whole in one group.
    Output: request columns + origin ('model' | 'template') + valid_candidates
    + script (the cleaned text; NULL for the rule plan).
    """
    keys = list(keys)
    cleaned = clean_fences(F.col(text_col))
    order = F.col(order_col) if order_col else F.lit(0)
    tried = model_texts.select(*keys, order.alias("_o"), cleaned.alias("_script"))
    ok = (F.length("_script") > 0) & (F.size(missing_components(F.col("_script"))) == 0)
    valid = tried.where(ok).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("valid_candidates"), F.min(F.struct("_o", "_script")).alias("_best"))
    out = requests.join(valid, keys, "left")
    n = F.coalesce(F.col("valid_candidates"), F.lit(0))
    return out.withColumn("origin", F.when(n > 0, F.lit("model")).otherwise(F.lit("template"))) \
              .withColumn("valid_candidates", n).withColumn("script", F.col("_best._script")).drop("_best")
