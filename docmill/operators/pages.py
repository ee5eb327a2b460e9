"""Page-structure extraction.

One parser pass per page (``mapInArrow``, Arrow batches) turns raw HTML into one
row per page with its element list, or an ``elements`` table. Everything after
that -- selector slots, sections, forms, inventories, roll-ups -- is expressions
over that list (no exchange) or Spark SQL over the table. Slot rules are simple CSS selectors translated
into column predicates at plan time (no CSS engine, no join with a rules
table).
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill import rules
from docmill.functions import html as H
from docmill.functions.text import readable

# ---------------------------------------------------------------------------
# A7 page text


@F.pandas_udf(T.StringType())
def _text_nodes(html: pd.Series) -> pd.Series:
    return html.map(H.raw_page_text)


def html_to_text(html: Column) -> Column:
    """Readable page text: the parser gives the text nodes, the spacing rules
    are expressions; unparsable input stays as it is."""
    return F.coalesce(readable(_text_nodes(html)), html)


def page_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    return pages.select(id_col, html_to_text(F.col(html_col)).alias("text"))


# ---------------------------------------------------------------------------
# E1 element table

PAGES_PER_BATCH = 64


def parse_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
                columns: Sequence[str] | None = None, text_tags: Sequence[str] | None = None) -> DataFrame:
    """(page_id, els): one row per page with its elements in document order as
    structs of ``columns`` (default: all). Narrow: each page is parsed once, in the task that read it,
    ``PAGES_PER_BATCH`` pages at a time; pages without elements have an empty
    list. ``text_tags`` limits whose text is made (it is as long as the page for
    its outer elements)."""
    kinds = [(n, k) for n, k in H.ELEMENT_COLUMNS if columns is None or n in columns]
    names = [n for n, _ in kinds]
    schema = "page_id long, els array<struct<" + ",".join(f"{n}:{k}" for n, k in kinds) + ">>"
    tags = None if text_tags is None else frozenset(text_tags)
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html"))

    fields = [pa.field(n, H.ARROW_TYPES[k]) for n, k in kinds]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, PAGES_PER_BATCH):
                part = batch.slice(lo, PAGES_PER_BATCH)
                made = [H.element_columns(h, names, tags) for h in part.column("html").to_pylist()]
                ends = [0]
                for m in made:
                    ends.append(ends[-1] + len(m[0]))
                flat = [pa.array([v for m in made for v in m[i]], f.type) for i, f in enumerate(fields)]
                els = pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                               pa.StructArray.from_arrays(flat, fields=fields))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), els], names=["page_id", "els"])

    return src.mapInArrow(run, schema)


def elements(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
             columns: Sequence[str] | None = None, text_tags: Sequence[str] | None = None) -> DataFrame:
    """One row per element: page_id and ``columns`` of (ord, tag, el_id, el_name,
    type, placeholder, value, onclick, action, method, href, classes, required,
    text, text_strip, last, attrs)."""
    return parse_pages(pages, id_col, html_col, columns, text_tags).select("page_id", F.inline("els"))


def by_page(els: DataFrame) -> DataFrame:
    """An element table back as one row per page (page_id, els): one exchange."""
    fields = ["ord"] + [c for c in els.columns if c not in ("page_id", "ord")]
    return els.groupBy("page_id").agg(F.array_sort(
        F.collect_list(F.struct(*fields)),
        lambda a, b: F.when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0)).alias("els"))


def tag_counts(els: DataFrame) -> DataFrame:
    return els.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------------------
# E2-E4 selector slots

_TOKEN = re.compile(
    r"""(?P<tag>[a-zA-Z][\w-]*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)"""
    r"""|\[(?P<attr>[\w-]+)(?:(?P<op>[*^$]?=)["'](?P<val>[^"']*)["'])?\]""")


def _attr(e, name: str) -> Column:
    return e["el_" + name] if name in ("id", "name") else F.element_at(e["attrs"], F.lit(name))


class _Columns:
    """Element fields as columns of an element table."""

    def __getitem__(self, name: str) -> Column:
        return F.col(name)


def css_predicate(selector: str, e=_Columns()) -> Column:
    """Predicate on an element (a struct, or the columns of an element table)
    for a selector list of simple selectors (``tag``, ``#id``, ``.class``,
    ``[a]``, ``[a="v"]``, ``[a*="v"]``, ``[a^="v"]``, ``[a$="v"]``; comma = OR).
    Values of the ``type`` attribute compare case-insensitively, as in HTML."""
    any_of = F.lit(False)
    for part in (p.strip() for p in selector.split(",")):
        pos, cond = 0, F.lit(True)
        for m in _TOKEN.finditer(part):
            if m.start() != pos:
                raise ValueError(f"unsupported selector: {part!r}")
            pos = m.end()
            if m["tag"]:
                cond = cond & (e["tag"] == F.lit(m["tag"].lower()))
            elif m["id"]:
                cond = cond & F.coalesce(e["el_id"] == F.lit(m["id"]), F.lit(False))
            elif m["cls"]:
                cond = cond & F.array_contains(e["classes"], F.lit(m["cls"]))
            else:
                a, op, v = m["attr"].lower(), m["op"], m["val"]
                col = _attr(e, a)
                if a == "type" and op:
                    col, v = F.lower(col), v.lower()
                if not op:
                    c = F.map_contains_key(e["attrs"], F.lit(a))
                elif op == "=":
                    c = col == F.lit(v)
                elif op == "*=":
                    c = F.contains(col, F.lit(v)) & F.lit(v != "")
                elif op == "^=":
                    c = F.startswith(col, F.lit(v)) & F.lit(v != "")
                else:
                    c = F.endswith(col, F.lit(v)) & F.lit(v != "")
                cond = cond & F.coalesce(c, F.lit(False))
        if pos != len(part) or not part:
            raise ValueError(f"unsupported selector: {part!r}")
        any_of = any_of | cond
    return any_of


def preferred_selector(el_id: Column, el_name: Column, classes: Column, tag: Column) -> Column:
    """``#id`` > ``[name='..']`` > ``.firstclass`` > tag; empty counts as missing."""
    return (F.when(F.coalesce(el_id, F.lit("")) != "", F.concat(F.lit("#"), el_id))
             .when(F.coalesce(el_name, F.lit("")) != "", F.concat(F.lit("[name='"), el_name, F.lit("']")))
             .when(F.size(classes) > 0, F.concat(F.lit("."), F.element_at(classes, 1)))
             .otherwise(tag))


def selector_list(els: Column, slot_rules=rules.SELECTOR_RULES, pay_text: str | None = rules.PAY_BUTTON_TEXT,
                  pay_slot: str = rules.PAY_BUTTON_SLOT) -> Column:
    """ARRAY<STRUCT<slot, selector, ord>> of a page's elements: for each slot the
    first element that matches its rule; slots without a match are absent. A
    button with the pay text overrides the pay slot's rule by its id, else its
    first class, else its tag."""
    def first(pred):
        return F.try_element_at(F.filter(els, pred), F.lit(1))

    def rule(css):
        return lambda e: css_predicate(css, e)

    picks = []
    for slot, css in slot_rules:
        hit = first(rule(css))
        if pay_text is not None and slot == pay_slot:
            pay = first(lambda e: (e["tag"] == "button") & F.contains(F.lower(e["text"]), F.lit(pay_text)))
            by_id = F.coalesce(pay["el_id"], F.lit("")) != ""
            hit = F.when(by_id, first(lambda e: e["el_id"] == pay["el_id"])) \
                .when(F.size(pay["classes"]) > 0, first(lambda e: F.array_contains(
                    e["classes"], F.element_at(pay["classes"], 1)))) \
                .when(pay.isNotNull(), first(lambda e: e["tag"] == "button")).otherwise(hit)
        picks.append(F.when(hit.isNotNull(), F.struct(
            F.lit(slot).alias("slot"),
            preferred_selector(hit["el_id"], hit["el_name"], hit["classes"], hit["tag"]).alias("selector"),
            hit["ord"].alias("ord"))))
    return F.filter(F.array(*picks), lambda x: x.isNotNull())


def page_selectors(parsed: DataFrame, **options) -> DataFrame:
    """(page_id, slot, selector, ord) of parsed pages; narrow."""
    return parsed.select("page_id", F.inline(selector_list(F.col("els"), **options)))


def resolve_selectors(els: DataFrame, slot_rules=rules.SELECTOR_RULES,
                      pay_text: str | None = rules.PAY_BUTTON_TEXT,
                      pay_slot: str = rules.PAY_BUTTON_SLOT) -> DataFrame:
    """``page_selectors`` for an element table."""
    return page_selectors(by_page(els), slot_rules=slot_rules, pay_text=pay_text, pay_slot=pay_slot)


# ---------------------------------------------------------------------------
# E5-E9 inventories and roll-up

def key_sections(els: DataFrame, tags: Sequence[str] = rules.KEY_SECTION_TAGS,
                 class_pattern: str = rules.KEY_SECTION_CLASS,
                 preview: int = rules.KEY_SECTION_PREVIEW) -> DataFrame:
    """Sections: given tags with any class matching the pattern (search)."""
    return (els.where(F.col("tag").isin(list(tags))
                      & F.exists("classes", lambda c: c.rlike(class_pattern)))
               .select("page_id", "ord", "tag", "el_id", "classes",
                       F.substring("text_strip", 1, preview).alias("text_preview")))


def buttons(els: DataFrame) -> DataFrame:
    return els.where(F.col("tag") == "button").select(
        "page_id", "ord", F.col("text_strip").alias("text"), "el_id", "classes", "onclick", "type")


def inputs(els: DataFrame, tags: Sequence[str] = rules.FORM_FIELD_TAGS) -> DataFrame:
    return els.where(F.col("tag").isin(list(tags))).select(
        "page_id", "ord", "type", "el_name", "el_id", "placeholder", "classes")


def _field(e) -> Column:
    return F.struct(e["type"].alias("type"), e["el_name"].alias("name"), e["el_id"].alias("id"),
                    e["placeholder"].alias("placeholder"), e["required"].alias("required"))


def _class(e) -> Column:
    return F.when(F.map_contains_key(e["attrs"], F.lit("class")), e["classes"]).alias("class")


def contains(outer, inner) -> Column:
    """Whether an element (a struct, or the columns of an element table) stands
    inside another one of its page: a range of ords."""
    return (inner["ord"] > outer["ord"]) & (inner["ord"] <= outer["last"])


def container_list(els: Column, container: str = "form",
                   child_tags: Sequence[str] = rules.FORM_FIELD_TAGS) -> Column:
    """ARRAY<STRUCT<id, class, action, method, inputs>>: the container elements
    in order, each with its descendant fields in order."""
    fields = F.filter(els, lambda e: e["tag"].isin(list(child_tags)))
    return F.transform(F.filter(els, lambda e: e["tag"] == container), lambda b: F.struct(
        b["el_id"].alias("id"), _class(b), b["action"].alias("action"), b["method"].alias("method"),
        F.transform(F.filter(fields, lambda f: contains(b, f)), _field).alias("inputs")))


def page_containers(parsed: DataFrame, container: str = "form",
                    child_tags: Sequence[str] = rules.FORM_FIELD_TAGS) -> DataFrame:
    """One row per container: page_id, pos, id, class, action, method, inputs."""
    return parsed.select("page_id", F.posexplode(container_list(F.col("els"), container, child_tags))
                         .alias("pos", "c")).select("page_id", "pos", "c.*")


def containers(els: DataFrame, container: str = "form",
               child_tags: Sequence[str] = rules.FORM_FIELD_TAGS) -> DataFrame:
    """``page_containers`` for an element table."""
    return page_containers(by_page(els), container, child_tags)


def structure_record(els: Column, container: str = "form", child_tags: Sequence[str] = rules.FORM_FIELD_TAGS,
                     section_tags: Sequence[str] = rules.KEY_SECTION_TAGS,
                     section_class: str = rules.KEY_SECTION_CLASS, preview: int = rules.KEY_SECTION_PREVIEW,
                     input_tags: Sequence[str] = rules.FORM_FIELD_TAGS) -> Column:
    """STRUCT<forms, buttons, inputs, interactive_elements, key_sections> of a
    page's elements: containers with their fields (forms by default), buttons,
    page-wide inputs, interactive_elements (always empty) and key sections, with
    the field names of the structure record; an absent attribute is null."""
    buttons_ = F.transform(F.filter(els, lambda e: e["tag"] == "button"), lambda e: F.struct(
        e["text_strip"].alias("text"), e["el_id"].alias("id"), _class(e), e["onclick"].alias("onclick"),
        e["type"].alias("type")))
    inputs_ = F.transform(F.filter(els, lambda e: e["tag"].isin(list(input_tags))), lambda e: F.struct(
        e["type"].alias("type"), e["el_name"].alias("name"), e["el_id"].alias("id"),
        e["placeholder"].alias("placeholder"), _class(e)))
    sections = F.transform(
        F.filter(els, lambda e: e["tag"].isin(list(section_tags))
                 & F.exists(e["classes"], lambda c: c.rlike(section_class))),
        lambda e: F.struct(e["tag"].alias("tag"), e["el_id"].alias("id"), _class(e),
                           F.substring(e["text_strip"], 1, preview).alias("text_preview")))
    return F.struct(container_list(els, container, child_tags).alias("forms"), buttons_.alias("buttons"),
                    inputs_.alias("inputs"), F.array().cast("array<string>").alias("interactive_elements"),
                    sections.alias("key_sections"))


def page_structure(parsed: DataFrame, **options) -> DataFrame:
    """Per page the lists of ``structure_record`` and the record as JSON; every
    page of ``parsed`` has a row. Narrow."""
    made = parsed.select("page_id", structure_record(F.col("els"), **options).alias("r"))
    return made.select("page_id", "r.*", F.to_json("r", {"ignoreNullFields": "false"}).alias("structure_json"))


def structure(els: DataFrame, pages: DataFrame | None = None, **options) -> DataFrame:
    """``page_structure`` for an element table. An element table can't name pages
    without elements; give ``pages`` (page_id) to have their rows, too."""
    grouped = by_page(els)
    if pages is not None:
        grouped = pages.select("page_id").distinct().join(grouped, "page_id", "left") \
            .withColumn("els", F.coalesce("els", F.array()))
    return page_structure(grouped, **options)
