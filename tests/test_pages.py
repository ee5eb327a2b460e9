"""Page-structure extraction on a self-written checkout-like page."""

from pyspark.sql import functions as F

from docmill.operators import pages as P
from docmill.operators import scripts as S


def _els(spark, html):
    return P.elements(spark.createDataFrame([(1, html)], "page_id long, html string")).cache()


def test_selector_slots_golden(spark, checkout_html):
    sel = {r.slot: r.selector for r in P.resolve_selectors(_els(spark, checkout_html)).collect()}
    assert sel == {
        "add_to_cart_buttons": ".add-to-cart",
        "discount_input": "#discountCode",
        "apply_discount_btn": "#applyDiscount",   # onclick*="discount" fails on case
        "name_input": "#name",
        "email_input": "#email",
        "address_input": "#address",
        "shipping_options": "#standard",
        "payment_options": "#card",
        "pay_button": "#payNow",
        "total_price": "#total",
        "error_messages": "#discountError",
    }  # cart_items / quantity_inputs only occur inside script text


def test_inventories(spark, checkout_html):
    els = _els(spark, checkout_html)
    assert P.buttons(els).count() == 5
    assert P.inputs(els).count() == 8
    forms = P.containers(els).collect()
    assert len(forms) == 1 and len(forms[0].inputs) == 7
    assert forms[0].id == "checkoutForm"
    secs = [r.classes for r in P.key_sections(els).orderBy("ord").collect()]
    assert secs == [["cart-section"], ["cart-total"], ["form-group"], ["form-group"], ["form-group"],
                    ["payment-section"]]


def test_pay_button_text_override(spark):
    html = ('<button onclick="pay()" class="a">First</button>'
            '<button class="buy big">Pay now please</button><div id="payNow">x</div>')
    sel = {r.slot: r.selector for r in P.resolve_selectors(_els(spark, html)).collect()}
    assert sel["pay_button"] == ".buy"


def test_page_text_rules(spark):
    cases = [("<p>a<br>b</p>", "ab"), ("<script>var t='</p>';</script><p> x  y </p><!-- c -->z", "x y z"),
             ("<p>fish &amp chips &amp; more</p>", "fish & chips & more"), ("<div>unclosed <b>bold", "unclosed bold"),
             ("line1\r\n   line2  \n\n", "line1 line2"), ("<b>a</b>\t<b>c</b>", "a c"),
             ("<b>a</b> \n <b>c</b>", "a c"), ("<pre>a</pre><pre>\t</pre>b", "a\tb"), ("", ""), (None, None),
             ("a\u2028 b \x0b c", "a b c"), ("no tags\u3000 here\u3000", "no tags\u3000 here")]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)], "page_id long, html string")
    got = {r.page_id: r.text for r in P.page_text(df).collect()}
    assert [got[i] for i in range(len(cases))] == [t for _, t in cases]


def test_structure_json_fields(spark, checkout_html):
    els = _els(spark, checkout_html)
    import json
    st = json.loads(P.structure(els).first().structure_json)
    assert list(st) == ["forms", "buttons", "inputs", "interactive_elements", "key_sections"]
    assert st["interactive_elements"] == []
    assert st["forms"][0]["inputs"][0] == {"type": "text", "name": "name", "id": "name", "placeholder": None,
                                           "required": True}
    assert st["buttons"][4]["text"] == "Pay Now"


def test_script_plan_defaults(spark, checkout_html):
    parsed = P.parse_pages(spark.createDataFrame([(1, checkout_html)], "page_id long, html string"))
    slots = parsed.select("page_id", P.selector_list(F.col("els")).alias("slots"))
    plan = {(r.family, r.slot): (r.selector, r.resolved) for r in S.script_plan(slots).collect()}
    assert plan[("form", "pay_button")] == ("#payNow", True)
    assert plan[("cart", "cart_items")] == (".cart-item", False)
    assert plan[("cart", "quantity_inputs")] == ('input[type="number"]', False)


def test_case_slots_by_family_and_branch(spark, checkout_html):
    parsed = P.parse_pages(spark.createDataFrame([(1, checkout_html)], "page_id long, html string"))
    cases = spark.createDataFrame([("TC-001", "Discount Code", "positive"), ("TC-002", "Discount Code", "negative"),
                                   ("TC-003", "Form Validation", "negative"), ("TC-004", "Form Validation", None),
                                   ("TC-005", "Anything", "exploratory")],
                                  "test_id string, feature string, test_type string")
    rows = S.case_slots(cases.crossJoin(parsed.select(P.selector_list(F.col("els")).alias("slots")))).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.test_id, r.slot_no)):
        got.setdefault((r.test_id, r.family, r.branch), []).append(r.slot)
    assert got == {
        ("TC-001", "discount", "positive"): ["discount_input", "apply_discount_btn", "total_price", "add_to_cart_buttons"],
        ("TC-002", "discount", "negative"): ["discount_input", "apply_discount_btn", "add_to_cart_buttons", "error_messages"],
        ("TC-003", "form", "negative"): ["name_input", "email_input", "pay_button", "error_messages"],
        ("TC-004", "form", "positive"): ["name_input", "email_input", "address_input", "pay_button", "error_messages"],
        ("TC-005", "generic", "negative"): ["add_to_cart_buttons", "name_input", "email_input"]}
    assert {(r.slot, r.selector) for r in rows if r.resolved} >= {("discount_input", "#discountCode"), ("pay_button", "#payNow")}


def test_prompt_text(spark):
    from docmill import rules
    steps = ["a", "it's", 'say "x"', "both ' and \"", "back\\slash\n"]
    row = spark.createDataFrame([("TC-001", "F", "S", "E", None, steps, None)],
                                "test_id string, feature string, test_scenario string, expected_result string, "
                                "test_type string, steps array<string>, context string")
    got = row.select(S.script_prompt(F.lit("{sel}"), F.lit("{str}")).alias("p")).first().p
    assert got == rules.SCRIPT_PROMPT.format(test_id="TC-001", feature="F", test_scenario="S", expected_result="E",
                                             test_type="positive", steps=str(steps), selectors="{sel}", structure="{str}",
                                             context="", class_suffix="TC_001")


def test_css_predicate_rejects_unsupported():
    import pytest
    with pytest.raises(ValueError):
        P.css_predicate("div > p")


def test_pages_without_elements_keep_their_row(spark):
    pages = spark.createDataFrame([(1, "<p>x</p>"), (2, "plain text only"), (3, None), (4, "")], "page_id long, html string")
    parsed = P.parse_pages(pages)
    rows = {r.page_id: r for r in P.page_structure(parsed).collect()}
    empty = '{"forms":[],"buttons":[],"inputs":[],"interactive_elements":[],"key_sections":[]}'
    assert {i: r.structure_json for i, r in rows.items()} == {i: empty for i in (1, 2, 3, 4)}
    again = {r.page_id for r in P.structure(P.elements(pages), pages).collect()}
    assert again == {1, 2, 3, 4} and {r.page_id for r in P.structure(P.elements(pages)).collect()} == {1}


def test_narrow_forms_equal_table_forms(spark, checkout_html):
    pages = spark.createDataFrame([(1, checkout_html), (2, "<form id=f><input name=a required><form><input></form>")],
                                  "page_id long, html string")
    parsed, els = P.parse_pages(pages), P.elements(pages)
    key = lambda df: sorted(str(r) for r in df.collect())
    assert key(P.page_selectors(parsed)) == key(P.resolve_selectors(els))
    assert key(P.page_structure(parsed)) == key(P.structure(els))
    assert key(P.page_containers(parsed)) == key(P.containers(els))
    few = P.elements(pages, columns=["ord", "tag", "text"], text_tags=["button"])
    assert few.columns == ["page_id", "ord", "tag", "text"]
    assert all((r.text is None) == (r.tag != "button") for r in few.collect())


def test_one_parse_and_no_exchange_after_it(spark):
    from conftest import plan_text

    from docmill.plans import registry as R
    for q in (R.q_page_structure, R.q_page_forms, R.q_page_selectors, R.q_script_plan):
        plan = plan_text(q(spark, "/root/testdata/sf0.001"))
        tree = plan.split("\n\n")[0]
        # below the parser a one-file scan may be dealt out; nothing is shuffled by key
        assert tree.count("MapInArrow") == 1 and "hashpartitioning" not in plan, q.__name__
        assert "Exchange" not in tree.split("MapInArrow")[0], q.__name__


def test_containment_is_a_range_of_ords(spark):
    """Against lists of ancestors, on random pages with unclosed, void and stray tags."""
    import random

    from docmill.functions import html as H

    class Ancestors(H._Walker):
        def __init__(self):
            super().__init__(True)
            self.above = []

        def _open(self, tag, attrs):
            self.above.append(set(self.stack))
            return super()._open(tag, attrs)

    rng = random.Random(5)
    for _ in range(200):
        html = "".join(rng.choice(["<div>", "</div>", "<form>", "</form>", "<input name=a>", "<p/>", "</b>", "<b>", "x"])
                       for _ in range(rng.randrange(60)))
        w = Ancestors()
        w.feed(html)
        w.finish()
        ords, lasts = H.element_columns(html, ["ord", "last"])
        for inner, above in enumerate(w.above):
            assert {o for o, z in zip(ords, lasts) if o < inner <= z} == above, html


def test_deeply_nested_page_stays_linear(spark):
    depth = 5000
    html = "<div>" * depth + "<form id=outer><input name=a><form id=inner><input name=b></form></form>" + "</div>" * depth \
        + "<form id=open><select name=c>"
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    columns = ["ord", "last", "tag", "el_id", "el_name", "type", "placeholder", "required", "classes", "attrs", "action", "method"]
    parsed = P.parse_pages(df, columns=columns, text_tags=[])
    forms = P.page_containers(parsed).orderBy("pos").collect()
    assert [(f["id"], [i["name"] for i in f["inputs"]]) for f in forms] == [
        ("outer", ["a", "b"]), ("inner", ["b"]), ("open", ["c"])]
    els = P.elements(df, columns=["ord", "last", "tag"], text_tags=[])
    assert els.where("tag = 'div' and ord = 0").first()["last"] == depth + 3
    # structural join over an element table: what stands inside the 2,501st division
    a, b = els.alias("a"), els.alias("b")
    inside = a.join(b, (F.col("a.page_id") == F.col("b.page_id")) & (F.col("b.ord") > F.col("a.ord"))
                    & (F.col("b.ord") <= F.col("a.last"))).where("a.ord = 2500").groupBy("b.tag").count()
    assert dict(map(tuple, inside.collect())) == {"div": depth - 2501, "form": 2, "input": 2}
