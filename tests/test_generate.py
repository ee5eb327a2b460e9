"""Rule-based generation goldens and model-output handling."""

from pyspark.sql import functions as F

from conftest import plan_text
from docmill.operators import generate as G
from docmill.operators import scripts as S

ALL_SIX = ("[Source: product_specs.md]\nUse code SAVE15 for 15% off; discount applies at checkout. "
           "Add to cart, update quantity. Standard shipping is free, express costs $10. "
           "Payment by credit card or PayPal; the Pay Now button is green. "
           "Validation: required fields show an error in red; email must be valid. Enter name and address.\n")


def _cases(spark, rows):
    """rows: (query_id, query, context or None, chunk_sources)"""
    q = spark.createDataFrame([(r[0], r[1]) for r in rows], "query_id long, query string")
    ctx = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows if r[2] is not None],
                                "query_id long, context string, chunk_sources array<string>")
    return G.test_cases(q, ctx, ["query_id"]).orderBy("query_id", "test_id").collect()


def test_all_six_features_golden(spark):
    out = _cases(spark, [(1, "checkout tests", ALL_SIX, ["product_specs.md"])])
    got = [(r.test_id, r.feature, r.test_type, len(r.steps)) for r in out]
    assert got == [("TC-001", "Discount Code", "positive", 5), ("TC-002", "Discount Code", "negative", 5),
                   ("TC-003", "Shopping Cart", "positive", 4), ("TC-004", "Form Validation", "positive", 4),
                   ("TC-005", "Form Validation", "negative", 3), ("TC-006", "Form Validation", "negative", 3)]
    assert {r.grounded_in for r in out} == {"product_specs.md"}
    assert out[4].test_scenario == "Submit form with invalid email"


def test_only_untemplated_features_gives_generic_row(spark):
    ctx = "[Source: b.md]\nExpress delivery and PayPal for each user.\n"
    out = _cases(spark, [(7, "delivery", ctx, ["b.md", "a.md"])])
    assert len(out) == 1
    r = out[0]
    assert (r.test_id, r.feature, r.test_type) == ("TC-001", "General Functionality", "exploratory")
    assert r.test_scenario == "Test functionality related to: delivery"
    assert r.grounded_in == "b.md, a.md" and len(r.steps) == 4


def test_query_text_alone_triggers_features(spark):
    out = _cases(spark, [(2, "coupon flow", "[Source: x]\nnothing relevant\n", ["x"])])
    assert [r.feature for r in out] == ["Discount Code", "Discount Code"]


def test_empty_retrieval_row(spark):
    out = _cases(spark, [(3, "anything", None, None)])
    assert [(r.test_id, r.test_type, r.grounded_in, r.steps) for r in out] == \
        [("TC-001", "informational", "No source", None)]


def test_spec_rules(spark):
    df = spark.createDataFrame([(1, ALL_SIX)], "id long, text string")
    rows = df.select("id", F.inline(G.detected_features([F.col("text")]))).select(
        "feature", G.spec_list(F.col("feature"), F.lit(ALL_SIX)).alias("s")).collect()
    specs = {r.feature: r.s for r in rows}
    assert specs["discount_code"] == ["SAVE15 code applies 15% discount", "Discount code functionality available"]
    assert specs["shipping"] == ["Express shipping costs $10", "Standard shipping is free"]
    assert specs["form_validation"] == ["Error messages displayed in red", "Required field validation"]
    assert specs["payment"] == ["Pay Now button should be green"]
    assert specs["cart"] == [] and specs["user_details"] == []


def test_cited_sources_truncates_on_bracket(spark):
    df = spark.createDataFrame([("[Source: a]b.md]\nx\n\n[Source: c.md]\ny [Source: c.md]\n",)], "context string")
    assert df.select(G.cited_sources(F.col("context"))).first()[0] == ["a", "c.md"]


def test_parse_model_output(spark):
    rows = [(1, '```json\n[{"test_id": "TC-001", "feature": "F", "steps": ["a", "b"]}]\n```'),
            (2, '  {"test_id": "TC-009", "feature": "G"}  '),
            (3, '```{"test_id": "TC-002"}```'),
            (4, "not json at all"), (5, ""), (6, "[1, 2]")]
    df = spark.createDataFrame(rows, "id long, text string")
    out = {(r.id, r.pos): (r.test_id, r.bad, r.n_steps)
           for r in G.parse_responses(df, ["id"]).collect()}
    assert out[(1, 0)] == ("TC-001", False, 2)
    assert out[(2, 0)][:2] == ("TC-009", False)
    assert out[(3, 0)][:2] == ("TC-002", False)
    assert out[(4, None)][1] and out[(5, None)][1] and out[(6, None)][1]


def test_model_output_is_strict_json_with_all_fields(spark):
    whole = ('[{"test_id": "TC-001", "feature": "F", "test_scenario": "s ] }", "expected_result": "e", '
             '"grounded_in": "a.md", "test_type": "negative", "steps": ["x", "y"]}]')
    rows = [(1, whole), (2, whole + " Hope this helps!"), (3, "[{'test_id': 'T1'}]"), (4, "[]"),
            (5, '{"test_id": "T5", "steps": "one"}'), (6, '{"a": 1}{"b": 2}'), (7, '{"test_id": "x",}'),
            (8, '[{"test_id":"A"} {"test_id":"B"}]'), (9, "{\"test_id\": \"" + "z\\\"" * 30000 + "\"}")]
    df = spark.createDataFrame(rows, "id long, text string")
    out = {r.id: r for r in G.parse_responses(df, ["id"]).collect()}
    assert {i for i, r in out.items() if r.bad} == {2, 3, 6, 7, 8}
    assert [out[1][c] for c in G.CASE_COLUMNS] == ["TC-001", "F", "s ] }", "e", "a.md", "negative", ["x", "y"]]
    assert out[4].pos is None and out[5].steps == ["one"] and len(out[9].test_id) == 60000
    rule = spark.createDataFrame([(i, "TC-001", "R", "s", "e", "g", "positive", ["z"]) for i in (1, 2, 4)],
                                 "id long, " + ", ".join(f"{c} string" for c in G.CASE_COLUMNS[:-1]) + ", steps array<string>")
    chosen = G.generator_choice(rule, G.parse_responses(df.where("id < 5"), ["id"]), ["id"]).collect()
    assert sorted((r.id, r.origin, r.feature, tuple(r.steps)) for r in chosen) == [
        (1, "model", "F", ("x", "y")), (2, "rules", "R", ("z",)), (4, "rules", "R", ("z",))]


def test_extra_fields_are_kept(spark):
    rows = [(1, '```json\n[{"test_id": "A", "risk": {"z": [1, {"b": null}], "a": "x"}}, {"test_id": "B", "n": 1.5}]\n```'),
            (2, ' {"test_id": "C", "priority": "high", "steps": ["s"]} '), (3, '{"x": 1} and more'), (4, '{"x": 1}],[2'),
            (5, "[]"), (6, None), (7, ""), (8, '[{"feature": "F"}]'), (9, '{"x": 1, "x": 2}'), (10, "[1]")]
    df = spark.createDataFrame(rows, "id long, text string")
    assert sorted(tuple(r) for r in G.extra_fields(df, ["id"]).collect()) == [
        (1, 0, "risk", '{"a":"x","z":[1,{"b":null}]}'), (1, 1, "n", "1.5"), (2, 0, "priority", '"high"')]
    assert G.extra_fields(df.where("false"), ["id"]).count() == 0


def test_case_lookup_by_ordinal(spark):
    cases = spark.createDataFrame([(1, "TC-001"), (1, "TC-002"), (2, "TC-001")], "id long, test_id string")
    assert [tuple(r) for r in G.case_at(cases, ["id"], 1).collect()] == [(1, "TC-002")]


def test_clean_fences_and_components(spark):
    rows = [("```python\nimport x\n```",), ("```python\ncode\n```\n",), ("```\n",), ("plain  \n",),
            ("```py",), ('import selenium\nfrom selenium import webdriver\nclass TestA:\n def setup(self): pass\n'
                         ' def teardown(self): pass\n def test_x(self): pass\nif __name__ == "__main__": pass',)]
    df = spark.createDataFrame(rows, "t string")
    got = [r[0] for r in df.select(S.clean_fences(F.col("t"))).collect()]
    assert got == ["import x", "code\n```", "", "plain", "", rows[5][0]]
    miss = df.select(S.missing_components(S.clean_fences(F.col("t")))).collect()
    assert miss[5][0] == [] and "selenium" in miss[0][0]


def test_routing(spark):
    df = spark.createDataFrame([("Discount Code", "negative"), ("Shopping Cart", None), ("Form Validation", "positive"),
                                ("Payment", "weird"), ("General Functionality", "exploratory")], "feature string, t string")
    got = df.select(S.route_family(F.col("feature")), S.branch(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("discount", "negative"), ("cart", "positive"), ("form", "positive"),
                                       ("payment", "negative"), ("generic", "negative")]


def test_script_choice(spark):
    req = spark.createDataFrame([(1, "TC-001"), (2, "TC-001"), (3, "TC-001")], "rid long, test_id string")
    good = ('```python\nimport time\nfrom selenium import webdriver\nclass TestTC_001:\n    def setup(self): pass\n'
            '    def teardown(self): pass\n    def test_main(self): pass\nif __name__ == "__main__":\n    pass\n```')
    model = spark.createDataFrame([(1, good), (1, "nope"), (2, "class Test only"), (2, "")], "rid long, text string")
    out = S.script_choice(req, model, ["rid"]).collect()
    assert {r.rid: (r.origin, r.valid_candidates) for r in out} == {1: ("model", 1), 2: ("template", 0), 3: ("template", 0)}
    scripts = {r.rid: r.script for r in out}
    assert scripts[1].startswith("import time\n") and scripts[1].endswith("pass") and scripts[2] is scripts[3] is None


def test_every_step_on_model_output_runs_on_all_cores(spark, tmp_path):
    from docmill.plans import registry
    for name in ("part", "documents", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    for query in (registry.q_response_extras, registry.q_parse_responses):
        plan = plan_text(query(spark, str(tmp_path)))
        scanned = plan[plan.rindex("Scan parquet"):]
        # nothing but cheap filters on columns stands between the scan and the round robin
        assert "RoundRobinPartitioning" in plan and "from_json" not in scanned.split("Exchange")[0]
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan


def test_extra_fields_of_repeated_and_null_keys(spark):
    rows = [(1, '[{"feature": "a", "x": 1}]'), (1, '[{"feature": "a", "x": 1}] trailing'), (1, '{"x": {"b": 1, "a": [2]}}'),
            (None, '[{"x": 1}]'), (2, '[{"x": 1}, 5]'), (3, "[]"), (4, None), (5, "```json\n[{\"x\": true}]\n```")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = sorted(tuple(r) for r in G.extra_fields(df, ["id"]).collect() if r.id != 2)
    assert got == [(1, 0, "x", "1"), (1, 0, "x", '{"a":[2],"b":1}'), (5, 0, "x", "true")]
