"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the driver tables whole; outputs are flat, every computed
column is aliased, integers are BIGINT and floating results are rounded to
6 decimals so an independent SQL engine can reproduce them exactly
(see :mod:`docmill.plans.oracle`).
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill import rules
from docmill.functions.text import tokens
from docmill.operators import chunking, dictionary, generate, orders, pages, postings, retrieve, scripts
from docmill.plans.corpus import (benchmark_queries, case_queries, chunk_table, contexts, documents, retrieved,
                                  spread, table)
from docmill.session import scratch_path
from docmill.sources import files, kb, packed
from docmill.sources.scratch import written

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the driver queries (not fixed values): the reference's
# e-commerce dictionary never occurs in the driver corpus, so feature/spec
# detection over it uses a dictionary of terms the corpus does contain. The
# default dictionary is exercised by the test-case queries and unit tests.
CORPUS_FEATURES = [
    ("license", ["license", "apache"]),
    ("secret", ["token =", "password"]),
    ("contact", ["@"]),
    ("money", ["$"]),
    ("percent", ["%"]),
]
CORPUS_SPEC_RULES = [
    ("license", [("apache", False)], "Apache license text present"),
    ("license", [("mit license", False)], "MIT license text present"),
    ("license", [("General Public License", True)], "GPL text present"),
    ("secret", [("token =", False)], "Token assignment present"),
    ("money", [("$", True), ("%", True)], "Amounts and percentages present"),
]
# Page slots that exist in the driver pages (the checkout slots are tested
# on a checkout-like fixture page).
PAGE_SLOTS = [
    ("page_title", "title"),
    ("main_heading", "h1"),
    ("ad_block", ".ad"),
    ("nav_link", 'a[href*="/"]'),
    ("first_paragraph", "p"),
    ("footer", "footer"),
]
# Features and templates that the corpus reaches: several per request, both test
# types, labels of every script family. Requests that reach none stay generic.
CASE_KEYWORDS = [
    ("english", [" of the ", " and the "]),
    ("german", [" ist ", " und "]),
    ("french", [" est ", " pour "]),
    ("spanish", [" ción", " para "]),
]
CASE_TEMPLATES = [
    ("english", "positive", "Discount of the English text", "Read the English text", "It's read", ["Open it", "Read it"]),
    ("english", "negative", "Discount of the English text", "Read it twice", "Nothing is new", ["Open it again"]),
    ("german", "positive", "Form of the German text", "Fill in the form", "All fields hold", ["Open", "Fill", "Send"]),
    ("german", "negative", "Form of the German text", "Leave fields empty", "It says so", ["Send"]),
    ("french", "positive", "Shopping cart in French", "Fill the cart", "It is full", ["Add", "Count"]),
    ("spanish", "negative", "Payment in Spanish", "Pay nothing", "Nothing is paid", ["Say \"no\"", "Don't pay"]),
]
CASE_SPECS = [
    ("english", [(" of the ", False)], "English of something"),
    ("english", [("Th", True), ("and", False)], "English with a capital"),
    ("german", [("Ö", True)], "German capital umlaut"),
    ("french", [("é", False)], "French accents"),
    ("spanish", [("ñ", False), ("Ó", True)], "Spanish letters"),
]
# Slot defaults of the families for the driver pages: some slots resolve there
# (PAGE_SLOTS), some don't.
CASE_SLOTS = [
    ("discount", "page_title", "title"),
    ("discount", "ad_block", ".banner"),
    ("discount", "nav_link", "nav a"),
    ("discount", "missing_note", ".note"),
    ("form", "main_heading", "h2"),
    ("form", "first_paragraph", "div"),
    ("form", "missing_form", "form"),
    ("cart", "nav_link", "a"),
    ("cart", "footer", ".end"),
    ("payment", "ad_block", ".ad2"),
    ("payment", "missing_pay", "button"),
    ("generic", "footer", "#footer"),
    ("generic", "missing_any", "*"),
]
CASE_BRANCH_SLOTS = [("discount", "ad_block", "positive"), ("discount", "missing_note", "negative"),
                     ("form", "first_paragraph", "negative")]
# The stored KB of these tables is small.
KB_BUCKETS = 8
EMAIL_CANDIDATE = r"[^\s]+@[^\s]+"

TEST_K = retrieve.TEST_CASE_K


def _long(c):
    return F.col(c).cast("long").alias(c)


def _r6(c):
    return F.round(F.col(c), 6).alias(c)


# ---------------------------------------------------------------------------
# ingestion and chunking

def q_chunks(spark, sf):
    ch = chunk_table(spark, sf)
    return ch.select("doc_id", _long("chunk_index"), _long("start_char"), _long("end_char"), "text")


def _records(spark, sf):
    docs = spread(documents(spark, sf).select("doc_id", "source", "text"))
    return files.document_record(docs)


def q_document_record(spark, sf):
    return _records(spark, sf).select("doc_id", _long("n_chars"), _long("chunk_count"))


def q_document_summary(spark, sf):
    return files.document_summary(_records(spark, sf), "source").select("source", _long("docs"), _long("chunks"))


def q_document_preview(spark, sf):
    return files.document_preview(documents(spark, sf), ["doc_id"])


def _all_files(spark, sf):
    """Documents as .txt uploads plus pages as .html uploads whose content
    type carries a charset (so exact type matching fails and the extension
    decides)."""
    d = files.documents_as_files(documents(spark, sf)).select("filename", "content_type", "content")
    p = table(spark, sf, "pages").select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.lit(".html")).alias("filename"),
        F.lit("text/html; charset=utf-8").alias("content_type"),
        F.encode("html", "UTF-8").alias("content"))
    return d.unionByName(p)


def q_format_dispatch(spark, sf):
    f = _all_files(spark, sf)
    return f.select(F.col("filename").alias("name"),
                    files.format_kind(F.col("content_type"), F.col("filename")).alias("kind"))


def q_ingest_filter(spark, sf):
    f = files.ingest_filter(_all_files(spark, sf))
    return f.select(F.col("filename").alias("name"),
                    files.format_kind(F.col("content_type"), F.col("filename")).alias("kind"),
                    F.octet_length("content").cast("long").alias("bytes"))


def _mixed_files(spark, sf):
    """Documents as text files (every seventh with a damaging byte in front,
    every eleventh as a PDF), pages as html files and event properties as json
    files."""
    d = documents(spark, sf).select("doc_id", F.encode("text", "UTF-8").alias("body"))
    r7, r11 = F.col("doc_id") % 7 == 0, F.col("doc_id") % 11 == 0
    docs = d.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.when(r11, F.lit(".pdf")).otherwise(F.lit(".txt")))
        .alias("filename"),
        F.when(r11, F.lit("application/pdf")).otherwise(F.lit("text/plain")).alias("content_type"),
        F.when(r11, F.concat(F.unhex(F.lit("25504446E2E3CF")), F.col("body")))
        .when(r7, F.concat(F.unhex(F.lit("FF")), F.col("body"))).otherwise(F.col("body")).alias("content"))
    pages_ = table(spark, sf, "pages").select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.lit(".html")).alias("filename"),
        F.lit("text/html; charset=utf-8").alias("content_type"), F.encode("html", "UTF-8").alias("content"))
    events = table(spark, sf, "events").select(
        F.concat(F.lit("event-"), F.col("event_id").cast("string"), F.lit(".json")).alias("filename"),
        F.lit(None).cast("string").alias("content_type"), F.encode("props", "UTF-8").alias("content"))
    return spread(docs).unionByName(spread(pages_)).unionByName(spread(events))


def q_ingest_quarantine(spark, sf):
    out = files.extract_text(_mixed_files(spark, sf), mode="quarantine")
    return out.select(F.col("filename").alias("name"), "kind", "ok", "error_code",
                      F.length("text").cast("long").alias("n_chars"))


def q_packed_ingest(spark, sf):
    """The mixed files packed into tar archives (one a shuffle partition), read back
    through the archive source and extracted; kinds come from the extensions alone."""
    path = scratch_path(spark, "archives")
    packed.write_packed(_mixed_files(spark, sf), path, int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = files.extract_text(packed.read_packed(spark, path), mode="quarantine")
    return out.select(F.col("filename").alias("name"), "kind", "ok", "error_code",
                      F.length("text").cast("long").alias("n_chars"))


def q_ingest_metrics(spark, sf):
    """What the ingest of mixed files counted while it wrote its table."""
    path = scratch_path(spark, "ingested")
    counts = files.write_extracted(_mixed_files(spark, sf), path)
    return spark.createDataFrame(sorted(counts.items()), "metric string, value long")


def q_ingest_chunks(spark, sf):
    """Mixed files to chunks: dispatch, extract, chunk."""
    good = files.extract_text(_mixed_files(spark, sf), mode="quarantine").where("ok")
    from docmill.operators.chunking import chunk
    ch = chunk(good.select("filename", "kind", "text"))
    return ch.select(F.col("filename").alias("name"), "kind", _long("chunk_index"), _long("start_char"),
                     _long("end_char"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def q_json_normalize(spark, sf):
    ev = spread(table(spark, sf, "events").select("event_id", "props"))
    return ev.select("event_id", files.json_normalize(F.col("props")).alias("text"))


def q_page_text(spark, sf):
    return pages.page_text(spread(table(spark, sf, "pages")))


def q_assemble_parts(spark, sf):
    return files.assemble_parts(table(spark, sf, "conversations"), "conv_id", "turn")


def _kb_rows(spark, sf):
    return kb.kb_rows(chunk_table(spark, sf))


def _stored_kb(spark, sf):
    """The KB of ``documents``, built in a fresh shared folder and opened again."""
    root = scratch_path(spark, "kb")
    kb.build(_kb_rows(spark, sf), root, buckets=KB_BUCKETS)
    return kb.open_kb(spark, root)


def _kb_columns(rows):
    return rows.select("chunk_id", "source", "content_type", _long("chunk_index"), _long("start_char"),
                       _long("end_char"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def q_kb_build(spark, sf):
    return _kb_columns(_stored_kb(spark, sf))


def q_kb_upsert(spark, sf):
    """The stored KB after every fifth document was sent again, shorter, and a
    document was added for every seventh."""
    root = scratch_path(spark, "kb")
    kb.build(_kb_rows(spark, sf), root, buckets=KB_BUCKETS)
    docs = documents(spark, sf).select("doc_id")
    sent = docs.where("doc_id % 5 = 0").unionByName(docs.where("doc_id % 7 = 0").select(
        (F.col("doc_id") + 1_000_000_000).alias("doc_id")))
    text = F.concat(F.lit("Document "), F.col("doc_id").cast("string"), F.lit(" was withdrawn."))
    named = sent.select("doc_id", text.alias("text"), files.document_name(F.col("doc_id")).alias("filename"),
                        F.lit("text/plain").alias("content_type"))
    kb.append(kb.kb_rows(chunking.chunk(named)), root)
    return _kb_columns(kb.open_kb(spark, root))


def q_kb_lifecycle(spark, sf):
    """Chunks and sources of a KB at each step of its life: not there yet, built,
    replaced by the documents of even id, cleared, sent again."""
    root = scratch_path(spark, "kb")
    rows = _kb_rows(spark, sf)
    even = kb.kb_rows(chunk_table(spark, sf).where("doc_id % 2 = 0"))
    steps = [("0 missing", lambda: None), ("1 built", lambda: kb.build(rows, root, buckets=KB_BUCKETS)),
             ("2 replaced", lambda: kb.build(even, root, buckets=KB_BUCKETS)), ("3 cleared", lambda: kb.clear(spark, root)),
             ("4 sent again", lambda: kb.append(even, root, buckets=KB_BUCKETS))]
    seen = []
    for name, change in steps:
        change()
        seen.append(written(kb.open_kb(spark, root).agg(
            F.count(F.lit(1)).alias("chunks"), F.countDistinct("source").alias("sources"))
            .select(F.lit(name).alias("step"), "chunks", "sources"), "kb-step"))
    return functools.reduce(DataFrame.unionByName, seen)


def q_kb_summary(spark, sf):
    return kb.summary(_kb_rows(spark, sf)).select("source", _long("chunks"))


def q_kb_retrieve(spark, sf):
    """Requests answered from the stored KB: its chunk ids, sources and texts."""
    top = retrieve.lexical_topk(case_queries(spark, sf), _stored_kb(spark, sf), k=retrieve.DEFAULT_K,
                                q_keys=["item_id"], q_text="query", c_keys=["source", "chunk_index"],
                                carry=["chunk_id", "text"])
    return top.select("item_id", _long("rank"), "chunk_id", "source", _r6("distance"),
                      F.md5(F.col("text").cast("binary")).alias("text_md5"))


def q_kb_sources(spark, sf):
    return kb.sources(_kb_rows(spark, sf))


# ---------------------------------------------------------------------------
# retrieval and context

def q_retrieve_lexical(spark, sf):
    top = retrieved(spark, sf, retrieve.DEFAULT_K, carry=())
    return top.select("item_id", _long("rank"), "doc_id", _long("chunk_index"), _r6("distance"))


def q_retrieve_indexed(spark, sf):
    """The same from the block-max index, both sides as tables."""
    index = postings.lexical_index(chunk_table(spark, sf))
    top = postings.search(benchmark_queries(spark, sf), index, retrieve.DEFAULT_K, ["item_id"], "query")
    return top.select("item_id", _long("rank"), "doc_id", _long("chunk_index"), _r6("distance"))


def _vectors(spark, sf):
    emb = table(spark, sf, "embeddings")
    corpus = emb.select(F.col("vec_id").alias("cid"), F.col("embedding").alias("vec"))
    queries = retrieve.label_centroids(emb)
    return queries, corpus


def q_retrieve_dense(spark, sf):
    queries, corpus = _vectors(spark, sf)
    top = retrieve.dense_topk(queries, corpus, k=retrieve.DEFAULT_K)
    return top.select("qid", _long("rank"), "cid", _r6("distance"))


def _ann(spark, sf):
    """The vectors whose id is divisible by 100, asked against the index of all."""
    emb = table(spark, sf, "embeddings")
    corpus = emb.select(F.col("vec_id").alias("cid"), F.col("embedding").alias("vec"), "label")
    asked = emb.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"))
    return asked, corpus


def q_retrieve_ann(spark, sf):
    """Certified search: cells that may hold a nearer vector are probed, too."""
    found, _ = retrieve.ivf_topk(*_ann(spark, sf), k=retrieve.DEFAULT_K, carry=["label"], certified=True)
    return found.select("qid", _long("rank"), "cid", _long("label"), F.abs("distance").alias("distance"))


def q_ann_recall(spark, sf):
    """Per query the nearest vector found; whether recall over all queries is
    0.9 or more."""
    asked, corpus = _ann(spark, sf)
    approx, _ = retrieve.ivf_topk(asked, corpus, k=retrieve.DEFAULT_K)
    exact = retrieve.dense_topk(asked, corpus, k=retrieve.DEFAULT_K)
    approx = written(approx, "approx")
    hits = exact.join(approx.select("qid", "cid", F.lit(1).alias("h")), ["qid", "cid"], "left") \
        .agg((F.count("h") >= 0.9 * F.count(F.lit(1))).alias("recall_ok"))
    return approx.where("rank = 1").crossJoin(F.broadcast(hits)).select(  # one row
        "qid", F.col("cid").alias("best_cid"), F.abs("distance").alias("distance"), "recall_ok")


def letter_model():
    """Loads an encoder without weights for the encoder contract: how often each
    of the letters a-z occurs, in either case."""
    import numpy as np
    pairs = [(c, c.upper()) for c in LETTERS]
    return lambda texts: np.array([[t.count(a) + t.count(b) for a, b in pairs] for t in texts], dtype=np.float32)


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def q_retrieve_encoded(spark, sf):
    """Items and chunks through the encoder contract, then exact dense retrieval
    with the chunks' sources and texts."""
    from docmill.operators.encode import encode_with
    key = (F.col("doc_id") * 1_000_000 + F.col("chunk_index")).alias("cid")
    chunks = chunk_table(spark, sf).select(key, "filename", "text")
    corpus = encode_with(chunks, ["cid", "filename", "text"], "text", letter_model, dim=len(LETTERS))
    asked = encode_with(benchmark_queries(spark, sf), ["item_id"], "query", letter_model, dim=len(LETTERS))
    top = retrieve.dense_topk(asked.select(F.col("item_id").alias("qid"), F.col("embedding").alias("vec")),
                              corpus.withColumnRenamed("embedding", "vec"), carry=["filename", "text"])
    return top.select(F.col("qid").alias("item_id"), _long("rank"), F.col("filename").alias("source"), "distance",
                      F.md5(F.col("text").cast("binary")).alias("text_md5"))


def q_context(spark, sf):
    return contexts(spark, sf, retrieve.DEFAULT_K).select("item_id", "context")


def q_cited_sources(spark, sf):
    ctx = contexts(spark, sf, retrieve.DEFAULT_K)
    return ctx.select("item_id", F.array_join(generate.cited_sources(F.col("context")), ", ").alias("sources"))


# ---------------------------------------------------------------------------
# feature / rule detection and test cases

def q_feature_detect(spark, sf):
    docs = spread(documents(spark, sf).select("doc_id", "text"))
    return generate.feature_rows(docs, ["doc_id"], ["text"], CORPUS_FEATURES) \
                   .select("doc_id", _long("feature_ord"), "feature")


def q_keyword_table(spark, sf):
    """Words of the benchmark, as a keyword table, found in the documents."""
    words = F.explode(F.array_distinct(tokens("text"))).alias("keyword")
    keywords = table(spark, sf, "benchmark").select(words).where(F.length("keyword") >= 6).distinct() \
        .withColumn("cased", F.lit(False))
    docs = spread(documents(spark, sf).select("doc_id", "text"))
    hits = dictionary.keyword_hits(docs, keywords, ["doc_id"])
    return hits.groupBy(F.col("needle").alias("keyword")).agg(F.count(F.lit(1)).alias("docs"),
                                                              F.min("doc_id").alias("first_doc"))


def q_spec_rules(spark, sf):
    docs = spread(documents(spark, sf).select("doc_id", "text"))
    feats = docs.select("doc_id", "text", F.inline(generate.detected_features([F.col("text")], CORPUS_FEATURES)))
    specs = generate.spec_list(F.col("feature"), F.col("text"), CORPUS_SPEC_RULES)
    return feats.select("doc_id", "feature", F.array_join(specs, " | ").alias("specs"),
                        F.size(specs).cast("long").alias("n_specs"))


def q_feature_map(spark, sf):
    q = case_queries(spark, sf)
    out = generate.feature_map(q, contexts(spark, sf, TEST_K, q), ["item_id"], keywords=CASE_KEYWORDS,
                               spec_rules=CASE_SPECS)
    return out.select("item_id", _long("feature_ord"), "feature", F.array_join("source_docs", ", ").alias("source_docs"),
                      F.array_join("specifications", " | ").alias("specifications"))


def _test_cases(spark, sf):
    q = case_queries(spark, sf)
    return generate.test_cases(q, contexts(spark, sf, TEST_K, q), ["item_id"], keywords=CASE_KEYWORDS,
                               templates=CASE_TEMPLATES)


def q_test_cases_default(spark, sf):
    """The default dictionary, which the corpus never reaches (generic rows)."""
    return _flat_cases(generate.test_cases(benchmark_queries(spark, sf), contexts(spark, sf, TEST_K), ["item_id"]))


def _flat_cases(cases):
    return cases.select("item_id", "test_id", "feature", "test_scenario", "expected_result", "grounded_in",
                        "test_type", F.array_join("steps", "\n").alias("steps"))


def q_test_cases(spark, sf):
    return _flat_cases(_test_cases(spark, sf))


def q_case_steps(spark, sf):
    return generate.case_steps(_test_cases(spark, sf), ["item_id"]).select(
        "item_id", "test_id", _long("step_no"), "step")


def q_case_labels(spark, sf):
    return generate.case_labels(_test_cases(spark, sf), ["item_id"])


def _model_outputs(spark, sf):
    """Model-style responses derived from ``part`` rows, keyed by p_partkey
    (shared key space with the requests): fenced JSON lists, bare objects,
    single-line fences, steps that aren't a list, empty lists, and output that is
    not strict JSON (trailing text, single quotes, refusals)."""
    p = spread(table(spark, sf, "part"))
    steps = F.array(F.col("p_name"), F.col("p_type"))

    def case(steps_):
        return F.struct(F.format_string("TC-%03d", F.col("p_size")).alias("test_id"),
                        F.col("p_brand").alias("feature"), F.col("p_name").alias("test_scenario"),
                        F.lit("As documented").alias("expected_result"), F.col("p_type").alias("grounded_in"),
                        F.lit("positive").alias("test_type"), steps_.alias("steps"))

    obj, one = F.to_json(case(steps)), F.to_json(case(F.col("p_name")))
    both = F.to_json(F.array(case(steps), case(steps)))
    r = F.col("p_partkey") % 5
    text = (F.when(F.col("p_type") == "ECONOMY", F.concat(F.lit("```json\n"), both, F.lit("\n```")))
             .when(F.col("p_type") == "SMALL", F.concat(F.lit("  "), obj, F.lit("\n")))
             .when(F.col("p_type") == "PROMO", F.concat(F.lit("```"), obj, F.lit("```")))
             .when(r == 0, F.concat(both, F.lit(" Hope this helps!")))
             .when(r == 1, F.translate(obj, '"', "'"))
             .when(r == 2, F.lit("[]"))
             .when(r == 3, one)
             .otherwise(F.concat(F.lit("Sorry, cannot help with "), F.col("p_name"))))
    return p.select(F.col("p_partkey").alias("item_id"), text.alias("text"))


def q_parse_responses(spark, sf):
    parsed = generate.parse_responses(_model_outputs(spark, sf), ["item_id"])
    return parsed.select("item_id", _long("pos"), *generate.CASE_COLUMNS[:-1],
                         F.array_join("steps", "\n").alias("steps"), _long("n_steps"), "bad")


def q_response_extras(spark, sf):
    """Fields beyond the case columns in responses derived from ``part``: a number in
    the first case, an object with a list in the second; every seventh response has
    text after its JSON."""
    p = spread(table(spark, sf, "part"))
    named = F.col("p_name").alias("feature")
    first = F.to_json(F.struct(named, F.col("p_size").alias("priority")))
    second = F.to_json(F.struct(named, F.struct(F.col("p_type").alias("type"), F.array("p_brand").alias("tags")).alias("meta")))
    text = F.concat(F.lit("```json\n["), first, F.lit(", "), second, F.lit("]"),
                    F.when(F.col("p_partkey") % 7 == 0, " Done!").otherwise("\n```"))
    found = generate.extra_fields(p.select(F.col("p_partkey").alias("item_id"), text.alias("text")), ["item_id"])
    return found.select("item_id", _long("pos"), "field", "value")


def q_generator_choice(spark, sf):
    rule_cases = _test_cases(spark, sf)
    # outputs of the requests, written once: they are parsed for both sides of the choice
    outputs = _model_outputs(spark, sf).join(benchmark_queries(spark, sf).select("item_id"), "item_id", "left_semi")
    model = generate.parse_responses(written(outputs, "outputs"), ["item_id"])
    chosen = generate.generator_choice(rule_cases, model, ["item_id"])
    return chosen.select("item_id", "origin", *generate.CASE_COLUMNS[:-1], F.array_join("steps", "\n").alias("steps"))


def q_case_lookup(spark, sf):
    """The second case of each request that has one."""
    return _flat_cases(generate.case_at(_test_cases(spark, sf), ["item_id"], 1))


def q_prompts(spark, sf):
    ctx = contexts(spark, sf, TEST_K)
    q = benchmark_queries(spark, sf).join(ctx, "item_id")
    prompt = generate.test_case_prompt(F.col("query"), F.col("context"))
    return q.select("item_id", F.md5(prompt).alias("prompt_md5"), F.length(prompt).cast("long").alias("prompt_chars"))


def q_grounding_check(spark, sf):
    cases = _test_cases(spark, sf)
    srcs = kb.sources(_kb_rows(spark, sf))
    return generate.grounding_check(cases, srcs, ["item_id"]).select(
        "item_id", "test_id", _long("n_cited"), _long("n_missing"))


def q_coverage_matrix(spark, sf):
    m = generate.coverage_matrix(_test_cases(spark, sf))
    return m.select("feature", *[_long(c) for c in generate.COVERAGE_TYPES])


def q_status_counts(spark, sf):
    # documents and chunks from one scan: the chunk count has a closed form
    docs = _records(spark, sf).agg(F.count(F.lit(1)).alias("d"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("n")) \
        .select(F.inline(F.array(
            F.struct(F.lit("documents_uploaded").alias("metric"), F.col("d").alias("v")),
            F.struct(F.lit("kb_ready").alias("metric"), (F.col("n") > 0).cast("long").alias("v")),
            F.struct(F.lit("kb_chunks").alias("metric"), F.col("n").cast("long").alias("v")))))
    cases = _test_cases(spark, sf).agg(F.count(F.lit(1)).alias("v")).select(F.lit("cases_generated").alias("metric"), "v")
    html = table(spark, sf, "pages").agg(F.count(F.lit(1)).alias("v")).select(F.lit("html_loaded").alias("metric"), "v")
    out = docs.unionByName(cases).unionByName(html)
    return out.select("metric", F.col("v").cast("long").alias("value"))


# ---------------------------------------------------------------------------
# pages

def _parsed(spark, sf, columns=None, text_tags=None):
    return pages.parse_pages(spread(table(spark, sf, "pages")), columns=columns, text_tags=text_tags)


def _form_pages(spark, sf):
    """The pages with a form, a button outside of it and a textarea at the end."""
    pid = F.col("page_id").cast("string")
    form = F.concat(F.lit('<form id="f'), pid, F.lit('" class="big x" action="/go"><input type="text" name="n'), pid,
                    F.lit('" required><div class="wide"><select id="s"><option>a</select></div>'
                          '<button class="b ok" type="submit">Pay now '), pid,
                    F.lit(' </button></form><textarea placeholder="say"></textarea>'
                          '<button id="last" onclick="go()"> Stop </button>'))
    p = spread(table(spark, sf, "pages").select("page_id", "html"))
    return p.select("page_id", F.concat("html", form).alias("html"))


def q_page_elements(spark, sf):
    els = pages.elements(spread(table(spark, sf, "pages")), columns=["ord", "tag"])
    return els.select("page_id", _long("ord"), "tag")


def q_tag_counts(spark, sf):
    els = pages.elements(spread(table(spark, sf, "pages")), columns=["tag"])
    return pages.tag_counts(els).select("tag", _long("n"))


SELECTOR_COLUMNS = ["ord", "tag", "el_id", "el_name", "classes", "attrs"]


def q_page_selectors(spark, sf):
    sel = pages.page_selectors(_parsed(spark, sf, SELECTOR_COLUMNS), slot_rules=PAGE_SLOTS, pay_text=None)
    return sel.select("page_id", "slot", "selector")


def q_pay_button(spark, sf):
    """The pay slot on the form pages: the button that says so."""
    parsed = pages.parse_pages(_form_pages(spark, sf), columns=SELECTOR_COLUMNS + ["text"], text_tags=["button"])
    slots = [("pay_button", "#last"), ("form", "form"), ("choice", "select")]
    return pages.page_selectors(parsed, slot_rules=slots).select("page_id", "slot", "selector")


def q_page_sections(spark, sf):
    els = pages.elements(spread(table(spark, sf, "pages")), columns=["ord", "tag", "el_id", "classes", "text_strip"],
                         text_tags=["div", "section"])
    sec = pages.key_sections(els, ["div", "section"], "ad")
    return sec.select("page_id", "tag", F.array_join("classes", " ").alias("classes"), "text_preview")


def q_page_forms(spark, sf):
    parsed = _parsed(spark, sf, text_tags=[])
    return pages.page_containers(parsed, "nav", ["a"]).select("page_id", F.size("inputs").cast("long").alias("n_fields"))


def q_page_buttons(spark, sf):
    els = pages.elements(_form_pages(spark, sf), text_tags=["button"])
    return pages.buttons(els).select("page_id", "text", "el_id", F.array_join("classes", " ").alias("classes"),
                                     "onclick", "type")


def q_page_inputs(spark, sf):
    els = pages.elements(_form_pages(spark, sf), text_tags=[])
    return pages.inputs(els).select("page_id", "type", "el_name", "el_id", "placeholder")


def q_page_structure(spark, sf):
    """Structure records of the form pages, counts and JSON."""
    parsed = pages.parse_pages(_form_pages(spark, sf), text_tags=["button", "div", "section"])
    st = pages.page_structure(parsed, section_tags=["div", "section"], section_class="wide")
    n_fields = F.aggregate(F.transform("forms", lambda f: F.size(f["inputs"])), F.lit(0), lambda a, b: a + b)
    return st.select("page_id", F.size("forms").cast("long").alias("n_forms"),
                     n_fields.cast("long").alias("n_fields"),
                     F.size("buttons").cast("long").alias("n_buttons"),
                     F.size("inputs").cast("long").alias("n_inputs"),
                     F.size("key_sections").cast("long").alias("n_sections"), "structure_json")


# ---------------------------------------------------------------------------
# script plans

def q_case_context(spark, sf):
    # the cases are a query set and joined again: written once
    cases = written(_test_cases(spark, sf), "cases")
    return scripts.case_context(cases, chunk_table(spark, sf), ["item_id"], source_col="filename")


def q_script_route(spark, sf):
    return scripts.script_route(_test_cases(spark, sf), ["item_id"])


def _page_slots(spark, sf):
    parsed = _parsed(spark, sf, SELECTOR_COLUMNS)
    return parsed.select("page_id", pages.selector_list(F.col("els"), PAGE_SLOTS, None).alias("slots"))


def q_script_plan(spark, sf):
    plan = scripts.script_plan(_page_slots(spark, sf), CASE_SLOTS)
    return plan.select("page_id", "family", "slot", "selector", "resolved")


def q_case_slots(spark, sf):
    """Slot plan of each request's cases on the page of the same number."""
    cases = _test_cases(spark, sf).join(_page_slots(spark, sf).withColumnRenamed("page_id", "item_id"), "item_id")
    out = scripts.case_slots(cases, CASE_SLOTS, CASE_BRANCH_SLOTS)
    return out.select("item_id", "test_id", "family", "branch", _long("slot_no"), "slot", "selector", "resolved")


def q_script_prompts(spark, sf):
    """Per page: the page title is the request; its test cases (rules, k=8)
    become prompts with that page's selectors, structure and case context."""
    # one parse per page: request, selectors and structure of each page in one
    # narrow row, written once (as are the cases: a query set and joined again)
    parsed = _parsed(spark, sf, text_tags=["title", "button", *rules.KEY_SECTION_TAGS])
    title = F.try_element_at(F.filter("els", lambda e: e["tag"] == "title"), F.lit(1))["text_strip"]
    ctx_of_page = scripts.page_context(parsed, extra={"query": title})
    page_ctx = written(ctx_of_page, "pages")
    titles = page_ctx.where("query is not null").select("page_id", "query")
    chunks = chunk_table(spark, sf)
    top = retrieve.lexical_topk(titles, chunks, k=TEST_K, q_keys=["page_id"], q_text="query",
                                carry=["filename", "text"])
    ctx = generate.assemble_context(top, ["page_id"], source_col="filename")
    # a page without a title is a request without text
    asked = page_ctx.select("page_id", F.coalesce("query", F.lit("")).alias("query"))
    cases = written(generate.test_cases(asked, ctx, ["page_id"]), "cases")
    case_ctx = scripts.case_context(cases, chunks, ["page_id"], source_col="filename")
    req = cases.join(case_ctx, ["page_id", "test_id"], "left")
    out = scripts.script_prompts(req, page_ctx.drop("query"))
    return out.select("page_id", "test_id", F.md5("prompt").alias("prompt_md5"),
                      F.length("prompt").cast("long").alias("prompt_chars"))


def _assistant_turns(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", "text")


def q_clean_fences(spark, sf):
    c = _assistant_turns(spark, sf)
    return c.select("conv_id", "turn", scripts.clean_fences(F.col("text")).alias("text"))


def q_component_check(spark, sf):
    c = _assistant_turns(spark, sf)
    miss = scripts.missing_components(scripts.clean_fences(F.col("text")))
    return c.select("conv_id", "turn", F.array_join(miss, ", ").alias("missing"),
                    (F.size(miss) == 0).alias("valid"))


SCRIPT_HEAD = "import time\nfrom selenium import webdriver\nclass TestIt:\n  def setup(self): pass\n  def teardown(self): pass\n"
SCRIPT_TAIL = "\n  def test_it(self): pass\nif __name__ == \"__main__\": pass"


def _model_scripts(spark, sf):
    """Assistant turns as candidate scripts: turns of every third conversation
    stand as a comment in a complete fenced script, the others as they are."""
    c = table(spark, sf, "conversations").where(F.col("role") == "assistant")
    text = F.concat(F.lit("```python\n" + SCRIPT_HEAD + "  # "), F.replace("text", F.lit("\n"), F.lit(" ")),
                    F.lit(SCRIPT_TAIL + "\n```"))
    return c.select(F.col("conv_id").alias("item_id"), "turn",
                    F.when(F.col("conv_id") % 3 == 0, text).otherwise(F.col("text")).alias("text"))


def q_script_choice(spark, sf):
    """Model scripts (assistant turns keyed by conversation id, the request
    id space shared with benchmark items) vs the rule plan per test case."""
    req = _test_cases(spark, sf).select("item_id", "test_id")
    out = scripts.script_choice(req, _model_scripts(spark, sf), ["item_id"], order_col="turn")
    return out.select("item_id", "test_id", "origin", F.col("valid_candidates").cast("long").alias("valid_candidates"),
                      "script")


def q_export_names(spark, sf):
    out = files.export_names(_test_cases(spark, sf))
    return out.select("item_id", "test_id", "class_name", "file_name")


# ---------------------------------------------------------------------------
# orders

def _order_inputs(spark, sf):
    o = table(spark, sf, "orders")
    code = (F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(" save15 "))
             .when(F.col("o_orderpriority") == "5-LOW", F.lit(""))
             .otherwise(F.lit("INVALID")))
    ship = F.when(F.col("o_orderstatus") == "O", F.lit("express")).otherwise(F.lit("standard"))
    return o, code, ship


def _totals(spark, sf):
    o, code, ship = _order_inputs(spark, sf)
    return orders.order_totals(o, spread(table(spark, sf, "lineitem")), table(spark, sf, "part"), code, ship)


def _total_columns(t):
    return t.select("o_orderkey", _long("n_items"), "code_status", "subtotal", "discount", "shipping", "total")


def q_order_totals(spark, sf):
    return _total_columns(_totals(spark, sf))


def q_order_totals_bucketed(spark, sf):
    """The same totals from tables that were stored by the order key."""
    _, code, ship = _order_inputs(spark, sf)
    o, lines = (orders.store_by_key(table(spark, sf, n), key, scratch_path(spark, n))
                for n, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")))
    return _total_columns(orders.order_totals(o, lines, table(spark, sf, "part"), code, ship))


def _customer_fields(spark, sf):
    """Customers with an email and an address made from their columns; some of
    each are invalid, with white space of JavaScript that ASCII has not."""
    c = table(spark, sf, "customer")
    key = F.col("c_custkey").cast("string")
    r = F.col("c_custkey") % 6
    email = (F.when(r == 0, F.concat(F.lit("c"), key, F.lit("\u00a0@mail.example.com")))
              .when(r == 1, F.concat(F.lit("c"), key, F.lit("@mail")))
              .otherwise(F.concat(F.lit(" c"), key, F.lit("@mail.example.com\ufeff"))))
    address = F.when(r == 2, F.lit("\ufeff \u2003")).otherwise(F.col("c_mktsegment"))
    name = F.when(r == 3, F.lit("\t\u3000")).otherwise(F.col("c_name"))
    return c.select("c_custkey", name.alias("name"), email.alias("email"), address.alias("address"))


def q_order_eligible(spark, sf):
    flags = orders.record_validation(_customer_fields(spark, sf), ["c_custkey"], name=F.col("name"),
                                     email=F.col("email"), address=F.col("address"))
    return orders.order_eligible(_totals(spark, sf), flags).select(
        "o_orderkey", _long("n_items"), "name_ok", "email_ok", "address_ok", "eligible")


def q_record_validation(spark, sf):
    docs = spread(documents(spark, sf).select("doc_id", "text"))
    cand = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(EMAIL_CANDIDATE), 0))
                       .alias("pos", "candidate"))
    return orders.record_validation(cand, ["doc_id", _long("pos"), "candidate"], email=F.col("candidate"))


def q_amount_parse(spark, sf):
    o = table(spark, sf, "orders")
    shown = F.concat(F.lit("Total: $"), F.format_number("o_totalprice", 2))
    return o.select("o_orderkey", shown.alias("amount_text"), orders.parse_amount(shown).alias("amount"))


def q_discount_reconcile(spark, sf):
    return orders.discount_reconcile(_totals(spark, sf))


# ---------------------------------------------------------------------------
# incremental ingest (streaming)

def q_incremental_ingest(spark, sf):
    from docmill.streaming.ingest import run_incremental_ingest
    return _kb_columns(run_incremental_ingest(spark, sf))


def q_versioned_ingest(spark, sf):
    """Documents as a stream of versions into a KB: the second version of each, then
    old first versions and newer third ones, then second ones again."""
    from docmill.streaming.ingest import start_versioned_ingest
    root = scratch_path(spark, "versions")
    docs = documents(spark, sf).select("doc_id", "text")
    short = F.concat(F.lit("Document "), F.col("doc_id").cast("string"), F.lit(" was withdrawn."))
    second = docs.withColumn("version", F.lit(2).cast("long"))
    uploads = [second, docs.where("doc_id % 3 = 0").select("doc_id", F.lit("Old.").alias("text"), F.lit(1).cast("long").alias("version"))
               .unionByName(docs.where("doc_id % 5 = 0").select("doc_id", short.alias("text"), F.lit(3).cast("long").alias("version"))),
               second.where("doc_id % 2 = 0")]
    for upload in uploads:
        upload.write.mode("append").parquet(f"{root}/uploads")
        stream = spark.readStream.schema(second.schema).parquet(f"{root}/uploads")
        start_versioned_ingest(stream, f"{root}/kb", f"{root}/_checkpoint").awaitTermination()
    return _kb_columns(kb.open_kb(spark, f"{root}/kb"))


QUERIES: dict[str, Query] = {
    "chunks": q_chunks,
    "document_record": q_document_record,
    "document_summary": q_document_summary,
    "document_preview": q_document_preview,
    "format_dispatch": q_format_dispatch,
    "ingest_filter": q_ingest_filter,
    "ingest_quarantine": q_ingest_quarantine,
    "packed_ingest": q_packed_ingest,
    "ingest_metrics": q_ingest_metrics,
    "json_normalize": q_json_normalize,
    "page_text": q_page_text,
    "assemble_parts": q_assemble_parts,
    "ingest_chunks": q_ingest_chunks,
    "kb_build": q_kb_build,
    "kb_upsert": q_kb_upsert,
    "kb_lifecycle": q_kb_lifecycle,
    "kb_summary": q_kb_summary,
    "kb_retrieve": q_kb_retrieve,
    "kb_sources": q_kb_sources,
    "retrieve_lexical": q_retrieve_lexical,
    "retrieve_indexed": q_retrieve_indexed,
    "retrieve_dense": q_retrieve_dense,
    "retrieve_encoded": q_retrieve_encoded,
    "retrieve_ann": q_retrieve_ann,
    "ann_recall": q_ann_recall,
    "context": q_context,
    "cited_sources": q_cited_sources,
    "feature_detect": q_feature_detect,
    "keyword_table": q_keyword_table,
    "spec_rules": q_spec_rules,
    "feature_map": q_feature_map,
    "test_cases": q_test_cases,
    "test_cases_default": q_test_cases_default,
    "case_lookup": q_case_lookup,
    "case_steps": q_case_steps,
    "case_labels": q_case_labels,
    "parse_responses": q_parse_responses,
    "response_extras": q_response_extras,
    "generator_choice": q_generator_choice,
    "prompts": q_prompts,
    "grounding_check": q_grounding_check,
    "coverage_matrix": q_coverage_matrix,
    "status_counts": q_status_counts,
    "page_elements": q_page_elements,
    "tag_counts": q_tag_counts,
    "page_selectors": q_page_selectors,
    "pay_button": q_pay_button,
    "page_sections": q_page_sections,
    "page_buttons": q_page_buttons,
    "page_inputs": q_page_inputs,
    "page_forms": q_page_forms,
    "page_structure": q_page_structure,
    "case_context": q_case_context,
    "script_route": q_script_route,
    "script_plan": q_script_plan,
    "case_slots": q_case_slots,
    "script_prompts": q_script_prompts,
    "clean_fences": q_clean_fences,
    "component_check": q_component_check,
    "script_choice": q_script_choice,
    "export_names": q_export_names,
    "order_totals": q_order_totals,
    "order_totals_bucketed": q_order_totals_bucketed,
    "order_eligible": q_order_eligible,
    "record_validation": q_record_validation,
    "amount_parse": q_amount_parse,
    "discount_reconcile": q_discount_reconcile,
    "incremental_ingest": q_incremental_ingest,
    "versioned_ingest": q_versioned_ingest,
}
