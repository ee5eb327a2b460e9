"""The registered queries of the llm operators (digest columns of their real
outputs, over whole tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm import bpe
from docmill.llm import decontaminate as dc
from docmill.llm import jaccard, licences, line_templates, max_sketch, pii, quality, rlz, secret_scan, sharding, spelling
from docmill.llm import token_store as ts
from docmill.llm.common import table, written
from docmill.session import scratch_path


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as directly addressable token ids, written and read back."""
    import public_tokenizers
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        tokenizer = f.read()
    path = scratch_path(spark, "tokens")
    ts.write(documents(spark, sf_dir), tokenizer, 2, path)
    docs = ts.documents_of(ts.segments(spark, path))
    return docs.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_rlz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of repeated 35-word windows."""
    cut = rlz.remove_repeats(documents(spark, sf_dir), keep=["doc_id"])
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its lines of recurring templates."""
    left = line_templates.drop_templates(documents(spark, sf_dir), keep=["doc_id", "text"])
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document and the bytes they decode to."""
    import public_tokenizers
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    back = bpe.round_trip(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN, keep=["doc_id"])
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base spans and those the field adds."""
    docs = documents(spark, sf_dir)
    found = pii.find(docs, pii.train(docs), keep=["doc_id"])
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.span_string(base), 256).alias("base_sha256"),
                        pii.span_string(F.col("spans")).alias("spans"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 24 and of 25, by law ``key``."""
    placed = sharding.shard(documents(spark, sf_dir), sharding.layout(24), sharding.layout(25))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and covered template spans of every document."""
    found = licences.scan(documents(spark, sf_dir), keep=["doc_id"])
    base, spans = F.transform("base", lambda p: p["label"]), F.transform("spans", lambda s: s["label"])
    starts = F.transform("base", lambda p: p["start"])

    def listed(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        listed(base).alias("base_labels"), listed(F.concat(base, spans)).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(
            ":", s["label"], s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of the fertility bands for every document. Measured once:
    the bands are fitted on those rows that are labelled good."""
    import public_tokenizers
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = public_tokenizers.path("piece_bpe_32k.model")
    measured = written(quality.measure(docs, model, keep=["doc_id", "lang"]), "measured")
    bands = quality.fit_bands(docs, table(spark, sf_dir, "labels"), model, measured=measured)
    return quality.judged(measured, F.col("lang"), bands).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_tokens", "chars_per_token", "byte_share", "entropy_share", "entropy_bits", "script")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of every document by the benchmark's 13-word windows."""
    found = dc.contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    hit = dc.n_hit()
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        dc.is_contaminated(hit, F.col("n_words")).alias("contaminated"),
        F.col("hit_spans").cast("string").alias("hit_spans"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, number of links and group of every document."""
    return jaccard.join(documents(spark, sf_dir)).select("doc_id", "class_id", "n_copies", "n_links", "group_id")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: base spans and stretches that look random."""
    found = secret_scan.scan(documents(spark, sf_dir), keep=["doc_id"])
    base = F.filter("spans", lambda s: s["kind"] != "random")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(kind) for kind in secret_scan.BASE_KINDS],
                        F.sha2(pii.span_string(base), 256).alias("base_sha256"),
                        pii.span_string(F.col("spans")).alias("spans"), count("random"))


def op12_max_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of each benchmark item."""
    found = max_sketch.rank(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents; the contract's slip
    (a code point of every 97th run by hash) makes variants of its own."""
    words = spelling.word_counts(documents(spark, sf_dir), slip_every=97)
    return spelling.group(words)


QUERIES = {
    "op10_jaccard_join": op10_jaccard_join,
    "op1_token_store": op1_token_store,
    "op11_secret_scan": op11_secret_scan,
    "op12_max_sketch": op12_max_sketch,
    "op13_spelling": op13_spelling,
    "op2_rlz": op2_rlz,
    "op3_line_templates": op3_line_templates,
    "op4_bpe": op4_bpe,
    "op5_pii": op5_pii,
    "op6_sharding": op6_sharding,
    "op7_licences": op7_licences,
    "op8_quality": op8_quality,
    "op9_decontaminate": op9_decontaminate,
}
