"""Keyword dictionaries as tables: which keywords of a table each text contains.

The plan doesn't grow with the dictionary, unlike the per-keyword expressions of
:mod:`docmill.operators.generate`, which stay the better form for a few dozen.

Within a checked bound of rows and bytes the keywords become one Aho-Corasick
automaton, broadcast, and a narrow Arrow pass finds all of them in one walk over each
text. Beyond the bound keywords and texts are both tables: a keyword of ``GRAM``
characters or more is looked up by its rarest gram (in the number of keywords that
hold it) among the texts' distinct grams, and verified with ``contains``; the
automaton only holds the shorter ones, of which the alphabet bounds the number.

Matching is on lower-cased texts unless a row says otherwise. Defined cases: NULL and
empty keywords and NULL texts match nothing; a keyword that is in the table twice
counts once per feature.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.sizing import fits
from docmill.sources.scratch import written

#: Bound of the broadcast automaton, and characters of a gram.
MAX_KEYWORDS, MAX_BYTES, GRAM = 500_000, 32 << 20, 4


def keyword_rows(keywords: Sequence) -> list[tuple[int, str, str, bool]]:
    """(feature_ord, feature, keyword, cased) rows of a plan-time dictionary."""
    return [(i, name, kw, False) for i, (name, kws) in enumerate(keywords) for kw in kws]


def _prepared(keywords: DataFrame) -> DataFrame:
    """(needle, cased): the distinct strings to look for."""
    cased = F.coalesce(F.col("cased"), F.lit(False))
    return keywords.where(F.col("keyword").isNotNull() & (F.col("keyword") != "")) \
        .select(F.when(cased, F.col("keyword")).otherwise(F.lower("keyword")).alias("needle"), cased.alias("cased")).distinct()


def _automaton_hits(texts: DataFrame, needles: list[tuple[str, bool]]) -> DataFrame:
    """``texts`` plus ``hits``: the (needle, cased) that its ``_text``/``_low`` contain."""
    shared = texts.sparkSession.sparkContext.broadcast(needles)
    hit = T.StructType([T.StructField("needle", T.StringType()), T.StructField("cased", T.BooleanType())])
    others = [c for c in texts.columns if c not in ("_text", "_low")]
    schema = T.StructType([texts.schema[c] for c in others] + [T.StructField("hits", T.ArrayType(hit))])

    def run(batches):
        import ahocorasick
        machines = []
        for cased in (False, True):
            machine = ahocorasick.Automaton()
            for needle, own in shared.value:
                if own == cased:
                    machine.add_word(needle, needle)
            if len(machine):
                machine.make_automaton()
                machines.append((cased, machine))
        for batch in batches:
            found: list[list] = [[] for _ in range(batch.num_rows)]
            for cased, machine in machines:
                for i, text in enumerate(batch.column("_text" if cased else "_low").to_pylist()):
                    found[i] += [{"needle": n, "cased": cased} for n in sorted({n for _, n in machine.iter(text or "")})]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in others],
                 pa.array(found, pa.list_(pa.struct([("needle", pa.string()), ("cased", pa.bool_())])))], names=schema.names)

    return texts.mapInArrow(run, schema)


def _grams(text: str) -> Column:
    """Distinct grams of a column's characters."""
    body = F.col(text)
    n = F.length(body) - GRAM + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(body, i, F.lit(GRAM))))) \
        .otherwise(F.array().cast("array<string>"))


def _gram_hits(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """(_row, needle, cased) by the needles' rarest grams; texts and needles as tables."""
    grams = needles.select("needle", "cased", F.explode(_grams("needle")).alias("g"))
    counts = grams.groupBy("cased", "g").agg(F.count(F.lit(1)).alias("n"))
    rare = Window.partitionBy("needle", "cased").orderBy("n", "g")
    keys = written(grams.join(counts, ["cased", "g"]).withColumn("_r", F.row_number().over(rare)).where("_r = 1")
                   .select("needle", "cased", "g"), "grams")
    body = F.when(F.col("cased"), F.col("_text")).otherwise(F.col("_low"))
    sides = texts.select("_row", "_text", "_low", F.explode(F.array(F.lit(False), F.lit(True))).alias("cased")) \
        .withColumn("_body", body)
    # only grams that some needle has travel; texts are joined again to verify
    asked = sides.select("_row", "cased", F.explode(_grams("_body")).alias("g"))
    pairs = asked.join(keys, ["cased", "g"]).select("_row", "cased", "needle")
    return pairs.join(sides.select("_row", "cased", "_body"), ["_row", "cased"]) \
        .where(F.contains("_body", "needle")).select("_row", "needle", "cased")


def keyword_hits(df: DataFrame, keywords: DataFrame, keys: Sequence[str], text_col: str = "text",
                 max_keywords: int = MAX_KEYWORDS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(keys..., needle, cased): the distinct keywords(keyword, cased) in each row's text."""
    needles = written(_prepared(keywords), "needles")
    texts = df.select(*keys, F.col(text_col).alias("_text"), F.lower(text_col).alias("_low"))
    if fits(needles, max_keywords, max_bytes):
        rows = [(r["needle"], r["cased"]) for r in needles.collect()]  # within the bound
        return _automaton_hits(texts, rows).select(*keys, F.inline("hits"))
    numbered = written(texts.select(F.monotonically_increasing_id().alias("_row"), *keys, "_text", "_low"), "texts")
    long = F.length("needle") >= GRAM
    found = _gram_hits(numbered, needles.where(long))
    short = [(r["needle"], r["cased"]) for r in needles.where(~long).collect()]  # of up to three characters
    if short:
        found = found.unionByName(_automaton_hits(numbered.select("_row", "_text", "_low"), short).select("_row", F.inline("hits")))
    return found.join(numbered.select("_row", *keys), "_row").select(*keys, "needle", "cased")


def feature_hits(df: DataFrame, keywords: DataFrame, keys: Sequence[str], text_col: str = "text", **bounds) -> DataFrame:
    """(keys..., feature_ord, feature) of the features of which a keyword of
    keywords(feature_ord, feature, keyword, cased) is in the row's text. ``keys`` identify
    a row; rows with equal keys count as one."""
    cased = F.coalesce(F.col("cased"), F.lit(False))
    names = keywords.select(F.when(cased, F.col("keyword")).otherwise(F.lower("keyword")).alias("needle"),
                            cased.alias("cased"), "feature_ord", "feature").distinct()
    hits = keyword_hits(df, keywords, keys, text_col, **bounds)
    return hits.join(names, ["needle", "cased"]).select(*keys, "feature_ord", "feature").distinct()


def spec_hits(df: DataFrame, specs: DataFrame, keys: Sequence[str], text_col: str = "text", **bounds) -> DataFrame:
    """(keys..., spec_id) of specs(spec_id, keyword, cased) whose every keyword is in
    the row's text."""
    cased = F.coalesce(F.col("cased"), F.lit(False))
    needed = specs.where(F.col("keyword").isNotNull()).select(
        "spec_id", F.when(cased, F.col("keyword")).otherwise(F.lower("keyword")).alias("needle"), cased.alias("cased")).distinct()
    sizes = needed.groupBy("spec_id").agg(F.count(F.lit(1)).alias("_need"))
    hits = keyword_hits(df, specs, keys, text_col, **bounds).join(needed, ["needle", "cased"])
    met = hits.groupBy(*keys, "spec_id").agg(F.count(F.lit(1)).alias("_have"))
    return met.join(sizes, "spec_id").where("_have = _need").select(*keys, "spec_id")
