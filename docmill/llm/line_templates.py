"""Line dedup by a log-template tree, in DataFrame functions only.

A fixed-depth tree routes every non-blank line by its number of tokens and its
leading tokens (``DEPTH``; a token with a digit, an @ or :// is a variable field and
becomes <*>). Lines of up to ``DEPTH`` tokens have the line itself as their leaf.
In a leaf that ``MIN_DOCS`` documents or more reach, each later place keeps the
tokens that ``MIN_DOCS`` documents have there; other tokens are variable fields. A
line of which ``SIMILARITY`` of the later tokens are kept belongs to the template of
its kept tokens, so a leaf has as many templates as it has families of lines, and
neither an unrelated line nor the order of documents changes them. A template of
``MIN_DOCS`` documents is recurring. So is any long line (``LONG_TOKENS`` tokens or
``LONG_CHARS`` characters) that stands word for word in ``LONG_DOCS`` documents.

Lines of a recurring template are dropped from all documents but the first (least
doc_id), so no template is lost altogether. Blank lines are structure and stay.

One scan writes narrow keys of all lines; leaves and long lines are counted from
them. Only lines of recurring leaves are read again (leaves broadcast within the
checked bound, else a shuffle join that AQE splits) and only their tokens are
exploded; a line's kept tokens are one XOR of hashes, combined map-side. Counts are
joined to a frequent key's lines as written tables: broadcast, or by a join with an
exchange on either side, which AQE splits.

Defined cases: a NULL text stays NULL (0 lines); an empty text is one empty line;
a document that loses all lines keeps an empty text; rows repeated with the same
doc_id and text count as one document and are treated alike; a document without
doc_id comes last; line borders are \\n only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.sizing import maybe_broadcast
from docmill.llm.common import carried, quoted, written

DEPTH, SIMILARITY, MIN_DOCS = 3, 0.6, 10
LONG_TOKENS, LONG_CHARS, LONG_DOCS = 40, 240, 2

#: Blanks between tokens, other than the space.
BLANKS = ("\t", "\x0b", "\x0c", "\r")


def spaced(line: Column) -> Column:
    """``line`` trimmed, its runs of ASCII blanks as one space."""
    odd = F.contains(line, F.lit("  "))
    for blank in BLANKS:
        odd = odd | F.contains(line, F.lit(blank))
    return F.trim(F.when(odd, F.regexp_replace(line, "[ \t\x0B\f\r]+", " ")).otherwise(line))


def masked(token: Column) -> Column:
    return F.when(token.rlike("[0-9@]|://"), "<*>").otherwise(token)


def _row_key(doc_id: str, body: Column) -> list[Column]:
    return [F.xxhash64(F.col(quoted(doc_id)), body).alias("k1"),
            F.xxhash64(F.lit(3), body, F.col(quoted(doc_id))).alias("k2")]


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(k1, k2, d, pos, line, n, leaf) of every non-blank line. Tokens are counted by
    the spaces and only the leading ones are cut off."""
    body = F.col(quoted(text)).cast("string")
    lines = docs.select(*_row_key(doc_id, body), F.col(quoted(doc_id)).alias("d"),
                        F.posexplode(F.split(body, "\n")).alias("pos", "line")) \
        .select("k1", "k2", "d", "pos", spaced(F.col("line")).alias("line")).where(F.col("line") != "")
    n = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    lead = F.transform(F.split(F.substring_index("line", " ", DEPTH), " "), masked)
    leaf = F.when(F.col("n") <= DEPTH, F.xxhash64("line")).otherwise(F.xxhash64("n", lead))
    return lines.withColumn("n", n).withColumn("leaf", leaf)


def _documents_of(rows: DataFrame, *key: str) -> DataFrame:
    """(key..., docs): the number of documents that each key occurs in."""
    return rows.select(*key, "k1", "k2").distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("docs"))


def _kept_tokens(found: DataFrame, min_docs: int, similarity: float) -> DataFrame:
    """(k1, k2, d, pos, g1, g2, g3, need) of the ``found`` lines of recurring leaves
    that are like a template: the leaf and the XOR of the kept tokens."""
    tail = found.select("leaf", "k1", "k2", "d", "pos", F.posexplode(F.slice("t", DEPTH + 1, F.size("t"))).alias("p", "token"))
    kept = _documents_of(tail, "leaf", "p", "token").where(F.col("docs") >= min_docs)
    kept = written(kept.select("leaf", "p", "token", F.xxhash64("p", "token").alias("h1"),
                               F.xxhash64(F.lit(5), "token", "p").alias("h2")), "kept")
    met = tail.join(maybe_broadcast(kept), ["leaf", "p", "token"], "left")
    zero = F.lit(0).cast("long")
    whole = met.groupBy("leaf", "k1", "k2", "pos").agg(
        F.first("d").alias("d"), F.bit_xor(F.coalesce("h1", zero)).alias("g2"), F.bit_xor(F.coalesce("h2", zero)).alias("g3"),
        F.count("h1").alias("fixed"), F.count(F.lit(1)).alias("n"))
    general = whole.where(F.col("fixed") >= F.col("n") * F.lit(similarity))
    short = found.where(F.size("t") <= DEPTH).withColumns({"g2": zero, "g3": zero})
    need = F.lit(min_docs).alias("need")
    return general.select("k1", "k2", "d", "pos", F.col("leaf").alias("g1"), "g2", "g3", need) \
        .unionByName(short.select("k1", "k2", "d", "pos", F.col("leaf").alias("g1"), "g2", "g3", need))


def templates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS,
              similarity: float = SIMILARITY, long_docs: int = LONG_DOCS) -> DataFrame:
    """(k1, k2, d, pos, g1, g2, g3, need): lines that may recur, as the document's key
    and id, the line's place, its template and the documents that make it recurring.
    A long line in a recurring leaf has two rows."""
    lines = _lines(docs, doc_id, text)
    long = (F.col("n") >= LONG_TOKENS) | (F.length("line") >= LONG_CHARS)
    keys = written(lines.select("k1", "k2", "d", "pos", "leaf", F.when(long, F.xxhash64("line")).alias("e1"),
                                F.when(long, F.xxhash64(F.lit(9), "line")).alias("e2")), "keys")
    leaves = written(_documents_of(keys, "leaf").where(F.col("docs") >= min_docs).select("leaf"), "leaves")
    found = lines.join(maybe_broadcast(leaves), "leaf")
    found = written(found.select("leaf", "k1", "k2", "d", "pos", F.when(F.col("n") <= DEPTH, F.split("line", " ")).otherwise(
        F.transform(F.split("line", " "), masked)).alias("t")), "lines")
    whole = keys.where("e1 is not null").select("k1", "k2", "d", "pos", F.col("e1").alias("g1"), F.col("e2").alias("g2"),
                                                F.lit(0).cast("long").alias("g3"), F.lit(long_docs).alias("need"))
    return _kept_tokens(found, min_docs, similarity).unionByName(whole)


def dropped_places(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(k1, k2, places): the sorted line numbers that each document loses."""
    held = written(templates(docs, doc_id, text, **options), "held")
    group = ["g1", "g2", "g3", "need"]
    order = F.struct(F.col("d").isNull().alias("x"), F.col("d"), F.col("k1"), F.col("k2"))
    recurring = held.select(*group, "d", "k1", "k2").distinct().groupBy(*group).agg(
        F.count(F.lit(1)).alias("docs"), F.min(order).alias("first")).where(F.col("docs") >= F.col("need"))
    recurring = written(recurring.select(*group, F.col("first.k1").alias("f1"), F.col("first.k2").alias("f2")),
                        "recurring")
    lost = held.join(maybe_broadcast(recurring), group).where((F.col("k1") != F.col("f1")) | (F.col("k2") != F.col("f2")))
    return lost.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("pos")).alias("places"))


def without(body: Column, places: Column) -> Column:
    """``body`` without the lines at the sorted ``places``, in time linear in its
    lines: the places become one mark per line."""
    lines = F.split(body, "\n")
    before = F.concat(F.array(F.lit(-1)), F.slice(places, 1, F.size(places) - 1))
    marks = F.array_join(F.zip_with(places, before, lambda p, q: F.concat(
        F.repeat(F.lit("0"), p - q - 1), F.lit("1"))), "")
    kept = F.zip_with(lines, F.split(marks, ""), lambda line, mark: F.when(~mark.eqNullSafe(F.lit("1")), line))
    return F.array_join(F.slice(F.array_compact(kept), 1, F.size(lines)), "\n")


def drop_templates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None,
                   **options) -> DataFrame:
    """``keep`` columns (default: all but those named like an output) with the
    text's recurring lines dropped, plus n_lines and n_dropped."""
    keep = carried(docs, ["n_lines", "n_dropped"]) if keep is None else keep
    lost = written(dropped_places(docs, doc_id, text, **options), "lost")
    body = F.col(quoted(text)).cast("string")
    rows = docs.select(F.struct(F.lit(0), *[F.col(quoted(c)) for c in keep]).alias("doc"), body.alias("body"),
                       *_row_key(doc_id, body))
    met = rows.join(maybe_broadcast(lost), ["k1", "k2"], "left")
    text_left = F.when(F.col("places").isNull(), F.col("body")).otherwise(without(F.col("body"), F.col("places")))
    return met.select(
        *[(text_left if c == text else F.col("doc").getField(c)).alias(c) for c in keep],
        F.when(F.col("body").isNull(), 0).otherwise(F.size(F.split("body", "\n"))).cast("long").alias("n_lines"),
        F.when(F.col("places").isNull(), 0).otherwise(F.size("places")).cast("long").alias("n_dropped"))
