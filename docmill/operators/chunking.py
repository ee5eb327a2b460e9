"""Overlapping character chunker (sentence/newline back-off), no UDF.

The rule, quirk included: windows of ``size`` characters follow each other with
``overlap`` characters in common. A window that doesn't reach the end of the text
may be cut after its last '.' or newline. That break's place is counted from the
window's own start, yet it is compared with the middle of the window in the text,
and taken as the cut, as if it were a place in the text. Windows are not clamped
at the end of the text; each chunk is its window's text, stripped.

Because a break's place is at most ``size - 1``, a cut can only move while the
window starts before ``size - 1 - size // 2``, and every step advances by at least
``min(size // 2 + 2 - overlap, size - overlap)``. So only the first ``H``
cuts (H = 2 for 1000/200) can be adaptive; every later chunk is a fixed
window on a regular stride. The rule therefore has a closed form: ``H``
unrolled column expressions for the head cuts, then
``sequence``/``explode`` for the tail. Everything stays inside whole-stage
codegen and is narrow (no shuffle): chunking scales with the scan.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.functions.text import py_strip

DEFAULT_SIZE = 1000
DEFAULT_OVERLAP = 200


def _check(size: int, overlap: int) -> tuple[int, int, int]:
    if size <= 0 or overlap < 0:
        raise ValueError("chunk size must be > 0 and overlap >= 0")
    half = size // 2
    step_min = min(half + 2 - overlap, size - overlap)
    if step_min <= 0:
        # The loop may stall for such parameters; refuse rather than guess.
        raise ValueError(f"overlap {overlap} too large for chunk size {size}")
    limit = size - 1 - half  # a back-off needs start < limit
    heads = 0 if limit <= 0 else math.ceil(limit / step_min)
    return half, heads, size - overlap


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


# Index of the last '.' or newline in window {w}, -1 if none: the greedy
# ``.*`` runs to the end and backs off to the final break, so the match
# length minus one is its position.
_LAST_BREAK = "(length(regexp_extract({w}, '(?s)^(.*[.\\n])', 1)) - 1)"


def _start_sql(h: int, overlap: int, prefix: str) -> str:
    """Start of cut ``h``: 0 for the first, previous end minus overlap after."""
    return "0" if h == 0 else f"({prefix}e{h - 1} - {overlap})"


def with_chunk_plan(df: DataFrame, text_col: str = "text", size: int = DEFAULT_SIZE,
                    overlap: int = DEFAULT_OVERLAP, prefix: str = "_ck_") -> DataFrame:
    """Add ``{prefix}n``, the head cut ends ``{prefix}e{h}`` and
    ``{prefix}count``.

    Each head end (the only regex work) is projected once as its own column;
    starts are cheap arithmetic on the previous end (``s{h+1} = e{h} -
    overlap``) and are written inline. The expressions are given as SQL
    text, so building the plan is a handful of calls into the JVM.
    """
    half, heads, step = _check(size, overlap)
    t, n = _q(text_col), f"{prefix}n"
    out = df.selectExpr("*", f"length({t}) AS {n}")
    for h in range(heads):
        s = _start_sql(h, overlap, prefix)
        bp = _LAST_BREAK.format(w=f"substring({t}, {s} + 1, {size})")
        out = out.selectExpr("*", f"CASE WHEN {s} + {size} < {n} AND {bp} > {s} + {half} "
                                  f"THEN {bp} + 1 ELSE {s} + {size} END AS {prefix}e{h}")
    arms = " ".join(f"WHEN {_start_sql(h, overlap, prefix)} >= {n} THEN {h}" for h in range(1, heads + 1))
    tail = _start_sql(heads, overlap, prefix)
    count = (f"CAST(CASE WHEN {n} <= 0 THEN 0 {arms} "
             f"ELSE {heads + 1} + CAST(floor(({n} - 1 - {tail}) / {step}) AS INT) END AS INT) AS {prefix}count")
    return out.selectExpr("*", count)


def chunk_count(df: DataFrame, text_col: str = "text", size: int = DEFAULT_SIZE,
                overlap: int = DEFAULT_OVERLAP, out_col: str = "chunk_count") -> DataFrame:
    """Number of chunks per row without exploding (narrow projection)."""
    planned = with_chunk_plan(df, text_col, size, overlap)
    keep = [_q(c) for c in df.columns if c != out_col]
    return planned.selectExpr(*keep, f"_ck_count AS {_q(out_col)}")


def chunk(df: DataFrame, text_col: str = "text", size: int = DEFAULT_SIZE,
          overlap: int = DEFAULT_OVERLAP, out_text: str = "text",
          keep_source_text: bool = False) -> DataFrame:
    """One row per chunk: input columns + chunk_index, start_char, end_char, text.

    ``text`` is the stripped chunk (empty-after-strip chunks are kept);
    offsets are pre-strip, ``end_char`` not clamped to the length.
    """
    _, heads, step = _check(size, overlap)
    planned = with_chunk_plan(df, text_col, size, overlap)
    helpers = [c for c in planned.columns if c.startswith("_ck_")]
    planned = planned.selectExpr(
        "*", "explode(CASE WHEN _ck_count > 0 THEN sequence(0, _ck_count - 1) END) AS chunk_index")
    start = " ".join(f"WHEN {h} THEN {_start_sql(h, overlap, '_ck_')}" for h in range(heads))
    end = " ".join(f"WHEN {h} THEN _ck_e{h}" for h in range(heads))
    tail = _start_sql(heads, overlap, "_ck_")
    starts = f"{tail} + (chunk_index - {heads}) * {step}"
    planned = planned.selectExpr(
        "*",
        f"CAST(CASE chunk_index {start} ELSE {starts} END AS INT) AS start_char",
        f"CAST(CASE chunk_index {end} ELSE {starts} + {size} END AS INT) AS end_char")
    keep = [c for c in df.columns if keep_source_text or c != text_col]
    if out_text in keep:
        keep.remove(out_text)
    body = F.expr(f"substring({_q(text_col)}, start_char + 1, end_char - start_char)")
    return planned.select(*keep, "chunk_index", "start_char", "end_char", py_strip(body).alias(out_text))
