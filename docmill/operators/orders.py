"""Order/checkout analytics: totals with discount code and shipping,
record validation, eligibility, amount parsing and discount reconciliation.

Money is computed in DECIMAL (exact cents) and rounded half-up to 2 places
only for the displayed total.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill import rules
from docmill.functions.sizing import maybe_broadcast
from docmill.functions.text import js_trim, py_strip

MONEY = "decimal(18,2)"


def normalise_code(code: Column) -> Column:
    return F.upper(py_strip(code))


def discount_rate(code: Column, codes=rules.DISCOUNT_CODES) -> Column:
    c = normalise_code(code)
    rate = F.lit(0).cast("decimal(5,4)")
    for name, r in reversed(codes):
        rate = F.when(c == F.lit(name), F.lit(r).cast("decimal(5,4)")).otherwise(rate)
    return rate


def code_status(code: Column, codes=rules.DISCOUNT_CODES) -> Column:
    c = normalise_code(code)
    return (F.when(c.isin([n for n, _ in codes]), F.lit("applied"))
             .when(F.coalesce(c, F.lit("")) == "", F.lit("none"))
             .otherwise(F.lit("invalid")))


def shipping_cost(method: Column, costs=rules.SHIPPING_COSTS) -> Column:
    out = F.lit(0).cast(MONEY)
    for name, cost in reversed(costs):
        out = F.when(method == F.lit(name), F.lit(cost).cast(MONEY)).otherwise(out)
    return out


def store_by_key(df: DataFrame, key: str, path: str, buckets: int = 16, name: str | None = None) -> DataFrame:
    """``df`` as a table at ``path``, bucketed and sorted by ``key``. Tables stored
    with one number of buckets are joined and aggregated by their keys without an
    exchange, in every later query. Choose ``buckets`` so that one is a task's work
    (about 256 MB). ``name`` is the table's name in the catalog (default: from the
    path's last part); drop it there, the files are at ``path``."""
    name = name or re.sub(r"\W", "_", path.rstrip("/").rsplit("/", 1)[-1])
    # a bucket's rows meet before the write, so it is one file, or a few where AQE splits a large one
    df.hint("rebalance", key).write.option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return df.sparkSession.table(name)


def order_lines(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Per order: subtotal = sum(unit price x quantity), item count.

    Part is a dimension: broadcast when its row count passes the check,
    otherwise a shuffle join (AQE splits a hot part key). The per-order sum
    is partially aggregated before its shuffle.
    """
    parts = maybe_broadcast(part.select("p_partkey", "p_retailprice"))
    lines = lineitem.select("l_orderkey", "l_partkey", "l_quantity") \
                    .join(parts, F.col("l_partkey") == F.col("p_partkey"))
    amount = F.col("p_retailprice").cast(MONEY) * F.col("l_quantity").cast(MONEY)
    return lines.groupBy("l_orderkey").agg(F.sum(amount).alias("subtotal"),
                                           F.count(F.lit(1)).alias("n_items"))


def order_totals(orders: DataFrame, lineitem: DataFrame, part: DataFrame,
                 code: Column, shipping: Column) -> DataFrame:
    """o_orderkey, n_items, code_status, subtotal, discount, shipping, total.

    Orders without line items keep subtotal 0 (left join).
    """
    o = orders.select("o_orderkey", "o_custkey", code.alias("code"), shipping.alias("shipping_method"))
    sub = order_lines(lineitem, part)
    j = o.join(sub, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    subtotal = F.coalesce(F.col("subtotal"), F.lit(0).cast(MONEY))
    discount = subtotal * discount_rate(F.col("code"))
    ship = shipping_cost(F.col("shipping_method"))
    total = F.round(subtotal - discount + ship, 2)
    return j.select(
        "o_orderkey", "o_custkey",
        F.coalesce(F.col("n_items"), F.lit(0)).alias("n_items"),
        code_status(F.col("code")).alias("code_status"),
        subtotal.cast("double").alias("subtotal"),
        F.round(discount, 2).cast("double").alias("discount"),
        ship.cast("double").alias("shipping"),
        total.cast("double").alias("total"))


def valid_email(col: Column) -> Column:
    return F.coalesce(js_trim(col).rlike(rules.EMAIL_PATTERN), F.lit(False))


def not_blank(col: Column) -> Column:
    return F.coalesce(js_trim(col) != "", F.lit(False))


def record_validation(df: DataFrame, keys, name: Column | None = None, email: Column | None = None,
                      address: Column | None = None) -> DataFrame:
    """One flag per supplied field: name/address non-blank, email pattern."""
    cols = list(keys)
    if name is not None:
        cols.append(not_blank(name).alias("name_ok"))
    if email is not None:
        cols.append(valid_email(email).alias("email_ok"))
    if address is not None:
        cols.append(not_blank(address).alias("address_ok"))
    return df.select(*cols)


def order_eligible(totals: DataFrame, customer_flags: DataFrame) -> DataFrame:
    """Eligible = at least one cart item and every supplied flag true."""
    flags = [c for c in customer_flags.columns if c.endswith("_ok")]
    j = totals.select("o_orderkey", "o_custkey", "n_items").join(
        customer_flags.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey", "left")
    ok = F.col("n_items") > 0
    for f in flags:
        ok = ok & F.coalesce(F.col(f), F.lit(False))
    return j.select("o_orderkey", "n_items", *flags, ok.alias("eligible"))


def parse_amount(text: Column) -> Column:
    """'Total: $1,234.56' -> 1234.56 (NULL when not a number)."""
    cleaned = F.replace(F.replace(F.replace(text, F.lit("Total:"), F.lit("")), F.lit("$"), F.lit("")),
                        F.lit(","), F.lit(""))
    return py_strip(cleaned).try_cast("double")


def discount_reconcile(totals: DataFrame, rate: float = 0.15,
                       tolerance: float = rules.DISCOUNT_TOLERANCE) -> DataFrame:
    """For orders with an applied code: expected = round(total before
    discount x (1 - rate), 2) vs the observed discounted total."""
    applied = totals.where(F.col("code_status") == "applied")
    before = (F.col("subtotal").cast(MONEY) + F.col("shipping").cast(MONEY))
    expected = F.round(before * F.lit(1 - rate).cast("decimal(5,4)"), 2).cast("double")
    return applied.select("o_orderkey", expected.alias("expected"), F.col("total").alias("observed"),
                          (F.abs(expected - F.col("total")) < tolerance).alias("ok"))
