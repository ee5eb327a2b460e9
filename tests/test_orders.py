"""Checkout arithmetic and validation."""

from conftest import plan_text
from pyspark.sql import functions as F

from docmill.operators import orders as O


def test_totals_codes_and_shipping(spark):
    orders = spark.createDataFrame([(1, 10, " save15 ", "express"), (2, 10, "", "standard"), (3, 11, "BAD", "standard"),
                                    (4, 12, "SAVE15", "standard")], "o_orderkey long, o_custkey long, code string, ship string")
    line = spark.createDataFrame([(1, 100, 1.0), (1, 101, 2.0), (2, 100, 3.0), (3, 101, 1.0)],
                                 "l_orderkey long, l_partkey long, l_quantity double")
    part = spark.createDataFrame([(100, 29.99), (101, 49.99)], "p_partkey long, p_retailprice double")
    t = {r.o_orderkey: r for r in O.order_totals(orders, line, part, F.col("code"), F.col("ship")).collect()}
    assert (t[1].subtotal, t[1].code_status, t[1].shipping) == (129.97, "applied", 10.0)
    assert t[1].total == round(129.97 * 0.85 + 10, 2) == 120.47
    assert (t[2].code_status, t[2].total) == ("none", 89.97)
    assert (t[3].code_status, t[3].discount, t[3].total) == ("invalid", 0.0, 49.99)
    assert (t[4].n_items, t[4].subtotal, t[4].total) == (0, 0.0, 0.0)
    rec = {r.o_orderkey: r.ok for r in O.discount_reconcile(O.order_totals(
        orders, line, part, F.col("code"), F.col("ship"))).collect()}
    assert rec == {1: False, 4: True}  # shipping is not discounted, so express orders differ


def test_validation_and_amounts(spark):
    df = spark.createDataFrame([(1, " Ann ", " a@b.co ", "street"), (2, "  ", "a@b", ""), (3, None, "x @y.z", " ")],
                               "id long, name string, email string, address string")
    got = {r.id: (r.name_ok, r.email_ok, r.address_ok) for r in O.record_validation(
        df, ["id"], F.col("name"), F.col("email"), F.col("address")).collect()}
    assert got == {1: (True, True, True), 2: (False, False, False), 3: (False, False, False)}
    odd = spark.createDataFrame([(1, "\ufeff", "a\u00a0b@x.yz"), (2, "\u001c", "\ufeffa@x.yz\u2003"), (3, "x", "a@x.y\u3000z")],
                                "id long, name string, email string")
    flags = {r.id: (r.name_ok, r.email_ok) for r in O.record_validation(odd, ["id"], F.col("name"), F.col("email")).collect()}
    assert flags == {1: (False, False), 2: (True, True), 3: (True, False)}
    amt = spark.createDataFrame([("Total: $1,234.50",), ("$7",), ("n/a",)], "t string")
    assert [r[0] for r in amt.select(O.parse_amount(F.col("t"))).collect()] == [1234.5, 7.0, None]


def test_stored_by_key_needs_no_exchange_on_the_order_key(spark):
    from docmill.session import scratch_path
    read = lambda n: spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet")
    code, ship = F.lit("SAVE15"), F.lit("express")
    plain = O.order_totals(read("orders"), read("lineitem"), read("part"), code, ship)
    o, lines = (O.store_by_key(read(n), k, scratch_path(spark, n), buckets=4)
                for n, k in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")))
    stored = O.order_totals(o, lines, read("part"), code, ship)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables; part's own hint stays
        plan = plan_text(stored)
        assert "hashpartitioning(l_orderkey" in plan_text(plain)
        assert "hashpartitioning" not in plan and "SortMergeJoin" in plan and "Bucketed: true" in plan
        assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, plain.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    files = {f.rsplit("/", 1)[-1] for f in o.inputFiles()}
    assert len(files) <= 8  # a bucket is a file, or a few where AQE splits it
