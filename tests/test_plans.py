"""Plan shape assertions on registered queries (sf0.001)."""

from conftest import plan_text
from pyspark.sql import functions as F

from docmill.plans import registry as R

SF = "/root/testdata/sf0.001"
PYTHON_NODES = ("EvalPython", "MapInArrow", "MapInPandas", "PythonUDF", "FlatMapGroupsInPandas")


def test_feature_detection_is_jvm_only(spark):
    plan = plan_text(R.q_feature_detect(spark, SF))
    assert not any(n in plan for n in PYTHON_NODES)
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_order_totals_broadcasts_the_part_dimension(spark):
    plan = plan_text(R.q_order_totals(spark, SF))
    assert "BroadcastHashJoin" in plan
    assert "ReadSchema: struct<p_partkey:bigint,p_retailprice:double>" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>" in plan


def test_retrieval_shuffles_only_candidates(spark):
    plan = plan_text(R.q_retrieve_lexical(spark, SF))
    # the kernel sits below a partial top-k; no aggregate over (query, chunk) pairs
    assert "MapInArrow" in plan and "WindowGroupLimit" in plan
    assert "HashAggregate" not in plan


def test_a_one_group_file_is_dealt_out(spark):
    """Planned splits of a small file are mostly empty; its rows still reach every core."""
    from docmill.plans.corpus import documents, spread
    cores = spark.sparkContext.defaultParallelism
    df = documents(spark, "/root/testdata/sf0.01").select("doc_id", "text")
    assert df.rdd.getNumPartitions() < cores
    assert "RoundRobinPartitioning" in plan_text(spread(df))
    full = spread(df).groupBy(F.spark_partition_id()).count().collect()
    assert len(full) == cores
    assert "RoundRobin" not in plan_text(spread(df.repartition(cores, "doc_id")))
