"""What the plans must look like at any size."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from convfeat.catalog import QUERIES
from convfeat.fixtures.samples import samples
from convfeat.operators.features import convert, project_layout
from convfeat.operators.lookup import lookup_embedding
from convfeat.operators.selection import filter_recent
from convfeat.sources.samples import read_samples
from tests.test_features import LAYOUT, ROWS, SCHEMA

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["seq_pack", "match_features", "attention_pool", "auc", "early_stop", "oob_report", "last_prediction"])
def test_stays_in_the_jvm_without_single_partition_rows(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert not re.search(r"ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroups|CartesianProduct|NestedLoop", text)
    before_final_aggregate = text.split("Exchange SinglePartition")
    for below in before_final_aggregate[1:]:
        assert "partial_" in below.split("\n")[1], "only combined rows may meet in one task"


def test_scan_reads_only_declared_columns_and_pushes_time(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(str(tmp_path / "d"))
    df = filter_recent(project_layout(read_samples(spark, str(tmp_path / "d")), LAYOUT), 50_000)
    text = plan(convert(df, LAYOUT).select("user_id", "user_int_feats_1"))
    schema = re.search(r"ReadSchema: struct<([^\n]*)>", text).group(1)
    read = {name for name in re.findall(r"(\w+):", schema) if not name.startswith("_tmp_metadata")}
    assert read == {"timestamp", "user_id", "user_int_feats_1"}
    assert "GreaterThanOrEqual(timestamp,50000)" in text


def test_large_table_is_not_broadcast(spark, setting):
    setting("spark.sql.autoBroadcastJoinThreshold", "10")
    df = spark.range(50).select("id", (F.col("id") % 3).alias("item"))
    table = spark.range(5).select("id", F.array(F.lit(1.0)).alias("vec"))
    text = plan(lookup_embedding(df, "item", table, 1, ["id"]))
    assert "BroadcastHashJoin" not in text and "__salt" in text


def exchanges(node):
    """All shuffles below a physical plan node."""
    own = [node] if node.nodeName() == "Exchange" else []
    below = node.children()
    return own + [e for i in range(below.size()) for e in exchanges(below.apply(i))]


@pytest.mark.parametrize("name", ["match_features", "match_summary"])
def test_matching_shuffles_no_vectors(spark, setting, name):
    """Ids alone cross the exchanges by sample; vectors only those of keys that several samples share."""
    setting("spark.sql.adaptive.enabled", "false")
    found = exchanges(QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan())
    by_sample = [e for e in found if "hashpartitioning(sample_id" in e.toString().split("\n")[0]]
    assert by_sample
    for e in by_sample:
        crossing = e.schema().simpleString()
        assert not re.search("double|binary", crossing) or "__samples" in e.toString(), crossing


def test_samples_shuffle_for_no_part_that_no_event_names(spark, setting, tmp_path):
    events = [(i, datetime(2024, 1, 1, 0, 0, i), 7, "view", 1.0, f'{{"k": {k}}}' if k else None) for i, k in enumerate([3, 3, 40000, None, 60000])]
    events = spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    parts = spark.range(1, 50000).selectExpr("id AS p_partkey", "concat('Brand#', id % 25) AS p_brand", "int(id % 50) AS p_size")
    parts.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    setting("spark.sql.autoBroadcastJoinThreshold", "20000")
    found = samples(spark, str(tmp_path), ["item"])
    assert "__salt" not in plan(found)
    assert sorted((r.sample_id, r.item_int_feats_5) for r in found.collect()) == [(0, 3), (1, 3), (2, 0), (3, None), (4, None)]
