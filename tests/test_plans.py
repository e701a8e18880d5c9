"""What the physical plans must look like."""

import re

import pytest

from flowlens.operators import sessions as S
from flowlens.operators import prep as H
from flowlens.operators import temporal as E
from flowlens.plans.flows import CFG
from flowlens.sources.adapters import packets, table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    """The packet feed as a stored table, so that pruning shows at the scan."""
    path = str(tmp_path_factory.mktemp("feed") / "packets")
    packets(spark, "/root/testdata/sf0.001").write.parquet(path)
    return spark.read.parquet(path)


def test_sessions_shuffle_twice_and_hash_aggregate(feed):
    text = plan(S.session_aggregates(feed, CFG))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 2
    assert "SortAggregate" not in text and "ObjectHashAggregate" not in text
    assert "Python" not in text


def test_temporal_features_never_window_over_a_whole_key_of_packets(feed):
    text = plan(E.temporal_features(feed, CFG))
    for window in re.findall(r"Window \[(?:lag|lead)\(ts_us.*", text):
        assert "chunk" in window
    assert "Python" not in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scan_reads_needed_columns(feed):
    df = S.session_aggregates(feed.where("protocol = 6"), CFG)
    text = feed.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(
        df._jdf.queryExecution(), "formatted"
    )
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "k:" not in schema and "winsize" not in schema and "seq" not in schema
    assert "EqualTo(protocol,6)" in text


def test_split_does_not_shuffle_rows(spark, sf):
    li = table(spark, sf, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS id", "cast(l_returnflag = 'R' AS int) AS label", "l_tax")
    text = plan(H.stratified_split(li, "id"))
    # One exchange: the ranked rows of the border prefix. The class cut-offs were fetched first.
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1
    assert "BroadcastHashJoin" in text


def test_flow_features_scan_packets_twice(feed):
    spark = feed.sparkSession
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(E.flow_features(feed, CFG))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"FileScan parquet", text)) == 2
    assert len(re.findall(r"Exchange hashpartitioning", text)) <= 6
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
