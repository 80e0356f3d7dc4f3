"""Every registered query against its SQL, and the plans that must hold at scale."""

import os
import re

import pytest

import __spark_entry__ as entry
from unisource.plans.queries import QUERIES
from compare import connect, difference

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert name in entry.oracle_sql()
    assert difference(spark, con, name, SF) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 11 and df.schema == entry.entry(spark).schema


def test_vote_has_one_aggregation_exchange(spark, plan):
    text = plan(entry.queries()["infer_types_lineitem"](spark, SF))
    assert text.count("Exchange hashpartitioning") == 1 and "Python" not in text


def test_type_map_is_broadcast(spark, plan):
    assert "BroadcastHashJoin" in plan(entry.queries()["normalize_types"](spark, SF))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_and_no_cartesian_product(spark, plan, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text and "MapInPandas" not in text
    assert "CartesianProduct" not in text


def test_columns_are_pruned(spark, plan):
    text = plan(entry.queries()["latest_status"](spark, SF))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,value:double,props:string>" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double,o_orderpriority:string>" in plan(
        entry.queries()["entity_page"](spark, SF)
    )


def test_bodies_are_parsed_once(spark, plan):
    assert plan(entry.queries()["edmx_fields"](spark, SF)).count("from_xml(") == 1
    assert "from_json" not in plan(entry.queries()["json_file_fields"](spark, SF)).split("RoundRobin")[-1].split("FileScan")[-1]


def test_joins_without_broadcast_exchange_each_side_once(spark, plan):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        detail = plan(entry.queries()["entity_detail"](spark, SF))
        replaced = plan(entry.queries()["metadata_replace"](spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # nested fields are not exchanged again after they were gathered
    assert re.search(r"Sort \[entity_id[^\n]*part[^\n]*\n[^\n]*ObjectHashAggregate", detail)
    assert replaced.count("Exchange hashpartitioning") == 4


def test_relations_read_every_table_once(spark, plan):
    text = plan(entry.queries()["relation_confidence"](spark, SF))
    # seven pairs over seven tables: one exchange by value, one by mask, one by pair, and the join with the pairs' names
    assert text.count("FileScan") == 7 and text.count("Exchange hashpartitioning") <= 3 and "SortMergeJoin" not in text


def test_integrity_reads_each_table_once(spark, plan):
    assert plan(entry.queries()["catalog_integrity"](spark, SF)).count("FileScan") == 2
