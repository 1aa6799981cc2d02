"""The shape of physical plans: what is read, joined and ranked."""

import pytest
from pyspark.sql import functions as F

from veilframe import showcase
from veilframe.operators import anonymity, profile

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def lineitem(spark):
    return spark.read.parquet(f"{FOLDER}/lineitem.parquet")


def test_only_needed_columns_are_read(lineitem):
    text = plan(anonymity.k_anonymity(lineitem, ["l_returnflag", "l_linestatus"]))
    assert "ReadSchema: struct<l_returnflag:string,l_linestatus:string>" in text
    assert text.count("FileScan") == 1


def test_filters_reach_the_scan(lineitem):
    late = lineitem.where(F.col("l_quantity") > 45)
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,45.0)" in plan(anonymity.k_anonymity(late, ["l_returnflag"]))


def test_top_values_are_cut_before_the_shuffle(lineitem):
    text = plan(profile.top_values(profile.value_counts(lineitem, ["l_returnflag", "l_comment" if "l_comment" in lineitem.columns else "l_linestatus"]), 5))
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text


def test_counts_are_combined_before_the_shuffle(lineitem):
    text = plan(profile.value_counts(lineitem, ["l_returnflag", "l_linestatus"]))
    assert text.count("Exchange hashpartitioning") == 1 and text.count("HashAggregate") == 2


@pytest.mark.parametrize("name", ["classical_metrics", "t_closeness", "cramers_v_mae", "tvd_categorical", "stratified_split", "holdout_split",
                                  "run_history_page", "run_log_extract", "process_state", "weighted_f1", "jsd_numeric"])
def test_no_cross_join_and_no_python(spark, name):
    text = plan(showcase.runner(name)(spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "Python" not in text and "mapInArrow" not in text.lower()


def test_every_query_is_registered_once():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and len(names) > 90


def test_parts_of_a_split_are_pruned(spark, lineitem):
    from veilframe.plans.prepare import PrepareConfig, prepare

    done = prepare(lineitem.select("l_quantity", "l_returnflag"), PrepareConfig(target="l_returnflag"))
    text = plan(done.train)
    assert "PartitionFilters: [isnotnull(split" in text and done.train.columns == ["l_quantity", "l_returnflag"]
    assert done.train.count() + done.holdout.count() == done.tagged.count()


def test_no_window_without_partition(spark, lineitem):
    from veilframe.operators.split import class_quotas

    sizes = lineitem.groupBy(F.col("l_suppkey").alias("__qg")).agg(F.count(F.lit(1)).alias("__n"))
    rows = lineitem.count()
    quotas = class_quotas(sizes, rows // 5, rows)
    assert "Exchange SinglePartition" not in plan(quotas)
    assert quotas.agg(F.sum("__quota")).first()[0] == rows // 5


def test_a_run_leaves_nothing(spark):
    from veilframe.session import materialize, scratch_run, shared_dir

    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    with scratch_run(spark) as root:
        assert materialize(spark.range(5), "few").count() == 5
        path = hadoop.Path(root)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        assert root.startswith(shared_dir(spark)) and fs.exists(path)
    assert not fs.exists(path)
