"""What queries leave on disk: shuffles go with the step that made them, and what several steps need is computed once."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from evigraph.plans.scratch import CLEANUP, staged


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_the_shuffles_of_a_staged_table_go_with_its_write(spark):
    before, conf = shuffle_files(spark), spark.conf.get(CLEANUP)
    rows = staged(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count(), "test")
    assert shuffle_files(spark) <= before and spark.conf.get(CLEANUP) == conf
    assert rows.count() == 100


def test_single_assignment_returns_what_it_has_written(spark, sf):
    got = entry.queries()["single_assignment"](spark, sf)
    shown = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in shown and "lineitem" not in shown


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning")


def test_relation_gate_shuffles_lines_by_part_and_by_order_only(spark, sf):
    # lines and parts by part, lines and orders by order, orders (also for their evidence, twice) and customers by customer
    assert shuffles(entry.queries()["relation_gate"](spark, sf)) <= 14


def test_export_computes_claims_once_and_shuffles_each_kind_apart(spark, sf):
    assert shuffles(entry.queries()["export_records_csv"](spark, sf)) <= 2  # orders and customers, of the evidence


def test_catalog_shuffles_each_output_apart(spark, sf):
    assert shuffles(entry.queries()["candidate_catalog"](spark, sf)) == 0


def test_build_graph_writes_its_outputs_before_they_are_put_together(spark, sf):
    assert shuffles(entry.queries()["build_graph"](spark, sf)) == 0
