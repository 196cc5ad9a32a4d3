"""Cells of tables are moved no more often than they must be, and in a small form."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from docstrata.operators import tables


def grid(spark, docs=40):
    cells = spark.range(docs * 60).select((F.col("id") % docs).alias("doc_id"), F.floor(F.col("id") / docs).cast("int").alias("i"))
    return cells.select("doc_id", (F.col("i") % 2).alias("table_id"), F.floor(F.col("i") / 6).cast("int").alias("row"), (F.floor(F.col("i") / 2) % 3).cast("int").alias("col"), F.when(F.col("i") % 4 != 0, F.concat(F.lit("w"), "i")).alias("text"))


def exchanges(rows) -> int:
    return len(re.findall(r"Exchange hashpartitioning", rows._jdf.queryExecution().executedPlan().toString()))


@pytest.mark.parametrize("of", [tables.forward_filled, lambda c: tables.report(c, F.lit("2024-05-06 07:08:09").cast("timestamp"))])
def test_cells_are_moved_once(spark, of):
    """With one table id for all, too, as constants leave the keys."""
    for cells in (grid(spark), grid(spark).withColumn("table_id", F.lit(0))):
        assert exchanges(of(cells)) == 1


def test_rows_collect_no_struct_for_each_cell(spark):
    assert "collect_list(struct" not in tables.rows(grid(spark))._jdf.queryExecution().optimizedPlan().toString()


def test_rows_with_nulls_keep_texts_in_their_places(spark):
    cells = spark.createDataFrame([("d", 0, 0, 2, "c"), ("d", 0, 0, 0, None), ("d", 0, 0, 1, "b"), ("d", 0, 1, 0, "x")], "doc_id string, table_id int, row int, col int, text string").repartition(4)
    assert sorted((r.row, r.data) for r in tables.rows(cells).collect()) == [(0, ["", "b", "c"]), (1, ["x"])]
