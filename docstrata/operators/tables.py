"""Table grids in long form: (doc, table_id, row, col, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstrata.functions import text as X

TABLE = ["doc_id", "table_id"]


def cleaned(cells: DataFrame, strip: bool = False) -> DataFrame:
    """No-break spaces and line breaks become blanks."""
    text = F.translate("text", f"{X.NBSP}\n", "  ")
    return cells.withColumn("text", X.strip(text) if strip else text)


def merged_cells(cells: DataFrame, by: list[str] = TABLE) -> DataFrame:
    """Cells of ``cells(..., text, span)``: "right" takes the value to its left, "down" the value above in its column.
    Spans of both kinds are resolved from the top left, columns first."""
    own = F.when(F.col("span").isNull(), F.col("text"))
    down = F.last(own, True).over(Window.partitionBy(*by, "col").orderBy("row"))
    filled = cells.withColumn("text", F.when(F.col("span") == "down", down).otherwise(own))
    across = F.last("text", True).over(Window.partitionBy(*by, "row").orderBy("col"))
    return filled.withColumn("text", F.when(F.col("span") == "right", across).otherwise(F.col("text"))).drop("span")


def forward_filled(cells: DataFrame, by: list[str] = TABLE) -> DataFrame:
    """Blank cells take the value above, and those still blank the value to the left. A document's cells are moved once, for both windows:
    the first of ``by`` deals them out."""
    cells = cells.repartition(by[0])
    value = F.when(~X.is_blank(F.col("text")), F.col("text"))
    down = cells.withColumn("text", F.last(value, True).over(Window.partitionBy(*by, "col").orderBy("row")))
    return down.withColumn("text", F.last("text", True).over(Window.partitionBy(*by, "row").orderBy("col")))


def profile(cells: DataFrame, by: list[str] = TABLE, style: str | None = None) -> DataFrame:
    """(…, num_cols, num_rows[, style]) of each table."""
    more = [F.first(style, True).alias("style")] if style else []
    return cells.groupBy(*by).agg((F.max("col") + 1).alias("num_cols"), (F.max("row") + 1).alias("num_rows"), *more)


def larger_than(cells: DataFrame, n: int, by: list[str] = TABLE) -> DataFrame:
    """Cells of the tables with more than n rows."""
    return cells.join(profile(cells, by).where(F.col("num_rows") > n).select(*by), by, "left_semi")


def rows(cells: DataFrame, by: list[str] = TABLE) -> DataFrame:
    """(…, row, data): the cells of each row in order."""
    return ordered_rows(cells, by).drop("num_cols")


def ordered_rows(cells: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with ``num_cols``, the last column's number and one. Places and texts are collected side by side, without nulls, which moves
    a third less than a struct for each cell."""
    place, text = F.collect_list(F.coalesce("col", F.lit(-(2**31)))), F.collect_list(F.coalesce("text", F.lit("")))
    both = F.array_sort(F.arrays_zip(place.alias("col"), text.alias("text")))
    return cells.groupBy(*by, "row").agg(F.transform(both, lambda x: x["text"]).alias("data"), (F.max("col") + 1).alias("num_cols"))


def delimited(cells: DataFrame, separator: str = ",", by: list[str] = TABLE) -> DataFrame:
    """(…, row, line): each row as a line of CSV or, with a tab, TSV."""

    def quoted(x: Column) -> Column:
        special = F.contains(x, F.lit(separator)) | F.contains(x, F.lit('"')) | F.contains(x, F.lit("\n"))
        return F.when(special, F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)

    return rows(cells, by).select(*by, "row", F.array_join(F.transform("data", quoted), separator).alias("line"))


def report(cells: DataFrame, at: Column, doc: str = "doc_id", table: str = "table_id") -> DataFrame:
    """(doc, report): a JSON object with filename, timestamp, num_tables and the tables of each document."""
    grid = ordered_rows(cells.repartition(doc), [doc, table]).groupBy(doc, table)  # cells are moved once, for rows, tables and documents
    data = F.transform(F.array_sort(F.collect_list(F.struct("row", "data"))), lambda r: r["data"]).alias("data")
    one = grid.agg(F.max("num_cols").alias("num_cols"), (F.max("row") + 1).alias("num_rows"), data).select(doc, F.struct(F.col(table).alias("id"), "num_cols", "num_rows", "data").alias("t"))
    return one.groupBy(doc).agg(F.to_json(F.struct(F.first(F.col(doc).cast("string")).alias("filename"), F.first(X.iso_time(at)).alias("timestamp"), F.count("*").alias("num_tables"), F.array_sort(F.collect_list("t")).alias("tables"))).alias("report"))
