"""Tables of cells: rectangular grids, spans and overlaps, rows as text and as Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T


def grid(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row_no, col_no, text: one row for each place of the grid; a value stands at its cell's first place only.

    cells: keys, cell_seq, text, r0, r1, c0, c1 (ends exclusive). Values that start at one place join in order with ` / `.
    """
    value = T.cell_text(F.coalesce("text", F.lit("")))
    starts = cells.groupBy(*keys, F.col("r0").alias("row_no"), F.col("c0").alias("col_no")).agg(
        F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("cell_seq", value.alias("v")))), lambda x: x["v"]), lambda v: v != ""), " / ").alias("text")
    )
    sizes = cells.groupBy(*keys).agg((F.max("r0") + 1).alias("h"), (F.max("c0") + 1).alias("w"), F.max("r1").alias("r1"), F.max("c1").alias("c1"))
    places = sizes.select(*keys, F.explode(F.sequence(F.lit(0), F.greatest("h", "r1") - 1)).alias("row_no"), F.greatest("w", "c1").alias("w"))
    places = places.select(*keys, "row_no", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("col_no"))
    return places.join(starts, [*keys, "row_no", "col_no"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def grid_rows(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row_no, cells: the grid's rows as arrays."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("col_no", "text"))), lambda x: x["text"])
    return grid(cells, keys).groupBy(*keys, "row_no").agg(ordered.alias("cells"))


def table_checks(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, overlaps (places covered twice), has_span, is_empty."""
    covered = cells.select(*keys, F.explode(F.sequence(F.col("r0"), F.greatest("r0", F.col("r1") - 1))).alias("r"), "c0", "c1")
    covered = covered.select(*keys, "r", F.explode(F.sequence(F.col("c0"), F.greatest("c0", F.col("c1") - 1))).alias("c"))
    twice = covered.groupBy(*keys, "r", "c").agg(F.count("*").alias("n")).filter("n > 1").groupBy(*keys).agg(F.count("*").alias("overlaps"))
    facts = cells.groupBy(*keys).agg(
        F.max((F.col("r1") - F.col("r0") > 1) | (F.col("c1") - F.col("c0") > 1)).alias("has_span"),
        (~F.max(T.cell_text(F.coalesce("text", F.lit(""))) != "")).alias("is_empty"),
    )
    return facts.join(twice, keys, "left").withColumn("overlaps", F.coalesce("overlaps", F.lit(0).cast("long")))


def prose_tables(rows: DataFrame, keys: list[str], is_title: Column) -> DataFrame:
    """keys, lines: tables with one value a row, a title first and list items after it, which are text. is_title judges `first`."""
    value = F.filter("cells", lambda x: x != "")
    per = rows.select(*keys, "row_no", F.size(value).alias("n"), F.coalesce(F.get(value, F.lit(0)), F.lit("")).alias("v"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("row_no", "v"))), lambda x: x["v"])
    tables = per.groupBy(*keys).agg(F.max("n").alias("most"), lines.alias("lines")).withColumn("first", F.get("lines", F.lit(0)))
    items = F.forall(F.slice("lines", 2, 1_000_000), lambda v: v.rlike(P.LIST_LINE))
    return tables.filter((F.size("lines") > 1) & (F.col("most") <= 1) & items & is_title).select(*keys, "lines")


def row_lines(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row_no, text: `a | b` with one cell for a span: its later columns are left out, its later rows are blank."""
    here = cells.select(*keys, F.explode(F.sequence(F.col("r0"), F.greatest("r0", F.col("r1") - 1))).alias("row_no"), "r0", "c0", "cell_seq", "text")
    shown = F.when(F.col("row_no") == F.col("r0"), T.strip(F.regexp_replace(F.coalesce("text", F.lit("")), rf"{T.BLANK}+", " "))).otherwise("")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("c0", "cell_seq", shown.alias("v")))), lambda x: x["v"])
    rows = here.groupBy(*keys, "row_no").agg(ordered.alias("cells"))
    return rows.filter(F.exists("cells", lambda v: v != "")).select(*keys, "row_no", F.array_join("cells", " | ").alias("text"))


def markdown_row(cells: Column) -> Column:
    shown = F.transform(cells, lambda c: F.replace(T.escaped_markdown(c), F.lit("|"), F.lit("\\|")))
    return F.concat(F.lit("| "), F.array_join(shown, " | "), F.lit(" |"))


def table_markdown(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, markdown: the first row is the header."""
    line = F.when(
        F.col("row_no") == F.min("row_no").over(Window.partitionBy(*keys)),
        F.concat(markdown_row(F.col("cells")), F.lit("\n| "), F.array_join(F.transform("cells", lambda _: F.lit("---")), " | "), F.lit(" |")),
    ).otherwise(markdown_row(F.col("cells")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("row_no", "line"))), lambda x: x["line"])
    return rows.withColumn("line", line).groupBy(*keys).agg(F.array_join(ordered, "\n").alias("markdown"))


def divergence(reference_tables: Column, text_tables: Column) -> Column:
    """Array of rule names for tables that one reading has and the other lacks; a null reference was not read."""
    lost = (reference_tables > 0) & (text_tables == 0)
    return F.when(lost, F.array(F.lit("TABLE_AUDIT"), F.lit("TABLES_MISSING"))).otherwise(F.array().cast("array<string>"))


def set_upright(places: DataFrame, keys: list[str]) -> DataFrame:
    """grid() places of tables read on a turned page (direction `btt` or `ttb`), with rows and columns as they are read."""
    page = Window.partitionBy(*keys)
    h, w = F.max("row_no").over(page), F.max("col_no").over(page)
    way = F.col("direction")
    row = F.when(way == "btt", F.col("col_no")).when(way == "ttb", w - F.col("col_no")).otherwise(F.col("row_no"))
    col = F.when(way == "btt", h - F.col("row_no")).when(way == "ttb", F.col("row_no")).otherwise(F.col("col_no"))
    return places.withColumns({"row_no": row, "col_no": col})
