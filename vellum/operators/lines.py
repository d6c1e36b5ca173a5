"""Line tables: text split into numbered lines, page furniture, long lines, line order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T


def to_lines(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, line_no (from 1), text."""
    return df.select(*keys, F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "text")).withColumn("line_no", F.col("line_no") + 1)


def to_text(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, text: the lines in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])
    return lines.groupBy(*keys).agg(F.array_join(ordered, "\n").alias("text"))


def _filled_ranks(lines: DataFrame, keys: list[str]) -> tuple[DataFrame, Column]:
    """Adds up, down and filled: a non-empty line's rank from the top and the bottom, and how many there are."""
    full = T.strip("text") != ""
    page = Window.partitionBy(*keys)
    n = F.sum(full.cast("int")).over(page)
    up = F.sum(full.cast("int")).over(page.orderBy("line_no"))
    return lines.withColumns({"filled": n, "up": up}).withColumn("down", F.col("filled") - F.col("up") + 1), full


def strip_furniture(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, line_no, text, removed (array): furniture lines go anywhere, page numbers and broken footers only in the margins.

    A line with a header in front or a dated header inside keeps the rest. A line that ends with nothing left has a null
    text; callers filter it.
    """
    ranked, full = _filled_ranks(lines, keys)
    plain = T.strip("text")
    margin = full & (F.least("up", "down") <= P.MARGIN_LINES)
    drop = T.is_furniture("text") | (margin & T.one_of(plain, P.PAGE_NUMBER, P.BROKEN_FOOTER))
    rest = T.without_header_prefix("text")
    prefix = F.when(rest != plain, F.substring(plain, F.lit(1), F.length(plain) - F.length(rest)))
    body = F.when(rest != plain, rest).otherwise(F.col("text"))
    cleaned = T.without_dated_header(body)
    removed = F.when(drop, F.array(plain)).otherwise(F.filter(F.concat(F.array(T.strip(prefix)), T.dated_headers(body)), lambda x: F.coalesce(x, F.lit("")) != ""))
    return ranked.select(*keys, "line_no", F.when(~drop & ((T.strip(cleaned) != "") | (plain == "")), cleaned).alias("text"), removed.alias("removed"))


#: How many parts the rows of one key come in where they meet a row of few.
SALTS = 64


def salt(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int").alias("salt")


def salted(few: DataFrame) -> DataFrame:
    """A row for each salt, for joins with rows of which very many have one key."""
    return few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def repeated_margins(lines: DataFrame, doc: str = "doc_id", page: str = "page_no", in_table: Column | None = None, least: int = 3) -> DataFrame:
    """doc, text, pages: lines in the margins of half the pages, and of `least` at least. Table lines count for place only."""
    in_table = F.lit(False) if in_table is None else in_table
    ranked, full = _filled_ranks(lines, [doc, page])
    zone = F.greatest(F.lit(1), F.least(F.lit(3), F.floor(F.col("filled") / 4)))
    margin = ranked.filter(full & ~in_table & (F.least("up", "down") <= zone)).select(doc, page, T.strip("text").alias("text")).distinct()
    pages = lines.select(doc, page).distinct().groupBy(doc).agg(F.count("*").alias("all_pages"))
    counted = margin.groupBy(doc, "text").agg(F.count("*").alias("pages")).join(pages, doc)
    return counted.filter(F.col("pages") >= F.greatest(F.lit(least), F.ceil(F.col("all_pages") / 2))).select(doc, "text", "pages")


def remove_repeated(lines: DataFrame, doc: str = "doc_id", page: str = "page_no", in_table: Column | None = None) -> DataFrame:
    """Lines of pages without furniture and without what repeats in the margins; tables stay whole."""
    in_table = F.lit(False) if in_table is None else in_table
    # Twelve lines of a document at most, as a page has six in its margins; only those of margins need to meet them.
    often = salted(repeated_margins(lines, doc, page, in_table).select(doc, F.col("text").alias("met"), F.lit(True).alias("often")))
    ranked, full = _filled_ranks(lines, [doc, page])
    zone = F.greatest(F.lit(1), F.least(F.lit(3), F.floor(F.col("filled") / 4)))
    text = full & ~in_table
    at_end = text & (F.least("up", "down") <= zone)
    ranked = ranked.withColumns({"plain": T.strip("text"), "at_end": at_end}).withColumns({"met": F.when(F.col("at_end"), F.col("plain")).otherwise(""), "salt": salt(page, "line_no")})
    ranked = ranked.join(often, [doc, "met", "salt"], "left")
    rest = T.without_header_prefix("plain")
    margin = F.col("at_end") & (F.col("often").isNotNull() | T.one_of(F.col("plain"), r"^\p{Nd}+$", P.BROKEN_FOOTER))
    kept = F.when(text & (T.is_furniture("plain") | margin), None).when(text & (rest != F.col("plain")), F.nullif(rest, F.lit(""))).otherwise(F.col("text"))
    return ranked.withColumn("text", kept).filter(F.col("text").isNotNull()).select(*lines.columns)


def long_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, paragraph, chars: lines that look like a table fallen into one line. Paragraphs count non-empty lines."""
    full = lines.withColumn("text", T.strip("text")).filter("text <> ''")
    order = Window.partitionBy(*keys).orderBy("line_no")
    near = full.withColumns({"paragraph": F.row_number().over(order), "before": F.coalesce(F.lag("text").over(order), F.lit("")), "after": F.coalesce(F.lead("text").over(order), F.lit(""))})
    text = F.col("text")
    bad = (F.length(text) > P.LONG_LINE) & T.looks_like_table(text) & ~(text.contains(" | ") & T.whole_table_row(text, F.col("before"), F.col("after")))
    return near.filter(bad).select(*keys, "paragraph", F.length(text).alias("chars"))


def residues(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, paragraph, text: furniture left in a final text."""
    full = lines.withColumn("text", T.strip("text")).filter("text <> ''")
    full = full.withColumn("paragraph", F.row_number().over(Window.partitionBy(*keys).orderBy("line_no")))
    return full.filter(T.has_furniture("text")).select(*keys, "paragraph", "text")


def table_blocks(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, blocks: runs of two or more neighbouring lines with cells."""
    order = Window.partitionBy(*keys).orderBy("line_no")
    run = F.row_number().over(order) - F.row_number().over(Window.partitionBy(*keys, "is_row").orderBy("line_no"))
    runs = lines.withColumn("is_row", F.col("text").contains(" | ")).withColumn("run", run).filter("is_row").groupBy(*keys, "run").agg(F.count("*").alias("n"))
    return runs.filter("n >= 2").groupBy(*keys).agg(F.count("*").alias("blocks"))


def joined_pages(pages: DataFrame, doc: str = "doc_id", page: str = "page_no") -> DataFrame:
    """doc, page, text: a word cut between pages moves to the page where it starts.

    Pages are folded in order, as a page that gave its first word away may be cut itself.
    """
    head = r"^[a-zà-ÿ][\p{L}\p{N}_]*"
    plain = F.regexp_replace("text", rf"{T.BLANK}+\z", "")
    rows = pages.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.coalesce(plain, F.lit("")).alias("t")))).alias("all"))

    def step(done: Column, x: Column) -> Column:
        last, start = F.element_at(done, -1), F.regexp_replace(x["t"], rf"^{T.BLANK}+", "")
        cut = F.coalesce(last["t"].rlike("[-￾]\\z"), F.lit(False)) & start.rlike(head)
        whole = F.struct(last["p"].alias("p"), F.concat(F.regexp_replace(last["t"], ".\\z", ""), F.regexp_extract(start, f"({head})", 1)).alias("t"))
        rest = F.struct(x["p"].alias("p"), F.regexp_replace(start, head, "").alias("t"))
        return F.when(cut, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(whole, rest))).otherwise(F.concat(done, F.array(x)))

    folded = F.aggregate(F.slice("all", 2, 1_000_000_000), F.slice("all", 1, 1), step)
    return rows.select(doc, F.explode(folded).alias("x")).select(doc, F.col("x.p").alias(page), T.joined_hyphens(F.col("x.t")).alias("text"))


def clean_pages(pages: DataFrame, doc: str = "doc_id", page: str = "page_no") -> DataFrame:
    """Reference pages made ready to measure: one line end, no furniture, no cut words."""
    keys = [doc, page]
    lines = to_lines(pages.withColumn("text", T.unix_lines("text")), keys)
    kept = strip_furniture(lines, keys).filter(F.col("text").isNotNull())
    texts = pages.select(*keys).join(to_text(kept, keys), keys, "left").withColumn("text", F.coalesce("text", F.lit("")))
    return joined_pages(texts, doc, page)
