"""Page geometry: reading order, columns, hidden glyphs, regions. Near pairs meet on written bucket keys, never in a cross join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..sources.scratch import written

# Limits of the page rules, in points or shares.
BLOCKS_FOR_COLUMNS, GUTTER_SHARE, BLOCKS_ACROSS, SIDE_SHARE = 8, 0.02, 0.05, 0.25
WORDS_FOR_COLUMNS, GUTTER_POINTS, WORDS_ACROSS = 40, 5.0, 0.02
ORIGIN_TOLERANCE, BASELINE, BAND, LINE_TOLERANCE = 0.1, 1.0, 4.0, 3.0
INSIDE_SHARE, SECTION_JUMP, LEAST_GUTTER, SPACE_LEAST, SPACE_SLACK = 0.9, 3.0, 8.0, 0.8, 1.2
NEARLY_STRAIGHT = 0.5
PAGE_CELLS, MOST_COORDINATE = 16, 1e15
LEAST_ROTATED, ROTATED_WITHOUT_COLUMNS, ROTATED_TABLE = 3, 10, 0.8


def from_top(t: Column, height: Column, origin: Column) -> Column:
    """Distance to the page's top from either origin."""
    return F.when(origin == "BOTTOMLEFT", height - t).otherwise(t)


def _share(part: Column, whole: Column) -> Column:
    return F.sum(part.cast("int")) / F.count(whole)


def block_columns(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, two_columns: from blocks with l, r and the page's width."""
    mid, tol = F.col("width") / 2, F.col("width") * GUTTER_SHARE
    l, r = F.col("l"), F.col("r")  # noqa: E741
    return boxes.filter(l.isNotNull()).groupBy(*keys).agg(
        ((F.count("l") >= BLOCKS_FOR_COLUMNS) & (_share((l < mid - tol) & (r > mid + tol), l) < BLOCKS_ACROSS)
         & (_share(r <= mid + tol, l) > SIDE_SHARE) & (_share(l >= mid - tol, l) > SIDE_SHARE)).alias("two_columns")
    )


def word_columns(words: DataFrame, keys: list[str], edges: DataFrame | None = None, tables: DataFrame | None = None) -> DataFrame:
    """keys, gutter: the middle of pages in two columns, else null. words: x0, x1, left, right (the page's sides).

    Two horizontal edges (x0, x1, top, page_top, page_bottom) across the middle of the body, or a table (x0, x1) across
    it, mean one column.
    """
    mid = (F.col("left") + F.col("right")) / 2
    x0, x1 = F.col("x0"), F.col("x1")
    pages = words.groupBy(*keys).agg(
        F.min(mid).alias("mid"),
        ((F.count("x0") >= WORDS_FOR_COLUMNS) & (_share((x0 < mid - GUTTER_POINTS) & (x1 > mid + GUTTER_POINTS), x0) < WORDS_ACROSS)
         & (_share(x1 <= mid, x0) > SIDE_SHARE) & (_share(x0 >= mid, x0) > SIDE_SHARE)).alias("two"),
    )
    blocked = []
    if edges is not None:
        margin = (F.col("page_bottom") - F.col("page_top")) * 0.1
        across = edges.join(pages.select(*keys, "mid"), keys).filter(
            (F.col("x0") < F.col("mid") - 10) & (F.col("x1") > F.col("mid") + 10)
            & (F.col("top") > F.col("page_top") + margin) & (F.col("top") < F.col("page_bottom") - margin)
        )
        blocked.append(across.groupBy(*keys).agg(F.count("*").alias("n")).filter("n >= 2").select(*keys))
    if tables is not None:
        blocked.append(tables.join(pages.select(*keys, "mid"), keys).filter((F.col("x0") < F.col("mid") - 20) & (F.col("x1") > F.col("mid") + 20)).select(*keys).distinct())
    for one in blocked:
        pages = pages.join(one.withColumn("no", F.lit(True)), keys, "left").withColumn("two", F.col("two") & F.col("no").isNull()).drop("no")
    return pages.select(*keys, F.when(F.col("two"), F.col("mid")).alias("gutter"))


def reading_order(items: DataFrame, doc: str = "doc_id") -> DataFrame:
    """items with place (from 1) and moved: by page, column, distance to the top, own order.

    items: doc, item_seq, page_no, l, t, r, origin, width, height; an item without a box stays after the one before it.
    """
    columns = block_columns(items, [doc, "page_no"])
    placed = items.join(columns, [doc, "page_no"], "left")
    right = F.coalesce("two_columns", F.lit(False)) & (F.col("l") >= F.col("width") / 2 - F.col("width") * GUTTER_SHARE)
    key = F.when(F.col("l").isNotNull(), F.struct(F.col("page_no").alias("p"), right.cast("int").alias("c"), from_top(F.col("t"), F.col("height"), F.col("origin")).cast("double").alias("t")))
    start = F.struct(F.lit(0).cast("int").alias("p"), F.lit(0).alias("c"), F.lit(0.0).alias("t"))
    order = Window.partitionBy(doc).orderBy("item_seq")
    placed = placed.withColumn("key", F.coalesce(F.last(key, ignorenulls=True).over(order), start))
    placed = placed.withColumns({"place": F.row_number().over(Window.partitionBy(doc).orderBy("key", "item_seq")), "was": F.row_number().over(order)})
    return placed.withColumn("moved", F.max(F.col("place") != F.col("was")).over(Window.partitionBy(doc))).drop("key", "was", "two_columns")


def upright(matrix: Column) -> Column:
    """Written along the line, straight or upside down."""
    m = lambda i: F.abs(F.get(matrix, F.lit(i)))
    return m(0) + m(3) >= m(1) + m(2)


def straight(matrix: Column) -> Column:
    m = lambda i: F.get(matrix, F.lit(i))
    return (m(0) > 0) & (m(3) > 0) & (F.abs(m(1)) + F.abs(m(2)) < F.abs(m(0)) + F.abs(m(3)))


def upside_down(matrix: Column) -> Column:
    return (F.get(matrix, F.lit(0)) < -0.1) & (F.get(matrix, F.lit(3)) < -0.1)


def turned(matrix: Column) -> Column:
    """`btt` (read from bottom to top), `ttb`, or null for text that isn't turned by a right angle."""
    a, b, d = (F.get(matrix, F.lit(i)) for i in (0, 1, 3))
    return F.when((F.abs(a) <= 0.1) & (F.abs(d) <= 0.1), F.when(b > 0, "btt").otherwise("ttb"))


def page_direction(chars: DataFrame, keys: list[str], least: int = LEAST_ROTATED) -> DataFrame:
    """keys, direction (of most turned glyphs, null below `least`), rotated: more than half of the glyphs aren't upright."""
    seen = chars.filter(T.strip("text") != "").withColumns({"up": upright(F.col("matrix")), "way": turned(F.col("matrix"))})
    way = F.when(~F.col("up"), F.col("way"))
    n = lambda w: F.sum(F.coalesce(way == w, F.lit(False)).cast("int"))
    return seen.groupBy(*keys).agg(
        F.when(n("btt") + n("ttb") >= least, F.when(n("btt") >= n("ttb"), "btt").otherwise("ttb")).alias("direction"),
        (F.sum((~F.col("up")).cast("int")) * 2 > F.count("*")).alias("rotated"),
    )


def _near(df: DataFrame, x: Column, y: Column, spread: bool) -> DataFrame:
    """Adds bucket keys bx, by of the rounded place; spread: a row for each bucket, four at most, that a glyph within the
    tolerance can lie in."""
    bx, by = F.round(x).cast("long"), F.round(y).cast("long")
    if not spread:
        return df.withColumns({"bx": bx, "by": by})
    ends = lambda c: F.array_distinct(F.array(F.round(c - 2 * ORIGIN_TOLERANCE).cast("long"), F.round(c + 2 * ORIGIN_TOLERANCE).cast("long")))
    return df.withColumn("bx", F.explode(ends(x))).withColumn("by", F.explode(ends(y)))


def drop_hidden(chars: DataFrame, hidden: DataFrame, keys: list[str]) -> DataFrame:
    """chars (seq, text, fontname, matrix) without hidden glyphs (text, x, y) of the same origin, and blanks of their lines.

    Several hidden glyphs at one origin also stand for the ligature they make.
    """
    ox, oy = F.get("matrix", F.lit(4)), F.get("matrix", F.lit(5))
    spots = _near(hidden.withColumn("mark", F.when(F.col("text") == "￾", "-").otherwise(F.col("text"))).drop("text"), F.col("x"), F.col("y"), True)
    spots = spots.withColumn("hidden_seq", F.monotonically_increasing_id() if "seq" not in hidden.columns else F.col("seq")).select(*keys, "bx", "by", "x", "y", "mark", "hidden_seq")
    glyphs = _near(chars.filter(T.strip("text") != ""), ox, oy, False).withColumns({"ox": ox, "oy": oy})
    met = glyphs.join(spots, [*keys, "bx", "by"]).filter((F.abs(F.col("ox") - F.col("x")) <= ORIGIN_TOLERANCE) & (F.abs(F.col("oy") - F.col("y")) <= ORIGIN_TOLERANCE))
    marks = F.transform(F.array_sort(F.collect_list(F.struct("hidden_seq", "mark"))), lambda s: s["mark"])
    gone = met.groupBy(*keys, "seq", "text", "fontname", "oy").agg(marks.alias("marks"))
    gone = gone.filter(F.array_contains("marks", F.col("text")) | ((F.size("marks") > 1) & (F.array_join("marks", "") == F.col("text"))))
    rest = chars.join(gone.select(*keys, "seq"), [*keys, "seq"], "left_anti").withColumn("baseline", F.round(oy, 1))
    lines = gone.select(*keys, "fontname", F.round("oy", 1).alias("baseline"), F.lit(True).alias("line")).distinct()
    rest = rest.join(lines, [*keys, "fontname", "baseline"], "left")
    return rest.filter((T.strip("text") != "") | F.col("line").isNull()).select(*chars.columns)


def drop_blanks_over_letters(chars: DataFrame, keys: list[str]) -> DataFrame:
    """Without blanks of another font that lie over a letter of the same base line by more than half of their width."""
    flat = chars.filter(straight(F.col("matrix"))).withColumns({"band": F.floor(F.col("top") / BAND), "base": F.get("matrix", F.lit(5))})
    blank = T.strip("text") == ""
    over = flat.filter(~blank).select(*keys, "band", F.col("fontname").alias("f"), F.col("x0").alias("a"), F.col("x1").alias("b"), F.col("base").alias("y"))
    spaces = flat.filter(blank & (F.col("x1") > F.col("x0"))).withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    hit = (
        (F.col("f") != F.col("fontname")) & (F.least("x1", "b") - F.greatest("x0", "a") > (F.col("x1") - F.col("x0")) / 2) & (F.abs(F.col("base") - F.col("y")) < BASELINE)
    )
    gone = spaces.join(over, [*keys, "band"]).filter(hit).select(*keys, "seq").distinct()
    return chars.join(gone, [*keys, "seq"], "left_anti")


def drop_doubled(chars: DataFrame, keys: list[str]) -> DataFrame:
    """One glyph of each set with the same text and font at (about) one place: bold made by drawing twice."""
    same = [*keys, "text", "fontname", F.round("x0"), F.round("top")]
    return chars.withColumn("again", F.row_number().over(Window.partitionBy(*same).orderBy("seq"))).filter("again = 1").drop("again")


def outside(box: list[Column], area: list[Column]) -> Column:
    """Whether a box (x0, y0, x1, y1) lies wholly outside an area."""
    return (box[2] < area[0]) | (box[0] > area[2]) | (box[3] < area[1]) | (box[1] > area[3])


def clipped(box: list[Column], clips: Column) -> Column:
    """Outside any of the clip boxes (array of array of four), which intersect."""
    return F.coalesce(F.exists(clips, lambda c: outside(box, [F.get(c, F.lit(i)) for i in range(4)])), F.lit(False))


def on_page(chars: DataFrame) -> DataFrame:
    """Glyphs that are at least partly on their page (left, page_top, right, page_bottom), with upright set."""
    seen = (F.col("x1") > F.col("left")) & (F.col("x0") < F.col("right")) & (F.col("bottom") > F.col("page_top")) & (F.col("top") < F.col("page_bottom"))
    return chars.filter(seen).withColumn("upright", upright(F.col("matrix")))


def straightened(edges: DataFrame) -> DataFrame:
    """Edges (x0, x1, top, bottom) that are almost horizontal or vertical become so."""
    w, h = F.col("x1") - F.col("x0"), F.col("bottom") - F.col("top")
    flat = (h > 0) & (h <= NEARLY_STRAIGHT) & (w > NEARLY_STRAIGHT)
    tall = (w > 0) & (w <= NEARLY_STRAIGHT) & (h > NEARLY_STRAIGHT)
    y, x = (F.col("top") + F.col("bottom")) / 2, (F.col("x0") + F.col("x1")) / 2
    put = lambda when, mid, name: F.when(when, mid).otherwise(F.col(name))
    return edges.withColumns({"x0": put(tall, x, "x0"), "x1": put(tall, x, "x1"), "top": put(flat, y, "top"), "bottom": put(flat, y, "bottom")})


def in_region(chars: DataFrame, regions: DataFrame, keys: list[str], closed: bool = False) -> DataFrame:
    """Glyphs with the region (region_id, a, b, c, d) that holds their centre; closed regions own their far edges too."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    inside = (cx >= F.col("a")) & (cy >= F.col("b")) & ((cx <= F.col("c")) & (cy <= F.col("d")) if closed else (cx < F.col("c")) & (cy < F.col("d")))
    return chars.join(regions, keys).filter(inside)


def outside_tables(chars: DataFrame, tables: DataFrame, keys: list[str]) -> DataFrame:
    hit = in_region(chars, tables, keys, closed=True).select(*keys, "seq").distinct()
    return chars.join(hit, [*keys, "seq"], "left_anti")


def contained_tables(tables: DataFrame, keys: list[str]) -> DataFrame:
    """keys, table_id, inner_id: tables of which at least 90 % lies in a larger one of the page.

    Equal boxes of a page are compared once. The middle of a box lies in all that hold 90 % of it, so pairs meet in a cell of
    the page; boxes without an area are in every larger one, they and those without finite sides meet all of the page.
    """
    sides = ["x0", "top", "x1", "bottom"]
    area = lambda a, b, c, d: F.greatest(F.lit(0.0), c - a) * F.greatest(F.lit(0.0), d - b)
    mine, theirs = [F.col(c) for c in sides], [F.col(f"i_{c}") for c in sides]
    plain = area(*mine) > 0
    for c in mine:
        plain = plain & (F.abs(c) <= MOST_COORDINATE)
    boxes = tables.select(*keys, *sides).distinct().withColumn("plain", F.coalesce(plain, F.lit(False)))
    boxes = written(boxes.withColumn("box", F.monotonically_increasing_id()))
    even = boxes.filter("plain")
    page = even.groupBy(*keys).agg(F.min("x0").alias("px"), F.min("top").alias("py"), (F.max("x1") - F.min("x0")).alias("pw"), (F.max("bottom") - F.min("top")).alias("ph"))
    even = even.join(page, keys)
    column = lambda c: F.floor((c - F.col("px")) / F.col("pw") * PAGE_CELLS)
    row = lambda c: F.floor((c - F.col("py")) / F.col("ph") * PAGE_CELLS)
    outer = even.withColumn("cx", F.explode(F.sequence(column(F.col("x0")), column(F.col("x1"))))).withColumn("cy", F.explode(F.sequence(row(F.col("top")), row(F.col("bottom")))))
    named = lambda df, *more: df.select(*keys, F.col("box").alias("inner_box"), *[F.col(c).alias(f"i_{c}") for c in sides], *more)
    inner = named(even, column((F.col("x0") + F.col("x1")) / 2).alias("cx"), row((F.col("top") + F.col("bottom")) / 2).alias("cy"))
    common = area(F.greatest(mine[0], theirs[0]), F.greatest(mine[1], theirs[1]), F.least(mine[2], theirs[2]), F.least(mine[3], theirs[3]))
    holds = (area(*mine) > area(*theirs)) & (common >= INSIDE_SHARE * area(*theirs))
    pair = lambda met: met.filter(holds).select("box", "inner_box")
    odd = boxes.filter("not plain")
    pairs = pair(outer.join(inner, [*keys, "cx", "cy"])).unionByName(pair(boxes.join(named(odd), keys))).unionByName(pair(odd.join(named(boxes.filter("plain")), keys)))
    known = boxes.select(*[F.col(c).alias(f"_{c}") for c in (*keys, *sides)], "box")
    same = [tables[k] == known[f"_{k}"] for k in keys] + [tables[c].eqNullSafe(known[f"_{c}"]) for c in sides]
    members = tables.join(known, same).select(*keys, "table_id", "box")
    within = members.select(F.col("box").alias("inner_box"), F.col("table_id").alias("inner_id"))
    return members.join(pairs, "box").join(within, "inner_box").filter(F.col("table_id") != F.col("inner_id")).select(*keys, "table_id", "inner_id")


def word_amounts(words: DataFrame, keys: list[str]) -> DataFrame:
    """keys, amount, n: a three-digit amount takes the digits before it where both stand close on one base line."""
    order = Window.partitionBy(*keys).orderBy("seq")
    prev = lambda c: F.lag(c).over(order)
    way = F.coalesce("direction", F.lit("ltr"))
    rows = words.withColumns({"way": way, "p_text": prev("text"), "p_way": prev(way)} | {f"p_{c}": prev(c) for c in ("x0", "x1", "top")})
    gap = F.when(F.col("way") == "ltr", F.col("x0") - F.col("p_x1")).when(F.col("way") == "btt", F.col("p_top") - F.col("bottom"))
    level = F.when(F.col("way") == "ltr", F.abs(F.col("top") - F.col("p_top")) < 2).when(F.col("way") == "btt", F.abs(F.col("x0") - F.col("p_x0")) < 2)
    joins = F.col("text").rlike(r"^\p{Nd}{3}[,.]\p{Nd}{2}$") & F.col("p_text").rlike(r"^\p{Nd}{1,3}$") & level & gap.between(0, 4) & (F.col("p_way") == F.col("way"))
    value = F.when(F.coalesce(joins, F.lit(False)), F.concat("p_text", "text")).otherwise(F.col("text"))
    return rows.select(*keys, F.explode(T.amounts(value)).alias("amount")).groupBy(*keys, "amount").agg(F.count("*").alias("n"))


def glyph_lines(chars: DataFrame, keys: list[str]) -> DataFrame:
    """chars with line_id: glyphs whose tops, in order, are no more than the tolerance apart."""
    order = Window.partitionBy(*keys).orderBy("top", "seq")
    new = F.coalesce((F.col("top") - F.lag("top").over(order) > LINE_TOLERANCE).cast("int"), F.lit(0))
    return chars.withColumn("new", new).withColumn("line_id", F.sum("new").over(order)).drop("new")


def column_bands(chars: DataFrame, gutters: DataFrame, keys: list[str]) -> DataFrame:
    """keys, band, top, bottom, wide: runs of lines that cross the gutter or don't; a wide gap between them starts a new run."""
    lines = glyph_lines(chars.filter(T.strip("text") != ""), keys).join(gutters.filter("gutter is not null"), keys)
    lines = lines.withColumn("right", (F.col("x0") + F.col("x1")) / 2 >= F.col("gutter"))
    side = Window.partitionBy(*keys, "line_id", "right").orderBy("x0", "seq")
    gap = F.col("x0") - F.lag("x1").over(side)
    lines = lines.withColumn("gap", F.when(gap > SPACE_LEAST, gap))
    jump = F.min(F.when(F.col("right"), F.col("x0"))) - F.max(F.when(~F.col("right"), F.col("x1")))
    per = lines.groupBy(*keys, "line_id").agg(F.min("top").alias("top"), F.max("bottom").alias("bottom"), jump.alias("jump"), F.coalesce(F.max("gap"), F.lit(0.0)).alias("space"))
    wide = F.coalesce((F.col("jump") < LEAST_GUTTER) & ((F.col("jump") <= F.col("space") * SPACE_SLACK) | (F.col("jump") <= 1)), F.lit(False))
    page = Window.partitionBy(*keys)
    order = page.orderBy("top", "bottom", "line_id")
    heights = F.sort_array(F.collect_list(F.col("bottom") - F.col("top")).over(page))
    per = per.withColumn("wide", wide).withColumn("middle", F.get(heights, F.floor(F.size(heights) / 2).cast("int")))
    per = per.withColumns({"p_wide": F.lag("wide").over(order), "p_bottom": F.lag("bottom").over(order)})
    split = (F.col("p_wide") != F.col("wide")) | (~F.col("wide") & ~F.col("p_wide") & (F.col("top") - F.col("p_bottom") >= SECTION_JUMP * F.col("middle")))
    per = per.withColumn("band", F.sum(F.coalesce(split, F.lit(False)).cast("int")).over(order))
    return per.groupBy(*keys, "band").agg(F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.first("wide").alias("wide"))


def page_words(words: DataFrame, keys: list[str], tables: DataFrame | None = None, gutters: DataFrame | None = None) -> DataFrame:
    """keys, place, text: words in reading order: bands between tables, beside a table left before right, columns, lines, x.

    tables: keys, table_id, a, b, c, d (a word belongs by its centre); gutters: keys, gutter of pages in columns.
    """
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    rows = words.withColumns({"cx": cx, "cy": cy})
    if tables is not None:
        boxes = F.array_sort(F.collect_list(F.struct("b", "d", "a", "c", "table_id")))
        rows = rows.join(tables.groupBy(*keys).agg(boxes.alias("boxes")), keys, "left")
    else:
        rows = rows.withColumn("boxes", F.lit(None).cast("array<struct<b:double,d:double,a:double,c:double,table_id:int>>"))
    boxes = F.coalesce("boxes", F.array().cast("array<struct<b:double,d:double,a:double,c:double,table_id:int>>"))
    above = F.size(F.filter(boxes, lambda x: x["d"] <= F.col("cy")))
    beside = F.filter(boxes, lambda x: (x["b"] <= F.col("cy")) & (F.col("cy") < x["d"]))
    side = F.when(F.size(beside) == 0, 0).when(F.col("cx") < F.get(beside, F.lit(0))["a"], 1).when(F.col("cx") <= F.get(beside, F.lit(0))["c"], 2).otherwise(3)
    rows = rows.withColumns({"band": above * 2 + (F.size(beside) > 0).cast("int"), "side": side})
    if gutters is not None:
        rows = rows.join(gutters, keys, "left").withColumn("column", F.when(F.coalesce(F.col("cx") >= F.col("gutter"), F.lit(False)), 1).otherwise(0))
    else:
        rows = rows.withColumn("column", F.lit(0))
    area = [*keys, "band", "side", "column"]
    rows = glyph_lines(rows, area)
    order = Window.partitionBy(*keys).orderBy("band", "side", "column", "line_id", "x0", "seq")
    return rows.withColumn("place", F.row_number().over(order)).select(*keys, "place", "text")


def margin_pictures(pictures: DataFrame, page_texts: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, item_seq of pictures all of whose boxes are a small mark at the top of a page that names the bulletin.

    pictures: doc, item_seq, page_no, l, t, r, b (from the top), width, height; page_texts: doc, page_no, text.
    """
    named = page_texts.filter(F.col("text").contains(P.BULLETIN) | F.col("text").rlike(r"^BTE\s+\d+.*\z")).select(doc, "page_no").distinct().withColumn("named", F.lit(True))
    l, t, r, b, w, h = (F.col(c) for c in ("l", "t", "r", "b", "width", "height"))
    small = (t >= 0) & (t < b) & (b <= h * 0.075) & (l >= w * 0.43) & (l < r) & (r <= w * 0.57) & ((r - l) * (b - t) <= w * h * 0.005)
    seen = pictures.join(named, [doc, "page_no"], "left")
    return seen.groupBy(doc, "item_seq").agg(F.bool_and(F.coalesce(F.col("named") & small, F.lit(False))).alias("mark")).filter("mark").select(doc, "item_seq")


def image_pages(images: DataFrame, doc: str = "doc_id", share: float = 0.03) -> DataFrame:
    """doc, page_no with an image of at least 3 % of the page."""
    area = (F.col("x1") - F.col("x0")) * (F.col("bottom") - F.col("top"))
    return images.filter(area >= share * F.col("width") * F.col("height")).select(doc, "page_no").distinct()


def suspect_rotation(tables: DataFrame) -> DataFrame:
    """Tables more than twice as tall as wide."""
    return tables.filter(F.col("bottom") - F.col("top") > 2 * (F.col("x1") - F.col("x0")))


def blind_pages(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """keys, text, blind: pages where the first reader sees less than half of the second's characters use the second."""
    n = lambda c: F.length(F.regexp_replace(F.coalesce(c, F.lit("")), T.BLANK, ""))
    both = first.select(*keys, "text").join(second.select(*keys, F.col("text").alias("other")), keys, "left")
    blind = n(F.col("text")) < P.BLIND_SHARE * n(F.col("other"))
    return both.select(*keys, F.when(blind, F.col("other")).otherwise(F.col("text")).alias("text"), blind.alias("blind"))


def line_tolerance(chars: DataFrame, keys: list[str]) -> DataFrame:
    """keys, tolerance: what tells interleaved lines apart, or the usual one.

    Where three neighbours or more of a line overlap at different heights, half of the least such height counts if the
    glyphs then make up two full lines or more.
    """
    lines = glyph_lines(chars.filter(T.strip("text") != ""), keys)
    if "matrix" in chars.columns:
        lines = lines.filter(upright(F.col("matrix")))
    row = [*keys, "line_id"]
    order = Window.partitionBy(*row).orderBy("x0", "seq")
    width = F.col("x1") - F.col("x0")
    lines = lines.withColumns({"p_x1": F.lag("x1").over(order), "p_top": F.lag("top").over(order), "p_w": F.lag(width).over(order)})
    step = F.abs(F.col("top") - F.col("p_top"))
    over = (F.col("p_x1") - F.col("x0") > 0.3 * F.least("p_w", width)) & (step > 0.3)
    steps = lines.filter(over).groupBy(*row).agg(F.count("*").alias("n"), (F.min(step) / 2).alias("tolerance")).filter("n >= 3")
    inside = lines.join(steps.select(*row, "tolerance"), row)
    up = Window.partitionBy(*row).orderBy("top", "seq")
    new = F.coalesce((F.col("top") - F.lag("top").over(up) > F.col("tolerance")).cast("int"), F.lit(0))
    inside = inside.withColumn("new", new).withColumn("part", F.sum("new").over(up))
    parts = inside.groupBy(*row, "tolerance", "part").agg(F.count("*").alias("n"))
    full = F.col("n") >= 4
    good = parts.groupBy(*row, "tolerance").agg(F.sum(full.cast("int")).alias("k"), F.sum(F.when(full, F.col("n")).otherwise(0)).alias("held"), F.sum("n").alias("every"))
    found = good.filter((F.col("k") >= 2) & (F.col("held") >= 0.8 * F.col("every"))).groupBy(*keys).agg(F.min("tolerance").alias("tolerance"))
    return chars.select(*keys).distinct().join(found, keys, "left").withColumn("tolerance", F.coalesce("tolerance", F.lit(LINE_TOLERANCE)))


def turned_lines(words: DataFrame, keys: list[str]) -> DataFrame:
    """keys, line_no, text of turned words: lines follow x (falling for `ttb`), words follow the direction of reading."""
    way = F.when(F.col("direction") == "ttb", -1).otherwise(1)
    rows = words.withColumns({"across": F.col("x0") * way, "along": F.col("top") * -way})
    order = Window.partitionBy(*keys).orderBy("across", "seq")
    new = F.coalesce((F.col("across") - F.lag("across").over(order) > 2).cast("int"), F.lit(0))
    rows = rows.withColumn("new", new).withColumn("line_no", F.sum("new").over(order) + 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("along", "seq", "text"))), lambda x: x["text"]), " ")
    return rows.groupBy(*keys, "line_no").agg(text.alias("text"))
