"""Word bags: counts, differences, coverage, losses by page. A bag difference is one aggregation over both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T


def word_bag(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, word, n, first_pos: how often each word occurs, and where it is first met."""
    exploded = df.select(*keys, F.posexplode(T.words(text)).alias("pos", "word"))
    return exploded.groupBy(*keys, "word").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


def array_bag(df: DataFrame, keys: list[str], items: str) -> DataFrame:
    return df.select(*keys, F.explode(items).alias("word")).groupBy(*keys, "word").agg(F.count("*").alias("n"), F.lit(0).alias("first_pos"))


def compare_bags(reference: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, word, n_reference, n_found, missing, extra and first positions; both sides meet in one shuffle."""
    left = reference.select(*keys, "word", F.col("n").alias("r"), F.lit(0).cast("long").alias("f"), F.col("first_pos").alias("rp"), F.lit(None).cast("int").alias("fp"))
    right = found.select(*keys, "word", F.lit(0).cast("long").alias("r"), F.col("n").alias("f"), F.lit(None).cast("int").alias("rp"), F.col("first_pos").alias("fp"))
    both = left.unionByName(right).groupBy(*keys, "word")
    both = both.agg(F.sum("r").alias("n_reference"), F.sum("f").alias("n_found"), F.min("rp").alias("reference_pos"), F.min("fp").alias("found_pos"))
    return _differences(both)


def _differences(both: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return both.withColumns({
        "missing": F.greatest(zero, F.col("n_reference") - F.col("n_found")), "extra": F.greatest(zero, F.col("n_found") - F.col("n_reference")),
    })


def together(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of a key in one partition, so that what groups by the keys and more shuffles no more.

    The number of partitions is given: texts become many times as many words, so they aren't put together by their bytes.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def compare_texts(reference: DataFrame, found: DataFrame, keys: list[str], text: str = "text", items: Callable[[str], Column] = T.words) -> DataFrame:
    """compare_bags of the bags of the texts' words (or other items): texts cross the network, once, and words don't."""
    sides = [df.select(*keys, F.lit(own).alias("own"), F.col(text).alias("_text")) for df, own in ((reference, True), (found, False))]
    words = together(sides[0].unionByName(sides[1]), keys).select(*keys, "own", F.posexplode(items("_text")).alias("pos", "word"))
    own, n = F.col("own"), lambda c: F.sum(F.when(c, 1).otherwise(0).cast("long"))
    both = words.groupBy(*keys, "word").agg(
        n(own).alias("n_reference"), n(~own).alias("n_found"), F.min(F.when(own, F.col("pos"))).alias("reference_pos"), F.min(F.when(~own, F.col("pos"))).alias("found_pos")
    )
    return _differences(both)


def coverage(compared: DataFrame, keys: list[str]) -> DataFrame:
    """keys, reference_words, found_words, coverage (1 without a reference), excess (0 without a text)."""
    sums = compared.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n_reference", "n_found", "missing", "extra")])
    return sums.select(
        *keys, F.col("n_reference").alias("reference_words"), F.col("n_found").alias("found_words"),
        F.when(F.col("n_reference") == 0, 1.0).otherwise(1 - F.col("missing") / F.col("n_reference")).alias("coverage"),
        F.when(F.col("n_found") == 0, 0.0).otherwise(F.col("extra") / F.col("n_found")).alias("excess"),
    )


def verdict(coverage: Column, excess: Column, order: Column, reversed_words: Column, residues: Column, long_lines: Column, error: Column | None = None, excluded: Column | None = None, skipped: Column | None = None) -> Column:
    """The lattice of verdicts; counts may be null where not measured. A null order has nothing to judge (a side without words);
    one that was skipped bars `OK`."""
    n = lambda c: F.coalesce(c, F.lit(0))
    no = F.lit(None).cast("string")
    fail = (coverage < P.COVERAGE_FAIL) | (n(reversed_words) >= P.FAIL_REVERSED)
    look = (coverage < P.COVERAGE_OK) | (excess > P.EXCESS_OK) | (F.coalesce(order, F.lit(1.0)) < P.ORDER_OK) | (n(reversed_words) + n(residues) + n(long_lines) > 0)
    look = look if skipped is None else look | skipped
    return (
        F.when((no if excluded is None else excluded).isNotNull(), "EXCLUÍDO")
        .when((no if error is None else error).isNotNull(), "SEM MEDIDA")
        .when(fail, "FALHA").when(look, "ATENÇÃO").otherwise("OK")
    )


def page_loss(pages: DataFrame, text: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, page_no, loss for pages with words that the text lacks; pages (key, page_no, text) use the text's words in order.

    A page finds what the pages before it left of each word: least(its count, total - counts before), none below zero.
    """
    every = pages.select(key, F.lit(True).alias("paged"), "page_no", "text").unionByName(text.filter(F.col(key).isNotNull()).select(key, F.lit(False).alias("paged"), F.lit(None).cast(pages.schema["page_no"].dataType).alias("page_no"), "text"))
    counts = together(every, [key]).select(key, "paged", "page_no", F.explode(T.words("text")).alias("word")).groupBy(key, "paged", "page_no", "word").agg(F.count("*").alias("c"))
    # A word's rows: the text's count first, then the pages in order. What goes before a page's row is what the pages before it leave.
    before = Window.partitionBy(key, "word").orderBy("paged", "page_no").rowsBetween(Window.unboundedPreceding, -1)
    left = F.coalesce(F.sum(F.when(F.col("paged"), -F.col("c")).otherwise(F.col("c"))).over(before), F.lit(0).cast("long"))
    found = F.greatest(F.lit(0).cast("long"), F.least(F.col("c"), left))
    per = counts.withColumn("found", found).filter("paged").groupBy(key, "page_no").agg((1 - F.sum("found") / F.sum("c")).alias("loss"))
    return per.filter("loss > 0")


def top_words(compared: DataFrame, keys: list[str], side: str = "missing", most: int = 25) -> DataFrame:
    """The words most missing (or extra), ties in the order they are first met, then by word."""
    pos = "reference_pos" if side == "missing" else "found_pos"
    rank = Window.partitionBy(*keys).orderBy(F.desc(side), F.asc_nulls_last(pos), "word")
    return compared.filter(F.col(side) > 0).withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= most).select(*keys, "rank", "word", F.col(side).alias("n"))


def reversed_words(compared: DataFrame, keys: list[str]) -> DataFrame:
    """keys, found, expected: extra words that are a missing word backwards, or have that shape."""
    changed = compared.filter("missing > 0 or extra > 0").select(*keys, "word", "missing", "extra").withColumn("_word", F.reverse("word"))
    # A word and its reverse stand in one window, of two rows at most.
    pair = Window.partitionBy(*keys, F.least("word", "_word"))
    both = changed.withColumn("lost", F.collect_list(F.when(F.col("missing") > 0, F.col("word"))).over(pair)).filter((F.col("extra") > 0) & (F.length("word") >= 4))
    return both.filter(F.array_contains("lost", F.col("_word")) | T.is_reversed("word")).select(*keys, F.col("word").alias("found"), F.col("_word").alias("expected"))


def bags_equal(compared: DataFrame, keys: list[str]) -> DataFrame:
    """keys, same: whether both bags hold the same words as often."""
    return compared.groupBy(*keys).agg(F.bool_and((F.col("missing") == 0) & (F.col("extra") == 0)).alias("same"))


def reconcile_amounts(reference: DataFrame, text: DataFrame, keys: list[str], column: str = "text") -> DataFrame:
    """keys, missing, extra (maps amount -> count) for documents whose amounts differ."""
    compared = compare_texts(reference, text, keys, column, T.amounts).filter("missing > 0 or extra > 0")
    entries = lambda side: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(side) > 0, F.struct("word", side)))))
    return compared.groupBy(*keys).agg(entries("missing").alias("missing"), entries("extra").alias("extra"))


def passages_in(texts: DataFrame, passages: DataFrame, doc: str = "doc_id", item: str = "item_id", size: int = 8) -> DataFrame:
    """item, doc of passages (item, text) that a text (doc, text) holds as they are; passages without a word are in none.

    A passage of fewer words than `size` is looked up by all of its words. Strings are built for candidates only: 64-bit
    hashes of word runs meet first, in the few run lengths that the passages have, and whole texts are compared last.
    """
    lookup = passages.select(item, F.col("text").alias("passage"), T.words("text").alias("w")).filter(F.size("w") > 0)
    lookup = lookup.select(item, "passage", F.least(F.size("w"), F.lit(size)).alias("k"), F.xxhash64(F.array_join(F.slice("w", 1, size), " ")).alias("h"))
    lengths = lookup.agg(F.sort_array(F.collect_set("k")).alias("ks"))  # at most `size` numbers
    rows = texts.select(doc, T.words("text").alias("w")).crossJoin(F.broadcast(lengths)).select(doc, "w", F.explode("ks").alias("k")).filter(F.size("w") >= F.col("k"))
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("k") + 1), lambda i: F.xxhash64(F.array_join(F.slice("w", i, F.col("k")), " ")))
    met = rows.select(doc, "k", F.explode(F.array_distinct(runs)).alias("h")).join(lookup.select("k", "h", item), ["k", "h"]).select(doc, item).distinct()
    both = met.join(texts.select(doc, "text"), doc).join(lookup.select(item, "passage"), item)
    return both.filter(F.contains("text", F.col("passage"))).select(item, doc).distinct()
