"""Queries on odd rows against their SQL in DuckDB."""

import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from vellum.operators import bags, geometry, markdown
from vellum.plans.catalogue import ORACLES, QUERIES


def same(spark, folder, name, **tables):
    con = duckdb.connect()
    for table, columns in tables.items():
        pq.write_table(pa.table(columns), f"{folder}/{table}.parquet")
        con.sql(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet')")
    df, want = QUERIES[name](spark, str(folder)), con.sql(ORACLES[name])
    columns = sorted(df.columns)
    rows = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(r[c] for c in columns) for r in rows), key=repr)
    return got


def test_titles_with_other_references(spark, tmp_path):
    titles = ["a &amp", "&quot;b&quot; &lt;&gt;", "&amp;lt; &amp;amp;", "&Amp; &#38; &nbsp;", "", None]
    html = [None if t is None else f"<h1 class='x'>{t}</h1>" for t in titles] + ["no title"]
    got = same(spark, tmp_path, "q42_page_titles", pages={"page_id": list(range(7)), "html": html})
    assert (1, '&quot;b&quot; <>') in got


def test_other_callers_decode_every_reference(spark):
    df = spark.createDataFrame([(1, "&quot;a&quot; &amp &eacute;"), (2, None)], "k int, t string")
    assert {r.k: r.plain for r in markdown.unescaped(df, ["k"], "t").collect()} == {1: '"a" & é', 2: None}


def test_cells_of_odd_texts(spark, tmp_path):
    """No text at all, blanks that only Unicode knows, vertical tabs beside a line's end."""
    texts = ["", "\xa0a", "\x0bab", "a-\x0b\nb", "a-\n\x0bb", "\x85", "　x \n y", "\x1c-\n a", "-\n a", "-\n", " out", "\n", None, "a\x0b\n b-\n c", "0-\n\n é", "x\r\ny-\r\nz "]
    got = same(spark, tmp_path, "q48_cell_text", documents={"doc_id": list(range(len(texts))), "text": texts})
    assert len(got) == len(texts) - 3


def _bags(spark):
    from pyspark.sql import functions as F

    rng = random.Random(4)
    words = ["casa", "asac", "oxE", "Exo", "aba", "rato", "otar", "Lisboa", "aobsiL"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))
    rows = [(None if d == 9 else d, text(), text()) for d in range(10) for _ in range(1 + d % 3)] + [(11, None, "só"), (12, "só", None)]
    df = spark.createDataFrame(rows, "doc_id int, a string, b string")
    return df.select("doc_id", F.col("a").alias("text")), df.select("doc_id", F.col("b").alias("text"))


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_texts_are_compared_as_their_bags(spark):
    """Keys of several rows, null keys and texts; and one shuffle, of texts, whatever is made of the comparison."""
    a, b = _bags(spark)
    old = bags.compare_bags(bags.word_bag(a, ["doc_id"]), bags.word_bag(b, ["doc_id"]), ["doc_id"])
    new = bags.compare_texts(a, b, ["doc_id"])
    assert new.columns == old.columns and _rows(new) == _rows(old)
    made = {"coverage": bags.coverage(new, ["doc_id"]), "top": bags.top_words(new, ["doc_id"]), "same": bags.bags_equal(new, ["doc_id"]), "reversed": bags.reversed_words(new, ["doc_id"])}
    for name, df in made.items():
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.split("Initial Plan")[-1].count("Exchange ") == 1, (name, plan)


def test_reversed_words_of_bags(spark):
    a, b = _bags(spark)
    compared = bags.compare_texts(a, b, ["doc_id"])
    want, rows = [], compared.collect()
    lost = {(r.doc_id, r.word) for r in rows if r.missing > 0}
    for r in rows:
        if r.extra > 0 and len(r.word) >= 4 and ((r.doc_id, r.word[::-1]) in lost or re.match("[a-zà-ÿ]{2,}[A-ZÀ-Ý]$", r.word)):
            want.append((r.doc_id, r.word, r.word[::-1]))
    assert _rows(bags.reversed_words(compared, ["doc_id"])) == sorted(want, key=repr) and len(want) > 5


def test_page_losses_in_one_shuffle(spark):
    rng = random.Random(8)
    page = lambda: " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 6)))
    pages = [(d, p, page()) for d in range(12) for p in range(5)]
    texts = [(d, " ".join(page() for _ in range(4))) for d in range(11)]
    got = bags.page_loss(spark.createDataFrame(pages, "doc_id int, page_no int, text string"), spark.createDataFrame(texts, "doc_id int, text string"))
    want, left = [], {d: Counter(t.split()) for d, t in texts}
    for d, p, t in pages:
        own, rest = Counter(t.split()), left.setdefault(d, Counter())
        found = sum(min(n, rest[w]) for w, n in own.items())
        for w, n in own.items():
            rest[w] = max(0, rest[w] - n)
        if found < sum(own.values()):
            want.append((d, p, round(1 - found / sum(own.values()), 9)))
    assert sorted((r.doc_id, r.page_no, round(r.loss, 9)) for r in got.collect()) == sorted(want) and want
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange ") == 1


DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]


def test_frequent_margins_meet_in_parts(spark):
    """A language's pages and its common lines are joined with a salt, not in one task."""
    joins = [x for x in plan(QUERIES["q90_repeated_margins_removed"](spark, DATA)).split("\n") if "SortMergeJoin" in x and ("met" in x or "lang" in x)]
    assert any("salt" in x for x in joins)


@pytest.mark.parametrize("name", ["q06_amounts_roundtrip", "q07_amounts_reconciliation", "q57_amounts_by_place"])
def test_orders_are_spread_by_number(spark, name):
    """Line items are shuffled into a given number of partitions, and not again as words or amounts."""
    shown = plan(QUERIES[name](spark, DATA))
    assert "REPARTITION_BY_NUM" in shown and "ENSURE_REQUIREMENTS" not in shown


def test_furniture_is_found_once(spark):
    assert "Join" not in plan(QUERIES["q09_furniture_strip"](spark, DATA))


def test_markdown_is_read_in_parts(spark):
    one = spark.createDataFrame([(1, "# a")], "k int, t string").coalesce(1)
    assert "RoundRobinPartitioning" in plan(markdown.visible_text(one, ["k"], "t"))


def test_hidden_glyphs_go_to_four_buckets_at_most(spark):
    df = spark.createDataFrame([(x, y) for x in (1.0, 1.45, 7.55, -0.5) for y in (3.0, 3.5)], "x double, y double")
    near = geometry._near(df, df.x, df.y, True)
    counts = [r["count"] for r in near.groupBy("x", "y").count().collect()]
    assert max(counts) == 4 and min(counts) == 1
    for r in near.collect():
        assert abs(r.bx - r.x) <= 0.75 and abs(r.by - r.y) <= 0.75
