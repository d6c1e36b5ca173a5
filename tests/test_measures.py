"""Bags, furniture, completeness, geometry, tables, sanity."""

import random

import pytest
from pyspark.sql import functions as F

from vellum.operators import audit, bags, geometry, lines, report, sanity, structure, tables

BODY = "O trabalhador tem direito a férias pagas em cada ano de serviço efetivo prestado. "


def page(n, body):
    return f"Boletim do Trabalho e Emprego, n.º 31, 22/8/2026\n{body}\nBTE 31 | {n}"


def measured(spark, pages, text, **options):
    p = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(pages)], "doc_id long, page_no int, text string")
    return audit.measure(p, spark.createDataFrame([(1, text)], "doc_id long, text string"), **options).first(), p


def test_complete(spark):
    pages = [page(n, BODY * 3) for n in range(1, 6)]
    m, _ = measured(spark, pages, "\n".join([BODY * 3] * 5), with_order=True)
    assert (m.verdict, m.coverage, m.excess, m.order) == ("OK", 1.0, 0.0, 1.0)


def test_loss_is_seen_on_the_last_page(spark):
    pages = [BODY * 3] * 4
    text = "\n".join([BODY * 2] + [BODY * 3] * 3)
    m, p = measured(spark, pages, text)
    assert m.verdict in ("ATENÇÃO", "FALHA") and m.coverage < 0.995
    assert [r.page_no for r in bags.page_loss(p, spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()] == [4]


def test_reversed_and_residue(spark):
    m, _ = measured(spark, [BODY * 20 + "Folgas Serviço"], BODY * 20 + "sagloF oçivreS\nBoletim do Trabalho e Emprego 31")
    assert (m.reversed_words, m.residues, m.verdict) == (2, 1, "ATENÇÃO")


def test_collapsed_table(spark):
    rows = [f"Nível {i} | {i} 250,00 | {i} 300,00" for i in range(60)]
    m, _ = measured(spark, ["\n".join(rows)], " | ".join(rows))
    assert (m.coverage, m.long_lines, m.verdict) == (1.0, 1, "ATENÇÃO")
    m, _ = measured(spark, ["\n".join(rows)], "\n".join(rows))
    assert (m.long_lines, m.verdict) == (0, "OK")


def test_order_and_hyphens(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(200)) for x in "ab")
    m, _ = measured(spark, [a + "\n" + b], b + "\n" + a, with_order=True)
    assert m.coverage == 1.0 and m.order < 0.6 and m.verdict == "ATENÇÃO"
    m, _ = measured(spark, ["o traba-\nlhador"], "o trabalhador")
    assert m.coverage == 1.0
    m, _ = measured(spark, ["o traba-", "lhador vai"], "o trabalhador vai")
    assert m.coverage == 1.0


@pytest.mark.parametrize(("coverage", "excess", "order", "reversed_", "verdict"), [
    (1.0, 0.0, None, 0, "OK"), (0.995, 0.005, 0.97, 0, "OK"), (0.9949, 0.0, 1.0, 0, "ATENÇÃO"), (1.0, 0.0051, 1.0, 0, "ATENÇÃO"), (1.0, 0.0, 0.969, 0, "ATENÇÃO"),
    (0.97, 0.0, 1.0, 0, "ATENÇÃO"), (0.9699, 0.0, 1.0, 0, "FALHA"), (1.0, 0.0, 1.0, 4, "ATENÇÃO"), (1.0, 0.0, 1.0, 5, "FALHA"),
])
def test_verdict(spark, coverage, excess, order, reversed_, verdict):
    lit = lambda v, t="double": F.lit(v).cast(t)
    assert spark.range(1).select(bags.verdict(lit(coverage), lit(excess), lit(order), lit(reversed_, "int"), F.lit(0), F.lit(0))).first()[0] == verdict


def test_amounts(spark):
    a = spark.createDataFrame([(1, "1 250,00 e 10,00"), (2, "5,00")], "doc_id int, text string")
    b = spark.createDataFrame([(1, "1250,00 e 11,00"), (2, "5.00")], "doc_id int, text string")
    assert [tuple(r) for r in bags.reconcile_amounts(a, b, ["doc_id"]).collect()] == [(1, {"10,00": 1}, {"11,00": 1})]
    words = spark.createDataFrame([(1, 1, "2", 50.0, 55.0, 10.0, 20.0), (1, 2, "920,00", 200.0, 230.0, 10.0, 20.0), (1, 3, "2", 50.0, 55.0, 40.0, 50.0), (1, 4, "920,00", 57.0, 80.0, 40.5, 50.0)], "p int, seq int, text string, x0 double, x1 double, top double, bottom double").withColumn("direction", F.lit("ltr"))
    assert {(r.amount, r.n) for r in geometry.word_amounts(words, ["p"]).collect()} == {("920,00", 1), ("2920,00", 1)}


def test_furniture(spark):
    pages = [(n, page(n, f"Texto {n}\n{n}")) for n in range(1, 7)]
    rows = lines.to_lines(spark.createDataFrame([(1, n, t) for n, t in pages], "doc_id int, page_no int, text string"), ["doc_id", "page_no"])
    left = lines.remove_repeated(rows).groupBy("page_no").agg(F.array_sort(F.collect_list("text")).alias("t")).collect()
    assert {tuple(r.t) for r in left} == {(str(n), f"Texto {n}") for n in range(1, 7)}  # a number inside the margins only
    kept = lines.strip_furniture(rows, ["doc_id", "page_no"]).filter("text is not null")
    assert sorted({r.text for r in kept.collect()}) == [f"Texto {n}" for n in range(1, 7)]


def test_columns(spark):
    def words(across, left, right):
        rows = [(1, 290.0, 305.0)] * across + [(1, 50.0, 60.0)] * left + [(1, 400.0, 410.0)] * right
        df = spark.createDataFrame(rows, "page_no int, x0 double, x1 double").withColumns({"left": F.lit(0.0), "right": F.lit(595.0)})
        return geometry.word_columns(df, ["page_no"]).first().gutter

    assert words(0, 20, 20) == 297.5 and words(0, 20, 19) is None
    assert words(1, 50, 49) == 297.5 and words(2, 49, 49) is None
    assert words(0, 26, 74) == 297.5 and words(0, 25, 75) is None


def test_reading_order(spark):
    schema = "doc_id int, item_seq int, page_no int, l double, r double, t double, origin string"
    rows = [(1, 1, 1, 10.0, 200.0, 700.0, "BOTTOMLEFT"), (1, 2, 1, None, None, None, None), (1, 3, 1, 10.0, 200.0, 800.0, "BOTTOMLEFT"), (2, 1, 0, None, None, None, None)]
    df = spark.createDataFrame(rows, schema).withColumns({"width": F.lit(595.0), "height": F.lit(842.0)})
    got = {(r.doc_id, r.item_seq): (r.place, r.moved) for r in geometry.reading_order(df).collect()}
    assert got == {(1, 3): (1, True), (1, 1): (2, True), (1, 2): (3, True), (2, 1): (1, False)}


def glyphs(spark, rows):
    schema = "p int, seq int, text string, fontname string, x0 double, x1 double, top double, bottom double, matrix array<double>"
    return spark.createDataFrame(rows, schema)


def test_glyphs(spark):
    m = lambda x, y: [1.0, 0.0, 0.0, 1.0, x, y]
    rows = [(1, 1, "a", "F", 0.0, 5.0, 10.0, 20.0, m(0.0, 700.0)), (1, 2, "ﬁ", "F", 5.0, 10.0, 10.0, 20.0, m(5.0, 700.0)), (1, 3, " ", "F", 10.0, 12.0, 10.0, 20.0, m(10.0, 700.0)), (1, 4, "b", "F", 0.0, 5.0, 30.0, 40.0, m(0.0, 680.0)), (1, 5, " ", "G", 1.0, 3.0, 30.0, 40.0, m(1.0, 680.0))]
    chars = glyphs(spark, rows)
    hidden = spark.createDataFrame([(1, 1, "a", 0.05, 700.05), (1, 2, "f", 5.0, 700.0), (1, 3, "i", 5.0, 700.0)], "p int, seq int, text string, x double, y double")
    left = geometry.drop_hidden(chars, hidden.withColumn("text", F.col("text")), ["p"])
    assert {r.seq for r in left.collect()} == {2, 4, 5} or {r.seq for r in left.collect()} == {4, 5, 2}
    assert {r.seq for r in geometry.drop_blanks_over_letters(chars, ["p"]).collect()} == {1, 2, 3, 4}
    doubled = glyphs(spark, [*rows[:1], (1, 9, "a", "F", 0.2, 5.2, 10.1, 20.0, m(0.2, 700.0))])
    assert {r.seq for r in geometry.drop_doubled(doubled, ["p"]).collect()} == {1}


def test_rotation(spark):
    turn = [0.0, 1.0, -1.0, 0.0, 0.0, 0.0]
    rows = [(1, i, "x", "F", 0.0, 5.0, 0.0, 5.0, turn if i < 4 else [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]) for i in range(6)] + [(2, 1, "x", "F", 0.0, 5.0, 0.0, 5.0, turn)]
    got = {r.p: (r.direction, r.rotated) for r in geometry.page_direction(glyphs(spark, rows), ["p"]).collect()}
    assert got == {1: ("btt", True), 2: (None, True)}


def test_regions_and_bands(spark):
    t = spark.createDataFrame([(1, 1, 0.0, 0.0, 100.0, 100.0), (1, 2, 10.0, 10.0, 50.0, 50.0), (1, 3, 90.0, 90.0, 150.0, 150.0)], "p int, table_id int, x0 double, top double, x1 double, bottom double")
    assert [(r.table_id, r.inner_id) for r in geometry.contained_tables(t, ["p"]).collect()] == [(1, 2)]
    words = spark.createDataFrame([(1, i, w, x, x + 10, y, y + 8) for i, (w, x, y) in enumerate([("c", 10.0, 200.0), ("a", 10.0, 10.0), ("t", 100.0, 100.0), ("l", 10.0, 100.0), ("r", 300.0, 100.0)])], "p int, seq int, text string, x0 double, x1 double, top double, bottom double")
    boxes = spark.createDataFrame([(1, 1, 80.0, 90.0, 200.0, 130.0)], "p int, table_id int, a double, b double, c double, d double")
    order = [r.text for r in geometry.page_words(words, ["p"], boxes).orderBy("place").collect()]
    assert order == ["a", "l", "t", "r", "c"]
    rows = [(1, i, "x", "F", x, x + 5, y, y + 8, [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]) for i, (x, y) in enumerate([(10.0, 10.0), (400.0, 10.0), (285.0, 30.0), (292.0, 30.0), (299.0, 30.0), (10.0, 50.0), (400.0, 50.0)])]
    gutters = spark.createDataFrame([(1, 297.5)], "p int, gutter double")
    assert [(r.band, r.wide) for r in geometry.column_bands(glyphs(spark, rows), gutters, ["p"]).orderBy("band").collect()] == [(0, False), (1, True), (2, False)]


def test_grids(spark):
    rng = random.Random(11)
    rows = []
    for k in range(120):
        free, seq = {(r, c) for r in range(4) for c in range(4)}, 0
        while free:
            r, c = min(free)
            h, w = rng.randint(1, 2), rng.randint(1, 2)
            box = {(r + i, c + j) for i in range(h) for j in range(w)}
            if not box <= free:
                h, w, box = 1, 1, {(r, c)}
            free -= box
            rows.append((k, seq, f"v{seq}", r, r + h, c, c + w))
            seq += 1
    cells = spark.createDataFrame(rows, "k int, cell_seq int, text string, r0 int, r1 int, c0 int, c1 int")
    shown = tables.row_lines(cells, ["k"]).groupBy("k").agg(F.array_join(F.collect_list("text"), " | ").alias("t")).collect()
    want = {k: sorted(t for kk, _, t, *_ in rows if kk == k) for k in range(120)}
    assert {r.k: sorted(x for x in r.t.split(" | ") if x) for r in shown} == want
    grid = tables.grid(cells, ["k"]).filter("text <> ''").groupBy("k").agg(F.array_sort(F.collect_list("text")).alias("t")).collect()
    assert {r.k: r.t for r in grid} == want
    assert {r.overlaps for r in tables.table_checks(cells, ["k"]).collect()} == {0}


def test_overlap_keeps_both(spark):
    cells = spark.createDataFrame([(1, 0, "2.841,09", 0, 1, 0, 1), (1, 1, "2.896,39", 0, 1, 0, 1), (1, 2, "A|B", 0, 1, 1, 2)], "k int, cell_seq int, text string, r0 int, r1 int, c0 int, c1 int")
    assert tables.table_checks(cells, ["k"]).first().overlaps == 1
    rows = tables.grid_rows(cells, ["k"])
    assert rows.first().cells == ["2.841,09 / 2.896,39", "A|B"]
    assert "A\\|B" in tables.table_markdown(rows, ["k"]).first().markdown


def test_sanity(spark):
    text = {
        1: "Cláusula 1.ª\nÂmbito\nCláusula 2.ª\nFim\nsem ponto e mais palavras aqui\nDepositado em 3 de maio de 2025.",
        2: "Acordo - Retificação\nOnde se lê x, leia-se y.",
        3: "Artigo 1.º\nÂmbito\nAs cláusulas passam a ter a redação seguinte:\nCláusula 5.ª\nHorário\nTexto certo.\nDepositado em 3 de maio de 2025.\nSobra",
        4: "ANEXO I\nTabela salarial\nNada aqui.",
    }
    rows = [(d, i, x) for d, t in text.items() for i, x in enumerate(t.split("\n"))]
    docs = structure.structured(spark.createDataFrame(rows, "doc_id int, line_no int, text string"))
    got = {}
    for r in sanity.sanity_findings(docs).orderBy("doc_id", "seq").collect():
        got.setdefault(r.doc_id, []).append((r.severity, r.message))
    assert got[1] == [("warning", "1 cláusula(s)/artigo(s) sem corpo válido: Cláusula 1.ª - Âmbito: sem conteúdo")]
    assert got[2][0][0] == "info" and len(got[2]) == 1
    assert got[3] == [("warning", "1 linha(s) depois da nota de depósito — ordem de leitura suspeita (a primeira: «Sobra»)")]
    assert any("tabela perdida" in m for _, m in got[4]) and any("estrutura não reconhecida" in m for _, m in got[4])


def test_gates_and_reports(spark, tmp_path):
    docs = spark.createDataFrame([(i,) for i in range(4)], "doc_id int")
    f = spark.createDataFrame([(0, 0, "A", 0, "m", "error"), (1, 0, "B", 0, "m1", "warning"), (1, 1, "B", 0, "m2", "warning"), (2, 0, "C", 0, "m", "info")], "doc_id int, seq int, rule string, line int, message string, severity string")
    found = report.union_findings(f)
    gates = report.gates(docs, found)
    assert {r.doc_id: r.gate for r in gates.collect()} == {0: "blocked", 1: "review", 2: "passed", 3: "passed"}
    assert [(r.doc_id, r.rule, r.n, r.message) for r in report.review_actions(found).orderBy("doc_id").collect()] == [(0, "A", 1, "m"), (1, "B", 2, "m1")]
    report.write_reports(report.run_report(gates, found, "r1"), str(tmp_path), "r1")
    assert (tmp_path / "manifest.json").exists() and "B ×2: m1" in (tmp_path / "runs/r1/diagnostic.md").read_text()
    twice = report.duplicate_outputs(spark.createDataFrame([("A.md",), ("a.md",), ("b.md",), ("_auditoria/x.md",)], "path string"))
    assert {r.name for r in twice.collect()} == {"a.md", "_auditoria/x.md"}


def test_blind_pages(spark):
    a = spark.createDataFrame([(1, "abc"), (2, "abcde"), (3, "x")], "p int, text string")
    b = spark.createDataFrame([(1, "abcdefg"), (2, "abcdefghij"), (4, "y")], "p int, text string")
    assert [tuple(r) for r in geometry.blind_pages(a, b, ["p"]).orderBy("p").collect()] == [(1, "abcdefg", True), (2, "abcde", False), (3, "x", False)]


def test_boxes(spark):
    box = [F.lit(x) for x in (10.0, 10.0, 20.0, 20.0)]
    lit = lambda *b: F.array(*map(F.lit, b))
    got = spark.range(1).select(
        geometry.clipped(box, F.array(lit(0.0, 0.0, 30.0, 30.0), lit(21.0, 0.0, 30.0, 30.0))), geometry.clipped(box, F.array(lit(0.0, 0.0, 30.0, 30.0))), geometry.clipped(box, F.array(lit(20.0, 20.0, 30.0, 30.0))), geometry.clipped(box, F.lit(None).cast("array<array<double>>")),
    ).first()
    assert tuple(got) == (True, False, False, False)
    edges = spark.createDataFrame([(0.0, 100.0, 10.0, 10.4), (5.0, 5.3, 0.0, 90.0), (0.0, 100.0, 10.0, 11.0)], "x0 double, x1 double, top double, bottom double")
    assert [(round(r.top, 2), round(r.bottom, 2), round(r.x0, 2), round(r.x1, 2)) for r in geometry.straightened(edges).collect()] == [(10.2, 10.2, 0.0, 100.0), (0.0, 90.0, 5.15, 5.15), (10.0, 11.0, 0.0, 100.0)]
    t = spark.createDataFrame([(0.0, 10.0, 0.0, 21.0), (0.0, 10.0, 0.0, 20.0)], "x0 double, x1 double, top double, bottom double")
    assert geometry.suspect_rotation(t).count() == 1
    images = spark.createDataFrame([("d", 1, 0.0, 50.0, 0.0, 60.0), ("d", 2, 0.0, 50.0, 0.0, 59.0)], "doc_id string, page_no int, x0 double, x1 double, top double, bottom double").withColumns({"width": F.lit(100.0), "height": F.lit(1000.0)})
    assert [r.page_no for r in geometry.image_pages(images).collect()] == [1]


def test_margin_pictures(spark):
    rows = [("d", 1, 1, 280.0, 10.0, 310.0, 40.0), ("d", 2, 1, 280.0, 10.0, 310.0, 80.0), ("d", 3, 2, 280.0, 10.0, 310.0, 40.0), ("d", 4, 1, 10.0, 10.0, 40.0, 40.0)]
    pictures = spark.createDataFrame(rows, "doc_id string, item_seq int, page_no int, l double, t double, r double, b double").withColumns({"width": F.lit(595.0), "height": F.lit(842.0)})
    texts = spark.createDataFrame([("d", 1, "BTE 31 | 4"), ("d", 2, "texto")], "doc_id string, page_no int, text string")
    assert [r.item_seq for r in geometry.margin_pictures(pictures, texts).collect()] == [1]


def test_turned_pages(spark):
    words = spark.createDataFrame([(1, 1, "b", 10.0, 50.0, "btt"), (1, 2, "a", 10.5, 90.0, "btt"), (1, 3, "c", 30.0, 90.0, "btt"), (2, 1, "b", 10.0, 50.0, "ttb"), (2, 2, "c", 10.0, 90.0, "ttb"), (2, 3, "a", 30.0, 10.0, "ttb")], "p int, seq int, text string, x0 double, top double, direction string")
    assert [(r.p, r.text) for r in geometry.turned_lines(words, ["p"]).orderBy("p", "line_no").collect()] == [(1, "a b"), (1, "c"), (2, "a"), (2, "b c")]
    for way, want in (("btt", [["e", "c", "a"], ["f", "d", "b"]]), ("ttb", [["b", "d", "f"], ["a", "c", "e"]])):
        rows = [(1, r, c, v, way) for r, line in enumerate(["ab", "cd", "ef"]) for c, v in enumerate(line)]
        up = tables.set_upright(spark.createDataFrame(rows, "k int, row_no int, col_no int, text string, direction string"), ["k"])
        got = {(r.row_no, r.col_no): r.text for r in up.collect()}
        assert [[got[r, c] for c in range(3)] for r in range(2)] == want


def test_line_tolerance(spark):
    flat = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]
    woven = [(1, i, "x", "F", i * 2.0, i * 2.0 + 5, 10.0 + (i % 2) * 2, 20.0, flat) for i in range(10)]
    plain = [(2, i, "x", "F", i * 6.0, i * 6.0 + 5, 10.0 + (i % 2) * 2, 20.0, flat) for i in range(10)]
    stairs = [(3, i, "x", "F", i * 2.0, i * 2.0 + 5, 10.0 + i * 2, 20.0, flat) for i in range(10)]
    got = {r.p: r.tolerance for r in geometry.line_tolerance(glyphs(spark, woven + plain + stairs), ["p"]).collect()}
    assert got == {1: 1.0, 2: 3.0, 3: 3.0}


def test_structure_summary(spark):
    nodes = spark.createDataFrame([(1, "clausula", "b", 5), (1, "clausula", "a", 1), (1, "anexo", "x", 9)], "doc_id int, tipo string, rotulo string, char_start int")
    r = report.structure_summary(nodes).first()
    assert (r.clausula, r.anexo, r.labels) == (2, 1, ["a", "b"])


def test_equal_and_odd_tables_in_tables(spark):
    """Against all pairs: many equal boxes, no area, null, not a number, infinite, far out; and the plan holds no join of a page with itself."""
    rng, inf, nan = random.Random(9), float("inf"), float("nan")
    some = [(0.0, 0.0, 90.0, 90.0), (5.0, 5.0, 50.0, 50.0), (5.0, 5.0, 5.0, 50.0), (9.0, 9.0, 3.0, 50.0), (-1e300, 0.0, 1e300, 9.0), (0.0, 0.0, inf, 9.0), (-0.0, 0.0, 90.0, 90.0), (None, 1.0, 2.0, 3.0)]
    rows = [(p, i, *(rng.choice(some) if rng.random() < 0.3 else (x := rng.randint(0, 60) / 2, y := rng.randint(0, 60) / 2, x + rng.choice([1, 9, 10, 30]), y + rng.choice([1, 9, 10, 30])))) for p in (1, 2, None) for i in range(150)]
    rows += [(3, 1, 0.0, nan, 5.0, 9.0), (3, 2, 1.0, 1.0, 2.0, 2.0)]
    t = spark.createDataFrame(rows, "p int, table_id int, x0 double, top double, x1 double, bottom double")
    got = geometry.contained_tables(t, ["p"])
    o = t.select("p", F.col("table_id").alias("inner_id"), *[F.col(c).alias(f"i_{c}") for c in ("x0", "top", "x1", "bottom")])
    area = lambda a, b, c, d: f"greatest(0d, {c} - {a}) * greatest(0d, {d} - {b})"
    common = area("greatest(x0, i_x0)", "greatest(top, i_top)", "least(x1, i_x1)", "least(bottom, i_bottom)")
    mine, theirs = area("x0", "top", "x1", "bottom"), area("i_x0", "i_top", "i_x1", "i_bottom")
    want = t.join(o, "p").filter(f"table_id <> inner_id and {mine} > {theirs} and {common} >= 0.9d * {theirs}").select("p", "table_id", "inner_id")
    pairs = sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, got.collect())) == pairs and len(pairs) > 1000


def test_equal_boxes_are_compared_once(spark):
    """20,000 copies of two boxes a page hold 4 * 10^8 pairs of which none is made, as none holds another."""
    t = spark.range(20_000).selectExpr("1 as p", "id as table_id", "0d as x0", "0d as top", "cast(id % 2 + 1 as double) as x1", "cast(2 - id % 2 as double) as bottom")
    plan = geometry.contained_tables(t, ["p"])
    assert plan.count() == 0
    assert "x0" not in plan._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[1]
