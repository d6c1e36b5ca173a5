"""Cases beyond former limits, against plain implementations: long texts, many documents, deep order, cut pages."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from vellum.functions.tables import register_tables
from vellum.operators import audit, bags, lines, report, structure


def test_alignment_is_difflibs():
    rng = random.Random(1)
    for _ in range(300):
        words = rng.choice([["a", "b"], list("abcdefgh"), [str(i) for i in range(60)]])
        ref = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        txt = [w for w in ref if rng.random() > 0.2] if rng.random() < 0.5 else [rng.choice(words) for _ in range(rng.randint(0, 60))]
        want = [tuple(m) for m in difflib.SequenceMatcher(None, ref, txt, autojunk=False).get_matching_blocks() if m.size]
        assert audit.matching_blocks(ref, txt) == want, (ref, txt)


def test_order_of_a_long_document(spark):
    """A scrambled document of 30,000 words is measured, and isn't OK."""
    rng = random.Random(2)
    known = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    words = [rng.choice(known) for _ in range(30_000)]
    shown = lambda ws: "\n".join(" ".join(ws[i : i + 10]) for i in range(0, len(ws), 10))
    mixed = words[20_000:] + words[:20_000]
    pages = spark.createDataFrame([("a", 1, shown(words)), ("b", 1, shown(words))], "doc_id string, page_no int, text string")
    texts = spark.createDataFrame([("a", shown(words)), ("b", shown(mixed))], "doc_id string, text string")
    got = {r.doc_id: r for r in audit.measure(pages, texts).collect()}
    assert (got["a"].order, got["a"].verdict) == (1.0, "OK") and got["b"].order < 0.7 and got["b"].verdict == "ATENÇÃO" and got["b"].coverage == 1.0
    skipped = {r.doc_id: r for r in audit.measure(pages, texts, with_order=False).collect()}
    assert all(r.order is None and r.order_skipped and r.verdict == "ATENÇÃO" for r in skipped.values())


def test_segments_are_cut(spark):
    ref = [f"palavra{i}" for i in range(100)]
    got = audit.order_similarity(spark.createDataFrame([(1, ref, ref[:3])], "doc_id int, reference array<string>, found array<string>")).first()
    assert [len(x) for x in got.missing_segments] == [300] and got.order == 0.03


def plain_join(texts):
    import re

    texts = [t.rstrip() for t in texts]
    for i in range(len(texts) - 1):
        after = texts[i + 1].lstrip()
        m = re.match(r"[a-zà-ÿ]\w*", after)
        if texts[i].endswith(("-", "￾")) and m:
            texts[i] = texts[i][:-1] + m[0]
            texts[i + 1] = after[m.end() :]
    return [re.sub("[-\x02\xad￾]\n(?=[a-zà-ÿ])", "", t).replace("￾", "-") for t in texts]


def test_pages_that_are_one_cut_word(spark):
    rng = random.Random(3)
    parts = ["traba-", " lha- ", "dor fim", "X de-", "", "pois", "-", "lhar e se-\nguir￾", "9 a"]
    docs = [[rng.choice(parts) for _ in range(rng.randint(1, 7))] for _ in range(120)]
    rows = [(d, k, t) for d, texts in enumerate(docs) for k, t in enumerate(texts)]
    got = lines.joined_pages(spark.createDataFrame(rows, "doc_id int, page_no int, text string")).collect()
    found = {(r.doc_id, r.page_no): r.text for r in got}
    for d, texts in enumerate(docs):
        assert [found[d, k] for k in range(len(texts))] == plain_join(texts), texts


def test_ends_of_long_lines():
    """Rules of a line's end see long words before it: they look at words, not at a number of characters."""
    for word in ("a" * 5000, "b" * 900 + " " * 3000):
        for end, goes_on in ((".", False), (",", True), (" revisão global", False)):
            prev, n = f"texto {word} segue{end}", 5
            assert structure._goes_on(prev, "minúscula aqui", n, False) == structure._goes_on(f"texto x segue{end}", "minúscula aqui", n, False) == goes_on
    assert structure._end("x " * 100 + "fim") == " ".join(["x"] * 39 + ["fim"])


def test_reports_list_every_document(spark):
    docs = spark.range(700).select(F.format_string("d%04d", "id").alias("doc_id"), F.when(F.col("id") % 100 == 0, "falhou").otherwise("ok").alias("state"), F.when(F.col("id") % 2 == 0, "blocked").otherwise("passed").alias("gate"))
    found = docs.filter("gate = 'blocked'").select("doc_id", F.lit(0).alias("seq"), F.lit("R*").alias("rule"), F.lit(3).alias("line"), F.lit("um *texto*").alias("message"), F.lit("error").alias("severity"))
    files = report.run_report(docs, report.union_findings(found), "r")
    assert files["diagnostic.md"].count("## ") == 700 and files["detalhes.md"].count("- error R*, linha 3: um \\*texto\\*") == 350
    assert files["diagnostic.md"].index("d0600: Falhou") < files["diagnostic.md"].index("d0002: Bloqueado") < files["diagnostic.md"].index("d0001: Sem alertas automáticos")


def test_links_and_attempts(spark):
    rows = [("/out/_auditoria/d.md", "/out/_auditoria/corridas/1", "../../d.md"), ("/out/a b/é(1).md", "/out", "a%20b/%C3%A9%281%29.md"), ("/x/y~.md", "/x", "y~.md"), ("/a/b", "/c", "../a/b")]
    df = spark.createDataFrame(rows, "path string, parent string, want string")
    got = df.select("want", report.report_link(F.col("path"), F.col("parent"), F.lit("a[b]")).alias("link")).collect()
    assert all(r.link == f"[a\\[b\\]](<{r.want}>)" for r in got), got
    manifest = spark.createDataFrame([("a", "nao_processado", "x"), ("b", "nao_processado", "y")], "doc_id string, state string, source string")
    tried = spark.createDataFrame([("a", "ok", "e"), ("c", "ok", "e")], "doc_id string, state string, error string")
    assert {tuple(r) for r in report.merge_attempts(manifest, tried).collect()} == {("a", "ok", "x", "e"), ("b", "nao_processado", "y", None)}


def test_short_passages(spark):
    texts = ["uma cláusula só", "nada", "um dois três quatro cinco seis sete oito nove dez", "", None, "oito nove"]
    passages = ["cláusula", "oito nove", "um dois três quatro cinco seis sete oito nove", "um dois três quatro cinco seis sete oito zero", "...", "", None, "láusula"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    items = spark.createDataFrame(list(enumerate(passages)), "item_id int, text string")
    got = {tuple(r) for r in bags.passages_in(docs, items).collect()}
    assert got == {(0, 0), (1, 2), (1, 5), (2, 2)}  # a passage that starts inside a word is none


def test_table_functions(spark):
    register_tables(spark)
    got = spark.sql("SELECT tipo, rotulo FROM structure_nodes('CAPÍTULO I\nGeral\nCláusula 1.ª\nÂmbito\nO texto fica em vigor.', null)").collect()
    assert [(r.tipo, r.rotulo) for r in got][:2] == [("capitulo", "CAPÍTULO I - Geral"), ("clausula", "Cláusula 1.ª - Âmbito")]
    got = spark.sql("SELECT d.k, b.kind, b.first FROM VALUES (1, '# a\n\ntexto'), (2, null) AS d(k, t), LATERAL markdown_blocks(d.t) AS b").collect()
    assert [(r.k, r.kind, r.first) for r in got] == [(1, "heading", 1), (1, "paragraph", 3)]


def test_a_failed_measure_is_a_finding(spark):
    texts = spark.createDataFrame([("a", "texto")], "doc_id string, text string")
    pages = spark.createDataFrame([("a", 1, "texto")], "doc_id string, page_no int, text string")
    bad = audit.unmeasured(texts, "ValueError: x")
    assert bad.first().verdict == "SEM MEDIDA"
    found = [(r.rule, r.severity) for r in audit.audit_findings(bad, pages, texts).collect()]
    assert found == [("COMPLETENESS_UNAVAILABLE", "error")]
    lost = spark.createDataFrame([("a", "ValueError: y"), ("b", None)], "doc_id string, error string")
    assert [(r.doc_id, r.rule) for r in audit.structure_errors(lost).collect()] == [("a", "STRUCTURE_UNAVAILABLE")]


@pytest.mark.parametrize("text", ["2\nlinha 2", " 1 \n\nfim"])
def test_numbers_at_ends_of_lines_stay(spark, text):
    """A line's own digits are no white space: strip takes nothing but what stands at its ends."""
    from vellum.operators.sanity import title_lines

    got = spark.createDataFrame([(text,)], "t string").select(title_lines(F.col("t")).alias("x")).first().x
    assert got == [x.strip() for x in text.split("\n") if x.strip()]


def test_documents_that_are_rows_need_no_shuffle(spark):
    texts = {1: ["CAPÍTULO I", "Geral", "Cláusula 1.ª", "Âmbito", "O texto fica", "em vigor."], 2: [], 3: None, 4: ["um texto", "que segue."]}
    rows = spark.createDataFrame(list(texts.items()), "doc_id int, lines array<string>")
    by_line = rows.select("doc_id", F.posexplode(F.col("lines")).alias("line_no", "text"))
    for new, old in ((structure.structured_rows(rows), structure.structured(by_line)),):
        want = {r.doc_id: (r.text, r.nodes) for r in old.collect()}
        got = {r.doc_id: (r.text, r.nodes) for r in new.collect()}
        assert {k: got[k] for k in want} == want and set(got) == {1, 2, 3, 4} and all(r.error is None for r in new.collect())
    assert "Exchange" not in structure.structured_rows(rows)._jdf.queryExecution().executedPlan().toString()
    want = {}
    for r in structure.joined(by_line).orderBy("doc_id", "line_no").collect():
        want.setdefault(r.doc_id, []).append(r.text)
    assert {r.doc_id: r.lines for r in structure.joined_rows(rows).collect()} == want | {2: [], 3: []}


def test_scratch_tables_can_be_cleared(spark):
    from vellum.sources import scratch

    scratch.clear(spark)
    kept = scratch.written(spark.range(3))
    assert kept.count() == 3 and scratch.clear(spark) == 1 and scratch.clear(spark) == 0
