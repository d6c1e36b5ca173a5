"""Scalar functions, on both sides of each threshold."""

import pytest
from pyspark.sql import functions as F

from vellum.functions import text as T


def values(spark, build, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", build("t").alias("r")).collect()
    return [r.r for r in sorted(rows)]


CASES = [
    (T.amounts, {"1 250,00 2.841,09 967,00 12.50": ["1250,00", "2841,09", "967,00", "12,50"], "13.149.130.89": ["13,149,130,89"], "1,234": [], "2 920,00": ["2920,00"], "": []}),
    (T.number_key, {
        "Cláusula 12.ª - Horário": "cl12", "CLÁUSULA DÉCIMA SEGUNDA - Horário": "cl12", "Cláusula 16.ª-A - Férias": "cl16A", "Artigo único - Âmbito": "arunico",
        "Cláusula prévia - Âmbito": "clprevia", "Cláusula de revisão": "clrevisao", "Cláusula VII-8 - Ajudas": "clVII-8", "Cláusula geral e transitória": None, "Cláusula civil": None, "Anexo I": None, "Artigo 007.º": "ar7",
    }),
    (T.ordinal_value, {"décima segunda": 12, "primeira décima": None, "centésima nonagésima nona": 199, "septuagésimo": 70, "setuagésimo": 70, "geral": None, "": None}),
    (T.is_furniture, {"Boletim do Trabalho e Emprego 31": True, "boletim do trabalho e emprego, n.º 31, 22/8/2026": True, "22 agosto 2026": True, "22 de agosto de 2026": False, "BTE 31 | 34": True, "BTE | 100": True, "no Boletim do Trabalho e Emprego, n.º 21": False}),
    (T.without_header_prefix, {"Boletim do Trabalho e Emprego 31 22 agosto 202 6 Deve ler-se:": "Deve ler-se:", "Boletim do Trabalho e Emprego, n.º 3 x": "Boletim do Trabalho e Emprego, n.º 3 x"}),
    (T.without_dated_header, {"fim Boletim do Trabalho e Emprego 28 29 agosto 2025": "fim", "a b": "a b"}),
    (T.has_furniture, {"x BTE 1 | 139 y": True, "BTE 1": True, "Boletim do Trabalho e Emprego 31 ANEX": True, "nada": False}),
    (T.whole_number, {"31.0": 31, "31.5": None, " 7 ": 7, "inf": None, "nan": None, "x": None, "": None}),
    (T.family, {"CCT-ALT": "convencao", "ACTV": "convencao", "Pct": "extensao", "AVISO": "aviso", "AA": "adesao", "ST": None, "": None}),
    (T.safe_name, {"a/b.pdf": "b.pdf", "..": None, "a/..": None, "a\\b": None, "": None, "a/b/": "b"}),
    (T.escaped_markdown, {"1. a": "1\\. a", "12) z": "12\\) z", "1.a": "1.a", "# x": "\\# x", "a*b_[c]<d>`\\": "a\\*b\\_\\[c\\]\\<d\\>\\`\\\\"}),
    (T.cell_text, {"estratégi-\nco": "estratégico", " a \n b ": "a b"}),
    (T.repaired_markers, {"Artigo 1. º": "Artigo 1.º", "3São": "3- São", "12.º": "12.º", "2025": "2025", "x\n3A EMEM": "x\n3- A EMEM"}),
    (T.joined_hyphens, {"traba-\nlhador": "trabalhador", "Traba-\nLhador": "Traba-\nLhador"}),
    (T.unix_lines, {"a\r\nb\rc": "a\nb\nc", "pro￾posta": "pro￾\nposta"}),
    (T.mostly_numbers, {"1 2 x y z": False, "1 2 3 x y z": True, "": False}),
    (T.is_reversed, {"sagloF": True, "abC": False, "aBcD": False, "ocincéT": True}),
    (T.item_text, {"BE": None, "BTE": None, "12": None, "22 de agosto de 2026": None, "profis -sional": "profissional", " a\n\tb ": "a b", "": None}),
    (T.normal_name, {"TIPO DE DOCUMENTO:": "tipodedocumento", "Nº DO BOLETIM:": "nºdoboletim", "Ação-É 1": "acaoe1"}),
    (T.title_of_file, {"a/b_c.pdf": "# b c"}),
    (T.subtype_of_file, {"x-RECT_1.pdf": "retificacao", "x.pdf": "desconhecido"}),
    (T.url_error, {
        "https://bte.dgcp.mtsss.gov.pt/a.pdf": None, "http://bte.dgcp.mtsss.gov.pt/a": "scheme", "https://bte.dgcp.mtsss.gov.pt.evil.com/": "host", "a/b": "scheme",
        "https://u:p@bte.dgcp.mtsss.gov.pt/": "authority", "https://bte.dgcp.mtsss.gov.pt:444/": "authority", "https://[bad/": "malformed",
    }),
    (T.fenced, {"x": "```text\nx\n```", "a```b": "````text\na```b\n````"}),
]


@pytest.mark.parametrize(("build", "cases"), CASES, ids=[c[0].__name__ for c in CASES])
def test_scalars(spark, build, cases):
    assert dict(zip(cases, values(spark, build, list(cases)), strict=True)) == cases
    values(spark, build, [None])


def test_list_items(spark):
    rows = [("1- x", None, None), ("3Idade", None, None), ("x", "a) x", "-"), ("x", None, "•"), ("x", None, None), ("- 1. y", None, None)]
    got = spark.createDataFrame(rows, "a string, b string, c string").select(T.list_item(F.col("a"), F.col("b"), F.col("c")).alias("r")).collect()
    assert [tuple(r.r) for r in got] == [("1- x", True), ("3- Idade", True), ("a) x", True), ("• x", True), ("- x", False), ("1. y", True)]


def test_repaired_words(spark):
    df = spark.createDataFrame([("o traba - lhador e traba - Lho, meio- dia", ["trabalhador"])], "t string, v array<string>")
    assert df.select(T.repaired_words(F.col("t"), F.col("v"))).first()[0] == "o trabalhador e traba - Lho, meio- dia"


def test_context(spark):
    df = spark.createDataFrame([("a" * 100 + " bom\n" + "z" * 100, "bom"), ("abom", "bom"), ("bom", "bom")], "t string, w string")
    got = [r[0] for r in df.select(T.context(F.col("t"), F.col("w"))).collect()]
    assert got[0].startswith("…a") and got[0].endswith("z…") and " bom ⏎ " in got[0] and got[1:] == ["", "bom"]


def test_registered_functions(spark):
    names = T.register_functions(spark)
    assert {"family", "url_error", "is_furniture"} <= set(names)
    assert spark.sql("SELECT family('CCT'), safe_name('a/b'), is_furniture('BTE 31')").first()[:] == ("convencao", "b", True)
