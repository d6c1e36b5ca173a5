"""Collecting, converting, streaming, sources, the command line, the driver's entry."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from vellum import cli
from vellum.operators import collect
from vellum.plans import convert
from vellum.sources import readers, sinks

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LABELS = ["ANO:", "ID:", "TÍTULO DO DOCUMENTO:", "TIPO DE DOCUMENTO:", "Nº DO BOLETIM:", "OUTORGANTE(S):", "LINK PARA O DOCUMENTO:", "TIPO DE DOCUMENTO:", "DOCS ALTERADOS POR ESTE:", "DOCS ALTERADOS POR ESTE 2:"]
HOST = "https://bte.dgcp.mtsss.gov.pt"


@pytest.fixture(scope="module")
def index(spark):
    kinds = ["CCT", "CCT-ALT", "CCT-ALT", "AE", "AE-ALT", "AE-ALT-RECT", "ST"]
    rows = [("i", "s", i, ["2025", str(i), f"T{i}", k, "", "X", f"{HOST}/documentos/2025/{i + 7}/doc{i}.pdf", None, "A1", "A1" if i % 2 else "A2"]) for i, k in enumerate(kinds)]
    rows += [("i", "s", 10, ["", "", "", "", "", "", "", "", "", ""]), ("i", "s", 11, ["1800", "", "mau", "CCT", "", "", f"{HOST}/documentos/2025/7/x.pdf", "", "", ""]), ("i", "s", 12, ["", "", "sem pdf", "CCT", "", "", f"{HOST}/2025/7/x.html", "", "", ""])]
    rows += [("i", "s", 13, ["", "", "travessia", "CCT", "", "", f"{HOST}/documentos/2025/7/..", "", "", ""])]
    return spark.createDataFrame(rows, "file string, sheet string, position int, cells array<string>")


def test_index(spark, index):
    known = spark.createDataFrame([("2025/7/doc0", "h", "h"), ("2025/8/doc1", "h", "g")], "chave string, sha256 string, local_sha256 string")
    done = convert.collect_index(spark, index, known, LABELS)
    valid = {r.position: r for r in done["valid"].collect()}
    assert sorted(valid) == list(range(7)) and valid[3].chave == "2025/10/doc3" and valid[3].num_bte == 10
    assert (valid[1].altera, valid[2].altera) == ("A1", "A1; A2")
    assert sorted(r.position for r in done["rejected"].collect()) == [11, 12, 13]
    state = {r.chave: r.estado for r in done["decisions"].collect()}
    assert state["2025/7/doc0"] == "ja_existente" and state["2025/13/doc6"] == "ignorado" and sum(v == "por_descarregar" for v in state.values()) == 5
    limited = convert.collect_index(spark, index, known, LABELS, network=True, limit=2)["decisions"]
    assert sorted(r.chave for r in limited.filter("estado = 'descarregar'").collect()) == ["2025/8/doc1", "2025/9/doc2"]
    total = done["summary"].filter("estado is null and unknown is null").orderBy(F.desc("n")).first()
    assert total.n == 7
    with pytest.raises(ValueError):
        convert.collect_index(spark, index, known, LABELS, families=("outra",))


def test_registry(spark):
    texts = ['{"chave":"a","ano":2025,"x":1}', "", "nada", '{"ano":1}', '{"chave":"a","ano":2026}', '{"chave":"b","descarga":{"estado":"mau"}}', '{"chave":"c","nomeacao":{"ordinal":0}}']
    df = spark.createDataFrame(list(enumerate(texts)), "line_no int, value string")
    good, bad = collect.load_registry(df)
    assert [(r.chave, json.loads(r.entry)["ano"]) for r in good.collect()] == [("a", 2026)]
    assert {r.line_no: r.errors for r in bad.collect()} == {2: ["json"], 3: ["chave"], 5: ["descarga.estado"], 6: ["nomeacao.ordinal"]}
    base = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "chave string, ano int, nota string")
    new = spark.createDataFrame([("a", 5), ("b", None), ("c", 7)], "chave string, ano int")
    assert {tuple(r) for r in collect.upsert(base, new, ["ano"]).collect()} == {("a", 5, "x"), ("b", 2, "y"), ("c", 7, None)}


def test_downloads(spark):
    rows = [(f"{HOST}/a", 200, b"%PDF-1", None, None), (f"{HOST}/a", 304, b"", None, None), (f"{HOST}/a", 404, b"", None, None), (f"{HOST}/a", 200, b"<html>", None, None), ("http://x/", 200, b"%PDF", None, None), (f"{HOST}/a", 200, b"%PDF-1", None, "other")]
    df = spark.createDataFrame(rows, "url string, status int, body binary, recorded string, local string")
    got = [r.r.estado for r in df.select(collect.download_outcome(*[F.col(c) for c in df.columns]).alias("r")).collect()]
    assert got == ["descarregado", "falhado", "falhado", "falhado", "falhado", "falhado"]
    items = spark.createDataFrame([("k", f"{HOST}/a"), ("z", "http://evil/")], "chave string, url string")
    found = collect.fetch(items, lambda url, asked: (200, {"etag": "e"}, b"%PDF"), pause=0).collect()
    assert [(r.chave, r.status, r.headers) for r in found] == [("k", 200, {"etag": "e"})]


ITEMS = "doc_id string, item_seq int, kind string, text string, orig string, marker string, page_no int, l double, t double, r double, b double, origin string, width double, height double"


@pytest.fixture(scope="module")
def layout(spark):
    texts = [("text", "CAPÍTULO I"), ("text", "Disposições gerais"), ("text", "Cláusula 1.ª"), ("text", "Âmbito"), ("list", "2Sem prejuízo do disposto."), ("text", "BTE 31 | 4"), ("text", "ANEXO I"), ("text", "Tabela salarial"), ("table", None), ("text", "Lisboa, 12 de maio de 2025.")]
    items = [("d", i, k, t, None, None, 1, 10.0, 10.0 + i * 20, 500.0, 20.0 + i * 20, "TOPLEFT", 595.0, 842.0) for i, (k, t) in enumerate(texts)]
    cells = [("d", 8, 0, "Nível", 0, 1, 0, 1), ("d", 8, 1, "A|B", 0, 1, 1, 2), ("d", 8, 2, "I", 1, 2, 0, 1), ("d", 8, 3, "920,00", 1, 2, 1, 2)]
    pages = [("d", 1, "CAPÍTULO I\nDisposições gerais\nCláusula 1.ª\nÂmbito\n2- Sem prejuízo do disposto.\nBTE 31 | 4\nANEXO I\nTabela salarial\nNível A|B\nI 920,00\nLisboa, 12 de maio de 2025.")]
    return spark.createDataFrame(items, ITEMS), spark.createDataFrame(cells, readers.CONTRACT["cells"]), spark.createDataFrame(pages, "doc_id string, page_no int, text string")


def test_convert(spark, layout, tmp_path):
    done = convert.convert(*layout, with_order=True)
    md = done["rendered"].first().markdown
    assert "## CAPÍTULO I - Disposições gerais" in md and "### Cláusula 1.ª - Âmbito" in md and "2- Sem prejuízo do disposto." in md
    assert "| Nível | A\\|B   |" in md and "BTE" not in md
    found = [(r.rule, r.severity) for r in done["findings"].collect()]
    assert ("RENDER_CONTENT", "error") not in found and ("AMOUNTS", "error") not in found and ("COMPLETENESS", "error") not in found
    m = done["measures"].first()
    assert m.coverage == 1.0 and m.order == 1.0 and done["gates"].first().gate == "review"
    n = sinks.write_documents(done["rendered"], str(tmp_path))
    assert n == 1 and (tmp_path / "d.md").read_text() == md
    with pytest.raises(FileExistsError):
        sinks.write_documents(done["rendered"], str(tmp_path))
    more = spark.createDataFrame([("d", "1", "2", "{}"), ("e/f", "3", None, "[]")], "doc_id string, markdown string, raw string, quality string")
    with pytest.raises(FileExistsError):  # and no file of any set is written
        sinks.write_documents(more, str(tmp_path))
    assert not (tmp_path / "e").exists() and not (tmp_path / "_auditoria").exists()
    assert sinks.write_documents(more, str(tmp_path), overwrite=True) == 2
    assert (tmp_path / "_auditoria/e/f.qualidade.json").read_text() == "[]" and (tmp_path / "d.md").read_text() == "1" and not (tmp_path / "_auditoria/e/f.layout.md").exists()
    with pytest.raises(Exception, match="outside"):
        sinks.write_documents(more.withColumn("doc_id", F.lit("../x")), str(tmp_path))


def test_command_line(spark, layout, tmp_path, capsys):
    for name, df in zip(("items", "cells", "pages"), layout, strict=True):
        df.write.parquet(f"{tmp_path}/in/{name}")
    assert cli.main(["convert", f"{tmp_path}/in", f"{tmp_path}/out"]) == 0
    assert cli.main(["convert", f"{tmp_path}/in", f"{tmp_path}/out2", "--strict"]) == 2
    assert json.loads((tmp_path / "out/_auditoria/manifest.json").read_text())["totals"]
    (tmp_path / "md/_auditoria").mkdir(parents=True)
    (tmp_path / "md/a.md").write_text("# a\n### b\n")
    (tmp_path / "md/_auditoria/x.md").write_text("- 1. x")
    assert cli.main(["lint", f"{tmp_path}/md"]) == 0 and cli.main(["lint", f"{tmp_path}/md", "--strict"]) == 2
    assert [json.loads(x)["rule"] for x in capsys.readouterr().out.splitlines()] == ["MD001"] * 2
    (tmp_path / "i.csv").write_text("Ano,Titulo,TipoSubTipoDoc,URLPDF\n2025,T,CCT," + HOST + "/documentos/2025/3/a.pdf\n,U,ST," + HOST + "/documentos/2025/4/b.pdf\n")
    (tmp_path / "r.jsonl").write_text('{"chave":"z"}\n')
    assert cli.main(["collect", f"{tmp_path}/i.csv", f"{tmp_path}/r.jsonl", f"{tmp_path}/here"]) == 0
    assert "por_descarregar 1" in capsys.readouterr().out
    after = {x["chave"]: x for x in map(json.loads, "".join(p.read_text() for p in (tmp_path / "r.jsonl.new").glob("part*")).splitlines())}
    assert after["z"] == {"chave": "z"} and after["2025/3/a"]["descarga"]["estado"] == "por_descarregar"


def test_sheets(spark, tmp_path):
    """Every sheet has its own header; sheets that are no index and files that can't be read are told or left out."""
    (tmp_path / "one.bin").write_bytes(b"one")
    (tmp_path / "two.bin").write_bytes(b"two")
    (tmp_path / "bad.bin").write_bytes(b"bad")
    url = HOST + "/documentos/2025/3/"

    def reader(content):
        if content == b"bad":
            raise ValueError("no book")
        if content == b"two":
            return [("notes", [["a", "b"], ["1", "2"]]), ("empty", [])]
        return [("s1", [["Ano", "Título", "URL PDF"], [2025, "T", url + "a.pdf"], [None, "T", url + "a.pdf"]]), ("s2", [["URLPDF", "Titulo", "TipoSubTipoDoc", "Tipo de documento"], [url + "b.pdf", "U", "", "CCT"]]), ("x", [["k"], ["v"]])]

    rows = readers.index_rows(spark, str(tmp_path), reader)
    got = sorted((r.file, r.sheet, r.position, r.problem) for r in rows.collect() if r.problem is None)
    assert got == [("one.bin", "s1", 1, None), ("one.bin", "s1", 2, None), ("one.bin", "s2", 1, None)]
    assert sorted(r.file for r in rows.filter("problem is not null").collect()) == ["bad.bin", "two.bin"]
    items = collect.complete_items(collect.project_index(rows.filter("problem is null")))
    assert {(r.sheet, r.position, r.chave, r.familia) for r in items.collect()} == {("s1", 1, "2025/3/a", None), ("s1", 2, "2025/3/a", None), ("s2", 1, "2025/3/b", "convencao")}


def test_whole_collect_run(spark, tmp_path):
    """Two runs: the first downloads, with tries and faults; the second finds what is there and keeps other fields of entries."""
    url = HOST + "/documentos/2025/3/"
    rows = [("i", "s", k, ["Ano", "Titulo", "TipoSubTipoDoc", "URLPDF"], ["2025", "T", "CCT" if k < 4 else "ST", url + f"{n}.pdf"], None) for k, n in enumerate("abcde")]
    rows = spark.createDataFrame(rows, "file string, sheet string, position long, header array<string>, cells array<string>, problem string")
    entries = spark.createDataFrame([("2025/3/a", '{"chave":"2025/3/a","nota":{"x":[1,"ú"]},"descarga":{"estado":"falhado","data":"ontem"}}'), ("old", '{"chave":"old"}')], "chave string, entry string")
    answers = {"a": (200, {"ETag": "e1"}, b"%PDF-a"), "b": (404, {}, b""), "c": (200, {}, b"<html>"), "d": (500, {}, b"")}
    folder = str(tmp_path / "docs")
    done = convert.collect_run(spark, rows, entries, folder, lambda u, asked: answers[u[-5]], families=("convencao",))
    state = {r.chave[-1]: (r.estado, r.erro) for r in done["downloads"].collect()}
    assert state == {"a": ("descarregado", None), "b": ("falhado", "HTTP 404"), "c": ("falhado", "a resposta não é um PDF"), "d": ("falhado", "HTTP 500"), "e": ("ignorado", None)}
    assert (tmp_path / "docs/2025/3/a.pdf").read_bytes() == b"%PDF-a" and len(list((tmp_path / "docs").rglob("*.*"))) == 1
    kept = {r.chave: json.loads(r.entry) for r in done["registry"].collect()}
    assert kept["old"] == {"chave": "old"} and kept["2025/3/a"]["nota"] == {"x": [1, "ú"]} and kept["2025/3/a"]["descarga"]["data"] == "ontem"
    assert kept["2025/3/a"]["descarga"]["etag"] == "e1" and kept["2025/3/e"]["descarga"]["motivo"].startswith("tipo desconhecido")
    again = convert.collect_run(spark, rows, done["registry"], folder, None, families=("convencao",))
    assert {r.chave[-1]: r.estado for r in again["downloads"].collect()} == {"a": "ja_existente", "b": "por_descarregar", "c": "por_descarregar", "d": "por_descarregar", "e": "ignorado"}


def test_fetching(spark):
    """Faults are tried again after longer waits, client errors aren't; a recorded copy at hand makes a request conditional."""
    seen = []

    def fetcher(url, asked):
        return {"a": (500, {}, b""), "b": (404, {}, b""), "c": (200, {"x": json.dumps(asked)}, b"%PDF"), "d": (200, {"x": json.dumps(asked)}, b"%PDF")}[url[-1]]

    items = spark.createDataFrame([(k, f"{HOST}/{k}", "e", None, k == "d") for k in "abcd"], "chave string, url string, etag string, last_modified string, at_hand boolean").coalesce(1)
    got = {r.chave: r for r in collect.fetch(items, fetcher, wait=lambda s: None).collect()}
    assert (got["a"].status, got["b"].status, got["c"].headers["x"], got["d"].headers["x"]) == (500, 404, "{}", '{"If-None-Match": "e"}') and not seen
    ok = [collect.allowed_url(u) for u in (f"{HOST}/x", f"{HOST}:443/x", "http://bte.dgcp.mtsss.gov.pt/", "https://evil/", f"{HOST}:99/", f"{HOST}:x/", HOST.replace("//", "//u:p@"))]
    assert ok == [True, True, False, False, False, False, False]


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, body in (("a/X.PDF", b"1"), ("b.pdf", b"22"), ("c.txt", b"3")):
        (tmp_path / name).write_bytes(body)
    found = readers.discover(spark, str(tmp_path))
    assert [(r.target, r.bytes) for r in found.collect()] == [("a/X.md", 1), ("b.md", 2)]
    facts = spark.createDataFrame([(1, 10, False), (1, 501, False), (101 << 20, 1, False), (1, 1, True)], "bytes long, pages int, encrypted boolean")
    assert [r.reason is None for r in readers.refused(facts).collect()] == [True, False, False, False]
    lay = readers.hashed(spark, str(tmp_path)).withColumn("stem", F.lower("stem"))
    quality = lay.select("stem", F.col("sha256").alias("source_sha256"), F.when(F.col("stem") == "b", "old").otherwise(F.col("sha256")).alias("document_sha256")).filter("stem <> 'c'")
    assert {r.stem: r.state for r in readers.cached_layouts(lay, lay, quality).collect()} == {"x": "valid", "b": "stale_layout", "c": "missing"}
    (tmp_path / "l.json").write_text(json.dumps({"name": "d", "texts": [{"label": "list_item", "text": "x", "orig": "a) x", "prov": [{"page_no": 2, "bbox": {"l": 1, "t": 2, "r": 3, "b": 4, "coord_origin": "BOTTOMLEFT"}}]}]}))
    row = readers.layout_items(spark, f"{tmp_path}/l.json").first()
    assert (row.doc_id, row.kind, row.page_no, row.l, row.origin) == ("d", "list", 2, 1.0, "BOTTOMLEFT")
    assert readers.contract(spark, "pages").columns[:2] == ["doc_id", "page_no"]
    sinks.write_registry(spark.createDataFrame([("b", "2"), ("a", "1")], "chave string, entry string"), f"{tmp_path}/reg", 1)
    assert [r.value for r in readers.text_lines(spark, f"{tmp_path}/reg").filter("value <> ''").orderBy("line_no").collect()] == ["1", "2"]


def test_stream(spark, tmp_path):
    from vellum.streaming.registry import deduplicated, keep_registry, versions

    schema = "chave string, ano int, num_bte int, tipo string, familia string, titulo string, url string, ficheiro string, seen_at timestamp"
    path = f"{tmp_path}/in"

    def put(*rows):
        df = spark.createDataFrame([(k, y, 1, "CCT", "convencao", t, "", "") for k, y, t in rows], schema.rsplit(",", 1)[0])
        df.withColumn("seen_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)

    put(("a", 2024, "um"), ("b", 2025, "dois"))
    items = deduplicated(spark.readStream.schema(schema).parquet(path))
    keep_registry(items, f"{tmp_path}/reg", f"{tmp_path}/cp").awaitTermination()
    put(("c", 2026, "três"))
    keep_registry(items, f"{tmp_path}/reg", f"{tmp_path}/cp").awaitTermination()
    read, _ = versions(f"{tmp_path}/reg")
    assert {(r.chave, r.ano) for r in read(spark).collect()} == {("a", 2024), ("b", 2025), ("c", 2026)}


def test_entry_without_the_corpus_package(tmp_path):
    """With the corpus operators gone, the entry still imports and has the other queries."""
    for name in ("vellum", "__spark_entry__.py"):
        os.symlink(f"{HERE}/{name}", tmp_path / name) if name.endswith(".py") else None
    os.makedirs(tmp_path / "vellum")
    for part in os.listdir(f"{HERE}/vellum"):
        if part not in ("llm", "__pycache__"):
            os.symlink(f"{HERE}/vellum/{part}", tmp_path / "vellum" / part)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) >= 45 and not [n for n in q if n.startswith('op') or n == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    run = subprocess.run([sys.executable, "-P", "-c", f"import sys; sys.path.insert(0, {str(tmp_path)!r}); {code}"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr


def test_entry(spark):
    sys.path.insert(0, HERE)
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["gate", "state", "quality", "n", "findings"]
    assert len([n for n in e.queries() if n.startswith("q")]) >= 95
