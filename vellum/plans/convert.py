"""Whole runs: layout items to Markdown with findings and gates, an index to registry decisions, Markdown to findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators import audit, bags, collect, geometry, lines, markdown, report, structure, tables
from ..sources import readers
from ..sources.scratch import written


def item_lines(items: DataFrame, doc: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """doc, item_seq, k, text of text and list items, cleaned; and the findings of lists without a marker."""
    cleaned = T.without_header_prefix(T.item_text("text"))
    rows = items.filter(F.col("kind").isin("text", "list", "heading", "title")).withColumn("clean", F.coalesce(cleaned, F.when(T.strip("text").rlike(r"^\p{Nd}+$"), T.strip("text"))))
    rows = rows.filter((F.coalesce("clean", F.lit("")) != "") & ~T.is_furniture("clean"))
    rows = rows.withColumn("clean", F.regexp_replace("clean", P.FUSED_LETTER, ";\n$1"))
    item = T.list_item(F.col("clean"), F.col("orig"), F.col("marker"))
    rows = rows.withColumn("item", F.when(F.col("kind") == "list", item).otherwise(F.struct(F.col("clean").alias("text"), F.lit(True).alias("recovered"))))
    lost = rows.filter(~F.col("item.recovered")).select(
        doc, F.col("item_seq").alias("seq"), F.lit("LIST_MARKER").alias("rule"), F.lit(0).alias("line"), F.lit("Item de lista sem marcador recuperável; conferir no PDF.").alias("message"), F.lit("warning").alias("severity")
    )
    return rows.select(doc, "item_seq", "place", F.posexplode(F.split("item.text", "\n")).alias("k", "text")), lost


def table_lines(cells: DataFrame, items: DataFrame, doc: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines that stand for tables, Markdown by line, and the findings of tables."""
    keys = [doc, "item_seq"]
    rows = tables.grid_rows(cells, keys)
    checks = tables.table_checks(cells, keys)
    title = (F.length("first").between(1, P.MOST_TITLE)) & ~T.one_of(F.col("first"), P.LIST_LINE, P.SIGNING_DATE, P.REVOKED, P.ONLY_OMITTED, *P.HEADINGS.values())
    prose = tables.prose_tables(rows, keys, title)
    finding = lambda df, rule, severity, message: df.select(doc, F.col("item_seq").alias("seq"), F.lit(rule).alias("rule"), F.lit(0).alias("line"), F.lit(message).alias("message"), F.lit(severity).alias("severity"))
    empty, kept = checks.filter("is_empty"), checks.filter("not is_empty").join(prose, keys, "left_anti")
    found = report.union_findings(
        finding(empty, "TABLE_EMPTY", "error", "Tabela sem conteúdo."), finding(checks.filter("overlaps > 0"), "TABLE_OVERLAP", "error", "Células com posições sobrepostas: todos os textos foram preservados, mas a correspondência entre linhas e colunas exige revisão."),
        finding(prose, "TABLE_AS_TEXT", "info", "Título e números legais numa tabela de uma célula por linha foram recuperados como texto."), finding(kept.filter("has_span"), "TABLE_SPAN", "warning", "Células unidas; continuações vazias preservam a grelha. Conferir no PDF."), doc=doc,
    ).drop("source_rank")
    key = F.concat(F.lit("TABELA "), F.col("item_seq").cast("string"), F.lit(" | FIM"))
    stand = kept.join(items.select(doc, "item_seq", "place"), keys).select(doc, "item_seq", "place", F.lit(0).alias("k"), key.alias("text"), F.lit(True).alias("in_table"))
    text = prose.join(items.select(doc, "item_seq", "place"), keys).select(doc, "item_seq", "place", F.posexplode("lines").alias("k", "text")).withColumn("in_table", F.lit(False))
    shown = tables.table_markdown(rows.join(kept.select(*keys), keys, "left_semi"), keys).select(doc, key.alias("line"), "markdown")
    return stand.unionByName(text), shown, found


def prepare(items: DataFrame, cells: DataFrame, doc: str = "doc_id", subtype: str = "desconhecido") -> dict[str, DataFrame]:
    """structured, rendered, findings, reordered of documents given as layout items and table cells (contract tables).

    The text's words must survive rendering; else a RENDER_CONTENT error says so. What several results share is written to
    the shared folder first, so each of them has a short plan.
    """
    placed = written(geometry.reading_order(items, doc))
    texts, lost = item_lines(placed, doc)
    stand, shown, table_findings = table_lines(cells, placed, doc)
    every = written(texts.withColumn("in_table", F.lit(False)).unionByName(stand))
    order = F.row_number().over(Window.partitionBy(doc).orderBy("place", "k"))
    structured = written(structure.structured(every.select(doc, order.alias("line_no"), "text", "in_table", F.lit(subtype).alias("subtype")), doc))
    rendered = written(markdown.rendered(structured, doc, shown))
    grid = tables.grid(cells, [doc, "item_seq"]).groupBy(doc).agg(F.array_join(F.collect_list("text"), " ").alias("cells_text"))
    source = every.filter(~F.col("in_table")).groupBy(doc).agg(F.array_join(F.collect_list("text"), " ").alias("t")).join(grid, doc, "full")
    source = source.select(doc, T.repaired_markers(F.concat_ws("\n", "t", "cells_text")).alias("text"))
    same = bags.bags_equal(bags.compare_texts(source, rendered.select(doc, F.col("plain").alias("text")), [doc]), [doc])
    changed = same.filter(~F.col("same")).select(doc, F.lit(0).alias("seq"), F.lit("RENDER_CONTENT").alias("rule"), F.lit(0).alias("line"), F.lit("Renderização alterou a contagem de palavras; rever o documento.").alias("message"), F.lit("error").alias("severity"))
    pictures = placed.filter("kind = 'picture'").select(doc, F.col("item_seq").alias("seq"), F.lit("IMAGE").alias("rule"), F.lit(0).alias("line"), F.concat(F.lit("Página "), F.coalesce(F.col("page_no").cast("string"), F.lit("?")), F.lit(": figura sem transcrição textual.")).alias("message"), F.lit("warning").alias("severity"))
    return {
        "structured": structured, "rendered": rendered, "findings": report.union_findings(pictures, table_findings, lost, changed, doc=doc),
        "reordered": placed.groupBy(doc).agg(F.max("moved").alias("reordered")),
    }


def convert(items: DataFrame, cells: DataFrame, pages: DataFrame, doc: str = "doc_id", subtype: str = "desconhecido", with_order: bool = True) -> dict[str, DataFrame]:
    """prepare, then lint and audit against reference pages; measures, all findings in order, and the gate of each document."""
    out = prepare(items, cells, doc, subtype)
    plain = out["rendered"].select(doc, F.col("plain").alias("text"))
    lint = markdown.lint_findings(out["rendered"], [doc], "markdown")
    try:
        measures = written(audit.measure(pages, plain, doc, with_order))
    except Exception as exc:  # a measure that can't be taken is an error of the documents, not the run's end
        measures = audit.unmeasured(plain, f"{type(exc).__name__}: {str(exc).splitlines()[0][:200]}", doc)
    audited = audit.audit_findings(measures, pages, plain, doc, out["structured"])
    audited = audited.unionByName(audit.structure_errors(out["structured"], doc))
    findings = written(report.union_findings(lint, out["findings"].withColumn("seq", F.col("source_rank") * 1_000_000 + F.col("seq")), audited, doc=doc))
    return {**out, "measures": measures, "findings": findings, "gates": report.gates(plain.select(doc), findings, doc)}


def lint_files(spark: SparkSession, path: str) -> DataFrame:
    """path, seq and findings of Markdown files below a folder, audit files left out."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return markdown.lint_findings(files.filter(~F.col("path").contains("_auditoria")), ["path"], "value")


def collect_index(spark: SparkSession, rows: DataFrame, registry: DataFrame, header: list[str] | None = None, **options) -> dict[str, DataFrame]:
    """valid and rejected items of an index, their decisions and the summary; rows that a reader marked are rejected as well."""
    bad = rows.filter("problem is not null").select("file", "problem") if "problem" in rows.columns else None
    rows = rows.filter("problem is null").drop("problem") if bad is not None else rows
    items = collect.complete_items(collect.project_index(rows, header))
    valid = items.filter("problem is null")
    rejected = items.filter("problem is not null")
    order = [c for c in ("file", "sheet", "position") if c in items.columns]
    last = collect.last_wins(valid, ["chave"], order)
    last = last.withColumn("x_place", F.row_number().over(Window.orderBy(*order))) if options.get("limit") is not None else last.withColumn("x_place", F.col("position"))
    decisions = collect.decide(last, registry, order="x_place", **options)
    rejected = rejected if bad is None else rejected.unionByName(bad, allowMissingColumns=True)
    return {"valid": last.drop("x_place"), "rejected": rejected, "decisions": decisions, "summary": collect.collect_summary(decisions)}


def collect_run(spark: SparkSession, rows: DataFrame, entries: DataFrame, folder: str, fetcher=None, **options) -> dict[str, DataFrame]:
    """A whole collecting run: decisions, downloads (with a fetcher), and the registry after it (chave, entry).

    entries: chave, entry (JSON) so far. Documents at hand below the folder are hashed, so those that are there already are
    not fetched. An entry's fields that this run doesn't know stay.
    """
    json_ = lambda p: F.get_json_object("entry", f"$.descarga.{p}")
    items = collect.complete_items(collect.project_index(rows.filter("problem is null").drop("problem"), options.pop("header", None))).filter("problem is null")
    place = F.concat_ws("/", F.col("ano").cast("string"), F.col("num_bte").cast("string"), F.col("ficheiro"))
    here = readers.local_hashes(spark, folder)
    paths = items.select("chave", place.alias("path")).distinct().join(here, "path").groupBy("chave").agg(F.max("local_sha256").alias("local_sha256"))
    known = entries.select("chave", json_("sha256").alias("sha256"), json_("etag").alias("etag"), json_("last_modified").alias("last_modified"))
    known = written(known.join(paths, "chave", "full"))
    out = collect_index(spark, rows, known, network=fetcher is not None, **options)
    decided = written(out["decisions"])
    if fetcher is None:
        told = decided.select("chave", "estado", F.lit(None).cast("string").alias("erro"), "motivo")
        got = None
    else:
        asks = decided.filter("estado = 'descarregar'").select("chave").join(out["valid"].select("chave", "url"), "chave").join(known.select("chave", "etag", "last_modified", (F.col("sha256") == F.col("local_sha256")).alias("at_hand")), "chave", "left")
        got = written(collect.download(decided, out["valid"], known, written(collect.fetch(asks, fetcher)), folder))
        rest = decided.filter("estado <> 'descarregar'").select("chave", "estado", F.lit(None).cast("string").alias("erro"), "motivo")
        told = got.select("chave", "estado", "erro", F.lit(None).cast("string").alias("motivo")).unionByName(rest)
    told = told if got is None else told.join(got.select("chave", "bytes", "sha256", "etag", "last_modified", "caminho"), "chave", "left")
    return {**out, "decisions": decided, "downloads": told, "registry": collect.merged_entries(entries, told)}


__all__ = ["collect_index", "collect_run", "convert", "item_lines", "lines", "lint_files", "prepare", "table_lines"]
