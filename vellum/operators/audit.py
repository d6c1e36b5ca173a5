"""Completeness of final texts against independent reference pages, and the findings that follow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..sources.scratch import written
from . import bags, lines, sanity, tables


def _longest(ref: np.ndarray, places: list, size: np.ndarray, a: int, b: int, c: int, d: int) -> tuple[int, int, int]:
    """The longest run that ref[a:b] and the found words c..d share, the first of equals; places: where each word is found."""
    best = (a, c, 0)
    before = None
    for i in range(a, b):
        at = places[ref[i]]
        at = at[np.searchsorted(at, c) : np.searchsorted(at, d)]
        if before is None and not len(at):
            continue
        run = size[at] + 1  # size[k]: how long the run is that ends before k, in the row above
        if before is not None:
            size[before + 1] = 0
        size[at + 1] = run
        before = at if len(at) else None
        if len(at) and run.max() > best[2]:
            k = int(run.argmax())
            n = int(run[k])
            best = (i - n + 1, int(at[k]) - n + 1, n)
    if before is not None:
        size[before + 1] = 0
    return best


def matching_blocks(ref: list[str], txt: list[str]) -> list[tuple[int, int, int]]:
    """Blocks (place in ref, in txt, length) of the alignment by longest common runs, left and right of each the same again.

    A row costs the places of its word only, so texts of 100,000 words align in seconds.
    """
    code: dict[str, int] = {}
    found = np.array([code.setdefault(w, len(code)) for w in txt], np.int64)
    order = np.argsort(found, kind="stable")
    places = np.split(order, np.cumsum(np.bincount(found, minlength=len(code)))[:-1]) if len(txt) else []
    places.append(np.zeros(0, np.int64))
    own = np.array([code.get(w, len(code)) for w in ref], np.int64)
    size = np.zeros(len(txt) + 2, np.int64)
    todo, blocks = [(0, len(ref), 0, len(txt))], []
    while todo:
        a, b, c, d = todo.pop()
        i, j, n = _longest(own, places, size, a, b, c, d)
        if n:
            blocks.append((i, j, n))
            if a < i and c < j:
                todo.append((a, i, c, j))
            if i + n < b and j + n < d:
                todo.append((i + n, b, j + n, d))
    out: list[tuple[int, int, int]] = []
    for i, j, n in sorted(blocks):
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (*out[-1][:2], out[-1][2] + n)
        else:
            out.append((i, j, n))
    return out


def order_similarity(pairs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, order, missing_segments, extra_segments: exact alignment of two word arrays (reference, found), however long.

    order is the matched share of the reference; the longest segments are told, each up to MOST_SEGMENT_CHARS characters.
    """
    kind = pairs.schema[doc].dataType.simpleString()

    def one(ref: list[str], txt: list[str]) -> tuple:
        if not ref or not txt:
            return 1.0, [], []
        blocks = matching_blocks(ref, txt)
        lost, more, i, j = [], [], 0, 0
        for a, c, n in [*blocks, (len(ref), len(txt), 0)]:
            if a - i >= P.LEAST_SEGMENT:
                lost.append((a - i, i, " ".join(ref[i:a])))
            if c - j >= P.LEAST_SEGMENT:
                more.append((c - j, j, " ".join(txt[j:c])))
            i, j = a + n, c + n
        top = lambda found: [t[: P.MOST_SEGMENT_CHARS] for _, _, t in sorted(found, key=lambda x: (-x[0], x[1]))[: P.MOST_SEGMENTS]]
        return sum(n for _, _, n in blocks) / len(ref), top(lost), top(more)

    def run(batches):
        for batch in batches:
            out = [one(r or [], f or []) for r, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            words = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([o[k] for o in out], t) for k, t in enumerate((pa.float64(), words, words))]], [doc, "order", "missing_segments", "extra_segments"])

    return pairs.select(doc, "reference", "found").mapInArrow(run, f"{doc} {kind}, order double, missing_segments array<string>, extra_segments array<string>")


def measure(pages: DataFrame, texts: DataFrame, doc: str = "doc_id", with_order: bool = True) -> DataFrame:
    """One row a document: words, coverage, excess, order, counts of reversed words, residues, long lines, verdict.

    Without with_order, order is null and order_skipped tells so; the verdict then is no better than `ATENÇÃO`.

    pages: doc, page_no, text of the reference; texts: doc, text. Both sides are cleaned alike first.
    """
    clean = written(lines.clean_pages(pages, doc))
    final = texts.select(doc, T.joined_hyphens(T.unix_lines("text")).alias("text"))
    compared = written(bags.compare_texts(clean, final, [doc]))
    out = texts.select(doc).join(bags.coverage(compared, [doc]), doc, "left")
    rows = lines.to_lines(final, [doc])
    for name, found in (
        ("reversed_words", bags.reversed_words(compared, [doc])), ("residues", lines.residues(rows, [doc])), ("long_lines", lines.long_lines(rows, [doc])),
    ):
        out = out.join(found.groupBy(doc).agg(F.count("*").alias(name)), doc, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    if with_order:
        words = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page_no", T.words("text").alias("w")))), lambda x: x["w"]))
        both = clean.groupBy(doc).agg(words.alias("reference")).join(final.select(doc, T.words("text").alias("found")), doc)
        out = out.join(order_similarity(both, doc).select(doc, "order"), doc, "left")
    else:
        out = out.withColumn("order", F.lit(None).cast("double"))
    out = out.fillna({"coverage": 1.0, "excess": 0.0, "reference_words": 0, "found_words": 0})
    out = out.withColumn("order_skipped", F.lit(not with_order))
    return out.withColumn("verdict", bags.verdict(*[F.col(c) for c in ("coverage", "excess", "order", "reversed_words", "residues", "long_lines")], skipped=F.col("order_skipped")))


def unmeasured(texts: DataFrame, error: str, doc: str = "doc_id") -> DataFrame:
    """Rows like measure's for documents that could not be measured: verdict `SEM MEDIDA`, with the error."""
    kinds = {"reference_words": "long", "found_words": "long", "coverage": "double", "excess": "double", "reversed_words": "long", "residues": "long", "long_lines": "long", "order": "double"}
    rows = texts.select(doc, *[F.lit(None).cast(k).alias(c) for c, k in kinds.items()], F.lit(True).alias("order_skipped"))
    return rows.withColumns({"verdict": F.lit("SEM MEDIDA"), "error": F.lit(error)})


def structure_errors(structured: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Findings for documents whose structure could not be built."""
    bad = structured.filter("error is not null")
    return bad.select(doc, F.lit(90).alias("seq"), F.lit("STRUCTURE_UNAVAILABLE").alias("rule"), F.lit(0).alias("line"), F.concat(F.lit("Estrutura não construída: "), F.col("error")).alias("message"), F.lit("error").alias("severity"))


def audit_findings(measures: DataFrame, pages: DataFrame, texts: DataFrame, doc: str = "doc_id", structured: DataFrame | None = None, table_counts: DataFrame | None = None, image_pages: DataFrame | None = None) -> DataFrame:
    """doc, seq, rule, line, message, severity. table_counts: doc, reference_tables, text_tables."""
    pct = lambda c: F.format_string("%.2f%%", F.col(c) * 100)
    said = F.concat("verdict", F.lit(": cobertura "), pct("coverage"), F.lit(", excesso "), pct("excess"), F.lit(", ordem "), F.coalesce(pct("order"), F.lit("não medida")), F.lit("."))
    finding = lambda df, rank, rule, message, severity: df.select(doc, F.lit(rank).alias("seq"), rule.alias("rule"), F.lit(0).alias("line"), message.alias("message"), severity.alias("severity"))
    if "error" in measures.columns:
        lost = finding(measures.filter("error is not null"), 0, F.lit("COMPLETENESS_UNAVAILABLE"), F.concat(F.lit("Completude não medida: "), F.col("error")), F.lit("error"))
        measures = measures.filter("error is null")
    else:
        lost = None
    bad = measures.filter("verdict <> 'OK'")
    out = finding(bad, 0, F.lit("COMPLETENESS"), said, F.when(F.col("verdict") == "FALHA", "error").otherwise("warning"))
    out = out if lost is None else lost.unionByName(out)
    empty = measures.filter("reference_words = 0")
    out = out.unionByName(finding(empty, 1, F.lit("REFERENCE_EMPTY"), F.lit("PDF sem camada textual para comparação independente; a completude do OCR não está comprovada."), F.lit("error")))
    whole = pages.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda x: x["text"]), "\n").alias("text"))
    money = bags.reconcile_amounts(whole, texts, [doc])
    message = F.concat(F.lit("Montantes em falta: "), F.to_json("missing"), F.lit("; montantes adicionais: "), F.to_json("extra"), F.lit("."))
    out = out.unionByName(finding(money, 2, F.lit("AMOUNTS"), message, F.lit("error")))
    if table_counts is not None:
        rules = table_counts.select(doc, "reference_tables", F.posexplode(tables.divergence(F.col("reference_tables"), F.col("text_tables"))).alias("k", "rule"))
        lost = F.when(F.col("rule") == "TABLES_MISSING", "O auditor deteta tabelas, mas o Markdown não contém nenhuma.").otherwise(
            F.concat(F.lit("o auditor deteta "), F.col("reference_tables").cast("string"), F.lit(" tabela(s) mas o texto extraído não tem nenhum bloco de tabela — possível perda na extração"))
        )
        out = out.unionByName(finding(rules.filter("rule = 'TABLE_AUDIT'"), 3, F.col("rule"), lost, F.lit("warning")))
        out = out.unionByName(finding(rules.filter("rule = 'TABLES_MISSING'"), 4, F.col("rule"), lost, F.lit("error")))
    if structured is not None:
        words = whole.select(doc, T.words("text").alias("words"))
        found = sanity.sanity_findings(structured, doc, words, image_pages)
        out = out.unionByName(found.withColumn("seq", F.col("seq") + 5))
    return out
