"""Findings to gates, gates to runs, runs to reports."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T


def severity_rank(c: Column | str) -> Column:
    return F.array_position(F.array(*map(F.lit, P.SEVERITIES)), T.col(c)).cast("int") - 1


def union_findings(*tables: DataFrame, doc: str = "doc_id") -> DataFrame:
    """All findings; the tables' order comes before their own."""
    out = None
    for rank, t in enumerate(tables):
        t = t.select(doc, F.lit(rank).alias("source_rank"), F.col("seq").cast("long").alias("seq"), "rule", F.col("line").cast("int").alias("line"), "message", "severity")
        out = t if out is None else out.unionByName(t)
    return out


def gates(documents: DataFrame, findings: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, gate, state, findings: any error blocks, anything but info needs a review."""
    worst = findings.groupBy(doc).agg(F.max(severity_rank("severity")).alias("worst"), F.count("*").alias("findings"))
    rows = documents.select(doc).join(worst, doc, "left")
    gate = F.element_at(F.array(*map(F.lit, P.GATES)), F.coalesce("worst", F.lit(0)) + 1)
    return rows.select(
        doc, gate.alias("gate"), F.when(F.coalesce("worst", F.lit(0)) > 0, "rever").otherwise("sem_alertas_automaticos").alias("state"), F.coalesce("findings", F.lit(0).cast("long")).alias("findings")
    )


def exit_code(failed: Column, worst: Column, strict: Column) -> Column:
    """1 with a failure or an error, 2 with anything but info where strict, else 0; over a group's rows."""
    top = F.max(F.coalesce(worst, F.lit(0)))
    return F.when(F.max(failed) | (top >= 2), 1).when(F.max(strict) & (top >= 1), 2).otherwise(0)


def rule_counts(findings: DataFrame, doc: str = "doc_id") -> DataFrame:
    """rule, severity, findings, documents."""
    return findings.groupBy("rule", "severity").agg(F.count("*").alias("findings"), F.count_distinct(doc).alias("documents"))


def review_actions(findings: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, place, rule, severity, n, message: one row a rule, in order of first occurrence; info is left out."""
    at = F.struct("source_rank", "seq")
    groups = findings.filter("severity <> 'info'").groupBy(doc, "rule", "severity").agg(F.count("*").alias("n"), F.min_by("message", at).alias("message"), F.min(at).alias("at"))
    return groups.withColumn("place", F.row_number().over(Window.partitionBy(doc).orderBy("at"))).drop("at")


def report_order(state: Column, gate: Column) -> Column:
    """Priority of a document in the report: failed, not processed, blocked, review, passed."""
    return F.when(state == "falhou", 0).when(state == "nao_processado", 1).when(gate == "blocked", 2).when(gate == "review", 3).otherwise(4)


def structure_summary(nodes: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, counts by node type, and the ordered labels of clauses and articles."""
    count = lambda kind: F.sum((F.col("tipo") == kind).cast("int")).cast("long")
    labels = F.transform(F.array_sort(F.collect_list(F.when(F.col("tipo").isin("clausula", "artigo"), F.struct("char_start", "rotulo")))), lambda x: x["rotulo"])
    return nodes.groupBy(doc).agg(*[count(k).alias(k) for k in ("capitulo", "seccao", "anexo", "clausula", "artigo", "paragrafo")], labels.alias("labels"))


def equal_contents(documents: DataFrame, digest: Column, doc: str = "doc_id") -> DataFrame:
    """sha256, n, first: contents that several documents share, with the least of them."""
    return documents.groupBy(digest.alias("sha256")).agg(F.count("*").alias("n"), F.min(doc).alias("first")).filter("n > 1")


def duplicate_outputs(paths: DataFrame, path: str = "path", reserved: tuple = ("_auditoria",)) -> DataFrame:
    """Output names that meet in lower case, or use a reserved first part."""
    name = F.lower(F.col(path))
    twice = paths.groupBy(name.alias("name")).agg(F.count("*").alias("n"))
    return twice.filter((F.col("n") > 1) | F.element_at(F.split("name", "/"), 1).isin(*reserved))


def atomic_write(path: str, text: str) -> None:
    """A small driver-side file, whole or not at all, with LF line ends."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder, suffix=".part")
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="\n") as f:
            f.write(text)
        os.replace(temporary, path)
    except BaseException:
        if os.path.exists(temporary):
            os.unlink(temporary)
        raise


#: What a report calls a gate or a state.
STATUS = {"passed": "Sem alertas automáticos", "review": "Rever", "blocked": "Bloqueado", "falhou": "Falhou", "nao_processado": "Não processado"}


def status_label(state: Column, gate: Column) -> Column:
    """The label of a failed or unprocessed document's state, else of its gate; other names stay as they are."""
    key = F.when(state.isin("falhou", "nao_processado"), state).otherwise(F.coalesce(gate, state))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair]), key), key)


def report_link(path: Column, parent: Column, label: Column) -> Column:
    """A Markdown link from a folder to a path, both absolute with `/`: relative, quoted, in angle brackets."""
    a, b = F.split(parent, "/"), F.split(path, "/")
    pairs = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z: F.coalesce(z["a"] == z["b"], F.lit(False)))
    same = F.coalesce(F.nullif(F.array_position(pairs, False), F.lit(0)) - 1, F.least(F.size(a), F.size(b))).cast("int")
    up = F.repeat(F.lit("../"), F.size(a) - same)
    target = F.concat(up, F.array_join(F.slice(b, same + 1, F.greatest(F.size(b) - same, F.lit(0))), "/"))
    quoted = F.replace(F.replace(F.replace(F.url_encode(target), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~"))
    return F.concat(F.lit("["), T.escaped_report(label), F.lit("](<"), F.replace(quoted, F.lit("*"), F.lit("%2A")), F.lit(">)"))


def merge_attempts(manifest: DataFrame, attempts: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The manifest with what an attempt told put over it; documents without an attempt, and fields of the manifest alone, stay."""
    fresh = [c for c in attempts.columns if c != doc]
    told = attempts.select(doc, F.lit(True).alias("x_told"), *[F.col(c).alias(f"x_{c}") for c in fresh])
    joined = manifest.join(told, doc, "left")
    put = {c: F.coalesce(f"x_{c}", c) if c in manifest.columns else F.col(f"x_{c}") for c in fresh}
    return joined.select(doc, *[put.pop(c).alias(c) if c in put else F.col(c) for c in manifest.columns if c != doc], *[v.alias(c) for c, v in put.items()])


def detail_lines(documents: DataFrame, findings: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, place, line: every document with its label and every finding, in report order; for sets of any size."""
    heads = documents.select(doc, report_order(F.col("state"), F.col("gate")).alias("priority"), F.concat(F.lit("## "), T.escaped_report(F.col(doc).cast("string")), F.lit(": "), status_label(F.col("state"), F.col("gate"))).alias("line"))
    order = Window.partitionBy(doc).orderBy("source_rank", "seq", "rule", "line", "message")
    said = F.concat(F.lit("- "), F.col("severity"), F.lit(" "), F.col("rule"), F.lit(", linha "), F.coalesce(F.col("line").cast("string"), F.lit("0")), F.lit(": "), T.escaped_report("message"))
    rows = findings.join(heads.select(doc, "priority"), doc).select(doc, "priority", F.row_number().over(order).alias("place"), said.alias("line"))
    return heads.select(doc, "priority", F.lit(0).alias("place"), "line").unionByName(rows)


def run_report(documents: DataFrame, findings: DataFrame, run_id: str, doc: str = "doc_id") -> dict[str, str]:
    """Files of a run: manifest.json, relatorio.txt, diagnostic.md (actions by document), detalhes.md (every finding).

    documents: doc, state, gate. All documents are listed, row by row; the texts are for a reader, so use detail_lines and
    write_table for sets that no one reads as a whole.
    """
    totals = [r.asDict() for r in documents.groupBy("state", "gate").count().orderBy("state", "gate").collect()]
    rules = [r.asDict() for r in rule_counts(findings, doc).orderBy("rule", "severity").collect()]
    ranked = documents.select(doc, report_order(F.col("state"), F.col("gate")).alias("priority"), status_label(F.col("state"), F.col("gate")).alias("label"))
    actions = review_actions(findings, doc).select(doc, "place", "severity", "rule", "n", "message")
    lines, last = ["# Diagnóstico", ""], None
    for r in ranked.join(actions, doc, "left").orderBy("priority", doc, "place").toLocalIterator():
        if r[doc] != last:
            lines += [""] * (last is not None) + [f"## {r[doc]}: {r.label}"]
            last = r[doc]
        if r.rule is not None:
            lines.append(f"- {r.severity} {r.rule} ×{r.n}: {r.message}")
    details = ["# Detalhes", ""] + [r.line for r in detail_lines(documents, findings, doc).orderBy("priority", doc, "place").toLocalIterator()]
    text = [f"corrida {run_id}"] + [f"  {t['state']} {t['gate']}: {t['count']}" for t in totals] + [f"  {r['rule']} ({r['severity']}): {r['findings']} em {r['documents']}" for r in rules]
    manifest = {"run_id": run_id, "totals": totals, "rules": rules}
    written = {"diagnostic.md": lines, "detalhes.md": details, "relatorio.txt": text}
    return {"manifest.json": json.dumps(manifest, ensure_ascii=False, indent=2) + "\n"} | {name: "\n".join(x) + "\n" for name, x in written.items()}


def write_reports(files: dict[str, str], folder: str, run_id: str) -> None:
    """The files as the current report and archived under the run."""
    for name, text in files.items():
        for place in (os.path.join(folder, "runs", run_id), folder):
            atomic_write(os.path.join(place, name), text)
