"""Rules over structured documents: bodies, deposit note, articles, annexes. Each gives one notice text a document or node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from .lines import to_lines
from .structure import NUMBERED, descendants, node_texts


def _full_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: T.strip(x)), lambda x: x != "")


def follows_in_reference(tail: Column, head: Column, reference: Column) -> Column:
    """Whether the reference's words have the last body words directly before the first heading words."""
    wanted = F.concat(F.lit(" "), F.array_join(F.concat(tail, head), " "), F.lit(" "))
    return (F.size(tail) > 0) & (F.size(head) > 0) & F.concat(F.lit(" "), F.array_join(reference, " "), F.lit(" ")).contains(wanted)


def bodies_missing(documents: DataFrame, doc: str = "doc_id", reference: DataFrame | None = None) -> DataFrame:
    """doc, node_id, notice: clauses and articles without a body, or without one closed sentence.

    Exempt are articles that announce the clause after them, bodies that aren't sentences (tables, formulas, omissions),
    and bodies that end in a colon where the reference (doc, words) goes on with the next heading too.
    """
    return bodies_missing_of(node_texts(documents, doc), doc, reference)


def bodies_missing_of(nodes: DataFrame, doc: str = "doc_id", reference: DataFrame | None = None) -> DataFrame:
    """bodies_missing over node_texts or structured_nodes."""
    rows = nodes.filter(F.col("tipo").isin(*NUMBERED) & F.col("folha")).withColumnsRenamed({"next_tipo": "a_tipo", "next_rotulo": "a_rotulo"})
    body = T.strip(F.array_join(F.slice(F.split("raw", "\n"), 2, 1_000_000), "\n"))
    rows = rows.withColumn("body", body).withColumn("lines", _full_lines(F.col("body")))
    last = F.element_at("lines", -1)
    announces = (F.col("tipo") == "artigo") & (F.col("a_tipo") == "clausula") & last.rlike(P.ANNOUNCEMENT)
    colon = F.lit(False)
    if reference is not None:
        rows = rows.join(reference.select(F.col(doc).alias("r_doc"), F.col("words").alias("r_words")), F.col(doc) == F.col("r_doc"), "left")
        heads = F.col("a_tipo").isin(*P.HEADINGS) & F.col("body").rlike(r":\s*\z")
        tail, head = T.words("body"), F.slice(T.words("a_rotulo"), 1, P.HEADING_WORDS)
        tail = F.slice(tail, F.greatest(F.lit(1), F.size(tail) - P.BODY_TAIL_WORDS + 1), F.lit(P.BODY_TAIL_WORDS))
        colon = heads & follows_in_reference(tail, head, F.col("r_words"))
    closed = F.exists("lines", lambda x: x.rlike(P.CLOSED_SENTENCE))
    exempt = F.coalesce(announces, F.lit(False)) | F.col("raw").rlike(P.NO_SENTENCES) | F.coalesce(colon, F.lit(False))
    notice = F.when(F.col("body") == "", ": sem conteúdo").when(~closed & ~exempt, ": corpo sem frase terminada em ponto")
    return rows.withColumn("notice", F.concat("rotulo", notice)).filter("notice is not null").select(doc, "node_id", "seq", "notice")


def title_lines(text: Column) -> Column:
    """The first lines before any heading, eight at most."""
    lines = _full_lines(text)
    first = F.array_position(F.transform(lines, lambda x: x.rlike(P.STRUCTURAL_HEADING)), True)
    return F.slice(lines, F.lit(1), F.least(F.lit(P.MOST_TITLE_LINES), F.when(first > 0, first - 1).otherwise(F.lit(P.MOST_TITLE_LINES))).cast("int"))


def is_rectification(subtype: Column, record_type: Column, text: Column) -> Column:
    title = F.exists(title_lines(text), lambda x: x.rlike(P.TITLE_RECTIFICATION))
    return T.one_of(F.coalesce(subtype, F.lit("")), P.RECTIFICATION) | T.one_of(F.coalesce(record_type, F.lit("")), P.RECTIFICATION) | F.coalesce(title, F.lit(False))


def deposit_notice(text: Column, rectification: Column) -> Column:
    """Null where the deposit note closes the text; it may go on for two lines until its sentence closes."""
    lines = _full_lines(text)
    at = F.array_position(F.transform(lines, lambda x: x.rlike(P.DEPOSIT)), True).cast("int")
    line = lambda k: F.coalesce(F.get(lines, at - 1 + k), F.lit("."))
    open_ = lambda k: ~line(k).rlike(P.CLOSED_SENTENCE)
    end = F.least(F.size(lines), at + F.when(open_(0), F.when(open_(1), 2).otherwise(1)).otherwise(0))
    first = F.get(lines, end)
    shown = F.when(F.length(first) <= 80, first).otherwise(F.concat(F.substring(first, 1, 77), F.lit("…")))
    late = F.concat((F.size(lines) - end).cast("string"), F.lit(" linha(s) depois da nota de depósito — ordem de leitura suspeita (a primeira: «"), shown, F.lit("»)"))
    return (
        F.when(F.size(lines) == 0, "documento vazio").when(rectification, None)
        .when(at == 0, "sem nota de depósito (art. 494.º CT) — documento truncado?").when(end < F.size(lines), late)
    )


def no_articles_notice(nodes: Column, rectification: Column, text: Column) -> Column:
    """Null with a clause or article; else why there may be none."""
    any_ = F.exists(nodes, lambda n: n["tipo"].isin(*NUMBERED))
    salary = F.exists(title_lines(text), lambda x: x.rlike(P.TITLE_SALARY_CHANGE)) & ~F.exists(F.split(text, "\n"), lambda x: x.rlike(P.HEADING_SHAPE) & ~x.contains(" | "))
    return F.when(any_, None).when(rectification, P.NOTE_RECTIFICATION).when(salary, P.NOTE_SALARY_CHANGE).otherwise(P.NOTE_NO_STRUCTURE)


def reads_as_levels(label: Column, raw: Column) -> Column:
    """A classification without a grid: three levels or more, most with category words after them."""
    body = F.array_join(F.slice(F.split(raw, "\n"), 2, 1_000_000), "\n")
    parts = F.transform(F.slice(F.split(body, P.LEVEL.replace(r"\b", r"(?U:\b)")), 2, 1_000_000), lambda x: T.strip(x))
    named = F.size(F.filter(parts, lambda x: x.rlike(P.CATEGORY_WORD)))
    left_out = F.size(F.filter(parts, lambda x: x.rlike(rf"^{P.OMITTED}\.?\z")))
    return label.rlike(P.CLASSIFICATION) & (F.size(parts) >= P.LEAST_VALUES) & (named >= P.LEAST_VALUES) & (named * 2 > F.size(parts) - left_out)


def annexes_without_table(documents: DataFrame, doc: str = "doc_id", image_pages: DataFrame | None = None) -> DataFrame:
    """doc, node_id, notice: annexes whose label promises a table and whose nodes hold none, with where it may be."""
    nodes = node_texts(documents, doc)
    family = descendants(nodes.select(doc, "node_id", "pai"), doc)
    parts = family.join(nodes.select(doc, "node_id", "seq", "raw"), [doc, "node_id"])
    raw = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((F.col("node_id") != F.col("ancestor")).alias("below"), "seq", "raw"))), lambda x: x["raw"]), "")
    whole = parts.groupBy(doc, F.col("ancestor").alias("node_id")).agg(raw.alias("whole"))
    rows = nodes.filter((F.col("tipo") == "anexo") & F.col("rotulo").rlike(P.TABLE_ANNEX)).select(doc, "node_id", "seq", "rotulo").join(whole, [doc, "node_id"])
    rows = rows.join(documents.select(doc, F.col("text").contains(" | ").alias("has_rows")), doc)
    if image_pages is not None:
        rows = rows.join(image_pages.groupBy(doc).agg(F.array_sort(F.collect_set("page_no")).alias("pages")), doc, "left")
    else:
        rows = rows.withColumn("pages", F.lit(None).cast("array<int>"))
    body = F.filter(F.slice(F.split("whole", "\n"), 2, 1_000_000), lambda x: T.strip(x) != "")
    values = F.size(F.regexp_extract_all("whole", F.lit(P.VALUE), F.lit(0))) >= P.LEAST_VALUES
    prose = (F.size(body) >= P.LEAST_TEXT_LINES) & ~F.col("rotulo").rlike(P.VALUE_ANNEX)
    fine = F.col("whole").contains(" | ") | values | reads_as_levels(F.col("rotulo"), F.col("whole")) | prose
    shown = F.array_join(F.transform("pages", lambda p: F.concat(F.lit("p"), p.cast("string"))), ", ")
    why = (
        F.when(F.size(F.coalesce("pages", F.array().cast("array<int>"))) > 0, F.concat(F.lit(" sem tabela no texto — o PDF tem tabelas em imagem ("), shown, F.lit("), que o texto não pode ter; ver no PDF")))
        .when(F.col("has_rows"), " com a tabela fora do corpo do nó — as linhas existem no documento mas não ficaram ancoradas ao anexo (ordem de leitura)")
        .otherwise(" sem nenhuma tabela no documento — tabela perdida na extração?")
    )
    return rows.filter(~fine).select(doc, "node_id", "seq", F.concat("rotulo", F.lit(": anexo de remuneração/mapa"), why).alias("notice"))


def sanity_findings(documents: DataFrame, doc: str = "doc_id", reference: DataFrame | None = None, image_pages: DataFrame | None = None) -> DataFrame:
    """doc, seq, rule, line, message, severity: all notices in order; two expected ones are info.

    documents: structured, with subtype and record_type where known.
    """
    for name in ("subtype", "record_type"):
        if name not in documents.columns:
            documents = documents.withColumn(name, F.lit(None).cast("string"))
    rect = is_rectification(F.col("subtype"), F.col("record_type"), F.col("text"))
    base = documents.withColumn("rect", rect)
    first = base.select(doc, F.lit(0).alias("rank"), no_articles_notice(F.col("nodes"), F.col("rect"), F.col("text")).alias("message"))
    second = base.select(doc, F.lit(1).alias("rank"), deposit_notice(F.col("text"), F.col("rect")).alias("message"))

    def listed(found: DataFrame) -> DataFrame:
        order = F.transform(F.array_sort(F.collect_list(F.struct("seq", "notice"))), lambda x: x["notice"])
        return found.groupBy(doc).agg(order.alias("all"))

    bodies = listed(bodies_missing(documents, doc, reference))
    text = F.concat(F.size("all").cast("string"), F.lit(" cláusula(s)/artigo(s) sem corpo válido: "), F.array_join(F.slice("all", 1, 5), "; "), F.when(F.size("all") > 5, " …").otherwise(""))
    third = bodies.select(doc, F.lit(2).alias("rank"), text.alias("message"))
    annexes = listed(annexes_without_table(documents, doc, image_pages))
    shown = F.concat(F.slice("all", 1, 5), F.when(F.size("all") > 5, F.array(F.lit("…"))).otherwise(F.array().cast("array<string>")))
    fourth = annexes.select(doc, F.posexplode(shown).alias("k", "message")).select(doc, (F.col("k") + 3).alias("rank"), "message")
    every = first.unionByName(second).unionByName(third).unionByName(fourth).filter("message is not null")
    expected = F.col("message").startswith(P.NOTE_RECTIFICATION) | F.col("message").startswith(P.NOTE_SALARY_CHANGE)
    return every.select(doc, F.col("rank").alias("seq"), F.lit("STRUCTURE").alias("rule"), F.lit(0).alias("line"), "message", F.when(expected, "info").otherwise("warning").alias("severity"))


def deposit_lines(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, line_no of the first deposit note, in non-empty lines; a window form for very long texts."""
    lines = to_lines(df, keys, text).filter(T.strip("text") != "")
    lines = lines.withColumn("line_no", F.row_number().over(Window.partitionBy(*keys).orderBy("line_no")))
    return lines.filter(T.one_of(F.col("text"), P.DEPOSIT)).groupBy(*keys).agg(F.min("line_no").alias("line_no"))
