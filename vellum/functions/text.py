"""Scalar text functions as Column builders; all stay inside the JVM. register_functions publishes them to SQL."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import patterns as P

NBSP = " "
#: Unicode white space, which Python's strip() and split() use.
BLANK = r"[\s\x1c-\x1f\x85  -     　]"
_LATIN = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) > 1}


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def one_of(c: Column, *found: str) -> Column:
    """Whether any of the patterns is found in the text; false for null."""
    out = F.lit(False)
    for p in found:
        out = out | c.rlike(p)
    return F.coalesce(out, F.lit(False))


def strip(c: Column | str, chars: str | None = None) -> Column:
    """Without white space, or the given characters, at both ends. In transform, call it in a lambda of one argument."""
    if chars is not None:
        return F.trim(col(c), F.lit(chars))
    return F.regexp_replace(col(c), rf"^{BLANK}+|{BLANK}+\z", "")


def unaccented(c: Column | str) -> Column:
    """Latin letters without marks; other scripts stay."""
    return F.regexp_replace(F.translate(col(c), "".join(_LATIN), "".join(_LATIN.values())), r"\p{Mn}", "")


def normal_name(c: Column | str) -> Column:
    """Lower case, without accents and punctuation, to compare headers."""
    return F.regexp_replace(F.lower(unaccented(F.coalesce(col(c), F.lit("")))), r"[^\p{L}\p{N}]", "")


def words(c: Column | str) -> Column:
    """Word tokens in order."""
    return F.regexp_extract_all(col(c), F.lit(P.WORD), F.lit(0))


def unix_lines(c: Column | str) -> Column:
    """CR and CRLF become LF; the reader's soft hyphen mark ends its line."""
    mark = "￾"
    text = F.replace(F.regexp_replace(col(c), "\r\n?", "\n"), F.lit(mark), F.lit(f"{mark}\n"))
    return F.replace(text, F.lit(f"{mark}\n\n"), F.lit(f"{mark}\n"))


def joined_hyphens(c: Column | str) -> Column:
    """Words cut at a line's end are whole again."""
    return F.replace(F.regexp_replace(col(c), P.SOFT_END, ""), F.lit("￾"), F.lit("-"))


def tidy_lines(c: Column | str) -> Column:
    """Final joining: hyphens at line ends, blanks before a line's end, three or more line ends."""
    text = F.regexp_replace(col(c), r"-\n(?=[a-zà-ú])", "")
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")


def repaired_markers(c: Column | str) -> Column:
    """Ordinals and paragraph numbers that lost or gained a space."""
    return F.regexp_replace(F.regexp_replace(col(c), P.SPLIT_ORDINAL, "$1.$2"), P.GLUED_NUMBER, "$1- ")


def cell_text(c: Column | str) -> Column:
    """A table cell on one line."""
    return strip(F.regexp_replace(F.regexp_replace(col(c), r"-\s*\n\s*(?=[a-zà-ú])", ""), r"[ \t]*\n[ \t]*", " "))


def amounts(c: Column | str) -> Column:
    """Money amounts in order, in one form: no thousands mark, a decimal comma. Dotted number groups count, as in the rules."""
    found = F.regexp_extract_all(col(c), F.lit(P.AMOUNT), F.lit(0))

    def canonical(v: Column) -> Column:
        v = F.translate(v, f" {NBSP}", "")
        return F.when(v.contains(","), F.replace(v, F.lit("."), F.lit(""))).otherwise(F.replace(v, F.lit("."), F.lit(",")))

    return F.transform(found, canonical)


def is_furniture(c: Column | str) -> Column:
    """A whole line of page furniture."""
    return one_of(strip(c), P.FURNITURE_HEADER, P.FURNITURE_DATE, P.FURNITURE_FOOTER)


def without_header_prefix(c: Column | str) -> Column:
    return F.regexp_replace(strip(c), P.HEADER_PREFIX, "")


def dated_headers(c: Column | str) -> Column:
    """Dated page headers anywhere in a line."""
    return F.transform(F.regexp_extract_all(col(c), F.lit(P.DATED_HEADER), F.lit(0)), lambda x: strip(x))


def without_dated_header(c: Column | str) -> Column:
    """The line without dated headers; untouched where there is none."""
    return F.when(col(c).rlike(P.DATED_HEADER), strip(F.regexp_replace(col(c), P.DATED_HEADER, " "))).otherwise(col(c))


def has_furniture(c: Column | str) -> Column:
    return is_furniture(c) | one_of(col(c), P.GLUED_FURNITURE)


def mostly_numbers(c: Column | str) -> Column:
    """More than 40 % of the tokens hold a digit."""
    tokens = F.filter(F.split(col(c), f"{BLANK}+"), lambda t: t != "")
    return (F.size(tokens) > 0) & (F.size(F.filter(tokens, lambda t: t.rlike(r"\p{Nd}"))) > P.NUMERIC_SHARE * F.size(tokens))


def looks_like_table(c: Column | str) -> Column:
    return col(c).contains(" | ") | mostly_numbers(c)


def whole_table_row(line: Column, before: Column, after: Column) -> Column:
    """A long line that is one row of a table: a neighbour has as many cells, or it is long by prose cells only."""
    n = lambda x: F.when(x.contains(" | "), F.size(F.split(x, r" \| ")))
    own = F.split(line, r" \| ")
    beside = F.coalesce(n(before) == F.size(own), F.lit(False)) | F.coalesce(n(after) == F.size(own), F.lit(False))
    short = F.filter(own, lambda x: (F.size(F.filter(F.split(x, f"{BLANK}+"), lambda t: t != "")) < P.PROSE_WORDS) | mostly_numbers(x))
    return beside | (F.length(F.array_join(short, " | ")) <= P.LONG_LINE)


def is_reversed(c: Column | str) -> Column:
    """A word of four letters or more that ends in its only capital."""
    return (F.length(col(c)) >= 4) & col(c).rlike(P.REVERSED_WORD)


def context(text: Column, word: Column, width: int = 70) -> Column:
    """The first whole occurrence of a word with its surroundings; empty without one."""
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), word, F.lit(r"\E(?![\p{L}\p{N}_])"))
    at = F.length(F.element_at(F.split(text, pattern, 2), 1)) + 1
    start, end = F.greatest(F.lit(1), at - width), F.least(F.length(text), at + F.length(word) - 1 + width)
    cut = F.replace(F.substring(text, start, end - start + 1), F.lit("\n"), F.lit(" ⏎ "))
    shown = F.concat(F.when(start > 1, "…").otherwise(""), cut, F.when(end < F.length(text), "…").otherwise(""))
    return F.when(at > F.length(text), "").otherwise(shown)


def char_classes(c: Column | str) -> Column:
    """struct(letters, digits, commas, dots, a)."""
    t = col(c)
    n = lambda drop, x=t: F.length(F.regexp_replace(x, drop, "")).cast("long")
    return F.struct(
        n(r"[^\p{L}]").alias("letters"), n(r"[^\p{Nd}]").alias("digits"), n("[^,]").alias("commas"), n("[^.]").alias("dots"), n("[^a]", F.lower(t)).alias("a")
    )


def safe_name(c: Column | str) -> Column:
    """The last part of a path; null where that can't be a plain file name."""
    name = F.element_at(F.split(F.regexp_replace(col(c), "/+$", ""), "/"), -1)
    return F.when(~name.isin("", ".", "..") & ~name.contains("\\"), name)


def whole_number(c: Column | str) -> Column:
    """Integral numbers in any notation; null for all else."""
    number = strip(col(c).cast("string")).try_cast("double")
    ok = (number == F.floor(number)) & (F.abs(number) < 9e18)
    return F.when(ok, number.cast("long"))


def url_error(c: Column | str) -> Column:
    """Null for an allowed download address, else `malformed`, `scheme`, `host` or `authority`."""
    u = col(c)
    part = lambda name: F.try_parse_url(u, F.lit(name))
    authority = F.coalesce(part("AUTHORITY"), F.lit(""))
    host = F.lower(F.coalesce(part("HOST"), F.lit("")))
    port = F.regexp_extract(F.regexp_replace(authority, "^.*@", ""), r":([^:]*)$", 1)
    return (
        F.when(u.isNull() | (u.contains("://") & part("PROTOCOL").isNull()), "malformed")
        .when(~port.rlike(r"^\d*$"), "malformed")
        .when(F.coalesce(F.lower(part("PROTOCOL")), F.lit("")) != "https", "scheme")
        .when(~host.isin(*P.ALLOWED_HOSTS), "host")
        .when(authority.contains("@") | ~port.isin("", "443"), "authority")
    )


def escaped_markdown(c: Column | str) -> Column:
    """Text that a Markdown reader shows as it is, legal numbers included."""
    t = F.regexp_replace(col(c), r"([\\`*_\[\]<>])", r"\\$1")
    return F.regexp_replace(F.regexp_replace(t, r"^(\s*\p{Nd}+)([.)])(?=\s)", r"$1\\$2"), "^([#>])", r"\\$1")


def escaped_report(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(col(c), "\r\n|[\r\n]", " "), r"([\\`*_{}\[\]<>()#!|])", r"\\$1")


def plain_references(c: Column | str) -> Column:
    """Without the three references that writers of HTML must use, each closed by its semicolon; one pass in this order."""
    text = F.replace(F.replace(col(c), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">"))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def fenced(c: Column | str) -> Column:
    """A fenced block; the fence is longer than any run of its character inside."""
    runs = F.transform(F.regexp_extract_all(col(c), F.lit("`+"), F.lit(0)), lambda r: F.length(r))
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))
    return F.concat(fence, F.lit("text\n"), col(c), F.lit("\n"), fence)


def family(c: Column | str) -> Column:
    """The document family of a type code; the first prefix that fits wins."""
    t = F.upper(normal_name(c))
    out = F.lit(None).cast("string")
    for prefix, name in reversed(P.FAMILIES):
        out = F.when(t.startswith(prefix), name).otherwise(out)
    return out


def ordinal_value(c: Column | str) -> Column:
    """The number of an ordinal spelled out, parts falling; null for anything else."""
    table = F.create_map(*[F.lit(x) for pair in P.ORDINALS.items() for x in pair])
    found = F.regexp_extract_all(F.lower(unaccented(c)), F.lit("[a-z]+"), F.lit(0))
    values = F.transform(found, lambda w: F.element_at(table, F.regexp_replace(w, "[ao]$", "")))
    falling = F.forall(F.arrays_zip(F.slice(values, F.lit(1), F.greatest(F.size(values) - 1, F.lit(0))).alias("a"), F.slice(values, 2, 1000).alias("b")), lambda p: p["a"] > p["b"])
    good = (F.size(values) > 0) & ~F.exists(values, lambda v: v.isNull()) & falling
    return F.when(F.coalesce(good, F.lit(False)), F.aggregate(values, F.lit(0), lambda a, v: a + v))


def number_key(c: Column | str) -> Column:
    """A stable key of a clause or article label: cl12, cl16A, arunico, clprevia, clrevisao, clVII-8; null without a number."""
    plain = unaccented(F.coalesce(col(c), F.lit("")))
    shape = r"(?i)^\s*(clausula|artigo)\s+(.+?)\s*(?:\s-\s.*)?$"
    kind, original = F.lower(F.substring(F.regexp_extract(plain, shape, 1), 1, 2)), F.regexp_extract(plain, shape, 2)
    n = F.lower(original)
    digits = r"^(\d+)\s*\.?\s*[ªº]?(?:\s*-\s*([a-z]))?(?U)\b"
    roman = r"^([IVXLC]+)(?:\s*-\s*(\d+))?(?![A-Za-z])"
    integer = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
    first = lambda k: ordinal_value(F.array_join(F.slice(F.split(n, r"\s+"), 1, k), " ")).cast("string")
    value = (
        F.when(n.rlike(digits), F.concat(integer(F.regexp_extract(n, digits, 1)), F.upper(F.regexp_extract(n, digits, 2))))
        .when(n.rlike(r"^unic[oa]\b"), "unico")
        .when(n.rlike(r"^(previ[oa]|preliminar)\b"), "previa")
        .when(n.rlike(r"^de\s+revisao\b"), "revisao")
        .when(original.rlike(roman), F.concat_ws("-", F.regexp_extract(original, roman, 1), F.nullif(integer(F.regexp_extract(original, roman, 2)), F.lit(""))))
        .otherwise(F.coalesce(first(3), first(2), first(1)))
    )
    return F.when(kind != "", F.concat(kind, value))


def item_text(c: Column | str) -> Column:
    """Text of a layout item on one line; null for furniture and lone numbers; loose hyphens joined."""
    t = strip(F.regexp_replace(F.regexp_replace(col(c), "[\n\t]", " "), rf"{BLANK}{{2,}}", " "))
    drop = (t == "") | one_of(t, rf"^{P.BULLETIN}\b", r"^\d{1,2}\s+(?:de\s+)?[a-zç]+\s+(?:de\s+)?\d{4}$", "^BT?E$", r"^\p{Nd}+$")
    return F.when(~drop, F.regexp_replace(t, r"([a-zà-ú]) -([a-zà-ú])", "$1$2"))


def list_item(text: Column, original: Column, marker: Column) -> Column:
    """struct(text, recovered): own marker, glued number, marker of the source text, given marker, or a dash (not recovered)."""
    bare = F.regexp_replace(text, r"^[-•]\s+(?=\d+(?:\s*[-–—.)]|[A-ZÀ-Ú])|[a-zà-ú]\))", "")
    source = F.regexp_extract(strip(F.coalesce(original, F.lit(""))), r"^(\d+\s*[-–—.)]|[a-zà-ú]\)|[ivxl]+\))\s*", 1)
    lead = F.coalesce(F.nullif(source, F.lit("")), F.nullif(strip(F.coalesce(marker, F.lit(""))), F.lit("")))
    own = bare.rlike(r"^(?:\d+\s*[-–—.)]|[a-zà-ú]\)|[ivxl]+\)|[-–—•·])")
    glued = bare.rlike(P.GLUED_LIST_NUMBER)
    shown = F.when(glued, F.regexp_replace(bare, P.GLUED_LIST_NUMBER, "$1- ")).when(own, bare).otherwise(F.concat(F.coalesce(lead, F.lit("-")), F.lit(" "), bare))
    return F.struct(shown.alias("text"), (glued | own | lead.isNotNull()).alias("recovered"))


def title_of_file(c: Column | str) -> Column:
    """A heading made of a file's name."""
    stem = F.regexp_replace(F.element_at(F.split(col(c), "/"), -1), r"\.[^.]*$", "")
    return F.concat(F.lit("# "), escaped_markdown(F.replace(stem, F.lit("_"), F.lit(" "))))


def subtype_of_file(c: Column | str) -> Column:
    stem = F.regexp_replace(F.element_at(F.split(col(c), "/"), -1), r"\.[^.]*$", "")
    return F.when(F.upper(stem).contains("-RECT_"), "retificacao").otherwise("desconhecido")


def repaired_words(text: Column, vocabulary: Column) -> Column:
    """Words cut as `left - right` joined where the right part starts lower and the whole is in the vocabulary (an array)."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(P.WRAPPED), F.lit(0)))

    def step(done: Column, cut: Column) -> Column:
        left, right = F.regexp_extract(cut, P.WRAPPED, 1), F.regexp_extract(cut, P.WRAPPED, 2)
        whole = F.concat(left, right)
        return F.when(right.rlike(r"^\p{Ll}") & F.array_contains(vocabulary, whole), F.regexp_replace(done, F.concat(F.lit(r"(?<!\p{L})\Q"), cut, F.lit(r"\E(?!\p{L})")), whole)).otherwise(done)

    return F.aggregate(found, text, step)


#: Functions of one text that register_functions publishes, by SQL name.
SCALARS = {
    "normal_name": normal_name, "doc_words": words, "unix_lines": unix_lines, "joined_hyphens": joined_hyphens, "tidy_lines": tidy_lines,
    "repaired_markers": repaired_markers, "cell_text": cell_text, "amounts": amounts, "is_furniture": is_furniture, "has_furniture": has_furniture,
    "without_header_prefix": without_header_prefix, "without_dated_header": without_dated_header, "mostly_numbers": mostly_numbers,
    "looks_like_table": looks_like_table, "is_reversed": is_reversed, "char_classes": char_classes, "safe_name": safe_name, "whole_number": whole_number,
    "url_error": url_error, "escaped_markdown": escaped_markdown, "escaped_report": escaped_report, "fenced": fenced, "family": family,
    "ordinal_value": ordinal_value, "number_key": number_key, "item_text": item_text, "title_of_file": title_of_file, "subtype_of_file": subtype_of_file,
}


def register_functions(spark: SparkSession) -> list[str]:
    """Publishes the SCALARS as temporary SQL functions and returns their names.

    A function is its expression, expanded into the calling plan, so Catalyst sees through it. Expressions with lambda
    functions have no SQL text and stay Column builders.
    """
    names = []
    for name, build in SCALARS.items():
        probe = spark.range(0).select(F.lit("").alias("t")).select(build("t").alias("r"))
        body = probe._jdf.queryExecution().analyzed().expressions().head().child().sql()
        if "lambdafunction" not in body:
            kind = probe.schema["r"].dataType.simpleString()
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS {kind} RETURN {body}")
            names.append(name)
    return names
