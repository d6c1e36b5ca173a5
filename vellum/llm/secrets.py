"""Secret scans in DataFrame functions only: three base patterns and a sliding-window entropy scan.

Positions come from splitting a text by a pattern: the gaps between matches and the matches themselves, from the same
regular expression engine, add up to code point offsets. The entropy of a window of W characters is
log2(W) - S / W, where S sums c * log2(c) over the counts of its characters; moving the window by one changes two counts,
so S is updated, never recomputed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"([0-9a-f]{16,})"  # maximal runs, so the length can stand in the pattern
KINDS = ("assign", "access", "hex", "entropy")
#: Per character class: candidate pattern, alphabet, window, least bits per character.
CLASSES = {
    "base64": (r"([A-Za-z0-9+/_=-]{20,})", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 20, 3.9),
    "hex": (r"([0-9A-Fa-f]{32,})", "0123456789abcdefABCDEF", 32, 3.2),
}
#: Candidates that are no secrets whatever their entropy.
ALLOWED = (
    r"^[^0-9]+$",
    r"^[^A-Za-z]+$",
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"^/?(?:[A-Za-z]+[0-9]{0,4}[_/=-])+[A-Za-z]*[0-9]{0,4}$",
    r"(?i)example|sample|dummy|placeholder|x{6}|abcdefgh|12345678",
)


def _found(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches: array of struct(start, end, whole, value)."""
    empty = F.array().cast("array<struct<start:int,end:int,whole:string,value:string>>")
    zipped = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"), F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("value")
    )

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        return F.struct((start + F.coalesce(F.length(x["whole"]), F.lit(0))).alias("at"), F.concat(acc["out"], F.array(start)).alias("out"))

    # The fold keeps places only: texts of many matches copy a few bytes for each match before, not the matches.
    starts = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])
    both = F.filter(F.arrays_zip(zipped.alias("x"), starts.alias("start")), lambda z: z["x"]["whole"].isNotNull())
    items = F.transform(both, lambda z: F.struct(z["start"].alias("start"), (z["start"] + F.length(z["x"]["whole"])).alias("end"), z["x"]["whole"].alias("whole"), z["x"]["value"].alias("value")))
    return F.when(text.rlike(pattern), items).otherwise(empty)


def _nlogn(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def _entropy_span(item: Column, alphabet: str, window: int, bits: float) -> Column:
    """struct(start, end) over the windows of a candidate with enough entropy; null without any."""
    most = window * (F.log2(F.lit(float(window))) - F.lit(bits)) + F.lit(1e-9)
    place = {c: i for i, c in enumerate(alphabet)}
    index = F.create_map(*[x for c, i in place.items() for x in (F.lit(c), F.lit(i))])
    codes = F.transform(F.split(item["whole"], ""), lambda c: F.element_at(index, c))

    def step(acc: Column, i: Column) -> Column:
        x = F.get(acc["codes"], i)
        y = F.when(i >= window, F.get(acc["codes"], i - window)).otherwise(F.lit(-1))
        before = F.get(acc["counts"], x)
        leaving = F.when(y >= 0, F.get(acc["counts"], y) + F.when(x == y, F.lit(1)).otherwise(F.lit(0))).otherwise(F.lit(0))
        s = acc["s"] + _nlogn(before + 1) - _nlogn(before) + _nlogn(leaving - 1) - _nlogn(leaving)
        counts = F.transform(acc["counts"], lambda c, k: c + F.when(k == x, 1).otherwise(0) - F.when(k == y, 1).otherwise(0))
        hit = (i >= window - 1) & (s <= most)
        return F.struct(
            acc["codes"].alias("codes"), counts.alias("counts"), s.alias("s"),
            F.when(hit & (acc["first"] < 0), i - (window - 1)).otherwise(acc["first"]).alias("first"),
            F.when(hit, i + 1).otherwise(acc["last"]).alias("last"),
        )

    start = F.struct(
        codes.alias("codes"), F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0.0).alias("s"), F.lit(-1).alias("first"), F.lit(-1).alias("last"),
    )
    done = lambda acc: F.when(acc["first"] >= 0, F.struct((item["start"] + acc["first"]).alias("start"), (item["start"] + acc["last"]).alias("end")))
    return F.aggregate(F.sequence(F.lit(0), F.length(item["whole"]) - 1), start, step, done)


def _suspects(text: Column, name: str) -> Column:
    """Spans of one character class, allow-listed candidates left out."""
    pattern, alphabet, window, bits = CLASSES[name]
    allowed = lambda x: F.greatest(*[x["whole"].rlike(a) for a in ALLOWED])
    items = F.filter(_found(text, pattern), lambda x: ~allowed(x))
    return F.filter(F.transform(items, lambda x: _entropy_span(x, alphabet, window, bits)), lambda x: x.isNotNull())


def _tag(items: Column, kind: str) -> Column:
    return F.transform(items, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end")))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(F.array_distinct(spans)), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def secret_scan(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    A null text is empty: no spans, the digest of the empty string. Rows are independent, so ids may be null or repeated;
    other columns are ignored. Offsets are code points, ends exclusive. Entropy spans (kind `entropy`) come on top of the
    base ones, which the allow-list never touches.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(
        F.col(id).alias("doc_id"),
        F.filter(_found(t, ASSIGN), lambda x: F.length(x["value"]) >= 12).alias("x_assign"),
        F.filter(_found(t, ACCESS), lambda x: F.length(x["whole"]) >= 18).alias("x_access"),
        _found(t, HEX).alias("x_hex"),
        F.concat(*[_suspects(t, name) for name in CLASSES]).alias("x_entropy"),
    )
    spans = found.select(
        "doc_id", *[F.size(f"x_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.concat(*[_tag(F.col(f"x_{k}"), k) for k in KINDS[:3]]).alias("x_base"), _tag(F.col("x_entropy"), "entropy").alias("x_more"),
    )
    return spans.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(_joined(F.col("x_base")), 256).alias("base_sha256"), _joined(F.concat("x_base", "x_more")).alias("spans"),
    )
