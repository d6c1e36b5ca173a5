"""Language identification as a mixture: EM estimates each document's language proportions from n-gram likelihoods.

Training counts byte trigrams by language over every training document. A document's units are its words; a unit's
likelihood in a language is the product over its trigrams. EM finds the share of each language among the units; the
language set is the one with the largest likelihood less a penalty for each further language, sets being grown in order
of their share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import Scratch, blocks, columns_of, free_name, utf8

#: The model is broadcast: buckets of trigrams by languages, 128 MB of floats. With more than 512 languages each gets fewer buckets.
BITS, MODEL = 16, 1 << 25
#: Floats that a slice of a text's trigrams by languages may take, and languages whose counts are gathered at once.
SLICE, AT_ONCE = 1 << 22, 64
UNDETERMINED = "und"
#: ASCII letters fold to lower case, other ASCII characters separate, all other bytes stay.
_FOLD = np.array([b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def _trigrams(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, each position's trigram bucket (no trigram crosses documents), offsets, positions that say nothing."""
    raw, off = utf8(column)
    a = _FOLD[raw]
    b, c = np.full_like(a, 32), np.full_like(a, 32)
    b[1:], c[2:] = a[:-1], a[:-2]
    starts = off[:-1][np.diff(off) > 0]
    b[starts] = c[starts] = 32
    c[starts[starts + 1 < len(a)] + 1] = 32
    g = (c.astype(np.uint32) << 16) | (b.astype(np.uint32) << 8) | a
    return a, ((g * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)).astype(np.int32), off, (a == 32) & (b == 32)


def _count(bits: int):
    """Counts by language and bucket; at most AT_ONCE languages are held, the rest goes out and is summed later."""

    def said(held: dict) -> pa.RecordBatch:
        found = [(lang, np.flatnonzero(counts)) for lang, counts in held.items()]
        names = pa.array([lang for lang, at in found for _ in range(len(at))], pa.string())
        buckets = np.concatenate([at for _, at in found]).astype(np.int32)
        return pa.RecordBatch.from_arrays([names, pa.array(buckets), pa.array(np.concatenate([held[lang][at] for lang, at in found]).astype(np.int64))], ["x_lang", "x_bucket", "x_n"])

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for batch in blocks(batches, "x_text", 4 << 20):
            _, buckets, off, idle = _trigrams(batch.column(0), bits)
            langs = batch.column(1).to_pylist()
            for lang in set(langs):
                own = np.repeat(np.array([x == lang for x in langs]), np.diff(off)) & ~idle
                held[lang] = held.get(lang, 0) + np.bincount(buckets[own], minlength=1 << bits)
                if len(held) > AT_ONCE:
                    yield said(held)
                    held = {}
        if held:
            yield said(held)

    return run


def train(docs: DataFrame, text: str = "text", lang: str = "lang", smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """The languages, sorted, and log probabilities (bucket, language). Rows without text or language teach nothing.

    What the driver gathers is bounded by the model's size, MODEL floats, with 256 buckets for a language at least.
    """
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("x_text"), F.col(lang).cast("string").alias("x_lang"))
    scratch = Scratch(docs.sparkSession)
    named = scratch.save(rows.select("x_lang").distinct())
    bits = max(8, min(BITS, int(np.log2(MODEL / max(named.count(), 1)))))
    counts = scratch.save(rows.mapInArrow(_count(bits), "x_lang string, x_bucket int, x_n long").groupBy("x_lang", "x_bucket").agg(F.sum("x_n").alias("x_n")))
    langs = sorted(r[0] for r in named.limit((MODEL >> 8) + 1).collect())
    if len(langs) > MODEL >> 8:
        raise ValueError(f"more than {MODEL >> 8} languages")
    model = np.full((1 << bits, len(langs)), smoothing)
    for a in range(0, len(langs), AT_ONCE):
        own = counts.filter(F.col("x_lang").isin(langs[a : a + AT_ONCE])).toArrow()
        place = {name: k for k, name in enumerate(langs)}
        model[own.column("x_bucket").to_numpy(), [place[x] for x in own.column("x_lang").to_pylist()]] += own.column("x_n").to_numpy()
    scratch.drop(counts, named)
    return langs, np.log(model / model.sum(0)).astype(np.float32) if langs else model.astype(np.float32)


def _em(a: np.ndarray, first: np.ndarray, n: np.ndarray, pi: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares of each document and its log likelihood (of scaled a). a: units by languages; first, n: a document's units."""
    for _ in range(rounds):
        r = a * np.repeat(pi, n, axis=0)
        r /= r.sum(1, keepdims=True)
        pi = np.add.reduceat(r, first, axis=0) / n[:, None]
    seen = (a * np.repeat(pi, n, axis=0)).sum(1)
    return pi, np.add.reduceat(np.log(np.maximum(seen, 1e-300)), first)


def mixtures(column: pa.Array, model: np.ndarray, penalty: float = 4.0, rounds: int = 10) -> np.ndarray:
    """Language shares of each text; zeros for texts without a byte, and for languages outside the chosen set.

    Trigrams are scored in slices; what is held of a text is a few bytes for each of its own and a row for each of its words.
    """
    bits = max(model.shape[0].bit_length() - 1, 1)
    _, buckets, off, idle = _trigrams(column, bits)
    size, shares = np.diff(off), np.zeros((len(column), model.shape[1]))
    full = np.flatnonzero(size)
    if not len(full) or not model.shape[1]:
        return shares
    word = ~idle & np.concatenate([[True], idle[:-1] | (_FOLD[utf8(column)[0]][:-1] == 32)])
    word[off[:-1][full]] = True
    at = np.flatnonzero(word)
    units = np.zeros((len(at), model.shape[1]))
    step = max(1, SLICE // model.shape[1])
    for a in range(0, len(buckets), step):
        score = model[buckets[a : a + step]]
        score[idle[a : a + step]] = 0
        low = int(np.searchsorted(at, a, "right")) - 1  # the word that the slice begins in, if any
        begin = at[low + 1 : int(np.searchsorted(at, a + step))] - a
        if low >= 0:
            begin = np.append(0, begin)
        elif not len(begin):
            continue
        units[max(low, 0) : max(low, 0) + len(begin)] += np.add.reduceat(score, begin, axis=0)
    n = np.diff(np.searchsorted(at, np.append(off[:-1][full], off[-1])))
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    top = units.max(1, keepdims=True)
    a = np.exp(np.maximum(units - top, -60.0))
    single = np.add.reduceat(np.maximum(units - top, -60.0), first, axis=0)
    best = single.argmax(1)
    value = single[np.arange(len(full)), best]
    out = np.zeros((len(full), model.shape[1]))
    out[np.arange(len(full)), best] = 1.0
    cost = penalty + 0.5 * np.log(n)
    pi, likely = _em(a, first, n, np.full(out.shape, 1.0 / out.shape[1]), rounds)
    more = np.flatnonzero(likely - cost > value)  # for all others even every language at once gains less than one more costs
    ranked = np.argsort(-pi, axis=1, kind="stable")
    for k in range(2, model.shape[1] + 1):
        if not len(more):
            break
        rows = np.concatenate([np.arange(first[d], first[d] + n[d]) for d in more])
        allowed = np.zeros((len(more), model.shape[1]))
        np.put_along_axis(allowed, ranked[more, :k], 1.0 / k, axis=1)
        own = n[more]
        shares_k, likely_k = _em(a[rows], np.concatenate([[0], np.cumsum(own)[:-1]]), own, allowed, rounds)
        gain = likely_k - (k - 1) * cost[more] > value[more]
        hit = more[gain]
        out[hit], value[hit] = shares_k[gain], (likely_k - (k - 1) * cost[more])[gain]
        more = hit if k > 2 else more  # a first language that isn't the best alone may need its partner
    shares[full] = out
    return shares


def _has_letter(texts: list) -> list[bool]:
    return [t is not None and any(map(str.isalpha, t)) for t in texts]


def identify(docs: DataFrame, langs: list[str], model: np.ndarray, text: str = "text") -> DataFrame:
    """docs and three more columns, the last ones: the predicted language, its share, and the shares of the chosen set.

    They are named x_lang_pred, x_score and x_shares, or longer where docs has such names. A null text, one without a
    letter, or a model without languages gives `und`, 0 and no shares.
    """
    shared = docs.sparkSession.sparkContext.broadcast((langs, model))
    numbered = [f"c{k}" for k in range(len(docs.columns) + 1)]

    def run(batches):
        langs, model = shared.value
        for batch in blocks(batches, numbered[-1], 1 << 20):
            texts = batch.column(batch.num_columns - 1)
            shares = mixtures(texts, model)
            ok = np.array(_has_letter(texts.to_pylist()), bool) & (shares.sum(1) > 0)
            best = shares.argmax(1) if len(langs) else np.zeros(len(ok), int)
            names = [langs[b] if good else UNDETERMINED for b, good in zip(best, ok, strict=True)]
            scores = [min(1.0, float(s[b])) if good else 0.0 for s, b, good in zip(shares, best, ok, strict=True)]
            said = [",".join(f"{langs[j]}:{s[j]:.4f}" for j in np.argsort(-s, kind="stable") if s[j] > 0) if good else "" for s, good in zip(shares, ok, strict=True)]
            extra = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(said, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *extra], schema.names)

    schema = StructType([*docs.schema.fields, *(StructField(free_name(docs, n), k) for n, k in (("x_lang_pred", StringType()), ("x_score", DoubleType()), ("x_shares", StringType())))])
    return docs.select("*", F.col(text).alias(free_name(docs, "x_text"))).toDF(*numbered).mapInArrow(run, schema)


def keep_identified(docs: DataFrame, langs: list[str], model: np.ndarray, text: str = "text") -> DataFrame:
    """The rows of docs that have a language, with all columns of docs, whatever their names."""
    found = identify(docs, langs, model, text)
    return found.filter(F.col(found.columns[-3]) != UNDETERMINED).select(columns_of(docs))


def held_out(id: str, parts: int = 5):
    """Whether a document is kept from training; rows without an id are."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % parts, F.lit(0)) == 0


def predict_language(docs: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id") -> DataFrame:
    """Per input row: doc_id, held_out, lang_pred, score, shares; learned from the rows that aren't held out.

    score is the share of the document's units in the predicted language. Null or letterless texts are `und` with score 0,
    as is all of a table without training rows. Ids may repeat; other columns are ignored.
    """
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("x_t"), F.col(lang).alias("x_l"), held_out(id).alias("held_out"))
    langs, model = train(rows.filter(~F.col("held_out")), "x_t", "x_l")
    found = identify(rows.select("doc_id", "held_out", "x_t"), langs, model, "x_t")
    return found.select("doc_id", "held_out", F.col("x_lang_pred").alias("lang_pred"), F.col("x_score").alias("score"), F.col("x_shares").alias("shares"))
