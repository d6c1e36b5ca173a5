"""Token counts of a subword model, computed in Arrow functions that return lengths only.

No piece of the model holds a space after another character, so a merge never crosses the point before a run of spaces:
texts split there, long ones included, and a batch's distinct units are encoded once. Batches are balanced by bytes.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, utf8

MARK = "▁"
_UNITS = re.compile(" +[^ ]+| +")
_MODELS: dict = {}


def load(path: str):
    """The model, once in each worker. Raises if a piece would make the split points unsafe."""
    if path not in _MODELS:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if any(MARK in model.id_to_piece(i).lstrip(MARK) for i in range(model.get_piece_size())):
            raise ValueError("the model has pieces that cross a space")
        _MODELS[path] = model
    return _MODELS[path]


def count_batch(model, texts: pa.Array) -> np.ndarray:
    """Tokens of each text. The model reads a text with one space before it, and its mark as a space."""
    texts = pc.replace_substring(texts.fill_null(""), MARK, " ")
    plain = pc.split_pattern(texts, " ")
    words, off = plain.flatten(), np.asarray(plain.offsets) - plain.offsets[0].as_py()
    coded = words.dictionary_encode()
    units = coded.dictionary.to_pylist()
    lengths = np.fromiter((len(x) for x in model.encode(units, num_threads=1)), np.int64, len(units))
    each = np.zeros(len(words) + 1, np.int64)
    if len(words):
        np.cumsum(lengths[np.asarray(coded.indices)], out=each[1:])
    counts = each[off[1:]] - each[off[:-1]]
    # An empty word means a run of spaces, or one at an end; such texts go by whole units.
    odd = pc.or_(pc.match_substring_regex(texts, "^ |  | $"), pc.equal(texts, "")).to_numpy(zero_copy_only=False)
    for i in np.flatnonzero(odd):
        text = texts[int(i)].as_py()
        found = _UNITS.findall(" " + text) if text else []
        seen = dict.fromkeys(u[1:] for u in found)
        for unit, ids in zip(seen, model.encode(list(seen), num_threads=1), strict=True):
            seen[unit] = len(ids) if unit else 1
        counts[i] = sum(seen[u[1:]] for u in found)
    return counts


def token_counts(docs: DataFrame, model: str, limit: int = 4096, text: str = "text", id: str = "doc_id", batch_bytes: int = 2 << 20) -> DataFrame:
    """Per input row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit); model is the path of a model file.

    A null text is empty and has no tokens. Special strings in texts are ordinary text; no begin, end or padding. Rows are
    independent, so ids may be null or repeated; other columns are ignored. Memory is bounded by batch_bytes or the
    longest single text.
    """

    def run(batches):
        own = load(model)
        for batch in blocks(batches, "x_text", batch_bytes):
            texts = batch.column(1)
            counts, sizes = count_batch(own, texts), np.diff(utf8(texts)[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(counts), pa.array(counts > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id).cast("long").alias("x_id"), F.col(text).alias("x_text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
