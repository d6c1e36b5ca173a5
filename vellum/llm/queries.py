"""The operators' queries with production parameters, each over its whole table, and SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers

from .bpe import encode_decode
from .common import documents
from .exact import exact_dedup
from .language import predict_language
from .media import media_features
from .mixing import interleave, mix
from .near import near_dedup
from .repeats import remove_repeats
from .secrets import secret_scan
from .token_counts import token_counts

QUERIES = {
    "op1_suffix_dedup": lambda spark, sf: remove_repeats(documents(spark, sf)).drop("spans"),
    "op2_ogg_media": lambda spark, sf: media_features(documents(spark, sf)),
    "op3_minhash_forest": lambda spark, sf: near_dedup(documents(spark, sf)),
    "op4_mix_sources": lambda spark, sf: mix(documents(spark, sf)),
    "op5_interleave_shards": lambda spark, sf: interleave(documents(spark, sf)),
    "op6_byte_bpe": lambda spark, sf: encode_decode(documents(spark, sf), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
    "op7_token_counts": lambda spark, sf: token_counts(documents(spark, sf), public_tokenizers.path("piece_bpe_32k.model")),
    "op8_language_mixture": lambda spark, sf: predict_language(documents(spark, sf)),
    "op9_exact_dedup": lambda spark, sf: exact_dedup(documents(spark, sf)),
    "op10_secret_scan": lambda spark, sf: secret_scan(documents(spark, sf)),
}

ORACLES = {
    "op9_exact_dedup": r"""
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)""",
    "op4_mix_sources": r"""
WITH t AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
             md5(concat_ws('|', '17', coalesce(doc_id::VARCHAR, 'null'), strlen(coalesce(text, '')), left(coalesce(text, ''), 32), right(coalesce(text, ''), 32))) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM t GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap,
        row_number() OVER (ORDER BY source NULLS LAST) AS r FROM s),
f AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER p, 0) AS rest,
        sum(w) OVER () - coalesce(sum(w) OVER p, 0) AS open
      FROM w WINDOW p AS (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, cap * open <= w * rest AS full_ FROM f),
l AS (SELECT arg_min(rest / open, {'a': cap / w, 'b': r}) AS level FROM g WHERE NOT full_),
target AS (SELECT source, source_size, CASE WHEN full_ THEN cap ELSE w * level END AS target FROM g, (SELECT (SELECT level FROM l) AS level)),
b AS (SELECT t.*, source_size, target, coalesce(sum(size) OVER (PARTITION BY t.source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) ELSE 0 END AS epochs
      FROM t JOIN target ON t.source IS NOT DISTINCT FROM target.source)
SELECT doc_id, size, source_size, target,
  (epochs * size + least(size, greatest(0, floor(target) - epochs * source_size - before)))::BIGINT AS taken FROM b""",
}
