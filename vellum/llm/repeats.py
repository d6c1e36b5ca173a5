"""Suffix-array dedup: bytes covered by a string of `length` bytes that also starts elsewhere in the corpus.

Sharding keeps equal strings together: each string of `length` bytes belongs to the least of its GRAM-byte grams (by hash,
the first of equals), and runs of neighbouring strings with one such anchor are cut out as a piece. Equal strings have
equal anchors at equal distances. A piece's strings are dealt by that distance into two units; all strings of a unit share
the bytes of a window around the anchor, so equal strings are in units with one window, and a unit whose window nobody
else has holds no repeat. Equal pieces are one, with a count; equal texts are one text, with a count.

The units of a window meet in a shard, which is sorted by external induced suffix sorting (suffixes.py); its common-prefix
values show every string that starts twice. Where a window is CROWDED (a passage in very many texts), its units are cut
into smaller ones with longer windows, again and again, down to single strings, which are counted with map-side sums: no
task gets a crowd, and units that the longer windows tell apart go.
"""

from __future__ import annotations

import hashlib
import os
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, blocks, utf8
from .suffixes import Shard

LENGTH, GRAM = 400, 32
#: An anchor with one piece in so many is frequent.
HEAVY = 1024
#: A window with more units than this is crowded; its units are cut into PARTS.
CROWDED, PARTS = 2048, 4
#: Bytes of a shard where there are more than shuffle partitions would hold.
SHARD = 256 << 20
#: Positions in a keyed gram; longer texts are cut into parts of PART string starts.
PLACE = np.uint64((1 << 24) - 1)
PART = 4 << 20
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 21)
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            factors = np.full(size + 1, base, np.uint64)
            factors[0] = 1
            _POWERS.append(np.cumprod(factors))
        del _POWERS[:-2]
    return _POWERS[0], _POWERS[1]


def _grams(raw: np.ndarray) -> np.ndarray:
    """A well mixed 64-bit hash of the gram at each position."""
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * down[: len(raw) - GRAM + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        keys = np.minimum(keys[:-span], keys[span:])
        span *= 2
    return np.minimum(keys[: len(keys) - (width - span)], keys[width - span :]) if width > span else keys


def pieces(raw: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of strings with one anchor over texts end to end: anchor hash, text, start in the text, strings, anchor in the text."""
    none = np.zeros(0, np.int64)
    out = [(none.astype(np.uint64), none, none, none, none)]
    size = np.diff(off)
    doc = 0
    while doc < len(size):
        end = doc + 1
        while end < len(size) and off[end + 1] - off[doc] <= PART:
            end += 1
        for base in range(int(off[doc]), int(off[end]), PART):
            part = raw[base : min(int(off[end]), base + PART + length - 1)]
            if len(part) < length:
                continue
            h = _grams(part)
            m = _least((h & ~PLACE) | np.arange(len(h), dtype=np.uint64), length - GRAM + 1)
            valid = np.zeros(len(m) + 1, bool)
            own = np.zeros(len(m), np.int32)
            for d in range(doc, end):
                a, b = max(int(off[d]) - base, 0), min(int(off[d + 1]) - base - length + 1, len(m), PART)
                if b > a:
                    valid[a:b] = True
                    own[a:b] = d
            new = valid[:-1].copy()
            new[1:] &= (m[1:] != m[:-1]) | ~valid[:-2] | (own[1:] != own[:-1])
            s = np.flatnonzero(new)
            stop = np.flatnonzero(valid[:-1] & (np.append(new[1:], True) | ~valid[1:])) + 1
            at, d = (m[s] & PLACE).astype(np.int64), own[s].astype(np.int64)
            out.append((h[at], d, s + base - off[d], stop - s, at + base - off[d]))
        doc = end
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


_SCAN = "x_id long, x_key binary, x_n long, x_sha string, x_f array<long>, x_start array<int>, x_count array<int>, x_anchor array<int>"


def _scan(length: int):
    """A row for each document; the pieces only where a task first sees a text."""

    def run(batches):
        seen: set[bytes] = set()
        for batch in blocks(batches, "x_text", 2 << 20):
            raw, off = utf8(batch.column(1))
            data = raw.tobytes()
            texts = [data[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            keys = [hashlib.blake2b(t, digest_size=16).digest() for t in texts]
            if len(seen) > 1_000_000:
                seen.clear()
            fresh = []
            for i, key in enumerate(keys):
                if key not in seen:
                    seen.add(key)
                    fresh.append(i)
            kept = b"".join(texts[i] for i in fresh)
            own = np.concatenate([[0], np.cumsum([len(texts[i]) for i in fresh])]).astype(np.int64)
            f, d, start, count, anchor = pieces(np.frombuffer(kept, np.uint8), own, length)
            n = np.zeros(len(texts), np.int64)
            n[fresh] = np.bincount(d, minlength=len(fresh))
            lists = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            columns = [pa.ListArray.from_arrays(lists, pa.array(x)) for x in (f.view(np.int64), start.astype(np.int32), count.astype(np.int32), anchor.astype(np.int32))]
            shas = [hashlib.sha256(t).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(np.diff(off)), pa.array(shas), *columns], ["x_id", "x_key", "x_n", "x_sha", "x_f", "x_start", "x_count", "x_anchor"]
            )

    return run


def _bodies(batches):
    """(key, packed text), once for each text that a task sees."""
    pack, seen = zstandard.ZstdCompressor(level=3), set()
    for batch in blocks(batches, "x_text", 4 << 20):
        keys, packed = [], []
        if len(seen) > 1_000_000:
            seen.clear()
        for t in batch.column(0).to_pylist():
            raw = (t or "").encode("utf-8", "surrogatepass")
            key = hashlib.blake2b(raw, digest_size=16).digest()
            if key not in seen:
                seen.add(key)
                keys.append(key)
                packed.append(pack.compress(raw))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(packed, pa.binary())], ["x_key", "x_body"])


def _digest(raw: bytes, size: int = 16) -> bytes:
    return hashlib.blake2b(raw, digest_size=size).digest()


def _parts(raw: bytes, lo: int, hi: int, anchor: int, near: int, far: int, length: int, parts: int):
    """Cuts the strings that start at lo..hi, near <= anchor - start < far, by that distance: (lo, hi, near, far, window's digest).

    Windows that only bring units together have short digests; one that is a whole string is known by its digest.
    """
    for k in range(parts):
        a, b = near + (far - near) * k // parts, near + (far - near) * (k + 1) // parts
        first, final = max(lo, anchor - b + 1), min(hi, anchor - a)
        if first <= final:
            yield first, final, a, b, _digest(raw[anchor - a : anchor - b + 1 + length], 16 if b - a == 1 else 8)


def _table(rows: list, schema: str) -> pa.RecordBatch:
    names, kinds = zip(*[x.split(" ") for x in schema.split(", ")], strict=True)
    types = {"binary": pa.binary(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(columns, kinds, strict=True)], list(names))


_UNITS = "x_key binary, x_lo int, x_hi int, x_anchor int, x_near int, x_far int, x_single boolean, x_window binary"
_PIECES = "x_key binary, x_lo int, x_hi int, x_anchor int, x_same binary, x_window0 binary, x_window1 binary"


def _pieces(length: int):
    """The digests of each piece and of the windows of its two units (null: it has no string there)."""
    span = length - GRAM + 1

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for some in blocks_of(batch):
                rows = []
                for key, body, hits in zip(*[c.to_pylist() for c in some.columns], strict=True):
                    raw = unpack.decompress(body)
                    for h in hits:
                        lo, hi, anchor = h["x_start"], h["x_start"] + h["x_count"] - 1, h["x_anchor"]
                        windows = {a > 0: w for _, _, a, _, w in _parts(raw, lo, hi, anchor, 0, span, length, 2)}
                        rows.append((key, lo, hi, anchor, _digest(raw[lo : hi + length]), windows.get(False), windows.get(True)))
                yield _table(rows, _PIECES)

    return run


def blocks_of(batch: pa.RecordBatch, most: int = 512):
    return (batch.slice(i, most) for i in range(0, batch.num_rows, most))


def _smaller(length: int):
    """Cuts units into PARTS, by distance from the anchor."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for some in blocks_of(batch):
                rows = []
                for key, body, units in zip(*[c.to_pylist() for c in some.columns], strict=True):
                    raw = unpack.decompress(body)
                    for u in units:
                        near, far, anchor = u["x_near"], u["x_far"], u["x_anchor"]
                        cut = _parts(raw, u["x_lo"], u["x_hi"], anchor, near, far, length, min(PARTS, far - near))
                        rows += [(key, first, final, anchor, a, b, u["x_single"], w) for first, final, a, b, w in cut]
                yield _table(rows, _UNITS)

    return run


_STRINGS = "x_window binary, x_key binary, x_lo int, x_count int, x_single boolean, x_bytes binary"


def _strings(length: int):
    """The bytes of units."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for some in blocks_of(batch):
                rows = []
                for key, body, units in zip(*[c.to_pylist() for c in some.columns], strict=True):
                    raw = unpack.decompress(body)
                    rows += [(u["x_window"], key, u["x_lo"], u["x_hi"] - u["x_lo"] + 1, u["x_single"], raw[u["x_lo"] : u["x_hi"] + length]) for u in units]
                yield _table(rows, _STRINGS)

    return run


_PLACE = np.dtype([("key", "V16"), ("lo", "<i4"), ("count", "<i4"), ("at", "<i8")])
_RUNS = "x_key binary, x_a int, x_b int"


def _sorted_shard(length: int, budget: int):
    """One shard: the repeated intervals of its units. The units' texts and places lie in files."""

    def run(batches):
        shard = Shard(budget)
        spool = open(os.path.join(shard.folder, "places"), "w+b")  # noqa: SIM115
        try:
            held = 0
            for batch in batches:
                for some in blocks_of(batch, 4096):
                    places = []
                    for _, key, lo, count, single, data in zip(*[c.to_pylist() for c in some.columns], strict=True):
                        at = shard.add(data)
                        if single:  # of a piece that occurs again every string is known to
                            places.append((key, lo, count, at))
                    np.array(places, _PLACE).tofile(spool)
                    held += len(places)
            flags = shard.repeated(length)
            spool.flush()
            places = np.memmap(spool.name, _PLACE, "r", shape=(held,)) if held else np.zeros(0, _PLACE)
            for a in range(0, held, 10_000):
                out = []
                for p in places[a : a + 10_000]:
                    at, count, lo = int(p["at"]), int(p["count"]), int(p["lo"])
                    own = flags[at : at + count]
                    if own.any():
                        hit = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
                        out += [(p["key"].tobytes(), lo + x, lo + y + length - 1) for x, y in hit.reshape(-1, 2).tolist()]
                yield _table(out, _RUNS)
        finally:
            spool.close()
            shard.close()

    return run


def _removed(batches):
    """Per text: the maximal repeated runs, and the digest of what remains."""
    unpack = zstandard.ZstdDecompressor()
    names = ["x_key", "x_removed", "x_spans", "x_kept"]
    for batch in batches:
        out = []
        for key, body, runs in (r for some in blocks_of(batch) for r in zip(*[c.to_pylist() for c in some.columns], strict=True)):
            raw = unpack.decompress(body)
            kept, at, spans = hashlib.sha256(), 0, []
            for r in sorted(runs, key=lambda r: (r["x_a"], r["x_b"])):
                if spans and r["x_a"] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], r["x_b"])
                else:
                    spans.append([r["x_a"], r["x_b"]])
            for a, b in spans:
                kept.update(raw[at:a])
                at = b
            kept.update(raw[at:])
            out.append((key, sum(b - a for a, b in spans), spans, kept.hexdigest()))
        types = (pa.binary(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.string())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


def remove_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text", id: str = "doc_id", budget: int = 64 << 20, crowded: int = CROWDED) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (arrays of start and end, in bytes).

    Every byte inside a string of `length` bytes that also starts anywhere else, in this text or another, is removed;
    strings are judged on the input. A null text is empty; texts shorter than `length` lose nothing; equal texts that are
    long enough lose all. Ids may be null or repeated; other columns are ignored; an empty table gives no rows. A shard
    larger than memory is sorted in files of the task's scratch folder, made anew if the task runs again elsewhere; budget
    bounds the bytes of its queues that stay in memory, and crowded the units of one window that meet in a task.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} at least")
    spark = docs.sparkSession
    scratch = Scratch(spark)
    own = docs.select(F.col(id).cast("long").alias("x_id"), F.col(text).alias("x_text"))
    rows = scratch.save(own.mapInArrow(_scan(length), _SCAN))
    # Anchors that occur twice. The few that are frequent, HEAVY longs at most as their shares add up, need no join.
    anchors = scratch.save(rows.select(F.explode("x_f").alias("x_f")).groupBy("x_f").agg(F.count("*").alias("x_c")).filter("x_c > 1"))
    total = rows.agg(F.sum(F.size("x_f").cast("long")).alias("n")).first()["n"] or 0
    heavy = [r[0] for r in anchors.filter(F.col("x_c") * HEAVY >= max(total, HEAVY)).select("x_f").collect()]
    found = rows.select("x_key", F.explode(F.arrays_zip("x_f", "x_start", "x_count", "x_anchor")).alias("x_piece")).select("x_key", "x_piece.*")
    often = F.col("x_f").isin(heavy)
    hits = found.filter(often).unionByName(found.filter(~often).join(anchors.filter(~often).select("x_f"), "x_f", "left_semi"))
    hits = hits.groupBy("x_key").agg(F.collect_set(F.struct("x_f", "x_start", "x_count", "x_anchor")).alias("x_hits"))
    bodies = own.select("x_text").mapInArrow(_bodies, "x_key binary, x_body binary").groupBy("x_key").agg(F.first("x_body").alias("x_body"))
    held = scratch.save(bodies.join(hits, "x_key").select("x_key", "x_body", "x_hits"))
    unit = ["x_lo", "x_hi", "x_anchor", "x_near", "x_far", "x_single", "x_window"]
    texts = held.select("x_key", "x_body")

    def with_text(units: DataFrame) -> DataFrame:
        return texts.join(units.groupBy("x_key").agg(F.collect_list(F.struct(*unit)).alias("x_units")), "x_key").select("x_key", "x_body", "x_units")

    pieces = scratch.save(held.mapInArrow(_pieces(length), _PIECES))
    scratch.drop(anchors)
    row = F.min(F.struct("x_key", "x_lo", "x_hi", "x_anchor", "x_window0", "x_window1"))
    same = scratch.save(pieces.groupBy("x_same").agg(row.alias("x_row"), F.count("*").alias("x_c")))
    # Pieces that occur again. Again the few frequent ones need no shuffle.
    again, all_ = same.filter("x_c > 1"), max(pieces.count(), HEAVY)
    hot = F.col("x_c") * HEAVY >= all_
    rest = pieces.join(F.broadcast(again.filter(hot).select("x_same")), "x_same", "left_anti").join(again.filter(~hot).select("x_same"), "x_same")
    runs = [d.select("x_key", "x_lo", "x_hi") for d in (pieces.join(F.broadcast(again.filter(hot).select("x_same")), "x_same"), rest)]
    span, middle, at = length - GRAM + 1, (length - GRAM + 1) // 2, F.col("x_row.x_anchor")
    sides = [
        F.struct(F.greatest("x_row.x_lo", at - (far - 1)).alias("x_lo"), F.least("x_row.x_hi", at - near).alias("x_hi"), F.lit(near).alias("x_near"), F.lit(far).alias("x_far"), F.col(f"x_row.x_window{k}").alias("x_window"))
        for k, (near, far) in enumerate([(0, middle), (middle, span)])
    ]
    units = same.select(F.col("x_row.x_key").alias("x_key"), at.alias("x_anchor"), (F.col("x_c") == 1).alias("x_single"), F.explode(F.array(*sides)).alias("x_side"))
    units = units.select("x_key", "x_anchor", "x_single", "x_side.*").filter("x_window is not null")
    shards, used = [], [pieces, same]
    while True:
        shared = scratch.save(units.groupBy("x_window").agg(F.count("*").alias("x_c")).filter("x_c > 1"))
        used.append(shared)
        alike = units.join(shared, "x_window")
        shards.append(alike.filter((F.col("x_c") <= crowded) & (F.col("x_far") - F.col("x_near") > 1)).select("x_key", *unit))
        runs.append(alike.filter("x_far - x_near = 1 and x_single").select("x_key", "x_lo", "x_hi"))  # a window of all its bytes
        crowd = alike.filter((F.col("x_c") > crowded) & (F.col("x_far") - F.col("x_near") > 1))
        if shared.filter(F.col("x_c") > crowded).isEmpty():
            break
        units = scratch.save(with_text(crowd).mapInArrow(_smaller(length), _UNITS))
        used.append(units)
        if units.isEmpty():
            break
    alike = scratch.save(reduce(DataFrame.unionByName, shards))
    used.append(alike)
    size = alike.agg(F.sum(F.col("x_hi") - F.col("x_lo") + length + 1).alias("n")).first()["n"] or 0
    number = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // SHARD)
    found = with_text(alike).mapInArrow(_strings(length), _STRINGS).repartition(number, "x_window")
    found = found.mapInArrow(_sorted_shard(length, budget), _RUNS)
    known = reduce(DataFrame.unionByName, runs).select("x_key", F.col("x_lo").alias("x_a"), (F.col("x_hi") + length).alias("x_b"))
    runs = found.unionByName(known).groupBy("x_key").agg(F.collect_list(F.struct("x_a", "x_b")).alias("x_runs"))
    done = held.select("x_key", "x_body").join(runs, "x_key").mapInArrow(_removed, "x_key binary, x_removed long, x_spans array<array<long>>, x_kept string")
    copies = rows.groupBy("x_key").agg(F.count("*").alias("x_copies"))
    per = scratch.save(copies.join(done, "x_key", "left").filter("x_copies > 1 or x_kept is not null"))
    scratch.drop(held, *used)
    every = (F.col("x_copies") > 1) & (F.col("x_n") >= length)
    removed = F.when(every, F.col("x_n")).otherwise(F.coalesce("x_removed", F.lit(0).cast("long")))
    whole = F.array(F.array(F.lit(0).cast("long"), F.col("x_n")))
    spans = F.when(every, whole).otherwise(F.coalesce("x_spans", F.array().cast("array<array<long>>")))
    out = rows.select("x_id", "x_key", "x_n", "x_sha").join(per, "x_key", "left")
    return out.select(
        F.col("x_id").alias("doc_id"), F.col("x_n").alias("n_bytes"), removed.alias("n_removed"), F.size(spans).cast("long").alias("n_spans"),
        F.when(every, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("x_kept", "x_sha")).alias("kept_sha256"), spans.alias("spans"),
    )
