"""Byte-level BPE: a global shuffle of distinct words, ids joined back, documents reassembled by position.

Documents are read once, in blocks of about BLOCK bytes. A block's pre-tokens with their positions become a sequence of
numbers of its distinct words, packed in one row instead of a row for each occurrence. The distinct words go, packed by
hash bucket, to the bucket's task, which encodes each distinct word of the corpus once and sends the ids to the blocks that
asked. There the numbers, in the order of their positions, take their ids, and the ids are decoded by joining the table of
token bytes on them. A word in a million places of a block crosses the network once; texts never do.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, utf8

BLOCK = 24 << 20
#: Hash buckets of words, at most.
BUCKETS = 4096
#: Words of a block whose ids are joined back and decoded at once.
STEP = 1 << 16
#: White space, and the letters and numbers below U+02C2 (fixed values of Unicode).
SPACE = "\t-\r \x85\xa0"
SPACE_ALL = SPACE + "  -     　"
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ˁ"
NUMBERS = "0-9²³¹¼-¾"
_BEYOND = re.compile("[^\x00-ˁ]")
_READY: dict = {}


def splitter(pattern: str):
    """A function from text to its pre-tokens. Texts below U+02C2 take the same pattern with its classes spelled out."""
    spelled = {r"[^\s\p{L}\p{N}]": f"[^{SPACE}{LETTERS}{NUMBERS}]", r"\p{L}": f"[{LETTERS}]", r"\p{N}": f"[{NUMBERS}]", r"\s": f"[{SPACE}]", r"\S": f"[^{SPACE}]"}
    whole = {r"[^\s\p{L}\p{N}]": rf"[^{SPACE_ALL}\p{{L}}\p{{N}}]", r"\s": f"[{SPACE_ALL}]", r"\S": f"[^{SPACE_ALL}]"}

    def put(names: dict) -> str:
        return re.sub("|".join(map(re.escape, names)), lambda m: names[m[0]], pattern)

    low, full = re.compile(put(spelled)).findall, regex.compile(put(whole)).findall
    return lambda text: full(text) if _BEYOND.search(text) else low(text)


def vocabulary(path: str):
    """(encode a word's bytes, the token-byte table: the bytes of each token at its id), once in each worker."""
    if path not in _READY:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        # One pre-token at a time is encoded, so the pattern takes the whole of it.
        core = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        table: list = [None] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        _READY[path] = core.encode_single_piece, pa.array(table, pa.large_binary())
    return _READY[path]


def _pack(parts: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, parts), np.uint32, len(parts)).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(len(parts).to_bytes(4, "little") + sizes + b"".join(parts))


def _unpack(packed: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n = int.from_bytes(raw[:4], "little")
    ends = np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64) + 4 + 4 * n
    return [raw[a:b] for a, b in zip([4 + 4 * n, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers, bytes of one weight together, which packs better."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


#: Numbers below ONE take a byte, those below ONE + 256 * TWO two, all others five.
ONE, TWO = 224, 31


def _short(numbers: np.ndarray) -> list[bytes]:
    """Numbers most of which are small, as lead bytes, second bytes and the large ones."""
    one, two = numbers < ONE, (numbers >= ONE) & (numbers < ONE + 256 * TWO)
    more = numbers[two] - ONE
    lead = np.full(len(numbers), 255, np.uint8)
    lead[one], lead[two] = numbers[one], ONE + more // 256
    return [lead.tobytes(), (more % 256).astype(np.uint8).tobytes(), _planes(numbers[~one & ~two])]


def _from_short(lead: bytes, more: bytes, large: bytes) -> np.ndarray:
    out = np.frombuffer(lead, np.uint8).astype(np.uint32)
    two, rest = (out >= ONE) & (out < 255), out == 255
    out[two] = ONE + (out[two] - ONE) * 256 + np.frombuffer(more, np.uint8)
    out[rest] = _from_planes(large)
    return out


class _Places(dict):
    """Numbers of words, in the order of their first appearance."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


_ROWS = "x_block long, x_to int, x_bucket int, x_data binary"


def _read(pattern: str, buckets: int, size: int):
    """For each block a row for each bucket, its distinct words, and one without a bucket: the documents as word numbers."""

    def run(batches):
        split = splitter(pattern)
        base, block = TaskContext.get().partitionId() << 32, 0
        place, found, ids, held = _Places(), [], [], 0

        def packed() -> pa.RecordBatch:
            counts = _planes(np.array([len(f) for f in found]))
            codes = np.concatenate(found)
            found.clear()
            # Numbers by frequency pack best. A bucket holds its words in this order, so their buckets tell where the ids go.
            times = np.zeros(len(place), np.int64)
            step = max(STEP, len(place))
            for first in range(0, len(codes), step):  # counting copies what it counts as wider numbers
                times += np.bincount(codes[first : first + step], minlength=len(place))
            often = np.argsort(-times, kind="stable")
            number = np.empty(len(place), np.uint32)
            number[often] = np.arange(len(place))
            words = list(map(_raw, place))
            place.clear()
            words = [words[i] for i in often.tolist()]
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.uint32, len(words))
            order = np.argsort(bucket, kind="stable")
            own = pa.concat_arrays(ids)
            codes = number[codes]
            body = [own.fill_null(0).to_numpy().tobytes(), np.asarray(own.is_null()).astype(np.uint8).tobytes(), counts, _planes(bucket), *_short(codes)]
            out = [(base + block, zlib.crc32((base + block).to_bytes(8, "little")) & 0x7FFFFFFF, None, _pack(body))]
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            for mine in np.split(order, cuts) if len(order) else ():
                b = int(bucket[mine[0]])
                out.append((base + block, b, b, _pack([words[i] for i in mine.tolist()])))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["x_block", "x_to", "x_bucket", "x_data"])

        for batch in blocks(batches, "x_text", max(1, size // 8)):
            ids.append(batch.column(0))
            for text in batch.column(1).to_pylist():
                words = split(text or "")
                found.append(np.fromiter(map(place.__getitem__, words), np.uint32, len(words)))
            held += int(utf8(batch.column(1))[1][-1])
            if held >= size:
                yield packed()
                place, found, ids, held, block = _Places(), [], [], 0, block + 1
        if ids:
            yield packed()

    return run


def _answers(path: str):
    """Each bucket's rows together: the ids of its words in their order, each word encoded once. Documents pass through."""

    def run(batches):
        encode, _ = vocabulary(path)
        known: dict[bytes, bytes] = {}
        last = None
        for batch in batches:
            out = []
            for bucket, data in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if bucket is None:
                    out.append(data)
                    continue
                if bucket != last:
                    known, last = {}, bucket
                ids = []
                for word in _unpack(data):
                    if word not in known:
                        known[word] = np.asarray(encode(word), np.uint32).tobytes()
                    ids.append(known[word])
                sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                out.append(_pack([_planes(sizes), _planes(np.frombuffer(b"".join(ids), np.uint32))]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], ["x_block", "x_bucket", "x_data"])

    return run


def _reassemble(path: str):
    """One block: its documents' ids in order of position, digests, and the bytes decoded from the ids."""

    def run(block: pa.Table) -> pa.Table:
        _, table = vocabulary(path)
        rows = sorted(zip([-1 if b is None else b for b in block.column("x_bucket").to_pylist()], block.column("x_data").to_pylist(), strict=True), key=lambda r: r[0])
        answers = [_unpack(data) for _, data in rows[1:]]
        size = np.concatenate([np.zeros(0, np.int64), *[_from_planes(sizes) for sizes, _ in answers]]).astype(np.int64)
        flat = np.concatenate([np.zeros(0, np.uint32), *[_from_planes(ids) for _, ids in answers]]).astype(np.uint32)
        start = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        raw_ids, nulls, counts, buckets, *short = _unpack(rows[0][1])
        place = np.empty(len(size), np.int64)
        place[np.argsort(_from_planes(buckets), kind="stable")] = np.arange(len(size))
        words = _from_short(*short)
        del rows, answers, buckets, short
        doc_ids = [None if null else i for i, null in zip(np.frombuffer(raw_ids, np.int64).tolist(), nulls, strict=True)]
        stops = [0, *np.cumsum(_from_planes(counts), dtype=np.int64).tolist()]
        out, n, of_ids, of_bytes = [], 0, hashlib.sha256(), hashlib.sha256()
        for first in range(0, max(1, len(words)), STEP):
            some = place[words[first : first + STEP]]
            own = size[some]
            marks = np.concatenate([[0], np.cumsum(own)]).astype(np.int64)
            ids = flat[np.repeat(start[some] - marks[:-1], own) + np.arange(marks[-1])]
            decoded = table.take(pa.array(ids))
            # A take of these ids is one array, as offsets are 64 bits wide.
            off = np.frombuffer(decoded.buffers()[1], np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
            data = memoryview(decoded.buffers()[2]) if len(ids) else memoryview(b"")
            raw = memoryview(ids.astype("<u4").tobytes())
            last = first + len(some)
            while len(out) < len(doc_ids):  # a document may begin in one step and end in another
                begin, end = stops[len(out)], stops[len(out) + 1]
                a, b = int(marks[max(begin, first) - first]), int(marks[min(end, last) - first])
                n += b - a
                of_ids.update(raw[4 * a : 4 * b])
                of_bytes.update(data[off[a] : off[b]])
                if end > last:
                    break
                out.append((doc_ids[len(out)], n, of_ids.hexdigest(), of_bytes.hexdigest()))
                n, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
        return pa.table(
            [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return run


def encode_decode(docs: DataFrame, path: str, pattern: str, text: str = "text", id: str = "doc_id", block_bytes: int = BLOCK, buckets: int | None = None) -> DataFrame:
    """Per input row: doc_id, n_tokens, ids_sha256, decoded_sha256, as the tiktoken library's encode_ordinary has the ids.

    A null text is empty: no tokens, digests of nothing. Rows are independent, so ids may be null or repeated; other columns
    are ignored; an empty table gives no rows. Memory: a block (or the longest text), its distinct words and word numbers in
    the tasks that read and reassemble, a bucket's distinct words in those that encode.
    """
    spark = docs.sparkSession
    partitions = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = buckets or min(BUCKETS, partitions)
    own = docs.select(F.col(id).cast("long").alias("x_id"), F.col(text).alias("x_text"))
    rows = own.mapInArrow(_read(pattern, buckets, block_bytes), _ROWS)
    rows = rows.repartition(max(buckets, partitions), "x_to").sortWithinPartitions("x_bucket")
    answers = rows.mapInArrow(_answers(path), "x_block long, x_bucket int, x_data binary")
    return answers.groupBy("x_block").applyInArrow(_reassemble(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
