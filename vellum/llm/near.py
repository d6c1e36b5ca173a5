"""MinHash near-dedup with an LSH forest.

Every distinct shingle set gets MINIMA minima. An order of the forest sorts all sets by a label of some of these minima;
neighbours in an order share the longest prefixes, so they are the first candidates. Verified neighbours join into
components. A region (one order, one prefix) that still holds several components is compared across them, so that a
single link in a crowd isn't lost; a region gives one link for each two components that it joins, not every pair.

The depth adapts to each region. The first orders need LEAST common minima. A region is crowded where the sets outside its
largest component, times all its sets, are more than CROWD * SIDE * SIDE pairs. It isn't compared at that depth: its sets go on, alone,
to deeper orders, which cut it into smaller regions. Agreeing at a depth d has odds of similarity ** d, so the deeper orders
are as many more as keep the odds of meeting at the threshold; their labels are drawn from the same minima, without new
hashing. Regions are compared in salted blocks of SIDE by SIDE, and those still crowded at the last depth too, an exact way
of any size. Links are confirmed on full shingle sets.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, WORD_RE, Scratch, blocks, free_name
from .graph import components

MINIMA, TREES, LEAST = 168, 28, 5
#: Depths that a region may take, and minima of a label beyond them, for the order inside a region.
DEPTHS, MORE = (LEAST, 8, 12), 1
#: Orders whose neighbours are verified first, the side of a block of a region, in sets, and the blocks that make a crowd.
FIRST, SIDE, CROWD = 10, 512, 16
#: Standard deviations that a sketch's estimate may fall short of the threshold; 4 loses 3 of 100,000 links on the line.
SLACK = 4.0
_FOLD = str.maketrans(UPPER, LOWER)
_RNG = np.random.default_rng(2718281828)
_XOR = _RNG.integers(0, 2**32, MINIMA, np.uint32)
_MUL = _RNG.integers(0, 2**31, MINIMA, np.uint32) * np.uint32(2) + np.uint32(1)


def orders(depth: int, share: int) -> np.ndarray:
    """The minima of each order's labels: as many orders as give a pair at the threshold the odds that TREES give it at LEAST."""
    if depth == LEAST:
        return np.arange(MINIMA).reshape(TREES, -1)
    rng = np.random.default_rng(depth)
    n = int(np.ceil(TREES * (share / 100) ** (LEAST - depth)))
    return np.stack([rng.permutation(MINIMA)[: depth + MORE] for _ in range(n)])


def words_of(text: str | None) -> list[str]:
    return WORD_RE.findall((text or "").translate(_FOLD))


def shingle_set(text: str | None) -> set[tuple[str, ...]]:
    """Distinct 2-word shingles; one word is a shingle by itself."""
    words = words_of(text)
    return {tuple(words)} if len(words) == 1 else set(zip(words, words[1:], strict=False))


def _hashed(texts: list) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes."""
    place: dict[str, int] = {}
    codes = [np.fromiter((place.setdefault(w, len(place)) for w in words_of(t)), np.int64) for t in texts]
    h = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in place), np.uint64, len(place))
    out = []
    for own in codes:
        x = h[own]
        x = x[:-1] * np.uint64(0x9E3779B97F4A7C15) + (x[1:] ^ (x[1:] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) if len(x) > 1 else x
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x94D049BB133111EB)
        out.append(np.unique(x ^ (x >> np.uint64(31))))
    return out


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MINIMA minima of each set; the sets aren't empty."""
    x = np.concatenate(sets)
    x = (x >> np.uint64(32)).astype(np.uint32)
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), MINIMA), np.uint32)
    scratch = np.empty_like(x)
    for i in range(MINIMA):
        np.bitwise_xor(x, _XOR[i], out=scratch)
        np.multiply(scratch, _MUL[i], out=scratch)
        out[:, i] = np.minimum.reduceat(scratch, first)
    return out


_SKETCH = "x_id long, x_n long, x_key binary, x_node binary, x_sig binary"


def _key(text: str | None) -> bytes:
    return xxhash.xxh3_128_digest((text or "").encode("utf-8", "surrogatepass"))


def _sketch(batches):
    """A row for each document; the signature only where a task first sees a set."""
    seen: set[bytes] = set()
    for batch in blocks(batches, "x_text", 1 << 20):
        texts = batch.column(1).to_pylist()
        sets = _hashed(texts)
        nodes = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        sigs: list[bytes | None] = [None] * len(sets)
        if len(seen) > 1_000_000:
            seen.clear()
        fresh = []
        for i, node in enumerate(nodes):
            if node is not None and node not in seen:
                seen.add(node)
                fresh.append(i)
        if fresh:
            for i, sig in zip(fresh, _signatures([sets[i] for i in fresh]), strict=True):
                sigs[i] = sig.astype(">u4").tobytes()
        columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), *[pa.array(c, pa.binary()) for c in (map(_key, texts), nodes, sigs)]]
        yield pa.RecordBatch.from_arrays(columns, ["x_id", "x_n", "x_key", "x_node", "x_sig"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u4").reshape(-1, MINIMA)


def _labels(places: np.ndarray):
    """A row for each order of each signature."""
    wide = 4 * places.shape[1]

    def run(batches):
        for batch in batches:
            step = max(1, (8 << 20) // (wide * len(places)))
            for some in (batch.slice(a, step) for a in range(0, batch.num_rows, step)):
                n = some.num_rows
                raw = np.ascontiguousarray(_matrix(some.column(1))[:, places.reshape(-1)])
                labels = pa.Array.from_buffers(pa.binary(wide), n * len(places), [None, pa.py_buffer(raw.tobytes())]).cast(pa.binary())
                nodes = some.column(0).take(pa.array(np.repeat(np.arange(n), len(places))))
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(len(places), dtype=np.int32), n)), labels, nodes], ["x_tree", "x_label", "x_node"])

    return run


def _neighbours(depth: int):
    """From a sorted run: rows that share `depth` minima with a neighbour, and that neighbour before them.

    The first and last rows of a run are kept too: their neighbour may be in the next run.
    """
    wide = 4 * depth

    def run(batches):
        held: tuple | None = None  # the row before, which isn't written yet
        for batch in batches:
            out = []
            for tree, label, node in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                prefix = label[:wide]
                if held is None:
                    held = (tree, prefix, node, None, True)
                    continue
                if held[0] == tree and held[1] == prefix:
                    if held[2] == node:
                        continue
                    out.append((*held[:4],))
                    held = (tree, prefix, node, held[2], True)
                else:
                    if held[4]:
                        out.append((*held[:4],))
                    held = (tree, prefix, node, None, False)
            if out:
                yield _rows(out)
        if held:
            yield _rows([held[:4]])

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["x_tree", "x_prefix", "x_node", "x_near"])


def _candidates(bound: int, places: np.ndarray, depth: int):
    """One region, or salted block of one: the queries and rows that have a pair across components whose sketches agree enough."""

    def run(table: pa.Table) -> pa.Table:
        tree = table.column("x_tree")[0].as_py()
        node, root = np.array(table.column("x_node").to_pylist(), object), np.array(table.column("x_root").to_pylist(), object)
        asks = table.column("x_asks").to_numpy(zero_copy_only=False).astype(bool)
        minor = table.column("x_minor").to_numpy(zero_copy_only=False).astype(bool)
        sig = _matrix(table.column("x_sig")).astype(np.uint32)
        data = np.flatnonzero(~asks)
        earlier = places[:tree, :depth]
        hit = np.zeros(len(asks), bool)
        for q in np.flatnonzero(asks):
            near = data[root[data] != root[q]]
            near = near[~minor[near] | (node[near] > node[q])]  # of two queries the smaller asks
            near = near[(sig[near] == sig[q]).sum(1) >= bound]
            if tree and len(near):  # the first order with a common prefix has the pair
                near = near[~(sig[near][:, earlier] == sig[q][earlier]).all(2).any(1)]
            hit[near] = True
            hit[q] = len(near) > 0
        return table.select(["x_tree", "x_prefix", "x_q", "x_d", "x_asks", "x_node", "x_root"]).filter(pa.array(hit))

    return run


def _links(share: int):
    """One salted block with full texts: links across components, at most one for each two that it joins."""

    def run(table: pa.Table) -> pa.Table:
        node, root = table.column("x_node").to_pylist(), table.column("x_root").to_pylist()
        asks = table.column("x_asks").to_numpy(zero_copy_only=False).astype(bool)
        unpack, place, parent = zstandard.ZstdDecompressor(), {}, {r: r for r in root}

        def find(x: bytes) -> bytes:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        texts = [unpack.decompress(b).decode("utf-8", "surrogatepass") for b in table.column("x_body").to_pylist()]
        sets = [np.fromiter((place.setdefault(x, len(place)) for x in shingle_set(t)), np.int64) for t in texts]
        size, data = np.array([len(s) for s in sets]), np.flatnonzero(~asks)
        mark = np.zeros(len(place), bool)
        whole = np.concatenate([sets[i] for i in data]) if len(data) else np.zeros(0, np.int64)
        first = np.concatenate([[0], np.cumsum(size[data])[:-1]]).astype(np.int64) if len(data) else data
        u, v = [], []
        for q in np.flatnonzero(asks) if len(data) else ():
            mark[sets[q]] = True
            both = np.add.reduceat(mark[whole].astype(np.int32), first)
            mark[sets[q]] = False
            for i in data[100 * both >= share * (size[data] + size[q] - both)]:
                a, b = find(root[q]), find(root[i])
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    u.append(node[q])
                    v.append(node[i])
        return pa.table([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])

    return run


def _squeezed(batches):
    """(key, packed text), once for each text that a task sees."""
    pack, seen = zstandard.ZstdCompressor(level=3), set()
    for batch in blocks(batches, "x_text", 4 << 20):
        keys, packed = [], []
        if len(seen) > 1_000_000:
            seen.clear()
        for t in batch.column(0).to_pylist():
            key = _key(t)
            if key not in seen:
                seen.add(key)
                keys.append(key)
                packed.append(pack.compress((t or "").encode("utf-8", "surrogatepass")))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(packed, pa.binary())], ["x_of", "x_body"])


def _confirm(share: int):
    """Pairs whose full shingle sets have 100 * intersection >= share * union. Sets of the last texts are kept."""

    def run(batches):
        unpack, held = zstandard.ZstdDecompressor(), OrderedDict()

        def full(node: bytes, body: bytes) -> set:
            if node not in held:
                held[node] = shingle_set(unpack.decompress(body).decode("utf-8", "surrogatepass"))
                if len(held) > 64:
                    held.popitem(last=False)
            return held[node]

        for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            ok = []
            for u, v, x, y in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                s, t = full(u, x), full(v, y)
                both = len(s & t)
                ok.append(100 * both >= share * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return run


def _verified(pairs: DataFrame, bodies: DataFrame, share: int) -> DataFrame:
    left, right = bodies.toDF("u", "x_left"), bodies.toDF("v", "x_right")
    joined = pairs.join(left, "u").join(right, "v").select("u", "v", "x_left", "x_right")
    return joined.mapInArrow(_confirm(share), "u binary, v binary")


def _merged(roots: DataFrame | None, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Components (node, root) of the links so far and further ones."""
    known = links if roots is None else links.unionByName(roots.filter("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    out = scratch.save(components(known, scratch))
    if roots is not None:
        scratch.drop(roots)
    return out


def near_dedup(docs: DataFrame, share: int = 80, text: str = "text", id: str = "doc_id", side: int = SIDE) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Sets are of 2-word shingles after lower-casing A-Z, linked at 100 * intersection >= share * union; a component's id is
    its smallest doc_id. Texts without words (null ones too) have 0 shingles and are components by themselves. Equal sets
    are one node however many rows have them. Rows with one id count each with its own text; a null id is never the
    smallest while its component has another. Other columns are ignored; an empty table gives no rows. One text is held by
    a task at a time with its shingles, however long. `side` bounds the sets that a task compares with as many.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    own = docs.select(F.col(id).cast("long").alias("x_id"), F.col(text).alias("x_text"))
    rows = scratch.save(own.mapInArrow(_sketch, _SKETCH))
    sketches = rows.filter("x_sig is not null").select("x_node", "x_sig")
    m, t = MINIMA, share / 100
    bound = int(np.floor(m * t - SLACK * np.sqrt(m * t * (1 - t))))
    region, cell = ["x_tree", "x_prefix"], ["x_tree", "x_prefix", "x_q", "x_d"]
    roots = bodies = None
    for depth in DEPTHS:
        places = orders(depth, share)
        labels = sketches.mapInArrow(_labels(places), "x_tree int, x_label binary, x_node binary")
        order = ["x_tree", "x_label", "x_node"]
        forest = labels.repartitionByRange(*order).sortWithinPartitions(*order)
        members = scratch.save(forest.mapInArrow(_neighbours(depth), "x_tree int, x_prefix binary, x_node binary, x_near binary"))
        if bodies is None:
            # The texts of the sets that have a neighbour, one text a set. Deeper orders hold none but these.
            involved = members.select("x_node").distinct()
            held = rows.filter("x_node is not null").groupBy("x_node").agg(F.min("x_key").alias("x_of")).join(involved, "x_node", "left_semi")
            packed = own.select("x_text").mapInArrow(_squeezed, "x_of binary, x_body binary")
            bodies = scratch.save(packed.join(held, "x_of").select("x_node", "x_body").dropDuplicates(["x_node"]))
        first = members.filter((F.col("x_tree") < FIRST) & F.col("x_near").isNotNull()).select(F.col("x_node").alias("u"), F.col("x_near").alias("v")).distinct()
        links = scratch.save(_verified(first, bodies, share))
        roots = _merged(roots, links, scratch)

        # Regions that still hold several components.
        placed = members.select("x_tree", "x_prefix", "x_node").distinct().join(roots.toDF("x_node", "x_root"), "x_node", "left")
        placed = placed.withColumn("x_root", F.coalesce("x_root", "x_node"))
        parts = placed.groupBy(*region, "x_root").agg(F.count("*").alias("x_c"))
        open_ = parts.groupBy(*region).agg(F.count("*").alias("x_parts"), F.sum("x_c").alias("x_size"), F.max("x_c").alias("x_most"), F.max_by("x_root", "x_c").alias("x_major")).filter("x_parts > 1")
        placed = scratch.save(placed.join(open_, region).withColumn("x_minor", F.col("x_root") != F.col("x_major")).drop("x_parts", "x_major"))
        crowded = (F.col("x_size") - F.col("x_most")) * F.col("x_size") > CROWD * side * side
        scratch.drop(members, links)
        last = depth == DEPTHS[-1]
        small = placed if last else placed.filter(~crowded)
        # A region is cut into blocks of sets that ask (those outside its largest component) and sets that are asked (all).
        asking, asked = (F.ceil(c / side).cast("int") for c in (F.col("x_size") - F.col("x_most"), F.col("x_size")))

        def salt(cells: Column) -> Column:
            return F.pmod(F.xxhash64("x_node"), cells).cast("int")

        def each(cells: Column) -> Column:
            return F.explode(F.sequence(F.lit(0), cells - 1))

        one = sketches.groupBy("x_node").agg(F.first("x_sig").alias("x_sig"))
        small = small.join(one.join(small.select("x_node").distinct(), "x_node", "left_semi"), "x_node")
        names = [*region, "x_node", "x_root", "x_minor", "x_sig"]
        asks = small.filter("x_minor").select(*names, F.lit(True).alias("x_asks"), salt(asking).alias("x_q"), each(asked).alias("x_d"))
        data = small.select(*names, F.lit(False).alias("x_asks"), salt(asked).alias("x_d"), each(asking).alias("x_q"))
        near = asks.unionByName(data).groupBy(*cell).applyInArrow(_candidates(bound, places, depth), "x_tree int, x_prefix binary, x_q int, x_d int, x_asks boolean, x_node binary, x_root binary")
        more = scratch.save(near.join(bodies, "x_node").groupBy(*cell).applyInArrow(_links(share), "u binary, v binary"))
        roots = _merged(roots, more, scratch)
        crowd = None if last else scratch.save(placed.filter(crowded).select("x_node").distinct())
        scratch.drop(placed, more)
        if last or crowd.isEmpty():
            break
        sketches = scratch.save(sketches.groupBy("x_node").agg(F.first("x_sig").alias("x_sig")).join(crowd, "x_node", "left_semi"))
    scratch.drop(bodies)

    nodes = rows.filter("x_node is not null").groupBy("x_node").agg(F.min("x_id").alias("x_low")).join(roots.toDF("x_node", "x_root"), "x_node", "left")
    nodes = scratch.save(nodes.withColumn("x_root", F.coalesce("x_root", "x_node")))
    least = nodes.groupBy("x_root").agg(F.min("x_low").alias("x_component"))
    named = nodes.join(least, "x_root").select("x_node", "x_component")
    linked = rows.filter("x_node is not null").select("x_id", "x_n", "x_node").join(named, "x_node").select("x_id", "x_n", "x_component")
    alone = rows.filter("x_node is null").select("x_id", "x_n", F.col("x_id").alias("x_component"))
    return linked.unionByName(alone).select(
        F.col("x_id").alias("doc_id"), F.col("x_n").alias("n_shingles"), F.col("x_component").alias("component_id"), F.col("x_id").eqNullSafe(F.col("x_component")).alias("kept"),
    )


def keep_one(docs: DataFrame, decided: DataFrame, id: str = "doc_id") -> DataFrame:
    """The rows of docs whose id stays in its component, with all columns of docs, whatever their names.

    Repeated ids share their fate: all rows of an id stay if any of them is to stay.
    """
    kept = free_name(docs, "x_kept")
    stay = decided.filter("kept").select(F.col("doc_id").alias(kept)).distinct()
    return docs.join(stay, docs[id].eqNullSafe(stay[kept]), "left_semi")
