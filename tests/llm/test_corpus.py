"""Operators over a whole corpus against brute force: repeats, near copies, mixture, shards, tokens, language, pipeline."""

import base64
import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken

from vellum.llm.bpe import encode_decode, splitter
from vellum.llm.exact import exact_dedup, keep_first
from vellum.llm.language import held_out, predict_language
from vellum.llm.mixing import apply_mix, interleave, mix
from vellum.llm.near import keep_one, near_dedup, shingle_set
from vellum.llm.repeats import remove_repeats
from vellum.llm.suffixes import suffixes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, x_key string, text_sha256 string"
RNG = random.Random(11)


def prose(n, words=400):
    return " ".join(RNG.choice(WORDS[:words]) for _ in range(n))


WORDS = ["".join(RNG.choice("abcdefghijé") for _ in range(RNG.randint(2, 9))) for _ in range(3000)]


def corpus():
    base = [prose(RNG.randint(20, 150), 3000) for _ in range(60)]
    texts = list(base)
    for t in base[:20]:  # near copies, some below the threshold
        for k in (1, 2, 5, 12):
            words = t.split(" ")
            for _ in range(k):
                words[RNG.randrange(len(words))] = RNG.choice(WORDS)
            texts.append(" ".join(words))
    texts += [base[0]] * 15 + [base[1].upper(), base[1].title(), base[2] + " " + base[3], None, None, "", "   ", "x", "x", "X", "one two", "12 34 !!", "Ü" * 700, "zz " * 500]
    rows = [(i, t, RNG.choice(["en", "fr", None]), RNG.choice(["a", "a", "a", "b", None, "é"]), 1, "c", "c") for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[70], (None, base[5], "en", "z", 1, "c", "c"), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def repr_sorted(rows):
    return sorted(map(tuple, rows), key=repr)


def test_exact(docs, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[fold(r[1])].append(r[0])
    top = {t: max((i for i in g if i is not None), default=None) for t, g in groups.items()}
    want = [(r[0], top[fold(r[1])], len(groups[fold(r[1])]), hashlib.sha256(fold(r[1]).encode()).hexdigest()) for r in rows]
    for heavy in (2, 1024):  # a small bound sends groups both ways
        got = exact_dedup(docs, heavy=heavy)
        assert repr_sorted(want) == repr_sorted(got.select("doc_id", "keep_id", "group_size", "text_sha256").collect())
        kept = got.filter("kept").collect()
        assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)
    stay = keep_first(docs, exact_dedup(docs))
    assert stay.columns == docs.columns
    assert sorted(fold(r.text) for r in stay.collect()) == sorted(groups)
    assert exact_dedup(docs.limit(0)).collect() == []


def components(rows):
    sets = [shingle_set(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    members = defaultdict(list)
    for i, r in enumerate(rows):
        members[find(i)].append(r[0])
    out = []
    for i, r in enumerate(rows):
        ids = [x for x in members[find(i)] if x is not None]
        least = r[0] if not sets[i] else min(ids, default=None)
        out.append((r[0], len(sets[i]), least, r[0] == least))
    return out


def test_near(docs, rows):
    got = near_dedup(docs)
    assert repr_sorted(components(rows)) == repr_sorted(got.collect())
    stay = keep_one(docs, got)
    assert stay.columns == docs.columns and stay.count() < docs.count()
    assert near_dedup(docs.limit(0)).collect() == []


def test_near_crowded(spark):
    """One dense group of distinct near copies around a text, with outliers that hang on by few links."""
    rng = random.Random(4)
    base = [rng.choice(WORDS) for _ in range(60)]
    rows = []
    for i in range(300):
        words = list(base)
        for _ in range(rng.randint(0, 7)):
            words[rng.randrange(60)] = rng.choice(WORDS)
        rows.append((i, " ".join(words), None, None, 1, "", ""))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for side in (512, 6):  # a small side makes regions crowded, so they take deeper orders and then salted blocks
        assert repr_sorted(components(rows)) == repr_sorted(near_dedup(docs, side=side).collect())


def test_near_rows_of_one_id(spark):
    """Very many rows under one id, or none, with texts of their own: as many rows come out, each with its own set."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice(WORDS) for _ in range(12)) for _ in range(700)]
    rows = [(7 if i % 2 else None, texts[i % 700], None, None, 1, "", "") for i in range(2100)]
    got = near_dedup(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert len(got) == 2100 and sum(r.n_shingles for r in got) == sum(len(shingle_set(r[1])) for r in rows)
    assert {r.component_id for r in got} == {7, None}


def test_near_recall(spark):
    """Pairs on the line: similarity 0.8 and a little more, each pair apart from all others. Every link is found."""
    rng = random.Random(6)
    rows = []
    for i in range(600):
        words = [f"{i}w{k}" for k in range(91)]
        other = list(words)
        other[-1 - i % 10 :] = [f"{i}x{k}" for k in range(1 + i % 10)]  # 90 - r of 90 + r shingles in common
        rows += [(2 * i, " ".join(words), None, None, 1, "", ""), (2 * i + 1, " ".join(other), None, None, 1, "", "")]
    rng.shuffle(rows)
    got = near_dedup(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert all(r.component_id == r.doc_id - r.doc_id % 2 for r in got)


@pytest.mark.parametrize("budget", [0, 1 << 26])
def test_suffixes(budget):
    rng = random.Random(8)
    for _ in range(60):
        symbols = rng.choice([b"ab", b"abcdefgh", b"a"]) + b"\xff"
        text = bytes(rng.choice(symbols) for _ in range(rng.randint(1, 70))) * rng.randint(1, 3)
        depth = rng.choice([2, 5, 16, 64])
        got = list(suffixes(text, depth, budget))
        at = [p for p, _ in got][::-1]
        assert sorted(at) == list(range(len(text)))
        assert all(text[a : a + depth] <= text[b : b + depth] for a, b in zip(at, at[1:], strict=False))
        for (a, common), (b, _) in zip(got[1:], got, strict=False):
            k = 0
            while k < depth and max(a, b) + k < len(text) and text[a + k] == text[b + k]:
                k += 1
            assert common == k


def test_suffixes_larger_than_the_budget():
    """Names of a long text exceed the budget, so levels of names are induced as well, with queues in files."""
    rng = random.Random(9)
    passage = [bytes(rng.choice(b"abcd ") for _ in range(500)) for _ in range(8)]
    text = b"\xff".join(bytes(rng.choice(b"abcdefgh ") for _ in range(rng.randint(0, 900))) + rng.choice(passage) for _ in range(300))
    budget, depth = 1 << 12, 400
    assert len(text) > 50 * budget
    got = list(suffixes(text, depth, budget))
    at = [p for p, _ in got][::-1]
    want = sorted(range(len(text)), key=lambda p: text[p : p + depth])
    assert sorted(at) == sorted(want) and [text[p : p + depth] for p in at] == [text[p : p + depth] for p in want]
    for (a, common), (b, _) in zip(got[1::97], got[::97], strict=False):
        k = 0
        while k < depth and max(a, b) + k < len(text) and text[a + k] == text[b + k]:
            k += 1
        assert common == k


def test_sorter_memory(monkeypatch):
    """With small blocks and a small budget, what is held while a shard is sorted is a few bytes for each symbol of a block."""
    import tracemalloc

    from vellum.llm import suffixes
    from vellum.llm.suffixes import Shard

    monkeypatch.setattr(suffixes, "STEP", 1 << 12)
    monkeypatch.setattr(suffixes, "STAGE", 1 << 12)
    rng = random.Random(10)
    shard = Shard(1 << 18)
    while shard.size < 1 << 19:
        shard.add(bytes(rng.choices(b"abcdefgh ", k=4096)) if rng.random() < 0.9 else b"the same " * 100)
    tracemalloc.start()
    flags = shard.repeated(400)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert flags.any() and not flags.all() and peak < 6 << 20, peak
    shard.close()


def test_repeats_of_a_crowd(spark):
    """One passage in very many texts, in other places and cut otherwise; long texts of several parts."""
    rng = random.Random(12)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(260))
    noise = ["".join(rng.choice("klmnopqrst ") for _ in range(rng.randint(5, 90))) for _ in range(150)]
    texts = [a + passage[rng.choice([0, 0, 40]) :] + b for a, b in zip(noise, reversed(noise), strict=True)]
    texts += ["u" * 900, "v" * 300 + passage + "v" * 300]
    rows = [(i, t, None, None, 1, "", "") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for crowded in (2, 40, 2048):
        assert repr_sorted(repeats(rows, 200)) == repr_sorted(remove_repeats(docs, 200, crowded=crowded).drop("spans").collect())


def test_pieces_of_a_long_text(monkeypatch):
    """A text that is longer than a part gives the same pieces as in one part."""
    import numpy as np

    from vellum.llm import repeats

    rng = random.Random(13)
    raw = np.frombuffer(bytes(rng.choices(b"abcdef ", k=30_000)), np.uint8)
    off = np.array([0, 5, 20_000, 20_000, 30_000])

    def strings(found):
        return {(d, s + k, anchor) for _, d, s, n, anchor in zip(*[c.tolist() for c in found], strict=True) for k in range(n)}

    whole = strings(repeats.pieces(raw, off, 100))
    monkeypatch.setattr(repeats, "PART", 1000)
    assert strings(repeats.pieces(raw, off, 100)) == whole and len(whole) == 20_000 - 5 - 99 + 10_000 - 99


def repeats(rows, length):
    texts = [(r[1] or "").encode() for r in rows]
    starts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for r, t in zip(rows, texts, strict=True):
        flags = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if starts[t[i : i + length]] > 1:
                flags[i : i + length] = b"\1" * length
        kept = bytes(b for b, f in zip(t, flags, strict=True) if not f)
        out.append((r[0], len(t), sum(flags), sum(f and not (i and flags[i - 1]) for i, f in enumerate(flags)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "budget", "crowded"), [(64, 0, 1), (101, 1 << 26, 3), (400, 1 << 26, 2048)])
def test_repeats(docs, rows, length, budget, crowded):
    got = remove_repeats(docs, length, budget=budget, crowded=crowded)
    assert repr_sorted(repeats(rows, length)) == repr_sorted(got.drop("spans").collect())
    assert all(r.n_removed == sum(b - a for a, b in r.spans) for r in got.collect())
    assert remove_repeats(docs.limit(0), length).collect() == []


def test_mix(docs, rows):
    size = {i: len((r[1] or "").split()) for i, r in enumerate(rows)}
    per = Counter()
    for i, r in enumerate(rows):
        per[r[3]] += size[i]
    order = sorted(per, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(per.values())
    while open_:  # share by weight, reshare what is above the caps
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * per[s]}
        target |= {s: 2.0 * per[s] if s in full else level * weight[s] for s in open_}
        if not full:
            break
        left -= sum(2 * per[s] for s in full)
        open_ -= full
    mixed = mix(docs)
    got = mixed.collect()
    assert repr_sorted(got) == repr_sorted(mix(docs).collect())
    assert Counter(zip([r.doc_id for r in got], [r.size for r in got], strict=True)) == Counter((r[0], size[i]) for i, r in enumerate(rows))
    taken = Counter()
    for r in got:
        s = min((s for s in order if per[s] == r.source_size and abs(target[s] - r.target) < 1e-6), key=str)
        taken[s] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    out = apply_mix(docs, mixed)
    assert out.columns == docs.columns and set(out.groupBy("doc_id").count().toPandas()["count"]) <= {1, 2, 4}
    assert mix(docs.limit(0)).collect() == []


def test_shards(docs, rows):
    got = interleave(docs, 6).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert sorted(shards) == list(range(6)) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    source = {r[0]: r[3] for r in rows if r[0] is not None}
    mixture = Counter((r.shard, source.get(r.doc_id)) for r in got if r.doc_id is not None)
    for s in ("a", "b", "é"):
        each = [mixture[k, s] for k in range(6)]
        assert max(each) - min(each) <= 3
    assert repr_sorted(got) == repr_sorted(interleave(docs, 6).collect())
    assert interleave(docs.limit(0)).collect() == []


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_splitter(library):
    rng = random.Random(6)
    odd = "ab 'sé12²½ªˁ\t\n\x0b\x1c\x1d\x1f\x85\xa0.!_-" + "ˆ中ⅷ٣ 　᠎​́😀"
    split = splitter(public_tokenizers.PATTERN)
    for k in range(3000):
        text = "".join(rng.choice(odd[:-11] if k % 2 else odd) for _ in range(rng.randint(0, 12)))
        words = split(text)
        assert "".join(words) == text
        assert [i for w in words for i in library.encode_ordinary(w)] == library.encode_ordinary(text), repr(text)


def test_bpe(docs, rows, library):
    want = []
    for r in rows:
        ids = library.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    for block in (200, 1 << 24):
        assert repr_sorted(want) == repr_sorted(encode_decode(docs, path, public_tokenizers.PATTERN, block_bytes=block).collect())
    unstable = docs.repartition(3)  # the two readings may cut other blocks
    assert repr_sorted(want) == repr_sorted(encode_decode(unstable, path, public_tokenizers.PATTERN, block_bytes=300).collect())
    assert encode_decode(docs.limit(0), path, public_tokenizers.PATTERN).collect() == []


def test_bpe_memory(monkeypatch, library):
    """A block is put together again in steps: what that holds is a small multiple of its bytes, documents may span steps."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    from vellum.llm import bpe

    monkeypatch.setattr(bpe, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 1)))
    rng = random.Random(18)
    texts = ["", *[" ".join(rng.choices(WORDS, k=k)) for k in (1, 150_000, 5, 70_000, 0, 100_000)], None, ""]
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    batch = pa.RecordBatch.from_arrays([pa.array([*range(8), None]), pa.array(texts)], ["x_id", "x_text"])
    (rows,) = bpe._read(public_tokenizers.PATTERN, 4, 1 << 30)([batch])
    block = pa.Table.from_batches(bpe._answers(path)([rows.sort_by("x_bucket")]))
    put_together = bpe._reassemble(path)
    tracemalloc.start()
    got = put_together(block).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = []
    for i, t in zip([*range(8), None], texts, strict=True):
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert [tuple(r.values()) for r in got] == want
    assert peak < 7 * sum(len((t or "").encode()) for t in texts), peak


def test_language(spark):
    rng = random.Random(12)
    stems = {"aa": ["ka", "ti", "ro", "mun"], "bb": ["şe", "lo", "vir", "gne"], "cc": ["xu", "pha", "dry", "qi"]}

    def text(lang, n):
        return " ".join("".join(rng.choice(stems[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))

    rows = [(i, text(l := rng.choice(list(stems)), rng.randint(3, 60)), l, "s", 1, "", "") for i in range(400)]
    more = [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 !", "bb"), (1003, text("aa", 40) + ". " + text("bb", 20), None), (1004, "É", None), (None, text("cc", 9), "aa")]
    rows += [(i, t, l, None, None, "", "") for i, t, l in more]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.doc_id: r for r in predict_language(docs).collect()}
    assert len(got) == len(rows)
    for i in (1000, 1001, 1002):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert got[1003].lang_pred == "aa" and abs(got[1003].score - 2 / 3) < 0.1 and got[1003].shares.startswith("aa:") and ",bb:" in got[1003].shares
    assert got[None].lang_pred == "cc" and got[1004].lang_pred in stems and all(0 <= r.score <= 1 for r in got.values())
    for i, _, lang, *_ in rows[:400]:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i].lang_pred == lang
    assert {r.lang_pred for r in predict_language(docs.withColumn("lang", docs.source.substr(9, 1))).collect()} <= {"", "und"}
    assert {r.lang_pred for r in predict_language(docs.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}
    assert predict_language(docs.limit(0)).collect() == []
    assert docs.select(held_out("doc_id")).distinct().count() == 2


NAMES = (
    "x_id x_id_ x_sha x_sha_ x_text x_text_ x_lang_pred x_score x_shares x_copies x_copy x_own x_times x_kept x_d x_s x_n x_k x_left x_right x_row x_size "
    "x_top x_key x_node x_n_ x_source x_rank x_bytes x_crc size taken target kept keep_id component_id group_size text_sha256 lang_pred a.b"
).split()


def test_clashing_columns(spark):
    """Columns with every name that the operators use inside keep their values, and only whole rows come out."""
    from vellum.llm.language import identify, keep_identified, train

    texts = ["some words here", "SOME words here", None, "", "other words there again", "other words there again", "12 34"]
    rows = [(i, t, "en", "s", *[f"{n}{i}" for n in NAMES]) for i, t in enumerate(texts)]
    columns = ["doc_id", "text", "lang", "source", *NAMES]
    docs = spark.createDataFrame(rows, ", ".join(f"`{c}` {'long' if c == 'doc_id' else 'string'}" for c in columns))
    langs, model = train(docs)
    for out, ids in [
        (keep_first(docs, exact_dedup(docs)), [1, 3, 5, 6]), (keep_one(docs, near_dedup(docs)), [0, 2, 3, 4, 6]),
        (keep_identified(docs, langs, model), [0, 1, 4, 5]), (apply_mix(docs, mix(docs)), None),
    ]:
        assert out.columns == columns
        got = out.collect()
        assert all(tuple(r) == rows[r.doc_id] for r in got) and (ids is None or sorted(r.doc_id for r in got) == ids)
    assert len(identify(docs, langs, model).columns) == len(columns) + 3
    for op in (mix, interleave, remove_repeats, predict_language, exact_dedup, near_dedup):
        assert sorted(r.doc_id for r in op(docs).collect()) == list(range(len(rows)))


def test_very_many_rows_of_one_id(spark):
    """Rows under one id, or none, with texts of their own are dealt over the ranges like any others."""
    rows = [(1 if i % 2 else None, f"text {i} " * (1 + i % 3), None, "s", 1, "", "") for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    taken = mix(docs).collect()
    assert len(taken) == 3000 and abs(sum(r.taken for r in taken) - 1.5 * sum(r.size for r in taken)) <= 1
    shards = Counter(r.shard for r in interleave(docs).collect())
    assert max(shards.values()) - min(shards.values()) <= 1
    from vellum.llm.mixing import _key
    from pyspark.sql import functions as F

    assert docs.select(_key(1, F.col("doc_id"), F.col("text"))).distinct().count() == 3000


def test_very_long_texts(spark, library):
    """Texts of some megabytes, one a single word, go through every operator whole."""
    rng = random.Random(16)
    long_ = " ".join(f"{rng.choice(WORDS)}{k}" for k in range(120_000))
    near = long_.replace(" ", " x", 2000)
    texts = [long_, near, long_, "é" * 800_000, "kurz und gut", "ende"]
    rows = [(i, t, "de" if i % 2 else "en", "s", 1, "", "") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert {r.doc_id: r.keep_id for r in exact_dedup(docs).collect()} == {0: 2, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup(docs).collect()}
    assert got == {i: (len(shingle_set(t)), 0 if i < 3 else i) for i, t in enumerate(texts)}
    sizes = {i: len(t.split()) for i, t in enumerate(texts)}
    mixed = mix(docs).collect()
    assert {r.doc_id: r.size for r in mixed} == sizes and sum(r.taken for r in mixed) == int(1.5 * sum(sizes.values()))
    assert sorted(r.size for r in interleave(docs, 2).collect()) == sorted(len(t.encode()) + 8 for t in texts)
    assert {r.doc_id for r in predict_language(docs).collect()} == set(range(6))
    removed = {r.doc_id: (r.n_removed, r.n_bytes) for r in remove_repeats(docs).collect()}
    assert removed[0] == removed[2] and removed[0][0] == removed[0][1] and removed[3][0] == 1_600_000 and removed[1][0] > 0.9 * removed[1][1] and removed[4][0] == 0
    tokens = encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert {r.doc_id: r.decoded_sha256 for r in tokens} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(texts)}
    assert {r.n_tokens for r in tokens if r.doc_id in (0, 2)} == {len(library.encode_ordinary(long_))}


def test_mixture_in_slices(monkeypatch):
    """Scores summed in slices, which may cut words, are those of the whole; words longer than a slice too."""
    import numpy as np
    import pyarrow as pa

    from vellum.llm import language

    rng = random.Random(14)
    texts = pa.array([prose(rng.randint(0, 60)) for _ in range(40)] + ["x" * 3000, "", None, " a ", "é" * 50 + " " * 70 + "b"])
    model = np.log(np.random.default_rng(1).dirichlet(np.ones(1 << 16), 3).T).astype(np.float32)
    whole = language.mixtures(texts, model)
    for floats in (3, 30, 1000):
        monkeypatch.setattr(language, "SLICE", floats)
        assert np.allclose(language.mixtures(texts, model), whole, atol=1e-4)


def test_mixture_is_that_of_plain_em():
    """Shares and the chosen set against a plain EM over words, with every language set tried in order of share."""
    import math

    import numpy as np
    import pyarrow as pa

    from vellum.llm.language import mixtures

    model = np.log(np.random.default_rng(2).dirichlet(np.full(1 << 16, 0.05), 3).T + 1e-12).astype(np.float32)

    def units(text):
        out, raw = [], [b | 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in text.encode()]
        a = b = 32
        word = None
        for c in raw:
            if not (c == 32 and b == 32):
                if b == 32 or word is None:
                    out.append(np.zeros(3))
                    word = out[-1]
                out[-1] = out[-1] + model[((((a << 16) | (b << 8) | c) * 0x9E3779B1) & 0xFFFFFFFF) >> 16]
            a, b = b, c
        return np.array(out)

    def em(u, pi, rounds=10):
        a = np.exp(np.maximum(u - u.max(1, keepdims=True), -60))
        for _ in range(rounds):
            r = a * pi
            pi = (r / r.sum(1, keepdims=True)).mean(0)
        return pi, np.log(np.maximum((a * pi).sum(1), 1e-300)).sum()

    rng = random.Random(15)
    for _ in range(40):
        text = "a" + prose(rng.randint(1, 80))
        u = units(text)
        top = np.maximum(u - u.max(1, keepdims=True), -60)
        cost = 4.0 + 0.5 * math.log(len(u))
        pi, likely = em(u, np.full(3, 1 / 3))
        best = top.sum(0).argmax()
        want, value = np.eye(3)[best], top.sum(0)[best]
        if likely - cost > value:
            ranked = np.argsort(-pi, kind="stable")
            for k in (2, 3):
                some = np.zeros(3)
                some[ranked[:k]] = 1 / k
                pi_k, likely_k = em(u, some)
                if likely_k - (k - 1) * cost > value:
                    want, value = pi_k, likely_k - (k - 1) * cost
                elif k > 2:
                    break
        assert np.allclose(mixtures(pa.array([text]), model)[0], want, atol=1e-3), text


def test_pipeline(spark, docs, rows, library, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "mixture", "tokens"]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "tokens":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append([r.asDict() for r in now.collect()])
    languages, exact, near, mixed, tokens = seen
    assert Counter((r["doc_id"], r["text"]) for r in languages) == Counter((r[0], r[1]) for r in rows if any(map(str.isalpha, r[1] or "")))
    assert sorted(fold(r["text"]) for r in exact) == sorted({fold(r["text"]) for r in languages})
    kept = {i for i, _, _, stays in components([tuple(r.values()) for r in exact]) if stays}
    assert sorted(r["doc_id"] for r in near if r["doc_id"] is not None) == sorted(i for i in kept if i is not None)
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in near} and max(Counter(r["doc_id"] for r in mixed).values()) <= 2
    ids = {r["doc_id"]: library.encode_ordinary(r["text"]) for r in mixed}
    assert Counter((r["doc_id"], r["n_tokens"]) for r in tokens) == Counter((r["doc_id"], len(ids[r["doc_id"]])) for r in mixed)
    assert repr_sorted(corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "ids_sha256").collect()) == repr_sorted((r["doc_id"], r["ids_sha256"]) for r in tokens)
