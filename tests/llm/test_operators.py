"""Every operator against the library or a brute-force version, on small tables with odd rows."""

import array
import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from sluice.llm import chat, components, language_id, lattice, packing, pii, sentencepiece_codec, simhash, simhash_wide, substrings, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(table_of, texts, ids=None):
    return table_of([(i if ids is None else ids[i], t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


# ---- packing ----

BPE = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_byte_bpe_equals_library(spark, odd_texts, sf):
    bpe = packing.ByteBpe(*BPE)
    texts = [t for t in odd_texts if t] + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    for t in texts:
        assert bpe.encode(t) == bpe.whole(t) == bpe.by_space(t), t[:60]


def test_windows_are_cheapest():
    """The monotone queue against plain dynamic programming over candidates and chains of full windows."""
    rng = random.Random(5)
    for _ in range(60):
        size, hard = 16, rng.choice([1, 3, 8])
        gaps = [rng.randint(1, 16) for _ in range(12)]
        pos = np.cumsum([0, *gaps])
        pen = np.array([0] + [rng.choice([0, 1, 4]) for _ in gaps])
        cuts = packing.windows(pos, pen, size, hard).tolist()
        price = {int(p): int(c) for p, c in zip(pos, pen, strict=True)}
        end = int(pos[-1])
        cut = lambda b: price[b] if b == end else min(price.get(b, hard), hard)  # noqa: E731  a cut inside a chain costs hard, wherever it is
        total = sum(size - (b - a) + cut(b) for a, b in zip([0, *cuts], cuts, strict=False))
        best = [0] + [10**9] * (len(pos) - 1)
        for j in range(1, len(pos)):
            for i in range(j):
                laps, rest = divmod(int(pos[j] - pos[i]), size)
                if pos[j] - pos[i] <= size:
                    best[j] = min(best[j], best[i] + size - int(pos[j] - pos[i]) + int(pen[j]))
                if rest == 0:
                    best[j] = min(best[j], best[i] + hard * (laps - 1) + int(pen[j]))
        assert cuts[-1] == pos[-1] and all(0 < b - a <= size for a, b in zip([0, *cuts], cuts, strict=False))
        assert total <= best[-1]


def check_pieces(rows, want, size=1024):
    """want: id list of every document by id. Each id lies in one piece; sequences are gapless and within size."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for k, ids in want.items():
        own = sorted(by_doc[k], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in own) == array.array("I", ids).tobytes()
        at = 0
        for r in own:
            assert r.start == at and r.length == len(r.ids) // 4 and r.doc_tokens == len(ids)
            at += r.length
    padding = 0
    for own in by_seq.values():
        own.sort(key=lambda r: r.offset)
        n = 0
        for r in own:
            assert r.offset == n
            n += r.length
        assert n <= size and all(r.sequence_length == n for r in own)
        padding += 0 if n & (n - 1) == 0 else size - n
    return padding


def test_pack(spark, table_of, odd_texts):
    docs = docs_of(table_of, odd_texts)
    bpe = packing.ByteBpe(*BPE)
    want = {i: [*np.frombuffer(bpe.whole(t), "<u4").tolist(), 0] if t else [0] for i, t in enumerate(odd_texts)}
    padding = check_pieces(packing.pack(docs, *BPE).collect(), want)
    assert padding <= 0.01 * sum(map(len, want.values()))
    assert packing.pack(empty(spark), *BPE).count() == 0
    small = packing.pack(docs, *BPE, size=64, stride=8, stream_tokens=500).collect()
    check_pieces(small, want, 64)


# ---- SentencePiece ----


def test_sentencepiece_equals_library(spark, table_of, odd_texts, sf):
    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece_codec.Codec(path).library
    texts = odd_texts + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(80).collect()]
    got = {r.doc_id: r for r in sentencepiece_codec.encode(docs_of(table_of, texts), path).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        assert bytes(got[i].ids) == array.array("I", ids).tobytes() and got[i].decoded == lib.decode(ids), repr(t)[:60]
    assert sentencepiece_codec.encode(empty(spark), path).count() == 0


# ---- SimHash ----


def slow_fingerprint(text, n):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    parts = [" ".join(w)] if len(w) < n else [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_groups(values, radius=3):
    par = {v: v for v in values}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    own = list(par)
    for i, a in enumerate(own):
        for b in own[:i]:
            if (a ^ b).bit_count() <= radius:
                par[find(a)] = find(b)
    return {v: find(v) for v in own}


def test_simhash(spark, table_of, odd_texts):
    texts = [t[:3000] if t else t for t in odd_texts] + ["A B c D e", "a b c d e", "Ä B c", "ä b c"]
    got = {r.doc_id: r for r in simhash.near_duplicates(docs_of(table_of, texts), shingle=3).collect()}
    prints = [slow_fingerprint(t, 3) for t in texts]
    roots = slow_groups(prints)
    least = {}
    for i, p in enumerate(prints):
        least.setdefault(roots[p], i)
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{p:016x}", least[roots[p]]) for i, p in enumerate(prints)}
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("heavy", [4096, 5])
def test_hamming_groups(spark, heavy):
    rng = random.Random(2)
    values = []
    for _ in range(25):
        base = rng.getrandbits(64)
        values.append(base)
        for _ in range(rng.choice([0, 3, 40])):
            values.append(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    rows = [(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)] + [(None, 77)]
    roots = slow_groups(values)
    least = {}
    for i, v in enumerate(values):
        least.setdefault(roots[v], i)
    got = simhash.groups(spark.createDataFrame(rows, "doc_id long, fp long"), heavy=heavy).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: least[roots[v]] for i, v in enumerate(values)} | {None: None}


def test_components_long_chain(spark):
    n = 300
    order = random.Random(1).sample(range(n), n)
    df = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (5, 5)], "u long, v long")
    got = {r.node: r.root for r in components.components(df).collect()}
    assert got == {i: 0 for i in range(n)} | {1000: 1000, 1001: 1000}


def test_components_of_few_edges_take_few_partitions(spark):
    """However many partitions shuffles have, the rounds write as many as the edges need."""
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)], "u long, v long")
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        stars = components.components(edges, each=1000)
        assert {r.node: r.root for r in stars.collect()} == dict.fromkeys(range(41), 0) | dict.fromkeys(range(100, 140), 100)
        written = stars.where("root is not null").select("node")._jdf.queryExecution().analyzed().collectLeaves()
        assert max(written.apply(k).rdd().getNumPartitions() for k in range(written.size())) <= components.PARTS
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_jaccard_near_duplicates(spark, table_of):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    texts = [None, "", "one two", "one two", "Short text here"]
    for _ in range(12):
        base = [word() for _ in range(200)]
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 8, 20):
            copy = list(base)
            for k in rng.sample(range(200), edits):
                copy[k] = word()
            texts.append(" ".join(copy))
    sets = [frozenset(simhash_wide.shingles(t, 5)) for t in texts]
    par = list(range(len(texts)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both, all_ = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if both >= 0.8 * all_:
                par[max(find(i), find(j))] = min(find(i), find(j))
    docs = docs_of(table_of, texts)
    got = simhash_wide.kept(docs)
    assert got.columns == docs.columns
    assert {r.doc_id for r in got.collect()} == {find(i) for i in range(len(texts))}
    assert simhash_wide.kept(empty(spark)).count() == 0


def brute_force_kept(texts):
    sets = [frozenset(simhash_wide.shingles(t, 5)) for t in texts]
    least = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both, all_ = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if both >= 0.8 * all_ and least[i] != least[j]:
                low, high = sorted((least[i], least[j]))
                least = [low if k == high else k for k in least]
    return set(least)


def test_crowd_of_similar_texts_keeps_its_true_pairs(table_of):
    """Pages of one template at a similarity of 0.6 to 0.75, each with one partner a little over 0.8."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 7)))
    template, texts = [word() for _ in range(240)], []
    for _ in range(150):
        own = [word() for _ in range(44)]
        texts.append(" ".join(template + own))
        texts.append(" ".join(template[40:] + own + [word() for _ in range(14)]))
    want = brute_force_kept(texts)
    assert 150 <= len(want) < 200
    assert {r.doc_id for r in simhash_wide.kept(docs_of(table_of, texts)).collect()} == want


def test_texts_that_share_a_fingerprint_are_verified(table_of):
    """Mostly one repeated shingle, the rest of each text its own; nodes of equal fingerprint are a pair."""
    texts = [" ".join(["-"] * 100 + [f"w{k}x{i}" for k in range(40)]) for i in range(12)]
    texts += ["a b c d e f g h", "a b c d e f g h", None, "", " "]
    assert {r.doc_id for r in simhash_wide.kept(docs_of(table_of, texts)).collect()} == brute_force_kept(texts) == {*range(13), 14}
    node = np.array([3, 5])
    u, v, thin = simhash_wide.meetings(simhash_wide.entries(node, node, np.zeros(2, np.uint8), np.full((2, 4), 77, np.uint64), True))
    assert (u.tolist(), v.tolist(), thin.tolist()) == ([3], [5], [False])


def test_near_copies_with_repeated_lines(table_of):
    """Copies that repeat a line another number of times are near copies by their sets."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 7)))
    texts = []
    for times in (5, 10, 20, 60):
        for _ in range(5):
            body, line = [word() for _ in range(180)], [word() for _ in range(20)]
            texts.append(" ".join(body + line))
            texts.append(" ".join(body + line * times))
            texts.append(" ".join(body + [word()] + line * times))
    assert simhash_wide.fingerprint("a b c d e f a b c d e f a b c d e f", 5) == simhash_wide.fingerprint("a b c d e f a b c d e f", 5)
    assert {r.doc_id for r in simhash_wide.kept(docs_of(table_of, texts)).collect()} == brute_force_kept(texts) == set(range(0, 60, 3))


def test_pairs_at_the_threshold(table_of):
    """Texts of 4 shingles and the same with one more word (similarity 0.8), and texts of 225 words near it."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 7)))
    texts = []
    for _ in range(150):
        base = [word() for _ in range(8)]
        texts += [" ".join(base), " ".join([*base, word()])]
    for _ in range(150):
        base, cut = [word() for _ in range(204)], rng.randint(20, 21)
        texts += [" ".join(base + [word() for _ in range(cut)]), " ".join(base + [word() for _ in range(cut)])]
    assert {r.doc_id for r in simhash_wide.kept(docs_of(table_of, texts)).collect()} == brute_force_kept(texts)


def test_crowds_give_forests():
    """A crowd's pairs connect its components; members of one component are no candidates."""
    rng = np.random.default_rng(0)
    e = np.zeros(900, simhash_wide.ENTRY)
    e["node"] = np.arange(900)
    e["root"] = np.where(np.arange(900) < 400, 1, np.arange(900))
    e["rest"][:700] = np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 64, 700).astype(np.uint64))
    e["rest"][700:] = rng.integers(0, 2**63, 200)
    e["key"][800:] = 7
    u, v, thin = simhash_wide.meetings(e)
    assert len(u) < 800 and thin.any() and (e["root"][u] != e["root"][v]).all()
    par = list(range(900))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, b in zip([*u.tolist(), *range(399)], [*v.tolist(), *range(1, 400)], strict=True):
        par[find(a)] = find(b)
    assert len({find(k) for k in range(700)}) == 1


def test_meetings_hold_little_beside_the_entries(monkeypatch):
    """Groups are met some at a time, with the same pairs as all at once."""
    rng = np.random.default_rng(5)
    e = np.zeros(400_000, simhash_wide.ENTRY)
    e["node"] = e["root"] = np.arange(len(e))
    e["key"] = rng.integers(0, len(e) // 200, len(e))
    for name, kind in (("rest", 64), ("more", 64), ("last", 32)):
        e[name] = rng.integers(0, 2**kind, len(e), np.uint64) if kind == 64 else rng.integers(0, 2**kind, len(e))
    e[::50] = e[1::50]  # some pairs of one node each way round
    e["node"][::50] -= 1
    e["root"][::50] -= 1
    tracemalloc.start()
    some = simhash_wide.meetings(e)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * e.nbytes, peak / e.nbytes
    monkeypatch.setattr(simhash_wide, "CHUNK", len(e))
    once = simhash_wide.meetings(e)
    assert len(some[0]) >= len(e) // 50 and all((x == y).all() for x, y in zip(some, once, strict=True))


@pytest.mark.parametrize(("copies", "edits"), [(8, 4), (120, 4), (700, 3), (700, 4), (1500, 4)])
def test_groups_of_near_copies(table_of, copies, edits):
    """One text and copies with 3 or 4 of 200 words changed: each is at 0.8 or more to it, fewer to each other."""
    rng = random.Random(copies + edits)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 7)))
    base, texts = [word() for _ in range(200)], []
    for _ in range(copies):
        copy = list(base)
        for k in rng.sample(range(200), edits):
            copy[k] = word()
        texts.append(" ".join(copy))
    texts.insert(copies // 2, " ".join(base))
    assert [r.doc_id for r in simhash_wide.kept(docs_of(table_of, texts)).collect()] == [0]


def test_blocks_of_groups(table_of):
    """Groups of segment values split into blocks, and crowds into pieces, give the same."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 7)))
    texts = []
    for _ in range(6):
        base = [word() for _ in range(120)]
        for _ in range(20):
            copy = list(base)
            for k in rng.sample(range(120), 3):
                copy[k] = word()
            texts.append(" ".join(copy))
    want = brute_force_kept(texts)
    assert {r.doc_id for r in simhash_wide.kept(docs_of(table_of, texts), block=4).collect()} == want
    node = np.arange(30)
    words = np.full((30, 4), 77, np.uint64)
    e = simhash_wide.entries(node, node, np.zeros(30, np.uint8), words, True, {77: 3})
    u, v, _ = simhash_wide.meetings(e[(e["key"] & 0xFFFFF) == 77])
    par = list(range(30))
    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        low, high = sorted((par[a], par[b]))
        par = [low if p == high else p for p in par]
    assert set(par) == {0}


def test_near_duplicates_pass_on_clashing_columns(table_of):
    docs = table_of([(7, "a b c", "x", 1), (3, "a b c", "y", 2), (4, None, "z", 3)], "doc_id long, text string, `row` string, `doc` int")
    for c in ("__row", "root", "node", "a.b", "id"):
        docs = docs.withColumn(c, F.col("doc") * 10)
    got = simhash_wide.kept(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.row, r["__row"], r["a.b"]) for r in got.collect()) == [(3, "y", 20, 20), (4, "z", 30, 30)]


# ---- search and lattice ----

VECS = "vec_id long, embedding array<float>, label int"


def vectors():
    rng = np.random.default_rng(7)
    rows = []
    for k in range(300):
        v = rng.normal(size=16)
        rows.append((k, v.tolist(), k % 3))
        if k % 10 == 0:
            rows += [(1000 + 10 * k + j, (v + rng.normal(0, 0.02, 16)).tolist(), k % 3) for j in range(4)]
    rows += [(5000, rows[0][1], 0), (5100, rows[0][1], 0), (5200, None, 1), (5300, [float("nan")] * 16, 1), (5400, [0.0] * 16, 1), (5500, [1.0, None] + [0.0] * 14, 1), (5600, rows[0][1], None), (None, rows[0][1], 0), (5700, [float("inf")] + [0.0] * 15, 2), (5800, [], 1)]
    return rows


def test_topk(spark, table_of):
    rows = vectors()
    got = {}
    for r in topk.search(table_of(rows, VECS), F.col("vec_id") % 100 == 0, chunk=7, block=64, candidates=50).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    part = [(i, np.floor(1024 * np.float32(v).astype(float)).astype(int) if v else np.zeros(0, int)) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = {}
    for i, w in part:
        if i % 100 == 0:
            scores = sorted((-(int(w[: len(x)] @ x[: len(w)])), j) for j, x in part if j != i)[:10]
            want[i] = [(n + 1, j, -s) for n, (s, j) in enumerate(scores)]
    assert {k: sorted(v) for k, v in got.items()} == want
    assert topk.search(empty(spark, VECS), F.col("vec_id") % 100 == 0).count() == 0


def test_e8_decoding():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 2, (2000, 8))
    p = lattice.decode(x)
    twice = np.rint(2 * p)
    assert (np.abs(2 * p - twice) < 1e-12).all() and ((twice % 2).sum(axis=1) % 8 == 0).all() and (p.sum(axis=1) % 2 == 0).all()
    r = ((x - p) ** 2).sum(axis=1)
    assert r.max() <= 1 + 1e-9 and len(lattice.ROOTS) == 240 and np.allclose((lattice.ROOTS**2).sum(axis=1), 2)
    assert (((x[:, None] - p[:, None] - lattice.ROOTS) ** 2).sum(axis=2).min(axis=1) >= r - 1e-9).all()


@pytest.mark.parametrize("block", [2048, 3])
def test_lattice_links(spark, table_of, block):
    rows = vectors()
    got = {r.vec_id: r for r in lattice.near_duplicates(table_of(rows, VECS), block=block).collect()}
    n = len(rows)
    unit = lattice.normalised([None if v is None else [None if x is None else float(np.float32(x)) for x in v] for _, v, _ in rows])
    link = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and rows[i][2] is not None and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= 0.98] for i in range(n)]
    par = list(range(n))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i in range(n):
        for j in link[i]:
            par[find(i)] = find(j)
    least = {}
    for i, (k, _, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), 10**9), k)
    for i, (k, _, _) in enumerate(rows):
        want = least.get(find(i))
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (len(link[i]), want, k is not None and k == want), k
    assert lattice.near_duplicates(empty(spark, VECS)).count() == 0


# ---- substrings ----


def slow_removal(texts, n=200):
    seen = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        cover = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                cover[i : i + n] = b"\1" * n
        out.append((len(t), sum(cover), len(re.findall(b"\1+", bytes(cover))), bytes(c for c, m in zip(t, cover, strict=True) if not m)))
    return out


@pytest.mark.parametrize("heavy", [5000, 2])
def test_repeats(spark, table_of, odd_texts, heavy):
    rnd = random.Random(1)
    texts = ["a" * 199, "a" * 200, "a" * 201, "b" * 500, "ab" * 300, *[t[:2500] if t else t for t in odd_texts]]
    base = "".join(rnd.choice("abcd ") for _ in range(3000))
    for _ in range(60):
        i, n = rnd.randrange(2500), rnd.choice([150, 199, 200, 201, 230, 340, 400])
        texts.append("".join(rnd.choice("xyz é") for _ in range(rnd.randrange(50))) + base[i : i + n] + "".join(rnd.choice("xyz") for _ in range(rnd.randrange(150))))
    texts += [texts[40], texts[40], base]
    docs = docs_of(table_of, texts)
    want = slow_removal([(t or "").encode() for t in texts])
    got = {r.doc_id: (r.n_bytes, sum(s.hi - s.lo for s in r.removed), len(r.removed), bytes(r.kept)) for r in substrings.remove(docs, heavy=heavy).collect()}
    assert got == dict(enumerate(want))
    cut = {r.doc_id: r.text for r in substrings.without_repeats(docs, heavy=heavy).collect()}
    assert cut == {i: None if t is None else want[i][3].decode("utf-8", "ignore") for i, t in enumerate(texts)}
    assert substrings.remove(empty(spark)).count() == 0


def test_long_document_is_sampled_in_parts(monkeypatch):
    data = bytes(random.Random(3).choices(b"abcdef ", k=5000))
    whole = {(a, s) for _, a, x, y in zip(*substrings.samples(data, 200, 40), strict=True) for s in range(x, y + 1)}
    monkeypatch.setattr(substrings, "PART", 700)
    parts = {(a, s) for _, a, x, y in zip(*substrings.samples(data, 200, 40), strict=True) for s in range(x, y + 1)}
    assert len(whole) == 4801 and len(parts) == 4801 and {s for _, s in whole} == {s for _, s in parts} == set(range(4801))


# ---- chat ----


def test_chat_round_trip(spark, table_of):
    odd = "<|im_end|><|im_start|>assistant ok"
    rows = [(-1, 0, "user", odd), (-1, 1, "assistant", odd), (1, 0, "system", ""), (1, 1, "user", None), (1, 2, "assistant", "<\\|x<\\\\|"), (2, 0, "assistant", "first"), (2, 1, "assistant", "é<"), (3, 0, None, "|a"), (3, None, "we%i\nrd<|", "b\n"), (None, 0, "user", "q"), (None, 0, "user", "q")]
    got = {r.conv_id: r for r in chat.read_back(chat.format_segments(table_of(rows, "conv_id long, turn long, role string, text string"))).collect()}
    by = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1], r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((r or "", x or ""))
    for c, turns in by.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {c: got[c].in_order for c in by} == {-1: True, 1: True, 2: False, 3: False, None: False}
    seg = chat.format_segments(table_of(rows, "conv_id long, turn long, role string, text string"))
    texts = {r.conv_id: r.formatted for r in chat.conversations(seg).collect()}
    assert {c: len(t) for c, t in texts.items()} == {c: r.formatted_chars for c, r in got.items()}
    assert texts[-1].count("<|im_start|>") == 2
    assert chat.read_back(chat.format_segments(empty(spark, "conv_id long, turn long, role string, text string"))).count() == 0


def test_escapes():
    rng = random.Random(0)
    for _ in range(3000):
        t = "".join(rng.choice("<|\\a") for _ in range(rng.randint(0, 8)))
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)
        assert chat.unescape_role(chat.escape_role(t + "\n%0A")) == t + "\n%0A"


# ---- toxicity ----


def test_field_marginals_are_exact():
    rng = np.random.default_rng(0)
    step = rng.normal(size=(2, 2))
    sizes = np.array([1, 4, 6])
    emit = rng.normal(size=(3, 6))
    for fast in (toxicity.forward_backward(emit, sizes, step), toxicity.pair_marginals(emit, sizes, step)[0]):
        for row in range(3):
            n = sizes[row]
            total, on = 0.0, np.zeros(n)
            for k in range(2**n):
                tags = [(k >> i) & 1 for i in range(n)]
                w = np.exp(sum(emit[row, i] * tags[i] for i in range(n)) + sum(step[tags[i], tags[i + 1]] for i in range(n - 1)))
                total += w
                on += w * np.array(tags)
            assert np.allclose(fast[row, :n], on / total)


def test_toxicity(spark, table_of, odd_texts):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    rows, marks = [], []
    for i in range(400):
        words = [word() for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(40)] = rng.choice(["zzbad", "zznasty", "zzvile"])
        rows.append((i, " ".join(words), "en", "s", 0))
        marks.append((i, 1, int(toxic)))
    rows += [(1000 + i, t, None, None, None) for i, t in enumerate(odd_texts)]
    marks += [(5, None, None), (None, 1, 1)]
    docs, labels = table_of(rows, DOCS), table_of(marks, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels.where("doc_id % 5 <> 0"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    wrong = sum((got[i].score >= 0.5) != (i % 4 == 0) for i in range(0, 400, 5))
    assert wrong <= 2
    r = got[20]
    assert {rows[20][1][s.start : s.end] for s in r.spans} & {"zzbad", "zznasty", "zzvile"}
    assert got[1000].score == got[1001].score < 0.5 and not got[1000].spans
    assert toxicity.clean(docs, model).columns == docs.columns
    assert {r.doc_id for r in toxicity.clean(docs, model).collect()} == {k for k, r in got.items() if r.score < 0.5}
    nothing = toxicity.fit(docs, labels.where("toxic = 0"))
    assert toxicity.score(docs, nothing).select("score").distinct().collect()[0].score == 0 and toxicity.clean(docs, nothing).count() == len(rows)
    assert toxicity.score(empty(spark), model).count() == 0


# ---- PII ----


def slow_base(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]


def test_pii(spark, table_of, odd_texts):
    rng = random.Random(9)
    made = ["a@b.c.d@e.f @x.y ..@a-b.c. 1.2.3.4.5.6.7.8 256.1.1.1 +1 (234) 567-8901 4111 1111 1111 1111 0 04111-1111-1111-1111", "é@b.c", "x@@y.z a@b..c 0001.02.3.255", "IBAN GB82 WEST 1234 5698 7654 32 and ssn 123-45-6789"]
    made += ["".join(rng.choice("a@.1 +-(4b%") for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    texts = [*odd_texts, *made]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find(docs_of(table_of, texts)).collect()}
    for i, t in enumerate(texts):
        assert [s for s in got[i] if s[0] in pii.BASE] == (slow_base(t) if t else []), t
    assert {k for k, *_ in got[len(odd_texts) + 3]} >= {"iban", "ssn"}
    near = pii.spans("my phone: +61 400 123 456")[0]
    far = pii.spans("+61 400 123 456")[0]
    assert near[3] > far[3]
    assert pii.masked("mail a@b.co now", pii.spans("mail a@b.co now")) == "mail <email> now"
    assert pii.find(empty(spark)).count() == 0


def test_checksums():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")


# ---- languages ----


def test_languages(spark, table_of, odd_texts):
    rng = random.Random(8)
    parts = {"aa": ["ka", "ki", "ko", "ru"], "bb": ["sch", "ung", "ein"], "cc": ["eau", "oux", "é"]}
    rows = []
    for i in range(300):
        lang = rng.choice(list(parts))
        rows.append((i, " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(12)), lang, "s", 0))
    docs = table_of(rows, DOCS)
    out = language_id.held_out("doc_id", 3, 1)
    langs, logp = language_id.fit(docs.where(~out))
    assert langs == ["aa", "bb", "cc"]
    got = {r.doc_id: r for r in language_id.predict(docs, langs, logp).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang, *_ in rows) >= 298
    assert {r.doc_id for r in docs.where(out).collect()} == {i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1}
    odd = {r.doc_id: r for r in language_id.predict(docs_of(table_of, odd_texts), langs, logp).collect()}
    for i, t in enumerate(odd_texts):
        assert (odd[i].lang_pred == "und") == (not t or not any(c.isalpha() for c in t)) and 0 <= odd[i].score <= 1
    none, flat = language_id.fit(docs.where("lang is null"))
    assert none == [] and {r.lang_pred for r in language_id.predict(docs, none, flat).collect()} == {"und"}


def test_histogram_of_parts():
    text = "".join(random.Random(1).choices("abc İé", k=5000))
    import sluice.llm.language_id as m

    whole = np.bincount(m.grams(text, 1024), minlength=1024)
    assert (m.histogram(text, 1024) == whole).all()
