"""SimHash near-duplicates at a Jaccard similarity: 256-bit fingerprints, multi-index hashing, exact verification.

Texts of similarity 0.8 differ in about 15 % of a fingerprint's bits, too many for the 64-bit operator's radius. A
256-bit fingerprint has 16 segments of 16 bits. Each distinct shingle set's fingerprint is filed under every segment's
value and under that value with one set bit cleared. Entries travel packed as bytes and are grouped by segment value in
numpy. Entries that meet and whose sizes allow the similarity are compared on the 160 bits they carry, then on all 256,
and what remains is verified by the Jaccard similarity of the sets of word shingles. The README gives the recall.

Large groups are met in three steps, none of which drops a link:

1. Entries of whole segment values only, each crowd of near ones giving a star around its middle. These pairs merge
   likely copies into components. This step need not be complete.
2. All entries, with their components: pairs of one component are no candidates. A group of few near pairs gives them
   all. A crowd gives a spanning forest of its components, which is marked. The pairs of both steps are verified.
3. Components, joined by the marked pairs, that verified links leave apart are compared exactly: all pairs of different
   groups, in blocks of bounded size, each pair of blocks a piece of work of its own, which gives links only.

Bits of few shingles are not independent, so sets of up to EXACT shingles need no fingerprints: sets of the similarity
share one of their first marks (the rarest come first), and those that share one are compared as in step 3.

Segment values that very many entries share are split into blocks, and pairs of blocks are pieces of work. Documents of
equal shingle sets (by a 128-bit digest) are one node from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch, cut, release, slices
from .components import components

SEGMENTS, WIDTH = 16, 16
BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
LANES = np.arange(32, dtype=np.int64) * 256
#: key: segment and value (20 bits), piece (12 bits); root: a hash of the component; size: a logarithm.
ENTRY = np.dtype([("key", "<u4"), ("root", "<u4"), ("node", "<i8"), ("rest", "<u8"), ("more", "<u8"), ("last", "<u4"), ("size", "u1")])
#: Entries of a task's bundle of groups on average, and of a block of a group.
BUNDLE, BLOCK = 500_000, 16_384
#: Entries of the groups that are met together, and edges of a partition in the search for components.
CHUNK, EDGES = 1 << 16, 200_000
#: Nodes of a partition of the tables between steps, and the least number of partitions.
SHARE, PARTS = 4000, 12
#: Group size up to which pairs are listed by shifting, beyond which by rows.
LIGHT = 512
#: Differing bits that are still candidates, of 160 and of 256 (4.6 standard deviations beyond the mean
#: of independent bits at 0.8), and of 160 where texts are likely copies of a middle one.
NEAR_160, NEAR_256, CLOSE_160 = 45, 66, 33
#: Shingles of the smaller set up to which pairs are found without fingerprints.
EXACT = 32
#: Nodes and shingles of a block of the exact comparison.
NODES, MARKS = 1024, 1 << 18
STEPS = 4  # size classes within the similarity


def shingles(text: str | None, n: int) -> list[bytes]:
    """Word shingles with repeats; a shorter text's words are one shingle, a text without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= n:
        return [joined]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - n + 1].tolist()
    return [joined[a:b] for a, b in zip(starts, ends[n - 1 :].tolist(), strict=True)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashed(text: str | None, n: int) -> np.ndarray:
    """Two 64-bit hashes of each distinct shingle (rows), ordered by the first; no two rows share the first."""
    digest = xxhash.xxh3_128_digest
    own = b"".join([digest(s) for s in set(shingles(text, n))])
    pairs = np.frombuffer(own, "<u8").reshape(-1, 2)
    _, first = np.unique(pairs[:, 0].view(np.int64), return_index=True)
    return pairs[first]


def marks_of(pairs: np.ndarray) -> np.ndarray:
    """The set of shingles: their first hashes, ascending as signed numbers."""
    return pairs[:, 0].view(np.int64)


def fingerprint_of(pairs: np.ndarray) -> bytes:
    """Of the set of shingles, as the similarity that verification uses; repeats do not count."""
    counts = np.zeros((32, 256), np.int64)
    for at in range(0, len(pairs), 1 << 15):
        part = pairs[at : at + (1 << 15)]
        four = np.concatenate([part, _mixed(part + np.uint64(0x9E3779B97F4A7C15))], axis=1)
        lanes = four.view(np.uint8).reshape(-1, 32) + LANES
        counts += np.bincount(lanes.ravel(), minlength=8192).reshape(32, 256)
    return np.packbits((counts @ BITS).ravel() * 2 > len(pairs), bitorder="little").tobytes()


def fingerprint(text: str | None, n: int) -> bytes:
    return fingerprint_of(hashed(text, n))


def _lists(arrays: list[np.ndarray | None]) -> pa.Array:
    sizes = np.array([0 if a is None else len(a) for a in arrays], np.int64)
    values = [a for a in arrays if a is not None]
    ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.array([*[a is None for a in arrays], False]))
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(values) if values else np.empty(0, np.int64)))


def _arrays(column: pa.ListArray) -> list[np.ndarray]:
    flat, ends = column.flatten().to_numpy(), np.asarray(column.offsets)
    return np.split(flat, (ends - ends[0])[1:-1]) if len(column) else []


def _prints(rows: DataFrame, id_col: str, text_col: str, n: int, few: int, id_type: str) -> DataFrame:
    """row, id, digest of the shingle set, fp, number of shingles, and the set itself where it has up to `few`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in slices(batches):
            digests, fps, sizes, sets = [], [], [], []
            for text in b.column(2).to_pylist():
                pairs = hashed(text, n)
                marks = marks_of(pairs)
                digests.append(xxhash.xxh3_128_digest(marks.tobytes()))
                fps.append(fingerprint_of(pairs))
                sizes.append(len(marks))
                sets.append(marks if len(marks) <= few else None)
            yield batch(["row", "id", "digest", "fp", "size", "few"], b.column(0), b.column(1), pa.array(digests, pa.binary()), pa.array(fps, pa.binary()), pa.array(sizes, pa.int64()), _lists(sets))

    picked = rows.select("row", F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"row long, id {id_type}, digest binary, fp binary, size long, few array<long>")


def _classes(size: np.ndarray, similarity: float) -> np.ndarray:
    """Logarithms of sizes; sets of the similarity differ by at most STEPS."""
    return np.minimum(255, np.floor(STEPS * np.log(np.maximum(1, size)) / np.log(max(1.001, 1 / similarity)))).astype(np.uint8)


def _hash32(x: np.ndarray) -> np.ndarray:
    return (_mixed(x.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def entries(node: np.ndarray, root: np.ndarray, size: np.ndarray, words: np.ndarray, ball: bool, blocks: dict[int, int] | None = None) -> np.ndarray:
    """Entries of nodes under their segment values, and with `ball` under those with a bit cleared; words: n x 4 uint64; size: classes.

    blocks: of keys whose group is split, the number of blocks; an entry goes to each piece that has its block.
    """
    values = words.view(np.uint16).reshape(len(node), SEGMENTS)
    masks = np.uint16(1) << np.arange(WIDTH, dtype=np.uint16)
    roots = _hash32(root)
    out = []
    for s in range(SEGMENTS):
        v = values[:, s]
        parts = [(np.arange(len(v)), v)]
        if ball:
            who, bit = np.nonzero(v[:, None] & masks)
            parts.append((who, v[who] ^ masks[bit]))
        for at, key in parts:
            e = np.empty(len(at), ENTRY)
            e["key"], e["node"], e["root"], e["size"] = key.astype(np.uint32) | np.uint32(s << WIDTH), node[at], roots[at], size[at]
            e["rest"], e["more"], e["last"] = words[at, (s // 4 + 1) % 4], words[at, (s // 4 + 2) % 4], words[at, (s // 4 + 3) % 4].astype(np.uint32)
            out.append(e)
    e = np.concatenate(out)
    if not blocks:
        return e
    split = np.isin(e["key"], np.fromiter(blocks, np.uint32))
    out = [e[~split]]
    for x in e[split]:
        n = blocks[int(x["key"])]
        mine = int(_hash32(np.array([x["node"]]))[0]) % n
        copies = np.repeat(np.array([x], ENTRY), n)
        lo, hi = np.minimum(mine, np.arange(n)), np.maximum(mine, np.arange(n))
        copies["key"] |= (hi * (hi + 1) // 2 + lo).astype(np.uint32) << np.uint32(20)
        out.append(copies)
    return np.concatenate(out)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of the 160 that entries carry."""
    return np.bitwise_count(a["rest"] ^ b["rest"]) + np.bitwise_count(a["more"] ^ b["more"]) + np.bitwise_count(a["last"] ^ b["last"])


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether entries are candidates: of different components, near, and of sizes that allow the similarity."""
    gap = a["size"].astype(np.int16) - b["size"]
    return (apart(a, b) <= NEAR_160) & (a["root"] != b["root"]) & (np.abs(gap) <= STEPS)


def middle(e: np.ndarray) -> int:
    """Of some entries that with the most close ones."""
    some = np.unique(np.linspace(0, len(e) - 1, min(len(e), 128)).astype(np.int64))
    return int(some[(apart(e[some, None], e[None, :]) <= CLOSE_160).sum(axis=1).argmax()])


def forest(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (as positions) of a spanning forest of the candidates; entries of one component are one node. It begins with a middle one."""
    _, root = np.unique(e["root"], return_inverse=True)
    order = np.argsort(root, kind="stable")
    members = np.split(order, np.flatnonzero(np.diff(root[order])) + 1)
    left = np.ones(len(members), bool)
    edges: list[tuple[int, int]] = []
    for first in (int(root[middle(e)]), *range(len(members))):
        queue = [first] if left[first] else []
        left[first] = False
        while queue:
            for x in members[queue.pop(0)].tolist():
                rest = np.flatnonzero(left[root])
                hit = rest[near(e[x], e[rest])]
                if len(hit):
                    new, at = np.unique(root[hit], return_index=True)
                    edges += [(x, k) for k in hit[at].tolist()]
                    left[new] = False
                    queue += new.tolist()
            if not left.any():
                queue = []
    a = np.array(edges, np.int64).reshape(-1, 2)
    return a[:, 0], a[:, 1]


def all_near(e: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Positions of all candidates, or None where there are more than `most`."""
    left, right, n = [], [], 0
    for at in range(0, len(e), 128):
        x, y = np.nonzero(near(e[at : at + 128, None], e[None, at:]))
        up = y > x
        n += int(up.sum())
        if n > most:
            return None
        left.append(x[up] + at)
        right.append(y[up] + at)
    return np.concatenate(left), np.concatenate(right)


def meetings(e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates (pairs of nodes, u < v) among entries of equal keys; of a crowd a forest, then marked True.

    Whole groups are taken together up to about CHUNK entries, so that beside e there is never another copy of it.
    """
    order = np.lexsort((e["node"], e["size"], e["key"]))
    key = e["key"][order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(e) else np.empty(0, np.int64)
    ends = np.append(starts, len(e))
    found, g = [], 0
    while g < len(starts):
        last = max(g + 1, int(np.searchsorted(ends, ends[g] + CHUNK, "right")) - 1)
        found.append(_met(e[order[ends[g] : ends[last]]], ends[g : last + 1] - ends[g]))
        g = last
    u, v, t = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))
    order = np.lexsort((~t, v, u))
    u, v, t = u[order], v[order], t[order]
    new = np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])]) if len(u) else np.empty(0, bool)
    return u[new], v[new], t[new]


def _met(e: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """meetings, with repeats, of whole groups in order; ends: where each starts, and the number of entries."""
    starts, sizes = ends[:-1], np.diff(ends)
    group = np.repeat(np.arange(len(starts)), sizes)
    at = np.flatnonzero(sizes[group] <= LIGHT)
    left, right, step = [], [], 0
    while len(at):
        step += 1
        at = at[at + step < len(e)]
        at = at[(group[at] == group[at + step]) & (e["size"][at + step] - e["size"][at] <= STEPS)]
        own, other = e[at], e[at + step]
        hit = at[near(own, other)]
        left.append(hit)
        right.append(hit + step)
    a = np.concatenate(left) if left else np.empty(0, np.int64)
    b = np.concatenate(right) if right else np.empty(0, np.int64)
    crowded = np.bincount(group[a], minlength=len(starts)) > 2 * sizes
    calm = ~crowded[group[a]]
    left, right, thin = [a[calm]], [b[calm]], [np.zeros(int(calm.sum()), bool)]
    for g in np.flatnonzero(crowded | (sizes > LIGHT)):
        own = e[starts[g] : starts[g] + sizes[g]]
        found = None if crowded[g] else all_near(own, 2 * int(sizes[g]))
        x, y = forest(own) if found is None else found
        left.append(starts[g] + x)
        right.append(starts[g] + y)
        thin.append(np.full(len(x), found is None))
    a, b, t = e["node"][np.concatenate(left)], e["node"][np.concatenate(right)], np.concatenate(thin)
    return np.minimum(a, b), np.maximum(a, b), t


def _words(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, 4)


def _crowded_keys(nodes: DataFrame, block: int) -> dict[int, int]:
    """Blocks of the keys whose groups have far over `block` entries. There are 2**20 keys, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SEGMENTS << WIDTH, np.int64)
        for b in batches:
            values = _words(b.column(0)).view(np.uint16).reshape(-1, SEGMENTS)
            n += np.bincount((values + (np.arange(SEGMENTS) << WIDTH)).ravel(), minlength=len(n))
        at = np.flatnonzero(n)
        yield batch(["key", "n"], at, n[at])

    own = arrow_map(nodes, ["fp"], run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    large = {r["key"]: r["n"] for r in own.where(F.col("n") * (WIDTH + 1) > block).collect()}
    filed: dict[int, int] = {}
    for key, n in large.items():
        for near_key in (key, *[key ^ (1 << b) for b in range(WIDTH) if key >> b & 1]):
            filed[near_key] = filed.get(near_key, 0) + n
    return {k: min(64, -(-n // block)) for k, n in filed.items() if n > block}


def _candidates(nodes: DataFrame, ball: bool, similarity: float, block: int = BLOCK) -> DataFrame:
    """(u, v, thin) of nodes (node, root, size, fp) that meet; thin: where any crowd gave the pair."""
    each = SEGMENTS * (1 + ball * WIDTH // 2)
    parts = max(1, -(-nodes.count() * each // BUNDLE))
    blocks = _crowded_keys(nodes, block) if ball else None

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, rows=2048):
            size = _classes(b.column(2).to_numpy(), similarity)
            e = entries(b.column(0).to_numpy(), b.column(1).to_numpy(), size, _words(b.column(3)), ball, blocks)
            part = (e["key"] * np.uint32(0x9E3779B1) >> np.uint32(7)) % np.uint32(parts)
            order = np.argsort(part, kind="stable")
            bounds = np.searchsorted(part[order], np.arange(parts + 1))
            e = e[order]
            some = [k for k in range(parts) if bounds[k + 1] > bounds[k]]
            yield batch(["part", "blob"], pa.array(some, pa.int32()), pa.array([e[bounds[k] : bounds[k + 1]].tobytes() for k in some], pa.binary()))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs, held = None, [], 0

        def close() -> pa.RecordBatch:
            e = np.frombuffer(b"".join(blobs), ENTRY)
            blobs.clear()
            return batch(["u", "v", "thin"], *meetings(e))

        release()
        for b in slices(batches, rows=64, size=16 << 20):
            for part, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                full = not ball and held > 4 * BUNDLE * ENTRY.itemsize  # the first step need not be complete
                if blobs and (part != now or full):
                    yield close()
                    held = 0
                now = part
                blobs.append(blob)
                held += len(blob)
        if blobs:
            yield close()

    sent = nodes.select("node", "root", "size", "fp").mapInArrow(send, "part int, blob binary")
    met = sent.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(meet, "u long, v long, thin boolean")
    return met.groupBy("u", "v").agg(F.max("thin").alias("thin"))


def _fit(p, q, similarity: float):
    """Whether sets of these sizes can have the similarity."""
    return (p >= similarity * q - 1e-9) & (q >= similarity * p - 1e-9)


def linked(root: np.ndarray, side: np.ndarray | None, words: np.ndarray | None, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Verified links (as positions) that connect all linked sets of different roots; with side, only pairs across."""
    sizes = np.array([len(x) for x in sets])
    starts = np.cumsum(sizes) - sizes
    names, ids = np.unique(np.concatenate(sets), return_inverse=True)
    _, label = np.unique(root, return_inverse=True)
    far = lambda x, y: sum(np.bitwise_count(words[x, k] ^ words[y, k]).astype(np.int64) for k in range(4))
    order = np.arange(len(sets))
    if words is not None:  # those that many are near to come first
        order = np.argsort([-int((far(x, order) <= NEAR_256 * 2 // 3).sum()) for x in order], kind="stable")
    left, own, edges = np.ones(len(sets), bool), np.zeros(len(names), np.int64), []
    for x in order.tolist():
        left[x] = False
        ok = left & (label != label[x]) & _fit(sizes, sizes[x], similarity)
        if side is not None:
            ok &= side != side[x]
        other = np.flatnonzero(ok)
        if words is not None:
            other = other[far(x, other) <= NEAR_256]
        if not len(other):
            continue
        own[ids[starts[x] : starts[x] + sizes[x]]] = 1
        if len(other) * 8 < len(sets):
            both = np.array([own[ids[starts[k] : starts[k] + sizes[k]]].sum() for k in other.tolist()])
        else:
            both = np.add.reduceat(own[ids], starts)[other]
        own[ids[starts[x] : starts[x] + sizes[x]]] = 0
        hit = other[both >= similarity * (sizes[other] + sizes[x] - both)]
        if len(hit):
            new, at = np.unique(label[hit], return_index=True)
            edges += [(x, k) for k in hit[at].tolist()]
            label[np.isin(label, new)] = label[x]
    return edges


def _compared(members: DataFrame, sets: DataFrame, similarity: float, prints: bool, parts: int) -> DataFrame:
    """(u, v): verified links that connect what is linked in each crowd of members (crowd, root, node, size). sets: node, fp, marks.

    A crowd's largest component, where it has over NODES nodes, is not compared with itself; what remains is dealt to
    blocks, and each pair of blocks is a piece of work.
    """
    blocks = lambda n, w: F.ceil(F.greatest(n / NODES, w / MARKS)).cast("int")
    whole = members.groupBy("crowd", "root").agg(F.count("*").alias("n"), F.sum("size").alias("w"))
    top = F.max(F.struct("n", "root", "w")).alias("top")
    crowds = whole.groupBy("crowd").agg(top, F.sum("n").alias("n"), F.sum("w").alias("w"), F.count("*").alias("roots")).where("roots > 1")
    giant = F.col("top.n") > NODES
    less = lambda c: F.col(c) - F.when(giant, F.col(f"top.{c}")).otherwise(0)
    crowds = cut(crowds.select("crowd", F.when(giant, F.col("top.root")).alias("giant"), blocks(less("n"), less("w")).alias("m"), F.when(giant, blocks(F.col("top.n"), F.col("top.w"))).otherwise(0).alias("g")), parts)
    dealt = members.join(crowds, "crowd").withColumn("within", F.coalesce(F.col("root") == F.col("giant"), F.lit(False)))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("node"), F.when(F.col("within"), F.col("g")).otherwise(F.col("m"))).cast("int"))
    # blocks of the rest are 0, 1, ...; those of the largest component -1, -2, ...
    to = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    met = F.when(F.col("within"), to(F.col("m"))).otherwise(F.concat(to(F.col("m")), F.transform(to(F.col("g")), lambda y: -1 - y)))
    dealt = dealt.withColumn("own", F.when(F.col("within"), -1 - F.col("mine")).otherwise(F.col("mine"))).withColumn("other", F.explode(met))
    pieces = dealt.select("crowd", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "root", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        now, held = None, []

        def close() -> pa.RecordBatch:
            own, root, node = (np.concatenate([h[k] for h in held]) for k in range(3))
            marks = [m for h in held for m in h[4]]
            words = np.concatenate([h[3] for h in held]) if prints else None
            pairs = linked(root, own if now[1] != now[2] else None, words, marks, similarity) if len(node) > 1 else []
            i, j = np.array(pairs, np.int64).reshape(-1, 2).T
            return batch(["u", "v"], node[i], node[j])

        for b in slices(batches, rows=4096):
            piece = list(zip(*[b.column(k).to_pylist() for k in range(3)], strict=True))
            bounds = [0, *[k for k in range(1, len(piece)) if piece[k] != piece[k - 1]], len(piece)]
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                if held and piece[lo] != now:
                    yield close()
                    held = []
                now = piece[lo]
                part = b.slice(lo, hi - lo)
                held.append((*[part.column(k).to_numpy() for k in (3, 4, 5)], _words(part.column(6)) if prints else None, _arrays(part.column(7))))
        if held:
            yield close()

    place = ["crowd", "x", "y"]
    spread = pieces.join(sets, "node").select(*place, "own", "root", "node", "fp", "marks").repartition(*place).sortWithinPartitions(*place)
    return spread.mapInArrow(run, "u long, v long").distinct()


def _few_links(nodes: DataFrame, similarity: float, parts: int) -> DataFrame:
    """(u, v): verified links that connect all nodes (node, size, few) that are linked; few: the sets.

    Sets of the similarity share one of their first size - ceil(similarity * size) + 1 marks in any common order; the
    order is by number of sets, then by value, and marks of one set alone cannot be shared.
    """
    each = nodes.select("node", "size", F.explode("few").alias("mark"))
    often = cut(each.groupBy("mark").agg(F.count("*").alias("sets")).where("sets > 1"), parts)
    shared = each.join(often, "mark").groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("sets", "mark"))).alias("m"))
    first = F.col("size") - F.ceil(similarity * F.col("size") - 1e-9) + 1 - (F.col("size") - F.size("m"))
    filed = shared.where(first > 0).select("node", "size", F.explode(F.slice("m", F.lit(1), first.cast("int"))).alias("m"))
    members = cut(filed.select(F.col("m.mark").alias("crowd"), F.col("node").alias("root"), "node", "size"), parts)
    sets = nodes.select("node", F.lit(None).cast("binary").alias("fp"), F.col("few").alias("marks"))
    return _compared(members, sets, similarity, False, parts)


def _distance(a: str, b: str):
    """Differing bits of two 32-byte columns."""
    word = lambda c, k: F.conv(F.hex(F.substring(c, 8 * k + 1, 8)), 16, -10).cast("long")
    return sum((F.bit_count(word(a, k).bitwiseXOR(word(b, k))) for k in range(1, 4)), F.bit_count(word(a, 0).bitwiseXOR(word(b, 0))))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose shingle sets (node, marks) have the Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in slices(batches, rows=1024):
            good = []
            for p, q in zip(_arrays(b.column(2)), _arrays(b.column(3)), strict=True):
                both = len(np.intersect1d(p, q, assume_unique=True))
                good.append(both >= similarity * (len(p) + len(q) - both))
            yield batch(["u", "v"], b.column(0).filter(pa.array(good, pa.bool_())), b.column(1).filter(pa.array(good, pa.bool_())))

    a = sets.select(F.col("node").alias("u"), F.col("marks").alias("a"))
    c = sets.select(F.col("node").alias("v"), F.col("marks").alias("b"))
    return pairs.join(a, "u").join(c, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _sets(rows: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(["node", "marks"], b.column(0), _lists([marks_of(hashed(t, n)) for t in b.column(1).to_pylist()]))

    return arrow_map(rows, ["row", "text"], run, "node long, marks array<long>")


def _near(met: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Of met (u, v), the pairs whose whole fingerprints are near."""
    info = lambda name: nodes.select(F.col("node").alias(name), F.col("fp").alias(f"fp_{name}"), F.col("size").alias(f"size_{name}"))
    both = met.join(info("u"), "u").join(info("v"), "v")
    return both.where((_distance("fp_u", "fp_v") <= NEAR_256) & _fit(F.col("size_u"), F.col("size_v"), similarity)).select("u", "v")


def _rooted(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes with the root of their component (their own number where they have no link)."""
    return nodes.drop("root").join(components(links, each=EDGES), "node", "left").withColumn("root", F.coalesce("root", "node"))


def _links(nodes: DataFrame, texts: DataFrame, n: int, similarity: float, block: int, parts: int) -> DataFrame:
    """(u, v): verified links that connect all nodes (node, fp, size, few) found to be linked."""
    few = cut(_few_links(nodes.where("size > 0 and few is not null"), similarity, parts), parts)
    many = nodes.where(F.col("size") > EXACT).select("node", "size", "fp")
    likely = cut(_near(_candidates(many.withColumn("root", F.col("node")), False, similarity), many, similarity), parts)
    rooted = cut(_rooted(many, likely).select("node", "root", "size", "fp"), parts)
    met = cut(_candidates(rooted, True, similarity, block), parts)
    pairs = cut(_near(met, many, similarity).union(likely), parts)
    thin = met.where("thin").select("u", "v")
    ends = pairs.union(thin)
    wanted = ends.select(F.col("u").alias("row")).union(ends.select("v")).distinct()
    sets = cut(_sets(texts.join(wanted, "row"), n), parts)
    links = few.union(cut(_verified(pairs, sets, similarity), parts))

    of = rooted.select("node", "root")
    end = lambda name: of.select(F.col("node").alias(name), F.col("root").alias(f"root_{name}"))
    marked = cut(thin.join(end("u"), "u").join(end("v"), "v").select(F.col("root_u").alias("u"), F.col("root_v").alias("v")), parts)
    within = rooted.groupBy("root").count().where("count > 1").select("root")
    some = within.union(marked.select("u")).union(marked.select("v")).distinct()
    crowd = components(marked, each=EDGES).select(F.col("node").alias("root"), F.col("root").alias("crowd"))
    crowds = cut(some.join(crowd, "root", "left").select("root", F.coalesce("crowd", "root").alias("crowd")), parts)
    now = components(links, each=EDGES).withColumnRenamed("root", "now")
    members = cut(rooted.join(crowds, "root").join(now, "node", "left").select("crowd", F.coalesce("now", "node").alias("root"), "node", "size"), parts)
    open_ = cut(members.groupBy("crowd").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("crowd"), parts)
    members = cut(members.join(open_, "crowd"), parts)
    prints = sets.join(many.select("node", "fp"), "node").select("node", "fp", "marks")
    return links.union(cut(_compared(members, prints, similarity, True, parts), parts))


def kept(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """docs, all columns, with one document of each group: that of the smallest id (nulls last, then the first row).

    A group is a component of the links between documents whose shingle sets have the similarity; documents of equal
    sets are linked. docs must be a scan or a checkpointed table, for rows are numbered where they are read.

    Defined cases: null and empty texts are equal to each other; a null id is only kept where its group has no other;
    repeated rows are copies; an empty table gives no rows; other columns are passed on, whatever their names.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    texts = numbered.select("row", F.col(f"doc.`{text_col}`").alias("text"))
    prints = _prints(numbered, f"doc.`{id_col}`", f"doc.`{text_col}`", shingle, int(EXACT / similarity + 1e-9), docs.schema[id_col].dataType.simpleString())
    best = F.min(F.struct(F.col("id").isNull().alias("n"), "id", "row")).alias("best")
    nodes = cut(prints.groupBy("digest").agg(best, F.min("row").alias("node"), *[F.first(c).alias(c) for c in ("fp", "size", "few")]))
    parts = max(PARTS, -(-nodes.count() // SHARE))  # not the session's shuffle partitions, which can be many empty ones
    rooted = _rooted(nodes.select("node", "best"), _links(nodes, texts, shingle, similarity, block, parts))
    stay = rooted.groupBy("root").agg(F.min("best").alias("best")).select("best.row")
    return numbered.join(stay, "row", "left_semi").select("doc.*").coalesce(parts)
