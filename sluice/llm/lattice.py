"""Embedding near-duplicates by lattice hashing.

Unit vectors are projected at random to 8 dimensions, scaled, and decoded to the nearest point of the E8 lattice, in
several tables. A vector is filed under its own cell and under the `probes` neighbouring cells that lie nearest, so
vectors on either side of a cell's border meet. Vectors that meet in a cell are verified by cosine in double
precision; a pair that meets in several cells counts in the first one only.

Vectors of one label and direction (by a 128-bit digest of the unit vector) are merged beforehand and carried with their number. Only vectors that share a label are
filed together. A cell of over `block` vectors is split into blocks, and each pair of blocks is one piece of work,
so no task holds a whole cell. Cells are met by ids and keys alone; vectors are joined, in their own precision, to the
pieces of work of cells with two or more. A cell gives link counts per vector and a spanning forest of its links, not its pairs.

Defined cases: a vector that is null, zero or has a null or non-finite component, or a null label, links with
nothing and is its own component; a null id is kept, counts as a partner and gives its component no smaller id (a
component of null ids alone has a null id and is not kept); repeated rows link with each other; vectors of unequal
length do not link; an empty table gives no rows; columns other than the three named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch, cut, slices
from .components import components


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or all entries +-1/2 with an even number of minus signs."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (1, -1):
                for b in (1, -1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for signs in range(256):
        bits = (signs >> np.arange(8)) & 1
        if bits.sum() % 2 == 0:
            out.append(0.5 - bits)
    return np.array(out)


ROOTS = roots()


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: where the sum is odd, the entry rounded furthest goes the other way."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(axis=1).astype(np.int64) & 1)
    worst = np.abs(off[odd]).argmax(axis=1)
    near[odd, worst] += np.where(off[odd, worst] < 0, -1.0, 1.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8 to the rows of x (n x 8)."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    nearer = ((x - b) ** 2).sum(axis=1) < ((x - a) ** 2).sum(axis=1)
    return np.where(nearer[:, None], b, a)


def cells(x: np.ndarray, probes: int) -> np.ndarray:
    """Doubled lattice points (n x (1 + probes) x 8): the own cell, then its nearest neighbours."""
    own = decode(x)
    toward = np.argsort(-((x - own) @ ROOTS.T), axis=1, kind="stable")[:, :probes]
    near = own[:, None, :] + ROOTS[toward]
    return np.rint(2 * np.concatenate([own[:, None, :], near], axis=1)).astype(np.int64)


def projections(width: int, tables: int, seed: int) -> np.ndarray:
    """tables x width x 8, with orthonormal columns where the width allows."""
    rng = np.random.default_rng([seed, width])
    out = []
    for _ in range(tables):
        m = rng.standard_normal((width, 8))
        out.append(np.linalg.qr(m)[0] if width >= 8 else m / np.sqrt(width))
    return np.array(out)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def keys(unit: np.ndarray, labels: np.ndarray, tables: int, probes: int, cell: float, seed: int) -> np.ndarray:
    """Cell keys of unit vectors of one width: n x tables x (1 + probes), 64-bit hashes of label, table and cell."""
    out = np.empty((len(unit), tables, 1 + probes), np.uint64)
    for t, p in enumerate(projections(unit.shape[1], tables, seed)):
        h = np.broadcast_to(_mix(labels.view(np.uint64) + np.uint64(t + 1))[:, None], (len(unit), 1 + probes)).copy()
        points = cells(unit @ p / cell, probes).view(np.uint64)
        for d in range(8):
            h = _mix(h ^ points[:, :, d] + np.uint64(0x9E3779B97F4A7C15))
        out[:, t] = h
    return out.view(np.int64)


def normalised(rows: list) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None for those that link with nothing."""
    out: list[np.ndarray | None] = []
    for r in rows:
        v = None if r is None or any(x is None for x in r) else np.asarray(r, np.float64)
        top = np.abs(v).max(initial=0.0) if v is not None else 0.0
        if v is None or not np.isfinite(top) or top == 0 or np.isnan(v).any():
            out.append(None)
        else:
            v = v / top
            out.append(v / np.sqrt(v @ v) + 0.0)
    return out


def _units(vectors: DataFrame, id_col: str, label_col: str, vec_col: str) -> DataFrame:
    """vec_id, label (as hash; null: links with nothing), a digest of the unit vector, and the vector as bytes of its own precision."""
    kind = vectors.schema[vec_col].dataType.elementType.simpleString()
    number = np.float32 if kind == "float" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(2).to_pylist()
            units = normalised(rows)
            digests = [None if u is None else xxhash.xxh3_128_digest(u.tobytes()) for u in units]
            blobs = [None if u is None else np.asarray(r, number).tobytes() for u, r in zip(units, rows, strict=True)]
            yield batch(["vec_id", "label", "digest", "vec"], b.column(0).cast(pa.int64()), b.column(1).cast(pa.int64()), pa.array(digests, pa.binary()), pa.array(blobs, pa.binary()))

    hashed = vectors.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.when(F.col(f"`{label_col}`").isNotNull(), F.xxhash64(F.col(f"`{label_col}`").cast("string"))).alias("l"), F.col(f"`{vec_col}`").alias("v"))
    return arrow_map(hashed, ["i", "l", "v"], run, "vec_id long, label long, digest binary, vec binary")


def unit_rows(blobs: list[bytes], number: type) -> np.ndarray:
    """Unit vectors of one width in double precision."""
    v = np.frombuffer(b"".join(blobs), number).reshape(len(blobs), -1).astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _filed(nodes: DataFrame, number: type, tables: int, probes: int, cell: float, seed: int) -> DataFrame:
    """node, copies, least, label, digest, vec and its cell keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            blobs = b.column(5).to_pylist()
            labels = b.column(3).to_numpy()
            out: list = [None] * len(blobs)
            for width in {len(x) for x in blobs}:
                at = [i for i, x in enumerate(blobs) if len(x) == width]
                for i, k in zip(at, keys(unit_rows([blobs[i] for i in at], number), labels[at], tables, probes, cell, seed), strict=True):
                    out[i] = k.ravel().tolist()
            yield batch(["node", "copies", "least", "label", "digest", "vec", "keys"], *b.columns, pa.array(out, pa.list_(pa.int64())))

    return nodes.select("node", "copies", "least", "label", "digest", "vec").mapInArrow(run, "node long, copies long, least long, label long, digest binary, vec binary, keys array<long>")


def pairs(unit: np.ndarray, key: np.ndarray, least: float, here: int, table: int, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs between rows `first` and rows `second` whose first meeting place is this cell of this table.

    key: n x tables up to this one x (1 + probes), cell keys, as `here`. Where first and second are one block, each pair comes once.
    """
    left, right = [], []
    one = first is second
    for lo in range(0, len(first), 256):
        i, j = np.nonzero(unit[first[lo : lo + 256]] @ unit[second].T >= least)
        i = first[lo + i]
        j = second[j]
        if one:
            i, j = i[i < j], j[i < j]
        a, b = key[i], key[j]
        common = (a[:, :, :, None] == b[:, :, None, :]).any(axis=3)
        earlier = common[:, :table].any(axis=(1, 2))
        lowest = np.where(common[:, table], a[:, table], np.iinfo(key.dtype).max).min(axis=1)
        at = ~earlier & (lowest == here)
        left.append(i[at])
        right.append(j[at])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64), np.empty(0, np.int64))


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest row of each row's component under the pairs (i, j)."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _verify(work: DataFrame, number: type, least: float, probes: int) -> DataFrame:
    """node, links (copies of the partners met here) and the smallest node it was joined to, from rows sorted by piece of work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple[np.ndarray, ...]] = []

        def close() -> None:
            if len(held) > 1:
                table, here, x, y = held[0][:4]
                node = np.array([r[5] for r in held])
                widths = {len(r[7]) for r in held}
                for width in widths:
                    at = np.array([k for k, r in enumerate(held) if len(r[7]) == width])
                    unit = unit_rows([held[k][7] for k in at], number)
                    key = np.array([held[k][8] for k in at], np.int64).reshape(len(at), table + 1, 1 + probes)
                    copies = np.array([held[k][6] for k in at])
                    mine = np.array([held[k][4] for k in at])
                    first = np.flatnonzero(mine == x)
                    second = first if x == y else np.flatnonzero(mine == y)
                    i, j = pairs(unit, key, least, here, table, first, second)
                    if len(i):
                        n = np.bincount(i, copies[j], len(at)) + np.bincount(j, copies[i], len(at))
                        low = spanning(len(at), i, j)
                        some = np.flatnonzero(n)
                        out.append((node[at[some]], n[some].astype(np.int64), node[at[low[some]]]))
            held.clear()

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3
            out.clear()
            return batch(["node", "n", "other"], *columns)

        for b in slices(batches, rows=4096):
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if held and held[0][:4] != row[:4]:
                    close()
                held.append(row)
            yield flush()
        close()
        yield flush()

    place = ["place", "key", "x", "y"]
    spread = work.select(*place, "mine", "node", "copies", "vec", "keys").repartition(*place).sortWithinPartitions(*place)
    return spread.mapInArrow(run, "node long, n long, other long")


def near_duplicates(vectors: DataFrame, least: float = 0.98, tables: int = 8, probes: int = 2, cell: float = 0.1, seed: int = 8, block: int = 2048, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row. cell is the lattice's scale on the unit sphere's projection."""
    number = np.float32 if vectors.schema[vec_col].dataType.elementType.simpleString() == "float" else np.float64
    units = _units(vectors, id_col, label_col, vec_col).withColumn("links", F.col("label").isNotNull() & F.col("vec").isNotNull())
    nodes = units.where("links").groupBy("label", "digest").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("vec").alias("vec"))
    filed = cut(_filed(nodes.withColumn("node", F.monotonically_increasing_id()), number, tables, probes, cell, seed))
    places = filed.select("node", F.posexplode("keys").alias("at", "key")).select("node", "key", F.floor(F.col("at") / (1 + probes)).cast("int").alias("place"))
    full = cut(places.groupBy("place", "key").count().where("count > 1").select("place", "key", F.ceil(F.col("count") / block).cast("int").alias("blocks")))
    met = places.join(full, ["place", "key"]).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("place", "key", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "node")
    work = met.join(filed.select("node", "copies", "vec", "keys"), "node").withColumn("keys", F.slice("keys", 1, (F.col("place") + 1) * (1 + probes)))  # of the tables up to this one
    found = cut(_verify(work, number, least, probes))
    roots_of = components(found.select(F.col("node").alias("u"), F.col("other").alias("v")))
    counted = found.groupBy("node").agg(F.sum("n").alias("n"))
    rooted = filed.select("node", "label", "digest", "least", "copies").join(counted, "node", "left").join(roots_of, "node", "left")
    rooted = cut(rooted.select("label", "digest", "least", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root")))
    named = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    classes = cut(rooted.join(named, "root").select("label", "digest", "n_links", "component_id"))
    out = units.select("vec_id", "links", "label", "digest").join(classes, ["label", "digest"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.when(F.col("links"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
