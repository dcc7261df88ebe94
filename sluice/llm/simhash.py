"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint has a bit set where over half of its shingles' XXH64 hashes have it. Documents of equal
fingerprint form a class, found by aggregation; all later work is on distinct fingerprints. Two fingerprints at
distance 3 or less have a 32-bit half at distance 1 or less, so each is filed under both its halves and under each
half with one set bit cleared: of two halves that differ in one bit, one has it set. Fingerprints that meet in a
bucket are verified on all 64 bits.

A bucket gives a spanning forest of its links, not its pairs: a breadth-first search over the bucket's distinct
fingerprints. Buckets of over `heavy` fingerprints are filed again by the 16-bit quarters of the other half in the
same way, which bounds a bucket by its free bits whatever the number of rows. Components then come from the
star-contraction of components.py.

Defined cases: a null or empty text has fingerprint 0, which links like any other; a null id is kept and gives its
component no smaller id (a component of null ids alone has a null id); repeated rows share a class; an empty table
gives no rows; columns other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch, cut, release
from .components import components

BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
LANES = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: str | None, shingle: int, seed: int = 42) -> int:
    """As an unsigned 64-bit number. Only A-Z are lower-cased; words end at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    counts = np.zeros((8, 256), np.int64)
    for at in range(0, len(hashes), 1 << 18):
        lanes = hashes[at : at + (1 << 18)].view(np.uint8).reshape(-1, 8) + LANES
        counts += np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256)
    over = (counts @ BITS).ravel() * 2 > len(hashes)
    return int.from_bytes(np.packbits(over, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its fingerprint as a (signed) long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            found = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64)
            yield batch(["doc_id", "fp"], b.column(0).cast(pa.int64()), found.view(np.int64))

    return arrow_map(docs, [id_col, text_col], run, "doc_id long, fp long")


def _ball(value: Column, bits: int) -> Column:
    """The value and the value with each of its set bits cleared."""
    one = F.lit(1).cast("long")
    masks = F.array(*[F.lit(1 << b).cast("long") for b in range(bits)])
    cleared = F.transform(F.filter(masks, lambda m: value.bitwiseAND(m) != F.lit(0).cast("long")), lambda m: value.bitwiseXOR(m))
    return F.concat(F.array(value * one), cleared)


def _file(fps: DataFrame) -> DataFrame:
    """fp, key: of both halves, the half's number and its value or a neighbour of it."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    keyed = F.concat(_ball(low, 32), F.transform(_ball(high, 32), lambda v: v + F.lit(1 << 32)))
    return fps.select("fp", F.explode(keyed).alias("key"))


def _file_again(rows: DataFrame) -> DataFrame:
    """fp, key, quarter: of the half that the key leaves free, both quarters and their neighbours."""
    free = F.when(F.col("key") < F.lit(1 << 32), F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    low, high = free.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(free, 16)
    keyed = F.concat(_ball(low, 16), F.transform(_ball(high, 16), lambda v: v + F.lit(1 << 16)))
    return rows.select("fp", "key", F.explode(keyed).alias("quarter"))


def forest(values: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the links (radius or fewer differing bits) among distinct uint64 values."""
    left, right, rest = [], [], values
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                found = rest[near]
                left += [int(x)] * len(found)
                right += found.tolist()
                queue.extend(found)
                rest = rest[~near]
    return left, right


def _links(rows: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Spanning links (u, v) of every bucket of rows (fp and the bucket's keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 1 + len(keys)), np.int64)

        def edges(block: np.ndarray) -> pa.RecordBatch:
            left: list[int] = []
            right: list[int] = []
            if len(block):
                new = np.flatnonzero((block[1:, 1:] != block[:-1, 1:]).any(axis=1)) + 1
                bounds = np.concatenate([[0], new, [len(block)]])
                for k in np.flatnonzero(np.diff(bounds) > 1):
                    a, b = forest(np.unique(block[bounds[k] : bounds[k + 1], 0].view(np.uint64)), radius)
                    left += a
                    right += b
            return batch(["u", "v"], np.array(left, np.uint64).view(np.int64), np.array(right, np.uint64).view(np.int64))

        for b in batches:
            block = np.ascontiguousarray(np.concatenate([held, np.stack([c.to_numpy() for c in b.columns], axis=1)]))
            if not len(block):
                continue
            same = (block[:, 1:] == block[-1, 1:]).all(axis=1)
            last = len(block) - int(same[::-1].argmin()) if not same.all() else 0
            held = block[last:]
            yield edges(np.ascontiguousarray(block[:last]))
        yield edges(np.ascontiguousarray(held))

    spread = rows.select("fp", *keys).repartition(*keys).sortWithinPartitions(*keys)
    return spread.mapInArrow(run, "u long, v long")


def links(fps: DataFrame, radius: int = 3, heavy: int = 4096) -> DataFrame:
    """(u, v): links among distinct fingerprints that connect all that are linked."""
    if not 0 <= radius <= 3:
        raise ValueError("two halves find distances up to 3")
    filed = _file(fps)
    # a bucket gets at most its own fingerprints and those of 32 neighbours; big ones come from big halves
    halves = fps.select(F.explode(F.array(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32) + F.lit(1 << 32))).alias("half"))
    big = cut(halves.groupBy("half").count().where(F.col("count") > heavy).select("half"))
    if big.isEmpty():
        return _links(filed, ["key"], radius)
    number, value = F.shiftrightunsigned("half", 32), F.col("half").bitwiseAND(F.lit(0xFFFFFFFF))
    around = cut(big.select(F.explode(F.transform(_ball(value, 32), lambda v: v + F.shiftleft(number, 32))).alias("key")).distinct())
    light = filed.join(around, "key", "left_anti")
    again = _file_again(filed.join(around, "key", "left_semi").select("fp", "key"))
    return _links(light, ["key"], radius).unionByName(_links(again, ["key", "quarter"], radius))


def groups(prints: DataFrame, radius: int = 3, heavy: int = 4096) -> DataFrame:
    """doc_id, fp and component_id (smallest id that links reach) of every row of prints (doc_id, fp)."""
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(classes.select("fp"), radius, heavy))
    rooted = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 5, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    prints = cut(fingerprints(docs, shingle, id_col, text_col))
    return groups(prints, radius).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
