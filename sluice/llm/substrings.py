"""Removal of repeated byte strings: suffixes sampled by content, named and counted.

A byte is removed if a string of `length` bytes that also starts anywhere else covers it. As in a
difference-cover sort only a sample of positions is named, and every other position is reached from a sampled one; but
nothing is sorted: samples are grouped by the hashes of their bytes, and equal windows are found by counting.
The sample is taken by content instead of by residue: the sample position of a start s is where the window of
`length` bytes at s has its least `gram`-byte hash. Equal windows therefore have their sample at the same offset,
so two starts are only ever compared through their samples, and about one position in 80 is grouped instead of two in three.

1. Every document gives its samples: the hash of the gram there, the starts that lead to it (an interval, since the
   sample never moves back), and the hash of the context that those starts' windows span.
2. Grams that occur once anywhere are dropped. The other samples are grouped by gram, offsets and context, with
   map-side partial aggregation: of a kind that occurs twice or more all windows are repeated, and of a gram with
   several kinds one sample of each goes on. No task holds a gram's or a kind's samples.
3. Those contexts are fetched; windows are compared start by start. A gram of over `heavy` such contexts has its
   windows counted by aggregation over all machines instead, so no task holds it.
4. Each document's covered intervals are merged and cut out.

Names are 64-bit hashes of the bytes; two different strings are taken for equal only if gram hash and context hash
(or window hash) agree together.

`docs` must be a scan or a checkpointed table, for rows are numbered where they are read.

Defined cases: a null or empty text has no bytes, nothing is removed and the rest is empty; a text shorter than
`length` stays whole; a null id stays null; rows are documents each, so repeated rows remove each other; an empty
table gives no rows; columns other than the two named are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch, cut, release, slices

BASE = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses modulo 2**64
PART = 1 << 19  # starts of a document that are sampled at once
SHIFT = 20  # low bits of a sort key that hold a position within a part

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n or more powers of BASE and of its inverse, modulo 2**64."""
    size = max(1 << 14, 1 << (n - 1).bit_length())
    if size not in _POWERS:
        steps = np.full((2, size), [[BASE], [pow(BASE, -1, 1 << 64)]], np.uint64)
        steps[:, 0] = 1
        _POWERS[size] = tuple(np.cumprod(steps, axis=1))
    return _POWERS[size]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all strings of gram bytes of data (uint8), modulo 2**64, mixed."""
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * up[: len(data)], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every `width` neighbours, by doubling."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def samples(data: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gram hash, position, and first and last start that lead to each sample."""
    out: list[tuple[np.ndarray, ...]] = []
    for lo in range(0, max(0, len(data) - length + 1), PART):
        part = np.frombuffer(data, np.uint8, min(PART + length - 1, len(data) - lo), lo).astype(np.uint64)
        h = gram_hashes(part, gram)
        key = (h & ~np.uint64((1 << SHIFT) - 1)) | np.arange(len(h), dtype=np.uint64)  # of equal hashes the first is least
        where = (_sliding_least(key, length - gram + 1) & np.uint64((1 << SHIFT) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        last = np.concatenate([first[1:], [len(where)]]) - 1
        at = where[first]
        out.append((h[at], at + lo, first + lo, last + lo))
    if not out:
        return (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _pack(at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Position of a sample and its offsets from its last and its first start, in one long (offsets below 1024)."""
    return (at << 20) | ((at - last) << 10) | (at - first)


def _sampled(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """gram, context, doc, packed of every sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            out: list[tuple[np.ndarray, ...]] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass") if text else b""
                if len(data) >= length:
                    h, at, first, last = samples(data, length, gram)
                    context = np.array([digest(data[x : y + length]) for x, y in zip(first.tolist(), last.tolist(), strict=True)], np.uint64)
                    out.append((h.view(np.int64), context.view(np.int64), np.full(len(h), doc), _pack(at, first, last)))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 4
            yield batch(["gram", "context", "doc", "packed"], *columns)

    return arrow_map(rows, ["doc", "text"], run, "gram long, context long, doc long, packed long")


def _grams(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """gram of every sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            out = [samples(data, length, gram)[0] for data in (t.encode("utf-8", "surrogatepass") for t in b.column(0).to_pylist() if t) if len(data) >= length]
            yield batch(["gram"], np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64))

    return arrow_map(rows, ["text"], run, "gram long")


def _judged(rows: DataFrame, length: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """Samples (doc, packed) all of whose windows are repeated, and those that go on (gram, doc, packed, state: 2 where the former too)."""
    again = cut(_grams(rows, length, gram).groupBy("gram").count().where("count > 1").select("gram"))  # shuffled anew, so that the join's hot grams can be split
    kind = ["gram", "context", "offsets"]
    found = cut(_sampled(rows, length, gram).join(again, "gram", "left_semi").withColumn("offsets", F.col("packed").bitwiseAND(F.lit(0xFFFFF))))
    kinds = cut(found.groupBy(*kind).agg(F.count("*").alias("n"), F.min(F.struct("doc", "packed")).alias("lead")))
    whole = found.join(kinds.where("n > 1").select(*kind), kind, "left_semi").select("doc", "packed")
    several = kinds.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1").select("gram")
    on = kinds.join(several, "gram", "left_semi").select("gram", "lead.doc", "lead.packed", F.when(F.col("n") > 1, 2).otherwise(0).alias("state"))
    return whole, cut(on)


def _contexts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """wanted (gram, doc, packed, state) with the bytes that the sample's windows span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, rows=512):
            out: list[tuple] = []
            for doc, text, marks in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for m in marks:
                    at, least, most = m["packed"] >> 20, (m["packed"] >> 10) & 1023, m["packed"] & 1023
                    out.append((m["gram"], doc, m["packed"], m["state"], data[at - most : at - least + length]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield batch(["gram", "doc", "packed", "state", "bytes"], *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)])

    marks = wanted.groupBy("doc").agg(F.collect_list(F.struct("gram", "packed", "state")).alias("marks"))
    joined = docs.join(marks, "doc").select("doc", "doc_id", "text", "marks")
    return joined.mapInArrow(run, "gram long, doc long, packed long, state int, bytes binary")


def repeated(rows: list[tuple[int, int, bytes]], length: int) -> list[tuple[int, int] | None]:
    """Of each (least offset, greatest offset, context) the least and the greatest offset whose window another has at the same offset."""
    digest = xxhash.xxh3_128_digest
    found: list[tuple[int, int] | None] = [None] * len(rows)
    for offset in range(min(r[0] for r in rows), max(r[1] for r in rows) + 1):
        own = [(k, digest(c[most - offset : most - offset + length])) for k, (least, most, c) in enumerate(rows) if least <= offset <= most]
        n = Counter(d for _, d in own)
        for k, d in own:
            if n[d] > 1:
                found[k] = (found[k][0] if found[k] else offset, offset)
    return found


def _compared(contexts: DataFrame, length: int) -> DataFrame:
    """doc, lo, hi: the bytes that the repeated windows of a sample cover, grams being light."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        out: list[tuple[int, int, int]] = []

        def close() -> None:
            if len(group) > 1:
                rows = [((p >> 10) & 1023, p & 1023, data) for _, _, p, _, data in group]
                for (_, doc, p, state, _), r in zip(group, repeated(rows, length), strict=True):
                    if r and state == 0:
                        out.append((doc, (p >> 20) - r[1], (p >> 20) - r[0] + length))
            group.clear()

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * 3
            out.clear()
            return batch(["doc", "lo", "hi"], *[pa.array(c, pa.int64()) for c in columns])

        for b in slices(batches, rows=4096):
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if group and group[0][0] != row[0]:
                    close()
                group.append(row)
            yield flush()
        close()
        yield flush()

    return contexts.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, "doc long, lo long, hi long")


def _counted(contexts: DataFrame, length: int) -> DataFrame:
    """As _compared, for grams of very many contexts: windows are counted across machines, none of which holds a gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_intdigest
        for b in slices(batches, rows=256):
            out: list[tuple[int, int, int, int, int, int, int]] = []
            for gram, doc, p, state, data in zip(*[c.to_pylist() for c in b.columns], strict=True):
                least, most = (p >> 10) & 1023, p & 1023
                for offset in range(least, most + 1):
                    d = digest(data[most - offset : most - offset + length])
                    out.append((gram, offset, (d & (1 << 63) - 1), d >> 65, doc, p >> 20, state))
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            yield batch(["gram", "offset", "a", "b", "doc", "at", "state"], *[pa.array(c, pa.int64()) for c in columns])

    windows = contexts.mapInArrow(run, "gram long, offset long, a long, b long, doc long, at long, state long")
    window = ["gram", "offset", "a", "b"]
    many = windows.groupBy(*window).count().where("count > 1").select(*window)
    hits = windows.where("state = 0").join(many, window, "left_semi")
    return hits.groupBy("gram", "doc", "at").agg((F.col("at") - F.max("offset")).alias("lo"), (F.col("at") - F.min("offset") + length).alias("hi")).select("doc", "lo", "hi")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the intervals' union, ascending."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _spans(docs: DataFrame, length: int, gram: int, heavy: int, id_col: str | None, text_col: str) -> tuple[DataFrame, DataFrame]:
    """docs as rows (doc, doc_id, text), and of each doc with repeats its covered intervals, packed."""
    if not 0 < gram < length < 1024:
        raise ValueError("0 < gram < length < 1024")
    rows = docs.select(F.monotonically_increasing_id().alias("doc"), (F.col(f"`{id_col}`") if id_col else F.lit(None)).cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    whole, some = _judged(rows, length, gram)
    at, least, most = F.shiftright("packed", 20), F.shiftright("packed", 10).bitwiseAND(F.lit(1023)), F.col("packed").bitwiseAND(F.lit(1023))
    covers = whole.select("doc", (at - most).alias("lo"), (at - least + length).alias("hi"))
    big = cut(some.groupBy("gram").count().where(F.col("count") > heavy).select("gram"))
    if big.isEmpty():
        covers = covers.unionByName(_compared(_contexts(rows, some, length), length))
    else:
        contexts = _contexts(rows, some, length)
        covers = covers.unionByName(_compared(contexts.join(big, "gram", "left_anti"), length))
        covers = covers.unionByName(_counted(contexts.join(big, "gram", "left_semi").select("gram", "doc", "packed", "state", "bytes"), length))
    spans = covers.groupBy("doc").agg(F.collect_list(F.shiftleft("lo", 32) + F.col("hi")).alias("spans"))
    return rows, spans


def cut_out(data: bytes, marks: list[int] | None) -> tuple[list[tuple[int, int]], bytes]:
    """The removed runs and the kept bytes."""
    own = merged([(m >> 32, m & 0xFFFFFFFF) for m in marks or []])
    starts = [0, *[hi for _, hi in own]]
    stops = [*[lo for lo, _ in own], len(data)]
    return own, b"".join([data[x:y] for x, y in zip(starts, stops, strict=True)])


def without_repeats(docs: DataFrame, length: int = 200, gram: int = 40, heavy: int = 5000, text_col: str = "text") -> DataFrame:
    """docs, all columns, with the repeats cut out of the text and n_chars (where there is one) renewed.

    Bytes that remain of a character cut apart are dropped; a null text stays null, an empty one empty; repeated rows
    remove each other; an empty table gives no rows; other columns are passed on, whatever their names.
    """
    _, spans = _spans(docs, length, gram, heavy, None, text_col)
    names = docs.columns
    at = names.index(text_col)
    whole = docs.select(F.monotonically_increasing_id().alias("doc"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    joined = whole.join(spans, "doc", "left").select(*[F.col(f"row.`{c}`").alias(f"c{k}") for k, c in enumerate(names)], "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, rows=512):
            new = []
            for text, marks in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
                new.append(text if not marks else cut_out(text.encode("utf-8", "surrogatepass"), marks)[1].decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if k == at else b.column(k) for k in range(len(names))], names=names)

    out = joined.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length(f"`{text_col}`").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def remove(docs: DataFrame, length: int = 200, gram: int = 40, heavy: int = 5000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, the removed runs (lo, hi; byte offsets, ends exclusive) and the kept bytes of every document."""
    rows, spans = _spans(docs, length, gram, heavy, id_col, text_col)
    joined = rows.join(spans, "doc", "left").select("doc", "doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        for b in slices(batches, rows=512):
            sizes, runs, kept = [], [], []
            for text, marks in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass") if text else b""
                own, rest = cut_out(data, marks)
                sizes.append(len(data))
                runs.append([{"lo": lo, "hi": hi} for lo, hi in own])
                kept.append(rest)
            yield batch(["doc_id", "n_bytes", "removed", "kept"], b.column(1).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(runs, span), pa.array(kept, pa.binary()))

    return joined.mapInArrow(run, "doc_id long, n_bytes long, removed array<struct<lo:long,hi:long>>, kept binary")
