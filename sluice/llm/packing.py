"""Order-preserving packing of documents into fixed token windows by dynamic programming.

The documents of an input partition form one token stream, in order, each document closed by `end_id`.
Cut candidates are document ends, sentence ends and, inside longer stretches without either, every `stride`
tokens. The cost of a sequence is its padding and a penalty by the kind of cut at its end. With
g(i) = f(i) + pos(i) the best start for the padded transition is the minimum of g over a sliding window, which a
monotone queue holds, so a stream is packed in linear time. A run of full sequences, cut wherever they are full,
is one more transition. The short rest at a stream's end is split into powers of two, which need no padding.

No shuffle: a sequence never spans input partitions, so a lost task is repeated alone.

Defined cases: a null or empty text is a document of the end id alone; a null id stays null; repeated rows are
separate documents; an empty table gives no rows; columns other than the two named are not read.
"""

from __future__ import annotations

import array
import base64
import re
import sys
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import arrow_map, batch, held

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, sequence_length long, ids binary"
#: Distinct chunks a worker keeps before it starts its table afresh, and the longest chunk it keeps.
TABLE_ROWS, TABLE_CHARS = 500_000, 48
#: The pre-tokeniser's pattern of byte-level BPE vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteBpe:
    """Token ids of a byte-level BPE vocabulary, equal to those of the `tokenizers` library, as little-endian uint32 bytes.

    A text is split at spaces. Each distinct space-led chunk is encoded once and then looked up. A chunk whose
    tokens could depend on its neighbours (runs of white space across the split) sends the text to the library.
    """

    def __init__(self, json_path: str, ranks_path: str | None):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.core = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.core = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.led = _Chunks(self, " ")
        self.first = _Chunks(self, "")

    def whole(self, text: str) -> bytes:
        return array.array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, text: str) -> bytes:
        if self.core is None or (not text.isascii() and max(text) >= "Ԁ"):
            return self.whole(text)
        return array.array("I", self.core.encode_ordinary(text)).tobytes()

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.whole(text)
        head, *rest = text.split(" ")
        if len(self.led) > TABLE_ROWS:
            self.led.clear()
        if len(self.first) > TABLE_ROWS // 4:
            self.first.clear()
        try:
            return self.first[head] + b"".join(map(self.led.__getitem__, rest))
        except TypeError:  # a None: this text has a chunk that can't be encoded alone
            return self.whole(text) if len(text) < 200_000 else self.by_space(text)

    def by_space(self, text: str) -> bytes:
        """Like whole(), for long texts: in parts that end where no token can cross, after a letter and before a space."""
        out, at = [], 0
        for m in re.finditer(r"(?<=[a-z]) (?=[a-z])", text):
            if m.start() - at >= 50_000:
                out.append(self.whole(text[at : m.start()]))
                at = m.start()
        return b"".join([*out, self.whole(text[at:])])


class _Chunks(dict):
    def __init__(self, bpe: ByteBpe, lead: str):
        self.bpe, self.lead = bpe, lead

    def __missing__(self, key: str) -> bytes | None:
        if self.lead and (not key or key[0].isspace()):
            value = None
        else:
            value = self.bpe.piece(self.lead + key)
        if len(key) <= TABLE_CHARS:
            self[key] = value
        return value


def tokenizer(json_path: str, ranks_path: str | None) -> ByteBpe:
    return held(("bpe", json_path, ranks_path), lambda: ByteBpe(json_path, ranks_path))


def sentence_ends(bpe: ByteBpe) -> np.ndarray:
    """For each id whether its string ends a sentence: with . ! ? or a line break."""
    n = bpe.library.get_vocab_size()
    flags = np.zeros(n, bool)
    for piece, i in bpe.library.get_vocab().items():
        flags[i] = piece[-1:] in ".!?Ċ"  # the last is the vocabulary's sign for a line break
    return flags


def windows(pos: np.ndarray, penalty: np.ndarray, size: int, hard: int) -> np.ndarray:
    """Positions at which the cheapest sequences end. pos: cut candidates, ascending, the first the start; gaps never exceed size.

    Besides the padded transition there is a chain of full windows, `hard` for each cut inside it: it leads from
    the cheapest earlier candidate of the same residue, which a table by residue holds.
    """
    p, pen, n = pos.tolist(), penalty.tolist(), len(pos)
    back = [0] * n
    base = p[0]
    queue: deque[tuple[int, int, int]] = deque([(base, 0, base)])  # (cost + position, index, position), the first ascending
    chain = [1 << 60] * size
    chain_from = [0] * size
    chain[0] = 0
    for j in range(1, n):
        at = p[j]
        while queue[0][2] < at - size:
            queue.popleft()
        best, start, _ = queue[0]
        best += size - at
        laps, r = divmod(at - base, size)
        full = chain[r] + hard * (laps - 1)
        if full < best:
            best, start = full, chain_from[r]
        best += pen[j]
        back[j] = start
        if best - hard * laps < chain[r]:
            chain[r], chain_from[r] = best - hard * laps, j
        g = best + at
        while queue and queue[-1][0] >= g:
            queue.pop()
        queue.append((g, j, at))
    cuts, j = [], n - 1
    while j > 0:
        i = back[j]
        cuts.extend(range(p[j], p[i], -size))
        j = i
    return np.array(cuts[::-1], np.int64)


def candidates(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, stride: int, sentence: int, hard: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions with the penalty of each: 0 after a document, `sentence` after a sentence, `hard` elsewhere."""
    inner = np.flatnonzero(ends[ids]) + 1
    cuts = np.unique(np.concatenate([[0], inner, doc_ends]))
    gaps = np.flatnonzero(np.diff(cuts) > stride)
    filled = [np.arange(cuts[k] + stride, cuts[k + 1], stride) for k in gaps]
    forced = np.concatenate(filled) if filled else np.empty(0, np.int64)
    pos = np.concatenate([cuts, forced])
    penalty = np.concatenate([np.full(len(cuts), sentence), np.full(len(forced), hard)])
    order = np.argsort(pos, kind="stable")
    pos, penalty = pos[order], penalty[order]
    penalty[np.isin(pos, doc_ends, assume_unique=True)] = 0
    return pos, penalty


def pack_stream(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, size: int, stride: int, sentence: int, hard: int) -> np.ndarray:
    """Sequence ends (positions in ids) of one stream."""
    pos, penalty = candidates(ids, doc_ends, ends, stride, sentence, hard)
    cuts = windows(pos, penalty, size, hard)
    start = cuts[-2] if len(cuts) > 1 else 0
    rest, tail = int(cuts[-1] - start), []
    if rest < size and rest & (rest - 1):
        at = start
        for k in range(rest.bit_length() - 1, -1, -1):
            if rest >> k & 1:
                at += 1 << k
                tail.append(at)
        cuts = np.concatenate([cuts[:-1], tail])
    return cuts.astype(np.int64)


def pack(docs: DataFrame, json_path: str, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, end_id: int = 0, stride: int = 64, sentence: int = 1, hard: int = 8, stream_tokens: int = 2_000_000) -> DataFrame:
    """One row per piece of a document: where the piece starts in it, its sequence and place there, and its ids (uint32, little-endian).

    stream_tokens bounds a task's memory: a stream is packed and emitted when it has so many tokens (a longer
    document makes one stream). ranks_path names the same vocabulary in rank form, which encodes faster.
    """
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "sequence_length", "ids"]
    closing = array.array("I", [end_id]).tobytes()

    def emit(keys: list, blobs: list[bytes], ends: np.ndarray, first: int) -> tuple[pa.RecordBatch, int]:
        blob = b"".join(blobs)
        ids = np.frombuffer(blob, "<u4")
        lengths = np.array([len(b) // 4 for b in blobs], np.int64)
        doc_ends = np.cumsum(lengths)
        cuts = pack_stream(ids, doc_ends, ends, size, stride, sentence, hard)
        stops = np.unique(np.concatenate([cuts, doc_ends]))
        starts = np.concatenate([[0], stops[:-1]])
        doc = np.searchsorted(doc_ends, starts, side="right")
        seq = np.searchsorted(cuts, starts, side="right")
        seq_starts = np.concatenate([[0], cuts[:-1]])
        pieces = pa.array([blob[4 * a : 4 * b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)], pa.binary())
        out = batch(names, pa.array([keys[d] for d in doc.tolist()], pa.int64()), starts - (doc_ends - lengths)[doc], stops - starts, lengths[doc], first + seq, starts - seq_starts[seq], (cuts - seq_starts)[seq], pieces)
        return out, first + len(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assert sys.byteorder == "little"
        bpe = tokenizer(json_path, ranks_path)
        ends = sentence_ends(bpe)
        sequence = TaskContext.get().partitionId() << 36
        keys, blobs, held = [], [], 0
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                blob = (bpe.encode(text) if text else b"") + closing
                keys.append(key)
                blobs.append(blob)
                held += len(blob) // 4
                if held >= stream_tokens:
                    out, sequence = emit(keys, blobs, ends, sequence)
                    yield out
                    keys, blobs, held = [], [], 0
        if keys:
            yield emit(keys, blobs, ends, sequence)[0]

    return arrow_map(docs, [id_col, text_col], run, SCHEMA)
