"""SentencePiece encoding and decoding through a table of distinct marked words.

When no piece of the vocabulary holds a white-space marker after another character, a merge never crosses the
start of a marked word, so each distinct marked word is segmented once per worker and its ids are joined back by
position. The table is bounded and is started afresh when full; a model without that property, or one that
normalises its input or knows user-defined symbols, is run on whole texts instead.

No shuffle: each partition is encoded alone.

Defined cases: a null or empty text has the begin and end ids only and decodes to the empty text; a null id stays
null; repeated rows are encoded each; an empty table gives no rows; columns other than the two named are not read.
"""

from __future__ import annotations

import array
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, batch, held

SCHEMA = "doc_id long, ids binary, decoded string"
MARK = "▁"
#: Distinct words, and characters of theirs, that a worker keeps before it starts its table afresh.
TABLE_ROWS, TABLE_CHARS = 600_000, 24 << 20


class Codec:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        self.library = SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.library.serialized_model_proto())
        spec, pieces = proto.normalizer_spec, proto.pieces
        plain = spec.name == "identity" and not spec.precompiled_charsmap and not spec.remove_extra_whitespaces and spec.add_dummy_prefix
        user, byte = 4, 6  # types of pieces: matched in the text before anything else; one byte of a rare character
        self.by_word = plain and proto.trainer_spec.model_type == 2 and proto.trainer_spec.byte_fallback and not any(MARK in p.piece.lstrip(MARK) or p.type == user for p in pieces)
        self.plain_from = max((i for i, p in enumerate(pieces) if p.type == byte), default=0) + 1
        self.ends = (array.array("I", [self.library.bos_id()]).tobytes(), array.array("I", [self.library.eos_id()]).tobytes())
        self.table: dict[str, bytes] = {}
        self.odd: dict[str, str] = {}  # words that decode to something else
        self.chars = 0

    def learn(self, words: set[str]) -> None:
        new = list(words.difference(self.table))
        for word, ids in zip(new, self.library.encode(new, num_threads=1) if new else [], strict=True):
            self.table[word] = array.array("I", ids).tobytes()
            self.chars += len(word)
            if ids and min(ids) < self.plain_from and (back := self.library.decode(ids)) != word:
                self.odd[word] = back

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """Of each text the ids with begin and end ids, as little-endian uint32, and their decoded text."""
        if len(self.table) > TABLE_ROWS or self.chars > TABLE_CHARS:
            self.table, self.odd, self.chars = {}, {}, 0
        words = [t.split(" ") if t and self.separable(t) else None for t in texts]
        self.learn(set(chain.from_iterable(filter(None, words))))
        begin, end = self.ends
        out = []
        for text, own in zip(texts, words, strict=True):
            if own is None:
                ids = self.library.encode(text or "", add_bos=True, add_eos=True)
                out.append((array.array("I", ids).tobytes(), self.library.decode(ids)))
            else:
                back = " ".join([self.odd.get(w, w) for w in own]) if self.odd else text
                out.append((begin + b"".join(map(self.table.__getitem__, own)) + end, back))
        return out

    def separable(self, text: str) -> bool:
        """Whether the text's spaces are where its marked words start, one space a word."""
        return self.by_word and not ("  " in text or text[0] == " " or text[-1] == " " or MARK in text or "\0" in text)


def codec(path: str) -> Codec:
    return held(("pieces", path), lambda: Codec(path))


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (uint32, little-endian, with begin and end ids) and the text that decode(ids) gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for b in batches:
            done = c.encode(b.column(1).to_pylist())
            yield batch(["doc_id", "ids", "decoded"], b.column(0).cast(pa.int64()), pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string()))

    return arrow_map(docs, [id_col, text_col], run, SCHEMA)
