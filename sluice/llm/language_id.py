"""Language identification by multinomial naive Bayes over hashed character n-grams.

Training counts (language, bucket) pairs over all training rows with map-side partial sums; the model is a matrix
of log probabilities of `buckets` rows and one column per language, so its size depends on neither rows nor texts.
Scoring turns a text into its buckets with counts (a sparse row), and sums the matrix's rows of those buckets, each times
its count, for a batch of texts at once in numpy.

Defined cases: a null text or one without a letter gets `und` with score 0; rows with null text or null language
train nothing; with nothing to learn from, every text gets `und`; a null id stays null; repeated rows count each
and are scored each; of equally likely languages the first by name is given; an empty table gives no rows; columns other
than those named are not read. Over `most_langs` languages are an error, for the model would grow with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch, cut

SCHEMA = "doc_id long, lang_pred string, score double"
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def grams(text: str, buckets: int) -> np.ndarray:
    """Buckets of the lower-cased text's 1-, 2- and 3-grams of code points; buckets is a power of two."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    mask = np.uint32(buckets - 1)
    one = c * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (one[1:] >> np.uint32(7))) * np.uint32(0x85EBCA6B)
    three = (two[:-1] ^ (one[2:] >> np.uint32(3))) * np.uint32(0xC2B2AE35)
    return np.concatenate([(h >> np.uint32(11)) & mask for h in (one, two, three)])


def histogram(text: str, buckets: int) -> np.ndarray:
    out = np.zeros(buckets, np.int64)
    for at in range(0, len(text), 1 << 20):  # a long text in parts that overlap by the two characters a gram needs
        part = text[max(0, at - 2) : at + (1 << 20)]
        out += np.bincount(grams(part, buckets), minlength=buckets)
        if at:
            out -= np.bincount(grams(part[:2], buckets), minlength=buckets)
    return out


def count(train: DataFrame, text_col: str = "text", lang_col: str = "lang", buckets: int = 8192) -> DataFrame:
    """(lang, bucket, n) over all training rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if lang not in sums:
                    sums[lang] = np.zeros(buckets, np.int64)
                sums[lang] += histogram(text, buckets)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield batch(["lang", "bucket", "n"], pa.array([lang] * len(at), pa.string()), at.astype(np.int32), n[at])

    rows = train.where(F.col(f"`{text_col}`").isNotNull() & F.col(f"`{lang_col}`").isNotNull())
    part = arrow_map(rows, [text_col, lang_col], run, "lang string, bucket int, n long")
    return part.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", buckets: int = 8192, smoothing: float = 0.5, most_langs: int = 1024) -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and the matrix of log probabilities (buckets x languages). Languages are taken as equally likely beforehand."""
    counts = cut(count(train, text_col, lang_col, buckets))
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().limit(most_langs + 1).collect())
    if len(langs) > most_langs:
        raise ValueError(f"over {most_langs} languages")
    got = counts.toArrow()  # at most buckets rows of each language
    n = np.full((buckets, len(langs)), smoothing)
    n[np.asarray(got.column("bucket")), np.searchsorted(langs, got.column("lang").to_pylist())] += np.asarray(got.column("n"))
    return langs, np.log(n / n.sum(axis=0)) if langs else n


def sparse(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' buckets, their counts, and where each text's begin."""
    ids, counts = [], []
    for t in texts:
        n = histogram(t, buckets)
        at = np.flatnonzero(n)
        ids.append(at)
        counts.append(n[at])
    starts = np.cumsum([0, *[len(x) for x in ids[:-1]]])
    return np.concatenate(ids), np.concatenate(counts), starts


def likelihoods(texts: list[str], matrix: np.ndarray) -> np.ndarray:
    """Log-likelihoods (texts x languages) over the root of each text's grams; every text has a gram."""
    ids, counts, starts = sparse(texts, len(matrix))
    return np.add.reduceat(matrix[ids] * counts[:, None], starts, axis=0) / np.sqrt(np.add.reduceat(counts, starts))[:, None]


def predict(docs: DataFrame, langs: list[str], logp: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the likeliest language and its share of the likelihood per root of the text's grams, 0 to 1."""
    model = docs.sparkSession.sparkContext.broadcast((langs, logp))  # buckets x most_langs numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = model.value
        for b in batches:
            texts = b.column(1).to_pylist()
            preds, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            real = [i for i, t in enumerate(texts) if t and names and has_letter(t)]
            for lo in range(0, len(real), 64):
                part = real[lo : lo + 64]
                like = likelihoods([texts[i] for i in part], matrix)
                best = like.argmax(axis=1)
                share = 1 / np.exp(like - like.max(axis=1, keepdims=True)).sum(axis=1)
                for i, k, s in zip(part, best.tolist(), share.tolist(), strict=True):
                    preds[i], scores[i] = names[k], s
            yield batch(["doc_id", "lang_pred", "score"], b.column(0).cast(pa.int64()), pa.array(preds, pa.string()), scores)

    return arrow_map(docs, [id_col, text_col], run, SCHEMA)


def held_out(id_col: str, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))
