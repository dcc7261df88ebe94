"""Toxicity by a linear-chain conditional random field over tokens.

Training. Up to `max_docs` labelled documents of each class, the first by a hash of their id, are the training
sample (the only place with a bound; everything scored is whole); of rows that share an id one is taken. Token labels follow from the documents' labels:
a token of a toxic document is toxic if its word or one of its affixes occurs in far more toxic than clean sample
documents (log-likelihood ratio). Windows of tokens around such tokens, and some others, train the field's weights
(word and affix features, hashed) and transitions by stochastic gradient on the conditional likelihood.

Scoring. Every token of a text gets its forward-backward marginal. A document's score is a logistic function,
fitted on the sample, of its two largest marginals' log-odds; tokens with a marginal of a half or more give the
offending spans. A worker keeps each distinct word's potential in a bounded table.

Defined cases: a null or empty text, or one without a word, has the score of a document without toxic tokens and no
spans; with no toxic or no clean document to learn from, every score is the sample's share of toxic ones (0 without
any); null labels teach nothing; of several labels of one id the largest counts, of several rows of one id the first text
teaches; a null id is kept; repeated rows are scored each; very long texts are scored whole; an empty table gives no rows; columns other than those named are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch, cut, held, slices

SCHEMA = "doc_id long, score double, spans array<struct<start:int,end:int,marginal:double>>"
WORD = re.compile(r"\w+")
BITS = 18
NONE = -30.0  # log-odds of a token that is not there
#: Distinct words whose potentials a worker keeps before it starts its table afresh.
TABLE_ROWS = 300_000


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of the toxic tag against the other, by feature bucket; the last is the bias
    step: np.ndarray  # 2 x 2 transition scores
    document: np.ndarray  # bias and weights of the two largest marginals' log-odds
    constant: float | None = None  # the score of all documents where there was nothing to learn from


def features(word: str) -> list[str]:
    """The word itself and its affixes, of a lower-cased word."""
    out = ["w" + word]
    out += [f"p{word[:n]}" for n in (4, 5, 6) if len(word) > n]
    if len(word) > 4:
        out.append("s" + word[-4:])
    return out


def buckets(word: str) -> list[int]:
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for f in features(word)]


def words_of(text: str | None) -> list[str]:
    """Lower-cased words, as many as WORD finds in the text itself."""
    low = (text or "").lower()
    return WORD.findall(low) if len(low) == len(text or "") else [w.lower() for w in WORD.findall(text)]


# ---- training ----


def sample(docs: DataFrame, labels: DataFrame, max_docs: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """text and y (0 or 1) of the training sample: of each class the max_docs first by hash of the id."""
    known = labels.where(F.col(f"`{label_col}`").isin(0, 1) & F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.max(F.col(f"`{label_col}`").cast("int")).alias("y"))
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(max_docs) for y in (0, 1)]
    chosen = picked[0].unionByName(picked[1])
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = texts.where("text is not null").join(F.broadcast(chosen), "id")  # 2 * max_docs ids
    return cut(rows.groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y")).select("text", "y"))


def _feature_counts(rows: DataFrame) -> DataFrame:
    """feature, toxic and clean: in how many sample documents of either class it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names: list[str] = []
            toxic: list[int] = []
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = {f for w in set(words_of(text)) for f in features(w)}
                names += own
                toxic += [y] * len(own)
            yield batch(["feature", "y"], pa.array(names, pa.string()), pa.array(toxic, pa.int32()))

    return arrow_map(rows, ["text", "y"], run, "feature string, y int").groupBy("feature").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))


def telling_features(rows: DataFrame, n_toxic: int, n_clean: int, least: float = 18.0, most: int = 50_000) -> set[str]:
    """Features of toxic documents: by log-likelihood ratio, and with hardly a clean document."""

    def term(k, n):
        return F.when(k > 0, k * F.log(k / n)).otherwise(0.0)

    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    share = (a + b) / (n_toxic + n_clean)
    ratio = 2 * (term(a, share * n_toxic) + term(b, share * n_clean))
    found = _feature_counts(rows).where((a / n_toxic > 20 * b / n_clean) & (a >= 3)).withColumn("g", ratio).where(F.col("g") >= least)
    return {r["feature"] for r in found.orderBy(F.desc("g"), "feature").limit(most).select("feature").collect()}


def _windows(rows: DataFrame, telling: set[str], width: int, most: int) -> list[tuple[list[str], list[bool]]]:
    """Token windows of the sample with token labels: up to `most` around toxic tokens and two others of each document."""
    shared = rows.sparkSession.sparkContext.broadcast(telling)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            tokens, tags = [], []
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = words_of(text)
                toxic = [bool(y) and not known.isdisjoint(features(w)) for w in words]
                places = {k // width for k, t in enumerate(toxic) if t}
                mark = zlib.crc32((text or "").encode("utf-8", "surrogatepass"))
                n = -(-len(words) // width)
                chosen = sorted(places, key=lambda k: zlib.crc32(b"%d" % (k + mark)))[:most] + ([mark % n, (mark >> 8) % n] if n else [])
                for k in sorted(set(chosen)):
                    tokens.append(words[k * width : (k + 1) * width])
                    tags.append(toxic[k * width : (k + 1) * width])
            yield batch(["tokens", "tags"], pa.array(tokens, pa.list_(pa.string())), pa.array(tags, pa.list_(pa.bool_())))

    got = arrow_map(rows, ["text", "y"], run, "tokens array<string>, tags array<boolean>").toArrow()
    return sorted(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True))


def forward_backward(emit: np.ndarray, sizes: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Marginals of tag 1 of sequences in the rows of emit (n x longest: its score against tag 0), each of its own size."""
    n, longest = emit.shape
    t = np.exp(step)
    gain = np.exp(np.clip(emit, -40, 40))
    # odds of tag 1 before and after each position; beyond a sequence's end nothing is added
    ahead = np.ones((longest, n))
    odds = np.ones(n)
    for k in range(longest):
        odds = gain[:, k] * ((t[0, 1] + odds * t[1, 1]) / (t[0, 0] + odds * t[1, 0]) if k else 1.0)
        ahead[k] = odds
    out = np.empty((longest, n))
    back = np.ones(n)
    for k in range(longest - 1, -1, -1):
        back = np.where(k >= sizes - 1, 1.0, back)
        o = ahead[k] * back
        out[k] = o / (1 + o)
        r = gain[:, k] * back
        back = (t[1, 0] + r * t[1, 1]) / (t[0, 0] + r * t[0, 1])
    return out.T


def pair_marginals(emit: np.ndarray, sizes: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of tag 1, and the expected number of each transition over all sequences (2 x 2)."""
    n, longest = emit.shape
    t = np.exp(step)
    gain = np.exp(np.clip(emit, -40, 40))
    alpha = np.empty((longest, n, 2))
    a = np.stack([np.ones(n), gain[:, 0]], axis=1)
    alpha[0] = a / a.sum(axis=1, keepdims=True)
    for k in range(1, longest):
        a = alpha[k - 1] @ t
        a[:, 1] *= gain[:, k]
        alpha[k] = a / a.sum(axis=1, keepdims=True)
    beta = np.ones((n, 2))
    out = np.empty((longest, n))
    moves = np.zeros((2, 2))
    for k in range(longest - 1, -1, -1):
        beta = np.where((k >= sizes - 1)[:, None], 1.0, beta)
        p = alpha[k] * beta
        out[k] = p[:, 1] / p.sum(axis=1)
        b = beta.copy()
        b[:, 1] *= gain[:, k]
        if k:
            m = alpha[k - 1][:, :, None] * t[None] * b[:, None, :]
            inside = k < sizes
            moves += (m[inside] / m[inside].sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        beta = b @ t.T
        beta /= beta.sum(axis=1, keepdims=True)
    return out.T, moves


def fit_field(windows: list[tuple[list[str], list[bool]]], epochs: int = 12, size: int = 2048, rate: float = 0.5, decay: float = 1e-6, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions, by AdaGrad on the conditional log-likelihood."""
    bias = 1 << BITS
    weights, step = np.zeros(bias + 1), np.zeros((2, 2))
    weights[bias] = -4.0
    seen, seen_step = np.full(bias + 1, 1e-4), np.full((2, 2), 1e-2)
    table: dict[str, list[int]] = {}
    longest = max(len(w) for w, _ in windows)
    wide = 6
    ids = np.full((len(windows), longest, wide), bias + 1)
    tags = np.zeros((len(windows), longest), bool)
    sizes = np.array([len(w) for w, _ in windows])
    for k, (words, tag) in enumerate(windows):
        for j, w in enumerate(words):
            if w not in table:
                table[w] = [*buckets(w), bias]
            own = table[w]
            ids[k, j, : len(own)] = own
        tags[k, : len(tag)] = tag
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for lo in range(0, len(order), size):
            at = order[lo : lo + size]
            own, real = ids[at], np.arange(longest) < sizes[at][:, None]
            padded = np.append(weights, 0.0)
            emit = padded[own].sum(axis=2)
            p, moves = pair_marginals(emit, sizes[at], step)
            miss = np.where(real, tags[at] - p, 0.0)
            grad = np.bincount(own.ravel(), np.repeat(miss.ravel(), wide), bias + 2)[: bias + 1] - decay * weights * len(at)
            y = tags[at].astype(int)
            both = real[:, 1:]
            told = np.bincount((2 * y[:, :-1] + y[:, 1:])[both], minlength=4).reshape(2, 2)
            seen += grad * grad
            weights += rate * grad / np.sqrt(seen)
            up = told - moves
            seen_step += up * up
            step += 0.1 * up / np.sqrt(seen_step)
    return weights, step - step[0, 0]


def fit_document(tops: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression of y on the columns of tops, by Newton steps. Classes weigh the same."""
    x = np.column_stack([np.ones(len(tops)), tops])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (y - p)) - ridge * len(y) * w
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * len(y) * np.eye(len(w))
        move = np.linalg.solve(hess, grad)
        w += np.clip(move, -1, 1)
        if np.abs(move).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 4096, width: int = 32, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    rows = sample(docs, labels, max_docs, id_col, text_col, label_col)
    n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    nothing = Model(np.zeros(1), np.zeros((2, 2)), np.zeros(3), n_toxic / max(1, n_toxic + n_clean))
    if not n_toxic or not n_clean:
        return nothing
    telling = telling_features(rows, n_toxic, n_clean)
    windows = [w for w in _windows(rows, telling, width, 4) if w[0]]
    if not windows:
        return nothing
    weights, step = fit_field(windows)
    model = Model(weights.astype(np.float32), step, np.zeros(3))
    got = _tops(rows, model).toArrow()
    tops = np.column_stack([np.asarray(got.column(1)), np.asarray(got.column(2))])
    return Model(model.weights, step, fit_document(tops, np.asarray(got.column(0))))


# ---- scoring ----


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.table = _Potentials(model.weights)

    def marginals(self, docs: list[list[str]]) -> list[np.ndarray]:
        """Marginal of the toxic tag of every word of every document."""
        if len(self.table) > TABLE_ROWS:
            self.table.clear()
        look = self.table.__getitem__
        emit = [np.fromiter(map(look, words), np.float64, len(words)) for words in docs]
        out: list[np.ndarray] = [np.empty(0)] * len(docs)
        order = sorted((k for k, e in enumerate(emit) if len(e)), key=lambda k: len(emit[k]))
        while order:  # the longest first; each block's matrix holds about 2**19 numbers
            n = max(1, min(len(order), (1 << 19) // len(emit[order[-1]])))
            at, order = order[-n:], order[:-n]
            sizes = np.array([len(emit[k]) for k in at])
            block = np.zeros((n, sizes[-1]))
            block[np.arange(sizes[-1]) < sizes[:, None]] = np.concatenate([emit[k] for k in at])
            p = forward_backward(block, sizes, self.model.step)
            for row, k, size in zip(p, at, sizes.tolist(), strict=True):
                out[k] = row[:size]
        return out

    def tops(self, marginals: list[np.ndarray]) -> np.ndarray:
        """Log-odds of the two largest marginals of each document."""
        out = np.full((len(marginals), 2), NONE)
        for k, p in enumerate(marginals):
            if len(p):
                best = p if len(p) < 2 else np.partition(p, len(p) - 2)[-2:][::-1]
                out[k, : len(best)] = best
        real = out > NONE
        out[real] = np.clip(np.log(np.maximum(out[real], 1e-13)) - np.log1p(-np.minimum(out[real], 1 - 1e-13)), NONE, -NONE)
        return out


class _Potentials(dict):
    def __init__(self, weights: np.ndarray):
        self.w = weights
        self.bias = float(weights[-1])

    def __missing__(self, word: str) -> float:
        value = self.bias + float(sum(self.w.item(b) for b in buckets(word)))
        if len(word) <= 40:
            self[word] = value
        return value


def _scorer(shared) -> Scorer:
    """One scorer per worker and model, so that its table of words lasts over tasks."""
    return held(("toxic", shared.id), lambda: Scorer(shared.value))


class _Shared:
    """A broadcast with an id that workers can tell it by."""

    def __init__(self, spark, model: Model):
        self.cast = spark.sparkContext.broadcast(model)
        self.id = zlib.crc32(model.weights.tobytes()) ^ zlib.crc32(model.step.tobytes() + model.document.tobytes())

    @property
    def value(self) -> Model:
        return self.cast.value


def _tops(rows: DataFrame, model: Model) -> DataFrame:
    shared = _Shared(rows.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for b in batches:
            tops = scorer.tops(scorer.marginals([words_of(t) for t in b.column(0).to_pylist()]))
            yield batch(["y", "a", "b"], b.column(1), tops[:, 0], tops[:, 1])

    return arrow_map(rows, ["text", "y"], run, "y int, a double, b double")


def spans(text: str, marginals: np.ndarray) -> list[dict]:
    """Runs of neighbouring words with a marginal of a half or more: code points, ends exclusive, and the largest marginal."""
    out: list[dict] = []
    last = -2
    for k, (m, p) in enumerate(zip(WORD.finditer(text), marginals.tolist(), strict=True)):
        if p >= 0.5:
            if last == k - 1:
                out[-1]["end"], out[-1]["marginal"] = m.end(), max(p, out[-1]["marginal"])
            else:
                out.append({"start": m.start(), "end": m.end(), "marginal": p})
            last = k
    return out


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and the offending spans of every document."""
    shared = _Shared(docs.sparkSession, model)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer = None if m.constant is not None else _scorer(shared)
        for b in batches:
            texts = b.column(1).to_pylist()
            if scorer is None:
                scores, found = np.full(len(texts), m.constant), [[] for _ in texts]
            else:
                marginals = scorer.marginals([words_of(t) for t in texts])
                z = np.column_stack([np.ones(len(texts)), scorer.tops(marginals)]) @ m.document
                scores = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                found = [spans(t, p) if len(p) and p.max() >= 0.5 else [] for t, p in zip(texts, marginals, strict=True)]
            yield batch(["doc_id", "score", "spans"], b.column(0).cast(pa.int64()), scores, pa.array(found, span))

    return arrow_map(docs, [id_col, text_col], run, SCHEMA)


def clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs, all columns, without the documents whose score is the threshold or more.

    Null and empty texts score as texts without toxic tokens; repeated rows are judged each; very long texts whole; an
    empty table gives no rows; with nothing to learn from all documents stay; other columns are passed on.
    """
    shared = _Shared(docs.sparkSession, model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        if m.constant is not None:  # nothing to learn from: nothing is rejected
            yield from batches
            return
        scorer = _scorer(shared)
        for b in slices(batches):
            tops = scorer.tops(scorer.marginals([words_of(t) for t in b.column(at).to_pylist()]))
            z = m.document[0] + tops @ m.document[1:]
            yield b.filter(pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))) < threshold))

    return docs.mapInArrow(run, docs.schema)
