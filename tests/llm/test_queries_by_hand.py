"""The registered queries op1, op5, op8, op9 and op10, column by column, and the pipeline, over odd rows."""

import array
import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_operators import slow_base
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from sluice.llm import language_id, pii, substrings, toxicity

MORE = [
    "call +61 400 123 456 or mail a.b@c.org, card 4111 1111 1111 1111, host 10.0.0.1",
    "my ssn is 123-45-6789, iban GB82 WEST 1234 5698 7654 32",
    "the part 123-45-6789 is out",
    "İx bad word " * 30,
]


@pytest.fixture(scope="module")
def folder(spark, sf, odd_texts, tmp_path_factory):
    """A data folder: odd texts, some given documents, and extra columns whose names the operators use themselves."""
    path = str(tmp_path_factory.mktemp("odd"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kinds = docs.schema.simpleString().removeprefix("struct<")[:-1]
    odd = [(None if i == 0 else 10_000 + i, t, None, None, None) for i, t in enumerate([*odd_texts, *MORE])]
    odd = spark.createDataFrame([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in odd], kinds)
    both = docs.unionByName(odd)
    for c in ("row", "doc", "spans", "__row", "__doc", "__spans", "label", "text_", "node", "root", "id", "y"):
        both = both.withColumn(c, F.length("text"))
    both.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def texts(spark, folder):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}


def rows_of(spark, folder, name):
    rows = __spark_entry__.queries()[name](spark, folder).collect()
    return rows


def test_op1(spark, folder, texts):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows_of(spark, folder, "op1_packing"):
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for doc, text in texts.items():
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            own = ids[at : at + r.length]
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(array.array("I", own).tobytes()))
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024


def test_op5(spark, folder, texts):
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in rows_of(spark, folder, "op5_sentencepiece")}
    assert set(got) == set(texts)
    for doc, text in texts.items():
        ids = lib.encode(text or "", add_bos=True, add_eos=True)
        want = (len(ids), hashlib.sha256(array.array("I", ids).tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())
        assert (got[doc].n_tokens, got[doc].ids_sha256, got[doc].decoded_sha256) == want


def test_op8(spark, folder, texts):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels.where(~language_id.held_out("doc_id", 5, 0)))
    got = {r.doc_id: r for r in rows_of(spark, folder, "op8_toxicity")}
    t = np.exp(model.step)
    for doc, text in texts.items():
        odds = []
        words = toxicity.words_of(text)
        emit = np.exp([np.clip(float(model.weights[-1]) + sum(float(model.weights[b]) for b in toxicity.buckets(w)), -40, 40) for w in words])
        ahead, back = [], [np.ones(2)]
        for k, e in enumerate(emit):
            now = np.array([1, e]) * (ahead[-1] @ t if k else 1)
            ahead.append(now / now.sum())
        for e in emit[:0:-1]:
            now = t @ (np.array([1, e]) * back[-1])
            back.append(now / now.sum())
        odds = sorted((math.log((a * b)[1] / (a * b)[0]) for a, b in zip(ahead, reversed(back), strict=False)), reverse=True)[:2] if words else []
        tops = [min(30, max(-30, x)) for x in odds] + [-30.0] * (2 - len(odds))
        score = 1 / (1 + math.exp(-(model.document @ [1, *tops])))
        assert got[doc].score == pytest.approx(score, rel=1e-3, abs=1e-6)
        assert got[doc].predicted == int(got[doc].score >= 0.5)
        assert got[doc].held_out == (doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0)


def test_toxic_spans_are_of_the_text():
    text = "İx bad word"
    assert toxicity.spans(text, np.array([0.1, 0.9, 0.1])) == [{"start": 3, "end": 6, "marginal": 0.9}]


def test_sample_is_bounded_by_rows(spark, table_of):
    docs = table_of([(1, f"text {k}") for k in range(50)] + [(2, "other")], "doc_id long, text string")
    labels = table_of([(1, 1), (2, 0), (2, 0)], "doc_id long, toxic int")
    assert sorted((r.text, r.y) for r in toxicity.sample(docs, labels, 4, "doc_id", "text", "toxic").collect()) == [("other", 0), ("text 0", 1)]


def test_op9(spark, folder, texts):
    got = {r.doc_id: r for r in rows_of(spark, folder, "op9_pii")}
    assert set(got) == set(texts)
    for doc, text in texts.items():
        base = slow_base(text) if text else []
        for kind in pii.BASE:
            assert got[doc][f"n_{kind}"] == sum(b[0] == kind for b in base)
        assert got[doc].base_sha256 == hashlib.sha256(",".join("%s:%d:%d" % b for b in base).encode()).hexdigest()
        added = [s[:3] for s in pii.spans(text) if s[0] not in pii.BASE]
        assert got[doc].spans == ",".join("%s:%d:%d" % b for b in [*base, *added])


def test_context_decides_on_added_spans():
    assert [s[0] for s in pii.spans(MORE[1])] == ["iban", "ssn"] and pii.spans(MORE[2]) == []


def test_op10(spark, folder, texts):
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 3 == 1
    n = defaultdict(lambda: np.full(8192, 0.5))
    for r in rows:
        if r.text is not None and r.lang is not None and not out(r.doc_id):
            n[r.lang] += np.bincount(language_id.grams(r.text, 8192), minlength=8192)
    langs = sorted(n)
    got = {r.doc_id: r for r in rows_of(spark, folder, "op10_language")}
    assert set(got) == set(texts)
    for doc, text in texts.items():
        assert got[doc].held_out == out(doc)
        if not text or not any(c.isalpha() for c in text):
            assert (got[doc].lang_pred, got[doc].score) == ("und", 0)
            continue
        own = language_id.grams(text, 8192)
        like = [float(np.log(n[k][own] / n[k].sum()).sum()) / math.sqrt(len(own)) for k in langs]
        assert got[doc].lang_pred == langs[int(np.argmax(like))]
        assert got[doc].score == pytest.approx(1 / sum(math.exp(x - max(like)) for x in like))


def test_language_ties_and_bound(spark, table_of):
    train = table_of([("same words", "b"), ("same words", "a")], "text string, lang string")
    langs, logp = language_id.fit(train)
    docs = table_of([(1, "some words")], "doc_id long, text string")
    assert [(r.lang_pred, r.score) for r in language_id.predict(docs, langs, logp).collect()] == [("a", 0.5)]
    with pytest.raises(ValueError, match="languages"):
        language_id.fit(train, most_langs=1)


def test_stages_over_odd_rows(spark, folder):
    """Every stage passes on clashing columns; the pipeline runs whole, and over an empty table."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, folder)
        assert got.columns == docs.columns, name
        assert all(r["row"] == r["__doc"] == r["y"] for r in got.select("row", "__doc", "y").collect()), name
    cut = {r.doc_id: r.text for r in substrings.without_repeats(docs).collect()}
    assert cut[None] is None and cut[10_001] == ""
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_pipeline_of_an_empty_table(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_bank_numbers_end_at_their_countrys_length():
    found = lambda t: [t[s:e] for s, e in pii.ibans(t)]
    assert found("to BE68 5390 0754 7034 EUR 50") == ["BE68 5390 0754 7034"]
    assert found("NO93 8601 1117 947 AND FR14 2004 1010 0505 0001 3M02 606 OK") == ["NO93 8601 1117 947", "FR14 2004 1010 0505 0001 3M02 606"]
    assert found("BE68 5390 0754 70345 BE68539007547034X xBE68539007547034 BE68 5390 0754 7035") == []
    text = "account BE68 5390 0754 7034 EUR"
    assert pii.masked(text, pii.spans(text)) == "account <iban> EUR"
