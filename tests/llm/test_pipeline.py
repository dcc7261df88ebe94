"""The pipeline's stages against brute force over a small table, and the registered queries over real rows."""

import public_tokenizers
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from sluice.llm import packing, pii, simhash_wide
from test_operators import check_pieces, slow_removal


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, sf)
    assert clean.columns == columns
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    left = {r.doc_id for r in clean.collect()}
    harmless = [d for d, t in labels.items() if t == 0]
    assert sum(d in left for d in harmless) >= 0.97 * len(harmless)

    one = stages["simhash"](spark, docs, sf)
    rows = docs.collect()
    sets = {r.doc_id: frozenset(simhash_wide.shingles(r.text, 5)) for r in rows}
    ids = sorted(sets)
    par = {i: i for i in ids}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                par[y] = x
    assert one.columns == columns and {r.doc_id for r in one.collect()} == {find(i) for i in ids}

    cut = {r.doc_id: r for r in stages["substrings"](spark, docs, sf).collect()}
    for r, w in zip(rows, slow_removal([(r.text or "").encode() for r in rows]), strict=True):
        assert cut[r.doc_id].text == w[3].decode("utf-8", "ignore") and cut[r.doc_id].n_chars == len(cut[r.doc_id].text)

    plain = {r.doc_id: r.text for r in stages["pii"](spark, docs, sf).collect()}
    assert plain == {r.doc_id: pii.masked(r.text, pii.spans(r.text)) for r in rows}

    bpe = packing.ByteBpe(public_tokenizers.path("byte_bpe_50k.json"), None)
    want = {r.doc_id: [*memoryview(bpe.whole(r.text)).cast("I"), 0] for r in rows}
    check_pieces(stages["packing"](spark, docs, sf).collect(), want)


def test_queries_run(spark, sf):
    queries = __spark_entry__.queries()
    mine = [k for k in queries if k.startswith("op") or k == "pipeline"]
    assert len(mine) == 14  # thirteen operators and the pipeline
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert queries["op2_simhash"](spark, sf).count() == n
    assert queries["op6_substrings"](spark, sf).agg(F.sum("n_bytes")).first()[0] > 0
    assert queries["op8_toxicity"](spark, sf).where("score between 0 and 1").count() == n
    assert queries["op10_language"](spark, sf).where("lang_pred <> 'und'").count() > 0.9 * n
    assert queries["pipeline"](spark, sf).count() > 0


def test_queries_against_sql(spark, sf):
    from compare import assert_same, connect

    from sluice.llm.queries import SQL

    con = connect(sf)
    for name, sql in SQL.items():
        assert_same(__spark_entry__.queries()[name](spark, sf), con, sql)
