import os

import public_tokenizers
import pytest

import corpus_pipeline
from pairloom.llm import bpe, decontaminate, language, secrets
from tests.llm.test_similar import plain_shingles

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


def test_pipeline_equals_its_steps_done_plainly(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = language.fit(docs)
    rows = [r for r in docs.collect()]
    said = {r["doc_id"]: model.predict((r["text"] or "").encode()) for r in rows}
    rows = [r for r in rows if said[r["doc_id"]][0] != "und" and said[r["doc_id"]][1] >= corpus_pipeline.LEAST_SCORE]
    assert len(rows) > 150
    sets = {r["doc_id"]: plain_shingles(r["text"]) for r in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    rows = [r for r in rows if find(r["doc_id"]) == r["doc_id"]]
    left = spark.createDataFrame(rows, docs.schema)
    leaked = {r["doc_id"] for r in decontaminate.find_contamination(left, spark.read.parquet(f"{SF_DIR}/benchmark.parquet")).filter("contaminated").collect()}
    encode = bpe.encoding(corpus_pipeline.RANKS, public_tokenizers.PATTERN).encode_ordinary
    expected = {r["doc_id"]: encode(secrets.mask(r["text"] or "")) for r in rows if r["doc_id"] not in leaked}
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, SF_DIR).collect()}
    assert got == expected and 0 < len(got) < docs.count()


def test_stages_keep_the_columns_of_documents(spark, documents, odd):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, documents([])):
            out = stage(spark, docs, SF_DIR)
            assert out.columns == docs.columns or name == "encoding"
            assert out.count() <= docs.count()
