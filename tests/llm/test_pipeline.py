import pytest

import corpus_pipeline
from tablewright.llm import mixing, near_dedup, quality, secret_scan
from tablewright.llm.sentencepiece_scan import MODEL

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def stages(spark, tables):
    docs, found = spark.read.parquet(f"{tables}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        found.append((docs, docs := stage(spark, docs, tables).cache()))
    return found


def test_stages_return_documents(stages):
    assert all(after.columns == COLUMNS for _, after in stages[:-1])
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "secrets", "mix", "tokens"]


def test_each_stage_takes_effect(spark, stages):
    (docs, good), (_, unique), (_, clean), (_, mix), _ = stages
    verdict = {r.row.doc_id for r in quality.judged(docs).where("kept").collect()}
    assert {r.doc_id for r in good.collect()} == verdict and 0 < len(verdict) < docs.count()
    groups = near_dedup.near_duplicates(good, width=5).where("kept")
    assert {r.doc_id for r in unique.collect()} == {r.doc_id for r in groups.collect()}
    assert clean.count() == unique.count()
    assert secret_scan.scanned(clean).where("exists(spans, s -> s.kind < 3)").count() == 0
    turns = mixing.schedule(clean).where("2 * taken >= size")
    assert rows(mix.select("doc_id")) == rows(turns.select("row.doc_id"))


def test_tokens_equal_the_library(stages):
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=MODEL)
    mix, tokens = stages[-1]
    expected = sorted((r.doc_id, library.encode(r.text)) for r in mix.collect())
    assert sorted((r.doc_id, r.ids) for r in tokens.collect()) == expected


def test_empty_and_odd_documents(spark, documents):
    odd = documents((None, None, None, None), (1, "", None, "s"), (1, "", None, "s"))
    for docs in (odd, odd.where("false")):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "")
        assert docs.count() == 0
