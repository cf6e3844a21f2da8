from pyspark.sql import functions as F

from tablewright.llm import queries
from tablewright.llm.language_id import identified, train

WORDS = {"aa": "kala mala tala sala pala", "bb": "krim drim frim stim glim", "cc": "pootz loomz goont boosh noorf"}


def rows():
    return [(k, " ".join(sorted(WORDS[lang].split(), key=lambda w: hash((w, k)))), lang) for k in range(30) for lang in WORDS]


def test_words_of_a_language_are_found(spark, documents):
    model = train(documents(*rows(), (1, None, "aa"), (2, "x", None)))
    found = {r.doc_id: r for r in identified(documents(
        (1, "tala mala"), (2, "GLIM drim!"), (3, "goont 12 pootz"), (4, None), (5, ""), (6, "123 ..."), (7, "zzzzzz"), (None, "kala kala"),
    ), model).collect()}
    assert [found[k].lang_pred for k in (1, 2, 3, 4, 5, 6, None)] == ["aa", "bb", "cc", "und", "und", "und", "aa"]
    assert found[7].lang_pred in WORDS and found[7].score < 0.1
    assert all(0 <= r.score <= 1 for r in found.values())


def test_many_languages_take_more_slices(spark, documents):
    docs = [(k, f"{c * 3}x{c}y " * 5, f"l{k:02}") for k, c in enumerate("abcdefghijklmnopqrst")]
    model = train(documents(*docs))
    assert model.slots.shape[0] == 3
    found = {r.doc_id: r.lang_pred for r in identified(documents(*docs), model).collect()}
    assert found == {k: lang for k, _, lang in docs}


def test_nothing_learned_and_empty_table(spark, documents):
    model = train(documents((1, "a")).where("false"))
    assert [(r.lang_pred, r.score) for r in identified(documents((1, "word"), (1, "word")), model).collect()] == [("und", 0.0)] * 2
    assert identified(documents((1, "word")).where("false"), model).collect() == []


def test_held_out_accuracy(spark, tables):
    found = queries.op1_ngram_language_id(spark, tables)
    truth = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "lang")
    right = found.where("held_out").join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.95 and found.count() == truth.count()
