import hashlib

from pyspark.sql import functions as F

from tablewright.llm import queries
from tablewright.llm.fingerprints import edited_likeness, fingerprints


def test_edited_texts_and_likeness(spark, tables):
    found = {r.doc_id: r for r in queries.op8_imatch_fingerprints(spark, tables).collect()}
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{tables}/documents.parquet").collect())
    prints = {}
    for (doc, text), (_, after) in zip(docs, docs[1:] + docs[:1]):
        row, moved = found[doc], len(text) // 4
        edited = text[: len(text) - moved] + after[:moved]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= row.near_edited <= 1 and 0 <= row.near_next <= 1
        assert prints.setdefault(text, row.fingerprint) == row.fingerprint
    assert len(found) == len(docs)
    mean = lambda name: sum(getattr(r, name) for r in found.values()) / len(found)
    assert mean("near_edited") > 0.25 and mean("near_next") < 0.05


def test_likeness_follows_from_fingerprints(spark, tables):
    rows = sorted(queries.op8_imatch_fingerprints(spark, tables).collect(), key=lambda r: r.doc_id)

    def like(a, b):
        a, b = set(filter(None, a.split(","))), set(filter(None, b.split(",")))
        place = lambda s: {int(x, 16) >> 56 for x in s}
        return 1.0 if a == b else len(a & b) / len(place(a) | place(b))

    for row, after in zip(rows, rows[1:] + rows[:1]):
        assert row.near_edited == like(row.fingerprint, row.edited_fingerprint)
        assert row.near_next == like(row.fingerprint, after.fingerprint)


def test_order_over_ranges(spark, documents):
    texts = {k * 1000 + (k % 3): f"text number {k} of some" for k in range(300)}
    found = {r.doc_id: r.edited for r in edited_likeness(documents(*texts.items())).collect()}
    ids = sorted(texts)
    for doc, after in zip(ids, ids[1:] + ids[:1]):
        moved = len(texts[doc]) // 4
        assert found[doc] == texts[doc][: len(texts[doc]) - moved] + texts[after][:moved]


def test_nulls_short_texts_and_repeats(spark, documents):
    docs = documents((1, None), (2, ""), (3, "abc"), (4, "one two"), (4, "one two"), (None, "null id here"))
    found = edited_likeness(docs).collect()
    assert len(found) == 6
    by_id = {r.doc_id: r for r in found}
    assert by_id[1].edited == "" and by_id[1].near_edited == 1.0
    assert by_id[3].edited == "abc" and by_id[3].near_edited == 1.0
    assert by_id[None].edited == "null id h"
    same = fingerprints(docs).where("row.doc_id = 4").select(F.collect_set("fingerprint")).first()[0]
    assert len(same) == 1
    assert edited_likeness(docs.where("false")).collect() == []
    assert [r.near_next for r in edited_likeness(documents((1, "only one text"))).collect()] == [1.0]
