import os
import random
import tracemalloc

import pyarrow as pa
import pytest

from tablewright.llm.common import sliced
from tablewright.llm.sentencepiece_scan import MODEL, _encode, _pieces, decoded, encoded

sentencepiece = pytest.importorskip("sentencepiece")
pytestmark = pytest.mark.skipif(not os.path.exists(MODEL), reason="no vocabulary")
SIGNS = ["a", "b", "e", "t", "h", "n", "o", " ", "  ", "é", "ñ", "\n", "0", "1", "=", "漢", "😀", "\t", ".", "the", "ing", "AB"]


def texts(seed, count):
    draw = random.Random(seed)
    found = ["".join(draw.choices(SIGNS, k=draw.randint(1, 400))) for _ in range(count)]
    return found + [t.replace(" ", "") for t in found[:20]] + [" " * 90 + t + " " * 70 for t in found[:10]] + ["x" * 3000]


@pytest.mark.parametrize("chunk", [40, 100])
def test_scan_equals_the_library(spark, documents, chunk):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    all_texts = texts(chunk, 80)
    rows = [*enumerate(all_texts), (900, None), (901, ""), (902, all_texts[0]), (902, all_texts[0]), (None, all_texts[1])]
    found = encoded(documents(*rows), giant_chars=50, chunk_chars=chunk).collect()
    expected = [(doc, library.encode(text or "")) for doc, text in rows]
    assert sorted(((r.doc_id, r.ids) for r in found), key=repr) == sorted(expected, key=repr)
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in found)


def test_round_trip_over_a_table(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    found = decoded(encoded(docs, giant_chars=4000, chunk_chars=1000))
    back = {r.doc_id: r.text for r in found.collect()}
    assert back == {r.doc_id: r.text for r in docs.collect()}


def test_space_sign_and_empty_table(spark, documents):
    row = encoded(documents((1, "a▁b"))).first()
    assert not row.round_trip and row.ids
    assert encoded(documents((1, "a")).where("false")).collect() == []


def test_a_worker_holds_the_ids_of_a_slice_not_of_a_batch():
    """One batch of 8 MB: as Python lists its ids alone take over 60 MB, those of a slice some 20."""
    with open(MODEL, "rb") as file:
        pieces = _pieces(file.read())
    text = "It was the best of times, it was the worst of times. " * 40
    batch = pa.record_batch([pa.array(range(4000)), pa.array([text] * 4000)], ["id", "text"])
    tracemalloc.start()
    try:
        rows = sum(found.num_rows for found in _encode(pieces, iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 4000
    assert peak < 40_000_000


def test_slices_hold_every_row_once_and_in_order():
    batch = pa.record_batch([pa.array(range(6)), pa.array(["aaaa", None, "bb", "c" * 50, "", "ää"])], ["id", "text"])
    parts = list(sliced(iter([batch, batch.slice(0, 0)]), 1, 6))
    assert [p.column(0).to_pylist() for p in parts] == [[0, 1, 2], [3], [4, 5]]
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
