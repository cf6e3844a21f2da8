import hashlib

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from tablewright.llm.common import new_folder
from tablewright.llm.warc import Bundle, archived, parse_record, read_records, record_id, write_bundles


@pytest.fixture
def pages(spark):
    big = "<p>é" + "x" * 1200
    rows = [(1, "http://a", big), (7, "http://b", big), (5, None, big), (2, "http://c", "small"), (3, "http://d", "small"),
            (4, "http://e", None), (None, "http://f", big), (8, "u", "<p>" + "y" * 50_000), (9, "u", "<p>other\r\n\r\n" + "z" * 2000)]
    return spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, digest string")


def test_agrees_with_sql(spark, agrees):
    agrees(spark, "op4_seekable_warc")


def test_round_trip(spark, pages):
    found = {r.page_id: r for r in archived(pages).collect()}
    given = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    assert set(found) == set(given)
    for page, row in found.items():
        assert (row.payload_bytes, row.payload_digest) == (len(given[page]), hashlib.sha1(given[page]).hexdigest())
        assert row.payload == (b"" if row.record_type == "revisit" else given[page])
    assert {p: r.refers_to for p, r in found.items() if r.record_type == "revisit"} == {1: 7, 5: 7}


def test_one_record_costs_one_frame(spark, pages):
    folder = new_folder(spark, "warc-test")
    index = write_bundles(pages, folder, frame_bytes=3000, bundle_bytes=2000)
    wanted = hashlib.sha1(b"small").hexdigest()
    row = index.where(F.col("record_id") == record_id(2, wanted)).first()
    assert [(r.page_id, r.payload) for r in read_records(index.where(F.col("record_id") == row.record_id), folder).collect()] == [(2, b"small")]
    files, path = fs.FileSystem.from_uri(folder if "://" in folder else folder.removeprefix("file:"))
    bundle = Bundle(files, f"{path}/{row.bundle}")
    fields, payload = parse_record(bundle.frame(row.frame)[row.offset : row.offset + row.length])
    assert payload == b"small" and fields["WARC-Type"] == "response"
    assert index.select("bundle").distinct().count() > 1


def test_repeated_rows_and_empty_table(spark, pages):
    twice = archived(pages.unionByName(pages)).collect()
    assert len(twice) == 18 and sum(r.record_type == "revisit" for r in twice) == 4
    assert archived(pages.where("false")).collect() == []
