from pyspark.sql import functions as F

from tablewright.llm.secret_scan import KINDS, listed, masked, scanned


def spans(docs):
    return {r.row.doc_id: r.said for r in scanned(docs).withColumn("said", listed(F.col("spans"))).collect()}


def test_agrees_with_sql(spark, agrees):
    agrees(spark, "op9_entropy_secrets")


def test_base_kinds(spark, documents):
    key, sha = "AKIA" + "Z7" * 8, "0123456789abcdef01234567"
    found = spans(documents(
        (1, "é Password : 'hunter22' x"), (2, key), (3, f"ü{sha}"), (4, "token=abc"), (5, None), (6, ""),
        (7, "password: token: abcdef"), (8, f"api_key={sha}"), (9, "AKIA123 " + sha[:23]),
    ))
    assert found[1] == "assign:2:22"
    assert found[2] == "access:0:20"
    assert found[3] == "hex:1:25"
    assert found[4] == found[5] == found[6] == found[7] == ""
    assert found[9] == "entropy:8:31"
    assert found[8] == "assign:0:32,hex:8:32"


def test_entropy_adds_and_allows(spark, documents):
    strong = "q7Kx9ZbT2mWv4LsR8dNf"
    found = spans(documents(
        (1, f"see {strong} there"), (2, "01234567-89ab-4def-8123-456789abcdef"), (3, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1"),
        (4, "internationalization_of_everything"), (5, "12345678901234567890123"), (6, strong + "EXAMPLE"),
        (7, "1" * 40 + strong + "1" * 40),
    ))
    assert found[1] == "entropy:4:24" and KINDS[3] == "entropy"
    assert [found[k] for k in (2, 4, 5, 6)] == [""] * 4 and found[3] == "hex:0:31"
    before, dense, after = sorted(found[7].split(","), key=lambda s: int(s.split(":")[1]))
    kind, start, end = dense.split(":")
    assert (before, after) == ("hex:0:40", "hex:59:100")
    assert kind == "entropy" and int(start) <= 40 and int(end) >= 60 and int(end) - int(start) < 100


def test_masked(spark, documents):
    docs = documents((1, "a token=abcdef1 b"), (2, None), (3, "plain"), (1, "a token=abcdef1 b"))
    found = masked(docs, count_col="n_chars")
    assert found.columns == docs.columns
    texts = sorted(((r.doc_id, r.text, r.n_chars) for r in found.collect()), key=repr)
    assert texts == [(1, "a [SECRET] b", 12), (1, "a [SECRET] b", 12), (2, None, 0), (3, "plain", 5)]


def test_long_text_and_empty_table(spark, documents):
    text = "word " * 50_000 + "token=abcdef1"
    assert spans(documents((1, text))) == {1: "assign:250000:250013"}
    assert scanned(documents((1, text)).where("false")).collect() == []
