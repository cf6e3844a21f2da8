import hashlib
import math
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tablewright.llm import queries
from tablewright.llm.sanitising import KINDS, entities, found_spans, listed, sanitised

#: The contract's patterns as they are written there.
PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base(text):
    found = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = "".join(c for c in m.group() if c in "0123456789")
            if (kind == 1 and max(map(int, m.group().split("."))) > 255 or kind == 2 and not (14 <= len(digits) <= 19 and luhn(digits))
                    or kind == 3 and not 10 <= len(digits) <= 15):
                continue
            found.append((m.start(), kind, m.end()))
    return sorted(found)


def brute(texts):
    """All spans of each text, by plain counting over the list."""
    texts = [t or "" for t in texts]
    lower = ["".join(c.lower() if c.isascii() else c for c in t) for t in texts]
    with_term, with_entity, both, differing, near = defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(set), []
    for d, (text, low) in enumerate(zip(texts, lower, strict=True)):
        spans = base(text)
        terms = [(m.start(), m.end(), m.group()) for m in re.finditer(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]{3,}", low)]
        for t in terms:
            with_term[t[2]].add(d)
        free = [t for t in terms if not any(s < t[1] and t[0] < e for s, _, e in spans)]
        for s, kind, e in spans:
            value = low[s:e] if kind < 2 else "".join(c for c in low[s:e] if c in "0123456789")
            beside = [t for t in free if t[1] <= s][-8:] + [t for t in free if t[0] >= e][:8]
            for t in beside:
                with_entity[kind, value].add(d)
                both[(kind, value), t[2]].add(d)
                differing[(kind, value), t[2]].add(text)
                near.append((d, (kind, value), t))
    telling = set()
    for (e, t), docs in both.items():
        told = math.log2(len(docs) * len(texts) / (len(with_term[t]) * len(with_entity[e])))
        if len(differing[e, t]) >= 3 and told >= 5 and told >= 0.9 * math.log2(len(texts) / len(with_entity[e])):
            telling.add((e, t))
    found = [set(base(t)) for t in texts]
    for d, e, (start, end, t) in near:
        if (e, t) in telling:
            found[d].add((start, 4, end))
    return [",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(f)) for f in found]


def spans(docs, **options):
    return {r.row.doc_id: r.said for r in found_spans(docs, **options).withColumn("said", listed(F.col("spans"))).collect()}


def corpus():
    """400 documents; one person's address stands near a name in several of them."""
    rng = random.Random(7)
    words = [f"word{k}" for k in range(60)]
    texts = [" ".join(rng.choices(words, k=40)) + f" n{k}." for k in range(400)]
    for k in range(5):
        texts[k] = " ".join(rng.choices(words, k=12)) + " Zaphod Übermann 4711 <zaphod.b@mail.example.org> " + " ".join(rng.choices(words, k=12))
    for k in range(5, 9):
        texts[k] = texts[4]
    texts[9] = "Copied once Quux a@b.cc " + texts[9]
    texts[10] = texts[11] = texts[9]
    texts[12], texts[13] = None, ""
    return texts


def test_entities_equal_the_patterns():
    rng = random.Random(3)
    pieces = ["a@b.c", "@", ".", "x_y@", "1.2.3.4", "256", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "-", " ", "+1 (555) 010-9999", "+", "9", "é", "_q@z.zz", "..", "007"]
    for _ in range(3000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 9)))
        assert entities(text) == base(text), text


def test_equals_plain_counting(spark, documents):
    texts = corpus()
    found = spans(documents(*enumerate(texts)))
    expected = brute(texts)
    assert [found[k] for k in range(len(texts))] == expected
    assert sum("term" in e for e in expected[:9]) == 9
    assert not any("term" in e for e in expected[9:])


def test_sanitised(spark, documents):
    texts = corpus()
    docs = documents(*enumerate(texts))
    found = sanitised(docs)
    assert found.columns == docs.columns
    rows = {r.doc_id: r.text for r in found.collect()}
    assert " [TERM] [TERM] 4000 <[EMAIL]> " in rows[0] and rows[12] is None and rows[13] == "" and rows[50] == texts[50]
    assert rows[9].startswith("Copied once Quux [EMAIL] ")


def test_very_long_texts_and_empty_table(spark, documents):
    hard = ["a" * 400_000, "1" * 400_000, "+1" * 100_000, "1." * 200_000, "a@" * 100_000, "+1" + " " * 300_000, "x" * 300_000 + " a@b.cc " + "y" * 300_000]
    found = spans(documents(*enumerate(hard), (None, "a@b.cc"), (None, "a@b.cc")))
    assert found[0] == "" and found[6] == "email:300001:300007" and found[None] == "email:0:6"
    assert found_spans(documents((1, "a@b.cc")).where("false")).collect() == []


def test_query_over_the_table(spark, tables):
    rows = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    expected = brute([r.text for r in rows])
    got = {r.doc_id: r for r in queries.QUERIES["op12_disclosure_sanitising"](spark, tables).collect()}
    assert len(got) == len(rows)
    for r, said in zip(rows, expected, strict=True):
        assert got[r.doc_id].spans == said
        plain = ",".join(s for s in said.split(",") if s and not s.startswith("term"))
        assert got[r.doc_id].base_sha256 == hashlib.sha256(plain.encode()).hexdigest()
        assert got[r.doc_id].n_email == said.count("email:") and got[r.doc_id].n_card == said.count("card:")
