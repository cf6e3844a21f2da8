import random
from collections import Counter

import numpy as np

from tablewright.llm import substring_dedup
from tablewright.llm.substring_dedup import without_repeats


def brute_force(rows, window=20):
    seen, found = set(), []
    for doc, text in sorted(rows):
        words = (text or "").split()
        covered = set()
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                covered.update(range(i, i + window))
            seen.add(key)
        found.append((doc, len(words), " ".join(w for i, w in enumerate(words) if i not in covered)))
    return found


def corpus(seed):
    draw = random.Random(seed)
    passages = [[f"p{p}_{k}" for k in range(draw.choice([19, 20, 21, 60]))] for p in range(6)]
    rows = []
    for doc in draw.sample(range(1000), 60):
        words = []
        for _ in range(draw.randint(0, 5)):
            words += draw.choice(passages) if draw.random() < 0.5 else [f"w{draw.randrange(10_000)}" for _ in range(draw.randint(0, 30))]
        rows.append((doc, " ".join(words)))
    rows += [(2000, rows[0][1]), (2001, None), (2002, ""), (2003, "a " * 100), (2004, "a\n" * 25)]
    return rows


def test_equals_brute_force_whatever_the_blocks(spark, documents, monkeypatch):
    for seed, size in ((1, 200), (2, 1 << 20)):
        monkeypatch.setattr(substring_dedup, "PACK_BYTES", size)
        rows = corpus(seed)
        found = without_repeats(documents(*rows).repartition(5)).collect()
        assert sorted((r.doc_id, r.n_words, r.kept_text) for r in found) == brute_force(rows)


def test_rolling_hash_and_packing():
    words = np.random.default_rng(1).integers(0, 2**63, 50).astype(np.uint64)
    for width in (1, 2, 5, 20):
        plain = [sum(int(words[i + k]) * substring_dedup._BASE ** (width - 1 - k) for k in range(width)) % 2**64
                 for i in range(len(words) - width + 1)]
        assert substring_dedup._rolled(words, width).tolist() == plain
    ids, counts = np.array([5, -7]), np.array([3, 2])
    positions, hashes = np.array([0, 4, 70_000, 1, 2]), words[:5] & np.uint64(2**56 - 1)
    owners, at, back = substring_dedup._unpack(substring_dedup._pack(ids, counts, hashes, positions, 7), 7)
    assert owners.tolist() == [5, 5, 5, -7, -7] and at.tolist() == positions.tolist() and back.tolist() == hashes.tolist()


def test_known_windows_are_spread_over_the_ranges(spark):
    rows = [(doc, " ".join(f"d{doc}_{k % 30}" for k in range(90))) for doc in range(640)]
    texts = spark.createDataFrame(rows, "id long, text string").repartition(16)
    held = Counter()
    for row in substring_dedup._windows(texts, 20, 6).where("known is not null").collect():
        held[row["range"]] += len(substring_dedup._unpack(bytes(row["known"]), 0)[0])
    assert sum(held.values()) == 640 * 41
    assert max(held.values()) < 5 * 640 * 41 / 64


def test_agrees_with_sql(spark, agrees):
    agrees(spark, "op7_rolling_substring_dedup")


def test_null_ids_repeated_rows_and_empty_table(spark, documents):
    text = " ".join(f"w{k}" for k in range(30))
    found = without_repeats(documents((None, text), (1, text), (2, text))).collect()
    assert {(r.doc_id, len(r.kept_text.split())) for r in found} == {(None, 30), (1, 30), (2, 0)}
    assert [[(s.begin, s.end) for s in r.intervals] for r in found if r.doc_id == 2] == [[(0, 30)]]
    assert without_repeats(documents((1, "a")).where("false")).collect() == []
