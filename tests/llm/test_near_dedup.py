import random
from collections import Counter

import pytest

from tablewright.llm import near_dedup
from tablewright.llm.components import components
from tablewright.llm.near_dedup import drop_near_duplicates, near_duplicates


def brute_force(rows, width, percent=80):
    sets = []
    for _, text in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ")
        words = [w for w in words if w]
        span = min(width, len(words))
        sets.append({tuple(words[i : i + span]) for i in range(len(words) - span + 1)} if words else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        root = find(i)
        if doc is not None:
            least[root] = min(least.get(root, doc), doc)
    return sorted(((doc, len(sets[i]), least[find(i)] if doc is not None else None) for i, (doc, _) in enumerate(rows)), key=repr)


def corpus(seed):
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    rows = []
    for _ in range(25):
        base = [draw.choice(words) for _ in range(draw.choice([1, 2, 3, 30, 60, 120]))]
        for _ in range(draw.choice([1, 1, 3, 9])):
            copy = list(base)
            for _ in range(draw.choice([0, 0, 1, 2, 4, 8])):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            rows.append(" ".join(copy).upper() if draw.random() < 0.1 else " ".join(copy))
    ids = draw.sample(range(10_000), len(rows))
    rows = list(zip(ids, rows))
    return [*rows, (20_000, None), (20_001, ""), (20_002, " \n\t"), (20_003, "One"), (20_004, "one"), rows[0], (None, rows[0][1])]


@pytest.mark.parametrize("width", [2, 5])
def test_components_equal_brute_force(spark, documents, width):
    rows = corpus(width)
    found = near_duplicates(documents(*rows).repartition(7), width=width).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=repr) == brute_force(rows, width)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_one_document_of_a_group_stays(spark, documents):
    text = " ".join(f"word{k}" for k in range(40))
    docs = documents((5, text), (3, text), (9, text + " more"), (4, "another text altogether"), (7, None))
    stays = drop_near_duplicates(docs)
    assert stays.columns == docs.columns
    assert sorted(r.doc_id for r in stays.collect()) == [3, 4, 7]


def test_empty_table(spark, documents):
    assert near_duplicates(documents((1, "a")).where("false")).collect() == []


def test_components_of_a_path_a_star_and_a_loop(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 200), (201, 202), (202, 201)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 130)}, 201: 201, 202: 201}


def _met(monkeypatch):
    """Tables of the exact filter by name; rows that share all of what they are joined on make pairs."""
    settled = {}
    settle = near_dedup.settle
    monkeypatch.setattr(near_dedup, "settle", lambda df, label: settled.setdefault(label, []).append(settle(df, label)) or settled[label][-1])

    def pairs():
        rows = [r for df in settled.get("firsts", []) for r in df.drop("id", "label", "n", "at", "of_largest", "low", "high").collect()]
        return sum(n * n for n in Counter(rows).values())

    return pairs


def test_copies_of_a_template_below_the_threshold_do_not_meet(spark, documents, monkeypatch):
    pairs = _met(monkeypatch)
    shared = [f"t{k}" for k in range(86)]
    rows = [(doc, " ".join([*shared, *(f"o{doc}_{k}" for k in range(14 + doc % 3))])) for doc in range(300)]
    found = near_duplicates(documents(*rows), width=1).collect()
    assert all(r.kept and r.component_id == r.doc_id for r in found)
    assert pairs() < 300


def test_open_links_of_sizes_on_both_sides_of_a_band(spark, documents):
    sizes = [80, 81, 90, 99, 100, 124, 125, 127, 128, 129, 130, 160, 161, 200, 256, 257, 259, 300, 320]
    rows = [(k, " ".join(f"w{j}" for j in range(n))) for k, n in enumerate(sizes)]
    sets = spark.createDataFrame([(k, list(range(n))) for k, n in enumerate(sizes)], "id long, shingles array<long>")
    labels = spark.createDataFrame([], "node long, component long")
    apart = spark.createDataFrame([(k, 0) for k in range(1, len(sizes))], "own_label long, head_label long")
    found = {tuple(r) for r in near_dedup._across(sets, labels, apart, 80).select("id", "head").collect()}
    assert found >= {(b, a) for a in range(len(sizes)) for b in range(a + 1, len(sizes)) if 100 * sizes[a] >= 80 * sizes[b]}
    found = near_duplicates(documents(*rows), width=1).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=repr) == brute_force(rows, 1)


def test_agrees_with_sql(spark, agrees):
    agrees(spark, "op10_minhash_near_dedup")
