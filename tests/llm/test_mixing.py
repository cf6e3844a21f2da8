import random

import pytest
from pyspark.sql import functions as F

from tablewright.llm.mixing import mixed, schedule, taken_words, targets


def test_agrees_with_sql(spark, agrees):
    agrees(spark, "op2_weighted_fair_mixing")


def shared_out(sizes, weights=(1, 2, 3), rounds=3):
    """Share by weight; what full sources cannot take is shared again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full, left = {}, dict(sizes)
    while True:
        budget = sum(sizes.values()) - sum(full.values())
        total = sum(weight[s] for s in left) or 1
        over = {s for s in left if budget * weight[s] / total > rounds * sizes[s]}
        if not over:
            return {**full, **{s: budget * weight[s] / total for s in left}}
        for s in over:
            full[s] = rounds * sizes[s]
            del left[s]


@pytest.mark.parametrize("seed", range(3))
def test_targets(spark, seed):
    draw = random.Random(seed)
    sizes = {f"s{k}": draw.choice([0, 1, 5, 100, 5000]) for k in range(9)} | {None: 50}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r.source: r.target for r in targets(rows).collect()}
    assert found == pytest.approx(shared_out(sizes))


def test_words_come_near_targets_whatever_the_sizes(spark, documents):
    draw = random.Random(1)
    rows = [(k, "w " * draw.choice([0, 1, 20, 3000]), "en", draw.choice(["a", "b", "c", None])) for k in range(120)]
    docs = documents(*rows, (None, "x y", "en", "a"), rows[3], (999, None, "en", "b"))
    found = taken_words(schedule(docs))
    assert found.where("taken > 3 * size or taken < 0").count() == 0
    sums = found.groupBy("queue").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 1 for r in sums)
    assert found.count() == docs.count()
    again = taken_words(schedule(docs.repartition(5)))
    columns = ["row.doc_id", "size", "taken"]
    assert sorted(map(tuple, found.select(columns).collect()), key=repr) == sorted(map(tuple, again.select(columns).collect()), key=repr)


def test_mix_is_in_order_and_whole(spark, documents):
    docs = documents(*[(k, "w " * 10, "en", "ab"[k % 2]) for k in range(20)])
    mix = mixed(docs)
    assert mix.columns == docs.columns
    counts = {r.source: r["count"] for r in mix.groupBy("source").count().collect()}
    assert counts == {"a": 7, "b": 13}
    finish = [r.finish for r in schedule(docs).where("taken > 0").orderBy("finish").collect()]
    assert finish[-1] >= 1 and sum(f > 1 for f in finish) <= 2


def test_texts_without_words_are_not_served(spark, documents):
    docs = documents((1, "a b c", "en", "a"), (2, "", "en", "a"), (3, None, "en", "b"), (4, " \n", "en", "b"), (5, "d e", "en", "b"))
    assert {r.doc_id for r in mixed(docs).collect()} == {1, 5}


def test_empty_table(spark, documents):
    none = documents((1, "a")).where("false")
    assert taken_words(schedule(none)).collect() == [] and mixed(none).collect() == []
