"""Near-dedup where many near misses of one text share their keys."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from test_documents import brute_components

from girder.llm import neardup
from girder.operators.components import connected_components


def group(rng, words, copies, most, first):
    """A text and copies of it with up to ``most`` words changed, taken out or put in."""
    base = [f"{first}w{i}" for i in range(words)]
    rows = []
    for i in range(copies):
        w = list(base)
        for _ in range(rng.randint(0, most)):
            at, what = rng.randrange(len(w)), rng.random()
            if what < 0.6:
                w[at] = f"x{rng.randrange(40) if what < 0.2 else rng.random()}"
            elif what < 0.8:
                del w[at]
            else:
                w.insert(at, f"y{rng.random()}")
        rows.append((first + i, " ".join(w), "s"))
    return rows


@pytest.mark.parametrize("how", [replace(neardup.NearDup(), few=1), replace(neardup.PIPELINE, few=1), neardup.NearDup()], ids=["three words", "five words", "as registered"])
def test_near_misses_are_told_apart(spark, how):
    rng = random.Random(12)
    # The second group has no lightly changed member; the third only shares a long beginning.
    rows = group(rng, 120, 90, 12, 1000) + [r for r in group(rng, 200, 60, 16, 2000) if r[0] > 2003]
    rows += [(3000 + i, " ".join([f"b{k}" for k in range(40)] + [f"c{i // 2}{k}" for k in range(60 if i % 2 else 63)]), "s") for i in range(60)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = sorted(tuple(r) for r in neardup.components(table, how).drop("component").collect())
    assert got == sorted(brute_components(rows, how.width, how.percent))
    assert 5 < len({r[2] for r in got}) < len(rows) - 50


def test_null_and_repeated_ids_with_different_texts(spark):
    rng = random.Random(3)
    texts = [r[1] for r in group(rng, 60, 30, 3, 0)]
    rows = [(None if i % 3 == 0 else i % 4, t, "s") for i, t in enumerate(texts)] + [(None, None, "s"), (None, "", "s"), (2, " ", "s")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("_mark", F.lit("x"))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r)[:3] for r in neardup.near_duplicates(table).collect()), key=key) == sorted(brute_components(rows, 3, 85), key=key)


def test_near_copies_are_linked_through_the_first_of_a_token(spark):
    """Under one centre, two families of members that are alike among themselves: as many links as rows at most, connecting all that pairs connect."""
    how = neardup.NearDup()
    rows = [(0, 40 * f + k + 1, [1000 * f + t for t in range(60) if t != k], 400) for f in range(2) for k in range(40)]
    t = spark.createDataFrame(rows, "hub long, node long, d array<long>, n int")
    common = neardup.differing(t.select("hub", "node", "n", "d")).withColumns({"component": F.col("node"), "centre": F.lit(0).cast("long")})
    rare = neardup.rarest(common, how).localCheckpoint()
    star = neardup.linked_to_first(rare, how)
    assert 0 < star.count() <= rare.count()
    parts = {r["id"]: r["component"] for r in connected_components(star.select("a", "b")).collect()}
    pairs = neardup.linked_by_differences(rare, how).collect()
    assert len(pairs) == len(set(map(tuple, pairs))) and pairs
    assert all(parts[p["a"]] == parts[p["b"]] for p in pairs)
