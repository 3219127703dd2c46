"""The mix against brute force: every source near its target, the same rows however the table lies."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from girder.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, n_chars long, lang string"


def targets(sizes, share=1.5, cap=2, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    left, total, target = list(order), share * sum(sizes.values()), {}
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    while left:
        unit = total / sum(weight[s] for s in left)
        over = [s for s in left if weight[s] * unit > cap * sizes[s]]
        for s in over:
            target[s] = float(cap * sizes[s])
            total -= target[s]
        if not over:
            target |= {s: weight[s] * unit for s in left}
        left = [s for s in left if s not in target]
    return target


def drawn(rng, n, sources):
    rows = []
    for i in range(n):
        t = " ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([0, 1, 5, 40, 200])))
        rows.append((rng.choice([i, i, i % 7, None]), rng.choice([t, t, t, None]), rng.choice(sources), len(t), "en"))
    return rows + [(5, "the same row " * 30, "b", 390, "en")] * 40 + [(None, "the same row " * 30, "b", 390, "en")] * 9


CASES = {
    "four rows": [(1, "a b c", "s", 5, "x"), (2, "a", "s", 1, "x"), (3, "a b", "t", 3, "x"), (4, None, None, None, "x")],
    "two-word source": [(1, "a b", "z", 3, "x")] + [(i, "w " * 300, "a", 600, "x") for i in range(2, 9)],
    "many sources": drawn(random.Random(1), 300, ["a", "b", "c", "d", "é", "", None]),
    "one source": drawn(random.Random(2), 60, ["only"]),
}


@pytest.mark.parametrize("name", CASES)
def test_every_source_comes_near_its_target(spark, name):
    rows = CASES[name]
    sizes = Counter()
    for _, t, s, *_ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    table = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix_documents(table).collect()
    assert len(got) == len(rows)
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(WORD.findall(t or ""))) for i, t, *_ in rows)
    expected = targets(sizes)
    # Ids and sizes do not name a row's source; its target does, as far as targets differ.
    took, aims = defaultdict(int), Counter(round(x, 6) for x in expected.values())
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        took[round(r["target"], 6)] += r["taken"]
    assert set(took) <= set(aims)
    for aim, words in took.items():
        assert abs(words - aim * aims[aim]) <= max(1.5, 0.04 * aim) * aims[aim], (aim, words)


@pytest.mark.parametrize("name", CASES)
def test_the_mix_is_the_same_on_any_partitioning(spark, name):
    rows = CASES[name]
    random.Random(5).shuffle(rows)
    table = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("mark", "at", "part", "copies", "size", "start", "n")})
    ways = [table.repartition(1), table.repartition(7), table.repartitionByRange(3, F.desc("text"))]
    counted = [Counter(tuple(r) for r in mixing.mix_documents(t).collect()) for t in ways]
    assert counted[0] == counted[1] == counted[2]
    texts = [mixing.mixed_texts(t) for t in ways]
    assert texts[0].columns == table.columns
    made = [Counter(tuple(r) for r in t.collect()) for t in texts]
    assert made[0] == made[1] == made[2]
    words = sum(len(WORD.findall(r[1])) * n for r, n in made[0].items())
    took = sum(r[4] * n for r, n in counted[0].items())
    assert abs(words - took) <= max(3, 0.02 * took)  # rows are known by other marks there, so shards differ
    assert all(r[3] == len(r[1]) for r in made[0])
    # Every row of the mix is a row of the input, whole or with runs of its words in order.
    known = defaultdict(set)
    for i, t, s, *_ in rows:
        known[i, s].add(t or "")
    for r in made[0]:
        assert any(r[1] == t or is_part(WORD.findall(r[1]), WORD.findall(t)) for t in known[r[0], r[2]])


def is_part(some, words):
    rest = iter(words)
    return all(w in rest for w in some)


def test_runs_take_exactly_the_quota(spark):
    rng = random.Random(9)
    lines = [(n, e, max(1, round(e / 16)), rng.randrange(n)) for n in (1, 2, 15, 16, 17, 100, 1000) for e in {0, 1, n // 3, n // 2, n - 1} if 0 <= e < n]
    t = spark.createDataFrame(lines, "line long, extra long, runs long, phase long").withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("line"))))
    t = t.withColumns({"before": mixing.extra_before(F.col("x")), "next": mixing.extra_before(F.col("x") + 1)}).groupBy("line", "extra", "runs", "phase")
    for r in t.agg(F.max("before").alias("high"), F.min("before").alias("low"), F.min(F.col("next") - F.col("before")).alias("least"), F.max(F.col("next") - F.col("before")).alias("most")).collect():
        assert r["high"] - r["low"] == r["extra"] and r["least"] >= 0 and r["most"] <= 1


def test_an_empty_table_gives_an_empty_mix(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mixing.mix_documents(none).count() == 0 and mixing.mixed_texts(none).count() == 0
    wordless = spark.createDataFrame([(1, " ", "a", 1, "x"), (2, None, None, None, None)], SCHEMA)
    assert [r["taken"] for r in mixing.mix_documents(wordless).collect()] == [0, 0] and mixing.mixed_texts(wordless).count() == 0
