"""Conversation prefixes, repeated lines and centroids against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from girder.llm import centroids, lines, trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TURNS = "conv_id long, turn long, role string, text string"


@pytest.fixture
def many_ranges(spark):
    """Ranges as they come on a cluster: small tables are not gathered into one."""
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "13"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def brute_trie(rows):
    def tie(role, text):
        return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()

    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append(((turn is not None, turn or 0, tie(role, text)), (role, text)))
    own = {c: [x for _, x in sorted(t)] for c, t in own.items()}
    made = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = tuple(own.get(c - c % 20, [])[:h] + t[h:])
    members = {}
    for c, t in made.items():
        for d in range(len(t) + 1):
            members.setdefault(t[:d], []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)

    def subtree(p):
        leaves, saved = int(p not in children), (len(members[p]) - 1) * (len(WORD.findall(p[-1][1])) if p else 0)
        for x in children.get(p, []):
            a, b = subtree(x)
            leaves, saved = leaves + a, saved + b
        return leaves, saved

    out = []
    for p, m in members.items():
        ids = ",".join(map(str, sorted(c for c in m if made[c] == p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), *subtree(p), hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(300), 200):
        first = rng.choice([0, 0, 5])
        rows += [(c, first + t, rng.choice("ua"), rng.choice(["a b", "a  b c", "é x", ""])) for t in range(rng.choice([0, 1, 2, 3, 4, 6]))]
    rows += [(1000 + c, t, "u", f"same {t} words") for c in range(120) for t in range(5)]  # copies
    rows += [(2000 + c, t, "a", f"deep {t}") for c in range(3) for t in range(150 + c)]  # long shared prefixes
    rows += [(3000, None, None, None), (3000, None, "u", "x"), (3000, 1, "u", "y"), (3000, 1, "u", "y"), (3001, 2, "u", "z"), (None, 1, "u", "left out"), (3021, 1, "u", "one")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force_over_many_ranges(spark, many_ranges, seed):
    rows = conversations(seed)
    turns = spark.createDataFrame(rows, TURNS).withColumns({"path": F.lit("clash"), "key": F.lit(1)}).repartition(5)
    assert sorted(map(tuple, trie.trie(turns).collect()), key=str) == brute_trie(rows)


def test_trie_is_the_same_in_one_range(spark):
    rows = conversations(3)
    turns = spark.createDataFrame(rows, TURNS).coalesce(1)
    assert sorted(map(tuple, trie.trie(turns).collect()), key=str) == brute_trie(rows)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert trie.trie(spark.createDataFrame([], TURNS)).count() == 0
    turnless = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)  # its only turn is replaced by those of an absent one
    got = [tuple(r) for r in trie.trie(spark.createDataFrame([(turnless, 0, "u", "x")], TURNS)).collect()]
    assert got == [(turnless, 0, None, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())]


def test_trie_words_of_very_long_texts(spark):
    rows = [(0, 0, "u", "w " * 300_000), (100, 0, "u", "w " * 300_000)]
    assert sorted(map(tuple, trie.trie(spark.createDataFrame(rows, TURNS)).collect()), key=str) == brute_trie(rows)


def test_common_prefix_by_turns():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.choice("xy") * trie.TURN for _ in range(rng.randint(0, 9))] for _ in "ab")
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert trie.common("".join(a).encode(), "".join(b).encode()) == n


def brute_lines(rows):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    rank = lambda i: (i is None, i or 0)
    first = {}
    for i, text in rows:
        for x in (text or "").split("\n"):
            if len(k := key(x)) >= 10:
                first[k] = min(first.get(k, rank(i)), rank(i))
    out = []
    for i, text in rows:
        every = (text or "").split("\n")
        stay = [x for x in every if len(k := key(x)) < 10 or first[k] == rank(i)]
        out.append((i, len(every), len(every) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def texts(seed):
    rng = random.Random(seed)
    pool = ["A line that many have", "a LINE that many have \t", "Zwölf Boxkämpfer\x0b", "ZwÖlf Boxkämpfer", "short", "", "   ", "123456789", "1234567890", "äöüäöüäöüä", "no break space ", "tail\r"]
    rows = [(rng.choice([None, *range(150)]), "\n".join(rng.choice(pool) if rng.random() < 0.7 else f"line number {rng.randint(0, 60)}" for _ in range(rng.randint(0, 12)))) for _ in range(400)]
    rows += [(500 + i, "A line that many have\nof its own number %d" % i) for i in range(300)]
    rows += rows[:40] + [(7, "twice the same row, twice")] * 30 + [(None, None), (3, None), (4, ""), (5, "\n\n")]
    long = "\n".join(f"line number {i % 9000}" if i % 3 else "x" for i in range(20_000))
    return rows + [(2000, long), (2001, long), (2002, long + "\nlast line of all")]


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_equal_brute_force_over_many_ranges(spark, many_ranges, seed):
    rows = texts(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_id": F.lit("clash"), "_doc": F.lit(1), "_keep": F.lit(2), "number": F.lit(3)}).repartition(6)
    got = lines.deduplicated(docs).select("_doc.doc_id", "_n_lines", "_n_dropped", "_text").collect()
    assert sorted(map(tuple, got), key=str) == brute_lines(rows)
    assert lines.without_repeated_lines(docs).columns == docs.columns


def test_line_bitmaps_hold_only_words_that_lose_lines(spark):
    text = "\n".join(f"a long enough line {i}" for i in range(300))
    docs = spark.createDataFrame([(1, text), (2, text.replace("line 70\n", "line of its own\n")), (3, "nothing is lost here")], "doc_id long, text string")
    got = lines.keep_bitmaps(docs).collect()
    assert [r["_id"] for r in got] == [2]
    words = dict(map(tuple, got[0]["_keep"]))
    assert sorted(words) == [0, 1, 2, 3, 4] and words[0] == 0 and words[1] == 1 << (70 - 64)
    assert lines.digests(docs.limit(0)).count() == 0


def brute_clusters(rows, k=16, rounds=3):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) and abs(x) <= 2**21 for x in v):
            kept.append((i, [int(np.floor(64 * float(x))) for x in v]))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((square(v, x), j) for j, x in enumerate(c))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            own = [v for (_, v), o in zip(kept, of, strict=True) if o == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    last = [(i, *near(v)[::-1]) for i, v in kept]
    sums = {j: sum(d for _, o, d in last if o == j) for j in range(len(c))}
    return sorted([(i, j, d, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in last], key=str)


VECTORS = "vec_id long, embedding array<float>"


def vectors(seed, n):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((9, 64)) * 0.2
    return [(i, [float(x) for x in np.float32(centres[i % 9] + rng.standard_normal(64) * 0.1)]) for i in range(n)]


def test_clusters_equal_brute_force(spark):
    rows = vectors(5, 400)
    rows += [(1000 + i, rows[3][1]) for i in range(200)] + rows[:25]  # copies, repeated rows
    rows += [(None, rows[1][1]), (None, None), (1, None), (2, [0.0] * 64), (3, [1.0] * 63), (4, [1.0] * 65), (5, [None] + [0.1] * 63), (6, [float("nan")] * 64), (7, [float("-inf")] * 64), (8, []), (9, [2.0**21] * 64), (10, [-(2.0**22)] * 64)]
    table = spark.createDataFrame(rows, VECTORS).withColumns({"cluster": F.lit("clash"), "v": F.lit(1)}).repartition(5)
    expected = brute_clusters(rows)
    assert sorted(map(tuple, centroids.clusters(table).collect()), key=str) == expected
    assert sorted(map(tuple, centroids.clusters(table.coalesce(1)).collect()), key=str) == expected


def test_clusters_of_few_and_none(spark):
    rows = vectors(6, 5) + [(7, [0.5] * 64), (8, [0.5] * 64)]
    assert sorted(map(tuple, centroids.clusters(spark.createDataFrame(rows, VECTORS)).collect()), key=str) == brute_clusters(rows)
    assert centroids.clusters(spark.createDataFrame([(1, [1.0])], VECTORS)).count() == 0
    assert centroids.clusters(spark.createDataFrame([], VECTORS)).count() == 0


def test_annulus_leaves_out_no_nearest_centroid():
    rng = np.random.default_rng(8)
    for spread in (2, 5, 1000, 2**27):
        for k in (1, 2, 40):
            c = rng.integers(-spread, spread + 1, (k, 4))
            v = np.vstack([rng.integers(-spread, spread + 1, (500, 4)), np.zeros((1, 4), int), c])
            d = ((v[:, None, :] - c[None]) ** 2).sum(axis=2)
            number, distance = centroids.nearest_centroids(v, c, pairs=97)
            assert (number == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()
    # Norms far apart: the annulus holds few centroids.
    c = np.arange(1, 201)[:, None] * np.full(4, 100)
    _, first, end = centroids.annulus(c + 1, c)
    assert (end - first).max() <= 3
