"""Plans and row counts that must not grow faster than their input."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from girder import shared
from girder.functions import masks
from girder.llm import passages
from girder.operators import confusion, matching, runs, similarity
from girder.plans import catalogue, masked, views
from girder.shared import staged


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hashes_times_keys_are_not_broadcast(spark):
    """A small stored table, whose rows times their 66 keys would pass for small."""
    t = staged(spark.range(1000).select("id", F.xxhash64("id").bitwiseAND((1 << 63) - 1).alias("hash")), "t")
    near = similarity.close_classes(t, 8)
    assert "SortMergeJoin [chunk" in plan_of(near)
    digest, grid = F.sha2(F.col("id").cast("string"), 256), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.pmod(F.xxhash64("id", i), F.lit(9)))
    pairs, _ = similarity.similar_classes(staged(spark.range(200).select("id", digest.alias("digest"), grid.alias("grid")), "t"), 6, 1.0)
    assert "SortMergeJoin [chunk" in plan_of(pairs)


def test_fingerprints_count_words_and_make_no_row_of_one(spark, tmp_path):
    texts = {1: "a b  a ", 2: "", 3: "\n x\ty é", 4: " ".join(map(str, range(3000))), 5: None}
    rows = [*texts.items(), (4, "more words"), (None, "no id"), (6, "6")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = views.fingerprints(spark, str(tmp_path))
    assert "Generate" not in plan_of(views.fingerprints(spark, "/root/testdata/sf0.001"))
    got = sorted((r["id"], r["digest"], list(r["grid"]), r["hash"]) for r in found.collect())

    def counts(*parts):
        grid = [0] * 64
        for w in [w for p in parts for w in p.split(" ")]:
            grid[hashlib.sha256(w.encode()).digest()[0] % 64] += 1
        return grid

    want = []
    for i, text in rows:
        if i is not None and text is not None:
            grid = counts(*[t for j, t in rows if j == i])
            want.append((i, hashlib.sha256(text.encode()).hexdigest(), grid, sum(1 << k for k in range(63) if grid[k + 1] > grid[k])))
    assert got == sorted(want)


def test_windows_of_large_buckets_are_not_broadcast(spark):
    how = passages.Passages()
    words = lambda *k: F.unhex(F.repeat(F.sha2(F.concat_ws("-", *k), 256), 5)).substr(1, 4 * how.reach)
    kept = spark.range(400).select(F.lit(1).cast("long").alias("gram"), words(F.expr("id div 2")).alias("after"), words(F.expr("id div 2"), F.lit("b")).alias("before"), F.col("id").cast("string").cast("binary").alias("rid"), F.array(F.lit(40)).alias("at"))
    found = passages.compared_apart(staged(kept, "kept"), how)
    assert "SortMergeJoin [gram" in plan_of(found)
    assert found.select("rid").distinct().count() == 400 and found.count() == 400 * (how.reach + 1)


def test_boxes_are_one_row_until_they_are_swept(spark, monkeypatch):
    """Boxes and windows against bitmaps, with batches and blocks that cut groups, and no row for a column of a box."""
    monkeypatch.setattr(runs, "AT_ONCE", 7)
    rng = np.random.default_rng(5)
    high, wide, key = 12, 15, ["image", "class"]
    boxes = [(int(i), str(c), int(s), (int(x), int(y), int(x + w), int(y + h))) for i, c, s, x, y, w, h in zip(*[rng.integers(0, n, 400) for n in (5, 3, 2, 9, 7, 7, 6)], strict=True)]
    t = spark.createDataFrame(boxes, "image long, class string, side int, box struct<x1:int,y1:int,x2:int,y2:int>")
    want = {}
    for i, c, s, (x1, y1, x2, y2) in boxes:
        want.setdefault((i, c), np.zeros((2, high, wide), bool))[s, y1:y2, x1:x2] = True
    one, two = (runs.box_runs(t.where(F.col("side") == s), key, F.lit(high)) for s in (0, 1))
    assert "Generate" not in plan_of(one)
    for block in (1 << 20, 7):
        monkeypatch.setattr(runs, "BLOCK", block)
        got = {(r["image"], r["class"]): (r["reference_pixels"], r["proposal_pixels"], r["shared_pixels"]) for r in runs.coverage(one, two, key).collect()}
        assert got == {k: (a.sum(), b.sum(), (a & b).sum()) for k, (a, b) in want.items() if (a | b).any()}
        flat = {k: np.zeros(high * wide, int) for k in want}
        for r in runs.united(one.unionByName(two), key).collect():
            flat[r["image"], r["class"]][r["start"] : r["stop"]] += 1
        assert all((flat[k].reshape((high, wide), order="F") == (a | b)).all() for k, (a, b) in want.items())


def test_chains_of_runs_and_their_windows(spark):
    rng = np.random.default_rng(6)
    masks_ = {0: np.zeros((5, 4), bool), 1: np.pad(np.ones((2, 3), bool), ((1, 2), (0, 1))), **{k: rng.random((5, 4)) < 0.5 for k in range(2, 9)}}
    rows = spark.createDataFrame([(k, k - 3, 2 - k, masks.encode(m)) for k, m in masks_.items()], "image long, x long, y long, runs array<long>")
    chains = runs.length_runs(rows, ["image", "x", "y"], chains=True)
    assert [(r["start"], r["stop"], r["step"], r["times"]) for r in chains.where("image = 1").collect()] == [(1, 3, 5, 3)]
    plain = runs.length_runs(rows, ["image", "x", "y"])
    on = lambda t: sorted(map(tuple, runs.united(runs.placed(t, F.lit(5), F.col("x"), F.col("y"), F.lit(6), F.lit(7)), ["image"]).collect()))
    assert on(chains) == on(plain) != []


def test_a_sweep_makes_no_row_for_image_and_threshold(spark):
    rng = np.random.default_rng(7)
    rows = [(int(i), str(c), int(s), "matched" if h else "duplicate") for i, c, s, h in zip(rng.integers(0, 40, 300), rng.integers(0, 3, 300), rng.integers(0, 1000, 300), rng.random(300) < 0.5, strict=True)]
    m = spark.createDataFrame(rows, "image long, class string, score long, reason string")
    r = spark.createDataFrame([(i, str(c)) for i in range(60) for c in range(4)], "image long, class string")
    swept = confusion.sweep(m, r, [50, 500, 950])
    shuffled = [x for x in plan_of(swept).splitlines() if "hashpartitioning" in x]
    assert shuffled and not any("image" in x and "threshold" in x for x in shuffled)
    got = {(x["class"], x["threshold"]): (x["tp"], x["fp"], x["fn"], x["images_with_false_proposals"]) for x in swept.collect()}
    for c in map(str, range(4)):
        for t in (50, 500, 950):
            own = [x for x in rows if x[1] == c and x[2] >= t]
            tp, bad = sum(x[3] == "matched" for x in own), [x for x in own if x[3] != "matched"]
            assert got[c, t] == (tp, len(bad), 60 - tp, len({x[0] for x in bad}))


def test_lines_of_boxes_are_shuffled_once_and_narrow(spark):
    both = views.references(spark, "/root/testdata/sf0.001").join(views.predictions(spark, "/root/testdata/sf0.001").withColumnRenamed("box", "other"), "image")
    assert both.count() > 0
    both.collect()
    plan = plan_of(both).split("Initial Plan")[0]
    assert "ReusedExchange" in plan
    assert not [x for x in plan.splitlines() if "hashpartitioning(l_orderkey" in x and "box" in x]


def test_a_task_of_boxes_does_not_grow_with_the_table(spark, monkeypatch):
    """Ten times the rows a task may have are ten tasks and more, and both sides are matched there, with one shuffle and no join."""
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    monkeypatch.setattr(shared, "ROWS_A_TASK", lines // 20)
    sizes = [r["count"] for r in views.boxes(spark, "/root/testdata/sf0.001").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == lines and max(sizes) < lines // 10
    plan = plan_of(matching.match_sides(views.sides(spark, "/root/testdata/sf0.001")))
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_similar_contents_meet_by_sums_too(spark):
    """Against all pairs, at sums near and beyond the limit, with a join that tells sums apart and few rows a content."""
    rng = np.random.default_rng(8)
    grids = [rng.integers(0, 30, 64) for _ in range(30)]
    for k in range(30):
        near = grids[k].copy()
        near[rng.integers(0, 64, 1 + k % 3)] += (k * 7) % 90
        grids.append(near[similarity.turned(8)[k % 8]])
    t = spark.createDataFrame([(i, f"d{i}", [int(x) for x in g]) for i, g in enumerate(grids)], "id long, digest string, grid array<long>")
    pairs, _ = similarity.similar_classes(staged(t, "t"), 6, 1.0)
    joins = [x for x in plan_of(pairs).splitlines() if "SortMergeJoin [chunk" in x]
    assert joins and all("range" in x for x in joins)
    bits = lambda g: sum(1 << i for i in range(63) if g[i + 1] > g[i])
    want = {}
    for a, x in enumerate(grids):
        for b, y in enumerate(grids):
            for k, way in enumerate(similarity.turned(8)):
                apart, error = (bits(x) ^ bits(y[way])).bit_count(), np.abs(x - y[way]).sum() / 64
                if a != b and apart <= 6 and error <= 1.0:
                    want[a, b] = min(want.get((a, b), (9.0, 0, 0)), (error, apart, k))
    assert len(want) > 10
    assert {(r["a"], r["b"]): (r["error"], r["distance"], r["view"]) for r in pairs.collect()} == want
    keys = similarity.with_keys(spark.range(1).select("id", F.lit(5).cast("long").alias("hash")), "hash", 4, 63, around=False)
    assert keys.count() == 4


def test_windows_read_the_lines_that_references_read(spark):
    """One shuffle of lines for both sides and nothing stored; a mask that does not fill its window still fails."""
    got = catalogue.windowed_coverage(spark, "/root/testdata/sf0.001")
    assert got.count() > 0
    plan = plan_of(got)
    assert plan.count("Scan parquet") == 2 and "lineitem.parquet" in plan and "/girder-" not in plan
    got.collect()
    assert "ReusedExchange" in plan_of(got).split("Initial Plan")[0]
    window = "image long, image_width int, image_height int, x long, y long, width int, height int, class string, score long, runs array<long>"
    rows = [(1, 9, 9, 0, 0, 2, 2, "A", s, r) for s, r in ((500, [1, 1, 2]), (100, [1]))]
    assert masked.windowed_runs(spark.createDataFrame(rows, window), 300, first=False).count() == 1
    for wrong in ([1, 2], [5, -1], None):
        bad = spark.createDataFrame([*rows, (2, 9, 9, 0, 0, 2, 2, "A", 500, wrong)], window)
        with pytest.raises(Exception, match="does not match its window"):
            masked.windowed_runs(bad, 300, first=False).collect()


def test_links_are_no_more_than_rows_under_keys(spark, monkeypatch):
    """Hashes about a few centres, against all pairs; with keys that are dealt out in pieces, and small and large groups."""
    rng = np.random.default_rng(9)
    centres = rng.integers(0, 1 << 62, 6)
    hashes = sorted({int(c) ^ sum(1 << b for b in set(map(int, rng.integers(0, 63, k % 4)))) for c in centres for k in range(150)} | {int(x) for x in rng.integers(0, 1 << 62, 200)})
    order = rng.permutation(len(hashes))
    t = spark.createDataFrame([(f"p{i:04}", hashes[k]) for i, k in enumerate(order)], "id string, hash long")
    pairs = {(f"p{i:04}", f"p{j:04}") for i, k in enumerate(order) for j, m in enumerate(order) if i < j and (hashes[k] ^ hashes[m]).bit_count() <= 8}
    assert len(pairs) > 66 * len(hashes) / 2

    def parts(links):
        of = {f"p{i:04}": {f"p{i:04}"} for i in range(len(hashes))}
        for a, b in links:
            if of[a] is not of[b]:
                of[a] |= of[b]
                for x in of[b]:
                    of[x] = of[a]
        return {tuple(sorted(x)) for x in of.values()}

    for small, most in ((64, 1 << 16), (8, 1 << 16), (64, 16)):
        monkeypatch.setattr(similarity, "SMALL", small)
        monkeypatch.setattr(similarity, "AT_ONCE", most)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000 if small == 8 else 50)
        try:
            links = [tuple(r) for r in similarity.similarity_links(t, 8).collect()]
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert all(a < b for a, b in links) and parts(links) == parts(pairs)
    assert "SortMergeJoin [chunk" not in plan_of(similarity.similarity_links(t, 8))
    dense = spark.range(64).crossJoin(spark.range(64).withColumnRenamed("id", "k")).select((F.col("id") * 64 + F.col("k")).alias("id"), F.expr("shiftleft(id, 3) + shiftleft(k, 33)").alias("hash")).where("bit_count(hash) <= 4")
    n = dense.count()
    assert similarity.similarity_links(dense, 8).distinct().count() < n * (n - 1) / 4


def test_close_pairs_are_not_shuffled(spark):
    """Classes of several pieces, and no exchange above the join that finds the pairs."""
    t = staged(spark.range(300).select("id", F.expr("case when id < 200 then id % 2 else shiftleft(id, 20) end").alias("hash")), "t")
    found = similarity.close_pairs(t, 3)
    rows = [(i, i % 2 if i < 200 else i << 20) for i in range(300)]
    want = {(i, j): (x ^ y).bit_count() for i, x in rows for j, y in rows if i < j and (x ^ y).bit_count() <= 3}
    assert found.count() == len(want) > 19900 and {(r["left"], r["right"]): r["distance"] for r in found.collect()} == want
    pieces = similarity.pieces_of(t).select("hash", F.size("ids").alias("n")).collect()
    assert sum(r["n"] for r in pieces) == 300 and max(r["n"] for r in pieces) < 80 and len(pieces) > 102
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = plan_of(similarity.close_pairs(t, 3)).splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    at = next(i for i, x in enumerate(plan) if "SortMergeJoin [chunk" in x)
    assert not any("Exchange" in x for x in plan[:at])


def test_similar_pairs_are_not_shuffled(spark, monkeypatch):
    """Against all pairs: short and longer grids, near copies in all views and contents of several pieces, compared in many blocks; no exchange above where pairs are found."""
    rng = np.random.default_rng(10)
    grids = [np.bincount(rng.integers(0, 64, n), minlength=64) for n in (*rng.integers(0, 9, 60), *rng.integers(30, 70, 20))]
    grids += [rng.integers(0, 30, 64) for _ in range(20)]
    for k in range(40):
        near = grids[60 + k].copy()
        near[rng.integers(0, 64, 1 + k % 3)] += (k * 7) % 70
        grids.append(near[similarity.turned(8)[k % 8]])
    of = [*range(len(grids)), *[0] * 45, *[97] * 3, 120, 120]
    ids = [int(x) for x in rng.permutation(len(of))]
    bits = lambda g: sum(1 << i for i in range(63) if g[i + 1] > g[i])
    turned = [[g[way] for way in similarity.turned(8)] for g in grids]
    hashes = [[bits(v) for v in views_] for views_ in turned]

    def best(a, b):
        found = [(float(np.abs(grids[a] - turned[b][k]).sum()) / 64, (hashes[a][0] ^ hashes[b][k]).bit_count(), k) for k in range(8)]
        return min((x for x in found if x[0] <= 1.0 and x[1] <= 6), default=None)

    classes = {(a, b): best(a, b) for a in range(len(grids)) for b in range(len(grids)) if a != b}
    want = set()
    for i, a in zip(ids, of, strict=True):
        for j, b in zip(ids, of, strict=True):
            if i < j and a == b:
                want.add((i, j, "identical", 0, 0, 0.0))
            elif i < j and (m := classes[a, b]):
                want.add((i, j, "similar", m[2], m[1], m[0]))
    assert len({x for x in want if x[2] == "similar"}) > 2000 and {x[3] for x in want} == set(range(8))
    for factor in (1.0, 0.5):
        # Halves are fractions that all have exact sums.
        rows = [(i, f"d{a}", [float(x) * factor for x in grids[a]] if factor < 1 else [int(x) for x in grids[a]]) for i, a in zip(ids, of, strict=True)]
        t = staged(spark.createDataFrame(rows, f"id long, digest string, grid array<{'double' if factor < 1 else 'long'}>"), "t")
        for block, strip, leaving in ((1 << 14, (64, 1024), 1 << 18), (13, (5, 7), 50)):
            monkeypatch.setattr(similarity, "BLOCK", block)
            monkeypatch.setattr(similarity, "STRIP", strip)
            monkeypatch.setattr(similarity, "LEAVING", leaving)
            got = [tuple(r) for r in similarity.similar_pairs(t, 6, factor).collect()]
            assert len(got) == len(want) and {(*x[:5], x[5] / factor) for x in got} == want
    plan = plan_of(similarity.similar_pairs(t, 6, 1.0)).splitlines()
    at = next(i for i, x in enumerate(plan) if "MapInArrow" in x or "SortMergeJoin [chunk" in x)
    assert not any("Exchange" in x for x in plan[:at])


def test_some_chunk_of_close_hashes_is_alike():
    """Whichever bits differ, as many as may: a chunk of the first in one bit at most or a later one in none."""
    rng = np.random.default_rng(11)
    for distance, bits in ((0, 63), (1, 63), (2, 63), (5, 64), (6, 63), (8, 63), (6, 8), (6, 3)):
        places, wide = similarity.uneven_places(distance, bits)
        masks = [sum(p) & ((1 << 64) - 1) for p in places]
        assert sum(masks) == (1 << bits) - 1 and sum(map(len, places)) == bits
        for _ in range(500):
            apart = sum(1 << int(b) for b in rng.permutation(bits)[:distance])
            assert any((apart & m).bit_count() <= (k < wide) for k, m in enumerate(masks))
