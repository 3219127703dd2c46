"""Approximate nearest neighbours: a forest of random-projection trees with one shared queue.

Each tree halves a bounded sample at the median of its projections on the line through two random
members, level by level. Every row of the table goes down every tree to a leaf. A
query opens leaves of all trees in order of one priority queue, keyed by the largest margin on the way, until
so many are open as a calibration on the sample asks for; their members are compared exactly and the nearest kept. Rows that
repeat an id and its vector are dropped first. Of equal vectors only the k + 1 smallest ids can ever be among a query's k nearest, so copies beyond those are left out first, exactly.
Rows and queries of one leaf meet in blocks of bounded size, whatever the leaf holds.

How many leaves that takes is a matter of the data: vectors in clusters need few; directions spread evenly over
a sphere of 64 dimensions have no near regions, and reaching the recall means opening half of all leaves.

Nulls: vectors that are null, zero, of another length than most or hold null or non-finite components take no part, nor do null
ids. Rows that repeat an id count as one candidate at their smallest distance. An empty table, or
one without valid vectors, gives an empty result. Equal distances go by the smaller id, also where copies are left out. Only the id and the vector are read, so other
columns may have any names; a vector's own length is bounded by the most common one.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girder.shared import staged


@dataclass(frozen=True)
class Forest:
    """sample: vectors that the trees are fitted on, at most. leaf: rows a leaf is planned to hold.

    The number of leaves opened is the smallest that finds the share ``recall`` of the true neighbours of ``trials`` sampled
    vectors within the sample, where neighbours are farther and so harder to find than in the whole table.
    rows_block, queries_block: rows and queries of a leaf that a task compares at once, about.
    """

    trees: int = 2
    leaf: int = 512
    recall: float = 0.96
    trials: int = 200
    sample: int = 16_384
    least_sample: int = 8
    rows_block: int = 8192
    queries_block: int = 2048
    seed: int = 11


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, v array<double>) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    t = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    t = t.where(sound & F.exists("v", lambda x: x != 0))
    usual = t.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return t.where(F.size("v") == (usual["n"] if usual else 0))


def without_spare_copies(t: DataFrame, k: int) -> DataFrame:
    """Of each set of equal vectors the k + 1 smallest ids, each once; the limit works before the shuffle, so no group gathers."""
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    return t.distinct().withColumn("nth", nth).where(F.col("nth") <= k + 1).drop("nth")


def rows_an_id(t: DataFrame) -> int:
    """The most rows that one id has."""
    return t.groupBy("id").count().agg(F.max("count")).first()[0] or 1


def fit(sample: np.ndarray, rows: int, how: Forest) -> tuple[np.ndarray, np.ndarray]:
    """Directions (trees, nodes, length) and thresholds (trees, nodes) of complete trees, nodes as in a heap."""
    rng = np.random.default_rng(how.seed)
    depth = 0
    while rows > how.leaf << depth and len(sample) >= how.least_sample << (depth + 1):
        depth += 1
    nodes, length = (1 << depth) - 1, sample.shape[1] if sample.ndim == 2 else 0
    direction, threshold = np.zeros((how.trees, nodes, length)), np.zeros((how.trees, nodes))
    for tree in range(how.trees):
        members = {0: np.arange(len(sample))}
        for node in range(nodes):
            own = members.pop(node)
            a, b = (sample[i] for i in rng.choice(own, 2, replace=False)) if len(own) > 1 else (rng.standard_normal(length), np.zeros(length))
            w = a - b
            if not w.any():
                w = rng.standard_normal(length)
            w /= np.linalg.norm(w)
            at = sample[own] @ w
            t = float(np.median(at)) if len(own) else 0.0
            direction[tree, node], threshold[tree, node] = w, t
            members[2 * node + 1], members[2 * node + 2] = own[at <= t], own[at > t]
    return direction, threshold


def leaves_of(x: np.ndarray, direction: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    """(rows, trees): the leaf of each row in each tree."""
    nodes = threshold.shape[1]
    out = np.zeros((len(x), len(threshold)), np.int64)
    for tree in range(len(threshold)):
        at = np.zeros(len(x), np.int64)
        for _ in range(int(nodes + 1).bit_length() - 1):
            far = np.einsum("ij,ij->i", x, direction[tree, at]) > threshold[tree, at]
            at = 2 * at + 1 + far
        out[:, tree] = at - nodes
    return out


def opened(margins: np.ndarray, probes: int) -> list[tuple[int, int]]:
    """(tree, leaf) opened for a query, in order; margins (trees, nodes) are signed distances to the hyperplanes."""
    trees, nodes = margins.shape
    queue: list = [(-np.inf, tree, 0) for tree in range(trees)]
    found: list[tuple[int, int]] = []
    while queue and len(found) < probes:
        key, tree, node = heapq.heappop(queue)
        while node < nodes:
            m = float(margins[tree, node])
            near, away = (2 * node + 2, 2 * node + 1) if m > 0 else (2 * node + 1, 2 * node + 2)
            heapq.heappush(queue, (max(key, abs(m)), tree, away))
            node = near
        found.append((tree, node - nodes))
    return found


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(float) if len(column) else np.zeros((0, 0))


def squared(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of all pairs by one product, up to a power of two, and for each of q how far off they may be.

    A common centre is taken away first, which no distance notices, so that the error goes with the spread of the vectors and not with
    their distance from zero; and very great vectors are halved until no square overflows.
    """
    peak = max(np.abs(q).max(initial=0), np.abs(x).max(initial=0))
    if peak > 1e100:
        shrink = 2.0 ** -np.ceil(np.log2(peak))
        q, x = q * shrink, x * shrink
    centre = x.mean(0)
    q, x = q - centre, x - centre
    nq, nx = (q * q).sum(1), (x * x).sum(1)
    off = 4 * (x.shape[1] + 16) * np.finfo(float).eps * (nq + nx.max(initial=0))
    return nq[:, None] + nx[None, :] - 2 * q @ x.T, off


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances of one vector to several, in double precision."""
    apart = x - q
    with np.errstate(over="ignore"):
        plain = np.sqrt((apart * apart).sum(1))
    over = ~np.isfinite(plain)
    if over.any():
        halved = (x[over] * 2.0**-600) - (q * 2.0**-600)
        plain[over] = np.sqrt((halved * halved).sum(1)) * 2.0**600
    return plain


def calibrated(sample: np.ndarray, direction: np.ndarray, threshold: np.ndarray, k: int, how: Forest) -> int:
    """Leaves to open, from the places in the queue at which the sample's own neighbours are found."""
    trees, leaves = threshold.shape[0], threshold.shape[1] + 1
    if leaves == 1 or len(sample) <= k:
        return trees * leaves
    leaf = leaves_of(sample, direction, threshold)
    trials = np.random.default_rng(how.seed + 1).choice(len(sample), min(how.trials, len(sample)), replace=False)
    far, _ = squared(sample[trials], sample)
    far[np.arange(len(trials)), trials] = np.inf
    places = []
    for i, near in zip(trials, np.argpartition(far, k, axis=1)[:, :k], strict=True):
        place = np.zeros((trees, leaves), np.int64)
        for n, door in enumerate(opened(np.einsum("j,tnj->tn", sample[i], direction) - threshold, trees * leaves)):
            place[door] = n
        places.append(place[np.arange(trees)[:, None], leaf[near].T].min(0))
    return int(np.quantile(np.concatenate(places), how.recall, method="higher")) + 1


def salt(ids: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """A block for each id, below the number of blocks of its leaf."""
    return (((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % blocks.astype(np.uint64)).astype(np.int32)


def compared(k: int):
    """A function of a block's rows and queries: each query's k nearest ids in the block, each at its smallest distance.

    An id has as many rows as it has vectors, so the rows looked at are k times the most rows of an id, with all that the error
    of the fast distances could have put beyond the edge; those are measured exactly.
    """

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        x, q = matrix(rows.column("v").combine_chunks()), matrix(queries.column("q").combine_chunks())
        ids, names = rows.column("id").to_numpy(), queries.column("query_id").to_numpy()
        found = {"query_id": [], "id": [], "score": []}
        if len(x) and len(q):
            far, off = squared(q, x)
            wanted = min(k * int(np.unique(ids, return_counts=True)[1].max()), len(ids))
            for i, name in enumerate(names):
                d = np.where(ids == name, np.inf, far[i])
                edge = np.partition(d, wanted - 1)[wanted - 1]
                near = np.flatnonzero(d <= edge + 2 * off[i]) if np.isfinite(edge) else np.flatnonzero(np.isfinite(d))
                exact = distances(q[i], x[near])
                order = np.lexsort((ids[near], exact))
                first = order[np.sort(np.unique(ids[near][order], return_index=True)[1])[:k]]
                found["query_id"].append(np.full(len(first), name))
                found["id"].append(ids[near][first])
                found["score"].append(exact[first])
        flat = {c: np.concatenate(v) if v else np.zeros(0) for c, v in found.items()}
        return pa.table({"query_id": pa.array(flat["query_id"].astype(np.int64)), "id": pa.array(flat["id"].astype(np.int64)), "score": pa.array(flat["score"].astype(float))})

    return run


def nearest(vectors: DataFrame, queries: Column, k: int = 10, how: Forest = Forest(), id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows, by Euclidean distance, of the rows that ``queries`` marks.

    queries: a condition on the column ``id``. The forest is sent with the tasks; it is bounded by the sample.
    """
    spark = vectors.sparkSession
    every = usable(vectors, id_col, vector)
    index = staged(without_spare_copies(every, k), "index")
    rows = index.count()
    every_nth = max(1, -(-rows // how.sample))
    picked = index.where(F.pmod(F.xxhash64("id", F.lit(how.seed)), F.lit(every_nth)) == 0).select("v").limit(how.sample).toArrow()
    sample = matrix(picked.column("v").combine_chunks()) if rows and picked.num_rows else np.zeros((0, 0))
    direction, threshold = fit(sample, rows, how)
    trees, leaves = threshold.shape[0], threshold.shape[1] + 1
    probes = calibrated(sample, direction, threshold, k, how)
    forest = spark.sparkContext.broadcast((direction, threshold))

    def doors_of(x: np.ndarray) -> list[list[tuple[int, int]]]:
        direction, threshold = forest.value
        margins = np.einsum("ij,tnj->itn", x, direction, optimize=True) - threshold
        return [opened(m, probes) for m in margins]

    def counted(of: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros((trees, leaves), np.int64)
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    x = matrix(batch.column(0).slice(at, 256))
                    if of == "rows":
                        np.add.at(n, (np.arange(trees)[None, :], leaves_of(x, *forest.value)), 1)
                    else:
                        for door in (d for one in doors_of(x) for d in one):
                            n[door] += 1
            t, leaf = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), pa.array(leaf.astype(np.int32)), pa.array(n[t, leaf])], ["tree", "leaf", "n"])

        return run

    asked = every.where(queries).distinct()

    def blocks(table: DataFrame, of: str, size: int) -> np.ndarray:
        # One row for every tree and leaf, of which a bounded sample makes a bounded number.
        n = np.ones((trees, leaves), np.int64)
        counts = table.select("v").mapInArrow(counted(of), "tree int, leaf int, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n"))
        for r in counts.collect():
            n[r["tree"], r["leaf"]] = -(-r["n"] // size)
        return n

    row_blocks, query_blocks = blocks(index, "rows", how.rows_block), blocks(asked, "queries", how.queries_block)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = leaves_of(matrix(batch.column(1)), *forest.value)
                for tree in range(trees):
                    own = leaf[:, tree]
                    copies = query_blocks[tree, own]
                    row = np.repeat(np.arange(len(own)), copies)
                    turn = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
                    block = salt(batch.column(0).to_numpy(), row_blocks[tree, own])[row]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), tree, np.int32)), pa.array(own[row].astype(np.int32)), pa.array(block), pa.array(turn.astype(np.int32)), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))], ["tree", "leaf", "rb", "qb", "id", "v"])

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                doors = doors_of(matrix(part.column(1)))
                row = np.repeat(np.arange(len(doors)), list(map(len, doors)))
                flat = np.array([d for one in doors for d in one], np.int64).reshape(-1, 2)
                copies = row_blocks[flat[:, 0], flat[:, 1]]
                turn = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
                flat, row = np.repeat(flat, copies, axis=0), np.repeat(row, copies)
                block = salt(part.column(0).to_numpy()[row], query_blocks[flat[:, 0], flat[:, 1]])
                yield pa.RecordBatch.from_arrays([pa.array(flat[:, 0].astype(np.int32)), pa.array(flat[:, 1].astype(np.int32)), pa.array(turn.astype(np.int32)), pa.array(block), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row))], ["tree", "leaf", "rb", "qb", "query_id", "q"])

    kind = "tree int, leaf int, rb int, qb int"
    small = vectors.schema[vector].dataType
    members = index.mapInArrow(placed, f"{kind}, id long, v array<double>").withColumn("v", F.col("v").cast(small))
    doors = asked.mapInArrow(probed, f"{kind}, query_id long, q array<double>").withColumn("q", F.col("q").cast(small))
    key = ["tree", "leaf", "rb", "qb"]
    pairs = members.groupBy(*key).cogroup(doors.groupBy(*key)).applyInArrow(compared(k), "query_id long, id long, score double")
    return best(pairs, k, trees * rows_an_id(index) * rows_an_id(asked))


def best(pairs: DataFrame, k: int, scores: int) -> DataFrame:
    """The k first of each query's (query_id, id, score) pairs, repeats of an id counting once; scores: different ones that a pair of ids has, at most."""
    order = Window.partitionBy("query_id").orderBy("score", "id")
    top = pairs.withColumn("nth", F.dense_rank().over(order)).where(F.col("nth") <= scores * k)
    once = top.groupBy("query_id", "id").agg(F.min("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
