"""The trie of conversation prefixes, from sorted turn arrays.

A conversation's turns are one binary value, 20 bytes a turn: 128 bits of role and text and the words of the text. Equal values are one path, which
carries its conversations' number, least id and a digest of their ids. Paths are sorted by range over the whole cluster; in a range each path's longest
common prefix (LCP) with the one before it says which prefixes end and which begin, so one sweep with a stack makes the LCP intervals into nodes. What is open
where a range begins or ends is given out as fragments, and those are stitched in order of the ranges: the only work that goes through
all ranges, and it sees no more than the first and the last path of each. A node's parent is joined by a hash of the prefix.

Conversations are made by ``turn_arrays``; a caller may bring other paths of its own. Nulls: a null turn comes first, a null role or text
is an empty one, rows without conv_id belong to no conversation. Turns that tie are taken in order of their digests, and repeated rows are turns each. An
empty table has no nodes, not even a root. A path is one value, so a single conversation has at most 100 million turns; texts are hashed
whole however long, and only hashes are shuffled. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girder.llm.text import n_words
from girder.shared import staged

#: Bytes of a turn in a path: the digest, then the number of words.
TURN, DIGEST = 20, 16
NO_IDS = hashlib.sha256(b"").hexdigest()
BATCH = 4096


def turn_value(role: Column, text: Column) -> Column:
    """A turn as 40 hex digits."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.concat(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)), F.lpad(F.lower(F.hex(n_words(text))), 8, "0"))


def turn_arrays(turns: DataFrame, family: int = 20, heads: int = 4) -> DataFrame:
    """conv_id, path of turns (conv_id, turn, role, text), each conversation rebuilt.

    Rebuilt: the first h turns of the conversation that begins its family of ``family`` ids, then its own after its first h, where h is crc32 of the
    id modulo ``heads``. Rows are dealt out by family once, so a conversation meets the head of its family without another shuffle.
    """
    head_of = F.col("conv_id") - F.col("conv_id") % family
    rows = turns.where("conv_id is not null").select("conv_id", "turn", turn_value(F.col("role"), F.col("text")).alias("value"), head_of.alias("of")).repartition("of")
    own = rows.groupBy("of", "conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "value"))), lambda x: x["value"]), "").alias("own"))
    head = F.max(F.when(F.col("conv_id") == F.col("of"), F.substring("own", 1, 2 * TURN * heads))).over(Window.partitionBy("of"))
    cut = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads * 2 * TURN).cast("int")
    path = F.concat(F.coalesce(F.substring(F.col("head"), F.lit(1), cut), F.lit("")), F.substring(F.col("own"), cut + 1, F.length("own")))
    return own.withColumn("head", head).select("conv_id", F.unhex(path).alias("path"))


def ends(conversations: DataFrame) -> DataFrame:
    """key, n, least, ends of conversations (key, conv_id): the digest of each key's ids, ascending and comma-joined.

    Ids of a key are read in order and hashed as they come, so a group of any size takes no memory; a digest of this kind has to be made in one pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, n, least, h = None, 0, 0, None
        for batch in batches:
            for key, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != now:
                    if n:
                        out.append((now, n, least, h.hexdigest()))
                    now, n, least, h = key, 0, i, hashlib.sha256()
                h.update(b",%d" % i if n else b"%d" % i)
                n += 1
            if len(out) >= BATCH:
                yield as_batch(out, ENDS)
                out = []
        if n:
            out.append((now, n, least, h.hexdigest()))
        yield as_batch(out, ENDS)

    return conversations.select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(run, "key binary, n long, least long, ends string")


ENDS = pa.schema([("key", pa.binary()), ("n", pa.int64()), ("least", pa.int64()), ("ends", pa.string())])


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def sorted_paths(arrays: DataFrame) -> DataFrame:
    """path, n, least, ends of every distinct path, sorted by range."""
    keyed = staged(arrays.select("conv_id", "path", F.unhex(F.md5("path")).alias("key")), "arrays")
    # Copies of a conversation are one row before the paths are sorted.
    distinct = keyed.groupBy("key").agg(F.first("path").alias("path"))
    paths = staged(distinct.join(ends(keyed), "key").select("path", "n", "least", "ends"), "paths")
    return paths.repartitionByRange("path").sortWithinPartitions("path")


@dataclass
class Node:
    """A prefix with what is known of it: members n, the least of them, children, and what its subtree has in leaves and saved words.

    The two late ones are what stitching adds: leaves and words of nodes that were open where a range ended. left: whether the node may have begun in an earlier range.
    """

    key: bytes
    depth: int
    words: int
    left: bool = False
    n: int = 0
    least: int | None = None
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ends: str | None = None
    late_leaves: int = 0
    late_saved: int = 0

    def add(self, n: int, least: int | None, children: int, leaves: int, saved: int, ends: str | None) -> None:
        self.n += n
        self.least = least if self.least is None else self.least if least is None else min(self.least, least)
        self.children += children
        self.leaves += leaves
        self.saved += saved
        self.ends = self.ends or ends


ROOT = b"\0" * DIGEST


def key_below(key: bytes, turn: bytes) -> bytes:
    return hashlib.blake2b(key + turn[:DIGEST], digest_size=DIGEST).digest()


NODE = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("closed", pa.bool_()), ("left", pa.bool_()), ("key", pa.binary()), ("above", pa.binary()), ("depth", pa.int64()), ("words", pa.int64()), ("n", pa.int64()), ("least", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("ends", pa.string())])
NODE_DDL = "part int, seq long, closed boolean, left boolean, key binary, above binary, depth long, words long, n long, least long, children long, leaves long, saved long, ends string"


@dataclass
class Sweep:
    """The stack of a range of sorted paths. Rows come out as nodes (part null) or, where the node may reach beyond the range, as fragments in order of seq."""

    part: int
    stack: list[Node] = field(default_factory=list)
    before: bytes | None = None
    seq: int = 0
    out: list[tuple] = field(default_factory=list)

    def row(self, x: Node, closed: bool) -> None:
        above = self.stack[x.depth - 1].key if x.depth else None
        fragment = x.left or not closed
        self.out.append((self.part if fragment else None, self.seq, closed, x.left, x.key, above, x.depth, x.words, x.n, x.least, x.children, x.leaves, x.saved, x.ends))
        self.seq += fragment

    def carry_up(self, x: Node) -> None:
        if x.depth:
            self.stack[x.depth - 1].add(x.n, x.least, 0, x.leaves, x.saved, None)

    def close(self) -> None:
        x = self.stack.pop()
        if not x.left:
            x.leaves += not x.children
            x.saved += (x.n - 1) * x.words
        self.carry_up(x)
        self.row(x, True)

    def path(self, path: bytes, n: int, least: int, ends: str) -> None:
        first = self.before is None
        same = 0 if first else common(self.before, path) + 1  # nodes that stay: the root and a node for each common turn
        while len(self.stack) > same:
            self.close()
        for d in range(len(self.stack), len(path) // TURN + 1):
            if d == 0:
                self.stack.append(Node(ROOT, 0, 0, first))
                continue
            turn = path[TURN * (d - 1) : TURN * d]
            self.stack[d - 1].children += not first
            self.stack.append(Node(key_below(self.stack[d - 1].key, turn), d, int.from_bytes(turn[DIGEST:]), first))
        self.stack[-1].add(n, least, 0, 0, 0, ends)
        self.before = path

    def end(self) -> None:
        for x in reversed(self.stack):
            self.carry_up(x)
        for x in self.stack:
            self.row(x, False)
        self.stack = []


def common(a: bytes, b: bytes) -> int:
    """Turns that two paths have in common from the beginning."""
    low, high = 0, min(len(a), len(b)) // TURN
    while low < high:
        middle = (low + high + 1) // 2
        if a[TURN * low : TURN * middle] == b[TURN * low : TURN * middle]:
            low = middle
        else:
            high = middle - 1
    return low


def swept(paths: DataFrame) -> DataFrame:
    """Nodes and fragments of sorted paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = Sweep(TaskContext.get().partitionId())
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                sweep.path(*row)
                if len(sweep.out) >= BATCH:
                    yield as_batch(sweep.out, NODE)
                    sweep.out = []
        sweep.end()
        for at in range(0, len(sweep.out), BATCH):
            yield as_batch(sweep.out[at : at + BATCH], NODE)

    return paths.select("path", "n", "least", "ends").mapInArrow(run, NODE_DDL)


def stitched(fragments: DataFrame) -> DataFrame:
    """Nodes of the fragments: at most the first and the last path of each range, read in order by one task that holds one path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[Node] = []
        out: list[tuple] = []

        def close() -> None:
            x = stack.pop()
            own = (x.n - 1) * x.words
            x.late_leaves, x.late_saved = x.late_leaves + (not x.children), x.late_saved + own
            above = None
            if stack:
                above = stack[-1].key
                stack[-1].late_leaves += x.late_leaves
                stack[-1].late_saved += x.late_saved
            out.append((None, 0, True, False, x.key, above, x.depth, x.words, x.n, x.least, x.children, x.leaves + x.late_leaves, x.saved + x.late_saved, x.ends))

        def join(part: list[tuple]) -> None:
            """One range: its first path is laid on the stack, what closed in it is closed, and what is new at its end is put on top."""
            closing = [r for r in part if r[2]]
            staying = [r for r in part if not r[2]]
            began = [r for r in staying if r[3]] + closing[::-1]  # the first path's prefixes by depth
            same = 0
            while same < min(len(stack), len(began)) and stack[same].key == began[same][4]:
                same += 1
            while len(stack) > same:
                close()
            for r in began:
                lay(r)
            for _ in closing:
                close()
            for r in staying:
                if not r[3]:
                    lay(r, counted=True)

        def lay(r: tuple, counted: bool = False) -> None:
            depth = r[6]
            if depth >= len(stack):
                if depth and not counted:
                    stack[-1].children += 1
                stack.append(Node(r[4], depth, r[7]))
            stack[depth].add(r[8], r[9], r[10], r[11], r[12], r[13])

        part: list[tuple] = []
        for batch in batches:
            for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if part and part[0][0] != r[0]:
                    join(part)
                    part = []
                part.append(r)
            if len(out) >= BATCH:
                yield as_batch(out, NODE)
                out.clear()
        if part:
            join(part)
        while stack:
            close()
        yield as_batch(out, NODE)

    return fragments.coalesce(1).sortWithinPartitions("part", "seq").mapInArrow(run, NODE_DDL)


def prefix_trie(arrays: DataFrame) -> DataFrame:
    """The nodes of conversations (conv_id, path): key, above (the parent's key), conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    made = staged(swept(sorted_paths(arrays)), "sweep")
    nodes = made.where("part is null").unionByName(stitched(made.where("part is not null")))
    nodes = staged(nodes.select("key", "above", "depth", F.col("least").alias("conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NO_IDS)).alias("ends_sha256")), "nodes")
    parents = nodes.where("n_children > 0").select(F.col("key").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(parents, "above", "left")


def trie(turns: DataFrame) -> DataFrame:
    """The nodes of rebuilt conversations, of turns (conv_id, turn, role, text)."""
    return prefix_trie(turn_arrays(turns)).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
