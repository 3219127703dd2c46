"""MinHash near-dedup by a multi-index Hamming join.

A document's set is its distinct shingles; its signature, ``positions`` MinHash values of 16 bits. Two signatures'
distance is the number of positions in which they differ. Split into chunks, signatures at a
distance under ``chunks * (errors + 1)`` agree in some chunk but for ``errors`` positions (pigeonhole); every
document emits, chunk by chunk, one key for each choice of positions left out, so such a pair
meets under an equal key, always. Signatures are of sets, and sets only show in them with chance: with
the defaults (8 chunks of 5, one error) a pair at similarity 0.85 meets in a given chunk with
probability 0.835, and in none with probability 6e-7; links are then confirmed on full sets.

Equal sets are one class, linked by nature, and only classes are joined. Under a key, every class is
first paired with the most central one, which meets most classes under all its keys; confirmed links make components, and only
pairs across components are compared further. Few classes under a key are compared one by one. Many are mostly near misses of
one text, alike in all but their differences from the central class, so there the differences are joined: two sets
differ from each other exactly where one of them differs from the centre and the other does not. Nothing is capped.

Nulls: a null, empty or wordless text has no set, is linked with nothing and is its own component.
A null id is a document like others and never names a component that has another id. Repeated rows are exact
copies. Very long texts are taken whole. An empty table gives an empty result. Ties are decided by the smallest id; only id and text are read, so other columns
may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.llm.text import packed, text_batches, text_key, unpacked
from girder.operators.components import connected_components
from girder.shared import staged


@dataclass(frozen=True)
class NearDup:
    """width: words in a shingle. Link at 100 * intersection >= percent * union.

    far: signature distance beyond which a candidate is dropped unconfirmed; at similarity 0.85 it is
    exceeded with probability under 1e-11 (binomial, 40 positions, 0.15 each).
    few: classes under a key, beyond which they are compared through their differences from its central one.
    """

    width: int = 3
    percent: int = 85
    chunks: int = 8
    per_chunk: int = 5
    errors: int = 1
    far: int = 25
    few: int = 16
    seed: int = 7

    @property
    def positions(self) -> int:
        return self.chunks * self.per_chunk

    @property
    def wide(self) -> int:
        """How many narrow rows a row with a signature is like."""
        return 2 + self.positions // 10


#: For a pipeline's near copies: five words, similarity 0.8. A pair at 0.8 meets in a chunk with
#: probability 0.737, and in none of 16 with probability 5e-10; ``far`` is exceeded with probability under 1e-6.
PIPELINE = NearDup(width=5, percent=80, chunks=16, per_chunk=5, far=36)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Each text's sorted distinct 64-bit shingle hashes; words are lower-cased A-Z, split at ASCII white space."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    factors = mixed(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    out = []
    for text in texts:
        found = text.lower().split()
        w = np.fromiter(map(digest, found), np.uint64, len(found))
        n = min(width, len(w))
        if not n:
            out.append(w)
            continue
        many = len(w) - n + 1
        s = np.full(many, n, np.uint64)
        for i in range(n):
            s += w[i : i + many] * factors[i]
        out.append(np.unique(mixed(s)))
    return out


def signatures(sets: list[np.ndarray], how: NearDup) -> np.ndarray:
    """Sets, none empty, by positions: 16 bits each of the smallest hash under that position's hash function."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    keys = mixed(np.arange(2 * how.positions, dtype=np.uint64) + np.uint64(how.seed << 20))
    out = np.empty((len(sets), how.positions), ">u2")
    for j in range(how.positions):
        least = np.minimum.reduceat((flat ^ keys[2 * j]) * (keys[2 * j + 1] | np.uint64(1)), starts)
        out[:, j] = (mixed(least) >> np.uint64(48)).astype(np.uint16)
    return out


def measured(docs: DataFrame, how: NearDup, keys: list[str], with_sets: bool = False) -> DataFrame:
    """keys, n_shingles, set_key (128 bits of the set), and the signature, or else the set, of each row's text."""
    kinds = "".join(f"`{k}` {t}, " for k, t in docs.select(*keys).dtypes)
    last = "shingles array<long>" if with_sets else "signature binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for part in text_batches(batches, len(keys)):
            sets = shingle_sets([x.as_py() or b"" for x in part.column(part.num_columns - 1)], how.width)
            full = [i for i, s in enumerate(sets) if len(s)]
            names = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            if with_sets:
                tail = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            else:
                marks: list = [None] * len(sets)
                if full:
                    for i, row in zip(full, signatures([sets[i] for i in full], how), strict=True):
                        marks[i] = row.tobytes()
                tail = pa.array(marks, pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(list(map(len, sets)), pa.int64()), pa.array(names, pa.binary()), tail], [*keys, "n_shingles", "set_key", last.split()[0]])

    return docs.select(*keys, F.col("text").cast("binary").alias("_text")).mapInArrow(run, f"{kinds}n_shingles long, set_key binary, {last}")


def chunk_keys(signature: Column, how: NearDup) -> Column:
    """One key for each chunk and each choice of positions left out of it."""
    out = []
    for chunk in range(how.chunks):
        for left_out in combinations(range(how.per_chunk), how.errors):
            kept = [F.substring(signature, 2 * (chunk * how.per_chunk + i) + 1, 2) for i in range(how.per_chunk) if i not in left_out]
            out.append(F.xxhash64(F.lit(chunk), F.lit(sum(1 << i for i in left_out)), *kept))
    return F.array(*out)


def distance(a: Column, b: Column, how: NearDup) -> Column:
    """Positions in which two signatures differ."""
    return sum((F.substring(a, 2 * i + 1, 2) != F.substring(b, 2 * i + 1, 2)).cast("int") for i in range(how.positions))


def near(a: str, b: str, how: NearDup) -> Column:
    """Whether sizes and signatures leave a link possible; prefixes name the sides' columns."""
    small, large = F.least(f"{a}_n", f"{b}_n"), F.greatest(f"{a}_n", f"{b}_n")
    return (100 * small >= how.percent * large) & (distance(F.col(f"{a}_s"), F.col(f"{b}_s"), how) <= how.far)


def confirmed(pairs: DataFrame, sets: DataFrame, how: NearDup) -> DataFrame:
    """Those of the (a, b) pairs whose full sets are similar enough."""
    for end in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(end), F.col("shingles").alias(f"{end}_set")), end)
    both = F.size(F.array_intersect("a_set", "b_set")).cast("long")
    union = F.size("a_set") + F.size("b_set") - both
    return pairs.where(100 * both >= how.percent * union).select("a", "b")


#: Differences to shingles of a set, up to which a member is held to be near its centre.
NEAR = 0.6
#: The centre of those that are near none: the empty set.
NO_CENTRE = -1


def differences(members: DataFrame, sets: DataFrame, how: NearDup) -> DataFrame:
    """(hub, node, n, m, dn, d, far) of members (hub, node): sizes of both sets, and the shingles in which they differ.

    Two linked sets differ in at most r = (100 - percent) / percent of either's size. So where one has at most ``NEAR`` times its size of
    differences, both have at most NEAR * (1 + r) + r times it, and keep them in ``d``. ``far`` are all beyond NEAR.
    """
    r = (100 - how.percent) / how.percent
    x, h = sets.select("node", "shingles"), sets.select(F.col("node").alias("hub"), F.col("shingles").alias("centre"))
    both = members.join(x, "node").join(h, "hub").withColumn("d", F.concat(F.array_except("shingles", "centre"), F.array_except("centre", "shingles")))
    t = both.select("hub", "node", F.size("shingles").alias("n"), F.size("centre").alias("m"), F.size("d").alias("dn"), "d")
    return t.withColumns({"d": F.when(F.col("dn") <= (NEAR * (1 + r) + r + 1e-9) * F.col("n"), F.col("d")), "far": F.col("dn") > NEAR * F.col("n")})


def differing(rows: DataFrame) -> DataFrame:
    """(hub, node, n, dn, tokens) of rows (hub, node, n, d): the number of differences, and those that another member has too, the rarest first."""
    each = rows.select("hub", "node", "n", F.size("d").alias("dn"), F.explode("d").alias("token"))
    often = each.groupBy("hub", "token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    return each.join(often, ["hub", "token"]).groupBy("hub", "node", "n", "dn").agg(F.array_sort(F.collect_list(F.struct("df", "token")))["token"].alias("tokens"))


def rarest(common: DataFrame, how: NearDup) -> DataFrame:
    """Rows of ``differing`` once for each of their rarest tokens, ``token``.

    Of a member's ``dn`` differences from the centre all but (100 - percent) / percent of its size are differences of a linked set too.
    In any common order, here by frequency, the first tokens of both then meet, and they are so many fewer as more must be shared.
    """
    least = F.greatest(F.lit(1), F.col("dn") - F.floor((100 - how.percent) * F.col("n") / how.percent))
    # Tokens of one member alone are the rarest of all and meet none.
    first = F.greatest(F.lit(0), F.size("tokens") - least + 1).cast("int")
    return common.withColumn("token", F.explode(F.slice("tokens", 1, first)))


def alike(sizes: Column, apart: Column, how: NearDup) -> Column:
    """Whether sets of these sizes together, with so many shingles that one of them lacks, are linked."""
    return (100 + how.percent) * (sizes - apart) >= 2 * how.percent * sizes


def linked_by_differences(rows: DataFrame, how: NearDup) -> DataFrame:
    """(a, b), once: linked pairs of rows of ``rarest`` with their ``component`` and the centre's, ``centre``, of different components.

    Members outside the centre's component are held against all that share a rare token, at the rarest that they share. The test is exact: the sets differ in
    what is a difference of one of them alone.
    """
    side = lambda x: ["hub", "token", *[F.col(c).alias(f"{x}{d}") for c, d in (("node", ""), ("component", "_c"), ("n", "_n"), ("dn", "_dn"), ("tokens", "_t"))]]
    one, two = rows.where("component <> centre").select(*side("a")), rows.select(*side("b"), (F.col("component") == F.col("centre")).alias("in_centre"))
    other = (F.col("a_c") != F.col("b_c")) & (F.col("in_centre") | (F.col("a") < F.col("b")))
    # The rarest token that two linked members share is one of the first of both.
    hit = other & near_differences(how) & (F.col("token") == F.get(F.array_intersect("a_t", "b_t"), F.lit(0)))
    return one.join(two, ["hub", "token"]).where(hit).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_differences(how: NearDup) -> Column:
    """Whether sides a and b of one hub, with their sizes, numbers of differences and shared tokens, are linked."""
    close = lambda shared: alike(F.col("a_n") + F.col("b_n"), F.col("a_dn") + F.col("b_dn") - 2 * shared, how)
    return close(F.least(F.size("a_t"), F.size("b_t"))) & close(F.size(F.array_intersect("a_t", "b_t")))


def linked_to_first(rows: DataFrame, how: NearDup) -> DataFrame:
    """(a, b, a_c, b_c): links of rows of ``rarest`` with the first of their hub and token, if that is of another component: a link a row at most."""
    side = lambda x: [F.col(c).alias(f"{x}{d}") for c, d in (("node", ""), ("component", "_c"), ("n", "_n"), ("dn", "_dn"), ("tokens", "_t"))]
    first = rows.groupBy("hub", "token").agg(F.min(F.struct("dn", "node", "component", "n", "tokens")).alias("f")).select("hub", "token", "f.*").select("hub", "token", *side("a"))
    hit = (F.col("a_c") != F.col("b_c")) & near_differences(how)
    return rows.select("hub", "token", *side("b")).join(first, ["hub", "token"]).where(hit).select("a", "b", "a_c", "b_c").distinct()


def across(rows: DataFrame, key: str, how: NearDup) -> DataFrame:
    """(a, b), once: pairs of rows (key, node, component, n, s) under one key whose components differ and that may be linked.

    Under a key every row outside its largest component is held against all, so members of the largest are never paired.
    """
    counts = rows.groupBy(key, "component").agg(F.count(F.lit(1)).alias("c"))
    major = counts.groupBy(key).agg(F.max(F.struct("c", "component")).alias("m"), F.count(F.lit(1)).alias("k")).where("k > 1")
    t = rows.join(major.select(key, F.col("m.component").alias("major")), key)
    side = lambda x: [F.col(key).alias(key), *[F.col(c).alias(f"{x}{d}") for c, d in (("node", ""), ("component", "_c"), ("n", "_n"), ("s", "_s"))]]
    one, two = t.where("component <> major").select(*side("a")), t.select(*side("b"), (F.col("component") == F.col("major")).alias("in_major"))
    apart = (F.col("a_c") != F.col("b_c")) & (F.col("in_major") | (F.col("a") < F.col("b")))
    return one.join(two, key).where(apart & near("a", "b", how)).select("a", "b").distinct()


def near_links(docs: DataFrame, classes: DataFrame, how: NearDup) -> tuple[DataFrame, DataFrame | None]:
    """Links between classes that connect what any confirmed pair connects, and their components if they are known."""
    keyed = classes.select(F.explode(chunk_keys(F.col("signature"), how)).alias("key"), "node")
    several = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    shared = staged(keyed.join(several, "key"), "keys")
    # Tables of ids and numbers made from these two alone are as narrow, and no longer.
    most = shared.count() + classes.count()
    sides = classes.select("node", F.col("n_shingles").alias("n"), F.col("signature").alias("s"))

    def possible(pairs: DataFrame) -> DataFrame:
        for end in ("a", "b"):
            pairs = pairs.join(sides.select(F.col("node").alias(end), F.col("n").alias(f"{end}_n"), F.col("s").alias(f"{end}_s")), end)
        return pairs.where(near("a", "b", how)).select("a", "b")

    def sets_of(nodes: DataFrame) -> DataFrame:
        # The sets of these classes, made from the text of the rows of the class's smallest id.
        named = staged(nodes.join(classes.select("node", "set_key", "min_id", "mark"), "node"), "named", most, heavy=True)
        ids = named.select(F.col("min_id").alias("_id"), F.col("mark").alias("_its")).distinct()
        rows = docs.join(ids, docs["doc_id"].eqNullSafe(ids["_id"]) & (docs["_mark"] == ids["_its"]), "left_semi")
        made = measured(rows, how, [], with_sets=True).dropDuplicates(["set_key"])
        return staged(made.join(named.select("set_key", "node"), "set_key").select("node", "shingles"), "sets")

    def checked(pairs: DataFrame) -> DataFrame:
        """The pairs whose sets are similar enough, stored."""
        many = pairs.count()
        ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        return staged(confirmed(pairs, sets_of(ends), how), "links", many, heavy=True)

    central = shared.groupBy("node").agg(F.sum("many").alias("met"))
    hubs = staged(shared.join(central, "node").groupBy("key").agg(F.max(F.struct("met", "node"))["node"].alias("hub")), "hubs", most)
    first = shared.join(hubs, "key").where("node != hub").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()
    links = checked(staged(possible(first), "star", most * how.wide))
    parts = connected_components(links)
    parted = lambda t, node="node", name="component": t.join(parts.select(F.col("id").alias(node), F.col("component").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))
    at = staged(parted(shared.select("key", "node")), "members", most)
    several = at.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("many")).where("x < y")
    several = staged(several.select("key", (F.col("many") > how.few).alias("large")), "several", most)
    left, found = staged(at.join(several, "key"), "left", most), False
    pairs = staged(across(left.where("not large").drop("large").join(sides, "node"), "key", how), "rest")
    if not pairs.isEmpty():
        links, found = links.unionByName(checked(pairs)), True
    # A key's centre is the most central class of the component of its hub; few centres make few tables of differences.
    tops = staged(parted(central).groupBy("component").agg(F.max(F.struct("met", "node"))["node"].alias("top")).withColumnRenamed("component", "centre"), "tops", most)
    members = left.where("large").join(hubs, "key").select("hub", "node", "component").distinct()
    members = parted(members, "hub", "centre").join(tops, "centre").where("node != top").select(F.col("top").alias("hub"), "node", "component", "centre").distinct()
    members = staged(members, "large", most)
    if not members.isEmpty():
        nodes = members.select("node").unionByName(members.select(F.col("hub").alias("node"))).distinct()
        sets = sets_of(nodes)
        apart = staged(differences(members.select("hub", "node"), sets, how), "differences")
        direct = apart.where(alike(F.col("n") + F.col("m"), F.col("dn"), how)).select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"))
        close = apart.where("d is not null").select("hub", "node", "n", "d").join(members, ["hub", "node"])
        lost = apart.where("far").select("node").distinct().join(sets, "node")
        lost = parted(lost).select(F.lit(NO_CENTRE).cast("long").alias("hub"), "node", F.size("shingles").alias("n"), F.col("shingles").alias("d"), "component", F.lit(NO_CENTRE).cast("long").alias("centre"))
        kinds = staged(close.unionByName(lost), "kinds")
        common = differing(kinds).join(kinds.select("hub", "node", "component", "centre"), ["hub", "node"])
        rows = rarest(staged(common, "common"), how)
        # Near copies of one another are linked through the first of a token, so only what is still apart is held against each other.
        star = staged(linked_to_first(rows, how), "firsts")
        names = connected_components(star, "a_c", "b_c")
        for c in ("component", "centre"):
            rows = rows.join(names.select(F.col("id").alias(c), F.col("component").alias("_name")), c, "left").withColumn(c, F.coalesce("_name", c)).drop("_name")
        rest = linked_by_differences(staged(rows, "rows"), how)
        links, found = links.unionByName(staged(rest.unionByName(direct).unionByName(star.select("a", "b")), "links")), True
    return links, None if found else parts


def components(docs: DataFrame, how: NearDup = NearDup(), keys: list[str] | None = None) -> DataFrame:
    """keys, n_shingles, component_id (smallest doc_id reachable) and component (its number, null without a set) of every row of documents (doc_id, text)."""
    keys = ["doc_id"] if keys is None else keys
    docs = docs.select(*keys, "text", F.xxhash64("text").alias("_mark"))
    rows = staged(measured(docs, how, [*keys, "_mark"]), "signatures")
    # A class is read again from the row of its smallest id, named by id and hash of the text, as an id alone may be null or repeated.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_mark")).alias("first")
    classes = rows.where(F.col("set_key").isNotNull()).groupBy("set_key").agg(first, F.max("n_shingles").alias("n_shingles"), F.max("signature").alias("signature"))
    classes = classes.select("set_key", F.col("first.doc_id").alias("min_id"), F.col("first._mark").alias("mark"), "n_shingles", "signature")
    classes = staged(classes.withColumn("node", F.monotonically_increasing_id()), "classes", rows.count() * how.wide)
    links, parts = near_links(docs, classes, how)
    parts = connected_components(links) if parts is None else parts
    of = classes.join(parts.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = of.groupBy("component").agg(F.min("min_id").alias("component_id"))
    named = of.select("set_key", "component").join(least, "component").select("set_key", "component_id", "component")
    out = [*keys, "n_shingles", "component_id", "component"]
    linked = rows.drop("signature").join(named, "set_key").select(*out)
    alone = rows.where(F.col("set_key").isNull()).withColumns({"component_id": F.col("doc_id"), "component": F.lit(None).cast("long")}).select(*out)
    return linked.unionByName(alone)


def near_duplicates(docs: DataFrame, how: NearDup = NearDup()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    return components(docs, how).drop("component").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, how: NearDup = NearDup()) -> DataFrame:
    """One row of every component: one with its smallest id. A wordless text is linked with nothing, so each of its rows stays.

    Rows are named by id and digest of the text; of rows that are equal in both one stays.
    """
    rows = docs.select(packed(docs).alias("_doc"), F.col("doc_id").alias("_id"), text_key(F.col("text")).alias("_digest"))
    flat = docs.select("doc_id", "text").withColumn("_digest", text_key(F.col("text")))
    found = components(flat, how, ["doc_id", "_digest"]).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    texts = found.groupBy("component", F.col("doc_id").alias("_i"), F.col("_digest").alias("_t")).agg(F.count(F.lit(1)).alias("copies"))
    # Texts of one component under its smallest id differ in case or white space at most a little; the first by digest stays.
    first = texts.where("component is not null").groupBy("component").agg(F.min(F.struct("_t", "_i", "copies")).alias("m")).select("m.*")
    kept = staged(first.unionByName(texts.where("component is null").select("_t", "_i", F.lit(1).cast("long").alias("copies"))), "kept")
    alone, several = kept.where("copies = 1"), kept.where("copies > 1")
    match = lambda t: rows["_id"].eqNullSafe(t["_i"]) & (rows["_digest"] == t["_t"])
    one = rows.join(alone, match(alone), "left_semi")
    many = rows.join(several, match(several), "left_semi").dropDuplicates(["_id", "_digest"])
    return unpacked(one.unionByName(many), docs.columns)
