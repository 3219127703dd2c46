"""Mixing sources to target weights, by Sainte-Laguë apportionment.

The mix is counted in blocks of equally many words. Blocks go to the sources by
highest quotients ``votes / (2 * seats + 1)``, then a source's blocks go to its shards
the same way with the shards' sizes as votes, which leaves each shard an integer quota. A block
is one word where a source is so small that larger ones would miss its target.
Within a shard the documents lie end to end in a seeded order. Its quota takes the whole line as often as it holds
it, and the rest in seeded runs of ``run_words``, spread evenly. Only narrow rows are ever shuffled, never texts.

Rows are known by id and a hash of their content; equal rows are interchangeable and are counted, so the mix depends on
neither the partitions nor the order of the table, and a row that stands very often is spread over the shards.

Nulls: a null text has size 0; null is a source of its own, ranked last; null ids are
ordinary ids. Repeated rows count as many times as they stand, and may be taken differently. Sources without words get
target 0. An empty table gives an empty mix. Very long texts are lines like others. Columns beyond those named are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girder.llm.text import let, n_words
from girder.operators.selection import dense_ids, running_sums
from girder.shared import staged


@dataclass(frozen=True)
class Mix:
    """share: words of the mix to words of the input. cap: a source's target to its own size, at most.

    block_words: words of a block, at most; fine: blocks of the smallest target, at least. A shard has about shard_words words, and a source
    at most ``shards`` shards. copies: equal rows that stay together. broadcast_rows bounds the tables of sources and shards that are broadcast.
    """

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    cap: int = 2
    block_words: int = 16
    fine: int = 32
    run_words: int = 16
    shard_words: int = 1 << 20
    shards: int = 4096
    copies: int = 1024
    seed: int = 20240117
    broadcast_rows: int = 50_000


def hinted(df: DataFrame, most: int) -> DataFrame:
    """Broadcast a stored table only if it is shown to have at most that many rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def source_targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """(skey, source_size, target, n_shards, place) from (skey, size) rows.

    Sharing the excess until no source is above its cap is filling vessels to a common
    level: with the sources in order of cap / weight, the level is the largest of
    (total - caps before) / (weights from here on). Ranks and sums go over ranges, so no task sees all sources.
    """
    every = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"))
    every = dense_ids(every, ["skey"], name="place")
    n = len(mix.weights)
    every = every.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in mix.weights]), ((F.col("place") - 1) % n + 1).cast("int")))
    every = every.withColumn("most", F.lit(mix.cap) * F.col("source_size")).withColumn("fill", F.col("most") / F.col("weight"))
    every = staged(running_sums(every, ["fill", "place"], {"lighter": F.col("weight"), "capped": F.col("most")}), "sources")
    whole = every.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weights")).first()
    total = F.lit(mix.share) * F.lit(whole["words"])
    level = every.agg(F.max((total - F.col("capped")) / (F.lit(whole["weights"]) - F.col("lighter")))).first()[0]
    target = F.least(F.col("most").cast("double"), F.col("weight") * F.lit(float(level or 0)))
    shards = F.least(F.lit(mix.shards), F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.lit(mix.shard_words))))
    return every.select("skey", "source_size", target.alias("target"), shards.cast("long").alias("n_shards"), "place")


def quotients(t: DataFrame, rows: Column) -> DataFrame:
    """The quotients that can decide the last seats: t has votes, fair, base and lack; a row of a group of so many needs no more.

    Starting from every row's rounded fair share, which is the outcome at one divisor, only the few seats by which the sum differs
    are dealt or taken back, by their quotients. A row can need at most its own share of 1.5 seats a row of the group.
    """
    reach = F.ceil(1.5 * rows * F.col("fair") + 1)
    c = t.where("lack <> 0").withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), reach.cast("long"))))
    seat = F.when(F.col("lack") > 0, F.col("base") + F.col("j")).otherwise(F.col("base") - 1 - F.col("j"))
    c = c.withColumn("quotient", F.col("votes") / (2 * seat + 1)).where(F.when(F.col("lack") > 0, F.col("votes") > 0).otherwise(seat >= 0))
    return c.withColumn("turn", F.when(F.col("lack") > 0, -F.col("quotient")).otherwise(F.col("quotient")))


def with_seats(t: DataFrame, dealt: DataFrame, key: list[str]) -> DataFrame:
    moved = F.coalesce("dealt", F.lit(0)) * F.signum("lack")
    out = t.join(dealt.groupBy(*key).agg(F.count(F.lit(1)).alias("dealt")), key, "left")
    return out.withColumn("seats", (F.col("base") + moved).cast("long")).drop("fair", "base", "lack", "dealt")


def apportion(votes: DataFrame, group: list[str], seats: Column) -> DataFrame:
    """Add ``seats``: each group's number of seats, dealt to its rows by highest quotients.

    votes: rows with ``votes`` (double), ``place`` (breaks ties, unique in the group). A group is one task's work.
    """
    of = Window.partitionBy(*group)
    t = votes.withColumn("all_seats", seats).withColumns({"all_votes": F.sum("votes").over(of), "n_rows": F.count(F.lit(1)).over(of)})
    fair = F.when(F.col("all_votes") > 0, F.col("votes") / F.col("all_votes")).otherwise(0.0)
    t = t.withColumn("fair", fair).withColumn("base", F.floor(F.col("fair") * F.col("all_seats") + 0.5))
    t = t.withColumn("lack", F.when(F.col("all_votes") > 0, F.col("all_seats") - F.sum("base").over(of)).otherwise(F.lit(0)))
    c = quotients(t, F.col("n_rows")).withColumn("nth", F.row_number().over(of.orderBy("turn", "place", "j")))
    return with_seats(t, c.where(F.col("nth") <= F.abs("lack")), [*group, "place"]).drop("all_seats", "all_votes", "n_rows")


def apportion_all(votes: DataFrame, seats: int) -> DataFrame:
    """The same with all rows in one group, over as many tasks as there are ranges. votes is a stored table or a projection of one."""
    whole = votes.agg(F.sum("votes").alias("votes"), F.count(F.lit(1)).alias("rows")).first()
    share = F.col("votes") / F.lit(whole["votes"]) if whole["votes"] else F.lit(0.0)
    t = votes.withColumn("fair", share).withColumn("base", F.floor(F.col("fair") * F.lit(seats) + 0.5))
    lack = seats - (t.agg(F.sum("base")).first()[0] or 0) if whole["votes"] else 0
    t = t.withColumn("lack", F.lit(lack))
    c = quotients(t, F.lit(whole["rows"]))
    last = dense_ids(c.select("turn", "place", "j"), ["turn", "place", "j"], name="nth").where(F.col("nth") <= abs(lack)) if lack else c
    return with_seats(t, last, ["place"])


def source_key(source: Column) -> Column:
    """A key without nulls that sorts as the sources do by code point, null last."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), source))


#: What tells rows apart: the id and 128 bits of the content.
ROW = ["at", "mark", "other_mark"]


def marks(*columns: Column) -> list[Column]:
    return [F.xxhash64(*columns).alias("mark"), F.xxhash64(F.lit(1), *columns).alias("other_mark")]


def taken(sized: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix over (at, mark, other_mark, skey, size) rows: one row for up to ``copies`` equal rows.

    Adds copies, source_size, target, and how the shard's line is taken: the copies begin at word ``start``; the line of ``line``
    words is taken ``rounds`` times, and once more in ``runs`` runs of ``extra`` words together, ``phase`` words on.
    """
    rows = staged(sized.groupBy("skey", "size", *ROW).agg(F.count(F.lit(1)).alias("n")), "sizes")
    sources = source_targets(rows.select("skey", (F.col("size") * F.col("n")).alias("size")), mix)
    some = sources.agg(F.sum("target").alias("words"), F.min(F.when(F.col("target") > 0, F.col("target"))).alias("least")).first()
    block = max(1, min(mix.block_words, int((some["least"] or 0) // mix.fine)))
    seats = apportion_all(sources.withColumn("votes", F.col("target")), round((some["words"] or 0) / block))
    sources = staged(seats.select("skey", "source_size", "target", "n_shards", F.col("seats").alias("blocks")), "quotas")
    last = F.floor((F.col("n") - 1) / mix.copies).cast("int")
    each = rows.withColumn("part", F.explode(F.sequence(F.lit(0), last)))
    each = each.withColumn("copies", F.least(F.lit(mix.copies), F.col("n") - F.col("part") * mix.copies).cast("int"))
    name = [F.lit(mix.seed), *ROW, "part"]
    placed = each.join(hinted(sources, mix.broadcast_rows), "skey").withColumn("shard", F.pmod(F.xxhash64(*name), F.col("n_shards")))
    words = F.col("size") * F.col("copies")
    shards = placed.groupBy("skey", "shard").agg(F.sum(words).alias("line"), F.first("blocks").alias("blocks"))
    shards = shards.withColumn("votes", F.col("line").cast("double")).withColumn("place", F.col("shard"))
    quota = F.least(F.col("seats") * block, mix.cap * F.col("line")).cast("long")
    length = F.greatest(F.col("line"), F.lit(1))
    quotas = apportion(shards, ["skey"], F.col("blocks")).select("skey", "shard", length.alias("line"), quota.alias("quota"))
    quotas = quotas.withColumns({"rounds": div(F.col("quota"), F.col("line")), "extra": F.col("quota") % F.col("line")})
    quotas = quotas.withColumn("runs", F.greatest(F.lit(1), F.round(F.col("extra") / mix.run_words)).cast("long"))
    quotas = staged(quotas.withColumn("phase", F.pmod(F.xxhash64(F.lit(mix.seed + 2), "skey", "shard"), F.col("line"))), "shards")
    line = Window.partitionBy("skey", "shard").orderBy(F.xxhash64(F.lit(mix.seed + 1), *ROW, "part"), *ROW, "part", "size").rowsBetween(Window.unboundedPreceding, -1)
    t = placed.drop("blocks", "n_shards").join(hinted(quotas.drop("quota"), mix.broadcast_rows), ["skey", "shard"])
    return t.withColumn("start", F.coalesce(F.sum(words).over(line), F.lit(0)))


def run_start(i: Column) -> Column:
    """Where run i of the line begins: runs and the gaps after them are as even as whole words allow."""
    return div(i * F.col("extra"), F.col("runs")) + div(i * (F.col("line") - F.col("extra")), F.col("runs"))


def run_at(word: Column) -> Column:
    """The run, or the gap after it, that holds a word of the line: the last that begins there or before."""
    guess = div(word * F.col("runs"), F.col("line"))
    return guess + (run_start(guess + 1) <= word).cast("long")


def extra_before(word: Column) -> Column:
    """Words taken once more among the first ``word`` words of the line, which begins again where it ends, ``phase`` words on."""

    def counted(y):
        def within(x):
            i = run_at(x)
            before = div(i * F.col("extra"), F.col("runs"))
            return before + F.least(x - run_start(i), div((i + 1) * F.col("extra"), F.col("runs")) - before)

        return div(y, F.col("line")) * F.col("extra") + within(y % F.col("line"))

    return counted(word + F.col("phase"))


def once_more(pieces: Column, begin: Column) -> Column:
    """The words of a document, as an array, that its runs take; ``begin``: where it lies in the line."""

    def of(y):
        line, runs = F.col("line"), F.col("runs")
        index = lambda word: div(word, line) * runs + run_at(word % line)

        def taken(i):
            at = div(i, runs) * line + run_start(i % runs)
            size = div((i % runs + 1) * F.col("extra"), runs) - div(i % runs * F.col("extra"), runs)
            first = F.greatest(at - y, F.lit(0).cast("long"))
            many = F.least(at + size - y, F.col("size")) - first
            return F.slice(pieces, (first + 1).cast("int"), F.greatest(many, F.lit(0)).cast("int"))

        return F.flatten(F.transform(F.sequence(index(y), index(y + F.col("size") - 1)), taken))

    return let(begin + F.col("phase"), of)


def mix_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, size, source_size, target, taken for documents (doc_id, source, text)."""
    sized = docs.select(F.col("doc_id").alias("at"), *marks(F.col("text")), source_key(F.col("source")).alias("skey"), n_words(F.col("text")).alias("size"))
    each = taken(sized, mix).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    begin = F.col("start") + F.col("copy") * F.col("size")
    words = F.col("rounds") * F.col("size") + extra_before(begin + F.col("size")) - extra_before(begin)
    return each.select(F.col("at").alias("doc_id"), "size", "source_size", "target", words.cast("long").alias("taken"))


def hashable(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]


def mixed_texts(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix itself: the documents' rows with the words that the mix takes.

    A document taken r whole times gives r equal rows; the runs taken once more give
    one row with those words and the white space after them. Rows are matched to their place by id and content;
    of equal rows one is read and gives the rows of all.
    """
    mark = marks(*hashable(docs))
    sized = docs.select(F.col("doc_id").alias("at"), *mark, source_key(F.col("source")).alias("skey"), n_words(F.col("text")).alias("size"))
    rule = staged(taken(sized, mix).where("size > 0 and (rounds > 0 or extra > 0)").drop("skey", "shard", "source_size", "target"), "rule")
    own = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in own.items()], F.col("doc_id").alias("_at"), mark[0].alias("_mark"), mark[1].alias("_other"))
    body = F.col(own["text"])
    same = lambda t: rows["_at"].eqNullSafe(t["at"]) & (rows["_mark"] == t["mark"]) & (rows["_other"] == t["other_mark"])
    each, several = rule.where("n = 1"), rule.where("n > 1")
    placed = rows.join(each, same(each))
    if not several.isEmpty():
        names = several.select(*ROW).distinct()
        one = rows.join(names, same(names), "left_semi").dropDuplicates(["_at", "_mark", "_other"])
        same_one = one["_at"].eqNullSafe(several["at"]) & (one["_mark"] == several["mark"]) & (one["_other"] == several["other_mark"])
        placed = placed.unionByName(one.join(several, same_one))
    placed = placed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    begin = F.col("start") + F.col("copy") * F.col("size")
    pieces = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    part = F.when(F.col("extra") > 0, let(pieces, lambda w: F.array_join(once_more(w, begin), ""))).otherwise(F.lit(""))
    text = F.concat(F.array_repeat(body, F.col("rounds").cast("int")), F.filter(F.array(part), lambda x: x != ""))
    both = placed.withColumn("_text", F.explode(text))
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return both.select(*[new.get(c, F.col(k)).alias(c) for c, k in own.items()])
