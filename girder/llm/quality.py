"""Quality rules as a short-circuit cascade.

Every rule has a predicate that rejects. On a sample the rules' costs are
timed and their rejections counted, and the cascade asks them in order of rejections per
cost among the documents that are left, so that a cheap rule that rejects much spares the dear ones. The order decides only how much is
computed: a document is kept exactly if no rule rejects it, so ties in the order do no harm.

Nulls: a null text is an empty one, with no words; it fails the base rule. An empty
table gives an empty result. Repeated rows are judged each for itself. Very long texts are judged whole, in time that grows with length times its logarithm.
Other columns of the table are left alone. All is built from
DataFrame functions inside one projection; nothing is shuffled.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.llm.text import WORD, let, n_words, words
from girder.shared import staged

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def n_lines(text: Column) -> Column:
    """Lines with a word."""
    return F.size(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def covered(starts: Column) -> Column:
    """Words in windows of three at these ascending starts."""
    seen = F.aggregate(
        starts,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n"), (p + 3).cast("int").alias("end")),
    )
    return seen["n"]


def repeated_starts(keys: Column, at, same) -> Column:
    """Ascending positions of the sorted keys that are the same as a neighbour."""

    def found(k):
        again = F.transform(F.sequence(F.lit(1), F.size(k)), lambda i: (i > 1) & same(F.get(k, i - 2), F.get(k, i - 1)))
        either = lambda f: F.filter(k, lambda _, i: F.get(f, i) | F.coalesce(F.get(f, i + 1), F.lit(False)))
        return F.sort_array(F.transform(let(again, either), at))

    return let(keys, found)


def n_repeat_words(text_words: Column) -> Column:
    """Words that lie in a window of three consecutive words found twice or more in the text.

    Windows are hashed; a text without equal hashes ends there. Else the hashes are sorted
    with their place in the low bits, as plain longs, and neighbours compared: their high bits first, then
    the words themselves. Should equal high bits ever belong to different words, the text's windows are
    sorted as strings instead, so the count is that of the words, not of hashes.
    """

    def count(w):
        n = F.size(w) - 2
        places = F.sequence(F.lit(0), n - 1)
        gram = lambda i: [F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)]
        low = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n))) - 1
        hashes = F.transform(places, lambda i: F.xxhash64(*gram(i)))

        def sorted_longs(h):
            def by_mask(mask):
                keys = F.array_sort(F.transform(h, lambda x, i: x.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long"))))
                at = lambda x: x.bitwiseAND(mask).cast("int")
                near = lambda x, y: x.bitwiseOR(mask) == y.bitwiseOR(mask)
                equal = lambda x, y: (F.get(w, at(x)) == F.get(w, at(y))) & (F.get(w, at(x) + 1) == F.get(w, at(y) + 1)) & (F.get(w, at(x) + 2) == F.get(w, at(y) + 2))

                def decide(k):
                    clash = F.exists(F.sequence(F.lit(1), F.size(k) - 1), lambda i: near(F.get(k, i - 1), F.get(k, i)) & ~equal(F.get(k, i - 1), F.get(k, i)))
                    return F.when(F.size(k) < 2, F.lit(0).cast("long")).when(clash, by_string()).otherwise(covered(repeated_starts(k, at, near)))

                return let(keys, decide)

            return let(low, by_mask)

        def by_string():
            keys = F.sort_array(F.transform(places, lambda i: F.struct(F.concat_ws(" ", *gram(i)).alias("g"), i.alias("i"))))
            return covered(repeated_starts(keys, lambda x: x["i"], lambda x, y: x["g"] == y["g"]))

        some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(sorted_longs(h)))
        return F.when(n < 2, F.lit(0).cast("long")).otherwise(some)

    return let(text_words, count)


@dataclass(frozen=True)
class Rule:
    """rejects: true where the rule turns a document away, over the columns of ``measured``."""

    name: str
    rejects: Column


def share(part: Column, percent: int, whole: Column) -> Column:
    return 100 * part > percent * whole


def measures(text: Column) -> dict[str, Column]:
    return {
        "n_words": n_words(text),
        "word_chars": word_chars(text),
        "n_symbols": n_symbols(text),
        "n_dup_lines": n_dup_lines(text),
        "n_repeat_words": n_repeat_words(words(text)),
    }


def base_failed(m: dict[str, Column]) -> Column:
    return (m["n_words"] < 50) | share(m["n_repeat_words"], 50, m["n_words"])


def rules(text: Column, m: dict[str, Column]) -> list[Rule]:
    """The rules of the verdict beyond the base; m has the measures, as columns or expressions."""
    return [
        Rule("symbols", share(m["n_symbols"], 10, m["n_words"])),
        Rule("word_length", (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 20 * m["n_words"])),
        Rule("exclaiming", share(F.regexp_count(text, F.lit("[!?]")), 50, m["n_words"])),
        Rule("shouting", share(F.length(text) - F.length(F.regexp_replace(text, r"[A-Z]", "")), 50, m["word_chars"])),
        Rule("letters", share(F.length(F.regexp_replace(text, r"[\p{L}\p{M}]+", "")) - F.length(text) + m["word_chars"], 40, m["word_chars"])),
        Rule("lines", (m["n_dup_lines"] >= 3) & share(m["n_dup_lines"], 30, n_lines(text))),
    ]


def greedy(rejected: list[list[bool]], cost: list[float]) -> list[int]:
    """The order of rules by rejections per cost, each counted over the rows that the rules before it let pass; rules that reject no more come last, cheap ones first."""
    left, order = list(range(len(rejected))), []
    rules = list(range(len(cost)))
    while rules:
        worth = {k: sum(rejected[i][k] for i in left) / cost[k] for k in rules}
        best = max(rules, key=lambda k: (worth[k], -cost[k], -k))
        order.append(best)
        rules.remove(best)
        left = [i for i in left if not rejected[i][best]]
    return order


def cascade_order(docs: DataFrame, sample_rows: int = 256, times: int = 4) -> list[str]:
    """Names of the rules in the cascade's order, estimated on a bounded sample.

    The sample is up to sample_rows texts whose hash is a multiple of 16, from the partitions read first; it sets the order only. A
    rule's cost is what ``times`` evaluations of all sampled texts in one job take beyond a job that only counts them, at the second run, so
    that starting the job and generating its code count for little.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    some = staged(docs.select(text.alias("text")).where(F.pmod(F.xxhash64(text), F.lit(16)) == 0).limit(sample_rows), "rules")
    t = F.col("text")
    m = measures(t)
    every = [Rule("base", base_failed(m)), *rules(t, m)]
    rejected = [list(r) for r in some.select(*[r.rejects.alias(r.name) for r in every]).collect()]

    again = some.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(times))))

    def seconds(rejects: Column) -> float:
        for _ in range(2):
            began = time.perf_counter()
            again.agg(F.count_if(rejects)).first()
        return time.perf_counter() - began

    start = seconds(t.isNull())
    cost = [max(1e-5, (seconds(r.rejects) - start) / times) for r in every]
    return [every[k].name for k in greedy(rejected, cost)]


def cascade(by_name: dict[str, Column], order: list[str]) -> Column:
    """True where no rule rejects; a later rule is evaluated only where the earlier ones let pass."""
    verdict = F
    for name in order:
        verdict = verdict.when(by_name[name], F.lit(False))
    return verdict.otherwise(F.lit(True))


def judge_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, the four measures, base_failed and kept for documents (doc_id, text)."""
    order = [x for x in cascade_order(docs) if x != "base"]
    text = F.coalesce(F.col("text"), F.lit(""))
    one = docs.select("doc_id", text.alias("text"), *[c.alias(k) for k, c in measures(text).items()])
    m = {k: F.col(k) for k in measures(text)}
    verdict = cascade({r.name: r.rejects for r in rules(F.col("text"), m)}, order)
    failed = base_failed(m)
    return one.select("doc_id", *m, failed.alias("base_failed"), (~failed & verdict).alias("kept"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows that no rule rejects, base included, in the cascade's order with measures taken only on demand."""
    order = cascade_order(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    m = measures(text)
    by_name = {"base": base_failed(m)} | {r.name: r.rejects for r in rules(text, m)}
    return docs.where(cascade(by_name, order))
