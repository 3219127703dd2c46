"""Secret scans with corpus-wide ownership frequency.

Base kinds are found by pattern alone. Further candidates (well-known token forms and long
mixed strings) are judged by the corpus: a candidate's hash is counted over distinct owners and
repositories; one that several owners carry, or many repositories of one, is a copied example, and any other belongs to its owner, looks live
and adds a span. Spans are in code points, end exclusive.

Nulls: a null text is empty; a null owner or repository is an owner or repository of its own. Repeated
rows are scanned each for itself and count once as owners. Overlapping spans of
different kinds all stay; of those that begin together the kind listed first comes first. An empty table gives an empty result. Very long texts are scanned whole;
matches are laid out in blocks, so that many of them in one text cost little more than few. Other columns are left alone, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.llm.text import let, packed, text_key, unpacked
from girder.shared import staged


@dataclass(frozen=True)
class Kind:
    """pattern: leftmost, non-overlapping; of the matches those stay whose group has ``least`` characters."""

    name: str
    pattern: str
    group: int
    least: int


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key")))
BASE = [
    Kind("assign", rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 16),
    Kind("hex", r"[0-9a-f]{32,}", 0, 32),
]
#: A key's letters come in both cases, with two digits or more among them that a letter follows; words, dates and version numbers don't look so.
DRAWN = r"(?=(?:[A-Za-z0-9+/_-]*?[0-9][A-Za-z+]){2})(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z])"
#: Candidates that count only if one owner alone has them. None begins within a word; a prefix is followed by a run of ten letters and digits somewhere; a string without a
#: known prefix is no part of a path, an address or a file name, and neither many slashes nor many hyphens cut it into words.
OWNED = [
    Kind("prefixed", rf"(?<![A-Za-z0-9_-])(?:gh[pousr]_|github_pat_|xox[abprs]-|sk-|sk_live_|glpat-|AIza)(?=[A-Za-z0-9_-]*[A-Za-z0-9]{{10}}){DRAWN}[A-Za-z0-9_-]{{16,}}", 0, 20),
    Kind("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 24),
    Kind("mixed", rf"(?<![A-Za-z0-9+/_.:@-])(?=[A-Za-z0-9+][A-Za-z0-9+/_-]{{23}})(?!(?:[A-Za-z0-9+_-]*/){{2}})(?!(?:[A-Za-z0-9+/]*[_-]){{3}}){DRAWN}[A-Za-z0-9+/_-]{{24,}}(?!\.[A-Za-z])", 0, 24),
]
#: Owners, or repositories, from which on a candidate counts as a copied example.
COPIED_BY, COPIED_IN = 2, 4
#: Matches of a text that are laid out together.
BLOCK = 256
SPAN = "array<struct<start:int,kind_no:int,kind:string,end:int,secret:string>>"


def spans_of(text: Column, kind: Kind, number: int) -> Column:
    """All spans of a kind: the matches, laid between the pieces that they split the text into."""
    hits = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group)) if kind.group else None
    gaps = F.split(text, kind.pattern, -1)
    none = F.array().cast(SPAN)

    def found(g, m, v):
        def step(a, i):
            begin = (a["at"] + F.length(F.get(g, i))).cast("int")
            end = (begin + F.length(F.get(m, i))).cast("int")
            one = F.array(F.struct(begin.alias("start"), F.lit(number).alias("kind_no"), F.lit(kind.name).alias("kind"), end.alias("end"), F.get(v, i).alias("secret"))).cast(SPAN)
            return F.struct(end.alias("at"), F.when(F.length(F.get(v, i)) >= kind.least, F.concat(a["spans"], one)).otherwise(a["spans"]).alias("spans"))

        def block(first, last, at):
            return F.aggregate(F.sequence(first, last), F.struct(at.alias("at"), none.alias("spans")), step)

        def next_block(a, k):
            here = block(k * BLOCK, F.least(k * BLOCK + BLOCK, F.size(m)) - 1, a["at"])
            return let(here, lambda r: F.struct(r["at"].alias("at"), F.concat(a["blocks"], F.array(r["spans"])).alias("blocks")))

        nothing = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("blocks"))
        many = F.flatten(F.aggregate(F.sequence(F.lit(0), F.floor((F.size(m) - 1) / BLOCK).cast("int")), nothing, next_block)["blocks"])
        few = block(F.lit(0), F.size(m) - 1, F.lit(0))["spans"]
        return F.when(F.size(m) == 0, none).when(F.size(m) <= BLOCK, few).otherwise(many)

    laid = let(gaps, lambda g: let(hits, lambda m: let(values, lambda v: found(g, m, v)) if kind.group else found(g, m, m)))
    return F.when(text.rlike(kind.pattern), laid).otherwise(none)


def joined(spans: Column) -> Column:
    """kind:start:end of the spans by start, then kind as listed, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def named(column: Column | None) -> Column:
    """An owner or repository as text; null is one of its own."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def scan(docs: DataFrame, keys: list[str], text: str = "text", owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """A table of each row's base spans and all spans after the verdict on ownership.

    keys: columns carried along. Columns out: keys, n_assign, n_access, n_hex, base, spans. Without an
    owner every row is its own; without a repository the owner stands for it.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    base = [spans_of(t, k, i) for i, k in enumerate(BASE)]
    owned = F.concat(*[spans_of(t, k, len(BASE) + i) for i, k in enumerate(OWNED)])
    row = F.monotonically_increasing_id()
    who = named(owner) if owner is not None else row.cast("string")
    where = F.concat_ws("\n", who, named(repository)) if repository is not None else who
    seen = docs.select(*keys, row.alias("_row"), *[c.alias(f"_b{i}") for i, c in enumerate(base)], owned.alias("_owned"), who.alias("_who"), where.alias("_where"))
    seen = staged(seen, "secrets")
    # A candidate inside a base span adds no span of its own but counts for its owner.
    extra = seen.where(F.size("_owned") > 0).select("_row", "_who", "_where", F.concat("_b0", "_b1", "_b2").alias("_base"), F.explode("_owned").alias("s"))
    inside = F.exists("_base", lambda b: (b["start"] <= F.col("s.start")) & (F.col("s.end") <= b["end"]))
    extra = extra.withColumn("inside", inside).withColumn("h", F.sha2(F.col("s.secret"), 256)).drop("_base")
    extra = staged(extra, "candidates")
    # Distinct places first, with map-side combining, so that a candidate copied everywhere is few rows when it is counted.
    places = extra.groupBy("h", "_who", "_where").agg(F.count(F.lit(1)).alias("n"))
    owners = places.groupBy("h", "_who").agg(F.count(F.lit(1)).alias("repositories"))
    verdict = owners.groupBy("h").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))
    alive = verdict.where((F.col("owners") < COPIED_BY) & (F.col("repositories") < COPIED_IN))
    live = extra.where(~F.col("inside")).join(alive.select("h"), "h").groupBy("_row").agg(F.collect_list("s").alias("_live"))
    both = seen.join(live, "_row", "left")
    n = {f"n_{k.name}": F.size(f"_b{i}").cast("long") for i, k in enumerate(BASE)}
    every = F.concat("_b0", "_b1", "_b2", F.coalesce("_live", F.array().cast(SPAN)))
    return both.select(*keys, *[c.alias(k) for k, c in n.items()], F.concat("_b0", "_b1", "_b2").alias("base"), every.alias("spans"))


def owners_of(docs: DataFrame) -> dict[str, Column]:
    """Owner and repository of documents: the source, and its part in a language where there is one."""
    return {"owner": F.col("source"), **({"repository": F.col("lang")} if "lang" in docs.columns else {})}


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for documents (doc_id, source, text)."""
    found = scan(docs, ["doc_id"], **owners_of(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, overlapping ones joined, replaced by a mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a, s):
        fresh = s["start"] >= a["at"]
        out = F.when(fresh, F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], s["end"]).cast("int").alias("at"), out.alias("out"))

    done = F.aggregate(F.array_sort(spans), start, step)
    return let(done, lambda d: F.concat(d["out"], F.substring(text, d["at"] + 1, F.length(text))))


#: Spans of a table that may be sent to every task: their rows and their number together.
BROADCAST_SPANS = 200_000


def redacted_documents(docs: DataFrame) -> DataFrame:
    """The documents with the secrets of their texts replaced; rows without any stay as they are.

    A small table of spans goes to the rows. Else rows are dealt out by digest, those that no pattern fits one by one, so that
    neither empty texts nor large groups of copies without secrets meet in one task.
    """
    key = text_key(F.col("text"))
    flat = docs.select(key.alias("_key"), *[c for c in ("text", "source", "lang") if c in docs.columns])
    found = staged(scan(flat, ["_key"], **owners_of(flat)).where(F.size("spans") > 0).select("_key", "spans").dropDuplicates(["_key"]), "spans")
    small = (found.agg(F.sum(F.size("spans") + 1)).first()[0] or 0) <= BROADCAST_SPANS
    if small:
        found = F.broadcast(found)
    else:
        fits = F.lit(False)
        for kind in [*BASE, *OWNED]:
            fits = fits | F.coalesce(F.col("text").rlike(kind.pattern), F.lit(False))
        key = F.when(fits, key).otherwise(F.unhex(F.hex(F.monotonically_increasing_id())))
    rows = docs.select(key.alias("_key"), packed(docs).alias("_doc"))
    both = rows.join(found, "_key", "left")
    text = F.when(F.col("spans").isNull(), F.col("_doc.text")).otherwise(redacted(F.col("_doc.text"), F.col("spans")))
    both = both.withColumn("_text", text)
    return unpacked(both, docs.columns, text=F.col("_text"), n_chars=F.length("_text").cast("long"))
