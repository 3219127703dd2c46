"""The pipeline's stages, each against brute force on what its predecessor kept."""

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_documents import WORD, base_quality, base_secrets, brute_components, shingles
from test_mixing import is_part, targets

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table_rows():
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    texts = [prose(rng.randint(60, 200)) for _ in range(40)]
    for k in range(12):  # near copies, some of copies
        w = texts[k % 5 if k < 8 else -1].split()
        w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += [texts[3]] * 3 + [texts[7].upper(), texts[8] + "!!" * 200, texts[9] + " ###" * 60, prose(10), "same words " * 50, texts[10] + "\nx y z" * 40, "", None]
    copied, live, inner = "ghp_Zz9Yy8Xx7Ww6Vv5Uu4Tt3Ss2", "ghp_Aa1Bb2Cc3Dd4Ee5Ff6Gg7Hh8", "sk-" + "a1B2" * 8
    for k, secret in enumerate([copied, copied, live, live, inner, f"token = {inner}", "AKIA" + "Z9" * 10, "0123456789abcdef" * 2, "password: 'longenough1'"]):
        texts.append(f"{prose(70)} {secret} {prose(20)}" if k != 5 else f"é {prose(70)} {secret}\n{prose(30)}")
    rows = [(None if i % 17 == 5 else 3 * i % 71, t, "en", None if i % 13 == 4 else f"s{i % 4}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return rows + [rows[1], rows[1]]


def kept_by_rules(t):
    t = t or ""
    n, chars, symbols, dup, repeated = base_quality(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    letters = sum(c.isalpha() for c in t)
    bad = n < 50 or 100 * repeated > 50 * n or 100 * symbols > 10 * n or chars < 2 * n or chars > 20 * n or 100 * len(re.findall("[!?]", t)) > 50 * n
    return not (bad or 100 * len(re.findall("[A-Z]", t)) > 50 * chars or 100 * (chars - letters) > 40 * chars or (dup >= 3 and 100 * dup > 30 * len(lines)))


OWNED = [re.compile(r"(?:gh[pousr]_|github_pat_|xox[abprs]-|sk-|sk_live_|glpat-|AIza)[A-Za-z0-9_-]{16,}"), re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{24,}")]


def redacted(rows):
    owners = defaultdict(set)
    for _, t, _, s, _ in rows:
        for p in OWNED:
            for m in p.finditer(t or ""):
                owners[m.group()].add(s)
    out = []
    for i, t, lang, s, n in rows:
        spans = [tuple(map(int, x.split(":")[1:])) for x in base_secrets(t or "")[3].split(",") if x]
        spans += [m.span() for p in OWNED for m in p.finditer(t or "") if len(m.group()) >= 20 and len(owners[m.group()]) < 2 and not any(a <= m.start() and m.end() <= b for a, b in spans)]
        at, made = 0, ""
        for a, b in sorted(spans):
            if a >= at:
                made += t[at:a] + "[SECRET]"
            at = max(at, b)
        out.append((i, made + t[at:], lang, s, len(made) + len(t) - at) if spans else (i, t, lang, s, n))
    return out


def test_every_stage_against_brute_force(spark):
    import sentencepiece

    rows = table_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    names, stages = zip(*corpus_pipeline.STAGES, strict=True)
    assert names == ("quality rules", "near-dedup", "secret scans", "mixing", "encoding")
    # Each stage's rows are made into a table anew, as the tool and run() do by files.
    again = lambda t: (spark.createDataFrame(r := [tuple(x) for x in t.collect()], t.schema).repartition(3), r)
    docs, got = again(stages[0](spark, docs, ""))
    assert Counter(got) == Counter(r for r in rows if kept_by_rules(r[1])) and 20 < len(got) < len(rows) - 5

    groups = brute_components([(k, r[1]) for k, r in enumerate(got)], 5, 80)
    by = defaultdict(list)
    for (k, _, group), r in zip(groups, got, strict=True):
        by[group if shingles(r[1], 5) else ("alone", k)].append(r)
    docs, kept = again(stages[1](spark, docs, ""))
    assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")] and len(kept) == len(by) < len(got)
    left = Counter(kept)
    for members in by.values():
        ids = [r[0] for r in members if r[0] is not None]
        assert sum(left[r] for r in set(members)) >= 1
        stays = [r for r in set(members) if left[r] and r[0] == (min(ids) if ids else None)]
        assert stays

    docs, clean = again(stages[2](spark, docs, ""))
    assert Counter(clean) == Counter(redacted(kept)) and any("[SECRET]" in r[1] for r in clean)

    sizes, took = Counter(), Counter()
    for r in clean:
        sizes[r[3]] += len(WORD.findall(r[1]))
    docs, mixed = again(stages[3](spark, docs, ""))
    sources = defaultdict(list)
    for r in clean:
        sources[r[0], r[2], r[3]].append(r[1])
    for i, t, lang, s, n in mixed:
        took[s] += len(WORD.findall(t))
        assert n == len(t) and any(t == x or is_part(WORD.findall(t), WORD.findall(x)) for x in sources[i, lang, s])
    for s, aim in targets(sizes).items():
        assert abs(took[s] - aim) <= 2 + 0.04 * aim

    out = stages[4](spark, docs, "").collect()
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter((r[0], r[1]) for r in mixed)
    for r in out:
        assert r["ids"] == library.encode(r["text"], add_eos=True) and r["decoded"] == library.decode(r["ids"])


def test_stages_take_empty_tables_and_clashing_columns(spark):
    none = spark.createDataFrame([], SCHEMA)
    clash = {c: F.lit(1) for c in ("_doc", "_key", "_c0", "_at", "node", "spans", "mark", "copies", "size", "component", "_mark")}
    few = spark.createDataFrame(table_rows()[:9], SCHEMA).withColumns(clash)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, none, "").count() == 0
        got = stage(spark, few, "")
        assert got.columns[: len(few.columns)] == few.columns and got.count() > 0, k


def test_the_whole_run_is_the_same_however_the_table_lies(spark, tmp_path):
    rows = table_rows()
    out = []
    for n in (1, 5):
        spark.createDataFrame(rows, SCHEMA).repartition(n).write.parquet(str(tmp_path / f"{n}" / "documents.parquet"))
        out.append(Counter((r["doc_id"], r["text"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, str(tmp_path / f"{n}")).collect()))
    assert out[0] == out[1] and sum(out[0].values()) > 20
