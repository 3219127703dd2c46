"""The ZIP source by ranges and filters, corpora committed whole, digests of tables."""

import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual, StringStartsWith

from girder.functions.rules import Refused
from girder.operators import digests
from girder.plans import evaluation, preparation
from girder.sources import archives


@pytest.fixture
def archive(tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(60):
            z.writestr(f"{'Images' if i % 2 else 'Masks'}/{i:03}.txt", f"member {i} " * (i + 1))
    return str(path)


def test_filters_open_only_their_members(archive, monkeypatch):
    names = []
    open_ = zipfile.ZipFile.open
    monkeypatch.setattr(zipfile.ZipFile, "open", lambda self, m, *a, **k: names.append(m.filename) or open_(self, m, *a, **k))
    reader = archives.ZipReader({"path": archive, "content": "true", "taskMembers": "10"})
    kept = list(reader.pushFilters([EqualTo(("name",), "Images/007.txt"), GreaterThan(("mode",), 5)]))
    assert [type(f) for f in kept] == [GreaterThan]  # a filter that it doesn't know stays Spark's
    parts = reader.partitions()
    assert [(p.start, p.stop) for p in parts] == [(0, 10)]
    rows = [r for p in parts for r in reader.read(p)]
    assert names == ["Images/007.txt"] and rows[0][1:4] == (7, "Images/007.txt", len("member 7 ") * 8) and rows[0][-1] == b"member 7 " * 8
    reader = archives.ZipReader({"path": archive, "content": "true"})
    assert not list(reader.pushFilters([StringStartsWith(("name",), "Masks/"), LessThanOrEqual(("size",), 100)]))
    assert {r[2] for p in reader.partitions() for r in reader.read(p)} == {f"Masks/{i:03}.txt" for i in range(0, 60, 2) if (i + 1) * len(f"member {i} ") <= 100}


def test_one_archive_in_several_tasks(spark, archive):
    t = archives.zip_members(spark, archive, content=True, taskMembers=7)
    assert t.rdd.getNumPartitions() == 9 and t.count() == 60
    assert [r["pos"] for r in t.orderBy("pos").collect()] == list(range(60))
    by_bytes = archives.zip_members(spark, f"file://{archive}", content=True, taskBytes=200)
    assert by_bytes.rdd.getNumPartitions() > 3 and by_bytes.where("content is null").isEmpty()
    got = t.where((F.col("name") == "Images/003.txt") | (F.col("name") == "Masks/004.txt")).select("name").collect()
    assert {r["name"] for r in got} == {"Images/003.txt", "Masks/004.txt"}
    few = t.where("name like 'Masks/00%' and size < 40")
    assert {r["pos"] for r in few.collect()} == {0, 2}
    assert t.where("pos < 7").rdd.getNumPartitions() == 1  # Spark has handed the filter over
    assert t.where("name = 'absent'").count() == 0 and archives.zip_members(spark, archive + ".none").count() == 0


def corpus(spark, n):
    return {"manifest": spark.range(n).select("id", F.when(F.col("id") % 2 == 0, "train").otherwise("test").alias("split")), "summary": spark.range(n).select(F.lit(n).alias("images")).limit(1), "withheld": spark.range(0).select(F.col("id"))}


@pytest.mark.parametrize("step", range(4))
def test_a_corpus_is_the_old_or_the_new(spark, tmp_path, monkeypatch, step):
    folder = f"file://{tmp_path}/corpus"
    assert preparation.commit_corpus(corpus(spark, 4), folder) == 1
    done = []

    def counted(real):
        def run(*a):
            if len(done) == step:
                raise OSError("died")
            done.append(1)
            return real(*a)

        return run

    one = preparation.write_tables
    monkeypatch.setattr(preparation, "write_tables", lambda tables, at: [counted(one)({k: v}, at) for k, v in tables.items()])
    monkeypatch.setattr(preparation, "create_once", counted(preparation.create_once))
    with pytest.raises(OSError, match="died"):
        preparation.commit_corpus(corpus(spark, 6), folder)
    tables = preparation.corpus_tables(spark, folder)
    assert {k: t.count() for k, t in tables.items()} == {"manifest": 4, "summary": 1, "withheld": 0} and tables["summary"].first()[0] == 4
    monkeypatch.undo()
    assert preparation.commit_corpus(corpus(spark, 6), folder) == 2
    assert preparation.corpus_tables(spark, folder)["summary"].first()[0] == 6 and preparation.corpus_tables(spark, folder, 1)["summary"].first()[0] == 4


def test_a_new_corpus_appears_whole(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/out/corpus"
    one = preparation.write_tables
    monkeypatch.setattr(preparation, "write_tables", lambda tables, at: (one({"manifest": tables["manifest"]}, at), 1 / 0))
    with pytest.raises(ZeroDivisionError):
        preparation.publish_corpus(corpus(spark, 4), folder)
    assert not (tmp_path / "out" / "corpus").exists() and not list((tmp_path / "out").glob("_staging*"))
    monkeypatch.undo()
    preparation.publish_corpus(corpus(spark, 4), folder, [f"{tmp_path}/source"])
    assert preparation.open_split(spark, folder, "train").count() == 2
    with pytest.raises(Refused, match="exists"):
        preparation.publish_corpus(corpus(spark, 4), folder)
    for inside in (f"{tmp_path}/out/corpus", f"file://{tmp_path}/out", f"{tmp_path}/out/x/.."):
        with pytest.raises(Refused, match="inside"):
            preparation.publish_corpus(corpus(spark, 4), f"file://{tmp_path}/out/corpus/new", [inside])
    preparation.refuse_inside(f"{tmp_path}/outer", [f"{tmp_path}/out"])


def test_digests_are_of_rows_however_they_lie(spark):
    rows = [(i, f"t{i % 7}", None if i % 5 == 0 else i / 3) for i in range(300)]
    t = spark.createDataFrame(rows, "id long, text string, x double")
    one = digests.table_digest(t)
    assert digests.table_digest(t.repartition(7)) == digests.table_digest(t.orderBy(F.desc("id")).coalesce(1)) == digests.table_digest(t.select("x", "text", "id")) == one
    assert digests.table_digest(t.unionByName(t.limit(1))) != one != digests.table_digest(t.where("id <> 7"))
    assert digests.table_digest(t.unionByName(t).where("id < 1")) != digests.table_digest(t.where("id < 1"))
    assert digests.table_digest(t.limit(0)) == digests.table_digest(t.where("false"))
    other = t.withColumn("text", F.when(F.col("id") == 123, "other").otherwise(F.col("text"))).where("id <> 250").unionByName(t.where("id = 31"))
    got = {r["range"]: (r["n_one"], r["n_two"]) for r in digests.differing_ranges(t, other.repartition(5), F.expr("id div 50")).collect()}
    assert got == {0: (50, 51), 2: (50, 50), 5: (50, 49)}
    a, b = evaluation.described("p1", ["crack"], t, t.select("id")), evaluation.described("p1", ["crack"], other, t.select("id"))
    evaluation.comparable(a, evaluation.described("p1", ["crack"], t.repartition(3), t.select("id").orderBy("id")))
    with pytest.raises(Refused, match="references_sha256"):
        evaluation.comparable(a, b)
