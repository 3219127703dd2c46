"""Documents in fragments: the text of the one-row form, however many tasks write it."""

import json

import pytest
from pyspark.sql import functions as F

from girder.functions.rules import Refused
from girder.sinks import documents, exports

CATEGORIES = [(1, "crack"), (2, "surface_loss")]


@pytest.fixture
def tables(spark):
    images = spark.range(120).select(F.concat(F.lit("p"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("id"), F.when(F.col("id") % 5 == 0, "valid").when(F.col("id") == 7, "test").otherwise("train").alias("split"), F.concat(F.lit("é"), F.col("id"), F.lit(".jpg")).alias("file_name"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    x = lambda k: (F.col("n") * k % 50).cast("double")
    boxes = spark.range(500).select(F.concat(F.lit("p"), F.lpad((F.col("id") % 90 + 8).cast("string"), 4, "0")).alias("image"), (F.col("id") % 2 + 1).alias("category_id"), F.col("id").alias("n")).select("image", "category_id", F.struct(x(3).alias("x1"), x(7).alias("y1"), (x(3) + 5.5).alias("x2"), (x(7) + F.col("n") / 4 + 1).alias("y2")).alias("box"))
    return images, boxes


@pytest.mark.parametrize("tasks", [1, 9])
def test_fragments_join_to_the_same_text(spark, tmp_path, tables, tasks):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    try:
        rows = documents.coco_fragments(*tables, CATEGORIES)
        documents.publish_documents(rows, f"file://{tmp_path}/out/coco")
        want = {r["split"]: r["document"] for r in exports.coco_documents(*tables, CATEGORIES).collect()}
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    folder = tmp_path / "out" / "coco"
    assert {p.name for p in folder.iterdir() if not p.name.startswith(".")} == {f"{s}.json" for s in want} == {"train.json", "valid.json", "test.json"}
    for split, text in want.items():
        assert (folder / f"{split}.json").read_text() == text
    assert json.loads((folder / "test.json").read_text())["annotations"] == []
    with pytest.raises(Refused, match="exists"):
        documents.publish_documents(rows, f"file://{tmp_path}/out/coco")


def test_a_task_that_fails_leaves_nothing(spark, tmp_path, tables):
    rows = documents.coco_fragments(*tables, CATEGORIES)
    bad = rows.withColumn("text", F.when(F.col("number") == 50, F.raise_error(F.lit("broken"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="broken"):
        documents.publish_documents(bad, f"file://{tmp_path}/out/coco")
    assert not (tmp_path / "out").exists() or not list((tmp_path / "out").iterdir())


def test_no_task_writes_more_than_its_part(tmp_path, monkeypatch):
    writer = documents.FragmentWriter({"path": str(tmp_path)})
    monkeypatch.setattr(documents.TaskContext, "get", classmethod(lambda cls: type("T", (), {"partitionId": lambda self: 3})()))
    made = writer.write(iter([{"document": "a", "text": "x"}, {"document": "a", "text": "ß"}, {"document": "b", "text": "y"}]))
    assert made.part == 3 and [d for d, _ in made.files] == ["a", "b"] and [open(f, encoding="utf-8").read() for _, f in made.files] == ["xß", "y"]
    first = documents.Fragments(1, [("a", made.files[1][1])])
    writer.commit([made, None, first])
    assert (tmp_path / "a").read_text() == "yxß" and (tmp_path / "b").read_text() == "y" and not (tmp_path / "_fragments").exists()
