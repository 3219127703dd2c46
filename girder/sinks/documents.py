"""Documents larger than a row: tasks write sorted fragments, the commit joins them (SNK-03).

A document is rows (document, section, number, text) whose texts, in that order, are its characters. Spark sorts the rows by range over all documents, so a large
document is many tasks' work and a task holds no more than a batch of rows. Only names of fragments come to the driver, which then copies their bytes, a buffer at a time.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from girder.functions.geometry import to_xywh
from girder.functions.rules import Refused
from girder.operators.splits import places
from girder.shared import staged
from girder.sinks.exports import file_system

BUFFER = 1 << 20


@dataclass
class Fragments(WriterCommitMessage):
    """Of a task's part of the order, the files that it wrote: (document, file)."""

    part: int
    files: list[tuple[str, str]]


def system_of(path: str) -> tuple[fs.FileSystem, str]:
    return (fs.LocalFileSystem(), path) if "://" not in path and not path.startswith("file:") else fs.FileSystem.from_uri(path)


class FragmentWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator: Iterator[Row]) -> Fragments:
        system, root = system_of(self.path)
        part = TaskContext.get().partitionId()
        files, now, out = [], None, None
        try:
            for row in iterator:
                if row["document"] != now:
                    if out is not None:
                        out.close()
                    now = row["document"]
                    name = posixpath.join(root, "_fragments", f"{part:06}-{len(files):06}-{uuid.uuid4().hex}")
                    system.create_dir(posixpath.dirname(name), recursive=True)
                    out = system.open_output_stream(name, buffer_size=BUFFER)
                    files.append((now, name))
                out.write(row["text"].encode())
        finally:
            if out is not None:
                out.close()
        return Fragments(part, files)

    def commit(self, messages: list[Fragments | None]) -> None:
        system, root = system_of(self.path)
        system.create_dir(root, recursive=True)
        parts: dict[str, list[str]] = {}
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.part):
            for document, name in m.files:
                parts.setdefault(document, []).append(name)
        for document, names in parts.items():
            with system.open_output_stream(posixpath.join(root, document), buffer_size=BUFFER) as out:
                for name in names:
                    with system.open_input_stream(name) as one:
                        while block := one.read(BUFFER):
                            out.write(block)
        self.clear()

    def abort(self, messages: list[Fragments | None]) -> None:
        self.clear()

    def clear(self) -> None:
        system, root = system_of(self.path)
        folder = posixpath.join(root, "_fragments")
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


class DocumentFragments(DataSource):
    @classmethod
    def name(cls) -> str:
        return "document_fragments"

    def schema(self) -> str:
        return "document string, text string"

    def writer(self, schema: StructType, overwrite: bool) -> FragmentWriter:
        return FragmentWriter(self.options)


def publish_documents(fragments: DataFrame, destination: str) -> None:
    """Write rows (document, section, number, text) as a file a document in a new folder, which is there whole or not at all."""
    spark = fragments.sparkSession
    hadoop, target = file_system(spark, destination)
    if hadoop.exists(target):
        raise Refused(f"{destination} exists")
    parent, _, name = destination.rstrip("/").rpartition("/")
    hidden = f"{parent}/_staging_{uuid.uuid4().hex}_{name}"
    _, source = file_system(spark, hidden)
    spark.dataSource.register(DocumentFragments)
    order = ["document", "section", "number"]
    rows = fragments.repartitionByRange(*order).sortWithinPartitions(*order).select("document", "text")
    try:
        rows.write.format("document_fragments").mode("append").option("path", hidden).save()
        if not hadoop.rename(source, target):
            raise Refused(f"{destination} could not be published")
    finally:
        hadoop.delete(source, True)


def coco_fragments(images: DataFrame, annotations: DataFrame, categories: list[tuple[int, str]], split: str = "split") -> DataFrame:
    """document, section, number, text of a COCO text for each split: the text that ``coco_documents`` makes, of splits of any size.

    images and annotations as there. Ids come from ranges over all rows, and a row's text begins with the comma that parts it from the one before.
    """
    i = places(images.select("id", split, "file_name", "width", "height"), [split], ["id"], "image_id")
    a = annotations.join(i.select(F.col("id").alias("image"), split, "image_id"), "image")
    a = places(a, [split], ["image_id", "category_id", "box"], "annotation_id")
    xywh = to_xywh(F.col("box"))
    area = F.col("area").cast("double") if "area" in annotations.columns else xywh[2] * xywh[3]
    drawn = ["segmentation"] if "segmentation" in annotations.columns else []
    one = F.struct(F.col("annotation_id").alias("id"), "image_id", "category_id", xywh.alias("bbox"), area.alias("area"), F.lit(0).alias("iscrowd"), *drawn)
    photo = F.struct(F.col("image_id").alias("id"), "file_name", "width", "height")
    row = lambda t, section, number, value: t.select(split, F.lit(section).alias("section"), F.col(number).alias("number"), F.concat(F.when(F.col(number) > 1, ",").otherwise(""), F.to_json(value, {"ignoreNullFields": "false"})).alias("text"))
    named = F.to_json(F.array(*[F.struct(F.lit(k).alias("id"), F.lit(n).alias("name")) for k, n in categories]))
    frame = [(0, F.lit('{"annotations":[')), (2, F.concat(F.lit('],"categories":'), named, F.lit(',"images":['))), (4, F.lit("]}"))]
    around = i.select(split).distinct().select(split, F.inline(F.array(*[F.struct(F.lit(k).alias("section"), F.lit(0).cast("long").alias("number"), t.alias("text")) for k, t in frame])))
    every = row(a, 1, "annotation_id", one).unionByName(row(i, 3, "image_id", photo)).unionByName(around)
    return staged(every.select(F.concat(F.col(split).cast("string"), F.lit(".json")).alias("document"), "section", "number", "text"), "fragments")
