"""ZIP archives as a Spark data source, one row a member, and the rules a member must keep (SRC-03, SRC-04, SRC-15, SRC-16)."""

from __future__ import annotations

import glob
import stat
import zipfile
from collections.abc import Iterable, Iterator

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith

MEMBER_BYTES = 8 << 20
RATIO = 1000


def opened(uri: str):
    """A file for random reads, of any file system that Arrow knows: a local path, file:, hdfs:, viewfs:, s3: and others."""
    system, path = (fs.LocalFileSystem(), uri) if "://" not in uri and not uri.startswith("file:") else fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def archives_of(pattern: str) -> list[str]:
    """The archives that a pattern names, in order; patterns are for local paths, elsewhere the path is one archive's or a folder's of archives."""
    if "://" not in pattern and not pattern.startswith("file:"):
        return sorted(glob.glob(pattern))
    system, path = fs.FileSystem.from_uri(pattern)
    at = system.get_file_info(path)
    if at.type != fs.FileType.Directory:
        return [pattern]
    root = pattern.rstrip("/")[: -len(path.rstrip("/"))]
    return sorted(root + f.path for f in system.get_file_info(fs.FileSelector(path)) if f.path.lower().endswith(".zip"))


class Members(InputPartition):
    """Members of an archive from ``start`` to before ``stop`` in the order of its directory."""

    def __init__(self, archive: str, start: int, stop: int):
        super().__init__((archive, start, stop))
        self.archive, self.start, self.stop = archive, start, stop


def passes(filters: list[Filter], row: dict) -> bool:
    """Whether a member's columns meet all filters."""
    tests = {
        EqualTo: lambda v, f: v == f.value, In: lambda v, f: v in f.value, GreaterThan: lambda v, f: v > f.value, GreaterThanOrEqual: lambda v, f: v >= f.value,
        LessThan: lambda v, f: v < f.value, LessThanOrEqual: lambda v, f: v <= f.value, StringStartsWith: lambda v, f: v.startswith(f.value), StringEndsWith: lambda v, f: v.endswith(f.value), StringContains: lambda v, f: f.value in v,
    }
    return all(tests[type(f)](row[f.attribute[0]], f) for f in filters)


KNOWN = (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, StringStartsWith, StringEndsWith, StringContains)


class ZipReader(DataSourceReader):
    """Members' rows; their bytes are read only if ``content`` is asked for, and never beyond the limit.

    An archive is cut into tasks of about ``taskBytes`` packed bytes or ``taskMembers`` members. Filters on names, sizes and places are taken over from Spark: what they
    rule out is neither opened nor a reason for a task.
    """

    def __init__(self, options: dict):
        self.pattern, self.content = options["path"], str(options.get("content", "false")).lower() == "true"
        self.most = int(options.get("memberBytes", MEMBER_BYTES))
        self.bytes, self.members = int(options.get("taskBytes", 64 << 20)), int(options.get("taskMembers", 20_000))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, KNOWN) and f.attribute in (("archive",), ("name",), ("size",), ("packed",), ("pos",)):
                self.filters.append(f)
            else:
                yield f

    @staticmethod
    def row(archive: str, pos: int, m: zipfile.ZipInfo) -> dict:
        return {"archive": archive, "pos": pos, "name": m.filename, "size": m.file_size, "packed": m.compress_size}

    def partitions(self) -> list[InputPartition]:
        of_archive = [f for f in self.filters if f.attribute == ("archive",)]
        out: list[InputPartition] = []
        for archive in archives_of(self.pattern):
            if not passes(of_archive, {"archive": archive}):
                continue
            with opened(archive) as file, zipfile.ZipFile(file) as z:
                start, weight, wanted = 0, 0, False
                every = z.infolist()
                for pos, m in enumerate(every):
                    if passes(self.filters, self.row(archive, pos, m)):
                        weight, wanted = weight + m.compress_size * self.content, True
                    if pos + 1 == len(every) or weight >= self.bytes or pos + 1 - start >= self.members:
                        if wanted:
                            out.append(Members(archive, start, pos + 1))
                        start, weight, wanted = pos + 1, 0, False
        return out or [Members("", 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.archive:
            return
        with opened(partition.archive) as file, zipfile.ZipFile(file) as z:
            for pos, m in list(enumerate(z.infolist()))[partition.start : partition.stop]:
                if not passes(self.filters, self.row(partition.archive, pos, m)):
                    continue
                data = None
                if self.content and not m.is_dir() and m.file_size <= self.most and not m.flag_bits & 1:
                    with z.open(m) as f:
                        data = f.read(self.most + 1)
                    data = data if len(data) == m.file_size else None
                mode = m.external_attr >> 16
                yield partition.archive, pos, m.filename, m.file_size, m.compress_size, mode, stat.S_ISLNK(mode), m.is_dir(), bool(m.flag_bits & 1), m.compress_type, data


class ZipMembers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return "archive string, pos int, name string, size long, packed long, mode int, is_link boolean, is_dir boolean, encrypted boolean, method int, content binary"

    def reader(self, schema) -> ZipReader:
        return ZipReader(self.options)


def zip_members(spark: SparkSession, path: str, content: bool = False, **options: int) -> DataFrame:
    """The members of the archives at a path. Spark hands filters over where spark.sql.python.filterPushdown.enabled is set, which this does."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ZipMembers)
    return spark.read.format("zip_members").option("path", path).option("content", str(content).lower()).options(**options).load()


def unsafe_name(name: Column) -> Column:
    """Absolute, with a drive, a backslash, an empty or dotted step, or a control character."""
    return name.rlike(r"^/|^[A-Za-z]:|\\|(^|/)\.{1,2}(/|$)|//|[\x00-\x1F]") | (F.length(name) == 0)


def member_violations(members: DataFrame, most_members: int, most_bytes: int) -> DataFrame:
    """archive, name, problem of members that break a rule; empty if the archive may be read."""
    by = Window.partitionBy("archive")
    t = members.withColumns({
        "same": F.count(F.lit(1)).over(Window.partitionBy("archive", F.lower("name"))),
        "n": F.count(F.lit(1)).over(by),
        "so_far": F.sum("size").over(by.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    })
    problem = (
        F.when(F.col("n") > most_members, "too_many_members")
        .when(unsafe_name(F.col("name")), "unsafe_name")
        .when(F.col("is_link"), "link")
        .when(F.col("encrypted"), "encrypted")
        .when(~F.col("method").isin(0, 8), "unknown_method")
        .when(F.col("size") > MEMBER_BYTES, "member_too_large")
        .when(F.col("size") > RATIO * F.greatest("packed", F.lit(1)), "packed_too_tightly")
        .when(F.col("same") > 1, "names_collide")
        .when(F.col("so_far") > most_bytes, "archive_too_large")
    )
    return t.select("archive", "name", problem.alias("problem")).where("problem is not null")


def patch_index(members: DataFrame) -> DataFrame:
    """surface, label, photo, names of patches named ``S/LS/photo-number.jpg`` with L for cracked (C) or clear (U)."""
    pattern = r"^([A-Z])/([CU])\1/(\d+)-(\d+)\.jpg$"
    part = lambda k: F.regexp_extract("name", pattern, k)
    t = members.where(F.col("name").rlike(pattern)).select(part(1).alias("surface"), F.when(part(2) == "C", "cracked").otherwise("clear").alias("label"), part(3).alias("photo"), "name")
    return t.groupBy("surface", "label", "photo").agg(F.sort_array(F.collect_list("name")).alias("names"))


def pinned_members(members: DataFrame, pins: DataFrame) -> DataFrame:
    """name, content, ok of the members that pins (name, sha256) ask for; a missing one has no content and is not ok."""
    t = pins.join(members.select("name", "content"), "name", "left")
    return t.select("name", "content", F.coalesce(F.sha2("content", 256) == F.col("sha256"), F.lit(False)).alias("ok"))
