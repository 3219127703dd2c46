"""JSON, CSV and file sources, strict ones (SRC-02, 06, 07, 11, 12, 17, 21)."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from girder.functions.rules import Refused, is_finite, refuse

COCO = (
    "images array<struct<id:bigint,file_name:string,width:int,height:int>>, "
    "annotations array<struct<id:bigint,image_id:bigint,category_id:int,bbox:array<double>,area:double,iscrowd:int,segmentation:array<array<double>>>>, "
    "categories array<struct<id:int,name:string>>"
)


def json_documents(spark: SparkSession, path: str, schema: str, version: int | None = None) -> DataFrame:
    """path, sha256, doc of whole JSON files. Repeated keys are refused by the variant parser, unknown versions by number."""
    raw = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("text"))
    checked = raw.withColumn("v", F.parse_json("text"))
    # The variant is asked for, or the optimizer would never parse it and repeated keys would pass.
    doc = F.when(F.col("v").isNotNull(), F.from_json("text", schema, {"mode": "FAILFAST"}))
    out = checked.select("path", "sha256", doc.alias("doc"), F.try_variant_get("v", "$.schema_version", "int").alias("version"))
    if version is not None:
        refuse(out.where(~F.col("version").eqNullSafe(F.lit(version))).select("path", "version"), "unknown schema version")
    return out.select("path", "sha256", "doc")


def pinned_files(spark: SparkSession, path: str) -> DataFrame:
    """path, size, sha256 of files as they are."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def read_inside(spark: SparkSession, root: str, wanted: DataFrame, most: int) -> DataFrame:
    """name, content of the files that ``wanted`` (name) lists under a folder (SRC-06).

    Refused are names that leave the folder, links out of it, missing files and files of more than ``most`` bytes; sizes are
    looked at before any byte is read.
    """
    parts = F.split("name", "/")
    refuse(wanted.where(F.col("name").isNull() | F.col("name").startswith("/") | F.exists(parts, lambda x: x.isin("", ".", ".."))), "a name leaves its folder")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    prefix = fs.makeQualified(base).toString().rstrip("/")
    tail = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    inside = files.withColumn("name", F.expr(f"substring(path, {len(prefix) + 2})")).where(F.startswith(tail, F.regexp_replace(F.lit(prefix + "/"), r"^[a-z]+:/+", "/")))
    sizes = wanted.join(inside.select("name", F.col("length").alias("size")), "name", "left")
    refuse(sizes.where(F.col("size").isNull() | (F.col("size") > most)).select("name", "size"), "a file is missing, a link or too large")
    return inside.join(wanted, "name", "left_semi").select("name", "content")


def coco_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """images, annotations, categories of COCO files."""
    doc = json_documents(spark, path, COCO).select("doc.*")
    return tuple(doc.select(F.inline(c)) for c in ("images", "annotations", "categories"))  # type: ignore[return-value]


def coco_violations(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """problem, id: repeated ids, dangling references, crowds, and boxes that are empty or leave the image."""
    twice = lambda t, what: t.groupBy("id").count().where("count > 1").select(F.lit(f"repeated_{what}").alias("problem"), "id")
    a = annotations.withColumnRenamed("id", "a_id")
    sized = a.join(images.select(F.col("id").alias("image_id"), "width", "height"), "image_id")
    b = [F.get("bbox", F.lit(i)) for i in range(4)]
    bad = ~((F.size("bbox") == 4) & F.forall("bbox", is_finite) & (b[0] >= 0) & (b[1] >= 0) & (b[2] > 0) & (b[3] > 0) & (b[0] + b[2] <= F.col("width")) & (b[1] + b[3] <= F.col("height")))
    parts = [
        twice(images, "image"), twice(annotations, "annotation"), twice(categories, "category"),
        a.join(images.select(F.col("id").alias("image_id")), "image_id", "left_anti").select(F.lit("unknown_image").alias("problem"), F.col("a_id").alias("id")),
        a.join(categories.select(F.col("id").alias("category_id")), "category_id", "left_anti").select(F.lit("unknown_category").alias("problem"), F.col("a_id").alias("id")),
        a.where("iscrowd <> 0").select(F.lit("crowd").alias("problem"), F.col("a_id").alias("id")),
        sized.where(F.coalesce(bad, F.lit(True))).select(F.lit("bad_box").alias("problem"), F.col("a_id").alias("id")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def projected_categories(annotations: DataFrame, keep: dict[int, int | None]) -> DataFrame:
    """Annotations of some categories with their new ones, numbered from 1 by (image_id, id) (PRJ-01).

    keep: the new category of every category there is, None for one that is left out. An annotation of any other is refused: an unknown
    category must not vanish like one that was left out.
    """
    from girder.operators.selection import dense_ids

    if not any(v is not None for v in keep.values()) or len({v for v in keep.values() if v is not None}) < sum(v is not None for v in keep.values()):
        raise Refused("categories must be projected to different ones, and some kept")
    known = F.coalesce(F.col("category_id").isin(*keep), F.lit(False))
    refuse(annotations.where(~known).select("id", "category_id"), "unknown category")
    table = F.create_map(*[F.lit(x) for kv in keep.items() for x in (kv[0], kv[1])]).cast("map<int,int>")
    t = annotations.withColumn("category_id", F.try_element_at(table, F.col("category_id").cast("int"))).where("category_id is not null")
    return dense_ids(t, ["image_id", "id"], name="new_id").drop("id").withColumnRenamed("new_id", "id")


def metric_summary(spark: SparkSession, path: str, target: str) -> dict:
    """The last defined value of every column of a metrics file, and the epoch of the last row that has the target.

    Rows are in order of their place in the file: of the block that a task reads, and there of their number, however blocks are dealt to tasks.
    """
    t = spark.read.csv(path, header=True)
    t = t.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("_row"))
    names = [c for c in t.columns if c != "_row"]
    if target not in names:
        raise Refused(f"no column {target}")
    n = {c: F.col(f"`{c}`").try_cast("double") for c in names}
    refuse(t.where(F.exists(F.array(*[F.coalesce((F.col(f"`{c}`").isNotNull()) & ~is_finite(n[c]), F.lit(False)) for c in names]), lambda x: x)), "a metric is not finite")
    last = t.agg(*[F.max_by(n[c], F.when(n[c].isNotNull(), F.col("_row"))).alias(c) for c in names], F.max_by(n["epoch"] if "epoch" in n else F.lit(None), F.when(n[target].isNotNull(), F.col("_row"))).alias("_epoch"))
    row = last.first().asDict()
    if row[target] is None:
        raise Refused(f"{target} never has a value")
    return {"epoch": row.pop("_epoch"), "values": row}


#: Fixed limits of saved predictions.
MOST_PREDICTIONS = 200


def prediction_violations(predictions: DataFrame, width: int, height: int, names: list[str], floor: float = 0.0) -> DataFrame:
    """id, problem of an image's saved predictions (id, class_id, class_name, score, box), and of their masks if there is a column ``mask_rle`` (SRC-17).

    Ids are 1 to the limit, each once; mask_rle is struct<size: array<int> (height, width), counts: string>.
    """
    from girder.functions.geometry import sound
    from girder.functions.masks import rle_problem

    known = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (i, n)])
    uses = F.count(F.lit(1)).over(Window.partitionBy("id"))
    problem = (
        F.when(~F.coalesce(F.try_element_at(known, F.col("class_id")) == F.col("class_name"), F.lit(False)), "class_and_name_differ")
        .when(~F.coalesce(F.col("id").between(1, MOST_PREDICTIONS), F.lit(False)), "id_outside")
        .when(F.col("uses") > 1, "repeated_id")
        .when(~is_finite(F.col("score")) | (F.col("score") < floor) | (F.col("score") > 1), "score_outside")
        .when(~sound(F.col("box"), F.lit(width), F.lit(height)), "bad_box")
    )
    t = predictions.withColumn("uses", uses).withColumn("problem", problem)
    if "mask_rle" in predictions.columns:
        t = t.withColumn("problem", F.coalesce("problem", rle_problem(width, height)(F.col("mask_rle.size"), F.col("mask_rle.counts"))))
    return t.select("id", "problem").where("problem is not null")


@dataclass(frozen=True)
class CorpusConfig:
    """Settings of a corpus preparation; unknown names and values out of bounds are refused."""

    seed: int = 20260918
    share: float = 0.1
    distance: int = 8
    error: float = 20.0
    most_images: int = 5000

    @classmethod
    def of(cls, values: dict) -> CorpusConfig:
        known = {f.name for f in fields(cls)}
        if extra := set(values) - known:
            raise Refused(f"unknown settings {sorted(extra)}")
        made = cls(**values)
        if type(made.seed) is not int or not 0 < made.share < 0.5 or not 0 <= made.distance <= 64 or made.error < 0 or not 1 <= made.most_images <= 50_000:
            raise Refused(f"settings out of bounds: {made}")
        return made
