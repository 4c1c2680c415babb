"""Image folders as tables of paths.  File content is never read."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hierspark.functions import ids


def catalog_of(paths: DataFrame, path: str = "path") -> DataFrame:
    """``(path, folder, file_name, suffix, photo_id)`` of the image files among the paths."""
    return (
        paths.withColumn("file_name", ids.base_name(F.col(path)))
        .withColumns({"folder": ids.parent_folder(F.col(path)), "suffix": ids.suffix(F.col("file_name"))})
        .filter(ids.is_image(F.col("file_name")))
        .withColumn("photo_id", ids.photo_id(F.col("file_name")))
    )


def file_catalog(spark: SparkSession, root: str, depth: int = 0) -> DataFrame:
    """Images directly in ``root`` (depth 0) or in its sub-folders (depth 1)."""
    if depth not in (0, 1):
        raise ValueError(f"unknown directory depth: {depth}")
    pattern = f"{root.rstrip('/')}/{'*/' * depth}*"
    return catalog_of(spark.read.format("binaryFile").load(pattern).select("path"))


def labelled_folder(spark: SparkSession, root: str) -> DataFrame:
    """Class folders ``<root>/<label>/<file>``: the catalog with ``class_label``."""
    return file_catalog(spark, root, depth=1).withColumnRenamed("folder", "class_label")


def split_folder(spark: SparkSession, root: str, split: str) -> DataFrame:
    """``(id, label, split)`` of the files ending in exactly ``.jpg``; one row per id."""
    return split_members(labelled_folder(spark, root), split)


def split_members(catalog: DataFrame, split: str) -> DataFrame:
    return (
        catalog.filter(F.endswith("file_name", F.lit(".jpg")))
        .groupBy(F.col("photo_id").alias("id"))
        .agg(F.max("class_label").alias("label"))
        .withColumn("split", F.lit(split))
    )
