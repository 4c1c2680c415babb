"""Encodings, label lists, hierarchy, names, ground truth and backbone taxonomy."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hierspark.operators import hierarchy, labels
from hierspark.operators.hierarchy import level_index, raise_if_any
from hierspark.operators.scores import union_all
from hierspark.schema import ALL_LEVELS, LEVELS


def read_encodings(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``encodings(lvl, label, taxon_id)`` from one space-separated file per level, root first."""
    tables = [
        spark.read.csv(p, sep=" ", schema="label BIGINT, taxon_id BIGINT").select(F.lit(k).alias("lvl"), "label", "taxon_id")
        for k, p in enumerate(paths)
    ]
    return union_all(tables)


def read_trained(
    spark: SparkSession, path: str, levels: Sequence[str] = LEVELS, numeric_order: bool = False
) -> DataFrame:
    """``trained(lvl, pos, label)``."""
    rows = spark.read.csv(path, sep="\t", schema="level STRING, labels STRING")
    listed = rows.select(level_index(levels, F.col("level")).alias("lvl"), "labels").filter("lvl IS NOT NULL")
    return labels.explode_label_list(listed, numeric_order)


def read_truth(spark: SparkSession, path: str, levels: Sequence[str] = ALL_LEVELS) -> DataFrame:
    """Wide truth ``(id, <level> …, filename)``; the unnamed index column is left out."""
    columns = ", ".join(f"`{x}` BIGINT" for x in levels)
    rows = spark.read.csv(path, header=True, schema=f"_idx BIGINT, id STRING, {columns}, filename STRING", enforceSchema=True)
    return rows.drop("_idx")


def truth_long(wide: DataFrame, levels: Sequence[str] = LEVELS) -> DataFrame:
    """``truth(id, lvl, label)`` of the listed level columns; the others are dropped."""
    cells = F.array(*[F.struct(F.lit(k).alias("lvl"), F.col(x).cast("bigint").alias("label")) for k, x in enumerate(levels)])
    return wide.select("id", F.inline(cells))


def read_edges(
    spark: SparkSession, path: str, levels: Sequence[str] = LEVELS, strict: bool = True
) -> DataFrame:
    """``edges(lvl, parent, child, ord)`` from the hierarchy file, parents of the listed levels.

    ``strict`` makes a repeated parent, or a child with two parents, an error.
    """
    rows = spark.read.csv(path, sep="\t", header=True, schema="level STRING, parent BIGINT, children STRING")
    rows = rows.withColumn("lvl", level_index(levels, F.col("level"))).filter("lvl IS NOT NULL")
    edges = hierarchy.explode_edges(rows)
    if strict:
        raise_if_any(hierarchy.duplicates(rows, ["lvl", "parent"]), "parents on more than one line")
        raise_if_any(hierarchy.duplicates(edges, ["lvl", "child"]), "children with more than one parent")
    return edges


def read_names(spark: SparkSession, path: str, levels: Sequence[str] = LEVELS, strict: bool = True) -> DataFrame:
    """``names(lvl, label, name)``; ``strict`` makes a repeated label an error."""
    rows = spark.read.csv(path, sep="\t", header=True, schema="level STRING, name STRING, label BIGINT")
    names = rows.select(level_index(levels, F.col("level")).alias("lvl"), "label", "name").filter("lvl IS NOT NULL")
    if strict:
        raise_if_any(hierarchy.duplicates(names, ["lvl", "label"]), "labels with more than one name")
    return names


def read_backbone(spark: SparkSession, path: str) -> DataFrame:
    """``(taxon_id, ancestry ARRAY<BIGINT>, rank, name, position)``; ids serve as position."""
    rows = spark.read.csv(
        path, sep="\t", header=True, schema="taxon_id BIGINT, ancestry STRING, rank_level STRING, rank STRING, name STRING"
    )
    chain = F.transform(F.split("ancestry", "/"), lambda x: x.try_cast("bigint"))
    return rows.select("taxon_id", chain.alias("ancestry"), "rank", "name", F.col("taxon_id").alias("position"))
