"""Build, list, collect and check label hierarchies.

The canonical table is ``edges(lvl, parent, child, ord)``: ``lvl`` is the level of the
*parent* and ``ord`` sorts the children of one parent (ties between children go to the
smaller ``ord``).  ``ord`` only has to be sortable, it need not be dense.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edges_from_truth(truth: DataFrame, levels: Sequence[str], position: str) -> DataFrame:
    """Edges between adjacent label columns of a flat table, with counts.

    ``ord`` is the smallest row position at which the pair was seen, so children keep the
    order of their first appearance without numbering rows globally.
    """
    pairs = F.array(
        *[
            F.struct(
                F.lit(k).alias("lvl"),
                F.col(a).cast("bigint").alias("parent"),
                F.col(b).cast("bigint").alias("child"),
            )
            for k, (a, b) in enumerate(zip(levels[:-1], levels[1:]))
        ]
    )
    return (
        truth.select(F.col(position).cast("bigint").alias("_pos"), F.explode(pairs).alias("e"))
        .groupBy("e.lvl", "e.parent", "e.child")
        .agg(F.min("_pos").alias("ord"), F.count(F.lit(1)).alias("n_rows"))
    )


def edges_from_backbone(backbone: DataFrame, encodings: DataFrame, ranks: Sequence[str]) -> DataFrame:
    """Edges from a taxonomy of ``(taxon_id, ancestry ARRAY, rank, position)`` rows.

    A taxon counts when its id is encoded at its own rank.  Its edge exists when its last
    ancestor is encoded at exactly the rank above; any other ancestor loses the edge.
    """
    taxa = encoded_taxa(backbone, encodings, ranks)
    parents = encodings.select(
        (F.col("lvl") + 1).alias("lvl"), F.col("taxon_id").alias("_up"), F.col("label").alias("parent")
    )
    return (
        taxa.withColumn("_up", F.try_element_at("ancestry", F.lit(-1)))
        .join(parents, ["lvl", "_up"])
        .select((F.col("lvl") - 1).alias("lvl"), "parent", F.col("label").alias("child"), F.col("position").alias("ord"))
    )


def names_from_backbone(backbone: DataFrame, encodings: DataFrame, ranks: Sequence[str]) -> DataFrame:
    """``(lvl, name, label)``; a name that occurs twice at a rank keeps its first label."""
    return (
        encoded_taxa(backbone, encodings, ranks)
        .groupBy("lvl", "name")
        .agg(F.min(F.struct("position", "label"))["label"].alias("label"))
    )


def encoded_taxa(backbone: DataFrame, encodings: DataFrame, ranks: Sequence[str]) -> DataFrame:
    """Backbone rows of the wanted ranks whose id is encoded at that rank."""
    lvl = F.array_position(F.array(*[F.lit(r) for r in ranks]), F.col("rank")) - 1
    return (
        backbone.filter(F.col("rank").isin(*ranks))
        .withColumn("lvl", lvl.cast("int"))
        .join(encodings.select("lvl", "taxon_id", "label"), ["lvl", "taxon_id"])
    )


def explode_edges(rows: DataFrame) -> DataFrame:
    """Edges from ``(lvl, parent, children)`` rows with a comma list; ``ord`` is the list position."""
    return rows.select(
        "lvl",
        F.col("parent").cast("bigint").alias("parent"),
        F.posexplode(F.split("children", ",")).alias("_pos", "_child"),
    ).select("lvl", "parent", F.col("_child").cast("bigint").alias("child"), F.col("_pos").cast("bigint").alias("ord"))


def collect_edges(edges: DataFrame) -> DataFrame:
    """One ``(lvl, parent, children)`` row per parent, the layout of the hierarchy file.

    The layout puts all children of a parent on one text line, so the size of a group is
    the size of its output row.
    """
    members = F.array_sort(F.collect_list(F.struct("ord", "child")))
    return edges.groupBy("lvl", "parent").agg(
        F.array_join(F.transform(members, lambda x: x["child"].cast("string")), ",").alias("children")
    )


def trained_edges(edges: DataFrame, trained: DataFrame) -> DataFrame:
    """Edges whose child a model can emit."""
    known = trained.select((F.col("lvl") - 1).alias("lvl"), F.col("label").alias("child")).distinct()
    return edges.join(known, ["lvl", "child"], "left_semi").select(*edges.columns)


def dead_ends(edges: DataFrame, trained: DataFrame, n_levels: int) -> DataFrame:
    """Trained labels above the leaf level that have no trained child."""
    alive = trained_edges(edges, trained).select("lvl", F.col("parent").alias("label"))
    return (
        trained.filter(F.col("lvl") < n_levels - 1)
        .select("lvl", "label")
        .distinct()
        .join(alive, ["lvl", "label"], "left_anti")
    )


def orphans(edges: DataFrame, trained: DataFrame) -> DataFrame:
    """Trained labels below the root level that have no parent."""
    known = edges.select((F.col("lvl") + 1).alias("lvl"), F.col("child").alias("label"))
    return trained.filter(F.col("lvl") > 0).select("lvl", "label").distinct().join(known, ["lvl", "label"], "left_anti")


def duplicates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur on more than one row, with their count."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def children_with_many_parents(edges: DataFrame) -> DataFrame:
    """``(lvl, child, n_parents)`` for every child that breaks the tree."""
    return (
        edges.select("lvl", "child", "parent")
        .distinct()
        .groupBy("lvl", "child")
        .agg(F.count(F.lit(1)).alias("n_parents"))
        .filter("n_parents > 1")
    )


def check_edges(edges: DataFrame, strict: bool = False) -> DataFrame:
    """``(lvl, child, n_parents)`` offenders; with ``strict`` any offender is an error."""
    bad = children_with_many_parents(edges)
    if strict:
        raise_if_any(bad, "children with more than one parent")
    return bad


def raise_if_any(bad: DataFrame, what: str) -> None:
    sample = bad.limit(5).collect()
    if sample:
        raise ValueError(f"{what}, for example {[r.asDict() for r in sample]}")


def nodes(edges: DataFrame) -> DataFrame:
    """Every label of the hierarchy once: ``(lvl, label, parent, child_ord, is_parent)``.

    A union and an aggregate rather than a join: its estimated size stays that of the edges,
    so Spark can still see that a small hierarchy fits a broadcast.  A label with two parents is an error.
    """
    one = F.min("above.parent").eqNullSafe(F.max("above.parent"))
    two = F.raise_error(F.concat(F.lit("two parents of label "), F.col("label").cast("string"), F.lit(" at level "), F.col("lvl").cast("string")))
    as_child = edges.select(
        (F.col("lvl") + 1).alias("lvl"),
        F.col("child").alias("label"),
        F.struct(F.col("parent").alias("parent"), F.col("ord").cast("bigint").alias("child_ord")).alias("above"),
        F.lit(False).alias("is_parent"),
    )
    as_parent = edges.select(
        "lvl", F.col("parent").alias("label"), F.lit(None).cast("struct<parent: bigint, child_ord: bigint>").alias("above"), F.lit(True).alias("is_parent")
    )
    return (
        as_child.union(as_parent)
        .groupBy("lvl", "label")
        .agg(F.min("above").alias("above"), one.alias("one"), F.max("is_parent").alias("is_parent"))
        .select("lvl", "label", F.when(F.col("one"), F.col("above.parent")).otherwise(two.cast("bigint")).alias("parent"), "above.child_ord", "is_parent")
    )


def level_index(levels: Sequence[str], name: Column) -> Column:
    """Index of a level name, ``NULL`` for a name that is not listed."""
    pos = F.array_position(F.array(*[F.lit(x) for x in levels]), name)
    return F.when(pos > 0, (pos - 1).cast("int"))
