"""Label lists, encodings and names."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hierspark.operators.skew import is_small, salted_join


def explode_label_list(lists: DataFrame, numeric_order: bool = False) -> DataFrame:
    """``trained(lvl, pos, label)`` from ``(lvl, labels)`` rows with a comma list.

    ``numeric_order`` sorts the labels as numbers instead of keeping the listed order.
    """
    labels = F.split("labels", ",").cast("array<bigint>")
    if numeric_order:
        labels = F.array_sort(labels)
    return lists.select("lvl", F.posexplode(labels).alias("pos", "label"))


def look_up(rows: DataFrame, lookup: DataFrame, keys: list[str], found: str, strict: bool = True, spread: list[str] | None = None) -> DataFrame:
    """Add the columns of ``lookup``; a key that it lacks is an error, or drops the row when ``strict`` is off.

    One key may own a large share of the rows, so they are spread by ``spread`` (all other columns by default).
    ``found`` is a column of the look-up that is never NULL there.
    """
    if not strict:
        return salted_join(rows, lookup, keys, spread or _others(rows, keys))
    joined = salted_join(rows, lookup, keys, spread or _others(rows, keys), how="left")
    known = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit("NULL"))) for k in keys])
    value = F.when(F.col(found).isNotNull(), F.col(found)).otherwise(F.raise_error(F.concat(F.lit(f"no {found} for "), known)))
    return joined.withColumn(found, value)


def _others(rows: DataFrame, keys: list[str]) -> list[str]:
    return [c for c in rows.columns if c not in keys] or keys


def decode_output(outputs: DataFrame, trained: DataFrame, encodings: DataFrame, strict: bool = True) -> DataFrame:
    """Model output position -> trained label -> taxon id, for rows with ``(lvl, pos)``.

    A position or label that is not listed is an error, or drops the row when ``strict`` is off.
    """
    return look_up(look_up(outputs, trained, ["lvl", "pos"], "label", strict), encodings, ["lvl", "label"], "taxon_id", strict)


def encode(taxa: DataFrame, encodings: DataFrame, strict: bool = True) -> DataFrame:
    """Taxon id -> label, for rows with ``(lvl, taxon_id)``; a taxon without a label as above."""
    return look_up(taxa, encodings, ["lvl", "taxon_id"], "label", strict)


def missing_keys(rows: DataFrame, lookup: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of ``rows`` that the look-up table lacks."""
    return rows.select(*keys).distinct().join(lookup, keys, "left_anti")


def class_index(rows: DataFrame, label: str) -> DataFrame:
    """``(class_label, class_idx)``: dense zero-based index in the lexical order of the label text.

    Only the distinct labels are ordered, as many rows as a model has classes.
    """
    w = Window.orderBy("class_label")
    return (
        rows.select(F.col(label).cast("string").alias("class_label"))
        .distinct()
        .withColumn("class_idx", (F.row_number().over(w) - 1).cast("int"))
    )


def with_names(paths: DataFrame, names: DataFrame, n_levels: int, strict: bool = True) -> DataFrame:
    """Add ``name0, name1, …`` for the label columns ``l0, l1, …``; an unused level (NULL label) has no name.

    A label that ``names`` lacks is an error, or has no name when ``strict`` is off.  One label may win for a large share
    of the ids, so its rows are spread by id.
    """
    out, broadcast = paths, is_small(names)
    for k in range(n_levels):
        at = names.filter(F.col("lvl") == k).select(F.col("label").alias(f"l{k}"), F.col("name").alias(f"name{k}"))
        out = known_or_raise(salted_join(out, at, [f"l{k}"], ["id"], how="left", broadcast=broadcast), f"l{k}", f"name{k}", strict)
    return out


def known_or_raise(joined: DataFrame, key: str, found: str, strict: bool = True) -> DataFrame:
    """After a left join: a key that is not NULL must have found something."""
    if not strict:
        return joined
    message = F.concat(F.lit(f"no {found} for {key}="), F.col(key).cast("string"))
    return joined.withColumn(found, F.when(F.col(key).isNull() | F.col(found).isNotNull(), F.col(found)).otherwise(F.raise_error(message).cast("string")))
