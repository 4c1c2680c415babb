"""Submission tables."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hierspark.functions.paths import unpack
from hierspark.functions.text import last_word, percent_text
from hierspark.operators.labels import known_or_raise, with_names
from hierspark.operators.skew import is_small, salted_join
from hierspark.schema import LEVELS

# Fixed values written into every submission row.
KINGDOM = "Plantae"
TEAM = "plant_image"
METHOD = "ML_plant_ensemble"
PREPARATIONS = "image_segmentation"
COLLECTION_METHOD = "MachineObservation"
NOT_AVAILABLE = "NA"
SUBMISSION_COLUMNS = (
    "sampling_event_id", "clip_file_path", "team", "inat_code", "preparations",
    "collection_method", "identification_method", "aiml_name",
    "kingdom", "phylum", "class", "order", "family", "genus", "species",
    "scientific_name", "taxon_rank", "confidence_percent",
    "verification_method", "verification_name", "occurrence_remarks",
    "individual_count", "organism_quantity", "organism_quantity_type",
    "references", "notes",
)
# Columns of the short layout.
SHORT_COLUMNS = (
    "photoid", "kingdom", "phyla", "class", "order", "family", "genus", "species_epithet",
    "taxon_rank", "identification_method", "confidence_percent",
)


def named_paths(decoded: DataFrame, names: DataFrame, phyla: DataFrame, n_levels: int) -> DataFrame:
    """Path columns with ``name0 …`` and the ``phylum`` of the root label.

    ``phyla(label, phylum)`` names the phylum of each root label.
    """
    flat = decoded.select("*", *unpack("path", n_levels)).drop("path")
    return _with_phyla(with_names(flat, names, n_levels), phyla)


def submission(
    named: DataFrame, event_id: str, input_dir: str, ranks: Sequence[str] = LEVELS
) -> DataFrame:
    """The 26 submission columns.  ``ranks`` names the level of each path position.

    Expects paths with ``rank_lvl`` and ``confidence``; blanked levels are empty text.
    """
    taxa = _taxa(ranks)
    fixed = {
        "sampling_event_id": F.lit(event_id),
        "clip_file_path": F.concat(F.lit(input_dir.rstrip("/") + "/"), F.col("id").cast("string")),
        "team": F.lit(TEAM),
        "preparations": F.lit(PREPARATIONS),
        "collection_method": F.lit(COLLECTION_METHOD),
        "identification_method": F.lit(METHOD),
        "aiml_name": F.lit(METHOD),
        "kingdom": F.lit(KINGDOM),
        "phylum": F.coalesce("phylum", F.lit("")),
        "scientific_name": F.concat(taxa["genus"], F.lit(" "), taxa["species"]),
        "taxon_rank": F.coalesce(_rank_name(ranks), F.lit("")),
        "confidence_percent": percent_text(F.col("confidence")),
        **taxa,
    }
    return named.select(*[fixed.get(c, F.lit(NOT_AVAILABLE)).alias(c) for c in SUBMISSION_COLUMNS])


def submission_short(
    named: DataFrame, ranks: Sequence[str] = LEVELS, conf: str = "conf", rank: Column | None = None
) -> DataFrame:
    """The older layout: untruncated path, confidence of the whole path, rank of the leaf unless given."""
    taxa = _taxa(ranks)
    values = {
        "photoid": F.col("id").cast("string"),
        "kingdom": F.lit(KINGDOM),
        "phyla": F.coalesce("phylum", F.lit("")),
        "species_epithet": taxa["species"],
        "taxon_rank": F.lit(ranks[-1]) if rank is None else rank,
        "identification_method": F.lit(METHOD),
        "confidence_percent": percent_text(F.col(conf)),
        **taxa,
    }
    return named.select(*[values[c].alias(c) for c in SHORT_COLUMNS])


def debug_paths(decoded: DataFrame, ranks: Sequence[str] = LEVELS) -> DataFrame:
    """``photoid``, one label column per rank, then one probability column per rank."""
    nodes = [F.col("path")[k] for k in range(len(ranks))]
    return decoded.select(
        F.col("id").alias("photoid"),
        *[n["label"].alias(r) for n, r in zip(nodes, ranks)],
        *[n["prob"].alias(f"p_{r}") for n, r in zip(nodes, ranks)],
    )


def gated_report(gated: DataFrame, names: DataFrame, phyla: DataFrame, ranks: Sequence[str] = LEVELS) -> DataFrame:
    """Back-filled gated paths in the short layout; the rank is the deepest kept label."""
    n = len(ranks)
    named = _with_phyla(with_names(gated, names, n), phyla)
    rank = F.coalesce(*[F.when(F.col(f"l{k}").isNotNull(), F.lit(ranks[k])) for k in reversed(range(n))], F.lit(""))
    return submission_short(named, ranks, conf="score", rank=rank)


def _with_phyla(named: DataFrame, phyla: DataFrame) -> DataFrame:
    """A handful of root labels serve all ids, so the rows are spread by id; a root label without a phylum is an error."""
    return known_or_raise(salted_join(named, phyla.withColumnRenamed("label", "l0"), ["l0"], ["id"], how="left", broadcast=is_small(phyla)), "l0", "phylum")


def _taxa(ranks: Sequence[str]) -> dict[str, Column]:
    """Name per rank; the species name is reduced to its epithet, an unused rank is empty."""
    out = {}
    for rank in LEVELS:
        name = F.coalesce(f"name{list(ranks).index(rank)}", F.lit("")) if rank in ranks else F.lit("")
        out[rank] = last_word(name) if rank == "species" else name
    return out


def _rank_name(ranks: Sequence[str]) -> Column:
    # element_at on an array without nulls is taken as never null, even for a null index
    name = F.element_at(F.array(*[F.lit(r) for r in ranks]), F.col("rank_lvl") + 1)
    return F.when(F.col("rank_lvl").isNotNull(), name)
