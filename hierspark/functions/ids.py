"""Identifiers derived from file names, paths and column names."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Image suffixes that are scored, compared in lower case.
IMAGE_SUFFIXES = ("jpg", "jpeg", "png")


def photo_id(file_name: Column) -> Column:
    """Text before the first dot."""
    return F.split_part(file_name, F.lit("."), F.lit(1))


def original_id(photo: Column, delimiter: str = "") -> Column:
    """Text before the first delimiter; an empty delimiter keeps the id as it is."""
    return F.split_part(photo, F.lit(delimiter), F.lit(1)) if delimiter else photo


def strip_original(photo: Column) -> Column:
    return F.split_part(photo, F.lit("_original"), F.lit(1))


def base_name(path: Column) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(-1))


def parent_folder(path: Column) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(-2))


def suffix(file_name: Column) -> Column:
    """Lower-case text after the last dot, empty without a dot."""
    return F.when(F.contains(file_name, F.lit(".")), F.lower(F.split_part(file_name, F.lit("."), F.lit(-1)))).otherwise("")


def is_image(file_name: Column) -> Column:
    return suffix(file_name).isin(*IMAGE_SUFFIXES)


def log_level(file_name: Column) -> Column:
    """Level name: the third underscore token of a score log's file name."""
    return F.split_part(F.split_part(file_name, F.lit("_"), F.lit(3)), F.lit("."), F.lit(1))


def is_score_log(file_name: Column) -> Column:
    return F.contains(file_name, F.lit("log_inference"))


def score_column(level: Column, label: Column) -> Column:
    return F.concat_ws("_", level, label.cast("string"))
