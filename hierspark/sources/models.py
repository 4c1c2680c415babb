"""Fitted models, one folder per level."""

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel


def model_path(root: str, level: str, kind: str) -> str:
    return f"{root.rstrip('/')}/{level}_{kind}_model"


def save_models(models: Mapping[str, PipelineModel], root: str, kind: str) -> None:
    """``kind`` is ``PCA`` or ``logistic``."""
    for level, model in models.items():
        model.write().overwrite().save(model_path(root, level, kind))


def load_models(root: str, levels: Sequence[str], kind: str) -> dict[str, PipelineModel]:
    return {level: PipelineModel.load(model_path(root, level, kind)) for level in levels}
