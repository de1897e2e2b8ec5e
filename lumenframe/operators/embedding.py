"""Embeddings of count profiles: a model if the caller has one, else principal components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from .vectors import principal_components, project

Model = Callable[[DataFrame], DataFrame]


def dense_profiles(values: DataFrame, genes: DataFrame, cell: str = "cell_id", value: str = "value", cells: DataFrame | None = None) -> DataFrame:
    """(cell, profile): values by gene in dictionary order, zeros where there are none; for panels of a few thousand genes. ``cells``: all
    cells, of which some may have no counts; their profiles are zeros. Values of genes that the dictionary lacks are left out."""
    numbered = values.join(genes.select("gene", "gene_idx"), "gene").groupBy(cell).agg(F.map_from_entries(F.collect_list(F.struct("gene_idx", value))).alias("m"))
    if cells is not None:
        numbered = cells.select(cell).distinct().join(numbered, cell, "left")
    size = genes.agg(F.max("gene_idx") + 1).first()[0] or 0
    at = F.sequence(F.lit(0), F.lit(size - 1)) if size else F.array().cast("array<int>")
    return numbered.select(cell, F.transform(at, lambda i: F.coalesce(F.element_at("m", i.cast("int")), F.lit(0.0))).alias("profile"))


def profile_embedding(profiles: DataFrame, k: int, model: Model | None = None, vector: str = "profile", name: str = "embedding", centred: bool = True) -> tuple[DataFrame, str]:
    """``profiles`` with ``name`` and how it was made: by the model, or by principal components without one or when it fails to load."""
    if model is not None:
        try:
            return model(profiles), "model"
        except ImportError:
            pass
    mean, parts, _ = principal_components(profiles, vector, k, centred)
    return project(profiles, vector, mean, parts, name), "pca" if centred else "svd"


def fused_embedding(df: DataFrame, first: str, second: str, name: str = "fused") -> DataFrame:
    return df.withColumn(name, S.mean_vector(F.col(first), F.col(second)))
