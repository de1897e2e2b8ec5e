"""Arrow functions over partitions."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """df.mapInArrow, with this library on the workers' path if it isn't installed there but lies where it does here."""
    environment, root = df.sparkSession.sparkContext.environment, str(Path(__file__).parents[2])
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join(p for p in [root, *paths] if p)
    return df.mapInArrow(function, schema)
