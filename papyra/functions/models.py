"""The model dimension as a literal fan-out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyra import DEFAULT_MODELS


def model_array(models=DEFAULT_MODELS) -> Column:
    """Models as a literal array of (model, model_pos) structs.

    Exploding it gives every row once per model: a bounded fan-out fixed by
    the configuration, with no join against a model table.
    """
    return F.array(*[F.struct(F.lit(m).alias("model"), F.lit(i).cast("bigint").alias("model_pos"))
                     for i, m in enumerate(models)])
