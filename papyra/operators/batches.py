"""A batched user map over a DataFrame (Arrow batches through ``mapInPandas``).

This is the extension point for user code that is genuinely per-record
Python; the built-in operators never go through it.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str,
                remove_columns: list[str] | None = None) -> DataFrame:
    """Apply ``fn`` to every Arrow batch; ``schema`` names the columns that it returns.

    ``fn`` sees all columns. Its result is put beside the batch's other columns, after ``remove_columns`` are dropped;
    a returned column replaces one of the same name. A batch function that changes the number of rows must remove all
    columns that it does not return.
    """
    new = StructType.fromDDL(schema)
    gone = {*(remove_columns or []), *new.names}
    kept = [f for f in df.schema.fields if f.name not in gone]
    names = [f.name for f in kept]

    def run(batches):
        for batch in batches:
            out = fn(batch)[new.names].reset_index(drop=True)
            if names and len(out) != len(batch):
                raise ValueError("the batch function changed the number of rows, but columns pass through")
            yield pd.concat([batch[names].reset_index(drop=True), out], axis=1) if names else out

    return df.mapInPandas(run, StructType([*kept, *new.fields]))


def text_stats(batch: pd.DataFrame) -> pd.DataFrame:
    """Example batch function: character and line counts of ``x``."""
    x = batch["x"].fillna("")
    return pd.DataFrame({"idx": batch["idx"], "n_chars": x.str.len().astype("int64"),
                         "n_lines": (x.str.count("\n") + 1).astype("int64")})
