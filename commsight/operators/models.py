"""M1: send one prompt per row to a caller-supplied model function.

No model client ships with this package.  The caller passes a function that
maps a pandas Series of prompts to a Series of replies (one batched call per
Arrow batch); tests pass a pure stub.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def model_map(df: DataFrame, fn: Callable[[pd.Series], pd.Series], prompt_col: str,
              out: str = "reply") -> DataFrame:
    """Add ``out`` = fn(prompt) for every row, batch by batch (``mapInPandas``)."""
    schema = T.StructType(list(df.schema.fields) + [T.StructField(out, T.StringType())])

    def run(batches):
        for pdf in batches:
            replies = fn(pdf[prompt_col])
            pdf = pdf.copy()
            pdf[out] = pd.Series(replies, index=pdf.index).astype("object")
            yield pdf

    return df.mapInPandas(run, schema)
