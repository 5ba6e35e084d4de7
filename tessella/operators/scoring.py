"""Batch scoring with a model of any kind."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def score(df: DataFrame, make_model: Callable[[], Callable[[np.ndarray], np.ndarray]], features: str, output: str = "y_prob", batch_rows: int = 1024) -> DataFrame:
    """`df` with `output`: the model is made once in each task and called with matrices of rows.

    `features` is an array column of one length; a null in it is an error of the caller.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(output, T.DoubleType())])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for batch in batches:
            for at in range(0, len(batch), batch_rows):
                part = batch.iloc[at : at + batch_rows]
                yield part.assign(**{output: np.asarray(model(np.stack(part[features].to_list())), dtype=np.float64)})

    return df.mapInPandas(work, schema)
