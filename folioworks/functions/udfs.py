"""Functions of users' own kind: a table function from a document to its pages, an aggregate over a group's values."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType


@F.udtf(returnType=StructType([StructField("page_number", IntegerType()), StructField("text", StringType())]))
class TextPages:
    """The pages of a text, which form feeds end: (page_number, text), from 1."""

    def eval(self, text: str | None) -> Iterator[tuple[int, str]]:
        if text is not None:
            for i, page in enumerate(text.split("\f")):
                yield i + 1, page


@F.pandas_udf(DoubleType())
def trimmed_mean(values: pd.Series) -> float:
    """The mean without the lowest and the highest tenth; a group's values are one batch."""
    v = values.dropna().sort_values()
    cut = len(v) // 10
    return float(v.iloc[cut : len(v) - cut].mean()) if len(v) else float("nan")
