"""Aggregates and table functions that aren't built in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def geometric_mean(values: pd.Series) -> float:
    """Of positive numbers; NaN where one is negative, nulls left out, null without any. A group's values meet in one worker."""
    values = values.dropna()
    return float(np.exp(np.log(values).mean())) if len(values) else None


@F.udtf(returnType="chunk_no: bigint, start_index: bigint, chunk: string")
class ChunkText:
    """Pieces of ``size`` characters, each beginning ``overlap`` before the last one's end; none of a null text."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple]:
        if text is None:
            return
        step = size - overlap
        for k, at in enumerate(range(0, max(len(text) - overlap, 1), step)):
            yield k, at, text[at : at + size]
