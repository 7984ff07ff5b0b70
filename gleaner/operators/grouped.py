"""Grouped functions over sorted partitions: no per-group overhead for many small groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def map_groups(df: DataFrame, keys: list[str], order: list[str], f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """`f` on each group of equal (non-null) `keys`, its rows sorted by `order`; a group comes whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            changed = np.zeros(len(pdf), bool)
            for k in keys:
                v = pdf[k].to_numpy()
                changed[1:] |= v[1:] != v[:-1]
            edges = np.flatnonzero(changed)
            starts = np.r_[0, edges]
            done = [f(pdf.iloc[a:b]) for a, b in zip(starts[:-1], starts[1:])]
            if done:
                yield pd.concat(done, ignore_index=True)
            rest = pdf.iloc[starts[-1] :]
        if rest is not None and len(rest):
            yield f(rest)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
