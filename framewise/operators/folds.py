"""Folds over a recording's rows in order, in bounded memory: sorted partitions, read batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

Take = Callable[[Any, pd.DataFrame], pd.DataFrame]


def folded(batches: Iterable[pd.DataFrame], make: Callable[[], Any], take: Take, close: Callable[[Any, Any], pd.DataFrame] | None) -> Iterator[pd.DataFrame]:
    """take(state, rows) for each stretch of equal rec within a batch, and close(state, rec) where a recording ends.

    Rows come sorted by rec. The state goes from a recording's rows in one batch to those in the next; no more
    than one batch is held.
    """
    own, rec, open_ = None, None, False
    for batch in batches:
        if not len(batch):
            continue
        starts = (batch["rec"].ne(batch["rec"].shift()) & ~(batch["rec"].isna() & batch["rec"].shift().isna())).to_numpy().nonzero()[0].tolist() or [0]
        starts = [0, *[i for i in starts if i]]
        for lo, hi in zip(starts, [*starts[1:], len(batch)], strict=True):
            rows = batch.iloc[lo:hi]
            here = rows["rec"].iloc[0]
            if not open_ or not (here == rec or pd.isna(here) and pd.isna(rec)):
                if open_ and close is not None:
                    yield close(own, rec)
                own, rec, open_ = make(), here, True
            yield take(own, rows)
    if open_ and close is not None:
        yield close(own, rec)


def fold(df: DataFrame, order: str, schema: str, make: Callable[[], Any], take: Take, close: Callable[[Any, Any], pd.DataFrame] | None = None) -> DataFrame:
    """Rows of a fold over each rec in the order of a column: one shuffle by rec and a sort that spills."""
    names = [x.strip().split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in folded(batches, make, take, close):
            if len(out):
                yield out[names]

    return df.repartition("rec").sortWithinPartitions("rec", order).mapInPandas(run, schema)
