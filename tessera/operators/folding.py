"""Ordered folds: a small state machine walks each group's rows in order.

Groups stream through partitions sorted by key and order; a worker holds one group's state and one batch, never a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class Machine(Protocol):
    """State of one group: ``step`` takes a row (a named tuple), ``close`` ends the group; both give finished output rows."""

    def step(self, row) -> Iterator[dict]: ...

    def close(self) -> Iterator[dict]: ...


def in_order(rows: DataFrame, keys: list[str], order: list[str], machine: Callable[[], Machine], columns: list[str], schema: str) -> DataFrame:
    """``keys`` and ``columns`` of what each group's machine gives, one shuffle by ``keys``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for pdf in parts:
            out: list[dict] = []
            for own, r in zip(pdf[keys].itertuples(index=False, name=None), pdf.itertuples(index=False), strict=True):
                if own != key or state is None:
                    if state is not None:
                        out += [dict(zip(keys, key, strict=True)) | x for x in state.close()]
                    key, state = own, machine()
                out += [dict(zip(keys, key, strict=True)) | x for x in state.step(r)]
            yield pd.DataFrame(out, columns=[*keys, *columns])
        if state is not None:
            yield pd.DataFrame([dict(zip(keys, key, strict=True)) | x for x in state.close()], columns=[*keys, *columns])

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
