"""Ordered folds: rows of a key are visited in order with a small carried state.

Rows are streamed in sorted Arrow batches, never gathered per key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from loomframe.session import partition_count


def fold_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    start: Callable[[], Any],
    step: Callable[[Any, Any], tuple],
    outputs: str,
) -> DataFrame:
    """Add the columns ``outputs`` (DDL) that ``step(state, row)`` gives for each row.

    ``start`` makes the mutable state of a new key; ``row`` is a named tuple.
    """
    extra = StructType.fromDDL(outputs)
    names = extra.names
    schema = StructType([*df.schema.fields, *extra.fields])
    fields = [df.columns.index(k) for k in keys]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            results = []
            for row in batch.itertuples(index=False):
                key = tuple(row[i] for i in fields)
                if key != current:
                    current, state = key, start()
                results.append(step(state, row))
            added = pd.DataFrame(results, columns=names, dtype=object)
            yield pd.concat([batch.reset_index(drop=True), added], axis=1)

    return sorted_runs(df, keys, order).mapInPandas(run, schema)


def sorted_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of a key together and in order. The number of partitions is kept as set,
    because Python work is slower than the size of its input suggests."""
    return df.repartition(partition_count(df.sparkSession), *keys).sortWithinPartitions(*keys, *order)
