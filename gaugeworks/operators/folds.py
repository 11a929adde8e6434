"""Folds over the rows of a key in order, in one pass over sorted partitions."""

from __future__ import annotations

import sys
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import from_arrow_schema

from ..shipping import ship


def sorted_fold(df: DataFrame, key: str, order: list[str], out: pa.Schema, begin: Callable, step: Callable, end: Callable | None = None) -> DataFrame:
    """Rows of each key in `order` through step(state, *row), which returns output rows; begin() makes a key's state, end(key,
    state) may give last rows.

    One shuffle on the key and a sort inside partitions (which spills); rows stream through Python in Arrow batches and
    only the state of one key is held, so a key of any length takes linear time and no more memory. df's columns are
    what step gets; its first one must be the key.
    """
    columns = df.columns

    def run(batches):
        now, state, known = None, None, False
        for b in batches:
            rows: list[tuple] = []
            for row in zip(*(b.column(c).to_pylist() for c in columns)):
                if not known or row[0] != now:
                    if known and end is not None:
                        rows += end(now, state)
                    now, state, known = row[0], begin(), True
                rows += step(state, *row)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)
        if known and end is not None and (rows := end(now, state)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, from_arrow_schema(out))


ship(sys.modules[__name__])
