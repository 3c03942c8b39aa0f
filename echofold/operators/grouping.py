"""Sequential folds over small groups, streamed: no task holds more than one group."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

FLUSH = 5000


def fold(df: DataFrame, by: list[str], order: list[str], kernel: Callable[[list[dict]], Iterable[tuple]], schema: str) -> DataFrame:
    """kernel(rows of one group, in order) gives output rows; groups are hash-partitioned and sorted by Spark."""
    out = T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out)
        done: list[tuple] = []

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], f.type) for k, f in enumerate(arrow)], schema=arrow)
            done.clear()
            return batch

        now, rows = None, []
        for batch in batches:
            for r in batch.to_pylist():
                key = tuple(r[c] for c in by)
                if key != now:
                    if rows:
                        done.extend(kernel(rows))
                    now, rows = key, []
                    if len(done) >= FLUSH:
                        yield flush()
                rows.append(r)
        if rows:
            done.extend(kernel(rows))
        yield flush()

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *by).sortWithinPartitions(*by, *order).mapInArrow(run, out)


def each(df: DataFrame, kernel: Callable[[dict], Iterable[tuple]], schema: str) -> DataFrame:
    """kernel(row) gives output rows, for every row by itself."""
    out = T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out)
        for batch in batches:
            done = [x for r in batch.to_pylist() for x in kernel(r)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], f.type) for k, f in enumerate(arrow)], schema=arrow)

    return df.mapInArrow(run, out)
