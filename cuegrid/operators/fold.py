"""Sequential folds over ordered groups, streamed: a task holds one row's state, never a group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], schema: str, arrow: pa.Schema) -> DataFrame:
    """Rows are hash-partitioned by ``keys`` and sorted; ``start()`` makes a folder with ``row(values) -> list`` and ``end() -> list``.

    ``values`` is the row as a dict; both methods return output tuples.  An empty input gives an empty output.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, f, out = None, None, []

        def flush() -> pa.RecordBatch:
            c = list(zip(*out)) or [[]] * len(arrow)
            out.clear()
            return pa.record_batch([pa.array(list(x), t.type) for x, t in zip(c, arrow)], schema=arrow)

        for b in batches:
            for values in zip(*(b.column(c).to_pylist() for c in cols)):
                row = dict(zip(cols, values))
                k = tuple(row[x] for x in keys)
                if f is None or k != key:
                    if f is not None:
                        out.extend(f.end())
                    key, f = k, start()
                out.extend(f.row(row))
            if len(out) > 10_000:
                yield flush()
        if f is not None:
            out.extend(f.end())
        yield flush()

    return df.repartition(n, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
