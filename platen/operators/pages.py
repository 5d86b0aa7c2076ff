"""Running a sequential kernel page by page without one Python call per page."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

PAGE = ["doc_id", "page_number"]


def by_page(df: DataFrame) -> DataFrame:
    """Rows of a page together; later windows, joins and aggregates by page reuse this one exchange."""
    return df.repartition(*PAGE)


def page_kernel(df: DataFrame, kernel: Callable[[list[dict]], list[tuple]], schema: str, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """kernel(rows of one page, in order) -> tuples of what follows the keys in the schema.

    Batches stream and only a page is held at a time, beside the batch.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    keys = keys or PAGE
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key: tuple | None = None
        rows: list[dict] = []
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [()] * len(kinds)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kinds, strict=True)], schema=kinds)

        for batch in batches:
            names = batch.schema.names
            at = [names.index(k) for k in keys]
            for values in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                key = tuple(values[i] for i in at)
                if key != open_key:
                    if rows:
                        out += [(*open_key, *t) for t in kernel(rows)]
                    open_key, rows = key, []
                rows.append(dict(zip(names, values, strict=True)))
            if len(out) >= 2000:
                yield flush()
        if rows:
            out += [(*open_key, *t) for t in kernel(rows)]
        if out:
            yield flush()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
