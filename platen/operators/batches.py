"""Page kernels over columns: many pages at once, as arrays.

One exchange by page, if its rows are not together already; then rows stream in
order, gathered into tables of whole pages of about ROWS rows, so memory follows
that number and the largest page.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from platen.operators.pages import PAGE

ROWS = 100_000


#: Of the rows of runs, how far each number goes on from one character to the next.
STEPS = {"x0": "step_x", "x1": "step_x", "top": "step_y", "bottom": "step_y", "char_index": "step_index"}
STEP_COLUMNS = ("step_x", "step_y", "step_index")


def whole_pages(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int | None = None) -> Iterator[pa.Table]:
    """Tables that end where a page ends; a run counts as its characters."""
    held: list[pa.RecordBatch] = []
    count = size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        size += weight(batch)
        if size < (rows or ROWS):
            continue
        table = pa.Table.from_batches(held)
        last = table.slice(count - 1, 1).select(keys).to_pylist()[0]
        # the last page may go on in the next batch
        same = np.ones(count, bool)
        for k in keys:
            same &= np.asarray(pc.equal(table.column(k), pa.scalar(last[k], table.schema.field(k).type)) if last[k] is not None else pc.is_null(table.column(k)))
        cut = int(np.argmax(same)) if same.any() else count
        if cut:
            yield table.slice(0, cut).combine_chunks()
        held, count = table.slice(cut).combine_chunks().to_batches(), count - cut
        size = sum(map(weight, held))
    if count:
        yield pa.Table.from_batches(held).combine_chunks()


def weight(batch: pa.RecordBatch) -> int:
    return pc.sum(pc.utf8_length(batch.column("text"))).as_py() or 0 if STEP_COLUMNS[0] in batch.schema.names else batch.num_rows


def letters(texts: pa.Array, whole: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray]:
    """The characters of all texts, and how many each text has; no byte is copied. whole: of which texts each is one character, whatever its length."""
    texts = texts.fill_null("") if texts.null_count else texts
    _, ends, data = texts.buffers()
    at = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    begins = (raw & 0xC0) != 0x80
    empty = at[:0]
    if whole is not None and whole.any():
        size = np.diff(at)
        begins &= ~np.repeat(whole, size)
        begins[at[:-1][whole & (size > 0)] - at[0]] = True
        empty = at[:-1][whole & (size == 0)]
    before = np.concatenate([[0], np.cumsum(begins)])[at - at[0]]
    cut = np.append(np.flatnonzero(begins) + at[0], at[-1])
    counts = np.diff(before)
    if len(empty):
        cut = np.sort(np.append(cut, empty))
        counts = np.where(whole, 1, counts)
    cut = cut.astype(np.int32)
    return pa.StringArray.from_buffers(len(cut) - 1, pa.py_buffer(cut), data), counts


def characters(table: pa.Table) -> tuple[pa.Array, np.ndarray, Callable[[str], np.ndarray]]:
    """Of rows that are characters or runs of them: the text of each character, its row, and its numbers by name. Among runs, a row without steps is one character."""
    texts = table.column("text").combine_chunks()
    texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) and texts.num_chunks == 1 else pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
    if STEP_COLUMNS[0] not in table.column_names:
        return texts, np.arange(table.num_rows), lambda name: numbers(table, name)
    alone = table.column(STEP_COLUMNS[0])
    texts, counts = letters(texts, np.asarray(pc.is_null(alone)) if alone.null_count else None)
    row = np.repeat(np.arange(table.num_rows), counts)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)

    def of(name: str) -> np.ndarray:
        v = numbers(table, name)[row]
        return v + nth * np.asarray(table.column(STEPS[name]).fill_null(0))[row] if name in STEPS else v

    return texts, row, of


def numbers(table: pa.Table, name: str) -> np.ndarray:
    v = table.column(name)
    if pa.types.is_integer(v.type):
        return np.asarray(v)
    return np.asarray(pc.fill_null(v, float("nan")) if v.null_count else v, float)


def in_order(*keys: np.ndarray) -> np.ndarray:
    """np.lexsort, whose last key leads; nothing is sorted where rows are in order already."""
    before, equal = np.zeros(max(len(keys[0]) - 1, 0), bool), np.ones(max(len(keys[0]) - 1, 0), bool)
    for k in reversed(keys):
        before |= equal & (k[:-1] < k[1:])
        equal &= k[:-1] == k[1:]
    return np.arange(len(keys[0])) if (before | equal).all() else np.lexsort(keys)


def page_batches(df: DataFrame, kernel: Callable[[pa.Table, np.ndarray], pa.Table | None], schema: str, keys: list[str] | None = None, order: list[str] | None = None, together: bool = False) -> DataFrame:
    """kernel(rows of whole pages, number of each row's page) -> rows of the schema. together: each page's rows stand in one partition, one after another and in order, so nothing moves."""
    keys, order = keys or PAGE, order or []
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_pages(batches, keys):
            out = kernel(table, page_numbers(table, keys))
            if out is not None and out.num_rows:
                for batch in out.cast(arrow).to_batches(max_chunksize=20_000):
                    yield batch

    placed = df if together else df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return placed.mapInArrow(run, schema)


def page_numbers(table: pa.Table, keys: list[str]) -> np.ndarray:
    """0, 1, ... by runs of equal keys."""
    new = np.zeros(table.num_rows, bool)
    for k in keys:
        v = table.column(k)
        v = np.asarray(pc.fill_null(v, -(1 << 31)) if v.null_count and pa.types.is_integer(v.type) else v)
        new[1:] |= v[1:] != v[:-1]
    return np.cumsum(new)


def flags(texts: pa.Array | pa.ChunkedArray, *tests: Callable[[str], bool]) -> list[np.ndarray]:
    """Each test of each text, made once for each distinct one."""
    coded = pc.dictionary_encode(texts)
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
    known = coded.dictionary.to_pylist()
    at = np.asarray(coded.indices.fill_null(len(known))) if coded.indices.null_count else np.asarray(coded.indices)
    return [np.array([test(t) for t in known] + [False])[at] for test in tests]


def joined(texts: pa.Array, starts: np.ndarray) -> pa.Array:
    """Runs of texts put together, each from one start to the next; no byte is copied."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.fill_null("") if texts.null_count else texts
    _, ends, data = texts.buffers()
    at = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    cut = np.ascontiguousarray(at[np.append(starts, len(texts))], np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(cut), data)


def lists(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Runs of numbers as lists."""
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), pa.array(values))


def run_starts(*columns: np.ndarray) -> np.ndarray:
    """Where any of the columns changes, and 0."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for v in columns:
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)
