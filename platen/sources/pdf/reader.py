"""PDF files as Spark relations.

A file is read once by one task (or, cut by slice_bytes, by a task for each
slice of its pages) into typed rows: the columns of the key, and a struct for
each relation asked for, of which a row fills its own. Relations that are not
asked for are not built, and a page is only interpreted if one needs it. A
broken file gives a warning row, never a failed job.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import replace
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from platen.operators.batches import STEP_COLUMNS
from platen.operators.batches import STEPS as STEP_OF
from platen.options import ExtractOptions
from platen.sources.pdf.document import Pdf

_BOX = "x0 double, top double, x1 double, bottom double"
_COLOR = "struct<space:string,components:array<float>>"
RELATIONS = {
    "pages": "width double, height double, rotation int, media_box array<double>, crop_box array<double>, trim_box array<double>, bleed_box array<double>, art_box array<double>",
    "chars": f"char_index bigint, text string, {_BOX}, fontname string, size double, doctop double, upright boolean, direction string, ctm array<double>, char_code bigint, mcid bigint, tag string, stroking_color {_COLOR}, non_stroking_color {_COLOR}",
    "lines": f"{_BOX}, line_width double, stroke_color {_COLOR}, orientation string",
    "rects": f"{_BOX}, line_width double, stroke boolean, fill boolean, stroke_color {_COLOR}, fill_color {_COLOR}",
    "curves": f"{_BOX}, pts array<struct<x:double,y:double>>, line_width double, stroke boolean, fill boolean, stroke_color {_COLOR}, fill_color {_COLOR}",
    "images": f"{_BOX}, width double, height double, name string, src_width bigint, src_height bigint, bits_per_component bigint, color_space string, filter string, data binary",
    "annotations": f"{_BOX}, type string, contents string, author string, date string, raw_subtype string",
    "hyperlinks": f"{_BOX}, uri string",
    "bookmarks": "ordinal bigint, title string, level bigint, page bigint, dest_top double",
    "form_fields": f"name string, type string, value string, default_value string, {_BOX}, options array<string>, flags bigint",
    "signatures": "name string, signer string, date string, reason string, location string, contact string, is_signed boolean",
    "struct_elements": "node_id bigint, parent_id bigint, ancestors array<bigint>, depth bigint, preorder bigint, type string, mcids array<bigint>, alt string, actual_text string, lang string",
    "metadata": "title string, author string, subject string, keywords string, creator string, producer string, creation_date string, mod_date string, page_count bigint",
    "warnings": "code string, description string, element string, operator_index bigint",
    "validation_issues": "severity string, code string, message string, location string",
    "repair_log": "entry string",
}
KEY = "doc_id long, path string, kind string, page_number int, idx long"
STEPS = ", step_x double, step_y double, step_index bigint"
BATCH_ROWS = 4000


def row_schema(kinds: Iterable[str], columns: dict[str, list[str]] | None = None, runs: bool = False) -> str:
    """The schema of rows that hold these relations, of some only the columns named; with runs, characters have their steps."""

    def fields(kind: str) -> str:
        wanted = (columns or {}).get(kind)
        own = StructType.fromDDL(RELATIONS[kind]).fields if wanted else []
        said = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own if f.name in wanted) if wanted else RELATIONS[kind]
        return said + STEPS if runs and kind == "chars" else said

    return ", ".join([KEY, *(f"{k} struct<{fields(k)}>" for k in kinds)])


ROW = row_schema(RELATIONS)


class Backend(Protocol):
    """What opens a file: anything with the pages and the rows of a document in place of Pdf."""

    pages: list

    def __init__(self, data: bytes, options: ExtractOptions): ...

    def document_rows(self, kinds: frozenset[str] | None) -> Iterator[tuple[str, int | None, dict]]: ...

    def page_rows(self, i: int, kinds: frozenset[str] | None) -> Iterator[tuple[str, dict]]: ...


def rows_of(data: bytes | None, options: ExtractOptions, pages: set[int] | None = None, kinds: Iterable[str] | None = None, part: tuple[int, int] = (0, 1), backend: type[Backend] = Pdf) -> Iterator[tuple[str, int | None, int, dict]]:
    """(kind, page, ordinal, row). Limits on objects and image bytes count over the document; one beyond them gives a warning and nothing else.

    part (i, n): every n-th page from the i-th on; the document's own rows come with the first part.
    """
    wanted = None if kinds is None else frozenset(kinds)
    limited = options.max_total_objects is not None or options.max_total_image_bytes is not None
    count: dict[tuple, int] = {}

    def row(kind: str, page: int | None, payload: dict):
        n = count[kind, page] = count.get((kind, page), -1) + 1
        return kind, page, n, payload

    def found() -> Iterator[tuple[str, int | None, int, dict]]:
        if data is None:
            raise ValueError(f"larger than {options.max_input_bytes} bytes")
        needed = wanted if not limited or wanted is None else wanted | {"chars"}
        objects = image_bytes = 0
        # characters count one by one
        pdf = backend(data, replace(options, runs=False) if limited else options)
        if part[0] == 0:
            for kind, page, payload in pdf.document_rows(wanted):
                yield row(kind, page, payload)
        for i in range(len(pdf.pages)):
            mine = i % part[1] == part[0] and (pages is None or i in pages)
            if not mine and not limited:
                continue
            for kind, payload in pdf.page_rows(i, needed):
                objects += kind in ("chars", "lines", "rects", "curves", "images")
                image_bytes += len(payload.get("data") or b"") if kind == "images" else 0
                if options.max_total_objects is not None and objects > options.max_total_objects:
                    raise ValueError(f"more than {options.max_total_objects} objects")
                if options.max_total_image_bytes is not None and image_bytes > options.max_total_image_bytes:
                    raise ValueError(f"more than {options.max_total_image_bytes} bytes of images")
                if mine:
                    yield row(kind, i, payload)

    try:
        for r in list(found()) if limited else found():
            if wanted is None or r[0] in wanted:
                yield r
    except Exception as e:  # noqa: BLE001  any malformed file is data, not a failure
        if (wanted is None or "warnings" in wanted) and part[0] == 0:
            yield row("warnings", None, {"code": type(e).__name__, "description": str(e)[:500]})


def _fit(v, kind: pa.DataType):
    """A value as its column takes it; what does not fit is null."""
    if v is None:
        return None
    if pa.types.is_string(kind):
        return str(v).encode("utf-8", "replace").decode()
    if pa.types.is_boolean(kind):
        return bool(v)
    if pa.types.is_floating(kind):
        return float(v) if isinstance(v, (int, float)) else None
    if pa.types.is_integer(kind):
        return int(v) if isinstance(v, (int, float)) and abs(v) < 1 << (kind.bit_width - 1) else None
    if pa.types.is_list(kind):
        return [_fit(x, kind.value_type) for x in v] if isinstance(v, (list, tuple)) else None
    if pa.types.is_struct(kind):
        return {f.name: _fit(v.get(f.name), f.type) for f in kind} if isinstance(v, dict) else None
    return v if isinstance(v, bytes) else None


def _array(values: list, kind: pa.DataType) -> pa.Array:
    try:
        return pa.array(values, kind)
    except (pa.ArrowException, UnicodeError, OverflowError, TypeError, ValueError):
        return pa.array([_fit(v, kind) for v in values], kind)


class Batches:
    """Rows of one file as record batches of one relation each."""

    def __init__(self, schema: pa.Schema):
        self.schema = schema
        self.waiting: dict[str, list[tuple]] = {}

    def add(self, doc: int, path: str, rows: Iterable[tuple[str, int | None, int, dict]]) -> Iterator[pa.RecordBatch]:
        for kind, page, idx, payload in rows:
            held = self.waiting.setdefault(kind, [])
            held.append((doc, path, kind, page, idx, payload))
            if len(held) >= BATCH_ROWS:
                yield self.batch(kind)

    def rest(self) -> Iterator[pa.RecordBatch]:
        for kind in list(self.waiting):
            if self.waiting[kind]:
                yield self.batch(kind)

    def batch(self, kind: str) -> pa.RecordBatch:
        rows = self.waiting.pop(kind)
        *keys, payloads = zip(*rows, strict=True)
        arrays = [_array(list(k), f.type) for k, f in zip(keys, self.schema, strict=False)]
        for f in list(self.schema)[len(keys) :]:
            if f.name == kind:
                arrays.append(pa.StructArray.from_arrays([_array([p.get(x.name) for p in payloads], x.type) for x in f.type], fields=list(f.type)))
            else:
                arrays.append(pa.nulls(len(rows), f.type))
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)


def extract(files: DataFrame, options: ExtractOptions | None = None, pages: set[int] | None = None, kinds: Iterable[str] | None = None, backend: type[Backend] = Pdf, columns: dict[str, list[str]] | None = None, runs: bool = False) -> DataFrame:
    """files: path, content (as of the binaryFile source; a null content is a file over the limit), and maybe slice and slices. doc_id is a hash of the path.

    columns: of a relation, the ones to build. runs: where characters of a text go on
    by equal steps, they are one row, with the box and index of the first and
    step_x, step_y and step_index to the next; rows of single characters have no
    steps. Operators take such rows, characters_of makes single characters of them.
    """
    options, kinds = options or ExtractOptions(), tuple(kinds or RELATIONS)
    if runs:
        own = (columns or {}).get("chars", ["char_code"])
        if "char_code" in own:
            raise ValueError("runs have no code of their characters: name the columns without char_code")
        options = replace(options, runs=True, turned_runs="doctop" not in own)
    cut = [F.col(c).cast("int").alias(c) if c in files.columns else F.lit(n).alias(c) for c, n in (("slice", 0), ("slices", 1))]
    files = files.select("path", "content", F.xxhash64("path").alias("doc_id"), *cut)

    ddl = row_schema(kinds, columns, runs)
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Batches(schema)
        for batch in batches:
            for i in range(batch.num_rows):
                path, content, doc, nth, of = (batch.column(c)[i].as_py() for c in ("path", "content", "doc_id", "slice", "slices"))
                yield from out.add(doc, path, rows_of(content, options, pages, kinds, (nth, of), backend))
        yield from out.rest()

    return files.mapInArrow(run, ddl)


def characters_of(runs: DataFrame) -> DataFrame:
    """Single characters of runs and single characters."""
    alone = F.col("step_x").isNull()
    rest = [c for c in runs.columns if c not in ("text", *STEP_COLUMNS)]
    parts = runs.select(*rest, *STEP_COLUMNS, F.posexplode(F.when(alone, F.array("text")).otherwise(F.split("text", ""))).alias("nth", "text")).filter(alone | (F.col("text") != ""))
    moved = {c: F.when(alone, F.col(c)).otherwise(F.col(c) + F.col("nth") * F.col(step)).alias(c) for c, step in STEP_OF.items()}
    return parts.select(*[moved.get(c, F.col(c)) for c in runs.columns if c not in STEP_COLUMNS])


def relation(rows: DataFrame, kind: str) -> DataFrame:
    """One relation of extracted rows."""
    return rows.filter(F.col("kind") == kind).select("doc_id", "path", "page_number", "idx", f"{kind}.*")


def read_pdf(spark: SparkSession, path: str, options: ExtractOptions | None = None, pages: set[int] | None = None, kinds: Iterable[str] | None = None, slice_bytes: int | None = None, columns: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows of all files under a path that Spark can read; see relation().

    Files over the limit are not loaded and give a warning. With slice_bytes the
    pages of a larger file are dealt to that many more tasks, each with a copy.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")
    if options and options.max_input_bytes is not None:
        large = files.filter(F.col("length") > options.max_input_bytes).select("path", "length", F.lit(None).cast("binary").alias("content"))
        files = files.filter(F.col("length") <= options.max_input_bytes).unionByName(large)
    if slice_bytes:
        files = files.withColumn("slices", F.greatest(F.lit(1), F.ceil(F.col("length") / slice_bytes)).cast("int"))
        files = files.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).repartition("path", "slice")
    return extract(files, options, pages, kinds, columns=columns)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class PdfReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema = dict(options), to_arrow_schema(schema)

    def partitions(self):
        from pathlib import Path

        root = Path(self.options["path"].removeprefix("file:")).absolute()
        return [_File(str(p)) for p in (sorted(root.rglob("*.pdf")) if root.is_dir() else [root])]

    def read(self, partition):
        import xxhash

        o = self.options
        only = {int(x) for x in o["pages"].split(",")} if o.get("pages") else None
        limit = o.get("maxinputbytes")
        opts = ExtractOptions(password=o.get("password"), repair=o.get("repair", "").lower() == "true", extract_image_data=o.get("imagedata", "").lower() == "true", max_input_bytes=int(limit) if limit else None)
        with open(partition.path, "rb") as f:
            data = f.read()
        path, kinds = f"file:{partition.path}", relations_of(o)
        doc = int.from_bytes(xxhash.xxh64_digest(path.encode(), 42), "big", signed=True)  # as xxhash64 of Spark
        out = Batches(self.schema)
        yield from out.add(doc, path, rows_of(data, opts, only, kinds))
        yield from out.rest()


def relations_of(options: dict) -> tuple[str, ...]:
    """Of the option relations, by comma; all without it."""
    named = options.get("relations")
    return tuple(k.strip() for k in named.split(",")) if named else tuple(RELATIONS)


class PdfDataSource(DataSource):
    """spark.read.format("pdf").option("relations", "chars,pages").load(path), for files on a file system that every machine mounts; else use read_pdf."""

    @classmethod
    def name(cls):
        return "pdf"

    def schema(self):
        return row_schema(relations_of(self.options))

    def reader(self, schema):
        return PdfReader(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PdfDataSource)
