"""python -m platen.cli COMMAND PATH: one relation of PDF files as text, CSV, TSV or JSON lines, written by Spark.

Output goes to a folder (--out), one part per partition, or to the terminal.
"""

from __future__ import annotations

import argparse
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platen.operators import edges as E
from platen.operators import export as X
from platen.operators import layout as L
from platen.operators import tables as T
from platen.operators import text_ops as O
from platen.operators.words import extract_words
from platen.options import ExtractOptions, SearchOptions, TableSettings, TextOptions
from platen.sources.pdf.reader import read_pdf, relation

PLAIN = {"annots": "annotations", "links": "hyperlinks", "bookmarks": "bookmarks", "forms": "form_fields", "images": "images", "validate": "validation_issues"}
COMMANDS = ["text", "chars", "words", "tables", "info", "search", "debug", *PLAIN]
CHARS = ["page_number", "text", "x0", "top", "x1", "bottom", "fontname", "size", "doctop", "upright", "direction"]
WORDS = ["page_number", "text", "x0", "top", "x1", "bottom", "doctop", "direction"]


def page_range(spec: str, count: int) -> list[int]:
    """'1,3-5' as sorted distinct pages from 0. A range that goes down holds nothing; 0, pages past the end and other words are errors."""
    out: set[int] = set()
    for part in spec.split(","):
        m = re.fullmatch(r"\s*(\d+)\s*(?:-\s*(\d+)\s*)?", part)
        if not m:
            raise ValueError(f"not a page range: {part!r}")
        a, b = int(m[1]), int(m[2] or m[1])
        if a < 1 or b < 1 or max(a, b) > count:
            raise ValueError(f"pages go from 1 to {count}: {part!r}")
        out.update(range(a - 1, b))
    return sorted(out)


#: Relations that a command reads.
NEEDS = {"text": ("pages", "chars"), "chars": ("pages", "chars"), "words": ("pages", "chars"), "search": ("pages", "chars"), "info": ("pages", "chars", "lines", "rects", "curves", "images", "metadata", "signatures"), "tables": ("pages", "chars", "lines", "rects", "curves"), "debug": ("pages", "chars", "lines", "rects", "curves")}


def result(rows: DataFrame, a: argparse.Namespace) -> DataFrame:
    """The lines that a command gives."""
    pages, chars = relation(rows, "pages"), relation(rows, "chars")
    lines = lambda df, cols: X.json_lines(df) if a.format == "json" else X.csv_lines(df, cols) if a.format == "csv" else X.tsv_lines(df, cols)
    if a.command == "text":
        if a.format == "html":
            return X.page_html(extract_words(chars), chars).select(F.col("html").alias("line"))
        text = L.chars_text(chars, options=TextOptions(layout=a.layout, columns="auto" if a.layout else None))
        return X.json_lines(text) if a.format == "json" else text.select(F.col("text").alias("line"))
    if a.command == "chars":
        return lines(chars.withColumn("page_number", F.col("page_number") + 1), CHARS)
    if a.command == "words":
        return lines(extract_words(chars).withColumn("page_number", F.col("page_number") + 1), WORDS)
    if a.command == "search":
        found = O.search(chars, a.pattern or "", SearchOptions(regex=not a.literal, case_sensitive=not a.ignore_case))
        return lines(found, ["page_number", "text", "x0", "top", "x1", "bottom"])
    edges = E.derive_edges(relation(rows, "lines"), relation(rows, "rects"), relation(rows, "curves"))
    if a.command == "tables":
        cells = T.find_tables(pages, chars, edges, settings=TableSettings(strategy=a.strategy))
        if a.format == "json":
            key = ["doc_id", "page_number", "table_index"]
            return X.json_lines(T.table_rows(cells).join(T.table_quality(cells).select(*key, "accuracy", "whitespace"), key))
        return X.table_csv(cells).select(F.col("csv").alias("line")) if a.format == "csv" else X.table_grid(cells).select(F.col("grid").alias("line"))
    if a.command == "debug":
        return X.page_svg(pages, chars=chars, edges=edges, intersections=E.intersections(edges)).select(F.col("svg").alias("line"))
    if a.command == "info":
        kinds = {k: relation(rows, k) for k in ("chars", "lines", "rects", "curves", "images")}
        counts = lines(X.page_info(pages, **kinds), ["page_number", *(f"n_{k}" for k in kinds)]).select("line")
        about = lambda kind: X.json_lines(relation(rows, kind).drop("idx")).select("line")
        return counts.unionByName(about("metadata")).unionByName(about("signatures"))
    found = relation(rows, PLAIN[a.command])
    if a.command == "validate":
        # every file has a line that sums it up, those without issues as well
        files = pages.select("path").distinct().join(found.groupBy("path").agg(*[F.count(F.when(F.col("severity") == k, 1)).alias(k) for k in ("error", "warning")]), "path", "left").fillna(0)
        summary = files.select(F.format_string("%s: %d errors, %d warnings", "path", "error", "warning").alias("line"))
        return lines(found, ["path", "severity", "code", "message", "location"]).select("line").unionByName(summary)
    skip = {"doc_id", "path", "data", "idx"}
    return lines(found, [f.name for f in found.schema if f.name not in skip and "<" not in f.dataType.simpleString()])


def export_to(images: DataFrame, folder: str) -> None:
    """Writes images' contents one at a time."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    for row in X.export_images(images).toLocalIterator():
        (Path(folder) / f"{row['doc_id'] & 0xFFFFFFFF:08x}_{Path(row['filename']).name}").write_bytes(row["data"])


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("path")
    p.add_argument("--format", choices=["text", "csv", "json", "html"], default="text")
    p.add_argument("--pages")
    p.add_argument("--password")
    p.add_argument("--repair", action="store_true")
    p.add_argument("--layout", action="store_true")
    p.add_argument("--strategy", choices=["lattice", "lattice_strict", "stream"], default="lattice")
    p.add_argument("--pattern")
    p.add_argument("--literal", action="store_true")
    p.add_argument("--ignore-case", action="store_true")
    p.add_argument("--extract", help="folder of this machine for the images' contents")
    p.add_argument("--out")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    pages = set(page_range(a.pages, 1 << 30)) if a.pages else None
    needs = NEEDS.get(a.command) or (PLAIN[a.command], "pages")
    rows = read_pdf(spark, a.path, ExtractOptions(password=a.password, repair=a.repair, extract_image_data=a.extract is not None), pages, needs)
    # a command with several relations reads files once
    rows = rows.persist() if a.command in ("info", "tables", "debug", "images") else rows
    if a.extract is not None:
        export_to(relation(rows, "images"), a.extract)
    lines = result(rows, a)
    if a.out:
        lines.select("line").write.mode("overwrite").text(a.out)
    else:
        for row in lines.select("line").toLocalIterator():
            print(row["line"])
    if a.command == "validate" and relation(rows, "validation_issues").filter("severity = 'error'").limit(1).count():
        raise SystemExit(1)


if __name__ == "__main__":
    main()
