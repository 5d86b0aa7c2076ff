"""Options of the operators; the defaults are part of the contract."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ExtractOptions:
    max_recursion_depth: int = 10
    unicode_norm: str | None = "NFC"
    extract_image_data: bool = False
    dedupe: bool = True
    #: Rows of characters may be runs of them: see extract. turned_runs: on pages turned by a quarter as well, where doctop goes on within a run.
    runs: bool = False
    turned_runs: bool = False
    max_input_bytes: int | None = None
    max_pages: int | None = None
    max_total_objects: int | None = None
    max_total_image_bytes: int | None = None
    password: str | None = None
    #: True, or what to mend.
    repair: bool | RepairOptions = False


@dataclass(frozen=True)
class WordOptions:
    x_tolerance: float = 3.0
    y_tolerance: float = 3.0
    keep_blank_chars: bool = False
    use_text_flow: bool = False
    text_direction: str = "ltr"
    expand_ligatures: bool = True


@dataclass(frozen=True)
class TextOptions:
    layout: bool = False
    y_tolerance: float = 3.0
    y_density: float = 10.0
    x_density: float = 10.0
    expand_ligatures: bool = True
    #: None, "auto" or boundaries.
    columns: str | tuple[float, ...] | None = None
    min_column_gap: float = 20.0
    max_columns: int = 6


@dataclass(frozen=True)
class TableSettings:
    #: lattice, lattice_strict, stream or explicit.
    strategy: str = "lattice"
    snap_x_tolerance: float = 3.0
    snap_y_tolerance: float = 3.0
    join_x_tolerance: float = 3.0
    join_y_tolerance: float = 3.0
    edge_min_length: float = 3.0
    min_words_vertical: int = 3
    min_words_horizontal: int = 1
    text_x_tolerance: float = 3.0
    text_y_tolerance: float = 3.0
    intersection_x_tolerance: float = 3.0
    intersection_y_tolerance: float = 3.0
    explicit_vertical: tuple[float, ...] = ()
    explicit_horizontal: tuple[float, ...] = ()
    min_accuracy: float | None = None
    #: Copies a merged cell's text to all its parts, in place of keeping it in the first.
    duplicate_merged_content: bool = False


@dataclass(frozen=True)
class DedupeOptions:
    tolerance: float = 1.0
    extra_attrs: tuple[str, ...] = ("fontname", "size")


@dataclass(frozen=True)
class SearchOptions:
    regex: bool = True
    case_sensitive: bool = True


@dataclass(frozen=True)
class PageRegionOptions:
    header_margin: float = 0.1
    footer_margin: float = 0.1
    min_pages: int = 3


@dataclass(frozen=True)
class HtmlOptions:
    y_tolerance: float = 3.0
    y_density: float = 10.0
    x_density: float = 10.0
    heading_min_ratio: float = 1.2
    detect_lists: bool = True
    detect_emphasis: bool = True


@dataclass(frozen=True)
class ImageExportOptions:
    pattern: str = "page{page}_img{index}.{ext}"
    deduplicate: bool = False


@dataclass(frozen=True)
class RepairOptions:
    rebuild_xref: bool = True
    fix_stream_lengths: bool = True
    remove_broken_objects: bool = True


@dataclass(frozen=True)
class DrawStyle:
    fill: str | None = None
    stroke: str | None = "red"
    stroke_width: float = 0.5
    opacity: float = 0.3
    extra: dict = field(default_factory=dict)
