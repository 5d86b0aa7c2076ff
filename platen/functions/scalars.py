"""Column functions on text, fonts, colours and boxes. All but unicode_normalise stay in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Ligatures and what they stand for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ſt", "ﬆ": "st"}
# Unicode White_Space.
WHITE_SPACE = r"[\u0009-\u000D \u0085   -     　]"
CJK = r"[぀-ゟ゠-ヿ㐀-䶿一-鿿가-힯豈-﫿\x{20000}-\x{2A6DF}]"
ARABIC_MARK = r"[ؐ-ًؚ-ٰٟۖ-ۜ۟-۪ۤۧۨ-ۭ]"
STRONG_RTL = r"[֐-ࣿיִ-﷿ﹰ-﻿\x{10800}-\x{10FFF}\x{1E800}-\x{1EFFF}]"


def expand_ligatures(text: Column) -> Column:
    for sign, letters in LIGATURES.items():
        text = F.replace(text, F.lit(sign), F.lit(letters))
    return text


def mask_variable(text: Column) -> Column:
    """Runs of digits as one #."""
    return F.regexp_replace(text, "[0-9]+", "#")


def escape_html(text: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def csv_escape(text: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[,"\n]'), quoted).otherwise(text)


def is_blank(text: Column) -> Column:
    return text.rlike(rf"\A{WHITE_SPACE}*\z")


def is_cjk(text: Column) -> Column:
    """By the first character."""
    return F.substring(text, 1, 1).rlike(CJK)


def is_arabic_mark(text: Column) -> Column:
    return text.rlike(rf"\A{ARABIC_MARK}+\z")


def is_strong_rtl(text: Column) -> Column:
    return text.rlike(STRONG_RTL)


def is_bold(font: Column) -> Column:
    return F.lower(font).rlike("bold|heavy|black")


def is_italic(font: Column) -> Column:
    return F.lower(font).rlike("italic|oblique")


def strip_subset_prefix(font: Column) -> Column:
    return F.regexp_replace(font, r"\A[A-Z]{6}\+", "")


def is_subset_font(font: Column) -> Column:
    return font.rlike(r"\A[A-Z]{6}\+")


def unicode_normalise(text: Column, form: str | None = "NFC") -> Column:
    """Normal form of a text; ASCII never reaches Python."""
    if form is None:
        return text

    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    return F.when(text.rlike(r"\A\p{ASCII}*\z"), text).otherwise(normal(text))


def edge_length(x0: Column, top: Column, x1: Column, bottom: Column) -> Column:
    return F.hypot(x1 - x0, bottom - top)


def orientation(x0: Column, top: Column, x1: Column, bottom: Column) -> Column:
    return F.when(F.abs(top - bottom) < 1e-6, "horizontal").when(F.abs(x0 - x1) < 1e-6, "vertical").otherwise("diagonal")


def transform_point(ctm: Column, x: Column, y: Column) -> Column:
    """A point through the row-vector matrix [a b c d e f]."""
    a, b, c, d, e, f = (F.element_at(ctm, i + 1) for i in range(6))
    return F.struct((a * x + c * y + e).alias("x"), (b * x + d * y + f).alias("y"))


def concat_ctm(m: Column, n: Column) -> Column:
    a, b = [F.element_at(m, i + 1) for i in range(6)], [F.element_at(n, i + 1) for i in range(6)]
    return F.array(
        a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3],
        a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3],
        a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5],
    )


def image_bbox(ctm: Column, page_height: Column) -> Column:
    """The box of the unit square through a matrix, with y down."""
    a, b, c, d, e, f = (F.element_at(ctm, i + 1) for i in range(6))
    xs, ys = [e, a + e, c + e, a + c + e], [f, b + f, d + f, b + d + f]
    return F.struct(F.least(*xs).alias("x0"), (page_height - F.greatest(*ys)).alias("top"), F.greatest(*xs).alias("x1"), (page_height - F.least(*ys)).alias("bottom"))


def rotate_point(x: Column, y: Column, width: Column, height: Column, rotation: Column) -> Column:
    """A point of an unrotated page, y down, on the page as shown."""
    turn = F.pmod(rotation, F.lit(360))
    return (
        F.when(turn == 90, F.struct((height - y).alias("x"), x.alias("y")))
        .when(turn == 180, F.struct((width - x).alias("x"), (height - y).alias("y")))
        .when(turn == 270, F.struct(y.alias("x"), (width - x).alias("y")))
        .otherwise(F.struct(x.alias("x"), y.alias("y")))
    )


def color_to_rgb(color: Column) -> Column:
    """struct<space, components> as an array of three shares; null for other spaces."""
    c = [F.element_at(color["components"], i + 1) for i in range(4)]
    return (
        F.when(color["space"] == "gray", F.array(c[0], c[0], c[0]))
        .when(color["space"] == "rgb", F.array(c[0], c[1], c[2]))
        .when(color["space"] == "cmyk", F.array(*[(1 - x) * (1 - c[3]) for x in c[:3]]))
    )


# Image filters with their media types and file endings.
IMAGE_FILTERS = {
    "DCTDecode": ("image/jpeg", "jpg"),
    "FlateDecode": ("image/png", "png"),
    "CCITTFaxDecode": ("image/tiff", "tiff"),
    "JBIG2Decode": ("image/jbig2", "jbig2"),
    "JPXDecode": ("image/jp2", "jp2"),
    "LZWDecode": ("application/octet-stream", "bin"),
    "RunLengthDecode": ("application/octet-stream", "bin"),
}
# Field types of forms.
FIELD_TYPES = {"Tx": "text", "Btn": "button", "Ch": "choice", "Sig": "signature"}


def image_mime(name: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in IMAGE_FILTERS.items() for x in (k, v[0])]), name), F.lit("application/octet-stream"))


def image_extension(name: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in IMAGE_FILTERS.items() for x in (k, v[1])]), name), F.lit("bin"))


def field_type(name: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, v in FIELD_TYPES.items() for x in (k, v)]), name)


def rotate_direction(direction: Column, rotation: Column) -> Column:
    """The direction of text on a page turned clockwise."""
    turns = ["ltr", "ttb", "rtl", "btt"]
    at = F.array_position(F.array(*map(F.lit, turns)), direction) - 1
    return F.element_at(F.array(*map(F.lit, turns)), (F.pmod(at + F.floor(rotation / 90), F.lit(4)) + 1).cast("int"))


def pdf_date(text: Column) -> Column:
    """D:YYYYMMDDHHmmSS as a timestamp; an extension, other strings give null."""
    digits = F.regexp_extract(text, r"\A(?:D:)?([0-9]{4,14})", 1)
    full = F.concat(digits, F.substring(F.lit("00000101000000"), F.length(digits) + 1, 14))
    return F.when(F.length(digits) >= 4, F.try_to_timestamp(full, F.lit("yyyyMMddHHmmss")))
