"""Crops and other filters on boxes; all are plain column predicates and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Bounds = tuple[float, float, float, float]


def inside_centre(b: Bounds) -> Column:
    """The middle of the object lies in the box, its border included."""
    x0, top, x1, bottom = b
    return ((F.col("x0") + F.col("x1")) / 2).between(x0, x1) & ((F.col("top") + F.col("bottom")) / 2).between(top, bottom)


def inside_fully(b: Bounds) -> Column:
    x0, top, x1, bottom = b
    return (F.col("x0") >= x0) & (F.col("top") >= top) & (F.col("x1") <= x1) & (F.col("bottom") <= bottom)


def apart(b: Bounds) -> Column:
    """No common area; touching is apart."""
    x0, top, x1, bottom = b
    return (F.col("x1") <= x0) | (F.col("x0") >= x1) | (F.col("bottom") <= top) | (F.col("top") >= bottom)


def rebase(objects: DataFrame, b: Bounds) -> DataFrame:
    """Coordinates from the box's corner; doctop and the points of curves move along."""
    x, y = b[0], b[1]
    moved = {"x0": F.col("x0") - x, "x1": F.col("x1") - x, "top": F.col("top") - y, "bottom": F.col("bottom") - y}
    if "doctop" in objects.columns:
        moved["doctop"] = F.col("doctop") - y
    if "pts" in objects.columns:
        moved["pts"] = F.transform("pts", lambda p: F.struct((p["x"] - x).alias("x"), (p["y"] - y).alias("y")))
    return objects.withColumns(moved)


def crop(objects: DataFrame, b: Bounds) -> DataFrame:
    return rebase(objects.filter(inside_centre(b)), b)


def within_bbox(objects: DataFrame, b: Bounds) -> DataFrame:
    return rebase(objects.filter(inside_fully(b)), b)


def outside_bbox(objects: DataFrame, b: Bounds) -> DataFrame:
    """Also from the box's corner, so coordinates may be negative."""
    return rebase(objects.filter(apart(b)), b)


class PageView:
    """The object relations of pages, cropped and filtered together; a view is never stored."""

    KINDS = ("chars", "lines", "rects", "curves", "images")

    def __init__(self, **relations: DataFrame):
        unknown = set(relations) - set(self.KINDS)
        if unknown:
            raise ValueError(f"unknown relations: {sorted(unknown)}")
        self.relations = relations

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["relations"][name]
        except KeyError:
            raise AttributeError(name) from None

    def _each(self, change) -> PageView:
        return PageView(**{k: change(df) for k, df in self.relations.items()})

    def crop(self, b: Bounds) -> PageView:
        return self._each(lambda df: crop(df, b))

    def within_bbox(self, b: Bounds) -> PageView:
        return self._each(lambda df: within_bbox(df, b))

    def outside_bbox(self, b: Bounds) -> PageView:
        return self._each(lambda df: outside_bbox(df, b))

    def filter(self, **predicates: Column) -> PageView:
        """One predicate per relation; relations not named stay whole."""
        return PageView(**{k: df.filter(predicates[k]) if k in predicates else df for k, df in self.relations.items()})
