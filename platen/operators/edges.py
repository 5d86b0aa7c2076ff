"""Edges from lines, rectangles and curves; snapping, joining and crossing them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platen.functions.scalars import edge_length, orientation
from platen.operators.pages import PAGE, by_page
from platen.options import TableSettings

EDGE = [*PAGE, "x0", "top", "x1", "bottom", "orientation", "source"]


def _edge(x0, top, x1, bottom, direction, source: str):
    return F.struct(x0.alias("x0"), top.alias("top"), x1.alias("x1"), bottom.alias("bottom"), direction.alias("orientation"), F.lit(source).alias("source"))


def edges_from_lines(lines: DataFrame) -> DataFrame:
    return lines.select(*PAGE, "x0", "top", "x1", "bottom", orientation(*map(F.col, ("x0", "top", "x1", "bottom"))).alias("orientation"), F.lit("line").alias("source"))


def edges_from_rects(rects: DataFrame) -> DataFrame:
    """The four sides."""
    x0, top, x1, bottom = map(F.col, ("x0", "top", "x1", "bottom"))
    h, v = F.lit("horizontal"), F.lit("vertical")
    sides = F.array(_edge(x0, top, x1, top, h, "rect_top"), _edge(x0, bottom, x1, bottom, h, "rect_bottom"), _edge(x0, top, x0, bottom, v, "rect_left"), _edge(x1, top, x1, bottom, v, "rect_right"))
    return rects.select(*PAGE, F.inline(sides))


def edges_from_curves(curves: DataFrame) -> DataFrame:
    """The chord between first and last point; a curve without points has no edge."""
    a, b = F.element_at("pts", 1), F.element_at("pts", -1)
    box = (F.least(a["x"], b["x"]), F.least(a["y"], b["y"]), F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"]))
    return curves.filter(F.size("pts") > 0).select(*PAGE, *[c.alias(n) for c, n in zip(box, ("x0", "top", "x1", "bottom"), strict=True)], orientation(*box).alias("orientation"), F.lit("curve").alias("source"))


def derive_edges(lines: DataFrame | None = None, rects: DataFrame | None = None, curves: DataFrame | None = None) -> DataFrame:
    parts = [f(x) for f, x in ((edges_from_lines, lines), (edges_from_rects, rects), (edges_from_curves, curves)) if x is not None]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def long_enough(edges: DataFrame, least: float) -> DataFrame:
    return edges.filter(edge_length(*map(F.col, ("x0", "top", "x1", "bottom"))) >= least)


def _anchored(position, tolerance: float):
    """Fold over a sorted array of positions: a group begins where the distance to its first member passes the tolerance."""
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(0).alias("no"), F.array().cast("array<int>").alias("out"))

    def step(s, x):
        new = s["anchor"].isNull() | (F.abs(x - s["anchor"]) > tolerance)
        no = F.when(new, s["no"] + 1).otherwise(s["no"])
        return F.struct(F.when(new, x).otherwise(s["anchor"]).alias("anchor"), no.alias("no"), F.concat(s["out"], F.array(no)).alias("out"))

    return F.aggregate(position, start, step, lambda s: s["out"])


def anchored_groups(df: DataFrame, keys: list[str], position: str, tolerance: float, name: str) -> DataFrame:
    """Adds the number of each row's anchored group. Only distinct positions are folded, so equal ones cost nothing."""
    distinct = df.groupBy(*keys).agg(F.array_sort(F.collect_set(position)).alias("p"))
    numbered = distinct.select(*keys, F.explode(F.arrays_zip(F.col("p").alias("position"), _anchored(F.col("p"), tolerance).alias("no"))).alias("g"))
    numbered = numbered.select(*keys, F.col("g.position").alias(position), F.col("g.no").alias(name))
    return df.join(numbered, [*keys, position])


def snap_edges(edges: DataFrame, x_tolerance: float = 3.0, y_tolerance: float = 3.0) -> DataFrame:
    """Near parallel edges move to their mean; diagonal ones stay as they are."""
    edges = by_page(edges.select(*EDGE))
    out = edges.filter("orientation = 'diagonal'")
    for direction, position, tolerance, (a, b) in (("horizontal", "top", y_tolerance, ("top", "bottom")), ("vertical", "x0", x_tolerance, ("x0", "x1"))):
        own = anchored_groups(edges.filter(F.col("orientation") == direction), PAGE, position, tolerance, "snap_no")
        mean = F.avg(position).over(Window.partitionBy(*PAGE, "snap_no"))
        own = own.withColumn("mean", mean).withColumns({a: F.col("mean"), b: F.col("mean")})
        out = out.unionByName(own.select(*EDGE))
    return out


def join_edges(edges: DataFrame, x_tolerance: float = 3.0, y_tolerance: float = 3.0) -> DataFrame:
    """Edges on one line that overlap or nearly touch become one; the first one's source stays. An end that is null comes after all others."""
    edges = by_page(edges.select(*EDGE))
    out = edges.filter("orientation = 'diagonal'")
    for direction, position, start, stop, tolerance in (("horizontal", "top", "x0", "x1", x_tolerance), ("vertical", "x0", "top", "bottom", y_tolerance)):
        own = edges.filter(F.col("orientation") == direction)
        line, by = Window.partitionBy(*PAGE, position), [F.col(c).asc_nulls_last() for c in (start, stop, "source")]
        order = line.orderBy(*by)
        reach = F.max(stop).over(order.rowsBetween(Window.unboundedPreceding, -1))
        own = own.withColumn("new", F.when(reach.isNull() | (F.col(start) > reach + tolerance), 1).otherwise(0))
        # of equal edges the one that begins comes first, so the order of ties has no effect
        own = own.withColumn("no", F.sum("new").over(line.orderBy(*by, F.desc("new")).rowsBetween(Window.unboundedPreceding, 0)))
        joined = own.groupBy(*PAGE, position, "no").agg(F.min(start).alias(start), F.max(stop).alias(stop), F.min_by("source", F.struct(F.isnull(start), start, F.isnull(stop), stop, "source")).alias("source"))
        other = "bottom" if direction == "horizontal" else "x1"
        out = out.unionByName(joined.withColumn(other, F.col(position)).withColumn("orientation", F.lit(direction)).select(*EDGE))
    return out


def intersections(edges: DataFrame, x_tolerance: float = 3.0, y_tolerance: float = 3.0) -> DataFrame:
    """doc_id, page_number, x, y: distinct crossings of horizontal and vertical edges, within tolerance of their ends."""
    h = edges.filter("orientation = 'horizontal'").select(*PAGE, F.col("x0").alias("hx0"), F.col("x1").alias("hx1"), F.col("top").alias("y"))
    v = edges.filter("orientation = 'vertical'").select(*PAGE, F.col("x0").alias("x"), F.col("top").alias("vtop"), F.col("bottom").alias("vbottom"))
    meets = F.col("x").between(F.col("hx0") - x_tolerance, F.col("hx1") + x_tolerance) & F.col("y").between(F.col("vtop") - y_tolerance, F.col("vbottom") + y_tolerance)
    return h.join(v, PAGE).filter(meets).select(*PAGE, "x", "y").distinct()


def stream_edges(words: DataFrame, x_tolerance: float = 3.0, y_tolerance: float = 3.0, min_vertical: int = 3, min_horizontal: int = 1) -> DataFrame:
    """Edges along which words line up: left and right sides, tops and bottoms."""
    sides = (("x0", "vertical", x_tolerance, min_vertical), ("x1", "vertical", x_tolerance, min_vertical), ("top", "horizontal", y_tolerance, min_horizontal), ("bottom", "horizontal", y_tolerance, min_horizontal))
    stacked = words.select(*PAGE, "x0", "top", "x1", "bottom", F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(s[0]).alias("position")) for i, s in enumerate(sides)])).alias("s"))
    stacked = by_page(stacked.select(*PAGE, "x0", "top", "x1", "bottom", "s.side", "s.position"))
    out = None
    for i, (_, direction, tolerance, least) in enumerate(sides):
        own = anchored_groups(stacked.filter(F.col("side") == i), PAGE, "position", tolerance, "no")
        span = ("top", "bottom") if direction == "vertical" else ("x0", "x1")
        g = own.groupBy(*PAGE, "no").agg(F.avg("position").alias("at"), F.count(F.lit(1)).alias("n"), F.min(span[0]).alias("a"), F.max(span[1]).alias("b")).filter(F.col("n") >= least)
        cols = {"x0": "at", "x1": "at", "top": "a", "bottom": "b"} if direction == "vertical" else {"x0": "a", "x1": "b", "top": "at", "bottom": "at"}
        g = g.select(*PAGE, *[F.col(v).alias(k) for k, v in cols.items()], F.lit(direction).alias("orientation"), F.lit("stream").alias("source")).select(*EDGE)
        out = g if out is None else out.unionByName(g)
    return out


def explicit_edges(pages: DataFrame, vertical: tuple[float, ...], horizontal: tuple[float, ...], detected: DataFrame | None = None) -> DataFrame:
    """Lines given by the caller on every page, over the extent of all lines given and edges detected; nothing without an extent."""
    xs, ys = sorted(vertical), sorted(horizontal)
    base = pages.select(*PAGE).distinct()
    if detected is None:
        if not xs or not ys:
            return base.limit(0).select(*PAGE, *[F.lit(0.0).alias(c) for c in EDGE[2:6]], F.lit("").alias("orientation"), F.lit("").alias("source"))
        extent = base.select(*PAGE, *[F.lit(float(v)).alias(k) for k, v in (("left", xs[0]), ("right", xs[-1]), ("high", ys[0]), ("low", ys[-1]))])
    else:
        found = detected.groupBy(*PAGE).agg(F.min("x0").alias("left"), F.max("x1").alias("right"), F.min("top").alias("high"), F.max("bottom").alias("low"))
        most = lambda f, c, given: f(F.col(c), F.lit(float(given))) if given is not None else F.col(c)
        extent = base.join(found, PAGE, "left").select(
            *PAGE, most(F.least, "left", xs[0] if xs else None).alias("left"), most(F.greatest, "right", xs[-1] if xs else None).alias("right"),
            most(F.least, "high", ys[0] if ys else None).alias("high"), most(F.greatest, "low", ys[-1] if ys else None).alias("low"),
        )
    v = [_edge(F.lit(float(x)), F.col("high"), F.lit(float(x)), F.col("low"), F.lit("vertical"), "explicit") for x in xs]
    h = [_edge(F.col("left"), F.lit(float(y)), F.col("right"), F.lit(float(y)), F.lit("horizontal"), "explicit") for y in ys]
    return extent.filter("left IS NOT NULL AND high IS NOT NULL").select(*PAGE, F.inline(F.array(*v, *h)))


def chosen_edges(settings: TableSettings, pages: DataFrame, edges: DataFrame | None, words: DataFrame | None) -> DataFrame:
    """Edges by strategy, as they come."""
    s = settings
    if s.strategy == "lattice":
        return edges.select(*EDGE)
    if s.strategy == "lattice_strict":
        return edges.filter("source = 'line'").select(*EDGE)
    if s.strategy == "stream":
        return stream_edges(words, s.text_x_tolerance, s.text_y_tolerance, s.min_words_vertical, s.min_words_horizontal)
    if s.strategy == "explicit":
        given = explicit_edges(pages, s.explicit_vertical, s.explicit_horizontal, edges)
        return given if edges is None else edges.select(*EDGE).unionByName(given)
    raise ValueError(f"unknown strategy: {s.strategy}")


def table_edges(settings: TableSettings, pages: DataFrame, edges: DataFrame | None, words: DataFrame | None) -> DataFrame:
    """Edges by strategy, at least edge_min_length long, snapped and joined."""
    s = settings
    chosen = long_enough(chosen_edges(s, pages, edges, words), s.edge_min_length)
    return join_edges(snap_edges(chosen, s.snap_x_tolerance, s.snap_y_tolerance), s.join_x_tolerance, s.join_y_tolerance)
