"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws u from a hash of its id and gets the key ln(u) / quality
(the logarithm of u ** (1 / quality)); within a source, larger keys come first.
A source takes as many complete epochs as its target holds, then the leading
documents whose running size comes nearest to what is left.

Running sizes are prefix sums in two levels, so that no source, however hot,
meets in one task: keys are cut into slices of equal width in the logarithm of
-key, which quality only moves: whatever the qualities are, no slice holds much
more than 0.4 / width of a source, and the width grows with the rows. Documents
are summed within (source, slice), slices within source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platen.llm.common import materialise, word_count

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Slices for each unit of the logarithm: so many at least, and one for so many rows.
SLICES = 128
SLICE_ROWS = 20_000
JUNK = r"[#$%&*|<>{}=]"


def quality(text: Column, size: Column) -> Column:
    """Between 0 and 1: falls with junk signs per word. Null and empty texts get 1."""
    return F.lit(1.0) / (F.lit(1.0) + F.coalesce(F.regexp_count(text, F.lit(JUNK)), F.lit(0)) / F.greatest(size, F.lit(1)))


def source_targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds target to rows (source, source_size): shares by weight, stopped at max_epochs times the size, the excess reshared.

    The fixed point of that resharing is target = min(cap, level * weight) with
    one level for all; sorted by cap / weight, the stopped sources are a prefix,
    so running sums find the level. One row per source: a dimension, not data.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sources.select("source", "source_size", F.row_number().over(by_name).alias("source_no"), weight.cast("long").alias("w"))
    s = s.withColumn("cap", F.col("source_size") * max_epochs)
    before = Window.orderBy(F.col("cap") / F.col("w"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    s = s.select(
        "*",
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("caps_before"),
        F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w_before"),
        F.sum("source_size").over(everything).alias("total"),
        F.sum("w").over(everything).alias("w_total"),
    )
    level = (F.col("total") - F.col("caps_before")) / (F.col("w_total") - F.col("w_before"))
    s = s.withColumn("stopped", level > F.col("cap") / F.col("w"))
    free = ~F.col("stopped")
    rest = F.col("total") - F.coalesce(F.sum(F.when(F.col("stopped"), F.col("cap"))).over(everything), F.lit(0))
    free_w = F.sum(F.when(free, F.col("w"))).over(everything)
    return s.select("source", "source_size", "source_no", F.when(F.col("stopped"), F.col("cap").cast("double")).otherwise(rest * F.col("w") / free_w).cast("double").alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    quality_col: Column | None = None,
) -> DataFrame:
    """Columns doc_id, row_no, size, source, source_size, target, taken; one row per input row.

    Null text has size 0 and null source is a source of its own, the last one.
    taken is a multiple of size, at most max_epochs times. Ties of keys (repeated
    ids) go by row number. Empty tables and tables without words give targets 0.
    quality_col: a positive weight per document; by default from the text.
    """
    text = F.col(text_col).cast("string")
    size = word_count(text)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row_no"), F.col(source_col).cast("string").alias("source"), size.alias("size"), (quality(text, size) if quality_col is None else quality_col.cast("double")).alias("quality"))
    digits = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 12), 16, 10).cast("double")
    u = (digits + 0.5) / float(1 << 48)
    rows = materialise(rows.withColumn("key", F.log(u) / F.col("quality")), "sizes")
    width = max(SLICES, rows.count() // SLICE_ROWS)
    rows = rows.withColumn("slice", F.floor(-F.log(-F.col("key")) * width).cast("long"))

    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialise(source_targets(totals, weights, max_epochs), "targets")
    slices = rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    ahead = Window.partitionBy("source").orderBy(F.col("slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("source", "slice", F.coalesce(F.sum("slice_size").over(ahead), F.lit(0)).alias("ahead"))
    slices = slices.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.source", "s.slice", "ahead", "source_size", "target")

    within = Window.partitionBy("source", "slice").orderBy(F.col("key").desc(), "doc_id", "row_no").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("upto", F.sum("size").over(within))
    same = F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.slice") == F.col("s.slice"))
    out = summed.alias("d").join(slices.alias("s"), same).select("d.doc_id", "d.row_no", "d.source", "d.size", "source_size", "target", (F.col("upto") + F.col("ahead")).alias("upto"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    left = F.col("target") - epochs * F.col("source_size")
    chosen = (F.col("upto") * 2 - F.col("size")) <= left * 2
    return out.select("doc_id", "row_no", "source", "size", "source_size", "target", ((epochs + F.when(chosen & (epochs < max_epochs), 1).otherwise(0)) * F.col("size")).cast("long").alias("taken"))


def op6_query(spark, sf_dir):
    from platen.llm.common import read

    return mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    coalesce(len(regexp_extract_all(text, '[#$%&*|<>{}=]')), 0) AS junk,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS digits
  FROM documents),
k AS (SELECT *, ln((digits::DOUBLE + 0.5) / 281474976710656.0::DOUBLE) / (1.0::DOUBLE / (1.0::DOUBLE + junk::DOUBLE / greatest(size, 1)::DOUBLE)) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS source_no FROM s),
w AS (SELECT *, CASE (source_no - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, source_size * 3 AS cap FROM n),
b AS (
  SELECT *, coalesce(sum(cap) OVER o, 0)::BIGINT AS caps_before, coalesce(sum(w) OVER o, 0)::BIGINT AS w_before,
    (sum(source_size) OVER ())::BIGINT AS total, (sum(w) OVER ())::BIGINT AS w_total
  FROM w WINDOW o AS (ORDER BY cap::DOUBLE / w, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, (total - caps_before)::DOUBLE / (w_total - w_before)::DOUBLE > cap::DOUBLE / w AS stopped FROM b),
t AS (
  SELECT source, source_size, CASE WHEN stopped THEN cap::DOUBLE
    ELSE ((total - coalesce(sum(CASE WHEN stopped THEN cap END) OVER (), 0)::BIGINT) * w)::DOUBLE / (sum(CASE WHEN NOT stopped THEN w END) OVER ())::DOUBLE END AS target
  FROM c),
p AS (
  SELECT k.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs,
    (sum(size) OVER (PARTITION BY k.source ORDER BY key DESC, doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS upto
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  ((epochs + CASE WHEN upto * 2 - size <= (target - epochs * source_size) * 2 AND epochs < 3 THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM p
"""
