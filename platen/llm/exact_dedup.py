"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Two texts are equal when they are identical without white space. Each level
counts its groups with a map-side aggregate, so a group of copies, however
large, is one row for each task that holds some. Levels hand on only rows of
groups with more than one member, where the table of these groups is within
BROADCAST_ROWS and so is sent to the rows; a larger one prunes the next level's
groups in their place. No row is dealt by a length or a prefix hash.

The whole text is read once: its normalised length needs every character, and
the digest column asks for a hash of every row, so both come from one scan and
the refinement spares shuffles, not reads. Between levels only narrow rows
(id, sizes, hashes) move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platen.llm.common import materialise, without_spaces

PREFIX_CHARS = 128
#: Groups (two numbers each) that are sent to all executors at most.
BROADCAST_ROWS = 500_000


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per document: id, row number, code points, normalised length, prefix hash, full hash."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return (
        docs.select(F.col(id_col).alias("doc_id"), text.alias("t"), without_spaces(text).alias("n"))
        .select(
            "doc_id",
            F.monotonically_increasing_id().alias("row_no"),
            F.length("t").alias("code_points"),
            F.octet_length("n").alias("norm_len"),
            F.xxhash64(F.substring("n", 1, PREFIX_CHARS)).alias("prefix_hash"),
            F.sha2(F.col("n"), 256).alias("text_sha256"),
        )
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, keep_id, group_size, kept, text_sha256, row_no; one row per input row.

    Null text counts as empty, so all null and blank texts form one group. The
    row with the most code points stays, then the smallest id (a null id comes
    last), then the first of fully repeated rows: exactly one row of a group has
    kept = true even if ids repeat. An empty table gives an empty result. Other
    columns of the input are not read.
    """
    rows = materialise(fingerprints(docs, id_col, text_col), "fingerprints")

    def several(level: DataFrame, *keys: str) -> tuple[DataFrame, bool]:
        """Keys that more than one row has, and whether they are few enough to be sent."""
        found = materialise(level.groupBy(*keys).count().filter("count > 1").select(*keys), keys[-1])
        return found, found.count() <= BROADCAST_ROWS

    lengths, few = several(rows, "norm_len")
    level1 = rows.join(F.broadcast(lengths), "norm_len", "left_semi") if few else rows
    prefixes, few = several(level1, "norm_len", "prefix_hash")
    level2 = level1.join(F.broadcast(prefixes), ["norm_len", "prefix_hash"], "left_semi") if few else level1
    best = F.struct("code_points", (-F.col("doc_id")).alias("i"), (-F.col("row_no")).alias("r"))
    groups = (
        level2.groupBy("norm_len", "prefix_hash", "text_sha256")
        .agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct("doc_id", "row_no"), best).alias("top"))
        .filter("n > 1")
        .select("norm_len", "prefix_hash", "text_sha256", "n", F.col("top.doc_id").alias("top_id"), F.col("top.row_no").alias("top_row"))
    )
    # written first: a join between two tables can be dealt anew where a group is large, one that an aggregate feeds can't
    groups = materialise(groups, "groups")
    joined = rows.join(groups, ["norm_len", "prefix_hash", "text_sha256"], "left")
    alone = F.col("n").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("top_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row_no") == F.col("top_row"))).alias("kept"),
        "text_sha256",
        "row_no",
    )


def op2_query(spark, sf_dir):
    from platen.llm.common import read

    return exact_dedup(read(spark, sf_dir, "documents")).drop("row_no")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents),
h AS (SELECT doc_id, length(t) AS cp, sha256(n) AS text_sha256 FROM d)
SELECT doc_id,
  first_value(doc_id) OVER w AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER w = 1 AS kept,
  text_sha256
FROM h WINDOW w AS (PARTITION BY text_sha256 ORDER BY cp DESC, doc_id)
"""
