"""Exact top-k inner products by M-tree best-first search.

Vectors are rounded to integers, so scores are exact. Inner products become a
metric by one more component: with M2 the largest squared length of a block,
x gets sqrt(M2 - |x|^2) and a query 0, and the squared distance is
|q|^2 + M2 - 2 <q, x>: the nearest vectors are those with the highest scores.

Rows are dealt into blocks of bounded size. A block is one task's work: its tree
is built once and the queries stream through it in batches. A block is an M-tree: pages of
bounded size whose entries keep their distance to the page's routing vector,
and whose covering radius bounds all below. A search takes pages in the order
of their best possible score and stops when that is below the k-th best; the
stored distances to the parent spare pages and entries the computation of their
own distance.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 1024
K = 10
PAGE = 128
FANOUT = 16
BLOCK_ROWS = 16_384
#: Beyond this, squares of components are not safe in doubles: such blocks and queries are scored without the tree.
HUGE = 1e100
LONG = (1 << 63) - 1
FOUND = "query_id long, vec_id long, score long"


class Node:
    """A page: entries are rows (leaf) or child pages; to_parent holds their distances to the routing vector."""

    __slots__ = ("center", "children", "radius", "rows", "to_parent")

    def __init__(self, center, radius, rows, children, to_parent):
        self.center, self.radius, self.rows, self.children, self.to_parent = center, radius, rows, children, to_parent


def build(points: np.ndarray, rows: np.ndarray) -> Node:
    """Bulk load: routing vectors are picked far apart, rows go to the nearest, pages above PAGE are split again. Equal vectors are cut by count."""
    center = points[rows].mean(axis=0)
    far = np.sqrt(((points[rows] - center) ** 2).sum(axis=1))
    if len(rows) <= PAGE:
        return Node(center, far.max(initial=0.0), rows, None, far)
    pivots = [int(np.argmax(far))]
    near = np.full(len(rows), np.inf)
    owner = np.zeros(len(rows), np.int64)
    for k in range(FANOUT):
        d = ((points[rows] - points[rows[pivots[-1]]]) ** 2).sum(axis=1)
        closer = d < near
        near[closer], owner[closer] = d[closer], k
        if k < FANOUT - 1:
            if near.max() <= 0:
                break
            pivots.append(int(np.argmax(near)))
    if len(pivots) == 1:
        owner = np.arange(len(rows)) * FANOUT // len(rows)
    children = [build(points, rows[owner == k]) for k in np.unique(owner).tolist()]
    return Node(center, far.max(), None, children, np.array([np.sqrt(((c.center - center) ** 2).sum()) for c in children]))


def search(root: Node, points: np.ndarray, vectors: np.ndarray, ids: np.ndarray, extended: np.ndarray, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
    """The k best (score, id) of a block for one query; ties go to the smaller id."""
    best: list[tuple[int, int]] = []  # a heap of (score, -id): the worst of the k first
    bound = np.inf  # distance beyond which nothing can enter
    base = float((extended**2).sum()) + float((points[0] ** 2).sum())  # |q|^2 + M2
    slack = 1e-6 * math.sqrt(base)  # far above what doubles lose in a squared distance of this size

    def reach() -> float:
        return math.sqrt(max(0.0, base - 2.0 * best[0][0])) + slack if len(best) == k else np.inf

    d = float(np.sqrt(((root.center - extended) ** 2).sum()))
    queue, turn = [(max(0.0, d - root.radius), 0, d, root)], 0
    while queue:
        least, _, d, node = heapq.heappop(queue)
        if least > bound:
            break
        if node.children is None:
            rows = node.rows
            if bound < np.inf:  # | d(q, parent) - d(x, parent) | <= d(q, x)
                rows = rows[np.abs(node.to_parent - d) <= bound]
            if not len(rows):
                continue
            scores = vectors[rows] @ query
            if len(best) == k:
                good = scores >= best[0][0]
                rows, scores = rows[good], scores[good]
            for score, i in zip(scores.tolist(), ids[rows].tolist(), strict=True):
                if i == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (score, -i))
                elif (score, -i) > best[0]:
                    heapq.heapreplace(best, (score, -i))
            bound = reach()
        else:
            for child, to_parent in zip(node.children, node.to_parent.tolist(), strict=True):
                if abs(d - to_parent) - child.radius > bound:
                    continue
                at = float(np.sqrt(((child.center - extended) ** 2).sum()))
                if at - child.radius <= bound:
                    turn += 1
                    heapq.heappush(queue, (max(0.0, at - child.radius), turn, at, child))
    return [(score, -i) for score, i in best]


def _rounded(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """floor(SCALE * x) of all vectors as doubles, exact as long as they are finite, and the vectors' lengths; shorter vectors are filled with 0."""
    size = np.diff(np.asarray(column.offsets)) if len(column) else np.zeros(0, np.int64)
    flat = np.asarray(column.flatten(), float)
    width = int(size.max(initial=0)) if width is None else width
    out = np.zeros((len(column), width))
    row = np.repeat(np.arange(len(column)), size)
    col = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    inside = col < width
    with np.errstate(over="ignore"):
        out[row[inside], col[inside]] = np.floor(SCALE * flat[inside])
    return out, size


def _exact(column: pa.Array, width: int) -> np.ndarray:
    """As Python integers, for components whose products don't fit 64 bits."""
    out = np.zeros((len(column), width), object)
    for i, v in enumerate(column.to_pylist()):
        for j, x in enumerate(v[:width]):
            out[i, j] = math.floor(SCALE * x) if abs(x) < HUGE else SCALE * int(x)
    return out


class Block:
    """The vectors of a block, their tree, and what is needed to score exactly."""

    def __init__(self, ids: np.ndarray, column: pa.Array):
        self.ids, self.column = ids, column
        rounded, _ = _rounded(column)
        self.width, self.most = rounded.shape[1], float(np.abs(rounded).max(initial=0.0))
        self.plain = self.most > HUGE
        self.whole: np.ndarray | None = None
        if self.plain:
            return
        self.vectors = rounded.astype(np.int64) if self.most < 2**62 else None
        lengths = (rounded**2).sum(axis=1)
        self.points = np.concatenate([rounded, np.sqrt(lengths.max() - lengths)[:, None]], axis=1)
        self.root = build(self.points, np.arange(len(rounded)))

    def exact(self) -> np.ndarray:
        if self.whole is None:
            self.whole = _exact(self.column, self.width)
        return self.whole

    def found(self, queries: pa.RecordBatch, k: int) -> Iterator[tuple[int, int, int]]:
        column = queries.column("embedding")
        asked, _ = _rounded(column, self.width)
        for i, own in enumerate(queries.column("vec_id").to_pylist()):
            most = float(np.abs(asked[i]).max(initial=0.0))
            fits = self.most * most * max(1, self.width) < 2**62 and max(self.most, most) < 2**62
            query = asked[i].astype(np.int64) if fits else _exact(column.slice(i, 1), self.width)[0]
            vectors = self.vectors if fits else self.exact()
            if self.plain or most > HUGE:
                scores = (vectors * query).sum(axis=1).tolist() if self.width else [0] * len(self.ids)
                best = heapq.nlargest(k, ((score, -int(j)) for score, j in zip(scores, self.ids.tolist(), strict=True) if j != own))
                got = [(score, -j) for score, j in best]
            else:
                got = search(self.root, self.points, vectors, self.ids, np.append(asked[i], 0.0), query, own, k)
            for score, j in got:
                yield own, j, int(score)


def _searched(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by block, the block's vectors before the queries."""
        at, ids, columns, block = None, [], [], None
        for batch in batches:
            key = np.stack([np.asarray(batch.column("block")), np.asarray(batch.column("asked")).astype(np.int64)], axis=1)
            cuts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1), [True]])) if len(key) else np.zeros(0, np.int64)
            for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                part = batch.slice(begin, end - begin)
                number, asked = key[begin].tolist()
                if number != at:
                    at, ids, columns, block = number, [], [], None
                if not asked:
                    ids.append(np.asarray(part.column("vec_id")))
                    columns.append(part.column("embedding"))
                    continue
                if not ids:
                    continue
                if block is None:
                    block = Block(np.concatenate(ids), pa.concat_arrays(columns))
                found = np.array([(q, j, min(max(score, -LONG - 1), LONG)) for q, j, score in block.found(part, k)], np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, i])) for i in range(3)], names=["query_id", "vec_id", "score"])

    return run


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and embedding of rows that take part: no null id, no null vector, no null or non-finite component."""
    v = F.col(vector_col)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("embedding"), sound.alias("ok")).filter("vec_id IS NOT NULL AND embedding IS NOT NULL AND ok").drop("ok")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest integer inner products, ties to the smaller vec_id.

    Both inputs have vec_id and embedding (see usable). A row whose id equals
    the query's is never its answer, so repeated ids of the query are left out
    together; of query rows with one id the least vector is asked. Vectors of
    other lengths are compared as if filled with 0; empty vectors score 0.
    Components of any size are scored exactly within a block; a score beyond 64
    bits is given as the nearest long. No rows or no queries: an empty result.
    """
    queries = queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    blocks = max(1, -(-vectors.count() // block_rows))
    # equal vectors have different ids: a very common vector is dealt over all blocks
    rows = vectors.select(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asked"), "vec_id", "embedding")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asked"), "vec_id", "embedding")
    dealt = rows.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "asked")
    found = dealt.mapInArrow(_searched(k), FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_query(spark, sf_dir):
    from platen.llm.common import read

    rows = usable(read(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.filter("vec_id % 100 = 0"))


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10
"""
