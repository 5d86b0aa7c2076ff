"""N-gram Jaccard join: Voronoi regions in the Jaccard metric space, joined recursively and exactly.

Distance is 1 - |x & y| / |x | y| over sets of distinct word shingles, a metric;
documents link at distance 0.2 or less.

1.  Documents with equal sets form a class; from here on a class counts once.
2.  Most pairs lie at distance exactly 1, where document pivots tell nothing
    apart, so the outermost pivots are single shingles: a document lies nearer
    than 1 only to those that it holds. Its cells are replicated just as far as
    the threshold asks: in any one order of shingles, the first K(n) that two
    linked sets have in common lie among the first n - ceil(8n/9) + K(n) of the
    smaller and n - ceil(4n/5) + K(n) of the larger. The order used puts
    frequent shingles last. A document whose cells are fewer than the K of its
    smallest possible partner links with nothing and goes no further: only the
    texts of those that are left move.
3.  The members of all cells with the same smallest document are a region. A
    region is split by document pivots, far from each other, into Voronoi cells:
    a member goes to its nearest pivot, or to the outer cell where none is nearer
    than REACH. By the triangle inequality a link can cross a boundary only
    from a window around it; members in it are replicated into the later cell.
    Cells are split again until a few members are left, which are measured one
    by one. Where windows hold most of a region a boundary parts nothing, and
    each member that is not yet connected becomes a pivot in its turn.
    Pairs already connected are not compared, unless all links are asked for.
4.  A region too large for a task is measured in chunks that each get the same
    pivots, and its cells are the regions of the next round; each round takes
    eight times as many pivots, so a region that does not part ends as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platen.llm.common import U, blocks, materialise, mix, text_buffer, word_hashes
from platen.llm.components import components

SHINGLE = 5
THRESHOLD = (4, 5)  # intersection / union
RADIUS = 0.2
#: Pivots farther than this own nothing: the distance at which the outer cell begins.
REACH = 0.6
SLACK = 1e-9
BLOCK_BYTES = 2 << 20
#: Shingles that come last in the order: so many at most; any set gives right results.
FREQUENT = 100_000
FREQUENT_PER_BLOCK = 4_000
FREQUENT_LEAST = 4
BUCKET_ENTRIES = 400_000
#: Entries a task gathers before it hands them on, packed by bucket.
GATHERED = 600_000
#: Members, and bytes of their texts, that one task joins or measures at once.
CHUNK = 4096
CHUNK_BYTES = 4 << 20
#: Bytes of text of a group of regions or chunks.
BUCKET_BYTES = 4 << 20
LEAF = 8
PIVOTS = 8
#: Pivots of a large region's first round; eight times as many in each further one.
WIDE = 32

_C = [U(pow(0xC2B2AE3D27D4EB4F, k, 1 << 64)) for k in range(SHINGLE + 1)]


def shingle_sets(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts one after another, and n + 1 offsets."""
    docs = len(at) - 1
    if not len(raw):
        return np.zeros(0, U), np.zeros(docs + 1, np.int64)
    b = raw.copy()
    b[(b >= 65) & (b <= 90)] += 32
    inside = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edge = np.zeros(len(b) + 1, bool)
    edge[at] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    words = word_hashes(b, s, e)
    first = np.searchsorted(s, at)
    count = np.diff(first)
    parts, owners = [], []
    if len(words) >= SHINGLE:
        h = np.zeros(len(words) - SHINGLE + 1, U)
        for k in range(SHINGLE):
            h += words[k : k + len(h)] * _C[SHINGLE - k]
        limit = np.repeat(first[1:], count)[: len(h)]
        good = np.arange(len(h)) + SHINGLE <= limit
        parts.append(mix(h[good]))
        owners.append(np.repeat(np.arange(docs), count)[: len(h)][good])
    for n in range(1, SHINGLE):
        short = np.flatnonzero(count == n)
        if len(short):
            h = np.full(len(short), U(n))
            for k in range(n):
                h += words[first[short] + k] * _C[SHINGLE - k]
            parts.append(mix(h))
            owners.append(short)
    if not parts:
        return np.zeros(0, U), np.zeros(docs + 1, np.int64)
    h, owner = (parts[0], owners[0]) if len(parts) == 1 else (np.concatenate(parts), np.concatenate(owners))
    if len(parts) > 1:
        order = np.argsort(owner, kind="stable")
        h, owner = h[order], owner[order]
    at = np.searchsorted(owner, np.arange(docs + 1))
    for i in range(docs):
        h[at[i] : at[i + 1]].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[at[:-1][at[:-1] < len(h)]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return h[new], kept[at]


def set_digests(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set; with the set's size it stands for the class."""
    sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(h ^ U(0xA0761D6478BD642F)))])
    return mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(U)).view(np.int64)


def least_common(n):
    """K(n): so many shared prefix shingles are asked of two linked sets, by the smaller one."""
    return (n + 19) // 20


def needed(n):
    """K of the smallest set that one of n shingles can link with."""
    return least_common((4 * n + 4) // 5)


SIZES = "doc_id long, fp long, bytes long, n long, digest long, frequent boolean"


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """frequent = false: each document's size and digest; true: shingles that many documents of the block hold, with their number."""
    for block in blocks(batches, "text", BLOCK_BYTES):
        raw, ends = text_buffer(block.column("text"))
        h, at = shingle_sets(raw, ends)
        digest, n = set_digests(h, at), np.diff(at)
        shingle, count = np.unique(h, return_counts=True)
        often = np.flatnonzero(count >= FREQUENT_LEAST)
        often = often[np.argsort(-count[often], kind="stable")[:FREQUENT_PER_BLOCK]]
        k = len(often)
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([block.column("doc_id"), pa.nulls(k, pa.int64())]),
                pa.concat_arrays([block.column("fp"), pa.nulls(k, pa.int64())]),
                pa.array(np.concatenate([np.diff(ends), np.zeros(k, np.int64)])),
                pa.array(np.concatenate([n, count[often]]).astype(np.int64)),
                pa.array(np.concatenate([digest, shingle[often].view(np.int64)])),
                pa.array(np.arange(len(n) + k) >= len(n)),
            ],
            names=["doc_id", "fp", "bytes", "n", "digest", "frequent"],
        )


def prefix(h: np.ndarray, at: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index into h, owner and rank of every shingle of each document's longer prefix."""
    n = np.diff(at)
    owner = np.repeat(np.arange(len(n)), n)
    late = np.zeros(len(h), bool)
    if len(frequent):
        seen = np.zeros(1 << 22, bool)
        seen[(frequent & U((1 << 22) - 1)).astype(np.int64)] = True
        maybe = np.flatnonzero(seen[(h & U((1 << 22) - 1)).astype(np.int64)])
        where = np.minimum(np.searchsorted(frequent, h[maybe]), len(frequent) - 1)
        late[maybe] = frequent[where] == h[maybe]
    early = np.cumsum(~late)
    base = np.concatenate([[0], early])
    rank = np.where(late, np.arange(len(h)) - at[:-1][owner] - (early - base[at[:-1]][owner]) + (base[at[1:]] - base[at[:-1]])[owner], early - 1 - base[at[:-1]][owner])
    longest = n - (4 * n + 4) // 5 + least_common(n)
    pick = np.flatnonzero(rank < longest[owner])
    return pick, owner[pick], rank[pick]


ENTRY = np.dtype([("shingle", "<u8"), ("cls", "<i8"), ("word", "<u4")])


def _entries(frequent_shared, buckets: int):
    def packed(parts: list[np.ndarray]) -> pa.RecordBatch:
        e = np.concatenate(parts)
        bucket = (e["shingle"] % U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        e, cuts = e[order], np.flatnonzero(np.diff(bucket[order], prepend=-1))
        ends = np.append(cuts[1:], len(e))
        return pa.RecordBatch.from_arrays([pa.array(bucket[order][cuts]), pa.array([e[a:b].tobytes() for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)], pa.binary())], names=["bucket", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = frequent_shared.value
        parts: list[np.ndarray] = []
        for block in blocks(batches, "text", BLOCK_BYTES):
            h, at = shingle_sets(*text_buffer(block.column("text")))
            digest, n = set_digests(h, at), np.diff(at)
            pick, owner, rank = prefix(h, at, frequent)
            once = np.zeros(len(n), bool)
            once[np.unique(digest, return_index=True)[1]] = True
            keep = once[owner]
            pick, owner, rank = pick[keep], owner[keep], rank[keep]
            size = n[owner]
            e = np.empty(len(pick), ENTRY)
            e["shingle"], e["cls"] = h[pick], digest[owner]
            e["word"] = size * 2 + (rank < size - (8 * size + 8) // 9 + least_common(size))
            if len(e):
                parts.append(e)
            if sum(map(len, parts)) > GATHERED:
                yield packed(parts)
                parts = []
        if parts:
            yield packed(parts)

    return run


MEMBER = "pivot long, pivot_n long, digest long, n long, cells long"


def _cells(table: pa.Table) -> pa.Table:
    """Rows (pivot, pivot_n, digest, n, cells): the members of the cells of each smallest document, and in how many of them.

    A cell is cut where sizes leave a gap no link spans.
    """
    e = np.frombuffer(b"".join(table.column("entries").to_pylist()), ENTRY)
    h, cls, size, short = e["shingle"], e["cls"], (e["word"] >> 1).astype(np.int64), (e["word"] & 1).astype(bool)
    order = np.lexsort((cls, size, h))
    h, cls, size, short = h[order], cls[order], size[order], short[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (cls[1:] != cls[:-1]) | (size[1:] != size[:-1])
    h, cls, size, short = h[new], cls[new], size[new], short[new]
    head = np.ones(len(h), bool)
    head[1:] = (h[1:] != h[:-1]) | (5 * size[:-1] < 4 * size[1:])
    cell = np.cumsum(head) - 1
    at = np.flatnonzero(head)
    members = np.diff(np.append(at, len(h)))
    live = (members > 1) & np.maximum.reduceat(short, at) if len(h) else np.zeros(0, bool)
    rows = np.flatnonzero(live[cell])
    top = at[cell[rows]]
    pairs, count = np.unique(np.stack([cls[top], size[top], cls[rows], size[rows]], axis=1), axis=0, return_counts=True) if len(rows) else (np.zeros((0, 4), np.int64), np.zeros(0, np.int64))
    return pa.table({**{k: pa.array(np.ascontiguousarray(pairs[:, i])) for i, k in enumerate(("pivot", "pivot_n", "digest", "n"))}, "cells": pa.array(count.astype(np.int64))})


class Region:
    """The sets of one region's members, which of them are known to be connected, and the links found between them."""

    def __init__(self, sets: list[np.ndarray], labels: np.ndarray | None = None, every: bool = False):
        self.every, self.splits = every, 0
        self.links: set[tuple[int, int]] = set()
        self.n = np.array([len(x) for x in sets], np.int64)
        self.parent = list(range(len(sets)))
        if labels is not None:
            first: dict[int, int] = {}
            for i, label in enumerate(labels.tolist()):
                self.parent[i] = first.setdefault(label, i)
        # the members that hold each shingle, for shingles that several hold
        every_one = np.concatenate(sets) if sets else np.zeros(0, U)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.n)
        order = np.argsort(every_one, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = every_one[order][1:] != every_one[order][:-1]
        term = np.cumsum(new, dtype=np.int64) - 1
        count = np.bincount(term)
        self.held, self.at, self.df = owner[order], np.concatenate([[0], np.cumsum(count)]), count
        of = np.empty(len(order), np.int64)
        of[order] = term
        shared = count[of] > 1 if len(of) else np.zeros(0, bool)
        self.terms, self.first = of[shared], np.concatenate([[0], np.cumsum(np.bincount(owner[shared], minlength=len(sets)))]).astype(np.int64)

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def distance(self, p: int, ids: np.ndarray) -> np.ndarray:
        """Distances to p; links found on the way are kept."""
        terms = self.terms[self.first[p] : self.first[p + 1]]
        size = self.df[terms]
        inter = np.bincount(self.held[np.repeat(self.at[terms] - (np.cumsum(size) - size), size) + np.arange(size.sum())], minlength=len(self.n))[ids]
        inter[ids == p] = self.n[p]
        union = self.n[p] + self.n[ids] - inter
        for i in ids[THRESHOLD[1] * inter >= THRESHOLD[0] * union].tolist():
            if i != p and self.every:
                self.links.add((min(i, p), max(i, p)))
            a, b = self.find(p), self.find(i)
            self.parent[max(a, b)] = min(a, b)
        return 1 - inter / union

    def open(self, ids: np.ndarray) -> np.ndarray:
        """Members that must still be measured: those outside the largest component, or all."""
        if self.every:
            return ids
        root = np.array([self.find(i) for i in ids.tolist()])
        names, which = np.unique(root, return_inverse=True)
        which = which.reshape(-1)
        return ids[which != np.bincount(which).argmax()] if len(names) > 1 else ids[:0]

    def join(self, ids: np.ndarray) -> None:
        stack = [ids]
        while stack:
            ids = stack.pop()
            left = self.open(ids) if len(ids) > 1 else ids[:0]
            if not len(left):
                continue
            if len(ids) <= LEAF:
                self.sweep(ids)
                continue
            pivots, far = [int(left[0])], [self.distance(int(left[0]), ids)]
            candidate = np.isin(ids, left)
            while len(pivots) < PIVOTS:
                nearest = np.where(candidate, np.minimum.reduce(far), -1.0)
                if nearest.max() <= RADIUS:
                    break
                pivots.append(int(ids[nearest.argmax()]))
                far.append(self.distance(pivots[-1], ids))
            cells, rest = voronoi(np.stack(far)), ~np.isin(ids, pivots)
            parts = [ids[c & rest] for c in cells]
            if sum(map(len, parts)) > 1.25 * len(ids):
                self.sweep(ids[rest])  # the boundaries part nothing
            else:
                self.splits += sum(map(bool, map(len, parts))) > 1
                stack += [part for part in parts if len(part) > 1]

    def sweep(self, ids: np.ndarray) -> None:
        """Each open member is a pivot for all."""
        left = self.open(ids)
        main = ids[~np.isin(ids, left)]
        for p in left.tolist():
            if self.every or not len(main) or self.find(p) != self.find(int(main[0])):
                self.distance(p, ids)


def voronoi(far: np.ndarray) -> list[np.ndarray]:
    """Masks of the members of each pivot's cell and, last, of the outer one, from distances by pivot and member.

    A linked pair that a boundary parts meets in the later of its two cells.
    With i before j, its member x of cell i has far[j] - far[i] <= 2 * RADIUS and
    far[j] <= REACH + RADIUS there, as distances change by RADIUS at most between
    the two; and the outer cell's constant distance gives far[i] >= REACH - RADIUS.
    """
    owner = np.concatenate([far, np.full((1, far.shape[1]), REACH)]).argmin(axis=0)
    own = far[np.minimum(owner, len(far) - 1), np.arange(far.shape[1])]
    cells = []
    for j in range(len(far)):
        window = (owner < j) & (far[j] - own <= 2 * RADIUS + SLACK) & (far[j] <= REACH + RADIUS + SLACK)
        cells.append((owner == j) | window)
    cells.append((owner == len(far)) | (own >= REACH - RADIUS - SLACK))
    return cells


def _sets(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    """The sets of the texts of a group, each made once, and the set of each row."""
    _, first, which = np.unique(np.stack([table.column("digest").to_numpy(), table.column("n").to_numpy()], axis=1), axis=0, return_index=True, return_inverse=True)
    sets: list[np.ndarray] = []
    texts = pa.RecordBatch.from_arrays([pa.concat_arrays(table.column("text").take(pa.array(first)).chunks) if len(first) else pa.array([], pa.string())], names=["text"])
    for block in blocks([texts], "text", BLOCK_BYTES):
        h, at = shingle_sets(*text_buffer(block.column("text")))
        sets += [h[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return sets, which.reshape(-1)


EDGES = "a long, b long"


def _regions(every: bool):
    def run(table: pa.Table) -> pa.Table:
        """Joins every region of a bucket: rows (a, b) of linked or connected classes."""
        sets, which = _sets(table)
        region, digest, label = (table.column(c).to_numpy() for c in ("region", "digest", "label"))
        order = np.lexsort((digest, region))
        cuts = np.flatnonzero(np.concatenate([[True], region[order][1:] != region[order][:-1], [True]]))
        a, b = [], []
        for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            rows = order[begin:end]
            rows = rows[np.unique(which[rows], return_index=True)[1]]
            r = Region([sets[i] for i in which[rows].tolist()], None if every else label[rows], every)
            r.join(np.arange(len(rows)))
            pairs = sorted(r.links) if every else [(i, root) for i in range(len(rows)) if (root := r.find(i)) != i]
            for i, j in pairs:
                a.append(digest[rows[i]])
                b.append(digest[rows[j]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


MEASURED = "kind int, region long, digest long, n long, doc_id long, fp long, bytes long, label long, cells array<struct<cell:int,far:double>>"


def _measured(every: bool):
    def run(table: pa.Table) -> pa.Table:
        """Measures the members of chunks against the pivots of their region.

        kind 0: classes digest and label are linked or connected; kind 1: a
        member, with its cells, under the label of the pivot it is connected to;
        kind 2: pivot digest is connected to what has that label.
        """
        sets, which = _sets(table)
        unit, slot = table.column("unit").to_numpy(), np.asarray(table.column("slot"))
        cols = {c: table.column(c).to_numpy() for c in ("region", "digest", "n", "doc_id", "fp", "bytes", "label")}
        order = np.lexsort((slot, unit))
        cuts = np.flatnonzero(np.concatenate([[True], unit[order][1:] != unit[order][:-1], [True]]))
        kinds, named, label, cells = [], [], [], []
        for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            rows = order[begin:end]
            pivots, members = rows[slot[rows] >= 0], rows[slot[rows] < 0]
            pivots = pivots[np.unique(which[pivots], return_index=True)[1]]
            members = members[np.unique(which[members], return_index=True)[1]]
            if not len(pivots) or not len(members):
                continue
            k, every_one = len(pivots), np.concatenate([pivots, members])
            digest = cols["digest"][every_one]
            r = Region([sets[i] for i in which[every_one].tolist()], None, every)
            far = np.stack([r.distance(i, np.arange(len(every_one))) for i in range(k)])[:, k:]
            root = [r.find(i) for i in range(len(digest))]
            for i, j in sorted(r.links) if every else enumerate(root):
                if digest[i] != digest[j]:
                    kinds.append(0)
                    named.append(every_one[i])
                    label.append(digest[j])
                    cells.append([])
            # labels that the pivots join: of each other, and of members that shared one before
            old = cols["label"][every_one]
            joins = {(root[i], int(old[i])) for i in range(len(digest)) if root[i] < k and (old[i] != digest[i] or i < k)} | {(root[i], int(digest[i])) for i in range(k)}
            for i, name in sorted(joins):
                if digest[i] != name:
                    kinds.append(2)
                    named.append(pivots[i])
                    label.append(name)
                    cells.append([])
            inside = np.stack(voronoi(far))
            rest = ~np.isin(which[members], which[pivots])
            for i in np.flatnonzero(rest).tolist():
                kinds.append(1)
                named.append(members[i])
                label.append(digest[root[k + i]] if root[k + i] < k else cols["label"][members[i]])
                cells.append([{"cell": j, "far": far[j, i]} if j < k else {"cell": -1, "far": 0.0} for j in np.flatnonzero(inside[:, i]).tolist()])
        row = np.array(named, np.int64)
        return pa.table({
            "kind": pa.array(kinds, pa.int32()), **{c: pa.array(cols[c][row]) for c in ("region", "digest", "n", "doc_id", "fp", "bytes")},
            "label": pa.array(label, pa.int64()), "cells": pa.array(cells, pa.list_(pa.struct([("cell", pa.int32()), ("far", pa.float64())]))),
        })

    return run


def _united(table: pa.Table) -> pa.Table:
    """Rows (region, label, root) from connected pairs (digest, label) of a region's pivots."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(table.column("digest").to_pylist(), table.column("label").to_pylist(), strict=True):
        parent[find(a)] = find(b)
    return pa.table({"region": pa.array([table.column("region")[0].as_py()] * len(parent), pa.int64()), "label": pa.array(list(parent), pa.int64()), "root": pa.array([find(x) for x in parent], pa.int64())})


def _grouped(rows: DataFrame, by: str, total: float, texts: DataFrame, kernel, schema: str, name: str) -> DataFrame:
    """Runs a kernel over rows with their texts, total bytes in all, in groups of units of about BUCKET_BYTES."""
    buckets = int(total // BUCKET_BYTES) + 16
    with_text = rows.hint("shuffle_hash").join(texts, ["doc_id", "fp"]).withColumn("bucket", F.pmod(F.xxhash64(by), F.lit(buckets)))
    return materialise(with_text.groupBy("bucket").applyInArrow(kernel, schema), name)


def _joined(work: DataFrame, texts: DataFrame, every: bool) -> DataFrame:
    """Edges (a, b) between linked classes of the regions of work: region, digest, n, doc_id, fp, bytes, label, far.

    Members of one label are known to be connected; far is the distance to the
    region's pivot, 0 where it has none.
    """
    edges, small, small_bytes, wide = [], [], 0, WIDE
    while True:
        turn = len(small)
        common = work.groupBy("region", "label").agg(F.count(F.lit(1)).alias("same")).groupBy("region").agg(F.max_by("label", F.struct("same", "label")).alias("main"))
        # tables by region are written before they are joined, so that a large region's rows can be dealt anew
        common = materialise(common, "common")
        open_ = F.lit(True) if every else F.col("label") != F.col("main")
        # dealt by member before they are gathered, else a region's join and aggregate would share one task
        size = work.join(common, "region").repartition("region", "digest").groupBy("region", "main").agg(
            F.count(F.lit(1)).alias("members"), F.sum("bytes").alias("total"), F.count(F.when(open_, 1)).alias("left"), F.min(F.when(open_, F.col("far"))).alias("least"), F.max(F.when(open_, F.col("far"))).alias("most")
        )
        # as many pivots as fit beside a chunk
        pivots = F.least(F.lit(wide), F.greatest(F.lit(PIVOTS), F.floor(CHUNK_BYTES * F.col("members") / F.col("total")))).cast("long")
        chunks = F.greatest(F.ceil(F.col("members") / CHUNK), F.ceil(F.col("total") / CHUNK_BYTES)).cast("long")
        size = materialise(size.filter("members > 1 AND left > 0").select("region", "main", "members", "total", "left", "least", "most", pivots.alias("pivots"), chunks.alias("chunks")), "regions")
        # bytes of text: of small regions, and of members and pivots of large ones
        sums = size.groupBy((F.col("chunks") > 1).alias("large")).agg(F.sum(F.when(F.col("chunks") == 1, F.col("total")).otherwise(F.col("total") * (1 + F.col("chunks") * F.least("pivots", "left") / F.col("members")))).alias("bytes"), F.max(F.col("left") > F.col("pivots")).alias("goes_on"))
        sums = {r["large"]: r for r in sums.collect()}
        here = work.join(size, "region")
        # members that are connected already: only those within reach of an open one
        here = here.filter(open_ | F.col("far").between(F.col("least") - RADIUS - SLACK, F.col("most") + RADIUS + SLACK))
        cols = ["region", "digest", "n", "doc_id", "fp", "bytes", "label"]
        small.append(here.filter("chunks = 1").select(*cols))
        small_bytes += sums[False]["bytes"] if False in sums else 0
        if True not in sums:
            break
        large = here.filter("chunks > 1")
        # where all open members can be pivots they are, and the region ends; else the least by hash of each slot
        asked = large.filter(open_)
        slot = F.when(F.col("left") <= F.col("pivots"), F.xxhash64("digest", "n")).otherwise(F.pmod(F.xxhash64("digest", F.lit(turn)), F.col("pivots")))
        chosen = asked.withColumn("slot", slot).repartition("region", "slot").groupBy("region", "slot").agg(F.min_by(F.struct(*cols[1:], "chunks"), F.xxhash64("digest", F.lit(-1 - turn))).alias("p")).select("region", "p.*")
        chosen = chosen.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        members = large.withColumn("chunk", F.pmod(F.xxhash64("digest", "n"), F.col("chunks")))
        units = chosen.select(*cols, "chunk", F.lit(0).alias("slot")).unionByName(members.select(*cols, "chunk", F.lit(-1).alias("slot")))
        found = _grouped(units.withColumn("unit", F.xxhash64("region", "chunk")), "unit", sums[True]["bytes"], texts, _measured(every), MEASURED, "measured")
        edges.append(found.filter("kind = 0").select(F.col("digest").alias("a"), F.col("label").alias("b")))
        if not sums[True]["goes_on"]:
            break
        united = found.filter("kind = 2").select("region", "digest", "label").distinct().groupBy("region").applyInArrow(_united, "region long, label long, root long")
        united = materialise(united, "united")
        going = found.filter("kind = 1").join(size.filter("left > pivots").select("region"), "region", "left_semi")
        going = materialise(going.join(united, ["region", "label"], "left").withColumn("label", F.coalesce("root", "label")), "measured")
        # where the windows hold most of a region its boundaries part nothing: it goes on as one
        parts = going.groupBy("region").agg((F.sum(F.size("cells")) <= 1.25 * F.count(F.lit(1))).alias("parts"))
        parts = materialise(parts, "parts")
        whole = F.array(F.struct(F.lit(-2).alias("cell"), F.lit(0.0).alias("far")))
        cells = going.join(parts, "region").select(*cols, F.explode(F.when(F.col("parts"), F.col("cells")).otherwise(whole)).alias("in"))
        work = materialise(cells.select(F.xxhash64("region", "in.cell", F.lit(turn)).alias("region"), *cols[1:], "in.far"), "work")
        wide = min(1024, 8 * wide)
    rest = small[0]
    for more in small[1:]:
        rest = rest.unionByName(more)
    edges.append(_grouped(rest, "region", small_bytes, texts, _regions(every), EDGES, "links"))
    found = edges[0]
    for more in edges[1:]:
        found = found.unionByName(more)
    return found


def _linked(docs: DataFrame, id_col: str, text_col: str, every: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, n, digest), classes (n, digest, doc_id) and edges (a, b) between classes' digests."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("fp"), text.alias("text"))
    seen = materialise(texts.mapInArrow(_sizes, SIZES), "sets")
    rows = seen.filter("NOT frequent").drop("frequent")
    often = seen.filter("frequent").groupBy("digest").agg(F.sum("n").alias("c")).orderBy(F.desc("c"), "digest").limit(FREQUENT).select("digest").collect()
    frequent = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in often], np.int64).view(U)))
    classes = rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("n", "digest").agg(F.min(F.struct("doc_id", "fp", "bytes")).alias("r")).select("n", "digest", "r.*")
    classes = materialise(classes, "classes")

    entries = rows.agg(F.sum(F.col("n") / 4 + 1)).first()[0] or 0
    buckets = int(entries // BUCKET_ENTRIES) + 1
    cells = texts.filter("doc_id IS NOT NULL").mapInArrow(_entries(frequent, buckets), "bucket long, entries binary")
    members = cells.groupBy("bucket").applyInArrow(_cells, MEMBER).groupBy("pivot", "pivot_n", "digest", "n").agg(F.sum("cells").alias("cells"))
    members = materialise(members, "members")
    need = F.floor((F.floor((F.col("n") * 4 + 4) / 5) + 19) / 20)
    alive = members.groupBy("digest", "n").agg(F.sum("cells").alias("cells")).filter(F.col("cells") >= need).select("digest", "n")
    alive = materialise(classes.join(alive, ["digest", "n"]), "alive")
    work = members.drop("cells").join(alive, ["digest", "n"])
    work = work.select(F.xxhash64("pivot", "pivot_n").alias("region"), "digest", "n", "doc_id", "fp", "bytes", F.col("digest").alias("label"), F.lit(0.0).alias("far"))
    work = materialise(work, "work")
    # the texts that move, each once even where a row is repeated
    wanted = texts.join(alive.select("doc_id", "fp").hint("shuffle_hash"), ["doc_id", "fp"]).dropDuplicates(["doc_id", "fp"])
    return rows, classes, _joined(work, materialise(wanted, "texts"), every)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, n_shingles, component_id, digest, fp, kept; one row per input row.

    fp is xxhash64 of the text (null: empty), with which doc_id tells rows apart
    where ids repeat; kept is true for the component's first document, for rows
    without a set and for rows without an id. Texts that are null, empty or blank have no set, link with nothing and are
    their own component. A row whose id is null gets its set's size and a null
    component and links nothing. Repeated rows are equal sets and share a
    component; if an id repeats with other texts, each row counts by its own.
    An empty table gives no rows. Other columns are not read.
    """
    rows, classes, edges = _linked(docs, id_col, text_col, False)
    roots = materialise(components(edges), "roots")
    # the root is a digest: the component is named by its smallest document
    inside = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    least = inside.join(classes, F.col("node") == F.col("digest")).groupBy("root").agg(F.min(F.struct("doc_id", "fp")).alias("least"))
    named = inside.join(least, "root").select(F.col("node").alias("digest"), "least")
    named = classes.join(named, "digest", "left").select("n", "digest", F.coalesce("least", F.struct("doc_id", "fp")).alias("least"))
    component = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("least.doc_id"))
    kept = F.col("doc_id").isNull() | (F.col("n") == 0) | (F.struct("doc_id", "fp") == F.col("least"))
    return rows.join(named, ["n", "digest"], "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "digest", "fp", kept.alias("kept"))


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All links: (class_a, class_b) between classes of equal sets, each once, and (doc_id, class_id), the classes' members.

    A class is named by its smallest document; rows as in jaccard_components,
    those without a set or an id are in no class. Where one id has several
    texts, its classes have one name.
    """
    rows, classes, edges = _linked(docs, id_col, text_col, True)
    name = lambda c: classes.select(F.col("digest").alias(c), F.col("doc_id").alias(f"class_{c}"))
    named = edges.join(name("a"), "a").join(name("b"), "b")
    pairs = named.select(F.least("class_a", "class_b").alias("class_a"), F.greatest("class_a", "class_b").alias("class_b")).distinct()
    members = rows.filter("doc_id IS NOT NULL").join(classes.select("n", "digest", F.col("doc_id").alias("class_id")), ["n", "digest"]).select("doc_id", "class_id")
    return pairs, members


def op4_query(spark, sf_dir):
    from platen.llm.common import read

    return jaccard_components(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
