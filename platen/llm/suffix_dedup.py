"""Suffix-array dedup: passages of LENGTH bytes that an earlier document holds are removed.

A passage shared by two documents is found wherever it lies, by merging
Burrows-Wheeler transforms of shards (platen.llm.bwt): the merged interleave
gives every suffix the interval of those that share its first LENGTH bytes, and
the smallest document of an interval keeps it.

Which texts must meet in one merge is decided first, exactly. Every window of
LENGTH bytes has an anchor, its GRAM-byte string with the least hash, so equal
windows have equal anchors; the windows of one anchor in a row and the bytes
they cover are a segment. Segments are dealt by anchor. Equal segments are one
string for the merge: it stands for the smallest document, and all windows of
later ones are repeats. A segment without a second text under its anchor
shares no window with other texts, and so is left out of the merge.

Blocks of documents hand on each anchor and segment once, as the smallest
document of the block, so a passage that a third of all rows hold brings a
bucket one entry for each block. Text moves with its document twice, to cut out
the segments that merge and to remove the repeats; entries are a few bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platen.llm.bwt import intervals
from platen.llm.common import BASE, U, blocks, materialise, mix, powers, text_buffer

LENGTH = 50
GRAM = 28
PIECE = 1 << 16
BLOCK_BYTES = 3 << 20
BUCKET_ENTRIES = 1_500_000
#: A round of merges stays within a core's cache.
MERGE_BYTES = 200_000
SHARDS = 4
#: Segment bytes of a bucket of merges.
MERGE_BUCKET_BYTES = 3_000_000
#: Of an anchor's hash this much is kept beside its bucket; anchors that meet by chance only share a merge.
KEPT = 5
#: Of this share of the documents the anchors are counted, to find hot ones: most so many, with so many texts in a block and in all.
HOT_SAMPLE = 8
HOT_ANCHORS = 50_000
HOT_IN_BLOCK = 6
HOT_IN_ALL = 64
ROW = "bucket long, kind int, doc_id long, fp long, a binary, b binary, c binary, d binary, e binary"
NAMES = ("bucket", "kind", "doc_id", "fp", "a", "b", "c", "d", "e")
PACKED = "group_no long, kind int, docs binary, payload binary"
REPLY = "doc_id long, fp long, kind int, reply binary"
MERGED = np.dtype([("ordinal", "<u4"), ("first", "<i4"), ("last", "<i4")])


def grams(raw: np.ndarray) -> np.ndarray:
    """Scrambled hashes of all GRAM-byte strings, by doubling."""
    power = lambda n: U(pow(BASE, n, 1 << 64))
    h, size, out, have = raw.astype(U) + U(1), 1, None, 0
    while size <= GRAM:
        if GRAM & size:
            # strings of have bytes go before those of size bytes
            out = h if out is None else out[: len(out) - size] * power(size) + h[have:]
            have += size
        if 2 * size > GRAM:
            break
        h = h[:-size] * power(size) + h[size:]
        size *= 2
    return mix(out)


def least_of(h: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of width values."""
    size = 1
    while 2 * size <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :]) if size < width else h


class Segments:
    """All segments of a block of texts: document, ordinal in it, anchor hash, first window, number of windows, content hash."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, hot: np.ndarray | None = None):
        sizes = np.diff(at)
        self.at = at
        if len(raw) < LENGTH:
            self.doc = self.first = self.windows = self.ordinal = np.zeros(0, np.int64)
            self.anchor = self.content = np.zeros(0, U)
            self.heads = np.zeros(len(sizes) + 1, np.int64)
            return
        up, down = powers(len(raw) + 1)
        anchor, sums = np.empty(len(raw) - LENGTH + 1, U), np.zeros(len(raw) - GRAM + 2, U)
        for at_ in range(0, len(anchor), PIECE):  # pieces that stay in a core's cache
            stop = min(at_ + PIECE, len(anchor))
            g = grams(raw[at_ : stop + LENGTH - 1])
            anchor[at_:stop] = least_of(g, LENGTH - GRAM + 1)
            own = g if stop == len(anchor) else g[: stop - at_]
            np.cumsum(own * up[at_ : at_ + len(own)], out=sums[at_ + 1 : at_ + 1 + len(own)])
            sums[at_ + 1 : at_ + 1 + len(own)] += sums[at_]
        if hot is not None and len(hot):
            where = np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)
            under = np.flatnonzero(hot[where] == anchor)
            anchor = anchor.copy()
            anchor[under] = mix((sums[under + LENGTH - GRAM + 1] - sums[under]) * down[under])
        owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[: len(anchor)]
        good = np.arange(len(anchor)) + LENGTH <= at[1:][owner]
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
        start = np.flatnonzero(new & good)  # a document's good windows come first, so a run that begins good may only lose its tail
        stop = np.flatnonzero(np.append((new | ~good)[1:], True) & good) + 1
        self.first, self.windows = start, stop - start
        self.doc, self.anchor = owner[start].astype(np.int64), anchor[start]
        self.heads = np.searchsorted(self.doc, np.arange(len(sizes) + 1))
        self.ordinal = np.arange(len(start)) - self.heads[self.doc]
        self.content = mix((sums[stop + LENGTH - GRAM] - sums[start]) * down[start] ^ mix(self.windows.astype(U)))


def _pack(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - KEPT :]).tobytes()


def _unpack(column) -> np.ndarray:
    data = np.frombuffer(b"".join(column), np.uint8).reshape(-1, KEPT)
    out = np.zeros((len(data), 8), np.uint8)
    out[:, 8 - KEPT :] = data
    return out.view("<u8").reshape(-1)


def _batch(rows: list[tuple], names=NAMES) -> pa.RecordBatch:
    kinds = {"bucket": pa.int64(), "kind": pa.int32(), "doc_id": pa.int64(), "fp": pa.int64()}
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.binary())) for n, c in zip(names, cols, strict=True)], names=list(names))


def _whole_runs(ordinals: np.ndarray) -> bytes:
    """Replies: from ordinal to last, all windows (first is -1)."""
    cut = np.flatnonzero(np.diff(ordinals) != 1)
    begin, end = ordinals[np.concatenate([[0], cut + 1])], ordinals[np.concatenate([cut, [len(ordinals) - 1]])]
    out = np.zeros(len(begin), MERGED)
    out["ordinal"], out["first"], out["last"] = begin, -1, end
    return out.tobytes()


def _by_doc(doc: np.ndarray, rest: np.ndarray):
    """Slices of rest by value of the sorted array doc."""
    if len(doc):
        cuts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield int(doc[a]), rest[a:b]


def _varied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors with several texts in a block, and how many."""
    for block in blocks(batches, "text", BLOCK_BYTES):
        s = Segments(*text_buffer(block.column("text")))
        order = np.lexsort((s.content, s.anchor))
        anchor, content = s.anchor[order], s.content[order]
        new = np.ones(len(order), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])
        names, count = np.unique(anchor[new], return_counts=True)
        often = np.flatnonzero(count >= HOT_IN_BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(names[often].view(np.int64)), pa.array(count[often].astype(np.int64))], names=["anchor", "texts"])


def _entries(hot_shared, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", BLOCK_BYTES):
            ids, fps = block.column("doc_id").to_numpy(), block.column("fp").to_numpy()
            s = Segments(*text_buffer(block.column("text")), hot_shared.value)
            # each content once, for the smallest document (and each text of its id); the same document counts once
            by_id = np.lexsort((fps, ids))
            first = np.argsort(np.argsort(by_id)[s.doc], kind="stable") if (np.diff(by_id) < 0).any() else np.arange(len(s.doc))
            both = mix(s.anchor + s.content * U(0x9E3779B97F4A7C15))
            order = first[np.argsort(both[first], kind="stable")]
            both, doc = both[order], s.doc[order]
            head = np.ones(len(order), bool)
            head[1:] = both[1:] != both[:-1]
            top = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
            same = ids[doc] == ids[doc[top]]
            later = order[~same]
            head[1:] |= same[1:] & (fps[doc[1:]] != fps[doc[:-1]])
            mine = order[head & same]
            rows: list[tuple] = []
            later = np.sort(later)  # by document and ordinal
            for d, ordinals in _by_doc(s.doc[later], s.ordinal[later]):
                rows.append((int(ids[d]) % buckets, 0, int(ids[d]), int(fps[d]), _whole_runs(ordinals), None, None, None, None))
            mine = np.sort(mine)
            bucket = (s.anchor[mine] % U(buckets)).astype(np.int64)
            mine = mine[np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")]
            bucket = (s.anchor[mine] % U(buckets)).astype(np.int64)
            for k, part in _by_doc(bucket, mine):
                docs, counts = np.unique(s.doc[part], return_counts=True)
                table = np.stack([ids[docs], fps[docs]], axis=1).astype("<i8").tobytes()
                rows.append((k, 1, None, None, _pack(s.anchor[part]), s.content[part].astype("<u8").tobytes(), table, counts.astype("<u4").tobytes(), s.ordinal[part].astype("<u4").tobytes()))
            yield _batch(rows)

    return run


def _grouped(replies: list[tuple[int, int, int, bytes]], groups: int) -> pa.Table:
    """Replies (doc_id, fp, kind, bytes) as one row for each group of documents and kind."""
    by: dict[tuple[int, int], tuple[list, list]] = {}
    for doc, fp, kind, data in replies:
        table, payload = by.setdefault(((doc * 0x9E3779B1 >> 7) % groups, kind), ([], []))
        table += (doc, fp, len(data))
        payload.append(data)
    keys = list(by)
    return pa.table({
        "group_no": pa.array([k[0] for k in keys], pa.int64()), "kind": pa.array([k[1] for k in keys], pa.int32()),
        "docs": pa.array([np.array(by[k][0], "<i8").tobytes() for k in keys], pa.binary()), "payload": pa.array([b"".join(by[k][1]) for k in keys], pa.binary()),
    })


def _collected(table: pa.Table) -> pa.Table:
    """One row for each document and kind, from all rows of a group."""
    by: dict[tuple[int, int, int], list[bytes]] = {}
    for kind, docs, payload in zip(*[table.column(c).to_pylist() for c in ("kind", "docs", "payload")], strict=True):
        at = 0
        for doc, fp, size in np.frombuffer(docs, "<i8").reshape(-1, 3).tolist():
            by.setdefault((doc, fp, kind), []).append(payload[at : at + size])
            at += size
    return pa.Table.from_batches([_batch([(*k, b"".join(v)) for k, v in by.items()], ("doc_id", "fp", "kind", "reply"))])


def _shared(table: pa.Table, groups: int) -> pa.Table:
    """Replies of kind 0 (windows that are repeats) and requests, kind 1 (ordinals whose text must be merged)."""
    kind = table.column("kind").to_numpy()
    rows: list[tuple] = []
    for r in table.filter(pa.array(kind == 0)).select(["doc_id", "fp", "a"]).to_pylist():
        rows.append((r["doc_id"], r["fp"], 0, r["a"]))
    own = table.filter(pa.array(kind == 1))
    if own.num_rows:
        anchor, content = _unpack(own.column("a").to_pylist()), np.frombuffer(b"".join(own.column("b").to_pylist()), "<u8")
        docs = np.frombuffer(b"".join(own.column("c").to_pylist()), "<i8").reshape(-1, 2)
        owner = np.repeat(np.arange(len(docs)), np.frombuffer(b"".join(own.column("d").to_pylist()), "<u4"))
        ordinal = np.frombuffer(b"".join(own.column("e").to_pylist()), "<u4")
        ids = docs[:, 0][owner]
        text = docs[:, 1][owner]
        rank = np.empty(len(docs), np.int64)
        rank[np.lexsort((docs[:, 1], docs[:, 0]))] = np.arange(len(docs))
        order = np.argsort(rank[owner], kind="stable")
        order = order[np.lexsort((content[order], anchor[order]))]
        anchor, content, ids, text, owner, ordinal = anchor[order], content[order], ids[order], text[order], owner[order], ordinal[order]
        new_anchor = np.ones(len(anchor), bool)
        new_anchor[1:] = anchor[1:] != anchor[:-1]
        head = new_anchor.copy()
        head[1:] |= content[1:] != content[:-1]
        top = np.maximum.accumulate(np.where(head, np.arange(len(ids)), 0))
        repeat = ids != ids[top]
        at = np.flatnonzero(new_anchor)
        group = np.cumsum(new_anchor) - 1
        texts = np.add.reduceat(head.astype(np.int64), at)
        several = np.minimum.reduceat(ids, at) != np.maximum.reduceat(ids, at)
        each = head.copy()
        each[1:] |= text[1:] != text[:-1]
        ask = each & ~repeat & ((texts > 1) & several)[group]
        for k, chosen in ((0, repeat), (1, ask)):
            pick = np.flatnonzero(chosen)
            pick = pick[np.lexsort((ordinal[pick], owner[pick]))]
            for d, ordinals in _by_doc(owner[pick], ordinal[pick]):
                rows.append((int(docs[d, 0]), int(docs[d, 1]), k, _whole_runs(ordinals.astype(np.int64)) if k == 0 else ordinals.tobytes()))
    return _grouped(rows, groups)


def _cut_out(hot_shared, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", BLOCK_BYTES):
            ids, fps = block.column("doc_id").to_numpy(), block.column("fp").to_numpy()
            raw, at = text_buffer(block.column("text"))
            s = Segments(raw, at, hot_shared.value)
            wanted = [np.frombuffer(asked, "<u4").astype(np.int64) + s.heads[i] for i, asked in enumerate(block.column("asked").to_pylist())]
            pick = np.concatenate(wanted) if wanted else np.zeros(0, np.int64)
            bucket = (s.anchor[pick] % U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rows = []
            for k, part in _by_doc(bucket[order], pick[order]):
                size = s.windows[part] + LENGTH - 1
                where = np.repeat(s.first[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                table = np.stack([ids[s.doc[part]], fps[s.doc[part]], s.ordinal[part], size], axis=1).astype("<i8").tobytes()
                rows.append((k, 1, None, None, _pack(s.anchor[part]), raw[where].tobytes(), table, None, None))
            yield _batch(rows)

    return run


def _merged(table: pa.Table, groups: int) -> pa.Table:
    """Merges the segments of a bucket, whole anchors at a time, and replies which windows a smaller document holds."""
    rows: list[tuple] = []
    anchor = _unpack(table.column("a").to_pylist())
    raw = np.frombuffer(b"".join(table.column("b").to_pylist()), np.uint8)
    meta = np.frombuffer(b"".join(table.column("c").to_pylist()), "<i8").reshape(-1, 4)
    at = np.concatenate([[0], np.cumsum(meta[:, 3])])
    order = np.argsort(anchor, kind="stable")
    sizes = meta[order, 3]
    head = np.ones(len(order), bool)
    head[1:] = anchor[order][1:] != anchor[order][:-1]
    # rounds of whole anchors of about MERGE_BYTES, so that memory follows the round, not the bucket
    group = np.cumsum(head) - 1
    filled = np.cumsum(np.bincount(group, sizes)) if len(group) else np.zeros(0)
    turn = (filled // MERGE_BYTES).astype(np.int64)[group] if len(group) else np.zeros(0, np.int64)
    for _, part in _by_doc(turn, order):
        size = meta[part, 3]
        where = np.repeat(at[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        ends = np.concatenate([[0], np.cumsum(size)])
        found = intervals(raw[where], ends, LENGTH, max(1, int(ends[-1]) // SHARDS + 1))
        doc = np.repeat(meta[part, 0], size)
        window = np.flatnonzero(found >= 0)
        least = np.full(int(found.max(initial=0)) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, found[window], doc[window])
        repeat = window[least[found[window]] < doc[window]]
        owner = np.repeat(np.arange(len(part)), size)[repeat]
        cut = np.flatnonzero((np.diff(repeat) != 1) | (np.diff(owner) != 0))
        first, last = repeat[np.concatenate([[0], cut + 1])] if len(repeat) else repeat, repeat[np.concatenate([cut, [len(repeat) - 1]])] if len(repeat) else repeat
        seg = owner[np.concatenate([[0], cut + 1])] if len(repeat) else owner
        out = np.zeros(len(seg), MERGED)
        out["ordinal"], out["first"], out["last"] = meta[part, 2][seg], first - ends[seg], last - ends[seg]
        which = part[seg]
        by = np.lexsort((meta[which, 1], meta[which, 0]))
        keys = np.unique(meta[which][by][:, :2], axis=0, return_inverse=True) if len(by) else None
        if keys is not None:
            for d, got in _by_doc(keys[1].reshape(-1), out[by]):
                rows.append((int(keys[0][d, 0]), int(keys[0][d, 1]), 0, got.tobytes()))
    return _grouped(rows, groups)


def removed_bytes(segments: Segments, d: int, replies: list[bytes], size: int) -> np.ndarray:
    """Mask of the bytes of document d that its replies remove; a content that recurs in it is treated alike everywhere."""
    a, b = segments.heads[d], segments.heads[d + 1]
    first, windows = segments.first[a:b] - segments.at[d], segments.windows[a:b]
    key = np.stack([segments.anchor[a:b], segments.content[a:b]], axis=1)
    kind = np.unique(key, axis=0, return_inverse=True)[1].reshape(-1) if b > a else np.zeros(0, np.int64)
    got = np.concatenate([np.frombuffer(r, MERGED) for r in replies])
    steps = np.zeros(size + 2, np.int64)
    whole = got[got["first"] < 0]
    flags = np.zeros(len(first) + 1, np.int64)
    np.add.at(flags, whole["ordinal"].astype(np.int64), 1)
    np.add.at(flags, whole["last"].astype(np.int64) + 1, -1)
    named = np.zeros(kind.max(initial=-1) + 1, bool)
    named[kind[np.cumsum(flags)[:-1] > 0]] = True
    full = np.flatnonzero(named[kind])
    np.add.at(steps, first[full], 1)
    np.add.at(steps, first[full] + windows[full] + LENGTH - 1, -1)
    part = got[got["first"] >= 0]
    if len(part):
        order = np.argsort(kind, kind="stable")
        heads = np.searchsorted(kind[order], np.arange(len(named) + 1))
        of = kind[part["ordinal"].astype(np.int64)]
        times = heads[of + 1] - heads[of]
        where = order[np.repeat(heads[of] - (np.cumsum(times) - times), times) + np.arange(times.sum())]
        np.add.at(steps, first[where] + np.repeat(part["first"], times), 1)
        np.add.at(steps, first[where] + np.repeat(part["last"], times) + LENGTH, -1)
    return np.cumsum(steps[:size]) > 0


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,stop:long>>"


def _removed(hot_shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for block in blocks(batches, "text", BLOCK_BYTES):
            raw, at = text_buffer(block.column("text"))
            replies = block.column("replies").to_pylist()
            touched = [i for i, r in enumerate(replies) if r]
            few = np.concatenate([raw[at[i] : at[i + 1]] for i in touched]) if touched else np.zeros(0, np.uint8)
            s = Segments(few, np.concatenate([[0], np.cumsum([at[i + 1] - at[i] for i in touched])]).astype(np.int64), hot_shared.value)
            turn = {i: k for k, i in enumerate(touched)}
            cols: list[list] = [[], [], [], [], []]
            for i in range(block.num_rows):
                own = raw[at[i] : at[i + 1]]
                spans = []
                if i in turn:
                    mask = removed_bytes(s, turn[i], replies[i], len(own))
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                    spans = [{"start": a, "stop": b} for a, b in edge.reshape(-1, 2).tolist()]
                    kept = own[~mask]
                else:
                    kept = own
                for c, v in zip(cols, (len(own), len(own) - len(kept), len(spans), hashlib.sha256(kept.tobytes()).hexdigest(), spans), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), span)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (spans of bytes); one row per input row.

    Texts are UTF-8 bytes, null is empty. A byte goes if some LENGTH-byte string
    over it also starts in a document with a smaller id; all is judged on the
    input. Equal ids are not smaller than each other, so repeated rows lose
    nothing to themselves. A null id has no place in the order: the row keeps
    all its bytes and takes none from others. Texts under LENGTH bytes keep all.
    An empty table gives no rows. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("fp"), text.alias("text"))
    known = texts.filter("doc_id IS NOT NULL")
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(size * 2 / (LENGTH - GRAM + 2) // BUCKET_ENTRIES) + 1
    groups = int(size // BLOCK_BYTES) + 1
    sampled = known.filter(F.pmod(F.xxhash64("doc_id", "fp"), F.lit(HOT_SAMPLE)) == 0)
    varied = sampled.mapInArrow(_varied, "anchor long, texts long").groupBy("anchor").agg(F.sum("texts").alias("texts")).filter(F.col("texts") >= HOT_IN_ALL)
    hot = [r["anchor"] for r in varied.orderBy(F.desc("texts"), "anchor").limit(HOT_ANCHORS).collect()]
    hot_shared = docs.sparkSession.sparkContext.broadcast(np.sort(np.array(hot, np.int64).view(U)))
    entries = known.mapInArrow(_entries(hot_shared, buckets), ROW)

    def gathered(rows: DataFrame, kernel, name: str) -> DataFrame:
        """Replies by document. A bucket has a row for each group of documents, not for each document that it knows of."""
        packed = rows.groupBy("bucket").applyInArrow(lambda table: kernel(table, groups), PACKED)
        return materialise(packed.groupBy("group_no").applyInArrow(_collected, REPLY), name)

    replies = gathered(entries, _shared, "shared")
    asked = replies.filter("kind = 1").select("doc_id", "fp", F.col("reply").alias("asked"))
    wanted = asked.agg(F.sum(F.octet_length("asked"))).first()[0] or 0
    merges = int(wanted / 4 * (LENGTH + LENGTH // 4) // MERGE_BUCKET_BYTES) + 1
    # repeated rows with one text bring its segments as often: equal ones of one document, which change nothing
    once = known.join(asked.hint("shuffle_hash"), ["doc_id", "fp"])
    cut = once.select("doc_id", "fp", "text", "asked").mapInArrow(_cut_out(hot_shared, merges), ROW)
    merged = gathered(cut, _merged, "merged")

    every = replies.filter("kind = 0").unionByName(merged).groupBy("doc_id", "fp").agg(F.collect_list("reply").alias("replies"))
    joined = texts.join(every.hint("shuffle_hash"), ["doc_id", "fp"], "left")
    return joined.select("doc_id", "text", "replies").mapInArrow(_removed(hot_shared), OUT)


def op1_query(spark, sf_dir):
    from platen.llm.common import read

    return suffix_dedup(read(spark, sf_dir, "documents")).drop("removed")
