"""Packing documents into fixed token sequences: first-fit decreasing with a tournament tree.

A document's ids are cut into full sequences and one remainder. Remainders are
packed by first-fit decreasing, independently in groups drawn at random (by a
hash), so every task holds one bounded group. The tree keeps the free capacity
of every open bin and the larger of each two children: the first bin that fits
is found by walking down, in logarithmic time.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platen.llm.common import U, blocks, materialise, word_hashes

SEQUENCE = 1024
GROUP_DOCS = 4096
#: Largest number of text units whose ids a worker remembers.
CACHE_UNITS = 2_500_000
LONGEST = 128
#: Sets the first unit of a text, which has no space before it, apart.
HEAD = U(0xA5A5A5A55A5A5A5A)
#: New units that are encoded as one text.
JOINED = 500
BLOCK_BYTES = 2 << 20
#: A space after white space and before white space or the end: there a text must not be cut.
_RUN = re.compile(r"\s \s|\s \Z")

PIECES = "doc_id long, doc_tokens long, crcs array<long>"
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Ids of whole texts. Most texts are cut before single spaces, where no token can cross, and ids of such units are remembered.

    Units are told apart by 64-bit hashes, many at a time; those over LONGEST
    bytes are not remembered. New ones are joined to short texts, which the
    tokenizer encodes in a batch without offsets, and are cut again by their
    tokens' bytes.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.token_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():  # a sign of the byte alphabet stands for one byte
            self.token_bytes[i] = len(token)
        self._clear()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _clear(self) -> None:
        #: Sorted hashes of units and their numbers; ids of unit i are ids[ends[i]:ends[i + 1]].
        self.keys, self.numbers = np.zeros(0, U), np.zeros(0, np.int64)
        self.count = 0
        self.ids = np.zeros(1 << 20, np.uint32)
        self.ends = np.zeros(1 << 16, np.int64)

    def _add(self, ids: list[list[int]] | None, flat: np.ndarray | None = None, ends: np.ndarray | None = None) -> None:
        """Appends units: lists of ids, or ids one after another with their ends."""
        if ids is not None:
            flat, ends = np.array(list(chain.from_iterable(ids)), np.int64), np.cumsum([len(x) for x in ids])
        begin, n = int(self.ends[self.count]), len(ends)
        while begin + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        while self.count + n >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(len(self.ends), np.int64)])
        self.ids[begin : begin + len(flat)] = flat
        self.ends[self.count + 1 : self.count + 1 + n] = begin + ends
        self.count += n

    def _learn(self, units: list[str], heads: np.ndarray) -> np.ndarray:
        """Numbers of new units. Those that follow a space are joined, where both ends are plain."""
        out = np.empty(len(units), np.int64)
        plain, single = [], []
        for i, (w, head) in enumerate(zip(units, heads.tolist(), strict=True)):
            (plain if w and not head and not w[0].isspace() and not w[-1].isspace() and "<|" not in w else single).append(i)
        for at in range(0, len(plain), 8192):
            part = [units[i] for i in plain[at : at + 8192]]
            joined = self._ids([" " + " ".join(part[k : k + JOINED]) for k in range(0, len(part), JOINED)])
            ids = np.array(list(chain.from_iterable(joined)), np.int64)
            sizes = np.array([len(w) if w.isascii() else len(w.encode()) for w in part])
            out[plain[at : at + 8192]] = self.count + np.arange(len(part))
            self._add(None, ids, np.searchsorted(np.cumsum(self.token_bytes[ids]), np.cumsum(sizes + 1)) + 1)
        if single:
            out[single] = self.count + np.arange(len(single))
            self._add(self._ids([units[i] if heads[i] else " " + units[i] for i in single]))
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; new units of all of them are learnt together."""
        if self.count > CACHE_UNITS:
            self._clear()
        whole = [bool(_RUN.search(text)) for text in texts]
        coded = [text.encode() for text, w in zip(texts, whole, strict=True) if not w]
        out = [np.asarray(x, np.uint32) for x in self._ids([text for text, w in zip(texts, whole, strict=True) if w])]
        raw, sizes = b"".join(coded), np.array([len(c) for c in coded], np.int64)
        cut = iter(self._cut(raw, sizes))
        alone = iter(out)
        return [next(alone) if w else next(cut) for w in whole]

    def _cut(self, raw: bytes, sizes: np.ndarray) -> list[np.ndarray]:
        if not len(sizes):
            return []
        data, stops = np.frombuffer(raw, np.uint8), np.cumsum(sizes)
        spaces = np.flatnonzero(data == 32)
        s = np.concatenate([stops - sizes, spaces + 1])
        e = np.concatenate([stops, spaces])
        text = np.concatenate([np.arange(len(sizes)), np.searchsorted(stops, spaces, side="right")])
        head = np.arange(len(s)) < len(sizes)
        # a unit ends at the next space or its text's end; empty texts share a place with their neighbours, so order by text too
        order = np.lexsort((s, text))
        s, text, head = s[order], text[order], head[order]
        e = e[np.lexsort((e, text[np.argsort(order)]))]
        key = word_hashes(data, s, e)
        key[head] ^= HEAD
        key, first, which = np.unique(key, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        known = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
        number = np.empty(len(key), np.int64)
        number[known] = self.numbers[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            begin, stop = s[first[new]], e[first[new]]
            number[new] = self._learn([raw[a:b].decode() for a, b in zip(begin.tolist(), stop.tolist(), strict=True)], head[first[new]])
            short = new[stop - begin <= LONGEST]
            where = np.searchsorted(self.keys, key[short])
            self.keys, self.numbers = np.insert(self.keys, where, key[short]), np.insert(self.numbers, where, number[short])
        unit = number[which.reshape(-1)]
        begin = self.ends[unit]
        count = self.ends[unit + 1] - begin
        stop = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.repeat(begin - stop[:-1], count) + np.arange(stop[-1])]
        ends = stop[np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(sizes)))])]
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


_encoders: dict[str, Encoder] = {}


def _tokenised(path: str, sequence: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        encoder = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
        for block in blocks(batches, "text", BLOCK_BYTES):
            ids, tokens, crcs = [], [], []
            texts = [text or "" for text in block.column("text").to_pylist()]
            for doc, got in zip(block.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                got = np.append(got, np.uint32(0)).astype("<u4")
                ids.append(doc)
                tokens.append(len(got))
                crcs.append([zlib.crc32(got[at : at + sequence].tobytes()) for at in range(0, len(got), sequence)])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tokens, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], names=["doc_id", "doc_tokens", "crcs"])

    return run


class Tournament:
    """Free capacities of bins 0 to n - 1; first(size) is the first bin with that much room, or the next new one."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1
        while self.leaves < bins:
            self.leaves *= 2
        self.tree = [capacity] * (2 * self.leaves)

    def first(self, size: int) -> int:
        tree, node = self.tree, 1
        while node < self.leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        return node - self.leaves

    def take(self, leaf: int, size: int) -> int:
        """Room that was free before."""
        tree, node = self.tree, leaf + self.leaves
        free = tree[node]
        tree[node] = free - size
        node //= 2
        while node:
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
            node //= 2
        return free


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; sizes lie between 1 and capacity. Ties keep their order."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    tree = Tournament(max(1, len(sizes)), capacity)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        bins[i] = leaf = tree.first(size)
        offsets[i] = capacity - tree.take(leaf, size)
    return bins, offsets


def _packed(sequence: int):
    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "copy"], kind="stable", na_position="last")
        tokens = group["doc_tokens"].to_numpy(np.int64)
        count = -(-tokens // sequence)
        rest = tokens - (count - 1) * sequence
        bins, offsets = first_fit_decreasing(rest, sequence)
        row = np.repeat(np.arange(len(group)), count)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        last = nth == count[row] - 1
        full = np.cumsum(~last) - 1 + (bins.max() + 1 if len(bins) else 0)
        return pd.DataFrame(
            {
                "doc_id": group["doc_id"].to_numpy()[row],
                "start": nth * sequence,
                "length": np.where(last, rest[row], sequence),
                "ids_crc32": np.concatenate([np.asarray(x, np.int64) for x in group["crcs"]]) if len(group) else np.zeros(0, np.int64),
                "doc_tokens": tokens[row],
                "sequence_id": (int(key[0]) << 40) + np.where(last, bins[row], full),
                "offset": np.where(last, offsets[row], 0),
            }
        ).astype({"doc_id": "Int64"})

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, group_docs: int = GROUP_DOCS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are one end mark, id 0. Fully repeated rows are packed
    once each; they are numbered after a map-side count, so even one document
    that makes up most rows is spread over all groups. Ids may be null. An empty
    table gives no pieces. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tokens = rows.mapInArrow(_tokenised(tokenizer_path, sequence), PIECES)
    tokens = materialise(tokens, "tokens")
    same = tokens.groupBy("doc_id", "doc_tokens", "crcs").count()
    each = same.select("doc_id", "doc_tokens", "crcs", F.explode(F.sequence(F.lit(1).cast("long"), "count")).alias("copy"))
    groups = max(1, -(-tokens.count() // group_docs))
    each = each.withColumn("group_no", F.pmod(F.xxhash64("doc_id", "doc_tokens", "copy"), F.lit(groups)))
    return each.groupBy("group_no").applyInPandas(_packed(sequence), PLACED)


def op8_query(spark, sf_dir):
    import public_tokenizers

    from platen.llm.common import read

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
