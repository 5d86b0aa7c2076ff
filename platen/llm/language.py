"""Language identification by word-first backoff.

A word that the model knows is scored by its log frequency per language; an
unseen word falls back to character n-grams, the longest length first, and each
shorter length stands in only where no n-gram of the longer one is known.

The model knows every word and n-gram of the labelled documents it is fitted to,
about TRAIN_DOCS, a like number of each language; every label is a language of
it. Words and n-grams are looked up by 64-bit hashes, many at a time: a block of
texts is one array of code points, and each distinct word of it is scored once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platen.llm.common import U, blocks, mix, word_hashes

#: About so many labelled documents are learnt from, chosen by a hash of their id.
TRAIN_DOCS = 20_000
LENGTHS = (4, 3, 2, 1)
BLOCK_BYTES = 4 << 20
#: Code points that are scored at once; a word longer than this counts as several.
RUN = 1 << 20
#: Words whose n-grams are counted at once.
FITTED = 50_000
#: Most words one worker counts before it hands its counts on.
COUNT_WORDS = 400_000
_WORD = re.compile(r"[^\W\d_]+")
#: The column that is scored, beside those kept.
HIDDEN = "__platen_text"
COUNTS = "lang string, item string, c long"
_STEP = [U(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(max(LENGTHS) + 1)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words by language."""
    words: dict[str, Counter] = {}

    def flushed() -> pa.RecordBatch:
        rows = [(lang, item, c) for lang, counter in words.items() for item, c in counter.items()]
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "item", "c"])

    for block in blocks(batches, "text", BLOCK_BYTES):
        for lang, text in zip(block.column("lang").to_pylist(), block.column("text").to_pylist(), strict=True):
            if found := _WORD.findall((text or "").lower()):
                words.setdefault(lang, Counter()).update(found)
        if sum(map(len, words.values())) > COUNT_WORDS:
            yield flushed()
            words = {}
    if words:
        yield flushed()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Which code points are letters: alphanumeric, but no decimal digits, as in the pattern of words."""
    return np.array([chr(c).isalnum() and not chr(c).isdecimal() for c in range(0x110000)])


def ngrams(points: np.ndarray, s: np.ndarray, e: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of the words points[s:e], each between two spaces, and the word of each."""
    size = e - s + 2
    begin = np.cumsum(size) - size
    padded = np.full(int(size.sum()), 32, np.uint32)
    inside = np.ones(len(padded), bool)
    inside[begin] = inside[begin + size - 1] = False
    padded[inside] = points[np.repeat(s - (np.cumsum(size - 2) - (size - 2)), size - 2) + np.arange(int((size - 2).sum()))]
    count = np.maximum(size - n + 1, 0)
    word = np.repeat(np.arange(len(s)), count)
    at = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    h = np.full(len(at), U(n))
    for k in range(n):
        h += (padded[at + k].astype(U) + U(1)) * _STEP[k]
    return mix(h), word


class Table:
    """Centred log frequencies per language of items, by their sorted hashes."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        v = np.log(counts + 0.5) - np.log(counts.sum(axis=0) + 0.5 * len(counts))
        self.keys, self.values = keys, (v - v.mean(axis=1, keepdims=True)).astype(np.float32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each key stands, and whether it is known."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys


class Model:
    def __init__(self, langs: list[str], words: Table | None = None, grams: dict[int, Table] | None = None):
        self.langs, self.words, self.grams = langs, words, grams or {}

    @classmethod
    def fitted(cls, langs: list[str], words: list[str], word: np.ndarray, lang: np.ndarray, c: np.ndarray) -> Model:
        """From counts c of word numbers and language numbers."""
        points = code_points("".join(words))
        size = np.array([len(w) for w in words], np.int64)
        e = np.cumsum(size)
        s = e - size
        counts = np.zeros((len(words), len(langs)))
        np.add.at(counts, (word, lang), c)
        keys, first = np.unique(word_hashes(points, s, e), return_index=True)
        grams = {}
        for n in LENGTHS:
            parts = []
            for at in range(0, len(words), FITTED):
                part = slice(at, at + FITTED)
                h, of = ngrams(points, s[part], e[part], n)
                gram, which = np.unique(h, return_inverse=True)
                of, which = of + at, which.reshape(-1)
                parts.append((gram, np.stack([np.bincount(which, counts[of, k], minlength=len(gram)) for k in range(len(langs))], axis=1)))
            gram, which = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            if len(gram):
                total = np.zeros((len(gram), len(langs)))
                np.add.at(total, which.reshape(-1), np.concatenate([c for _, c in parts]))
                grams[n] = Table(gram, total)
        return cls(langs, Table(keys, counts[first]), grams)

    def scores(self, keys: np.ndarray, points: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Centred log likelihoods by language of words points[s:e] with these hashes; an unseen one gets those of its n-grams of the longest length that knows any, over the root of their number."""
        at, known = self.words.find(keys)
        out = np.where(known[:, None], self.words.values[at], np.float32(0))
        left = np.flatnonzero(~known)
        for n in LENGTHS:
            if n not in self.grams or not len(left):
                continue
            h, of = ngrams(points, s[left], e[left], n)
            at, hit = self.grams[n].find(h)
            number = np.bincount(of[hit], minlength=len(left))
            some = number > 0
            for k in range(len(self.langs)):
                total = np.bincount(of[hit], self.grams[n].values[at[hit], k], minlength=len(left))
                out[left[some], k] = total[some] / np.sqrt(number[some])
            left = left[~some]
        return out


def quota(sizes: list[int], total: int) -> float:
    """The most rows to take of each group, so that about total are taken of all."""
    left = float(total)
    for i, size in enumerate(sorted(sizes)):
        level = left / (len(sizes) - i)
        if size > level:
            return level
        left -= size
    return math.inf


def train(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", train_docs: int = TRAIN_DOCS) -> Model:
    """Fits a model to rows whose language is not null. No labelled row: a model without languages, which answers und."""
    rows = labelled.select(F.col(id_col).cast("string").alias("i"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    per_lang = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(per_lang)
    if not langs:
        return Model([])
    most_rows = quota(list(per_lang.values()), train_docs)
    if most_rows < math.inf:
        below = F.create_map(*[F.lit(x) for lang, c in per_lang.items() for x in (lang, min(1_000_003, math.ceil(1_000_003 * most_rows / c)))])
        rows = rows.filter(F.pmod(F.xxhash64(F.coalesce("i", F.lit(""))), F.lit(1_000_003)) < below[F.col("lang")])
    counts = rows.select("lang", "text").mapInArrow(_counted, COUNTS).groupBy("lang", "item").agg(F.sum("c").alias("c")).toArrow()
    if not counts.num_rows:
        return Model(langs)
    number = {lang: i for i, lang in enumerate(langs)}
    item = counts.column("item").combine_chunks().dictionary_encode()
    item = item.combine_chunks() if isinstance(item, pa.ChunkedArray) else item
    return Model.fitted(langs, item.dictionary.to_pylist(), np.asarray(item.indices), np.array([number[x] for x in counts.column("lang").to_pylist()]), np.asarray(counts.column("c")).astype(float))


def _runs(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Texts in lower case, put together and cut into runs of about RUN signs, after a sign that is no letter where there is one."""
    owners, parts, size = [], [], 0
    for i, text in enumerate(texts):
        text, at = (text or "").lower(), 0
        while at < len(text):
            stop = min(len(text), at + RUN - size)
            if stop < len(text):
                back = next((k for k in range(stop, max(at, stop - 4096), -1) if not _WORD.match(text[k - 1])), None)
                stop = back or stop
            owners.append(i)
            parts.append(text[at:stop])
            size += stop - at
            at = stop
            if size >= RUN - 4096:
                yield owners, parts
                owners, parts, size = [], [], 0
    if parts:
        yield owners, parts


def _totals(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the scores of each text's words by language, and their number."""
    total, words = np.zeros((len(texts), len(model.langs))), np.zeros(len(texts), np.int64)
    for owners, parts in _runs(texts):
        points = code_points(" ".join(parts))
        inside = np.zeros(len(points) + 2, bool)
        inside[1:-1] = letters()[points]
        s, e = np.flatnonzero(inside[1:-1] & ~inside[:-2]), np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
        if not len(s):
            continue
        part = np.searchsorted(np.cumsum([len(x) + 1 for x in parts]), s, side="right")
        owner = np.array(owners)[part]
        words += np.bincount(owner, minlength=len(texts))
        if model.words is None:
            continue
        keys, first, which = np.unique(word_hashes(points, s, e), return_index=True, return_inverse=True)
        scores = model.scores(keys, points, s[first], e[first])
        which = which.reshape(-1)
        for k in range(len(model.langs)):
            total[:, k] += np.bincount(owner, scores[which, k], minlength=len(texts))
    return total, words


def _predicted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for block in blocks(batches, HIDDEN, BLOCK_BYTES):
            total, words = _totals(model, block.column(HIDDEN).to_pylist())
            langs: list[str] = ["und"] * block.num_rows
            scores = np.zeros(block.num_rows)
            if model.langs:
                total /= np.sqrt(np.maximum(words, 1))[:, None]  # words of a text are not independent
                odds = np.exp(total - total.max(axis=1, keepdims=True))
                best = odds.argmax(axis=1)
                scores = np.where(words > 0, odds[np.arange(len(odds)), best] / odds.sum(axis=1), 0.0)
                langs = [model.langs[b] if w else "und" for b, w in zip(best.tolist(), words.tolist(), strict=True)]
            keep = [c for c in block.schema.names if c != HIDDEN]
            yield pa.RecordBatch.from_arrays([*map(block.column, keep), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns keep of every row, with lang_pred and score (0 to 1).

    Null texts and texts without letters get und and 0.0. The whole text counts.
    Ties go to the language that sorts first. An empty table gives no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col(text_col).cast("string").alias(HIDDEN))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != HIDDEN)
    return rows.mapInArrow(_predicted(shared), f"{schema}, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    """True for the fifth of documents that is never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5, F.lit(0)) == 0


def op3_query(spark, sf_dir):
    from platen.llm.common import read

    docs = read(spark, sf_dir, "documents").withColumn("held_out", held_out())
    model = train(docs.filter(~F.col("held_out")))
    return identify(docs, model, ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score")
