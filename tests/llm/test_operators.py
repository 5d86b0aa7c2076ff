import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from platen.llm import queries
from platen.llm.exact_dedup import exact_dedup
from platen.llm.jaccard_join import Region, jaccard_components, jaccard_links
from platen.llm.language import held_out, identify, quota, train
from platen.llm.licenses import TEMPLATES, bigrams, probes, scan_license_windows, scan_licenses, windows_of
from platen.llm.mixing import mix_sources
from platen.llm.packing import Encoder, first_fit_decreasing, pack
from platen.llm.suffix_dedup import suffix_dedup
from platen.llm.topk import top_k, usable

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.execute(queries.SQL[name]).fetchdf(), queries.QUERIES[name](spark, SF).toPandas()
    frame = lambda d: d[sorted(d.columns)].astype(str).sort_values(sorted(d.columns)).reset_index(drop=True)
    assert frame(got).equals(frame(want))


# exact dedup


def test_exact_dedup(table, odd_rows):
    got = exact_dedup(table(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    by = {}
    for r in got:
        by.setdefault(r["text_sha256"], []).append(r)
    for sha, group in by.items():
        assert sum(r["kept"] for r in group) == 1 and {r["group_size"] for r in group} == {len(group)}
    blank = by[hashlib.sha256(b"").hexdigest()]
    assert {r["doc_id"] for r in blank} == {2, 3, 4} and {r["keep_id"] for r in blank} == {4}  # most code points
    assert {r["keep_id"] for r in by[hashlib.sha256(odd_rows[0][1].replace(" ", "").encode()).hexdigest()]} == {1}


def test_exact_dedup_without_broadcasts(table, odd_rows, monkeypatch):
    from platen.llm import exact_dedup as E

    want = sorted(map(str, exact_dedup(table(odd_rows)).collect()))
    monkeypatch.setattr(E, "BROADCAST_ROWS", 0)
    assert sorted(map(str, exact_dedup(table(odd_rows)).collect())) == want


@pytest.mark.parametrize("op", [exact_dedup, jaccard_components, suffix_dedup, mix_sources, scan_licenses, lambda d: pack(d, _tok()), lambda d: mask(d)])
def test_empty_tables(table, op):
    assert op(table([])).count() == 0


def mask(d):
    from platen.llm.pseudonyms import mask_private

    return mask_private(d)


def _tok():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# suffix dedup


def brute_suffix(rows):
    first, out = {}, []
    for doc, text in sorted(((d, t) for d, t in rows if d is not None), key=lambda r: r[0]):
        b = (text or "").encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], doc)
    for doc, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b) + 1)
        for k in range(len(b) - 49):
            if doc is not None and first[b[k : k + 50]] < doc:
                gone[k : k + 50] = b"\1" * 50
        keep = bytes(c for c, g in zip(b, gone) if not g)
        out.append((doc, len(b), len(b) - len(keep), sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1])), hashlib.sha256(keep).hexdigest()))
    return out


def key(r):
    return tuple((x is not None, x) for x in r)


def test_suffix_dedup(table, odd_rows):
    base = odd_rows[0][1]
    more = [(20, "aa " * 100), (21, "x " + "aa " * 60), (22, base[:49]), (23, base[10:62] + "###" + base[20:71]), (24, "Zürich äöü " * 9), (25, "y" + "Zürich äöü " * 9), (26, base[10:62]), (30, "abc" + odd_rows[5][1][5:60])]
    rows = [(r[0], r[1]) for r in odd_rows] + more
    got = suffix_dedup(table(rows)).drop("removed").collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute_suffix(rows), key=key)


def test_suffix_dedup_hot_anchors_and_repeated_ids(table, monkeypatch):
    from platen.llm import suffix_dedup as S

    monkeypatch.setattr(S, "HOT_SAMPLE", 1)
    monkeypatch.setattr(S, "HOT_IN_ALL", 6)
    rng = np.random.default_rng(6)
    phrase = "all rights are reserved by the owners of this page, see there"
    word = lambda: "".join(rng.choice(list("abcdefgh"), 12))
    rows = [(i, f"{word()} {phrase} {word()} {word()}") for i in range(80)] + [(i, f"{'xyz'[i % 3] * 9} {phrase} {'uv'[i % 2] * 30}") for i in range(80, 110)]
    rows += [(7, rows[3][1]), (7, "z" * 60 + rows[90][1]), (200, "ab" * 80), (201, "ab" * 70), (202, "ba" * 40)]
    hot = [r["anchor"] for r in table(rows).select("text").mapInArrow(S._varied, "anchor long, texts long").collect()]
    assert hot
    got = suffix_dedup(table(rows)).drop("removed").collect()
    assert sorted(map(tuple, got)) == sorted(brute_suffix(rows))


def test_suffix_dedup_random(table):
    rng = np.random.default_rng(4)
    parts = ["".join(rng.choice(list("abcd "), 70)) for _ in range(6)]
    rows = []
    for i in range(60):
        t = "".join(parts[k][rng.integers(0, 15) : rng.integers(55, 70)] for k in rng.integers(0, 6, 3))
        if rng.random() < 0.5:
            k = int(rng.integers(len(t)))
            t = t[:k] + "#" + t[k + 1 :]
        rows.append((i, t))
    got = suffix_dedup(table(rows)).drop("removed").collect()
    assert sorted(map(tuple, got)) == sorted(brute_suffix(rows))


# language


def test_language(spark, table, odd_rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("held_out", held_out())
    model = train(docs.filter("NOT held_out"))
    got = identify(docs, model, ["doc_id", "held_out", "lang"]).filter("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) == r["held_out"] for r in got)
    odd = identify(table(odd_rows), model, ["doc_id"]).collect()
    assert {r["doc_id"] for r in odd if r["lang_pred"] == "und"} == {2, 3, 4, 9} and all(0 <= r["score"] <= 1 for r in odd)
    assert {r["lang_pred"] for r in identify(table(odd_rows), train(table([])), ["doc_id"]).collect()} == {"und"}


class PlainModel:
    """Words and n-grams in dictionaries, one word at a time."""

    def __init__(self, rows):
        self.langs = sorted({lang for _, lang in rows})
        counts = {n: {} for n in (0, 4, 3, 2, 1)}
        for text, lang in rows:
            for word in re.findall(r"[^\W\d_]+", text.lower()):
                for n in counts:
                    p = word if n == 0 else f" {word} "
                    for item in [p] if n == 0 else [p[i : i + n] for i in range(len(p) - n + 1)]:
                        counts[n].setdefault(item, dict.fromkeys(self.langs, 0))[lang] += 1
        self.tables = {}
        for n, table in counts.items():
            sums = {x: sum(c[x] for c in table.values()) + 0.5 * len(table) for x in self.langs}
            logs = {item: [np.log(c[x] + 0.5) - np.log(sums[x]) for x in self.langs] for item, c in table.items()}
            self.tables[n] = {item: np.array(v) - np.mean(v) for item, v in logs.items()}

    def word(self, word):
        if word in self.tables[0]:
            return self.tables[0][word]
        p = f" {word} "
        for n in (4, 3, 2, 1):
            found = [self.tables[n][p[i : i + n]] for i in range(len(p) - n + 1) if p[i : i + n] in self.tables[n]]
            if found:
                return np.sum(found, axis=0) / np.sqrt(len(found))
        return np.zeros(len(self.langs))

    def predict(self, text):
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        if not words:
            return "und", 0.0
        total = sum(map(self.word, words)) / np.sqrt(len(words))
        odds = np.exp(total - total.max())
        return self.langs[int(odds.argmax())], odds.max() / odds.sum()


def test_language_equals_plain_scorer(spark, table, odd_rows, monkeypatch):
    from platen.llm import language as L

    rows = [(r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect() if r["text"] and r["lang"]]
    plain = PlainModel(rows)
    model = train(table([(i, *r) for i, r in enumerate(rows)]))
    texts = [r[1] for r in odd_rows] + ["Straße über İstanbul 中文 x1y2 _a_ qqqqzzz", "zzzz", "ﬁne ǅ", "\ud7ff \U0001f600 ok", *[t[::-1] for t, _ in rows[:20]], *[t for t, _ in rows[:5]]]
    for run in (L.RUN, 300):
        monkeypatch.setattr(L, "RUN", 4096 + run if run == 300 else run)
        total, words = L._totals(model, texts)
        for t, sums, n in zip(texts, total, words, strict=True):
            want, score = plain.predict(t)
            odds = np.exp(sums / np.sqrt(max(1, n)) - (sums / np.sqrt(max(1, n))).max())
            assert n == len(re.findall(r"[^\W\d_]+", (t or "").lower()))
            if n:
                assert abs(odds.max() / odds.sum() - score) < 1e-4 and (model.langs[int(odds.argmax())] == want or score < 0.51)
    got = identify(table([(i, t) for i, t in enumerate(texts)]), model, ["doc_id"]).collect()
    assert [(r["lang_pred"], round(r["score"], 3)) for r in sorted(got, key=lambda r: r["doc_id"])] == [(a, round(b, 3)) for a, b in map(plain.predict, texts)]
    assert identify(table([]), model, ["doc_id"]).count() == 0


def test_rare_languages(table):
    word = lambda lang, k: "".join(chr(0x4E00 + 40 * lang + (7 * k + j) % 40) for j in range(3))
    text = lambda lang, seed: " ".join(word(lang, (seed * 5 + j) % 40) for j in range(12))
    hot = [(i, " ".join(f"{'abcdefghij'[(i + j) % 10]}{'klmnopqrst'[i % 10]}" for j in range(20)), "hot") for i in range(4000)]
    rare = [(10_000 + 10 * lang + k, text(lang, k), f"l{lang:02d}") for lang in range(70) for k in range(3)]
    model = train(table(hot + rare), train_docs=400)
    assert model.langs == sorted({r[2] for r in hot + rare})
    got = identify(table([(lang, text(lang, 5), f"l{lang:02d}") for lang in range(70)]), model, ["doc_id", "lang"]).collect()
    assert len(got) == 70 and all(r["lang"] == r["lang_pred"] for r in got)
    assert quota([3, 3, 100], 26) == 20 and quota([3, 3, 100], 106) == float("inf")


# Jaccard


def brute_components(rows):
    sets = {}
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                i = len(sets[a] & sets[b])
                if i and 100 * i >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return {d: (len(s), root[d]) for d, s in sets.items()}


def test_jaccard(table, odd_rows):
    rng = np.random.default_rng(8)
    bases = [[f"w{x}" for x in rng.integers(0, 5000, n)] for n in (30, 60, 90)]
    rows = [(r[0], r[1]) for r in odd_rows if r[0] not in (None, 6, 7)]
    for i in range(100, 220):
        w = list(bases[int(rng.integers(3))])
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(len(w)))] = f"z{rng.integers(9)}"
        rows.append((i, " ".join(w[: len(w) - int(rng.integers(0, 8))])))
    want = brute_components(rows)
    got = jaccard_components(table(rows)).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_jaccard_nulls(table, odd_rows):
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard_components(table(odd_rows)).collect()}
    assert got[None, 14] is None and got[2, 0] == 2 and got[7, 29996] == 6


def test_cut_regions_equal_brute_force(table, monkeypatch):
    from platen.llm import jaccard_join as J

    monkeypatch.setattr(J, "CHUNK", 8)
    rng = np.random.default_rng(9)
    base = [f"w{x}" for x in range(40)]
    rows = []
    for i in range(80):
        w = list(base)
        for _ in range(int(rng.integers(0, 3))):
            w[int(rng.integers(len(w)))] = f"z{rng.integers(99)}"
        rows.append((i, " ".join(w)))
    got = jaccard_components(table(rows)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows)
    pairs, members = (x.collect() for x in jaccard_links(table(rows)))
    assert sorted((r["class_a"], r["class_b"]) for r in pairs) == brute_links(rows)
    assert len(members) == len(rows)


def brute_links(rows):
    sets = {}
    for doc, text in rows:
        w = text.split()
        sets.setdefault(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)), doc)
    linked = lambda x, y: 5 * len(x & y) >= 4 * len(x | y)
    return sorted((a, b) for x, a in sets.items() for y, b in sets.items() if a < b and linked(x, y))


def test_repeated_ids_with_other_texts(table):
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, one), (1, two), (1, two), (2, one + " z"), (3, two + " z"), (4, "c d e")]
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(table(rows)).collect()}
    assert got == {(1, 36, 1), (2, 37, 1), (3, 37, 1), (4, 1, 4)}


def test_long_words(monkeypatch):
    from platen.llm import common
    from platen.llm import jaccard_join as J

    text = " ".join(["x" * 50, "y" * 7, "z", "Q" * 200, "y" * 8, "ü" * 30, "w"] * 3).encode()
    raw, at = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    want = J.shingle_sets(raw, at)[0]
    monkeypatch.setattr(common, "SPAN", 16)
    assert J.shingle_sets(raw, at)[0].tolist() == want.tolist()


def test_region_recursion():
    rng = np.random.default_rng(5)
    splits = 0
    for _ in range(40):
        bases = [np.unique(rng.integers(0, 10**6, rng.integers(5, 80)).astype(np.uint64)) for _ in range(4)]
        sets = []
        for _ in range(int(rng.integers(2, 80))):
            b = bases[int(rng.integers(4))]
            sets.append(np.unique(np.concatenate([b[rng.random(len(b)) > rng.random() * 0.2], rng.integers(0, 10**6, rng.integers(1, 8)).astype(np.uint64)])))
        sets.sort(key=len)
        r = Region(sets)
        r.join(np.arange(len(sets)))
        root = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                n = len(np.intersect1d(sets[i], sets[j]))
                if 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n) and root[i] != root[j]:
                    low, high = min(root[i], root[j]), max(root[i], root[j])
                    root = [low if x == high else x for x in root]
        assert [r.find(i) for i in range(len(sets))] == root
        splits += r.splits
        whole = Region(sets, every=True)
        whole.join(np.arange(len(sets)))
        assert whole.links == {(j, i) for i in range(len(sets)) for j in range(i) for n in [len(np.intersect1d(sets[i], sets[j]))] if 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n)}
    assert splits > 20


# top k


def test_top_k_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (100, [2.0, 1.0]), (100, [2.0, 1.0]), (1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (None, [1.0, 1.0]), (4, []), (5, [3.0]), (6, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [float("inf"), 0.0])]
    v = usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = top_k(v, v.filter("vec_id % 100 = 0"), k=4).collect()
    mine = [(r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 0]
    m = 1024 * 1024
    assert mine == [(1, 6, 5 * m), (2, 7, 5 * m), (3, 100, 4 * m), (4, 100, 4 * m)]
    assert top_k(v.filter("vec_id < 0"), v.filter("vec_id = 0")).count() == 0


def test_top_k_blocks(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(700, 8)), np.ones((300, 8))])
    df = usable(spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>"))
    got = top_k(df, df.filter("vec_id % 100 = 0"), block_rows=150).collect()
    q = np.floor(1024 * x).astype(np.int64)
    for i in range(0, 1000, 100):
        s = q @ q[i]
        want = sorted([(-s[j], j) for j in range(1000) if j != i])[:10]
        assert [(-r["score"], r["vec_id"]) for r in sorted((r for r in got if r["query_id"] == i), key=lambda r: r["rank"])] == want


@pytest.mark.parametrize("scale", [1.0, 7e4, 3e6, 1e9, 1e130])
def test_top_k_of_large_components(spark, scale):
    rng = np.random.default_rng(3)
    x = np.concatenate([np.array([[70_000.0, 0], [80_000.0, 1], [90_000.0, 2]]), rng.normal(size=(400, 2)) * scale])
    df = usable(spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>"))
    got = top_k(df, df.filter("vec_id % 100 = 0"), k=3, block_rows=150).collect()
    q = [[int(np.floor(1024 * a)) if abs(a) < 1e100 else 1024 * int(a) for a in r.tolist()] for r in x]
    bound = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    for i in range(0, len(x), 100):
        want = sorted((-bound(sum(a * b for a, b in zip(q[i], q[j]))), j) for j in range(len(x)) if j != i)[:3]
        mine = [(-r["score"], r["vec_id"]) for r in sorted((r for r in got if r["query_id"] == i), key=lambda r: r["rank"])]
        assert [s for s, _ in mine] == [s for s, _ in want]
        if scale < 1e6:  # scores within 64 bits
            assert mine == want


# mixing


def test_mixing(table, odd_rows):
    rows = [(i, "a b c d e " * (1 + i % 3), "en", s) for i, s in enumerate(["a"] * 90 + ["b"] * 20 + ["c"] * 3 + [None] * 10)]
    got = mix_sources(table(rows)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix_sources(table(rows)).collect())) if all(r["source"] for r in got) else True
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
        assert r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
    for group in by.values():
        assert abs(sum(r["taken"] for r in group) - group[0]["target"]) <= 15
    assert abs(sum(g[0]["target"] for g in by.values()) - sum(r["size"] for r in got)) < 1e-6
    assert by["c"][0]["target"] <= 3 * by["c"][0]["source_size"]
    assert len(mix_sources(table(odd_rows)).collect()) == len(odd_rows)


def test_mixing_slices_of_low_quality(table):
    from pyspark.sql import functions as F

    rows = [(i, f"a{i % 7} " * (1 + i % 5), "en", "s") for i in range(3000)]
    for quality in (0.05, 1.0):
        got = mix_sources(table(rows), weights=(1,), quality_col=F.lit(quality)).collect()
        # one source takes one whole epoch of all
        assert all(r["taken"] == r["size"] for r in got)
    u = F.rand(3)
    for q in (0.02, 0.25, 1.0):
        cut = table(rows).select(F.floor(-F.log(-F.log(u) / q) * 128).alias("s")).groupBy("s").count()
        assert cut.agg(F.max("count")).first()[0] < 0.02 * len(rows)


# packing


def test_first_fit_equals_plain():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 1025, 500)
    bins, offsets = first_fit_decreasing(sizes, 1024)
    room: list[int] = []
    for i in np.argsort(-sizes, kind="stable"):
        k = next((k for k, r in enumerate(room) if r >= sizes[i]), None)
        if k is None:
            k = len(room)
            room.append(1024)
        assert (bins[i], offsets[i]) == (k, 1024 - room[k])
        room[k] -= sizes[i]


def test_encoder_equals_the_tokenizer():
    import random

    import public_tokenizers as P

    e, rng = Encoder(P.path("byte_bpe_50k.json")), random.Random(3)
    signs = [" ", "  ", "   ", "\n", "a", "b", "é", "'s", "1", ".", "<|endoftext|>", "\t", "x y", "　", "\x1c", " "]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 9))) for _ in range(5000)] + ["ab cd " * 2000]
    for at in range(0, len(texts), 7):
        for t, ids in zip(texts[at : at + 7], e.encode(texts[at : at + 7]), strict=True):
            assert ids.tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_pack(table, odd_rows):
    pieces = pack(table(odd_rows), _tok()).collect()
    t = Encoder(_tok()).tokenizer
    ids = {(d, x): np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4") for d, x, *_ in odd_rows}
    want = Counter((d, s, zlib.crc32(v[s : s + 1024].tobytes()), len(v)) for d, x, *_ in odd_rows for v in [ids[d, x]] for s in range(0, len(v), 1024))
    assert Counter((p["doc_id"], p["start"], p["ids_crc32"], p["doc_tokens"]) for p in pieces) == want
    rows = {}
    for p in pieces:
        rows.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for group in rows.values():
        at = 0
        for offset, length in sorted(group):
            assert offset == at
            at += length
        assert at <= 1024


# licences


def test_license_probes_hold():
    for words in TEMPLATES.values():
        own = bigrams(words)
        least = -(-len(own) * 2 // 3)
        assert len(own) - len(probes(words)) < least


def test_licenses(table, odd_rows):
    rows = [(1, "some words stand here\nReleased under the MIT License.\nand some stand here"), (2, "Licensed under the Apache License, Version 2.0."), (3, "the license"), (4, None), (5, "released under the mit  licence")]
    got = {r["doc_id"]: (r["license"], r["n_units"]) for r in scan_licenses(table(rows)).collect()}
    assert got == {1: ("MIT", 1), 2: ("Apache-2.0", 1), 3: (None, 0), 4: (None, 0), 5: (None, 0)}
    assert scan_licenses(table(odd_rows)).count() == len(odd_rows)


def test_licenses_wrapped_in_paragraphs_and_long_units(table):
    from platen.llm.license_texts import TEMPLATES as TEXTS

    code = "x = 1\n" * 300
    rows = [
        (1, code + "\n".join(f"# {line}" for line in MIT.split("\n")) + "\n" + code), (2, MIT.replace("\n", " ")), (3, "This data set was collected in 2020. Licensed under CC BY 4.0. See there."),
        (4, "// Licensed under the Apache\n// License, Version\n// 2.0 (the License);"), (5, MIT.replace("\n", " ") * 12), (6, " ".join(["released under the mit license"] * 4000)),
        (7, TEXTS["ISC-text"]), (8, TEXTS["MIT-text"]), (9, TEXTS["BSD-3-Clause-text"].replace(", ", ",\n")),
    ]
    got = {r["doc_id"]: r["license"] for r in scan_licenses(table(rows)).collect()}
    assert got == {1: "MIT-grant", 2: "MIT-grant", 3: "CC-BY-4.0", 4: "Apache-2.0", 5: "MIT-grant", 6: "MIT", 7: "ISC-text", 8: "MIT-text", 9: "BSD-3-Clause-text"}


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""


def test_license_windows(table, odd_rows):
    code = "x = 1\n" * 500
    rows = [
        (1, code + "\n".join(f"# {line}" for line in MIT.split("\n")) + "\n" + code), (2, MIT.replace("\n", " ")), (3, "This data set was collected in 2020. Licensed under CC BY 4.0. See there."),
        (4, "// Licensed under the Apache\n// License, Version\n// 2.0 (the License);"), (5, "the license of the software"), (6, None), (7, "Released under the MIT License. " * 3 + code),
    ]
    got = {r["doc_id"]: (r["license"], r["n_units"]) for r in scan_license_windows(table(rows)).collect()}
    # what follows the notice is most of the grant, a second window
    assert got == {1: ("MIT-notice", 2), 2: ("MIT-notice", 2), 3: ("CC-BY-4.0", 1), 4: ("Apache-2.0", 1), 5: (None, 0), 6: (None, 0), 7: ("MIT", 3)}
    assert scan_license_windows(table(odd_rows)).count() == len(odd_rows) and scan_license_windows(table([])).count() == 0


def test_license_windows_equal_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(300):
        words = list(rng.choice(list("abcd"), int(rng.integers(2, 30))))
        own = set(bigrams(" ".join(rng.choice(list("abcde"), int(rng.integers(3, 9))))))
        pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
        every = (2.0 * len(s & own) / (len(s) + len(own)) for i in range(len(pairs)) for j in range(i, len(pairs)) for s in [set(pairs[i : j + 1])])
        want = max(every, default=0.0)
        assert max((d for d, _, _ in windows_of(pairs, own, 0.8)), default=0.0) == (want if want >= 0.8 else 0.0)
