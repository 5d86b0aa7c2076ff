import hashlib
import json
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from platen.llm.pseudonyms import KEY, card, iban, iso_date, luhn, mask_private, permute, pseudonymise
from platen.llm.shards import Conflict, ShardStore, shard_documents, tiers

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("size", [2, 3, 10, 97, 1000])
def test_permutation(size):
    assert sorted(permute(KEY, "t", i, size) for i in range(size)) == list(range(size))


def test_formats_hold():
    new = card(KEY, "4610 5689 0197 0798")
    assert re.fullmatch(r"4\d{3} \d{4} \d{4} \d{4}", new) and luhn(re.sub(r"\D", "", new)) == 0 and new != "4610 5689 0197 0798"
    assert re.sub(r"\D", "", new) == card(KEY, "4610568901970798")
    assert card(KEY, "4610568901970799") is None
    i = iban(KEY, "DE89 3704 0044 0532 0130 00")
    assert re.fullmatch(r"DE\d\d( \d{4}){4} \d\d", i) and iban(KEY, i)
    assert re.fullmatch(r"\d{4}-\d\d-\d\d", iso_date(KEY, "2024-02-29")) and iso_date(KEY, "2023-02-29") is None


def test_text():
    text = "Call +1 (830) 555-5433 or that.92@mail2.example.com, 108.51.216.133; card 4610568901970798; born 1990-05-17, 17.05.1990. token = \"7c72db563d7f6e50cec00950f7bab1f2223b6afd\" v1.2.3 999.1.1.1 9870157079875995"
    new, found = pseudonymise(text)
    assert [k for k, _, _ in found] == ["phone", "email", "ipv4", "card", "iso_date", "local_date", "secret"]
    assert len(new) >= len(text) - 12 and new.endswith("v1.2.3 999.1.1.1 9870157079875995")
    for _, a, b in found:
        assert text[a:b] not in new
    assert new == pseudonymise(text)[0]
    again = pseudonymise("x 4610568901970798")[0]
    assert again[2:] in new


def test_phones():
    import pyarrow.parquet as pq

    planted = re.compile(r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}")
    texts = [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist() if t] + ["+1 (017) 555-7713", "+1 (132) 555-1352 190.1"]
    share = [any(k == "phone" and (a, b) == m.span() for k, a, b in found) for t in texts for found in [pseudonymise(t)[1]] for m in planted.finditer(t)]
    assert len(share) > 10 and all(share)
    others = ["+44 20 7946 0958", "+44 (0)20 7946 0958", "+4915112345678", "0049 151 12345678", "+33 1 23 45 67 89", "+351 912 345 678", "(017) 555-7713", "020 7946 0958", "01 23 45 67 89", "030/901820", "4155550123"]
    for s in others:
        for text in (s, f"call {s}, or", f"{s} 12/27"):
            new, found = pseudonymise(text)
            assert len(found) == 1 and found[0][0] == "phone" and text[found[0][1] : found[0][2]] == s and s not in new
        assert re.sub("[0-9]", "9", pseudonymise(s)[0]) == re.sub("[0-9]", "9", s)
    for text in ("1700000000", "v 12:00 4567", "0.123456789", "+12 345", "01-02-2003 10"):
        assert pseudonymise(text) == (text, [])
    # numbers that are no North American ones do not meet those that are, nor each other
    for head in ("+1 ", ""):
        some = [f"{head}{a}-{e}-0123" for a in ("017", "132", "415", "999") for e in ("055", "155", "555")]
        new = [pseudonymise(s)[0] for s in some]
        assert len(set(new)) == len(some)
        for s, n in zip(some, new):
            nanp = lambda x: x[len(head)] not in "01" and x[len(head) + 4] not in "01"  # noqa: B023, E731
            assert nanp(s) == nanp(n)


def test_values_before_other_groups():
    for value, more in [("4610 5689 0197 0798", "12/27"), ("4610568901970798", "123"), ("4610-5689-0197-0798", "12/27 123"), ("3782 822463 10005", "1234"), ("4610 5689 0197 0798", "4610568901970798")]:
        new, found = pseudonymise(f"card {value} {more}")
        assert (found[0][0], found[0][1], found[0][2]) == ("card", 5, 5 + len(value)) and new.split(" ")[1:][: value.count(" ") + 1] == card(KEY, value).split(" ")
    for value, more in [("ES91 2100 0418 4502 0005 1332", "BANK X"), ("ES9121000418450200051332", "BANK"), ("DE89 3704 0044 0532 0130 00", "BANKING"), ("NO93 8601 1117 947", "ABCD 1"), ("DE89 3704 0044 0532 0130 00", "4610 5689 0197 0798")]:
        new, found = pseudonymise(f"IBAN {value} {more}")
        assert found[0] == ("iban", 5, 5 + len(value)) and new.startswith(f"IBAN {iban(KEY, value)} ")
    assert [k for k, _, _ in found] == ["iban", "card"]
    for text in ("4610 5689 0197 0799 12/27", "ES91 2100 0418 4502 0005 1333 BANK X"):
        assert pseudonymise(text) == (text, [])


def test_dates_never_meet():
    from datetime import timedelta

    from platen.llm.pseudonyms import DAYS, FIRST_DAY, local_date

    days = [FIRST_DAY + timedelta(n) for n in range(DAYS)]
    strings = {f"{d:%d/%m/%Y}" for d in days} | {f"{d:%m/%d/%Y}" for d in days}
    assert {local_date(KEY, s) for s in strings} == strings
    assert {iso_date(KEY, f"{d:%Y-%m-%d}") for d in days} == {f"{d:%Y-%m-%d}" for d in days}


def test_long_values_take_linear_time():
    import time

    begin = time.time()
    for text in ("a" * 1_000_000, "0123456789abcdef" * 65_536, "x@" + "ab1." * 50_000 + "com", "a1" * 100_000 + "@b.example.org", "1" * 1_000_000, "1-" * 100_000, "." * 300_000, "ab@" * 100_000):
        new, found = pseudonymise(text)
        assert len(new) == len(text) and pseudonymise(text) == (new, found)
    assert time.time() - begin < 60
    assert len(pseudonymise("0123456789abcdef" * 65_536)[1]) == 1
    # values that differ in one sign only do not meet, wherever it stands
    base = "0123456789abcdef" * 20
    some = [base[:k] + c + base[k + 1 :] for k in (0, 40, 47, 48, 49, 100, 319) for c in "0123456789abcdef"]
    assert len({pseudonymise(s)[0] for s in some}) == len(set(some))


def test_text_equals_replacing_each_value():
    import random

    from platen.llm.pseudonyms import KINDS

    rng = random.Random(4)
    values = {
        "email": ["ann.lee@mail.example.com", "x_1@a.b.example.org"], "secret": ["7c72db563d7f6e50cec00950f7bab1f2223b6afd"], "iban": ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"],
        "ipv4": ["108.51.216.133", "10.0.0.1"], "iso_date": ["1990-05-17"], "local_date": ["17.05.1990", "05/17/1990"], "ssn": ["123-45-6789"], "phone": ["+1 (830) 555-5433", "+44 20 7946 0958"], "card": ["4610 5689 0197 0798", "378282246310005"],
    }
    plain = ["word", "999.1.1.1", "v1.2.3", "2023-02-30", "4610 5689 0197 0799", "000-12-3456", "é", "(x)", "12", "@", "a@b"]
    for _ in range(300):
        text, want, spans = "", "", []
        for _ in range(rng.randint(1, 8)):
            gap = rng.choice([", ", "; ", "\n", " and ", " \"", "\t|"])
            kind = rng.choice(sorted(values) + [None])
            value = rng.choice(plain if kind is None else values[kind])
            text, want = text + gap, want + gap
            if kind is not None:
                spans.append((kind, len(text), len(text) + len(value)))
            text, want = text + value, want + (value if kind is None else KINDS[kind][1](KEY, value))
        assert pseudonymise(text) == (want, spans)


def test_rows(table, odd_rows):
    got = mask_private(table(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    assert [r["text"] for r in got if r["doc_id"] == 2] == [None] and all(r["n_found"] == 0 for r in got)


def test_shards(spark, table, odd_rows, tmp_path):
    docs = table(odd_rows)
    store = shard_documents(docs, str(tmp_path / "s"), target_bytes=1 << 20)
    back = store.read().select(*docs.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, docs.collect()))
    runs = store.manifest()["runs"]
    assert all(len(t) < store.fanout for t in tiers([r for r in runs if r["bytes"] < 1 << 20], store.small_bytes))
    assert sorted(a for r in runs for a in r["arrivals"]) == sorted({a for r in runs for a in r["arrivals"]})
    stale = store.manifest(store.version() - 1)
    with pytest.raises(Conflict):
        store.commit(stale, [])
    assert store.manifest()["runs"] == runs and json.dumps(runs)
    assert ShardStore(spark, str(tmp_path / "empty")).read() is None
    assert shard_documents(table([]), str(tmp_path / "none")).read() is None


@pytest.mark.parametrize(("n", "target_bytes"), [(3, 1 << 20), (400, 128 << 20), (400, 20_000), (400, 2_000)])
def test_runs_of_a_table_do_not_depend_on_its_size(table, tmp_path, n, target_bytes):
    """Few rows, files far below the target and arrivals far above it: the runs are those of the SQL."""
    import hashlib

    from platen.llm.shards import META

    rows = [(i, hashlib.sha512(b"%d" % i).hexdigest() * 4) for i in range(n)]
    store = shard_documents(table(rows), str(tmp_path / "s"), target_bytes=target_bytes)
    arrival = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) % 8
    got = {r["doc_id"]: (r["text"], r[META]["run"]) for r in store.read().collect()}
    assert got == {i: (t, "00000-00006" if arrival(i) <= 6 else "00007-00007") for i, t in rows}
    assert [r["run"] for r in store.manifest()["runs"]] == ["00000-00006", "00007-00007"]


def test_tiers_by_size(spark, table, tmp_path):
    import random

    rng = random.Random(1)
    text = lambda kb: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=1000 * kb))
    store = ShardStore(spark, str(tmp_path / "t"), target_bytes=600_000, small_bytes=1000)
    rows, seen = [], {}
    for k, kb in enumerate([20, 900, 20, 200, 20, 20, 20, 200, 900, 200, 20, 20, 20]):
        new = [(k, text(kb))]
        rows += new
        store.append(table(new).coalesce(1), k)
        large = {r["folder"] for r in store.manifest()["runs"] if r["bytes"] >= 600_000}
        store.compact()
        runs = store.manifest()["runs"]
        assert large <= {r["folder"] for r in runs}  # never written again
        assert sorted(a for r in runs for a in r["arrivals"]) == list(range(k + 1))
        assert all(len(t) < 4 for t in tiers([r for r in runs if r["bytes"] < 600_000], 1000))
        seen[store.version()] = k + 1
    assert {tuple(r["arrivals"]) for r in runs} >= {(1,), (8,), (0, 2, 4, 5)}
    merged = [r for r in runs if len(r["arrivals"]) > 1]
    assert all(f["bytes"] <= 2 * 600_000 for r in merged for f in r["files"])
    # older versions can be read until they are dropped
    for version, n in seen.items():
        assert sorted((r["doc_id"], r["text"]) for r in store.read(version).collect()) == sorted(rows[:n])
    assert store.vacuum(keep=1) == []  # all young
    assert store.vacuum(keep=1, older_s=-60) and store.versions() == [store.version()]
    assert sorted((r["doc_id"], r["text"]) for r in store.read().collect()) == sorted(rows)


def test_shards_of_clashing_names(spark, tmp_path):
    names = ("run", "tier", "shard", "shard_bytes", "__arrival", "file", "bytes")
    docs = spark.createDataFrame([(i, "x", *[str(i)] * len(names)) for i in range(20)], f"doc_id long, text string, {', '.join(f'{n} string' for n in names)}")
    store = shard_documents(docs, str(tmp_path / "c"))
    assert sorted(map(str, store.read().select(*docs.columns).collect())) == sorted(map(str, docs.collect()))
    assert "Exchange" not in store.read()._jdf.queryExecution().toString()


def staged(spark, docs, sf_dir=SF):
    """What each stage of the pipeline gives."""
    import corpus_pipeline as C
    from platen.llm.common import materialise

    columns, given = docs.columns, {}
    for name, stage in C.STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "test")
        given[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    return given


def plain_mix(rows):
    """doc_id -> times taken, for rows (doc_id, text, source)."""
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in rows}
    members = {}
    for d, t, s in rows:
        members.setdefault(s, []).append((d, t))
    names = sorted(members, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    whole = {s: sum(size[d] for d, _ in members[s]) for s in names}
    target, free, rest = {}, list(names), sum(whole.values())
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        stopped = [s for s in free if share[s] > 3 * whole[s]]
        if not stopped:
            target |= share
            break
        for s in stopped:
            target[s] = 3 * whole[s]
            rest -= target[s]
            free.remove(s)
    times = {}
    for s in names:
        epochs = int(target[s] // whole[s]) if whole[s] else 0
        left, upto = target[s] - epochs * whole[s], 0

        def key(m):
            u = (int(hashlib.md5(str(m[0]).encode()).hexdigest()[:12], 16) + 0.5) / (1 << 48)
            return math.log(u) * (1 + len(re.findall("[#$%&*|<>{}=]", m[1] or "")) / max(size[m[0]], 1))

        for d, _ in sorted(members[s], key=lambda m: (-key(m), m[0])):
            upto += size[d]
            times[d] = epochs + (2 * upto - size[d] <= 2 * left and epochs < 3)
    return {d: n for d, n in times.items() if n and size[d]}


def test_pipeline_against_brute_force(spark, table, odd_rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tests.llm.test_operators import brute_components

    odd = [(100_000 + i, *r[1:]) for i, r in enumerate(odd_rows)]
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(table(odd).drop("row_no", "bucket"))
    every = docs.collect()
    given = staged(spark, docs)
    ids = lambda name: sorted(r["doc_id"] for r in given[name])
    letters = [r for r in every if re.search(r"[^\W\d_]", r["text"] or "")]
    assert ids("language") == sorted(r["doc_id"] for r in letters)
    best = {}
    for r in letters:
        bare = re.sub(r"[ \t-\r]", "", r["text"])
        best[bare] = min(best.get(bare, (0, 1 << 60)), (-len(r["text"]), r["doc_id"]))
    assert ids("exact dedup") == sorted(d for _, d in best.values())
    want = {root for _, root in brute_components([(r["doc_id"], r["text"]) for r in given["exact dedup"]]).values()}
    assert set(ids("near dedup")) == want and len(ids("near dedup")) == len(want)
    times = plain_mix([(r["doc_id"], r["text"], r["source"]) for r in given["near dedup"]])
    assert Counter(ids("mixing")) == Counter(times)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = Counter()
    for r in given["mixing"]:
        v = np.array(tokenizer.encode(r["text"], add_special_tokens=False).ids + [0], "<u4")
        pieces.update((r["doc_id"], s, len(v[s : s + 1024]), zlib.crc32(v[s : s + 1024].tobytes()), len(v)) for s in range(0, len(v), 1024))
    assert Counter((p["doc_id"], p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in given["packing"]) == pieces
    rows = {}
    for p in given["packing"]:
        rows.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert all(o == sum(n for _, n in sorted(group)[:i]) for group in rows.values() for i, (o, _) in enumerate(sorted(group)))
    assert len(rows) <= 1.05 * sum(p["length"] for p in given["packing"]) / 1024 + 1


def test_pipeline_keeps_other_texts_of_a_repeated_id(spark, table):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base, "en", "a"), (2, base + " z", "en", "a"), (2, " ".join(f"v{i}" for i in range(60)), "en", "a"), (3, "only words here", "en", "b")]
    kept = staged(spark, table(rows))["near dedup"]
    assert sorted((r["doc_id"], r["text"][:2]) for r in kept) == [(1, "w0"), (2, "v0"), (3, "on")]


def test_pipeline_of_odd_tables(spark, table, odd_rows, tmp_path):
    import corpus_pipeline as C

    names = ("same", "times", "__copy", "k_sha", "k_id", "__text", "taken", "size", "key", "slice", "r", "n", "digest", "fp", "kept")
    full = [(*(list(r) + [None] * 4)[:4], *["x"] * len(names)) for r in odd_rows]
    clashing = spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, {', '.join(f'`{n}` string' for n in names)}")
    assert staged(spark, clashing)["packing"]
    empty = table([])
    assert all(not rows for rows in staged(spark, empty).values())
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", ["op1_suffix_dedup", "op3_language", "op4_jaccard_join", "op8_pack", "op9_shards", "op10_pseudonyms"])
def test_queries_of_an_empty_table(spark, table, tmp_path, name):
    from platen.llm.queries import QUERIES

    table([]).drop("row_no", "bucket").write.parquet(str(tmp_path / "documents.parquet"))
    assert QUERIES[name](spark, str(tmp_path)).count() == 0
