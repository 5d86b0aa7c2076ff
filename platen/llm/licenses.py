"""Licence scan: Dice coefficient over word bigrams against licence templates, with size bounds.

A text is cut into pieces at line ends and after sentences; units are all runs
of up to RUN pieces and the whole text, in lower case with runs of other signs
than letters and digits as one space. So a notice is found though it is wrapped
over lines or stands inside a paragraph, and a file that holds a full licence
text as a whole. For t and x distinct bigrams and threshold T, 2c >= T (t + x)
needs x between T t / (2 - T) and t (2 - T) / T, which prunes templates by size,
and c >= T t / (2 - T): of any t - c + 1 of a template's bigrams a match holds
one, so a text with none of these probes is not cut into units. All runs in the
JVM; only narrow rows are shuffled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platen.llm.common import blocks
from platen.llm.license_texts import TEMPLATES as _TEXTS

BLOCK_BYTES = 4 << 20
THRESHOLD = 0.8
#: Pieces that a unit runs over at most, beside the whole text.
RUN = 8


def words_of(text: str) -> str:
    return " ".join(re.findall(r"[^\W_]+", text.lower()))


TEMPLATES = {name: words_of(text) for name, text in _TEXTS.items()}


def bigrams(words: str) -> list[str]:
    w = words.split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w[:-1], w[1:], strict=True)))


def probes(words: str, threshold: float = THRESHOLD) -> list[str]:
    """Bigrams of which every text that matches the template holds one: those of the longest words, which stand least often elsewhere."""
    all_of = bigrams(words)
    least = math.ceil(threshold * len(all_of) / (2 - threshold) - 1e-9)
    return sorted(all_of, key=lambda b: -len(b))[: len(all_of) - least + 1]


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def literals(values) -> Column:
    return F.array(*map(F.lit, values))


def pairs_of(words: Column) -> Column:
    n = F.size(words)
    return F.when(n > 1, F.zip_with(F.slice(words, 1, n - 1), F.slice(words, 2, n - 1), lambda a, b: F.concat_ws(" ", a, b)))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Columns doc_id, license, dice, n_units; one row per input row.

    license is the template of the best unit (equal scores: the last name),
    null where none reaches the threshold; dice is then 0. n_units counts pieces
    at which a matching unit begins. Null and empty texts match nothing.
    Repeated rows are repeated. Units of any length count. An empty table gives
    no rows. Other columns are not read.
    """
    templates = TEMPLATES if templates is None else templates
    wanted = list(dict.fromkeys(p for words in templates.values() for p in probes(words, threshold)))
    fewest = math.ceil(min(len(bigrams(words)) for words in templates.values()) * threshold / (2 - threshold) - 1e-9)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row_no"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    # each step is a column of its own, so that no step is computed once for each use
    rows = rows.withColumn("norm", normalised(F.col("t"))).withColumn("every", F.split("norm", " "))
    rows = rows.withColumn("every", F.when(F.arrays_overlap("every", literals(dict.fromkeys(max(p.split(), key=len) for p in wanted))), F.col("every")))
    rows = rows.withColumn("every", pairs_of(F.col("every")))
    gate = F.arrays_overlap("every", literals(wanted))
    u = rows.select("doc_id", "row_no", "norm", F.when(gate, F.split(F.regexp_replace("t", r"([.;:!?])[ \t]+", "$1\n"), "\n")).alias("lines"))
    u = u.select("doc_id", "row_no", "norm", F.filter(F.transform("lines", normalised), lambda x: x != "").alias("pieces"))
    whole = F.struct(F.lit(1).alias("start"), F.array("norm").alias("run"))
    runs = F.when(F.size("pieces") > 0, F.concat(F.transform("pieces", lambda _, i: F.struct((i + 1).alias("start"), F.slice("pieces", i + 1, RUN).alias("run"))), F.array(whole)))
    u = u.select("doc_id", "row_no", F.explode_outer(runs).alias("s"))
    u = u.select("doc_id", "row_no", "s.start", "s.run", F.explode_outer(F.sequence(F.lit(1), F.size("s.run"))).alias("n"))
    u = u.select("doc_id", "row_no", "start", F.split(F.array_join(F.slice("run", 1, F.col("n")), " "), " ").alias("words"))
    u = u.withColumn("pairs", F.when(F.size("words") > fewest, F.array_distinct(pairs_of(F.col("words")))))
    x = F.size("pairs")
    scores = []
    for name, words in templates.items():
        own = bigrams(words)
        near = (x >= len(own) * threshold / (2 - threshold) - 1e-9) & (x <= len(own) * (2 - threshold) / threshold + 1e-9)
        dice = F.size(F.array_intersect(F.col("pairs"), literals(own))) * 2.0 / (x + len(own))
        scores.append(F.when(near, F.struct(dice.alias("dice"), F.lit(name).alias("name"))))
    u = u.withColumn("best", F.when(F.col("pairs").isNotNull(), F.array_max(F.array_compact(F.array(*scores)))))
    hit = F.when(F.col("best.dice") >= threshold, F.col("best"))
    starts = u.groupBy("row_no", "doc_id", "start").agg(F.max(hit).alias("top"))
    found = starts.groupBy("row_no", "doc_id").agg(F.max("top").alias("top"), F.count("top").alias("n_units"))
    return found.select("doc_id", F.col("top.name").alias("license"), F.coalesce("top.dice", F.lit(0.0)).alias("dice"), "n_units")


def windows_of(pairs: list[str], own: set[str], threshold: float) -> Iterator[tuple[float, int, int]]:
    """(dice, start, stop) of the best window of bigrams from each start, where it reaches the threshold.

    A best window starts and ends with bigrams of the template, and its first
    one does not come again in it; so all starts together go over at most the
    template's bigrams times the text.
    """
    least, most = threshold * len(own) / (2 - threshold) - 1e-9, len(own) * (2 - threshold) / threshold + 1e-9
    hits = [i for i, p in enumerate(pairs) if p in own]
    if len({pairs[i] for i in hits}) < least:
        return
    for i in hits:
        seen, c, best = set(), 0, (0.0, 0, 0)
        for j in range(i, len(pairs)):
            p = pairs[j]
            if p in seen:
                if p == pairs[i]:
                    break
                continue
            seen.add(p)
            if len(seen) > most:
                break
            if p in own:
                c += 1
                best = max(best, (2.0 * c / (len(seen) + len(own)), i, j + 1))
        if best[0] >= threshold:
            yield best


def _windows(templates: dict[str, str], threshold: float):
    own = {name: set(bigrams(words)) for name, words in templates.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "norm", BLOCK_BYTES):
            names, dices, counts = [], [], []
            for norm in block.column("norm").to_pylist():
                words = norm.split(" ") if norm else []
                pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
                found = sorted(((d, name, -i, j) for name, b in own.items() for d, i, j in windows_of(pairs, b, threshold)), reverse=True)
                taken = bytearray(len(words))
                count = 0
                for _, _, i, j in found:
                    # a window of bigrams -i to j - 1 holds the words -i to j
                    if not any(taken[-i : j + 1]):
                        taken[-i : j + 1] = b"\1" * (j + 1 + i)
                        count += 1
                names.append(found[0][1] if found else None)
                dices.append(found[0][0] if found else 0.0)
                counts.append(count)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(names, pa.string()), pa.array(dices, pa.float64()), pa.array(counts, pa.int64())], names=["doc_id", "license", "dice", "n_units"])

    return run


def scan_license_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """As scan_licenses, but units are all runs of words of the text, wherever lines end, without a cap on words.

    So notices that are wrapped, stand inside a paragraph or in a full licence
    text are found. n_units counts matching windows that do not overlap, best
    first. Nothing is shuffled.
    """
    templates = TEMPLATES if templates is None else templates
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    rows = rows.select("doc_id", normalised(F.col("t")).alias("norm"))
    gate = F.lit(False)
    for p in dict.fromkeys(p for words in templates.values() for p in probes(words, threshold)):
        gate = gate | F.contains(F.col("norm"), F.lit(p))
    rows = rows.select("doc_id", F.when(gate, F.col("norm")).alias("norm"))
    return rows.mapInArrow(_windows(templates, threshold), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, license string, dice double, n_units long")


def op7_query(spark, sf_dir):
    from platen.llm.common import read

    return scan_licenses(read(spark, sf_dir, "documents"))


_VALUES = ", ".join("('{}', [{}])".format(n, ", ".join(f"'{b}'" for b in bigrams(w))) for n, w in TEMPLATES.items())
OP7_SQL = rf"""
WITH t(name, b) AS (VALUES {_VALUES}),
d AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents),
n AS (
  SELECT row_no, trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS norm,
    list_filter(list_transform(string_split(regexp_replace(text, '([.;:!?])[ \t]+', '\1' || chr(10), 'g'), chr(10)),
      lambda x: trim(regexp_replace(lower(x), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))), lambda x: x <> '') AS pieces
  FROM d),
u AS (
  SELECT row_no, i AS start, array_to_string(pieces[i : i + w - 1], ' ') AS unit
  FROM (SELECT row_no, pieces, unnest(range(1, len(pieces) + 1)) AS i FROM n), range(1, {RUN + 1}) AS r(w) WHERE i + w - 1 <= len(pieces)
  UNION ALL SELECT row_no, 1, norm FROM n),
g AS (SELECT row_number() OVER () AS unit_no, row_no, start, string_split(unit, ' ') AS words FROM u),
b AS (SELECT unit_no, row_no, start, list_distinct([words[i] || ' ' || words[i + 1] FOR i IN range(1, len(words))]) AS pairs FROM g WHERE len(words) > 1),
s AS (
  SELECT row_no, start, name, len(list_intersect(pairs, t.b)) * 2.0::DOUBLE / (len(pairs) + len(t.b)) AS dice
  FROM b, t WHERE len(pairs) * 3 >= len(t.b) * 2 AND len(pairs) * 2 <= len(t.b) * 3),
m AS (SELECT row_no, start, max(struct_pack(dice := dice, name := name)) AS best FROM s WHERE dice >= 0.8 GROUP BY ALL),
f AS (SELECT row_no, max(best) AS best, count(*) AS n_units FROM m GROUP BY row_no)
SELECT d.doc_id, f.best.name AS license, coalesce(f.best.dice, 0.0::DOUBLE) AS dice, coalesce(f.n_units, 0)::BIGINT AS n_units
FROM d LEFT JOIN f USING (row_no)
"""
