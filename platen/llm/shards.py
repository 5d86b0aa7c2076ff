"""Sharding: size-tiered compaction of immutable Parquet shards under versioned manifests.

An arrival is written once, as it comes, as a run of small files. Runs of similar
size are a tier; when a tier holds FANOUT runs they are merged into one run with
files of about the target size, which then belongs to a larger tier. A run that
has reached the target size is left alone, so a large arrival is never rewritten
together with tiny ones. A version is a manifest put in place by one rename that
fails if the version exists: readers see all of a change or nothing, and of two
writers one gets a Conflict. (A store whose rename is not atomic needs one that
refuses to overwrite.) Older versions stay readable until vacuum() drops them.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TARGET_BYTES = 128 << 20
#: Runs of up to this size are all alike.
SMALL_BYTES = 16 << 20
#: Runs belong to one tier while they are at most so many times its mean size.
RATIO = 2.0
FANOUT = 4
ARRIVALS = 8
#: The one column that read() adds, and the prefix of helper columns.
META = "__platen_shard"
ARRIVAL = "__platen_arrival"


class Conflict(RuntimeError):
    """Another writer put this version in place."""


def tiers(runs: list[dict], small: int = SMALL_BYTES, ratio: float = RATIO) -> list[list[dict]]:
    """Runs by size, cut where a run is larger than ratio times the mean of those before it; each tier from the oldest run on."""
    out: list[list[dict]] = []
    for run in sorted(runs, key=lambda r: (r["bytes"], r["arrivals"])):
        if out and run["bytes"] <= max(small, ratio * sum(r["bytes"] for r in out[-1]) / len(out[-1])):
            out[-1].append(run)
        else:
            out.append([run])
    return [sorted(tier, key=lambda r: r["arrivals"]) for tier in out]


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT, small_bytes: int = SMALL_BYTES, whole_bytes: float | None = None):
        """whole_bytes: runs of that size are left alone; the target size of files if not given."""
        self.spark, self.root, self.target_bytes, self.fanout, self.small_bytes = spark, root.rstrip("/"), target_bytes, fanout, small_bytes
        self.whole_bytes = target_bytes if whole_bytes is None else whole_bytes
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        for folder in ("manifests", "data"):
            self.fs.mkdirs(self._path(f"{self.root}/{folder}"))

    # manifests

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(f"{self.root}/manifests"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def version(self) -> int:
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "runs": []}
        stream = self.fs.open(self._path(f"{self.root}/manifests/v{version:010d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, base: dict, runs: list[dict], schema: StructType | None = None) -> dict:
        new = {"version": base["version"] + 1, "runs": runs, "schema": schema.jsonValue() if schema is not None else base.get("schema")}
        final = self._path(f"{self.root}/manifests/v{new['version']:010d}.json")
        temporary = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}")
        stream = self.fs.create(temporary, False)
        stream.write(bytearray(json.dumps(new).encode()))
        stream.close()
        if self.fs.exists(final) or not self.fs.rename(temporary, final):
            self.fs.delete(temporary, False)
            raise Conflict(f"version {new['version']} exists")
        return new

    # data

    def _folder(self, arrivals: list[int]) -> str:
        """Runs are named by the arrivals they hold; the rest of the name keeps two writers apart."""
        return f"{self.root}/data/{arrivals[0]:05d}-{arrivals[-1]:05d}-{uuid.uuid4().hex[:8]}"

    def _run(self, folder: str, arrivals: list[int]) -> dict:
        found = [(s.getPath().getName(), s.getLen()) for s in self.fs.listStatus(self._path(folder)) if s.getPath().getName().startswith("part-")]
        files = [{"name": n, "bytes": b} for n, b in sorted(found)]
        return {"run": f"{arrivals[0]:05d}-{arrivals[-1]:05d}", "folder": folder.rsplit("/", 1)[1], "arrivals": arrivals, "bytes": sum(f["bytes"] for f in files), "files": files}

    def _paths(self, runs: list[dict]) -> list[str]:
        return [f"{self.root}/data/{r['folder']}/{f['name']}" for r in runs for f in r["files"]]

    def _put(self, base: dict, folder: str, arrivals: list[int], gone: list[dict], schema: StructType | None) -> dict:
        """Commits a written folder in place of other runs; a folder that is not committed is removed."""
        old = {r["folder"] for r in gone}
        try:
            return self.commit(base, [*(r for r in base["runs"] if r["folder"] not in old), self._run(folder, arrivals)], schema)
        except BaseException:
            self.fs.delete(self._path(folder), True)
            raise

    def append(self, docs: DataFrame, arrival: int) -> dict:
        """Writes an arrival as it comes, without a shuffle, and commits it."""
        folder = self._folder([arrival])
        docs.write.parquet(folder)
        return self._put(self.manifest(), folder, [arrival], [], docs.schema)

    def adopt(self, written: str, arrival: int, schema: StructType) -> dict:
        """Commits a folder of files that were written under the root already; a folder that is not there is an arrival without rows."""
        folder = self._folder([arrival])
        if not self.fs.exists(self._path(written)):
            self.fs.mkdirs(self._path(folder))
        elif not self.fs.rename(self._path(written), self._path(folder)):
            raise OSError(f"{written} could not be moved")
        return self._put(self.manifest(), folder, [arrival], [], schema)

    def due(self, runs: list[dict]) -> list[dict]:
        """The runs to merge next: the oldest of the smallest tier that holds FANOUT runs that are not whole."""
        below = [r for r in runs if r["bytes"] < self.whole_bytes]
        return next((tier[: self.fanout] for tier in tiers(below, min(self.small_bytes, self.whole_bytes)) if len(tier) >= self.fanout), [])

    def compact(self) -> dict:
        """Merges until no tier of runs that are not whole holds FANOUT runs. Replaced files stay for the versions that name them."""
        while True:
            base = self.manifest()
            old = self.due(base["runs"])
            if not old:
                return base
            arrivals = sorted(a for r in old for a in r["arrivals"])
            folder = self._folder(arrivals)
            schema = StructType.fromJson(base["schema"])
            paths = self._paths(old)
            if paths:
                # a task for each file to be: whole splits are put together, nothing is shuffled
                rows = self.spark.read.schema(schema).parquet(*paths)
                rows.coalesce(max(1, round(sum(r["bytes"] for r in old) / self.target_bytes))).write.parquet(folder)
            else:
                self.fs.mkdirs(self._path(folder))
            self._put(base, folder, arrivals, old, None)

    def vacuum(self, keep: int = 2, older_s: float = 3600.0) -> list[str]:
        """Drops all but the last versions and the folders that none of them names, unless they are younger than older_s: a writer may be at work there."""
        versions = self.versions()
        kept = {r["folder"] for v in versions[-keep:] for r in self.manifest(v)["runs"]}
        for v in versions[:-keep]:
            self.fs.delete(self._path(f"{self.root}/manifests/v{v:010d}.json"), False)
        gone = []
        for s in self.fs.listStatus(self._path(f"{self.root}/data")):
            if s.getPath().getName() not in kept and s.getModificationTime() <= (time.time() - older_s) * 1000:
                self.fs.delete(s.getPath(), True)
                gone.append(s.getPath().getName())
        return gone

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version with a struct META of run, tier (of its size), file and bytes; None if it has no file.

        The run is part of each file's path, so only the runs' tiers, a row for
        each run, come from the manifest; nothing is joined.
        """
        manifest = self.manifest(version)
        paths = self._paths(manifest["runs"])
        if not paths:
            return None
        data = self.spark.read.schema(StructType.fromJson(manifest["schema"])).parquet(*paths)
        folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        tier = F.lit(None).cast("int")
        for k, same in enumerate(tiers(manifest["runs"], self.small_bytes)):
            tier = F.when(folder.isin([r["folder"] for r in same]), F.lit(k)).otherwise(tier)
        meta = F.struct(F.substring(folder, 1, 11).alias("run"), tier.alias("tier"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
        return data.select("*", meta.alias(META))


def shard_documents(docs: DataFrame, root: str, arrivals: int = ARRIVALS, target_bytes: int = TARGET_BYTES, id_col: str = "doc_id") -> ShardStore:
    """Stores a table as so many arrivals, dealt by a hash of the id, compacting after each one.

    All columns and rows are kept, nulls, empty and repeated rows included; null
    ids are dealt like one id. Nothing is shuffled, so a repeated id makes its
    arrival larger, not a task. Of names only META and ARRIVAL are taken.

    Arrivals of one table are alike by the way they are dealt, so they and what
    they are merged into are one tier: which arrivals a run holds follows from
    their numbers alone, for a table of any size. Arrivals without rows count, but
    an empty table commits none.
    """
    spark = docs.sparkSession
    store = ShardStore(spark, root, target_bytes, small_bytes=math.inf, whole_bytes=math.inf)
    staged = f"{store.root}/data/arrivals-{uuid.uuid4().hex}"
    digits = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")
    docs.withColumn(ARRIVAL, (digits % arrivals).cast("int")).write.partitionBy(ARRIVAL).parquet(staged)
    if any(s.getPath().getName().startswith(f"{ARRIVAL}=") for s in store.fs.listStatus(store._path(staged))):
        for k in range(arrivals):
            store.adopt(f"{staged}/{ARRIVAL}={k}", k, docs.schema)
            store.compact()
    store.fs.delete(store._path(staged), True)
    return store


def op9_query(spark, sf_dir):
    """Per document: the run that holds it in the last version, named by its arrivals, and what is read back from there."""
    from platen.llm.common import read, scratch_path

    docs = read(spark, sf_dir, "documents")
    rows = shard_documents(docs, scratch_path(spark, "shards")).read()
    if rows is None:
        rows = docs.withColumn(META, F.struct(F.lit("").alias("run")))
    return rows.select("doc_id", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.col(f"{META}.run").alias("run"))


#: Any FANOUT runs are merged: the first, and then each FANOUT - 1 more.
_LAST = (ARRIVALS - 1) // (FANOUT - 1) * (FANOUT - 1)
OP9_SQL = f"""
WITH d AS (SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % {ARRIVALS} AS arrival FROM documents)
SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5,
  CASE WHEN arrival <= {_LAST} THEN '00000-{_LAST:05d}' ELSE printf('%05d-%05d', arrival, arrival) END AS run
FROM d
"""
