"""Sharding by size-tiered compaction: small immutable shards arrive, similar runs are merged, a versioned manifest commits it all.

Everything is DataFrame writes and file-system metadata; rows are neither keyed nor shuffled, so a hot source
costs nothing. A reader sees exactly the files that one manifest version lists: what a lost job leaves behind is never read.
Merged runs stay, so older versions can be read, until `vacuum` removes what no kept version lists.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.llm.common import free_name, hadoop_fs


class Overtaken(RuntimeError):
    """Another writer has committed the version that this one was about to."""


class ShardStore:
    """A folder of runs (folders of Parquet shards) and manifest versions v00000000.json, v00000001.json, ..."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 256 << 20, fan_in: int = 4, smallest: int = 1 << 20):
        """target_bytes: size of a merged file. fan_in: so many runs of one tier are merged, and each tier is that many times the one below. smallest: bytes up to which a run is in tier 0."""
        self.spark, self.root, self.target_bytes, self.fan_in, self.smallest = spark, root.rstrip("/"), target_bytes, fan_in, smallest
        self.fs, _ = hadoop_fs(spark, self.root)

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def versions(self) -> list[int]:
        folder = self._path("_manifest")
        return sorted(int(s.getPath().getName()[1:-5]) for s in self.fs.listStatus(folder) if s.getPath().getName().endswith(".json")) if self.fs.exists(folder) else []

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version (the last one by default); an empty store has version -1 and no runs."""
        have = self.versions()
        if version is None and not have:
            return {"version": -1, "runs": []}
        reader = self.fs.open(self._path("_manifest", f"v{have[-1] if version is None else version:08d}.json"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(reader)).decode())
        finally:
            reader.close()

    def _commit(self, before: dict, runs: list[dict]) -> dict:
        """Atomic: a whole temporary file gets the name of the next version, which fails if another writer was first.

        On a local file system that is a hard link, on others a rename that does not overwrite, as HDFS has it. On an
        object store without such a rename there must be one writer at a time.
        """
        after = {"version": before["version"] + 1, "at": time.time(), "runs": runs}
        temporary, final = self._path("_manifest", f".{uuid.uuid4().hex}"), self._path("_manifest", f"v{after['version']:08d}.json")
        out = self.fs.create(temporary, False)
        try:
            out.write(bytearray(json.dumps(after).encode()))
        finally:
            out.close()
        try:
            if not self._named(temporary, final):
                raise Overtaken(f"another writer has committed version {after['version']}")
        finally:
            self.fs.delete(temporary, False)
        return after

    def _named(self, temporary, final) -> bool:
        if self.fs.getScheme() != "file":
            return not self.fs.exists(final) and self.fs.rename(temporary, final)
        place = lambda p: self.spark._jvm.java.nio.file.Paths.get(p.toUri())
        try:
            self.spark._jvm.java.nio.file.Files.createLink(place(self.fs.makeQualified(final)), place(self.fs.makeQualified(temporary)))
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        return True

    def _run(self, folder: str) -> dict:
        files = [s for s in self.fs.listStatus(self._path(*folder.split("/"))) if s.getPath().getName().endswith(".parquet")]
        return {"folder": folder, "bytes": sum(s.getLen() for s in files), "files": len(files)}

    def append(self, arrivals: DataFrame, arrival_col: str | None = None) -> dict:
        """Write df's rows as new immutable shards; each value of arrival_col is an arrival (a run and a manifest version) of its own, in rising order.

        Rows are stored as they are, whatever is null or repeated in them; an arrival without rows commits nothing.
        """
        batch = f"run-{uuid.uuid4().hex}"
        if arrival_col is None:
            arrivals.write.parquet(str(self._path(batch)))
            folders = [batch]
        else:
            arrivals.write.partitionBy(arrival_col).parquet(str(self._path(batch)))
            folders = sorted((f"{batch}/{s.getPath().getName()}" for s in self.fs.listStatus(self._path(batch)) if s.isDirectory()), key=lambda f: (len(f), f))
        for folder in folders:
            if (run := self._run(folder))["files"]:
                while True:  # a run can follow any other, so a writer that was overtaken tries again on the newer version
                    try:
                        now = self.manifest()
                        self._commit(now, [*now["runs"], run])
                        break
                    except Overtaken:
                        continue
                self.compact()
        return self.manifest()

    def tier(self, size: int) -> int:
        level, edge = 0, self.smallest
        while size > edge:
            level, edge = level + 1, edge * self.fan_in
        return level

    def compact(self) -> dict:
        """Merge fan_in runs of the lowest full tier until none can do with fewer files; merged runs go to files of about target_bytes.

        Of a tier, the runs with the most files beyond their bytes are taken, older ones first: if these cannot do with fewer
        files together, no other fan_in of them can. Every merge leaves fewer files, so it ends. A merge stands if all its inputs
        are still listed, however many runs have arrived meanwhile; else it is dropped and planned again.
        """
        def merged_files(runs: list[dict]) -> int:
            return max(1, -(-sum(r["bytes"] for r in runs) // self.target_bytes))

        while True:
            now = self.manifest()
            tiers: dict[int, list[dict]] = {}
            for run in now["runs"]:
                tiers.setdefault(self.tier(run["bytes"]), []).append(run)
            picked = [sorted(runs, key=lambda r: r["bytes"] - r["files"] * self.target_bytes)[: self.fan_in] for _, runs in sorted(tiers.items()) if len(runs) >= self.fan_in]
            full = [runs for runs in picked if sum(r["files"] for r in runs) > merged_files(runs)]
            if not full:
                return now
            merging = full[0]
            folder, old = f"run-{uuid.uuid4().hex}", {r["folder"] for r in merging}
            self._read(merging).coalesce(merged_files(merging)).write.parquet(str(self._path(folder)))
            run = self._run(folder)
            while old <= {r["folder"] for r in now["runs"]}:
                try:
                    self._commit(now, [*(r for r in now["runs"] if r["folder"] not in old), run])
                    break
                except Overtaken:
                    now = self.manifest()
            else:
                self.fs.delete(self._path(folder), True)

    def vacuum(self, keep_seconds: float) -> list[int]:
        """Remove the versions older than that but for the newest, and all runs that are older and that no kept version lists; returns the kept versions."""
        edge, kept, held = time.time() - keep_seconds, [], set()
        have = self.versions()
        for version in have:
            m = self.manifest(version)
            if version == have[-1] or m["at"] >= edge:
                kept.append(version)
                held |= {r["folder"] for r in m["runs"]}
            else:
                self.fs.delete(self._path("_manifest", f"v{version:08d}.json"), False)
        for s in self.fs.listStatus(self._path()):
            name = s.getPath().getName()
            if not name.startswith("run-") or s.getModificationTime() / 1000 > edge:
                continue
            inner = [f"{name}/{x.getPath().getName()}" for x in self.fs.listStatus(s.getPath()) if x.isDirectory()]
            for folder in inner or [name]:
                if folder not in held:
                    self.fs.delete(self._path(*folder.split("/")), True)
            if inner and not held & set(inner):
                self.fs.delete(s.getPath(), True)
        return kept

    def _read(self, runs: list[dict]) -> DataFrame:
        return self.spark.read.option("recursiveFileLookup", "true").parquet(*[str(self._path(*r["folder"].split("/"))) for r in runs])

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a manifest version; None if the store is empty."""
        runs = self.manifest(version)["runs"]
        return self._read(runs) if runs else None


def shard_documents(docs: DataFrame, root: str, arrivals: int = 8, target_bytes: int = 256 << 20) -> ShardStore:
    """Append docs in `arrivals` deals by a hash of the id, compacting as they come; returns the store.

    Null ids (they hash alike), repeated rows, empty texts and extra columns are stored as they are; an empty table commits
    nothing and its store reads as None.
    """
    store, arrival = ShardStore(docs.sparkSession, root, target_bytes), free_name(docs, "arrival")
    store.append(docs.withColumn(arrival, F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)).cast("int")), arrival)
    return store
